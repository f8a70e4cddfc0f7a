"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm.common import join_hot, scratch_path

CACHE_SCHEMA = "content_digest binary, n_tokens long"


def tokenizer_version(model: bytes, library: str) -> str:
    """Digest of the model file and the library with its version: counts hold for that pair only."""
    return hashlib.sha256(library.encode() + b"\n" + model).hexdigest()


def _load(kind: str, model: bytes):
    """A function from texts to token counts, without special tokens, truncation or padding."""
    if kind == "sentencepiece":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1, add_bos=False, add_eos=False)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(model.decode())
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]


def _encoder(kind: str, model: bytes, batch_chars: int):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = None
        for rows in batches:
            count = count or _load(kind, model)
            counts: list[int] = []
            texts: list[str] = []
            chars = 0
            for text in rows["text"]:
                texts.append(text)
                chars += len(text)
                if chars >= batch_chars:
                    counts += count(texts)
                    texts, chars = [], 0
            if texts:
                counts += count(texts)
            yield pd.DataFrame({"content_digest": rows["content_digest"], "n_tokens": pd.Series(counts, dtype="int64", index=rows.index)})

    return encode


def _cached(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; a folder that is not there yet is an empty cache."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        # Two writers may have stored the same digest: their counts are equal.
        return spark.read.schema(CACHE_SCHEMA).parquet(path).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(
    docs: DataFrame, model_path: str, *, cache: str | None = None, id_col: str = "doc_id",
    text_col: str = "text", limit: int = 4096, batch_chars: int = 1_000_000,
) -> DataFrame:
    """Count the tokens of every whole text, encoding each distinct text once.

    Texts are normalised by taking null as empty, and digested with SHA-256; the tokenizer's own
    digest names a folder of ``cache``. Digests found there are not encoded again; the distinct
    misses are encoded in tasks, one copy of each, and appended. The cache is a Parquet folder
    (one of the shared folder's if not given) and only ever grows, so a run that is repeated
    after a loss finds what earlier tasks committed.

    Returns ``id_col``, n_bytes, n_tokens, over_limit, one row per input row; equal texts have
    equal counts, repeated rows stay repeated, an empty table gives no rows, other columns are
    left out. Copies in a large share of all rows are dealt over several tasks (``join_hot``). The model file (a few MB at most) is read by the driver and sent with the tasks.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = f.read()
    if model_path.endswith(".model"):
        import sentencepiece as library

        kind = "sentencepiece"
    else:
        import tokenizers as library

        kind = "tokenizers"
    folder = f"{cache or scratch_path(spark, 'token-cache')}/{tokenizer_version(model, f'{kind} {library.__version__}')}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("content_digest"))
    known = _cached(spark, folder)
    (
        # One copy of each text leaves a task, so copies are no hot group; then those that are known drop out.
        rows.groupBy("content_digest").agg(F.first("text").alias("text"))
        .join(known, "content_digest", "left_anti")
        .mapInPandas(_encoder(kind, model, batch_chars), CACHE_SCHEMA)
        .write.mode("append").parquet(folder)
    )
    counts = _cached(spark, folder)
    sized = rows.select(F.col(id_col).alias("id"), "content_digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return join_hot(sized, counts, "content_digest").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
