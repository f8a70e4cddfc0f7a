"""Divergence of sources in the terms that they use."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.llm.common import cut

#: Documents of a language that a kept term is in.
MIN_DOCS = 30
#: What every kept term's count has on top.
PRIOR = 5
#: Probabilities are in parts of this.
UNIT = 1_000_000_000
#: Terms of a group are listed up to this rank.
TOP = 50
#: Rows of the count-min sketch, each with its own hash.
DEPTH = 4
#: Cells of a sketch row: the power of two from 16 a document on, between these. The sketch has DEPTH bytes a cell, so 16 MB at most.
WIDTH = (1 << 16, 1 << 22)
#: A task hands on its counts when it holds so many terms, or has read so many bytes of text since.
HELD, HELD_BYTES = 400_000, 64 << 20
#: Cells of a piece of the sketch while it is put together.
PIECE = 1 << 13

_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased) and all characters from U+0080 on, of a text in UTF-8."""
    return text.translate(_TABLE).split() if text else []


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of each term, summed up within each task as far as its memory
    allows, so a term can have several rows. Each group also has a row of the empty term, with n and df 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, seen) in groups.items():
                terms = list(n)
                columns = ([lang] * len(terms), [source] * len(terms), terms, list(n.values()), [seen[t] for t in terms])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["lang", "source", "term", "n", "df"])

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, seen = groups.get((lang, source)) or groups.setdefault((lang, source), (Counter({b"": 0}), Counter()))
                terms, before = terms_of(text), len(n)
                n.update(terms)
                seen.update(set(terms))
                held += len(n) - before
                size += len(text or b"")
                if held > HELD or size > HELD_BYTES:
                    yield from emit()
                    groups, held, size = {}, 0, 0
        yield from emit()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term binary, n long, df long").withColumn("term", F.col("term").cast("string"))


def _cells(h: np.ndarray, width: int) -> np.ndarray:
    """One cell in each sketch row for each 64-bit hash."""
    h = h.view(np.uint64)
    one, two = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((one + np.uint64(r) * two) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & np.uint64(width - 1) for r in range(DEPTH)]).astype(np.int64)


def document_sketch(counts: DataFrame, width: int) -> np.ndarray:
    """A count-min sketch (DEPTH x width, one byte a cell, 255 for more) of the document frequencies of (h, df) rows.

    Every task sketches its rows and sends the pieces that aren't empty; pieces are added up, so a frequency is never
    underestimated below 255. DEPTH * width bytes reach the driver.
    """
    piece = min(PIECE, width)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(DEPTH * width, np.uint32)
        for rows in batches:
            df = np.minimum(rows["df"].to_numpy(), 255).astype(np.uint32)
            for r, at in enumerate(_cells(rows["h"].to_numpy(np.int64), width)):
                at = at + r * width
                np.add.at(own, at, df)
                own[at] = np.minimum(own[at], 255)
        own = own.astype(np.uint8).reshape(-1, piece)
        used = np.flatnonzero(own.any(axis=1))
        for chunk in np.array_split(used, max(1, len(used) // 64)):
            yield pd.DataFrame({"piece": chunk.astype(np.int32), "data": [own[p].tobytes() for p in chunk]})

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(piece, np.uint32)
        for rows in batches:
            for x in rows["data"]:
                total = np.minimum(total + np.frombuffer(x, np.uint8), 255).astype(np.uint32)
        yield pd.DataFrame({"piece": [key[0]], "data": [total.astype(np.uint8).tobytes()]})

    schema = "piece int, data binary"
    out = np.zeros((DEPTH * width // piece, piece), np.uint8)
    merged = counts.select("h", "df").mapInPandas(parts, schema).groupBy("piece").applyInPandas(add, schema)
    for row in merged.toLocalIterator():
        out[row.piece] = np.frombuffer(row.data, np.uint8)
    return out.reshape(DEPTH, width)


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n) of the terms in at least ``min_docs`` documents of their language, and the (lang, source) groups of all documents.

    The counts of each task are written once. Terms that the sketch puts under ``min_docs`` are impossible and are not
    shuffled; the others' counts are added up and their document frequencies are checked exactly.
    """
    spark = docs.sparkSession
    if not 1 <= min_docs <= 255:
        raise ValueError("a cell of the sketch counts to 255")
    counts = cut(term_counts(docs, **columns), "term-counts")
    groups = cut(counts.where("term = ''").select("lang", "source").distinct(), "groups")
    terms = counts.where("term <> ''").withColumn("h", F.xxhash64("lang", "term"))
    width = WIDTH[0]
    n_docs = docs.count()
    while width < min(WIDTH[1], 16 * n_docs):
        width *= 2
    sketch = spark.sparkContext.broadcast(document_sketch(terms, width))

    @F.pandas_udf("boolean")
    def possible(h: pd.Series) -> pd.Series:
        at = _cells(h.to_numpy(np.int64), width)
        return pd.Series(np.min([sketch.value[r][at[r]] for r in range(DEPTH)], axis=0) >= min_docs)

    exact = cut(terms.where(possible("h")).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "survivors")
    kept = exact.groupBy("lang", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= min_docs).select("lang", "term")
    return cut(exact.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "kept-counts"), groups


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * terms)) in whole numbers."""
    top = (n + PRIOR).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", top, F.greatest(total + PRIOR * terms, F.lit(1)).cast("decimal(20,0)"))


def divergence(
    docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """How far the sources of a language are apart, and which terms mark each of them: (lang, source, part, item, value, rank).

    A term is a run of ASCII letters (lower-cased) and characters from U+0080 on; kept are terms in ``min_docs`` documents of the language.
    A group (lang, source) with count c of a kept term, N of all and V kept terms gives it p = 1 + floor(UNIT * (c + PRIOR) / (N + PRIOR * V)).
    Part ``pair``: the sum over all kept terms of the difference of both sources' p (0 without kept terms), all pairs both ways.
    Part ``term``: kept terms of the group whose p is over the language's, by the difference, up to ``top``.

    Pairs are summed sparsely: a group's terms against the p that the other gives to an absent term, from the group's histogram of
    counts, then a correction for terms that both have, from a join on the term. All numbers are whole.
    Null texts, languages and sources count as empty ones; groups without terms give all terms the same p; an empty table gives no rows.
    """
    counts, groups = kept_counts(docs, min_docs, text_col=text_col, lang_col=lang_col, source_col=source_col)
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "v", "total_lang")))
    groups = cut(groups.withColumn("p0", _share(F.lit(0), F.col("total"), F.col("v"))), "shares")
    shares = cut(counts.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("v"))), "term-shares")

    # Ordered pairs of sources, which are also rows of the result, with what each gives to absent terms.
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = cut(groups.select("lang", "source", "p0", "v").join(other, "lang").where("source <> item"), "pairs")
    histogram = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    own = pairs.join(histogram, ["lang", "source"]).groupBy("lang", "source", "item").agg(
        F.sum(F.col("terms") * (F.abs(F.col("p") - F.col("q0")) - F.abs(F.col("p0") - F.col("q0")))).alias("value"))
    both = shares.select("lang", "term", "source", "p", "p0").join(
        shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0")), ["lang", "term"]).where("source < item")
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    shared = both.groupBy("lang", "source", "item").agg(F.sum(gap("p", "q") - gap("p", "q0") - gap("q", "p0") + gap("p0", "q0")).alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    base = pairs.select("lang", "source", "item", (F.col("v") * gap("p0", "q0")).alias("value"))
    pair = base.union(own).union(turned(own)).union(shared).union(turned(shared)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pair = pair.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    marks = shares.join(vocabulary, ["lang", "term"]).withColumn("value", F.col("p") - _share(F.col("n_lang"), F.col("total_lang"), F.col("v"))).where("value > 0")
    marks = marks.select("lang", "source", F.col("term").alias("item"), "value")
    marks = marks.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    columns = lambda part: ("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return pair.select(*columns("pair")).union(marks.select(*columns("term")))
