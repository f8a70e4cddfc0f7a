"""Benchmark decontamination by winnowing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.llm.common import cut, row_key

#: Words to a window; every shared run of so many words is found.
WINDOW = 10
#: Words to a fingerprinted gram: each window keeps the smallest hash of its WINDOW - GRAM + 1 grams.
GRAM = 5
#: The filter before the join never has more bits than this (8 MB).
FILTER_BITS = 1 << 26
#: Bytes of a piece of the filter while it is put together.
PIECE = 1 << 15

_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and all characters from U+0080 on."""
    return text.encode().translate(_TABLE).split() if text else []


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxh64_intdigest(word)
        return h


def _gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive words."""
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def window_fingerprints(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window of ``window`` words its winnowed fingerprint: the smallest hash of its grams."""
    grams = _gram_hashes(h, gram)
    n = len(h) - window + 1
    out = grams[:n].copy()
    for j in range(1, window - gram + 1):
        np.minimum(out, grams[j : j + n], out=out)
    return out


def _spans(words: list[bytes], at: np.ndarray, n: int) -> list[bytes]:
    return [hashlib.md5(b" ".join(words[i : i + n])).digest() for i in at.tolist()]


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _probes(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return fp & np.uint64(bits - 1), (fp >> np.uint64(32)) & np.uint64(bits - 1)


def benchmark_windows(items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(item, n, fp, digest): every window of every item with its fingerprint and its exact digest.

    An item of fewer words than ``window``, but not none, is one window, fingerprinted whole.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for rows in batches:
            out: dict[str, list] = {"item": [], "n": [], "fp": [], "digest": []}
            for item, text in zip(rows["item"], rows["text"], strict=True):
                words = words_of(text)
                if not words:
                    continue
                n = min(window, len(words))
                h = np.array([hashes[w] for w in words], np.uint64)
                fps = window_fingerprints(h, n, gram if n == window else n)
                out["item"] += [item] * len(fps)
                out["n"] += [n] * len(fps)
                out["fp"] += _signed(fps)
                out["digest"] += _spans(words, np.arange(len(fps)), n)
            yield pd.DataFrame({c: pd.Series(x, dtype=object if c in ("item", "digest") else "int64") for c, x in out.items()})

    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "item string, n int, fp long, digest binary")


def _bit_filter(windows: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter with two probes over the benchmark's fingerprints, put together piece by
    piece in tasks; at most FILTER_BITS reach the driver."""
    size = min(PIECE, bits // 8)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have: dict[int, np.ndarray] = {}
        for rows in batches:
            for at in _probes(rows["fp"].to_numpy(np.int64).view(np.uint64), bits):
                for p in np.unique(at // np.uint64(size * 8)).tolist():
                    own = at[at // np.uint64(size * 8) == p] % np.uint64(size * 8)
                    piece = have.setdefault(p, np.zeros(size, np.uint8))
                    np.bitwise_or.at(piece, (own >> np.uint64(3)).astype(np.int64), (1 << (own & np.uint64(7))).astype(np.uint8))
        yield pd.DataFrame({"piece": list(have), "data": [x.tobytes() for x in have.values()]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        data = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows["data"]])
        return pd.DataFrame({"piece": rows["piece"].iloc[:1], "data": [data.tobytes()]})

    schema = "piece int, data binary"
    out = np.zeros(bits // 8, np.uint8)
    for row in windows.select("fp").mapInPandas(pieces, schema).groupBy("piece").applyInPandas(merge, schema).toLocalIterator():
        out[row.piece * size : (row.piece + 1) * size] = np.frombuffer(row.data, np.uint8)
    return out


def decontaminate(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """Find the benchmark's windows in every document.

    Each window of a document keeps the smallest of its gram hashes, the same one wherever the
    window stands, so that a window shared with an item always shares a fingerprint. Windows whose
    fingerprint passes a filter of bounded size are joined with the benchmark on fingerprint and,
    as the hit's extension to all its words, on the MD5 of the whole window. Shorter items are
    winnowed at their own length.

    Returns ``id_col``, n_words, n_hit (words inside any occurrence), n_items, items (sorted as
    strings), contaminated, spans (merged [start, end) of words), row_key: one row per input row. Null texts
    have no words; items without words never occur; item ids are compared as strings, repeated
    items count once and null item ids not at all; an empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    bench = cut(benchmark_windows(items, item_col=item_col, text_col=item_text_col, window=window, gram=gram), "benchmark-windows")
    lengths = sorted(r.n for r in bench.select("n").distinct().collect())  # at most ``window`` values
    bits = 1 << 12
    n_windows = bench.count()
    while bits < min(FILTER_BITS, 64 * n_windows):
        bits *= 2
    sieve = spark.sparkContext.broadcast(_bit_filter(bench, bits))

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, bitmap = _Hashes(), sieve.value
        has = lambda at: (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        for rows in batches:
            sizes, found = [], []
            for text in rows["text"]:
                words = words_of(text)
                sizes.append(len(words))
                hits: list[dict] = []
                h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                for n in lengths:
                    if n > len(words):
                        continue
                    fps = window_fingerprints(h, n, gram if n == window else n)
                    one, two = _probes(fps, bits)
                    at = np.flatnonzero(has(one))
                    at = at[has(two[at]).astype(bool)]
                    hits += [{"start": i, "n": n, "fp": f, "digest": d} for i, f, d in zip(at.tolist(), _signed(fps[at]), _spans(words, at, n), strict=True)]
                found.append(hits)
            yield pd.DataFrame({"id": rows["id"], "key": rows["key"], "n_words": pd.Series(sizes, dtype="int64", index=rows.index), "hits": pd.Series(found, dtype=object, index=rows.index)})

    kind = dict(docs.dtypes)[id_col]
    marked = cut(
        docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
        .mapInPandas(candidates, f"id {kind}, key binary, n_words long, hits array<struct<start: int, n: int, fp: long, digest: binary>>")
        .withColumn("row", F.monotonically_increasing_id()),
        "candidates",
    )
    known = bench.select("fp", "digest", "n").distinct()
    hits = cut(marked.select("row", F.inline("hits")).join(known, ["fp", "digest", "n"]).select("row", "start", "n", "digest"), "hits")
    # Spans that overlap or touch are one island: a span opens one if it starts after all ends before it.
    ordered = Window.partitionBy("row").orderBy("start", "n")
    before = F.max(F.col("start") + F.col("n")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    islands = hits.select("row", "start", "n").distinct().withColumn("opens", F.coalesce(F.col("start") > before, F.lit(True)).cast("long"))
    islands = islands.withColumn("island", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy("row", "island").agg(F.min("start").alias("s"), F.max(F.col("start") + F.col("n")).alias("e"))
    covered = islands.groupBy("row").agg(F.sum(F.col("e") - F.col("s")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    owners = bench.where("item is not null").select("digest", "item").distinct()
    owned = hits.select("row", "digest").distinct().join(owners, "digest").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    empty = F.array().cast("array<string>")
    return marked.drop("hits").join(covered, "row", "left").join(owned, "row", "left").select(
        F.col("id").alias(id_col), "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", empty).alias("items"), F.col("spans").isNotNull().alias("contaminated"), "spans", F.col("key").alias("row_key"),
    )
