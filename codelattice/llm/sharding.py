"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.llm.common import cut, free_name, row_key

#: Rounds of the network.
ROUNDS = 8
#: Rows to a task that numbers them.
ROWS = 1_000_000
#: Bytes that a document takes beside its text.
OVERHEAD = 8

# Multipliers of the round function.
_A, _B = 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D
_ALL = (1 << 64) - 1


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """One 64-bit key a round."""
    out = []
    for r in range(rounds):
        z = (seed * _A + (r + 1) * _B) & _ALL
        out.append((((z ^ (z >> 31)) * _A) & _ALL) ^ (z >> 29))
    return out


def halves(n: int) -> tuple[int, int]:
    """Bits of the left and of the right half of the smallest domain of whole bits, two at least, that holds n numbers."""
    bits = max(2, (max(n, 1) - 1).bit_length())
    return bits // 2, bits - bits // 2


def _mixed(x: np.ndarray, key: int, bits: int) -> np.ndarray:
    y = x * np.uint64(_A) + np.uint64(key)
    return ((y ^ (y >> np.uint64(32))) * np.uint64(_B)) >> np.uint64(64 - bits)


def _network(x: np.ndarray, keys: list[tuple[int, int]], left: int, right: int) -> np.ndarray:
    """Each round changes one half by the other: the left in even rounds, the right in odd ones, so the same rounds backwards undo it."""
    hi, lo = x >> np.uint64(right), x & np.uint64((1 << right) - 1)
    for r, key in keys:
        if r % 2:
            lo = lo ^ _mixed(hi, key, right)
        else:
            hi = hi ^ _mixed(lo, key, left)
    return (hi << np.uint64(right)) | lo


def permute(x: np.ndarray, n: int, seed: int, *, inverse: bool = False) -> np.ndarray:
    """The place of each row number under a permutation of 0 to n - 1, or with ``inverse`` the row number at each place.

    The network permutes the whole domain, which is less than twice n (4 at least); numbers from n on walk on
    along their cycle until they are below n. A cycle that starts below n returns there, so the walk ends.
    """
    keys = list(enumerate(round_keys(seed)))
    left, right = halves(n)
    out = np.asarray(x).astype(np.uint64)
    out = _network(out, keys[::-1] if inverse else keys, left, right)
    while len(far := np.flatnonzero(out >= np.uint64(n))):
        out[far] = _network(out[far], keys[::-1] if inverse else keys, left, right)
    return out.astype(np.int64)


def place_of(row_number: int, n: int, shards: int, seed: int = 42) -> tuple[int, int]:
    """Shard and slot of a row number, without a look at the data."""
    at = int(permute(np.array([row_number]), n, seed)[0])
    return at % shards, at // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 42) -> int:
    """The row number that stands in a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def _hashable(df: DataFrame, but: set[str]) -> list:
    return [F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in but and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]


def number_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``row_number``, from 0 in the order of the columns ``order``, nulls first.

    Rows are dealt into ranges of about ROWS rows, each is sorted, and a row's number is its place in the range after the
    counts of the ranges before, of which there is one for each million rows. Rows that agree in ``order``
    fall into one range, so its last column should tell rows apart.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS + 1)
    placed = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "numbered")
    counts = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), F.shiftright("at", 33) == F.col("part")).withColumn(
        "row_number", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "before")


def shard_places(
    docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, row_col: str | None = None,
) -> DataFrame:
    """Shard and slot of every row: ``id_col``, size, text_crc32, row_number, shard, slot, row (one row per input row).

    Rows are numbered in the order of id, digest of id and text, and hash of the other columns (but maps), so that the
    numbers don't depend on files or partitions; rows equal in all of these get neighbouring numbers in any
    order. A Feistel network with cycle walking turns a number into a place; its remainder by ``shards`` is the shard and
    its quotient the slot. Shards differ by one row at most, their slots have no gaps, and both follow from the row number,
    the number of rows, the number of shards and the seed alone (``place_of``, ``row_at``). size is the UTF-8 bytes of the text
    and OVERHEAD; a null text has none, and the CRC of an empty one. Null ids come first. ``row`` is the row's value of ``row_col``, if
    given, else a number of this run. Texts are read once and not shuffled; an empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
        row_key(id_col, text_col).alias("digest"), F.xxhash64(F.lit(seed), *_hashable(docs, {id_col, text_col, row_col})).alias("others"),
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
    )
    slim = cut(slim, "rows")
    n = slim.count()

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    placed = number_rows(slim, ["id", "digest", "others", "row"]).withColumn("place", place("row_number"))
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", "row_number", (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"), "row")


def write_shards(docs: DataFrame, path: str, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """Write ``docs`` shuffled: a folder ``shard=k`` for each shard, whose files in the order of their names hold its rows by slot.

    All columns are written, and ``slot`` (with underscores, like ``shard``, where documents have such a column).
    A shard is written by several tasks, each a range of its slots. Returns the written table.
    """
    row, shard, slot, key = (free_name(docs, x) for x in ("shard_row", "shard", "slot", "shard_key"))
    kept = cut(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    places = shard_places(kept, shards, id_col=id_col, text_col=text_col, seed=seed, row_col=row)
    places = places.select(F.col("row").alias(key), F.col("shard").alias(shard), F.col("slot").alias(slot))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards)
    out = kept.join(places, kept[row] == places[key]).drop(row, key).repartitionByRange(parts, shard, slot).sortWithinPartitions(shard, slot)
    out.write.partitionBy(shard).parquet(path)
    return docs.sparkSession.read.parquet(path)
