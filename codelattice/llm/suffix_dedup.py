"""Removal of repeated byte strings with a difference cover of the suffixes.

A string of ``length`` bytes repeats if it starts at two positions. With a difference cover D
modulo v every two positions i and j have an offset d < v with i + d and j + d both in the cover,
so it is enough to know which *cover* suffixes share their first length - v + 1 bytes. Their ranks
are worked out first (as classes of equal prefixes). Then only suffixes within v bytes before a
shared cover suffix are sorted to depth ``length``, one bucket at a time; suffixes that still tie
at that depth are repeated. Matches end there, so longer ties need no order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import cut, scratch_path

#: Bytes of a string whose repeats are removed.
LENGTH = 200
#: A perfect difference set; each residue modulo PERIOD is the difference of one ordered pair.
PERIOD = 133
COVER = (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
#: Texts are gathered to blocks of about so many bytes; a bucket of suffixes comes from about BUCKET bytes of text.
BLOCK, BUCKET = 1 << 22, 1 << 25
#: Bytes of text to one task over the blocks.
PART = 1 << 27
#: Hash bits: enough to leave few chance ties among cover suffixes, and next to none at full depth.
SAMPLE_BITS, FULL_BITS = 34, 64

_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, up to n."""
    if len(_powers.get("up", ())) < n + 1:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(n + 1, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    return h * np.uint64(0x94D049BB133111EB)


def _hashes(data: np.ndarray, at: np.ndarray, length: int, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``length`` bytes at sorted positions, and of their first halves."""
    full, half = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
    for lo in range(0, len(data), piece):
        a, b = np.searchsorted(at, (lo, lo + piece))
        if a == b:
            continue
        part = data[lo : lo + piece + length]
        up, down = _power_table(piece + length)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * up[: len(part)], out=sums[1:])
        p = at[a:b] - lo
        full[a:b] = _mixed((sums[p + length] - sums[p]) * down[p])
        half[a:b] = _mixed((sums[p + length // 2] - sums[p]) * down[p])
    return full, half


class _Classes:
    """The suffixes at some positions of a block, sorted by bucket and hash."""

    def __init__(self, data: np.ndarray, at: np.ndarray, length: int, bits: int, buckets: int):
        full, half = _hashes(data, at, length)
        full >>= np.uint64(64 - bits)
        bucket = (half % np.uint64(buckets)).astype(np.int32)
        self.order = np.lexsort((full, bucket))
        self.bucket, self.hash = bucket[self.order], full[self.order]
        new = np.ones(len(at), bool)
        if len(at):
            new[1:] = (self.hash[1:] != self.hash[:-1]) | (self.bucket[1:] != self.bucket[:-1])
        self.start = np.flatnonzero(new)
        self.member = np.cumsum(new) - 1
        self.several = np.diff(np.append(self.start, len(at))) > 1

    def rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, distinct hashes, whether several positions have them)."""
        bucket, values = self.bucket[self.start], self.hash[self.start]
        for b in np.unique(bucket):
            i, j = np.searchsorted(bucket, (b, b + 1))
            yield int(b), pack(values[i:j]), np.packbits(self.several[i:j]).tobytes()

    def flags(self, replies: dict[int, bytes]) -> np.ndarray:
        """From the buckets' answers, one bit per distinct hash: which positions are repeated, in
        the order of the positions."""
        bucket = self.bucket[self.start]
        shared = np.zeros(len(self.start), bool)
        for b, data in replies.items():
            i, j = np.searchsorted(bucket, (b, b + 1))
            shared[i:j] = np.unpackbits(np.frombuffer(data, np.uint8), count=j - i).astype(bool)
        out = np.zeros(len(self.order), bool)
        out[self.order] = shared[self.member]
        return out


def pack(values: np.ndarray) -> bytes:
    """Sorted numbers as byte planes of their differences: the high planes are zeros and compress away."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    planes = gaps.view(np.uint8).reshape(-1, 8).T
    used = max((i + 1 for i in range(8) if planes[i].any()), default=1)
    return bytes([used]) + np.ascontiguousarray(planes[:used]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    used = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(used, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :used] = planes.T
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64)


def _sort_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Sort one bucket's suffixes from all blocks: a hash that several blocks have, or one block
    several times, is shared."""
    values = [unpack(x) for x in rows["hashes"]]
    sizes = [len(x) for x in values]
    every = np.concatenate(values)
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    shared = np.zeros(len(every), bool)
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    out, at = [], 0
    for n, several in zip(sizes, rows["several"], strict=True):
        own = shared[at : at + n] | np.unpackbits(np.frombuffer(several, np.uint8), count=n).astype(bool)
        out.append(np.packbits(own).tobytes())
        at += n
    return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "shared": pd.Series(out, dtype=object, index=rows.index)})


class _Block:
    def __init__(self, data: bytes, sizes: list[int], length: int):
        self.data, self.length = np.frombuffer(data, np.uint8), length
        self.sizes = np.asarray(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)

    def cover(self, prefix: int) -> np.ndarray:
        """Positions of the cover, counted from each document's start, with ``prefix`` bytes left;
        documents that are too short have none."""
        marks = np.zeros(PERIOD, bool)
        marks[list(COVER)] = True
        out = []
        for end, n in zip(self.ends.tolist(), self.sizes.tolist(), strict=True):
            if n >= self.length:
                out.append(np.flatnonzero(np.resize(marks, n - prefix + 1)) + (end - n))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Positions that have a shared cover position within PERIOD bytes and ``length`` bytes left."""
        ok = np.zeros(len(self.data) + PERIOD, np.int32)
        np.add.at(ok, shared, 1)
        seen = np.concatenate([[0], np.cumsum(ok, dtype=np.int32)])
        near = seen[PERIOD : PERIOD + len(self.data)] > seen[: len(self.data)]
        for end, n in zip(self.ends.tolist(), self.sizes.tolist(), strict=True):
            near[max(end - n, end - self.length + 1) : end] = False
        return np.flatnonzero(near)

    def covered(self, repeated: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(self.data) + self.length + 1, np.int32)
        edge[repeated] += 1
        edge[repeated + self.length] -= 1
        return np.cumsum(edge[: len(self.data)]) > 0


def _blocks(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """Rows (ids, sizes, data) of about ``block`` bytes of whole texts each."""
    kind = dict(docs.dtypes)[id_col]

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        texts: list[bytes] = []
        n = 0
        row = lambda: pd.DataFrame({"ids": [ids], "sizes": [[len(x) for x in texts]], "data": pd.Series([b"".join(texts)], dtype=object)})
        for rows in batches:
            for i, text in zip(rows["id"].astype(object), rows["text"], strict=True):
                data = (text or "").encode()
                if texts and n + len(data) > block:
                    yield row()
                    ids, texts, n = [], [], 0
                ids.append(None if i is None or i != i else i)
                texts.append(data)
                n += len(data)
        if texts:
            yield row()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(gather, f"ids array<{kind}>, sizes array<int>, data binary").withColumn("block", F.monotonically_increasing_id())


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block: int = BLOCK, bucket: int = BUCKET,
) -> DataFrame:
    """Remove every byte that a repeated string of ``length`` bytes covers.

    Texts are UTF-8 bytes (null: empty) and strings never cross documents; a string repeats if it
    also starts at another place, of the same document too. All strings are judged on the input.
    ``length`` is at least PERIOD + 16.

    Texts are gathered to blocks and written once, bucketed by block, so that answers are joined to
    them without shuffling text, in tasks of about PART bytes at any size of the input. A block sends each distinct hash of a bucket once, so that a passage
    in a third of all documents is no hot group; it gets a bit for each back. A bucket holds what
    about ``bucket`` bytes of text send, at any size of the input.

    Returns ``id_col``, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept
    (binary: the remaining bytes): one row per input row, repeated rows included. An empty table gives
    no rows; texts shorter than ``length`` stay whole.
    """
    if length < PERIOD + 16:
        raise ValueError(f"length must be {PERIOD + 16} or more")
    spark = docs.sparkSession
    prefix = length - PERIOD + 1
    kind = dict(docs.dtypes)[id_col]
    name = scratch_path(spark, "blocks").rsplit("/", 1)[1].replace("-", "_")
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    n_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    (
        _blocks(docs, id_col, text_col, block).write.bucketBy(n_parts, "block")
        .option("path", scratch_path(spark, "blocks")).option("compression", "zstd").saveAsTable(name)
    )
    blocks = spark.table(name)
    buckets = max(4, -(-total // bucket))
    sends = "block long, bucket int, hashes binary, several binary"

    def send(block_id: int, classes: _Classes) -> pd.DataFrame:
        rows = list(classes.rows())
        return pd.DataFrame({
            "block": pd.Series([block_id] * len(rows), dtype="int64"), "bucket": pd.Series([r[0] for r in rows], dtype="int32"),
            "hashes": pd.Series([r[1] for r in rows], dtype=object), "several": pd.Series([r[2] for r in rows], dtype=object),
        })

    def cover_classes(b: _Block) -> tuple[np.ndarray, _Classes]:
        at = b.cover(prefix)
        return at, _Classes(b.data, at, prefix, SAMPLE_BITS, buckets)

    def answers(x) -> dict[int, bytes]:
        return {r["bucket"]: r["shared"] for r in x} if x is not None else {}

    def suffix_classes(b: _Block, ranks) -> tuple[np.ndarray, _Classes]:
        at, cover = cover_classes(b)
        near = b.candidates(at[cover.flags(answers(ranks))])
        return near, _Classes(b.data, near, length, FULL_BITS, buckets)

    def send_cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                yield send(r.block, cover_classes(_Block(r.data, r.sizes, length))[1])

    def send_suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                yield send(r.block, suffix_classes(_Block(r.data, r.sizes, length), r.ranks)[1])

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                b = _Block(r.data, r.sizes, length)
                near, classes = suffix_classes(b, r.ranks)
                gone = b.covered(near[classes.flags(answers(r.repeats))])
                out: list[tuple] = []
                for i, end, n in zip(r.ids, b.ends.tolist(), b.sizes.tolist(), strict=True):
                    own = gone[end - n : end]
                    kept = b.data[end - n : end][~own].tobytes()
                    spans = int(np.count_nonzero(np.diff(own.astype(np.int8), prepend=0) == 1))
                    out.append((i, n, n - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
                cols = list(zip(*out, strict=True))
                yield pd.DataFrame({
                    "id": pd.Series(cols[0], dtype=object), "n_bytes": pd.Series(cols[1], dtype="int64"), "n_removed": pd.Series(cols[2], dtype="int64"),
                    "n_spans": pd.Series(cols[3], dtype="int64"), "kept_sha256": pd.Series(cols[4], dtype=object), "kept": pd.Series(cols[5], dtype=object),
                })

    def answered(sent: DataFrame, as_name: str) -> DataFrame:
        found = sent.groupBy("bucket").applyInPandas(_sort_bucket, "block long, bucket int, shared binary")
        return cut(found.groupBy("block").agg(F.collect_list(F.struct("bucket", "shared")).alias(as_name)), as_name)

    ranks = answered(blocks.select("block", "sizes", "data").mapInPandas(send_cover, sends), "ranks")
    ranked = blocks.join(ranks, "block", "left")
    repeats = answered(ranked.select("block", "sizes", "data", "ranks").mapInPandas(send_suffixes, sends), "repeats")
    done = ranked.join(repeats, "block", "left").select("ids", "sizes", "data", "ranks", "repeats").mapInPandas(
        remove, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = cut(done.withColumnRenamed("id", id_col), "kept")
    spark.sql(f"DROP TABLE `{name}`")
    return out
