"""SimHash near-dedup: pigeonhole blocks, then verified Hamming distances."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import connected_components, cut, join_hot, row_key

#: Words to a shingle, and the largest number of differing bits of a link.
SHINGLE, BITS = 4, 4
#: The 64 bits are cut into so many blocks; a close pair agrees in at least BLOCKS - BITS of them.
BLOCKS = 7
#: A bucket with more fingerprints is compared chunk against chunk, each pair of chunks a task's row.
CHUNK = 1024


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, as a signed number.

    Words are runs of bytes other than space and 0x09 to 0x0D after lower-casing A-Z; a shingle is
    ``shingle`` words joined by spaces (fewer words: all of them). A bit is 1 if it is set in over
    half of the shingles' XXH64 hashes (seed 42). No words, or null: zero.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(parts), 65536):
        some = parts[at : at + 65536]
        h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in some), ">u8", len(some))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(parts)).view(">i8")[0])


def block_masks(blocks: int = BLOCKS, bits: int = BITS) -> list[int]:
    """One mask for each choice of ``blocks - bits`` blocks, as signed numbers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(x) for x in combinations(part, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _roots(values: np.ndarray, bits: int) -> np.ndarray:
    """For each fingerprint the smallest position that close pairs connect it to."""
    n = len(values)
    left, right = [], []
    for at in range(0, n, 256):
        i, j = np.nonzero(np.bitwise_count(values[at : at + 256, None] ^ values[None, :]) <= bits)
        left.append(i + at)
        right.append(j)
    a, b = np.concatenate(left), np.concatenate(right)
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _forest(bits: int):
    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            a: list[int] = []
            b: list[int] = []
            for fps in rows["fps"]:
                if len(fps) == 2:
                    x, y = int(fps[0]), int(fps[1])
                    if ((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() <= bits:
                        a.append(x)
                        b.append(y)
                    continue
                v = np.asarray(fps, np.int64)
                root = _roots(v.view(np.uint64), bits)
                far = root != np.arange(len(v))
                a += v[far].tolist()
                b += v[root[far]].tolist()
            yield pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    return forest


def close_pairs(fps: DataFrame, *, bits: int = BITS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` as all pairs within ``bits``
    differing bits do: a spanning forest of each bucket, never all its pairs.

    Two fingerprints that differ in at most ``bits`` of 64 bits agree in ``blocks - bits`` whole
    blocks, so they share a bucket under one of the masks. Buckets of one are dropped. In a bucket of
    more than ``chunk`` those close to its smallest fingerprint are linked to that and need no
    comparison with each other; the rest is compared with all of the bucket, chunk against chunk, in
    arrays of at most about ``2 * chunk``: exact for any size, with bounded memory.
    """
    masks = F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(blocks, bits)))
    rows = fps.select("fp", F.posexplode(masks).alias("mask", "block"))
    shared = cut(rows.groupBy("mask", "block").agg(F.count("*").alias("n"), F.min("fp").alias("leader")).where("n > 1"), "shared")
    key = ["mask", "block"]
    # Merged, never broadcast: the buckets are as many as the fingerprints.
    small = rows.join(shared.where(F.col("n") <= chunk).select(key).hint("merge"), key).groupBy(key).agg(F.collect_list("fp").alias("fps")).select("fps")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("leader"))) <= bits
    large = cut(rows.join(shared.where(F.col("n") > chunk).drop("n").hint("merge"), key).withColumn("near", near), "large")
    linked = large.where("near and fp <> leader").select(F.col("leader").alias("a"), F.col("fp").alias("b"))
    sizes = large.groupBy(key).agg(_chunks(F.col("near"), chunk).alias("nears"), _chunks(~F.col("near"), chunk).alias("fars")).where("fars > 0")
    own = F.pmod(F.xxhash64("fp", "mask"), F.when(F.col("near"), F.col("nears")).otherwise(F.col("fars"))).cast("int")
    cells = large.join(sizes, key).withColumn("own", own).select(*key, "fp", F.explode(_cells()).alias("at"))
    cells = cells.groupBy(*key, "at").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("fps")
    return small.union(cells).mapInPandas(_forest(bits), "a long, b long").union(linked).distinct()


def _chunks(condition: Column, chunk: int) -> Column:
    """Into how many chunks the rows with the condition are dealt."""
    return F.ceil(F.count_if(condition) / F.lit(chunk)).cast("int")


def _cells() -> Column:
    """The cells in which a row of a large bucket meets others: its chunk (``own`` of ``nears`` or ``fars``) of
    near rows with every chunk of far ones, of far rows with every chunk."""
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda c, d: F.struct(c.alias("c"), d.alias("d"))
    nears = F.when(F.col("nears") > 0, F.transform(to("nears"), lambda x: cell(F.col("own"), -1 - x))).otherwise(F.array().cast("array<struct<c: int, d: int>>"))
    return F.when(F.col("near"), F.transform(to("fars"), lambda x: cell(x, -1 - F.col("own")))).otherwise(F.concat(
        F.transform(to("fars"), lambda x: cell(F.least(x, F.col("own")), F.greatest(x, F.col("own")))), nears))


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS,
    blocks: int = BLOCKS, chunk: int = CHUNK,
) -> DataFrame:
    """One row per document: ``id_col``, fingerprint (16 hex digits), component_id, row_key, kept (the
    component's first document by id and key).

    Documents whose fingerprints differ in at most ``bits`` bits are linked; component_id is the
    smallest id that links reach, the document's own included. Equal fingerprints are joined before
    any pair is looked for, so copies cost nothing. Null and empty texts have fingerprint zero and
    are linked like any other; null ids never become a component_id while their component has
    another id; repeated rows stay repeated.
    """
    def fingerprint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"id": rows["id"], "key": rows["key"], "fp": pd.Series([simhash(x, shingle) for x in rows["text"]], dtype="int64", index=rows.index)})

    kind = dict(docs.dtypes)[id_col]
    marked = cut(
        docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
        .mapInPandas(fingerprint, f"id {kind}, key binary, fp long"),
        "fingerprints",
    )
    classes = cut(marked.groupBy("fp").agg(F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")), "classes")
    labels = connected_components(close_pairs(classes.select("fp"), bits=bits, blocks=blocks, chunk=chunk))
    labelled = cut(classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "first", F.coalesce("label", "fp").alias("label")), "labels")
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.min("first").alias("kept"))
    named = cut(join_hot(labelled.select("fp", "label"), smallest, "label").select("fp", "component_id", F.col("kept.key").alias("kept_key")), "components")
    return join_hot(marked, named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("key").alias("row_key"),
        (F.col("key") == F.col("kept_key")).alias("kept"))


#: Similarity search: words to a shingle, and words of 64 bits in a fingerprint.
SIMILAR_SHINGLE, LONGS = 5, 8
#: Blocks of a text, and minima in each: sets of similarity s share a block with probability 1 - (1 - s ** 4) ** 25,
#: however the differences lie in the text.
SIMILAR_BLOCKS, MINIMA = 25, 4
_NAMES = [f"f{i}" for i in range(LONGS)]


def allowed_bits(similarity: float, bits: int = 64 * LONGS, deviations: float = 5) -> int:
    """The largest distance taken for a candidate at this Jaccard similarity: a bit of two sets differs with
    probability acos(cosine) / pi; five standard deviations are added, so that fewer than one in a million pairs at the bound are lost."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + deviations * np.sqrt(bits * p * (1 - p)))


def _mix(z: np.ndarray) -> np.ndarray:
    """The finishing steps of SplitMix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_set(words: list[bytes], shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The sorted distinct XXH64 hashes of a text's shingles (fewer words: all of them); none without words."""
    parts = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words] if words else []
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(x), 42) for x in parts], np.uint64))


def wide_simhash(h: np.ndarray, longs: int = LONGS) -> np.ndarray:
    """``longs`` words of 64 bits: the SimHash of a set of hashes, each stretched by SplitMix64 steps."""
    steps = np.arange(1, longs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * longs, np.int64)
    for at in range(0, len(h), 4096):
        z = _mix(h[at : at + 4096, None] + steps)
        ones += np.unpackbits(z.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(ones * 2 > len(h)).view(np.int64)


_FACTORS = _mix(np.arange(1, SIMILAR_BLOCKS * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def min_blocks(h: np.ndarray) -> np.ndarray:
    """The blocks of a set of hashes: each a hash of the set's minima under MINIMA orders. An empty set has none."""
    if not len(h):
        return np.zeros(0, np.int64)
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for at in range(0, len(h), 1024):
        least = np.minimum(least, (h[at : at + 1024, None] * _FACTORS).min(axis=0))
    block = np.arange(1, SIMILAR_BLOCKS + 1, dtype=np.uint64)
    for x in least.reshape(SIMILAR_BLOCKS, MINIMA).T:
        block = _mix(block ^ x) + np.uint64(0x9E3779B97F4A7C15)
    return block.view(np.int64)


def _words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def _node(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), 0) - (1 << 63)


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        node, fps, blocks = [], [], []
        for text in rows["text"]:
            words = _words(text)
            h = shingle_set(words)
            node.append(_node(words))
            fps.append(wide_simhash(h))
            blocks.append(min_blocks(h))
        fp = np.array(fps, np.int64).reshape(-1, LONGS)
        yield pd.DataFrame({"id": rows["id"], "key": rows["key"], "node": np.array(node, np.int64), **dict(zip(_NAMES, fp.T, strict=True)), "blocks": blocks})


def _shingle_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        words = [_words(x) for x in rows["text"]]
        yield pd.DataFrame({"node": np.array([_node(w) for w in words], np.int64), "shingles": [shingle_set(w).view(np.int64) for w in words]})


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) * (1 - 1e-9):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) >= similarity


def _spanning(limit: int, similarity: float | None):
    """Edges of a spanning forest of each cell: a search from node to node over those not yet reached.

    With a similarity, nodes of one label are connected already, and a close fingerprint is only a
    candidate: the two sets of shingles decide.
    """

    def hits(cell, at: int, close: np.ndarray, label: np.ndarray) -> Iterator[int]:
        found = set()
        for x in close.tolist():
            if similarity is None or (label[x] not in found and _alike(cell[at]["shingles"], cell[x]["shingles"], similarity)):
                found.add(label[x])
                yield x

    def spanning(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            edges: list[tuple[int, int]] = []
            for cell in rows["cell"]:
                node = np.array([x["node"] for x in cell], np.int64)
                label = node if similarity is None else np.array([x["label"] for x in cell], np.int64)
                fp = np.array([[x[f] for f in _NAMES] for x in cell], np.int64).view(np.uint64)
                left = np.arange(len(node))
                while len(left):
                    own = label[left] == label[left[0]]
                    todo, left = left[own].tolist(), left[~own]
                    while todo and len(left):
                        at = todo.pop()
                        near = np.bitwise_count(fp[left] ^ fp[at]).sum(axis=1, dtype=np.int32) <= limit
                        if not near.any():
                            continue
                        linked = list(hits(cell, at, left[near], label))
                        edges += [(int(node[at]), int(node[x])) for x in linked]
                        reached = np.isin(label[left], label[linked])
                        todo += left[reached].tolist()
                        left = left[~reached]
            yield pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    return spanning


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have the similarity."""
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return joined.where(both / (F.size("x") + F.size("y") - both) >= similarity).select("a", "b")


def similar_pairs(
    nodes: DataFrame, *, limit: int, chunk: int = 4 * CHUNK, sets: Callable[[DataFrame], DataFrame] | None = None,
    similarity: float | None = None, leaders: int = 2,
) -> DataFrame:
    """Edges (a, b) that connect nodes as all pairs do that share a block and differ in at most ``limit`` bits.

    ``nodes`` has one row for each ``node``, with its fingerprint f0, f1, ... and its ``blocks``. In each
    bucket the nodes close to its smallest node are linked to that; they need no comparison with
    each other. The rest is compared with all of the bucket, chunk against chunk, so a cell holds
    about ``2 * chunk`` rows however large the bucket.

    With a ``similarity``, ``sets`` gives the ``shingles`` of the nodes asked for, and only pairs whose sets
    have it are linked. In ``leaders`` rounds every node is held against one leader of each of its buckets;
    the components of these links take the place of closeness to the leader.
    """
    rows = nodes.select("node", F.explode("blocks").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1")
    if similarity is None:
        first = nodes.select(F.col("node").alias("leader"), *(F.col(f).alias(f"l{f}") for f in _NAMES))
        apart = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"l{f}"))) for f in _NAMES), F.lit(0))
        met = rows.join(shared, "bucket").join(nodes.drop("blocks"), "node").join(first, "leader")
        met = cut(met.select("bucket", "leader", "node", *_NAMES, (apart <= limit).alias("near")), "buckets")
        linked, carried = met.where("near and node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")), _NAMES
    else:
        met = cut(rows.join(shared, "bucket").select("bucket", "leader", "node", F.col("node").alias("label"), F.col("leader").alias("leader_label")), "buckets")
        found = cut(sets(met.select("node").distinct()), "shingles")
        linked = None
        for k in range(leaders):
            if k:
                other = met.groupBy("bucket").agg(F.min_by(F.struct("node", "label"), F.xxhash64("label", "node", F.lit(k))).alias("to"))
                met = met.join(other, "bucket").select("bucket", F.col("to.node").alias("leader"), "node", "label", F.col("to.label").alias("leader_label"))
            pairs = met.where("label <> leader_label").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
            new = cut(_verified(pairs, found, similarity), "links")
            linked = new if linked is None else linked.union(new)
            labels = connected_components(linked)
            split = met.select("bucket", "leader", "node").join(labels, "node", "left").join(
                labels.select(F.col("node").alias("leader"), F.col("label").alias("leader_label")), "leader", "left")
            split = cut(split.select("bucket", "leader", "node", F.coalesce("label", "node").alias("label"), F.coalesce("leader_label", "leader").alias("leader_label")), "buckets")
            open_ = split.where("label <> leader_label").select("bucket").distinct()
            met = cut(split.join(open_, "bucket"), "buckets")
        met = met.withColumn("near", F.col("label") == F.col("leader_label")).join(nodes.drop("blocks"), "node").join(found, "node")
        carried = [*_NAMES, "label", "shingles"]
    sizes = met.groupBy("bucket").agg(_chunks(F.col("near"), chunk).alias("nears"), _chunks(~F.col("near"), chunk).alias("fars")).where("fars > 0")
    dealt = met.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("node", "bucket"), F.when(F.col("near"), F.col("nears")).otherwise(F.col("fars"))).cast("int"))
    met_cells = dealt.select("bucket", "node", *carried, F.explode(_cells()).alias("at")).groupBy("bucket", "at").agg(
        F.collect_list(F.struct("node", *carried)).alias("cell")).where("size(cell) > 1").select("cell")
    return linked.union(met_cells.mapInPandas(_spanning(limit, similarity), "a long, b long")).distinct()


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, chunk: int = CHUNK // 2) -> DataFrame:
    """One row per document: ``id_col``, component_id, row_key, kept (the component's first document by
    id and key), for documents whose sets of five-word shingles have a Jaccard ``similarity`` or more.

    The set of five-word shingles of each text gives 25 blocks, each of four minima of the set under
    hashed orders; documents that share a block are candidates. A link is made only where the exact
    similarity of the two sets of 64-bit hashes is high enough; before that, the sets' SimHash
    fingerprints (512 bits, ``allowed_bits(similarity)``) spare most comparisons.
    Texts of equal words are one node (XXH64), joined before any search. Null and empty texts
    are copies of each other; null ids come last; repeated rows stay repeated.
    """
    kind = dict(docs.dtypes)[id_col]
    marked = cut(
        docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
        .mapInPandas(_signatures, f"id {kind}, key binary, node long, {', '.join(f'{f} long' for f in _NAMES)}, blocks array<long>"),
        "signatures",
    )
    every = cut(marked.groupBy("node").agg(F.min("key").alias("key"), *(F.any_value(f).alias(f) for f in (*_NAMES, "blocks"))), "nodes")

    def sets(asked: DataFrame) -> DataFrame:
        keys = every.select("node", "key").join(asked, "node", "left_semi").select("key")
        texts = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
        return texts.join(keys, "key", "left_semi").dropDuplicates(["key"]).select("text").mapInPandas(_shingle_sets, "node long, shingles array<long>")

    order = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    classes = marked.groupBy("node").agg(order)
    labels = connected_components(similar_pairs(every.drop("key"), limit=allowed_bits(similarity), chunk=chunk, sets=sets, similarity=similarity))
    labelled = cut(classes.join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label")), "labels")
    kept = labelled.groupBy("label").agg(F.min("first").alias("kept"))
    named = cut(join_hot(labelled.select("node", "label"), kept, "label").select("node", "kept"), "components")
    return join_hot(marked.select("id", "key", "node"), named, "node").select(
        F.col("id").alias(id_col), F.col("kept.id").alias("component_id"), F.col("key").alias("row_key"), (F.col("key") == F.col("kept.key")).alias("kept"))
