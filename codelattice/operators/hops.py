"""One-hop patterns over nodes (id, kind, name, ...) and edges (type, src, dst)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.operators.lineage import cut


def of_kind(nodes: DataFrame, *kinds: str) -> DataFrame:
    return nodes.where(F.col("kind").isin(*kinds))


def of_type(edges: DataFrame, *types: str) -> DataFrame:
    return edges.where(F.col("type").isin(*types)) if types else edges


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge both ways, with its direction seen from ``src``."""
    out = edges.select("type", "src", "dst", F.lit("out").alias("direction"))
    return out.unionByName(edges.select("type", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("in").alias("direction")))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in df.columns))


def hop(
    left: DataFrame, edges: DataFrame, right: DataFrame, *, types: Sequence[str] = (), on: str = "a_id", prefix: str = "b",
    how: str = "inner", both_ways: bool = False, where: Column | None = None,
) -> DataFrame:
    """Extend rows by one hop: ``left``'s column ``on`` over edges to a node of ``right``.

    With ``how="left"`` the hop is optional: the condition on the new node belongs to the match, so
    a row without a matching neighbour stays, with nulls.
    """
    e = of_type(edges, *types)
    e = (undirected(e) if both_ways else e).select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("type").alias(f"{prefix}_edge"))
    b = prefixed(right, prefix)
    if where is not None:
        b = b.where(where)
    target = e.join(b, F.col("_dst") == F.col(f"{prefix}_id"))
    return left.join(target, F.col(on) == F.col("_src"), how).drop("_src", "_dst")


def having(nodes: DataFrame, edges: DataFrame, types: Sequence[str] = (), *, incoming: bool = False, negate: bool = False) -> DataFrame:
    """Nodes with (or without) an edge of these types: a semi or anti join, never a count."""
    end = "dst" if incoming else "src"
    keys = of_type(edges, *types).select(F.col(end).alias("_end"))
    return nodes.join(keys, F.col("id") == F.col("_end"), "left_anti" if negate else "left_semi")


def neighbourhood(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Neighbours of the given ids grouped by (id, direction, type)."""
    e = undirected(edges).join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    named = e.join(nodes.select(F.col("id").alias("dst"), "name"), "dst")
    return named.groupBy(F.col("src").alias("id"), "direction", "type").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("name")).alias("names"))


#: Owners of one shared thing that a task pairs with all others of it.
PAIRED = 1000


def pairs_that_share(rows: DataFrame, item: str, *shared: str) -> DataFrame:
    """(shared..., a, b) with a < b: the pairs of items that have the same ``shared``, from distinct rows.

    What n items share gives n^2 pairs, which are the result. Its items are dealt over a task for each PAIRED of them, by a hash, and meet all
    others there, so that no one task makes the pairs of a thing that everybody uses.
    """
    one = rows.select(*shared, F.col(item).alias("a")).distinct()
    parts = one.groupBy(*shared).agg(F.ceil(F.count("*") / PAIRED).cast("int").alias("_parts"))
    dealt = one.join(parts, list(shared)).withColumn("_part", F.pmod(F.xxhash64("a"), F.col("_parts")).cast("int"))
    every = dealt.select(*shared, F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return dealt.drop("_parts").join(every, [*shared, "_part"]).where("a < b").drop("_part")


#: Ends that one list holds, and rows that one task makes of lists.
LISTED, DEALT = 1000, 2_000_000


def end_lists(edges: DataFrame, end: Column | None = None) -> DataFrame:
    """(at, ends, n_ends): the ends of each node's edges, ``dst`` unless another is given, in lists of up to LISTED; repeats stay. The table is written out.

    Where rows meet the edges of a node, its list travels instead of a row for each of them.
    """
    # Rows are named before they are numbered, so that they are not dealt out again for the lists.
    rows = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("dst") if end is None else end).alias("end"))
    number = F.row_number().over(Window.partitionBy("at").orderBy("to"))
    rows = rows.select("at", "end", F.floor((number - 1) / LISTED).alias("part"))
    lists = rows.groupBy("at", "part").agg(F.collect_list("end").alias("ends"))
    return cut(lists.select("at", "ends", F.size("ends").alias("n_ends")), "ends")


def numbered(names: DataFrame, name: str) -> DataFrame:
    """(name, n): distinct names with numbers from 0 in their order, without a gap. The table is written out; only the sizes of its partitions meet."""
    given = cut(names.orderBy(name).select(name, F.monotonically_increasing_id().alias("given")), "numbers")
    at = F.shiftright("given", 33)
    sizes = given.groupBy(at.alias("at")).agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("at", before.alias("before"))
    return given.join(F.broadcast(sizes), at == F.col("at")).select(name, (F.expr("given & 8589934591") + F.col("before")).alias("n"))


def number_lists(edges: DataFrame) -> DataFrame:
    """(at, first, near, far, n_ends): the distinct ends of each node's edges as numbers, in lists of up to LISTED; null ends are left out, and a node of no others has an empty list. The table is written out.

    For who counts ends but doesn't name them. A list is its smallest number and how far the others lie behind it, in two bytes each (``near``) where
    all are that near, else in four (``far``); ``dealt_numbers`` gives the numbers. So where rows meet them, a list is a fraction of its names.
    """
    e = cut(edges.select(F.col("src").alias("at"), F.col("dst").alias("end")), "ends")
    rows = e.join(numbered(e.where("end is not null").select("end").distinct(), "end"), "end", "left").select("at", "n").distinct()
    part = F.floor((F.row_number().over(Window.partitionBy("at").orderBy("n")) - 1) / LISTED)
    g = rows.select("at", "n", part.alias("part")).groupBy("at", "part", F.shiftright("n", 31).alias("high")).agg(F.min("n").alias("first"), F.max("n").alias("last"), F.array_sort(F.collect_list("n")).alias("ns"))
    behind, near = F.transform("ns", lambda x: x - F.col("first")), F.col("last") - F.col("first") < 1 << 15
    return cut(g.select("at", "first", F.when(near, behind.cast("array<smallint>")).alias("near"), F.when(~near, behind.cast("array<int>")).alias("far"), F.size("ns").alias("n_ends")), "number-lists")


def dealt_out(rows: DataFrame, by: str, out: str) -> DataFrame:
    """Rows with ends and n_ends as a row for each end (``out``). Those of a ``by`` lie in one partition, so that they are grouped by it, and
    by more, without a further shuffle; there is a partition for each DEALT rows. ``n_ends`` is summed up in a run of its own, without the lists."""
    n = rows.agg(F.sum("n_ends")).first()[0] or 0
    rest = [c for c in rows.columns if c not in ("ends", "n_ends")]
    return rows.drop("n_ends").repartition(n // DEALT + 1, by).select(*rest, F.explode("ends").alias(out))


def dealt_numbers(rows: DataFrame, by: str, out: str) -> DataFrame:
    """(by, out): rows with lists of ``number_lists`` as a row for each number, dealt out as by ``dealt_out``."""
    n = rows.agg(F.sum("n_ends")).first()[0] or 0
    lists = rows.select(by, "first", "near", "far").repartition(n // DEALT + 1, by)
    behind = F.explode(F.coalesce(F.col("near").cast("array<int>"), "far")).alias("behind")
    return lists.select(by, "first", behind).select(by, (F.col("first") + F.col("behind")).alias(out))


def shared_dimension_pairs(links: DataFrame, owner: str, shared: str) -> DataFrame:
    """Pairs of owners (a < b) that share something, with how much they share."""
    return pairs_that_share(links, owner, shared).groupBy("a", "b").agg(F.count("*").alias("n_shared"))


def longest_prefix(items: DataFrame, places: DataFrame, *, item: str = "path", place: str = "root", fallback: str | None = None) -> DataFrame:
    """The most specific place of each item: the longest ``place`` that is the item's path or a
    folder above it.

    An item is joined with each of its own folders on equality, so no pair is compared that does
    not match. Items outside all places get ``fallback``.
    """
    parts = F.split(F.col(item), "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    own = items.select(F.col(item)).distinct().select(F.col(item).alias("_item"), F.explode(folders).alias("_folder"))
    best = own.join(places.select(F.col(place).alias("_place")).distinct(), F.col("_folder") == F.col("_place")).groupBy("_item").agg(
        F.max_by("_place", F.length("_place")).alias(place))
    out = items.join(best, F.col(item) == F.col("_item"), "left").drop("_item")
    return out.withColumn(place, F.coalesce(place, F.lit(fallback))) if fallback is not None else out
