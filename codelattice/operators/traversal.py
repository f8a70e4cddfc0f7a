"""Bounded and unbounded traversals of edges (type, src, dst)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.operators.hops import dealt_out, end_lists, of_type, undirected
from codelattice.operators.lineage import cut


def reach(edges: DataFrame, seeds: DataFrame, low: int, high: int, *, types: Sequence[str] = (), both_ways: bool = False) -> DataFrame:
    """(seed, id) pairs at the end of some walk of ``low`` to ``high`` edges, each once."""
    e = of_type(edges, *types)
    e = (undirected(e) if both_ways else e).select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct()
    step = seeds.select(F.col("id").alias("seed"), "id").distinct()
    found = [step] if low == 0 else []
    for n in range(1, high + 1):
        step = step.join(e, F.col("id") == F.col("at")).select("seed", F.col("to").alias("id")).distinct()
        step = cut(step, "reach") if n > 3 else step  # long walks don't carry the plans of all steps
        if n >= low:
            found.append(step)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def count_reached(edges: DataFrame, seeds: DataFrame, high: int, *, types: Sequence[str] = ()) -> DataFrame:
    """(seed, n): how many nodes lie at the end of some walk of 1 to ``high`` edges from each seed that has an edge; ``reach`` counted, its pairs not made.

    Seeds are numbered, those with most edges first, and a node holds the seeds that reach it as bits of words of 64, which are or-ed where
    walks meet. So seeds that reach nearly everything cost a row a node and not one each, and what is left is counted out of the words.
    """
    e = cut(of_type(edges, *types).select(F.col("src").alias("at"), F.col("dst").alias("to")), "edges")
    leaving = e.groupBy(F.col("at").alias("id")).agg(F.count("*").alias("edges"))
    numbered = seeds.select("id").distinct().join(leaving, "id").orderBy(F.desc("edges"), "id")
    numbered = cut(numbered.select("id", F.monotonically_increasing_id().alias("n")), "seeds")
    step = numbered.select("id", F.shiftright("n", 6).alias("word"), F.expr("shiftleft(1L, cast(n & 63 as int))").alias("bits"))
    found = None
    for _ in range(high):
        step = step.join(e, F.col("id") == F.col("at")).groupBy(F.col("to").alias("id"), "word").agg(F.bit_or("bits").alias("bits"))
        step = cut(step, "reached")
        found = step if found is None else found.unionByName(step)
    every = found.groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))
    bit = F.expr("explode(if(bit_count(bits) = 1, array(length(bin(bits)) - 1), filter(sequence(0, 63), i -> getbit(bits, i) = 1)))")
    count = every.select("word", bit.alias("bit")).groupBy((F.col("word") * 64 + F.col("bit")).alias("n")).agg(F.count("*").alias("c"))
    return numbered.join(count, "n").select(F.col("id").alias("seed"), F.col("c").alias("n"))


def count_walks(edges: DataFrame, seeds: DataFrame, low: int, high: int, *, types: Sequence[str] = ()) -> DataFrame:
    """(seed, id, n): how many walks of ``low`` to ``high`` edges lead there. On graphs without
    cycles shorter than ``high`` these are the paths that repeat no edge.

    The last step's ends are dealt out of lists where the walks of a seed are, so a walk is never shuffled by itself; the walks of one
    seed are summed up in one task.
    """
    lists = end_lists(of_type(edges, *types))
    step = seeds.select("id").distinct().select(F.col("id").alias("seed"), "id", F.lit(1).cast("long").alias("n"))
    found = [step.select("seed", "n", F.array("id").alias("ends"), F.lit(1).alias("n_ends"))] if low == 0 else []
    for k in range(1, high + 1):
        wide = step.join(lists, F.col("id") == F.col("at")).select("seed", "n", "ends", "n_ends")
        wide = cut(wide, "wide") if low <= k < high else wide  # read again for the next step
        if k >= low:
            found.append(wide)
        if k < high:
            step = wide.select("seed", F.explode("ends").alias("id"), "n")
            # From one seed a first step rarely leads to a node twice; later ones do.
            step = cut(step.groupBy("seed", "id").agg(F.sum("n").alias("n")), "walks") if k > 1 else step
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return dealt_out(out, "seed", "id").groupBy("seed", "id").agg(F.sum("n").alias("n"))


def depths(edges: DataFrame, seeds: DataFrame, limit: int, *, types: Sequence[str] = (), reverse: bool = False) -> DataFrame:
    """(id, depth): the fewest edges from any seed, up to ``limit``; seeds have depth 0.

    A frontier loop: the edges are written once, each round extends only the newly found nodes and
    drops known ones, its frontier is written, and the loop ends once that is empty. Only the ends of a round are made
    distinct, so edges may repeat and no task holds its share of all of them.
    """
    e = of_type(edges, *types).select(F.col("src").alias("at"), F.col("dst").alias("to"))
    e = e.select(F.col("to").alias("at"), F.col("at").alias("to")) if reverse else e
    e = cut(e, "edges")
    found = frontier = cut(seeds.select("id", F.lit(0).alias("depth")).distinct(), "frontier")
    for n in range(1, limit + 1):
        new = frontier.join(e, F.col("id") == F.col("at")).select(F.col("to").alias("id")).distinct().join(found, "id", "left_anti")
        frontier = cut(new.select("id", F.lit(n).alias("depth")), "frontier")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def paths(edges: DataFrame, seeds: DataFrame, high: int, *, types: Sequence[str] = (), mark: str = ">") -> DataFrame:
    """(seed, id, depth, nodes, types, node_text, type_text): each path of 1 to ``high`` edges that repeats no node.

    The texts are nodes and types joined by ``mark``; a caller that needs only them spares the lists of the longest paths, which are most. The edges and
    all but the longest paths are written out, as they are read again. A path is written as its nodes, types and the types' text; all else follows from them, and
    of the types only one form is read.
    """
    e = cut(of_type(edges, *types).select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("type").alias("kind")), "edges")
    step = seeds.select(F.array("id").alias("nodes"), F.array().cast("array<string>").alias("types"), F.lit(None).cast("string").alias("said"))
    said = F.when(F.col("kind").isNull(), F.col("said")).when(F.col("said").isNull(), F.col("kind")).otherwise(F.concat("said", F.lit(mark), "kind")).alias("said")
    end, text, found = F.element_at("nodes", -1), F.array_join("nodes", mark), []
    for n in range(1, high + 1):
        on = (end == F.col("at")) & ~F.array_contains("nodes", F.col("to"))
        longer = (F.array_append("nodes", F.col("to")).alias("nodes"), F.array_append("types", F.col("kind")).alias("types"))
        seed = F.col("nodes")[0].alias("seed")
        if n < high:
            step = cut(step.join(e, on).select(*longer, said), "paths")
            new = step.select(seed, end.alias("id"), "nodes", "types", text.alias("node_text"), "said")
        else:
            new = step.join(e, on).select(seed, F.col("to").alias("id"), *longer, F.concat(text, F.lit(mark), "to").alias("node_text"), said)
        found.append(new.select("seed", "id", F.lit(n).alias("depth"), "nodes", "types", "node_text", F.coalesce("said", F.lit("")).alias("type_text")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def call_chain(edges: DataFrame, entry: DataFrame, high: int, *, types: Sequence[str] = (), reverse: bool = False) -> DataFrame:
    """(seed, id, depth, via): for each node of a chain its least depth and the smallest node that
    leads there at that depth. ``reverse`` follows callers."""
    e = of_type(edges, *types).select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct()
    if reverse:
        e = e.select(F.col("to").alias("at"), F.col("at").alias("to"))
    step = entry.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"))
    found = step
    for n in range(1, high + 1):
        step = step.join(e, F.col("id") == F.col("at")).groupBy("seed", F.col("to").alias("id")).agg(F.min("id").alias("via")).select(
            "seed", "id", F.lit(n).alias("depth"), "via")
        step = step.join(found.select("seed", "id"), ["seed", "id"], "left_anti")
        found = found.unionByName(step)
    return found


def ancestors(nodes: DataFrame, high: int, *, key: str = "id", parent: str = "parent_id", label: str = "name") -> DataFrame:
    """(key, depth, path): for each node the labels from its root down to itself, by parent
    pointers; a parent that is no node ends the path."""
    up = nodes.select(F.col(key).alias("_k"), F.col(parent).alias("_p"), F.col(label).alias("_l"))
    rows = nodes.select(F.col(key), F.col(parent).alias("next"), F.array(F.col(label)).alias("path"))
    for _ in range(high):
        rows = rows.join(up, F.col("next") == F.col("_k"), "left").select(
            key, F.col("_p").alias("next"), F.when(F.col("_k").isNotNull(), F.concat(F.array("_l"), "path")).otherwise(F.col("path")).alias("path"))
    return rows.select(key, (F.size("path") - 1).alias("depth"), "path")


def tree(nodes: DataFrame, levels: int, *, key: str = "id", parent: str = "parent_id", label: str = "name") -> DataFrame:
    """Every node with its depth and the path of keys that orders the tree depth first."""
    rows = ancestors(nodes, levels, key=key, parent=parent, label=key)
    return nodes.join(rows, key).withColumn("sort_path", F.array_join("path", "/"))


def strong_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component): the strongly connected components of two nodes or more, and self-loops; a
    component is named by its smallest node.

    In each round every node gets the smallest node that reaches it and the smallest that it reaches
    (``_min_labels``). Where both are one node, it names the component. Of the rest only edges between nodes
    that agree in both stay, for a component's nodes always agree; what is left falls apart quickly.
    Where ``rounds`` do not settle all components it raises.
    """
    e = cut(edges.select("src", "dst").distinct(), "cycle-edges")
    loops = e.where("src = dst").select(F.col("src").alias("id"))
    rest, done = e.where("src <> dst"), None
    for n in range(rounds + 1):
        # A node without an edge in or out is in no cycle.
        rest = cut(rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(
            rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"), "cycle-edges")
        if rest.isEmpty():
            break
        if n == rounds:
            raise RuntimeError(f"cycles did not settle in {rounds} rounds")
        labels = _min_labels(rest)
        settled = labels.where("ahead = back").select("id", F.col("ahead").alias("component"))
        done = settled if done is None else done.unionByName(settled)
        part = labels.where("ahead <> back").select("id", F.struct("ahead", "back").alias("part"))
        rest = rest.join(part.select(F.col("id").alias("src"), F.col("part").alias("a")), "src").join(
            part.select(F.col("id").alias("dst"), F.col("part").alias("b")), "dst").where("a = b").select("src", "dst")
    alone = loops.withColumn("component", F.col("id"))
    if done is None:
        return alone
    grown = done.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    found = done.join(grown, "component", "left_semi").select("id", "component")
    return found.unionByName(alone.join(found, "id", "left_anti").select("id", "component"))


def _min_labels(edges: DataFrame) -> DataFrame:
    """(id, ahead, back): the smallest node that reaches each node, and the smallest that it reaches.

    Both ways go in one table. Labels pass over the edges, and a node also takes the label of its label, which
    reaches it too; so a chain of n nodes takes about log n rounds, not n.
    """
    both = edges.select(F.lit("ahead").alias("way"), F.col("src").alias("at"), F.col("dst").alias("to"))
    both = cut(both.unionByName(edges.select(F.lit("back").alias("way"), F.col("dst").alias("at"), F.col("src").alias("to"))), "ways")
    labels = cut(both.select("way", F.col("at").alias("id")).union(both.select("way", F.col("to").alias("id"))).distinct().select("way", "id", F.col("id").alias("label")), "labels")
    while True:
        sent = both.join(labels, (both["way"] == labels["way"]) & (both["at"] == labels["id"])).select(both["way"], F.col("to").alias("id"), "label", F.lit(None).cast("string").alias("own"))
        new = labels.withColumn("own", F.col("label")).unionByName(sent).groupBy("way", "id").agg(F.min("label").alias("label"), F.max("own").alias("own"))
        jump = labels.select("way", F.col("id").alias("label"), F.col("label").alias("further"))
        new = new.join(jump, ["way", "label"]).select("way", "id", F.least("label", "further").alias("label"), "own")
        new = cut(new, "labels")
        labels = new.drop("own")
        if new.where("label <> own").isEmpty():
            break
    return labels.groupBy("id").pivot("way", ["ahead", "back"]).agg(F.first("label"))
