"""Linking entities that only names and paths tie: screens, flows, actions, services, symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.operators import intervals
from codelattice.operators.hops import pairs_that_share


def link_first(left: DataFrame, right: DataFrame, on: str, kind: str) -> DataFrame:
    """Each left row to the first (smallest id) right row with the same ``on``, ignoring case."""
    known = right.groupBy(F.lower(on).alias("_k")).agg(F.min("id").alias("dst"))
    return left.join(known, F.lower(on) == F.col("_k")).select(F.lit(kind).alias("type"), F.col("id").alias("src"), "dst").distinct()


def link_composite(left: DataFrame, right: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Edges where all keys are equal and not null, each once."""
    r = right.select(F.col("id").alias("dst"), *(F.col(k).alias(f"_{k}") for k in keys))
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return left.join(r, cond).select(F.lit(kind).alias("type"), F.col("id").alias("src"), "dst").distinct()


def link_containing(left: DataFrame, right: DataFrame, kind: str, *, shortest: int = 3, name: str = "name") -> DataFrame:
    """Each left row to the first (smallest id) right row whose name contains the left name, ignoring case.

    Right names are cut into their pieces of ``shortest`` characters and joined with how the left names
    begin, so only pairs that share that piece are compared; shorter left names link nowhere.
    """
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_r") - (shortest - 1))), lambda i: F.substring("_r", i, F.lit(shortest))))
    r = right.select(F.col("id").alias("dst"), F.lower(name).alias("_r")).select("dst", "_r", F.explode(pieces).alias("_w"))
    own = left.select(F.col("id").alias("src"), F.lower(name).alias("_l")).where(F.length("_l") >= shortest).withColumn("_w", F.left("_l", F.lit(shortest)))
    return own.join(r, "_w").where(F.contains("_r", F.col("_l"))).groupBy("src").agg(F.min("dst").alias("dst")).select(F.lit(kind).alias("type"), "src", "dst")


def containing(rows: DataFrame, needles: DataFrame, length: int) -> DataFrame:
    """(id, w): the distinct needles (w, all of ``length`` characters) inside each row's text.

    A text is cut into its distinct pieces of that length, so the join is on equal pieces and no
    row is compared with a needle that it does not hold.
    """
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - (length - 1))), lambda i: F.substring("text", i, F.lit(length))))
    return rows.select("id", F.explode(pieces).alias("w")).join(needles, "w").select("id", "w")


def resolve_symbols(uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, name, module, target, placeholder): a use of a name of a module to the symbol that the
    module declares; a use without one gets a placeholder of its own."""
    known = symbols.groupBy("module", "name").agg(F.min("id").alias("target"))
    j = uses.join(known, ["module", "name"], "left")
    return j.select("id", "name", "module", F.coalesce("target", F.concat(F.lit("placeholder:"), "module", F.lit("#"), "name")).alias("target"), F.col("target").isNull().alias("placeholder"))


def includes(uses: DataFrame, files: DataFrame, weight: int = 4) -> DataFrame:
    """Include edges (path, included) to files by path, or to a placeholder file."""
    known = files.select(F.col("path").alias("_p")).distinct()
    j = uses.join(known, F.col("included") == F.col("_p"), "left")
    return j.select(F.lit("INCLUDES").alias("type"), F.col("path").alias("src"), F.col("included").alias("dst"), F.lit(weight).alias("weight"), F.col("_p").isNull().alias("placeholder"))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(id, owner): the smallest entity of the same file whose lines enclose an inner one's line, by one sweep over each file's lines."""
    spans = outer.select("path", F.col("id").alias("owner"), F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    return intervals.innermost(inner.select("path", "id", F.col("line").alias("at")), spans).select("id", "owner")


def validation_chain(steps: DataFrame) -> DataFrame:
    """Per action its validation steps in order, how many rules they have and over which fields."""
    ordered = F.array_sort(F.collect_list(F.struct("step", "field", "rule")))
    return steps.groupBy("action").agg(ordered.alias("steps"), F.count("rule").alias("n_rules"), F.array_sort(F.collect_set("field")).alias("fields"))


def cross_feature(links: DataFrame) -> DataFrame:
    """(a, b, kind, n_shared): pairs of features that share entities, services or screens, by kind."""
    return pairs_that_share(links, "feature", "kind", "component").groupBy("a", "b", "kind").agg(F.count("*").alias("n_shared"))


def with_share(df: DataFrame, value: str, *by: str) -> DataFrame:
    return df.withColumn("share", F.try_divide(F.col(value).cast("double"), F.sum(value).over(Window.partitionBy(*by))))
