"""Helpers that the text operators share: scratch tables, row keys and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.operators.lineage import cut, shared_folder

__all__ = ["connected_components", "cut", "drop_scratch", "free_name", "join_hot", "lower_ascii", "row_key", "scratch_path"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder; the driver deletes the folder when it ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)
    return path.toString()


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``scratch_path`` that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def join_hot(rows: DataFrame, facts: DataFrame, key: str, *, most: int = 1024, salts: int = 32) -> DataFrame:
    """``rows`` joined with the one row of ``facts`` for each ``key``, however many rows a key has.

    A key with at least one in ``most`` of all rows is hot: there are at most ``most`` of them, so
    they may be broadcast. Their rows are dealt over ``salts`` parts by a hash of the whole row's other
    columns and the fact is repeated for each part; other keys have one part.
    """
    n = rows.count()
    hot = F.broadcast(rows.groupBy(key).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") * most >= max(n, most * most)).select(key, F.lit(True).alias("is_hot")))
    others = [F.col(f"`{c}`") for c in rows.columns if c != key] or [F.col(key)]
    dealt = rows.join(hot, key, "left").withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64(*others), F.lit(salts))).otherwise(0).cast("int")).drop("is_hot")
    parts = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = facts.join(hot, key, "left").withColumn("salt", F.explode(parts)).drop("is_hot")
    return dealt.join(spread, [key, "salt"]).drop("salt")


def row_key(id_col: str, text_col: str) -> Column:
    """A 16-byte key of a row's id and text. Rows that agree in both are one document repeated."""
    return F.unhex(F.md5(F.concat(
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("\n"),
        F.col(text_col).isNull().cast("string"), F.coalesce(F.col(text_col), F.lit("")),
    )))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until ``df`` has no such column (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other letter stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Label each node with the smallest node of its component.

    ``edges`` has long columns ``a`` and ``b``. The result is (``node``, ``label``), for nodes
    with an edge to another node. Alternating large-star and small-star steps; each round is cut.
    """
    e = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    seen = None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select("v", "v")).distinct()
