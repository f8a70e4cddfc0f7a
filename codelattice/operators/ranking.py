"""Centrality: the in-degree rank and PageRank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelattice.operators.hops import of_type
from codelattice.operators.lineage import cut, new_folder

#: Edge types that count for rank.
RANK_TYPES = ("CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "DEPENDS_ON", "DEPENDS_ON_MODULE")
#: What a node without incoming edges gets before normalisation.
BASE = 0.15


def native_rank(nodes: DataFrame, edges: DataFrame, types: Sequence[str] = RANK_TYPES) -> DataFrame:
    """(id, in_degree, rank): in-degree over all counted edges plus BASE, divided by the largest.

    Edges count in the total if their source is a node; a graph without edges gives BASE to all.
    """
    e = of_type(edges, *types)
    n_total = e.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").agg(F.count("*").alias("total"))
    degree = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    raw = nodes.select("id").join(degree, "id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0).cast("long")))
    raw = raw.join(F.broadcast(n_total)).withColumn("raw", F.coalesce(F.try_divide(F.col("in_degree").cast("double"), F.col("total")), F.lit(0.0)) + BASE)
    top = raw.agg(F.max("raw").alias("top"))
    rank = F.when(F.col("total") == 0, F.lit(BASE)).otherwise(F.col("raw") / F.col("top"))
    return raw.join(F.broadcast(top)).select("id", "in_degree", rank.alias("rank"))


def pagerank(nodes: DataFrame, edges: DataFrame, *, types: Sequence[str] = RANK_TYPES, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(id, rank) after at most ``rounds`` rounds of rank = 1 - damping + damping * received share.

    A round passes on what the round before changed, so only nodes that a walk of that many edges reaches take part, and the rounds
    end once nothing changed; the sum of all changes is the rank. Each round's changes are written out. Ranks of nodes without outgoing edges are not passed on.
    """
    e = of_type(edges, *types).select("src", "dst").distinct()
    known = nodes.select("id").distinct()
    e = e.join(e.groupBy("src").agg(F.count("*").alias("out")), "src").join(known.select(F.col("id").alias("src")), "src", "left_semi").join(known.select(F.col("id").alias("dst")), "dst", "left_semi")
    e = cut(e.select("src", "dst", "out"), "rank-edges")
    base = F.lit(1.0 - damping)
    change, changes = known.select("id", base.alias("change")), None
    for _ in range(rounds):
        sent = e.join(change, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg((F.sum(F.col("change") / F.col("out")) * damping).alias("change"))
        change = cut(sent, "rank-change")
        if change.isEmpty():
            break
        changes = change if changes is None else changes.unionByName(change)
    if changes is None:
        return nodes.select("id", base.alias("rank"))
    got = changes.groupBy("id").agg(F.sum("change").alias("change"))
    return nodes.select("id").join(got, "id", "left").select("id", (base + F.coalesce("change", F.lit(0.0))).alias("rank"))


def top_ranked(ranks: DataFrame, n: int = 10, key: str = "id") -> DataFrame:
    return ranks.orderBy(F.col("rank").desc(), key).limit(n)


def share_of_largest(df: DataFrame, value: str, within: str, out: str) -> DataFrame:
    """``value`` over the largest of its group."""
    return df.withColumn(out, F.try_divide(F.col(value), F.max(value).over(Window.partitionBy(within))))


#: Ranks by name; each takes nodes and edges.
STRATEGIES = {"native": native_rank, "pagerank": pagerank}


def rank(nodes: DataFrame, edges: DataFrame, strategy: str = "pagerank", fallback: str = "native") -> DataFrame:
    """The rank of a strategy or, where there is none of that name, of ``fallback``."""
    return STRATEGIES.get(strategy, STRATEGIES[fallback])(nodes, edges)


class Projections:
    """Named graphs of some edge types, stored in the shared folder: (name, src, dst) edges, each once, a folder a name."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or new_folder(spark, "projections")).rstrip("/")

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/name={name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def project(self, name: str, edges: DataFrame, types: Sequence[str] = ()) -> None:
        """Store the edges of some types (all without any) under a name, in place of a graph of that name."""
        of_type(edges, *types).select("src", "dst").distinct().write.mode("overwrite").parquet(f"{self.path}/name={name}")

    def edges(self, name: str) -> DataFrame:
        return self.spark.read.schema("src string, dst string").parquet(f"{self.path}/name={name}").withColumn("type", F.lit(name))

    def drop(self, name: str) -> bool:
        path, system = self._folder(name)
        return bool(system.delete(path, True))

    def listed(self) -> DataFrame:
        """(name, n_edges) of the graphs that are there."""
        path, system = self._folder("")
        if not system.exists(path):
            return self.spark.createDataFrame([], "name string, n_edges long")
        return self.spark.read.schema("src string, dst string, name string").parquet(self.path).groupBy("name").agg(F.count("*").alias("n_edges"))
