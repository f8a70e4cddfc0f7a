"""A property graph read from the relational tables, as a frame and as SQL.

Regions, nations, customers, suppliers, orders and parts are nodes; belonging, calling (an order
its customer), using (an order its parts) and depending (a part on its suppliers) are edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    none = F.lit(None).cast("string")

    def node(df: DataFrame, prefix: str, key: str, kind: str, name, parent=none, weight=None):
        return df.select(_key(prefix, key).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), parent.alias("parent_id"),
                         (F.lit(0.0) if weight is None else F.col(weight)).alias("weight"))

    frames = [
        node(t("region"), "r", "r_regionkey", "Region", F.col("r_name")),
        node(t("nation"), "n", "n_nationkey", "Nation", F.col("n_name"), _key("r", "n_regionkey")),
        node(t("customer"), "c", "c_custkey", "Customer", F.col("c_name"), _key("n", "c_nationkey"), "c_acctbal"),
        node(t("supplier"), "s", "s_suppkey", "Supplier", F.col("s_name"), _key("n", "s_nationkey"), "s_acctbal"),
        node(t("orders"), "o", "o_orderkey", "Order", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), _key("c", "o_custkey"), "o_totalprice"),
        node(t("part"), "p", "p_partkey", "Part", F.col("p_name"), none, "p_retailprice"),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


#: Lines among which one task finds the distinct pairs.
PAIRED = 500_000


def _pairs(lines: DataFrame, a: str, b: str) -> DataFrame:
    """The distinct pairs of two columns. Lines are dealt out by both over a task for each PAIRED of them, so that what a task holds in
    memory does not grow with the table; their number is read from the files' footers."""
    n = max(lines.count() // PAIRED + 1, lines.sparkSession.sparkContext.defaultParallelism)
    return lines.select(a, b).repartition(n, a, b).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("type"), _key(*a).alias("src"), _key(*b).alias("dst"))
    lines = t("lineitem")
    frames = [
        edge(t("nation"), "BELONGS_TO", ("n", "n_nationkey"), ("r", "n_regionkey")), edge(t("customer"), "BELONGS_TO", ("c", "c_custkey"), ("n", "c_nationkey")),
        edge(t("supplier"), "BELONGS_TO", ("s", "s_suppkey"), ("n", "s_nationkey")), edge(t("orders"), "CALLS", ("o", "o_orderkey"), ("c", "o_custkey")),
        edge(_pairs(lines, "l_orderkey", "l_partkey"), "USES", ("o", "l_orderkey"), ("p", "l_partkey")),
        edge(_pairs(lines, "l_partkey", "l_suppkey"), "DEPENDS_ON", ("p", "l_partkey"), ("s", "l_suppkey")),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


SQL = """
nodes AS (
  SELECT 'r:' || r_regionkey AS id, 'Region' AS kind, r_name AS name, CAST(NULL AS VARCHAR) AS parent_id, CAST(0 AS DOUBLE) AS weight FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'Nation', n_name, 'r:' || n_regionkey, 0 FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'Customer', c_name, 'n:' || c_nationkey, c_acctbal FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'Supplier', s_name, 'n:' || s_nationkey, s_acctbal FROM supplier
  UNION ALL SELECT 'o:' || o_orderkey, 'Order', 'Order ' || o_orderkey, 'c:' || o_custkey, o_totalprice FROM orders
  UNION ALL SELECT 'p:' || p_partkey, 'Part', p_name, NULL, p_retailprice FROM part),
edges AS (
  SELECT 'BELONGS_TO' AS type, 'n:' || n_nationkey AS src, 'r:' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'BELONGS_TO', 'c:' || c_custkey, 'n:' || c_nationkey FROM customer
  UNION ALL SELECT 'BELONGS_TO', 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier
  UNION ALL SELECT 'CALLS', 'o:' || o_orderkey, 'c:' || o_custkey FROM orders
  UNION ALL SELECT DISTINCT 'USES', 'o:' || l_orderkey, 'p:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'DEPENDS_ON', 'p:' || l_partkey, 's:' || l_suppkey FROM lineitem)
"""


def with_graph(rest: str, recursive: bool = False) -> str:
    """SQL over the graph: ``rest`` begins with further tables (a comma first) or with SELECT."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{SQL}{rest}"
