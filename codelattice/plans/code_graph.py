"""A graph of code read from the relational tables by rule, as frames and as SQL.

Suppliers are classes, whose names end by rule in a role; parts are methods of the supplier of their first line; lines of
an order that follow each other are a call from one part to the next, at the line's number; nations are files of the classes and
regions are tables that the data access classes use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.plans.sample_graph import table

ROLES = ("Controller", "Service", "Dao", "Validator", "Builder", "Entity", "Util", "Action")
KINDS = ("JavaClass", "SpringService", "JavaClass", "JavaClass", "JavaClass", "Entity", "JavaClass", "SpringController")


def _of(values: tuple[str, ...], key: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _key(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def _owners(lines: DataFrame, part: str) -> DataFrame:
    """(part, owner): the supplier of each part's first line; of lines with the same key the one that stands first in the table counts, and lines
    without a key or supplier don't."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    first = F.when(key.isNotNull() & F.col("l_suppkey").isNotNull(), F.struct(key, "_metadata.file_path", "_metadata.row_index"))
    return lines.groupBy(F.col("l_partkey").alias(part)).agg(F.min_by("l_suppkey", first).alias("owner"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, name, parent_id, file, size, documented)."""
    t = lambda name: table(spark, sf_dir, name)
    none = F.lit(None).cast("string")
    owner = _owners(t("lineitem"), "k")
    home = t("supplier").select(F.col("s_suppkey").alias("owner"), "s_nationkey")
    methods = t("part").join(owner, F.col("p_partkey") == F.col("k"), "left").join(home, "owner", "left").select(
        _key("m", "p_partkey").alias("id"), F.lit("JavaMethod").alias("kind"), F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"), _key("c", "owner").alias("parent_id"), _key("f", "s_nationkey").alias("file"),
        F.col("p_size").cast("int").alias("size"), (F.col("p_size") > 25).alias("documented"))
    classes = t("supplier").select(
        _key("c", "s_suppkey").alias("id"), _of(KINDS, "s_suppkey").alias("kind"), F.concat(F.lit("Unit"), F.col("s_suppkey").cast("string"), _of(ROLES, "s_suppkey")).alias("name"), _key("f", "s_nationkey").alias("parent_id"),
        _key("f", "s_nationkey").alias("file"), F.lit(None).cast("int").alias("size"), (F.col("s_acctbal") > 0).alias("documented"))
    files = t("nation").select(_key("f", "n_nationkey").alias("id"), F.lit("File").alias("kind"), F.concat(F.lit("src/"), F.lower("n_name"), F.lit(".java")).alias("name"), none.alias("parent_id"), _key("f", "n_nationkey").alias("file"),
                               F.lit(None).cast("int").alias("size"), F.lit(True).alias("documented"))
    tables = t("region").select(_key("t", "r_regionkey").alias("id"), F.lit("SQLTable").alias("kind"), F.lower("r_name").alias("name"), none.alias("parent_id"), none.alias("file"), F.lit(None).cast("int").alias("size"), F.lit(False).alias("documented"))
    return methods.unionByName(classes).unionByName(files).unionByName(tables)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(type, src, dst, line): each pair once, with its smallest line."""
    t = lambda name: table(spark, sf_dir, name)
    a = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("a"))
    b = t("lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("b"))
    calls = a.join(b, ["l_orderkey", "l_linenumber"]).where("a <> b").groupBy(_key("m", "a").alias("src"), _key("m", "b").alias("dst")).agg(F.min("l_linenumber").cast("int").alias("line")).select(F.lit("CALLS").alias("type"), "src", "dst", "line")
    owner = _owners(t("lineitem"), "l_partkey")
    line = F.lit(None).cast("int").alias("line")
    has = owner.select(F.lit("HAS_METHOD").alias("type"), _key("c", "owner").alias("src"), _key("m", "l_partkey").alias("dst"), line)
    defines = t("supplier").select(F.lit("DEFINES_CLASS").alias("type"), _key("f", "s_nationkey").alias("src"), _key("c", "s_suppkey").alias("dst"), line)
    home = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    dao = t("supplier").where(_of(ROLES, "s_suppkey") == "Dao").join(home, "s_nationkey").select(F.lit("USES_TABLE").alias("type"), _key("c", "s_suppkey").alias("src"), _key("t", "n_regionkey").alias("dst"), line)
    imports = t("customer").join(home.select(F.col("s_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey").select(
        F.lit("IMPORTS").alias("type"), _key("f", "c_nationkey").alias("src"), F.concat(F.lit("f:"), ((F.col("c_custkey") * 7) % 25).cast("string")).alias("dst"), line).where("src <> dst").distinct()
    return calls.unionByName(has).unionByName(defines).unionByName(dao).unionByName(imports)


_ROLE = "(['Controller', 'Service', 'Dao', 'Validator', 'Builder', 'Entity', 'Util', 'Action'])[CAST(s_suppkey % 8 + 1 AS INTEGER)]"
SQL = f"""
own AS (SELECT l_partkey AS k, arg_min(l_suppkey, l_orderkey * 10 + l_linenumber) AS owner FROM lineitem GROUP BY l_partkey),
nodes AS (
  SELECT 'm:' || p_partkey AS id, 'JavaMethod' AS kind, lower(replace(p_name, ' ', '_')) AS name, 'c:' || owner AS parent_id, 'f:' || s_nationkey AS file, CAST(p_size AS INTEGER) AS size, p_size > 25 AS documented
    FROM part LEFT JOIN own ON p_partkey = k LEFT JOIN supplier ON owner = s_suppkey
  UNION ALL SELECT 'c:' || s_suppkey, (['JavaClass', 'SpringService', 'JavaClass', 'JavaClass', 'JavaClass', 'Entity', 'JavaClass', 'SpringController'])[CAST(s_suppkey % 8 + 1 AS INTEGER)], 'Unit' || s_suppkey || {_ROLE}, 'f:' || s_nationkey, 'f:' || s_nationkey, NULL, s_acctbal > 0 FROM supplier
  UNION ALL SELECT 'f:' || n_nationkey, 'File', 'src/' || lower(n_name) || '.java', NULL, 'f:' || n_nationkey, NULL, true FROM nation
  UNION ALL SELECT 't:' || r_regionkey, 'SQLTable', lower(r_name), NULL, NULL, NULL, false FROM region),
edges AS MATERIALIZED (
  SELECT 'CALLS' AS type, 'm:' || a.l_partkey AS src, 'm:' || b.l_partkey AS dst, CAST(min(a.l_linenumber) AS INTEGER) AS line FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_partkey <> b.l_partkey GROUP BY 1, 2, 3
  UNION ALL SELECT 'HAS_METHOD', 'c:' || owner, 'm:' || k, NULL FROM own
  UNION ALL SELECT 'DEFINES_CLASS', 'f:' || s_nationkey, 'c:' || s_suppkey, NULL FROM supplier
  UNION ALL SELECT 'USES_TABLE', 'c:' || s_suppkey, 't:' || n_regionkey, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE {_ROLE} = 'Dao'
  UNION ALL SELECT DISTINCT 'IMPORTS', 'f:' || c_nationkey, 'f:' || (c_custkey * 7 % 25), CAST(NULL AS INTEGER) FROM customer WHERE c_nationkey <> c_custkey * 7 % 25)
"""


def with_graph(rest: str) -> str:
    """SQL over the graph: ``rest`` begins with further tables (a comma first) or with SELECT."""
    return f"WITH {SQL}{rest}"
