"""Queries on the tables themselves: aggregates, text kernels, classifications, search, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelattice.functions import code_text, ids, ladders, words
from codelattice.operators import classify, hops, keep, reports, search, smells, verify
from codelattice.plans.sample_graph import table
from codelattice.streaming import incremental

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (t), where t(name) reads a table, as a query with its SQL."""
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table_name: table(spark, sf_dir, table_name))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


long = lambda c: c.cast("long")

# Filters over relations


@query("f15_like_any", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%' OR p_type ILIKE '%brass%'")
def _(t):
    return t("part").where(F.col("p_name").ilike("%RED%") | F.col("p_type").ilike("%brass%")).select("p_partkey", "p_name")


@query("f16_optional_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000")
def _(t):
    given = {"o_orderstatus": "O", "o_orderpriority": None}
    out = t("orders").where("o_totalprice > 1000")
    for c, v in given.items():
        out = out if v is None else out.where(F.col(c) == v)
    return out.select("o_orderkey")


@query("f17_version_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber > 2 AND l_linenumber <= 4")
def _(t):
    return t("lineitem").where("l_linenumber > 2 and l_linenumber <= 4").select("l_orderkey", "l_linenumber")


@query("j9_longest_prefix", """WITH p AS (SELECT DISTINCT regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS path FROM pages), m(root) AS (VALUES ('/en'), ('/de'), ('/en/7817'), ('/fr')),
k AS (SELECT p.path, m.root, row_number() OVER (PARTITION BY p.path ORDER BY length(m.root) DESC) AS r FROM p LEFT JOIN m ON p.path = m.root OR starts_with(p.path, m.root || '/'))
SELECT path, coalesce(root, '/') AS root FROM k WHERE r = 1""")
def _(t):
    paths = t("pages").select(F.regexp_extract("url", r"://[^/]+(/[^?#]*)", 1).alias("path")).distinct()
    roots = paths.sparkSession.createDataFrame([(x,) for x in ("/en", "/de", "/en/7817", "/fr")], "root string")
    return hops.longest_prefix(paths, roots, fallback="/").select("path", "root")


@query("j18_eager_load", """SELECT c.c_custkey, count(o.o_orderkey) AS n, coalesce(string_agg(CAST(o.o_orderkey AS VARCHAR), ',' ORDER BY o.o_orderkey), '') AS orders FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""")
def _(t):
    o = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("orders"))
    return t("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("orders", F.lit("")).alias("orders"))


@query("j19_latest_with_owner", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
SELECT c.c_custkey, c.c_name, k.o_orderkey AS latest FROM customer c LEFT JOIN k ON k.o_custkey = c.c_custkey AND k.r = 1""")
def _(t):
    latest = t("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    return t("customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "latest")


# Aggregates


@query("a4_summary", "SELECT count(DISTINCT doc_id) AS files, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS loc, (SELECT count(DISTINCT doc_id) FROM labels) AS labelled FROM documents")
def _(t):
    one = t("documents").agg(F.count_distinct("doc_id").alias("files"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("loc"))
    return one.join(F.broadcast(t("labels").agg(F.count_distinct("doc_id").alias("labelled"))))


@query("a5_language_distribution", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS loc FROM documents GROUP BY lang ORDER BY n DESC, lang")
def _(t):
    return t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("loc")).orderBy(F.desc("n"), "lang")


@query("a6_language_share", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, round(100.0 * sum(n_chars) / (SELECT sum(n_chars) FROM documents), 1) AS percent FROM documents GROUP BY lang")
def _(t):
    return reports.share_of_total(t("documents"), "lang", "n_chars")


@query("a7_module_stats", """WITH c AS (SELECT c_nationkey, count(*) AS customers, sum(c_acctbal) AS b, avg(c_acctbal) AS a, max(c_acctbal) AS m, list_sort(list(DISTINCT c_mktsegment)) AS segments FROM customer GROUP BY c_nationkey),
s AS (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY s_nationkey)
SELECT n.n_name, coalesce(c.customers, 0) AS customers, coalesce(s.suppliers, 0) AS suppliers, round(c.b, 4) AS balance, round(c.a, 4) AS mean, c.m AS most, c.segments FROM nation n LEFT JOIN c ON n.n_nationkey = c.c_nationkey LEFT JOIN s ON n.n_nationkey = s.s_nationkey""")
def _(t):
    """Both sides are aggregated before they are joined, so nothing is counted twice."""
    c = t("customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 4).alias("balance"), F.round(F.avg("c_acctbal"), 4).alias("mean"),
                                                 F.max("c_acctbal").alias("most"), F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))
    s = t("supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    zero = F.lit(0).cast("long")
    out = t("nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return out.select("n_name", F.coalesce("customers", zero).alias("customers"), F.coalesce("suppliers", zero).alias("suppliers"), "balance", "mean", "most", "segments")


@query("a9_conditional_counts", "SELECT count(*) AS n, count(*) FILTER (quality = 1) AS good, CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS toxic, round(avg(quality), 6) AS ratio FROM labels")
def _(t):
    return t("labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"), F.round(F.avg("quality"), 6).alias("ratio"))


_SMELL_SQL = """m AS (SELECT p_partkey AS id, p_size AS v FROM part), s AS (SELECT id, CASE WHEN v / 10.0 >= 3 THEN 'critical' WHEN v / 10.0 >= 2 THEN 'high' WHEN v / 10.0 >= 1.5 THEN 'medium' ELSE 'low' END AS severity FROM m WHERE v > 10)"""


@query("a10_smells_by_severity", f"WITH {_SMELL_SQL} SELECT severity, count(*) AS n FROM s GROUP BY severity")
def _(t):
    parts = t("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("loc"))
    return smells.smells(parts, (("large", "loc", 10, (1.5, 2.0, 3.0), "size"),)).groupBy("severity").agg(F.count("*").alias("n"))


@query("a22_debt_rollup", f"WITH {_SMELL_SQL}, d AS (SELECT severity, count(*) AS n, CAST(sum(CASE severity WHEN 'low' THEN 15 WHEN 'medium' THEN 30 WHEN 'high' THEN 60 ELSE 120 END) AS BIGINT) AS minutes FROM s GROUP BY severity) SELECT severity, n, minutes, round(minutes / 60.0, 1) AS hours FROM d")
def _(t):
    parts = t("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("loc"))
    return smells.smell_rollup(smells.smells(parts, (("large", "loc", 10, (1.5, 2.0, 3.0), "size"),)))


@query("a13_counts_by_pattern", "SELECT count(*) FILTER (regexp_matches(url, 'page=')) AS paged, count(*) FILTER (regexp_matches(url, '(?i)utm_')) AS tracked, count(*) FILTER (regexp_matches(url, '[.]html$')) AS plain FROM pages")
def _(t):
    hit = lambda p: F.count_if(F.col("url").rlike(p))
    return t("pages").agg(hit("page=").alias("paged"), hit("(?i)utm_").alias("tracked"), hit("[.]html$").alias("plain"))


@query("a16_statistics", """SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS loc, round(avg(n_chars), 4) AS mean_loc, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (n_chars > 5000) AS large, max(n_chars) AS largest, count(DISTINCT source) AS sources FROM documents""")
def _(t):
    return t("documents").agg(F.count("*").alias("files"), F.sum("n_chars").alias("loc"), F.round(F.avg("n_chars"), 4).alias("mean_loc"), F.count_if(F.col("lang") == "en").alias("english"),
                              F.count_if(F.col("n_chars") > 5000).alias("large"), F.max("n_chars").alias("largest"), F.count_distinct("source").alias("sources"))


@query("a17_distinct_counts", "SELECT count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def _(t):
    return t("lineitem").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("a18_module_counts", "SELECT source, count(*) AS files, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def _(t):
    return t("documents").groupBy("source").agg(F.count("*").alias("files"), F.count_distinct("lang").alias("langs"))


@query("a19_collected_dependencies", "SELECT l_suppkey AS id, count(DISTINCT l_returnflag) AS n, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY l_suppkey")
def _(t):
    return t("lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count_distinct("l_returnflag").alias("n"), F.array_sort(F.collect_set("l_returnflag")).alias("flags"))


@query("a20_feature_stats", "SELECT o_orderstatus AS category, count(*) AS n, count(*) FILTER (o_totalprice <= 50000) AS simple, count(*) FILTER (o_totalprice > 50000 AND o_totalprice <= 150000) AS moderate, count(*) FILTER (o_totalprice > 150000) AS complex FROM orders GROUP BY 1")
def _(t):
    size = F.when(F.col("o_totalprice") <= 50000, "simple").when(F.col("o_totalprice") <= 150000, "moderate").otherwise("complex")
    return reports.feature_stats(t("orders").select(F.col("o_orderstatus").alias("category"), size.alias("complexity")))


@query("a21_metric_summary", "SELECT l_returnflag AS kind, sum(l_quantity) AS loc, round(sum(CASE WHEN l_linenumber > 2 THEN l_linenumber ELSE 0 END) / CAST(count(*) AS DOUBLE), 9) AS avg_complexity, max(CASE WHEN l_linenumber > 2 THEN l_linenumber END) AS max_complexity, max(l_linenumber) AS max_nesting FROM lineitem GROUP BY 1")
def _(t):
    nodes = t("lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("loc"), F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).alias("complexity"), F.col("l_linenumber").alias("nesting"))
    return reports.metric_summary(nodes, "kind").withColumn("avg_complexity", F.round("avg_complexity", 9)).select("kind", F.coalesce(F.col("loc").cast("double"), F.lit(0.0)).alias("loc"), "avg_complexity", "max_complexity", "max_nesting")


@query("a24_coverage_ratio", "SELECT round(coalesce(avg(CASE WHEN l.doc_id IS NULL THEN 0.0 ELSE 1.0 END), 0), 9) AS covered, (SELECT coalesce(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 1.0) FROM labels WHERE doc_id < 0) AS empty_docs FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    known = t("labels").select(F.col("doc_id").alias("k"), F.lit(True).alias("has"))
    covered = t("documents").join(known, F.col("doc_id") == F.col("k"), "left").agg(F.round(reports.ratio(F.col("has"), 0.0), 9).alias("covered"))
    return covered.join(F.broadcast(t("labels").where("doc_id < 0").agg(reports.ratio(F.col("quality") == 1, 1.0).alias("empty_docs"))))


@query("a33_max_or_zero", "SELECT coalesce(max(o_orderkey), 0) AS latest, (SELECT coalesce(max(o_orderkey), 0) FROM orders WHERE o_orderkey < 0) AS none FROM orders")
def _(t):
    o = t("orders")
    latest = lambda d, name: d.agg(F.coalesce(F.max("o_orderkey"), F.lit(0).cast("long")).alias(name))
    return latest(o, "latest").join(F.broadcast(latest(o.where("o_orderkey < 0"), "none")))


@query("a34_page_with_total", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def _(t):
    return keep.page(t("orders"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 40, 20).select("o_orderkey", "total")


@query("a35_rollup_by_type", "SELECT o_orderpriority AS type, count(DISTINCT o_custkey) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy(F.col("o_orderpriority").alias("type")).agg(F.count_distinct("o_custkey").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


# Windows, sorts, sets


@query("w1_keep_last", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(t):
    return keep.keep_first(t("events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


@query("w2_keep_first_by_priority", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size > 40 THEN 0 ELSE 1 END, p_partkey) AS r FROM part) WHERE r = 1")
def _(t):
    return keep.keep_first(t("part"), ["p_brand"], [F.when(F.col("p_size") > 40, 0).otherwise(1), F.col("p_partkey")]).select("p_brand", "p_partkey")


@query("w3_latest_checkpoint", "SELECT o_custkey AS run_id, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def _(t):
    return incremental.latest_checkpoint(t("orders"), "o_custkey", "o_orderdate", "o_orderkey").select(F.col("o_custkey").alias("run_id"), "o_orderkey")


@query("w4_top_per_seed", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def _(t):
    return keep.keep_first(t("orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("w7_carry_forward", """SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations""")
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t("conversations").select("conv_id", "turn", "role", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("asked"))


@query("w8_running_depth", """WITH d AS (SELECT user_id, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS d FROM events)
SELECT user_id, CAST(max(d) AS BIGINT) AS deepest FROM d GROUP BY user_id""")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return t("events").withColumn("d", F.sum(step).over(w)).groupBy("user_id").agg(F.max("d").alias("deepest"))


@query("w11_previous_row", "SELECT event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 'error', false) AS after_error FROM events")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", F.coalesce(F.lag("event_type").over(w) == "error", F.lit(False)).alias("after_error"))


@query("w14_next_number", "SELECT o_custkey, max(o_orderkey) + 1 AS next_number FROM orders GROUP BY o_custkey")
def _(t):
    return t("orders").groupBy("o_custkey").agg((F.max("o_orderkey") + 1).alias("next_number"))


@query("l1_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(t):
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("l2_two_key_sort", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def _(t):
    return t("lineitem").orderBy(F.desc("l_quantity"), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(10).select("l_orderkey", "l_linenumber")


@query("l3_computed_order", "SELECT n_name FROM nation ORDER BY CASE WHEN n_name = 'CHINA' THEN 0 WHEN n_name LIKE 'C%' THEN 1 ELSE 2 END, n_name LIMIT 5")
def _(t):
    return t("nation").orderBy(F.when(F.col("n_name") == "CHINA", 0).when(F.col("n_name").startswith("C"), 1).otherwise(2), "n_name").limit(5).select("n_name")


@query("l7_budget_limit", "SELECT doc_id FROM documents ORDER BY n_chars, doc_id LIMIT greatest(10, CAST(0.7 * 8000 / 50 AS INTEGER))")
def _(t):
    return t("documents").select("doc_id", "n_chars").orderBy("n_chars", "doc_id").limit(max(10, int(0.7 * 8000 // 50))).select("doc_id")


@query("l8_offset_page", "SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 25 OFFSET 50")
def _(t):
    return t("documents").select("doc_id").orderBy(F.desc("doc_id")).offset(50).limit(25)


@query("l10_priority_order", """WITH x AS (SELECT 'recommendation ' || o_orderkey AS recommendation, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority FROM orders WHERE o_totalprice > 250000)
SELECT recommendation, priority FROM x ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, recommendation LIMIT 40""")
def _(t):
    words_of = F.element_at(F.create_map(*map(F.lit, ("1-URGENT", "critical", "2-HIGH", "high", "3-MEDIUM", "medium", "4-NOT SPECIFIED", "low", "5-LOW", "low"))), F.col("o_orderpriority"))
    rows = t("orders").where("o_totalprice > 250000").select(F.concat(F.lit("recommendation "), F.col("o_orderkey").cast("string")).alias("recommendation"), words_of.alias("priority"))
    return reports.by_priority(rows).limit(40)


@query("l11_head_and_tail", "SELECT doc_id, md5(CASE WHEN length(text) > 1000 THEN left(text, 500) || chr(10) || '...' || chr(10) || right(text, 500) ELSE text END) AS digest FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(words.head_and_tail(F.col("text"))).alias("digest"))


@query("u2_heterogeneous_union", "SELECT 'c' AS what, c_custkey AS id, c_mktsegment AS segment, CAST(NULL AS INTEGER) AS size FROM customer UNION ALL SELECT 'p', p_partkey, NULL, p_size FROM part")
def _(t):
    a = t("customer").select(F.lit("c").alias("what"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(t("part").select(F.lit("p").alias("what"), F.col("p_partkey").alias("id"), F.col("p_size").alias("size")), allowMissingColumns=True)


@query("u3_version_diff", """WITH a AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change, a.n_chars AS before, b.n_chars AS after FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.n_chars <> b.n_chars""")
def _(t):
    """Two versions of a set of sections: one lacks every seventh, the other every eleventh."""
    d = t("documents").select("doc_id", "n_chars")
    new = d.where("doc_id % 11 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return verify.version_diff(d.where("doc_id % 7 <> 0"), new, "doc_id", "n_chars")


@query("u5_order_preserving_distinct", "SELECT doc_id, len(list_distinct(string_split(lower(text), ' '))) AS n FROM documents")
def _(t):
    return t("documents").select("doc_id", long(F.size(F.array_distinct(F.split(F.lower("text"), " ")))).alias("n"))


# Scalar kernels on text


@query("f_cyc_complexity", "SELECT page_id, 1 + " + " + ".join(f"len(regexp_extract_all(regexp_replace(html, '[^\\x00-\\x7F]', ' ', 'g'), '{p}'))" for p in code_text.BRANCHES) + " AS complexity FROM pages")
def _(t):
    return t("pages").select("page_id", long(code_text.cyclomatic(F.regexp_replace("html", r"[^\x00-\x7F]", " "))).alias("complexity"))


def _loc_sql(text: str) -> str:
    """Lines of code by a walk over the lines that carries whether a block comment is open."""
    return rf"""WITH RECURSIVE p AS (SELECT page_id, {text} AS html FROM pages), t AS (SELECT page_id, unnest(string_split(html, chr(10))) AS x, generate_subscripts(string_split(html, chr(10)), 1) AS i FROM p),
m AS MATERIALIZED (SELECT page_id, i, t <> '' AND NOT cm AND NOT op AS code, op AND NOT cm AND NOT cl AS opens, en FROM (SELECT page_id, i, t, regexp_matches(t, '^(//|#|--)') AS cm, regexp_matches(t, '^(/[*]|\"{{3}}|''{{3}})') AS op,
 regexp_matches(t, '[*]/$') OR (length(t) > 3 AND regexp_matches(t, '(\"{{3}}|''{{3}})$')) AS cl, regexp_matches(t, '[*]/|\"{{3}}|''{{3}}') AS en FROM (SELECT page_id, i, regexp_replace(x, '^\s+|\s+$', '', 'g') AS t FROM t))),
r AS (SELECT page_id, 0 AS i, 0 AS loc, false AS block FROM p WHERE html IS NOT NULL UNION ALL SELECT r.page_id, r.i + 1, r.loc + (m.code AND NOT r.block)::INT, CASE WHEN r.block THEN NOT m.en ELSE m.opens END FROM r JOIN m ON m.page_id = r.page_id AND m.i = r.i + 1)
SELECT page_id, CAST(arg_max(loc, i) AS BIGINT) AS loc FROM r GROUP BY page_id"""


@query("f_loc_nonblank", _loc_sql("html"))
def _(t):
    return t("pages").select("page_id", long(code_text.text_metrics(F.col("html"))["loc"]).alias("loc"))


@query("f_loc_block_comments", _loc_sql("replace(replace(replace(html, '<p>', chr(10) || '/* '), '</p>', ' */' || chr(10)), '<li>', chr(10) || '# ')"))
def _(t):
    """Pages whose paragraphs are made block comments, many of which never close, and whose items are line comments."""
    text = F.replace(F.replace(F.replace("html", F.lit("<p>"), F.lit("\n/* ")), F.lit("</p>"), F.lit(" */\n")), F.lit("<li>"), F.lit("\n# "))
    return t("pages").select("page_id", long(code_text.text_metrics(text)["loc"]).alias("loc"))


@query("f_cog_complexity", r"""WITH RECURSIVE l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS x, generate_subscripts(string_split(html, chr(10)), 1) AS i FROM pages), t AS (SELECT page_id, i, x, regexp_replace(x, '^\s+|\s+$', '', 'g') AS t FROM l),
m AS MATERIALIZED (SELECT page_id, i, t = '' AS blank, regexp_matches(t, '\b(if|for|foreach|while|do|switch|try|catch)\b') AS w, contains(t, '{') AS o, contains(t, '}') AS c, regexp_matches(t, '\belse\b') AND NOT regexp_matches(t, '\belse\s+if\b') AS e, regexp_matches(t, '&&|[|][|]') AS a,
 regexp_matches(t, '^(//|#|[*])') AS skip, regexp_matches(t, '^(//|#|--)') AS cm, regexp_matches(t, '^(/[*]|\"{3}|''{3})') AS op, regexp_matches(t, '[*]/$') OR (length(t) > 3 AND regexp_matches(t, '(\"{3}|''{3})$')) AS cl, regexp_matches(t, '[*]/|\"{3}|''{3}') AS en,
 length(x) - length(translate(x, '{(', '')) - length(x) + length(translate(x, '})', '')) AS d FROM t),
r AS (SELECT page_id, 0 AS i, 0 AS cost, 0 AS depth, 0 AS open, 0 AS deep, false AS block FROM pages WHERE html IS NOT NULL UNION ALL SELECT r.page_id, r.i + 1,
 CASE WHEN m.skip THEN r.cost ELSE r.cost + CASE WHEN m.w THEN 1 + r.depth ELSE 0 END + m.e::INT + m.a::INT END, CASE WHEN m.skip THEN r.depth WHEN m.c THEN greatest(0, r.depth + (m.w AND m.o)::INT - 1) ELSE r.depth + (m.w AND m.o)::INT END,
 CASE WHEN NOT r.block AND NOT m.blank AND NOT m.cm AND NOT m.op THEN r.open + m.d ELSE r.open END, CASE WHEN NOT r.block AND NOT m.blank AND NOT m.cm AND NOT m.op THEN greatest(r.deep, r.open + m.d) ELSE r.deep END,
 CASE WHEN r.block THEN NOT m.en ELSE m.op AND NOT m.cm AND NOT m.cl END FROM r JOIN m ON m.page_id = r.page_id AND m.i = r.i + 1)
SELECT page_id, arg_max(cost, i) AS cognitive, arg_max(deep, i) AS nesting FROM r GROUP BY page_id""")
def _(t):
    return t("pages").select("page_id", code_text.cognitive(F.col("html")).alias("cognitive"), code_text.text_metrics(F.col("html"))["nesting"].alias("nesting"))


@query("f_base_path", r"SELECT page_id, regexp_extract(regexp_extract(url, '://[^/]+(/[^?#]*)', 1), '^((?:/[^/:\[*{][^/]*){0,2})', 1) AS base FROM pages")
def _(t):
    return t("pages").select("page_id", ids.base_path(F.regexp_extract("url", r"://[^/]+(/[^?#]*)", 1)).alias("base"))


@query("f_entity_id", r"SELECT p_partkey, 'part:' || regexp_replace(lower(p_brand), '[^a-z0-9-]', '_', 'g') || ':' || regexp_replace(lower(p_name), '[^a-z0-9_.:/-]', '_', 'g') AS entity_id FROM part")
def _(t):
    return t("part").select("p_partkey", ids.entity_id(F.lit("Part"), F.col("p_brand"), F.col("p_name")).alias("entity_id"))


@query("f_sub_before_first", "SELECT p_partkey, split_part(p_type, ' ', 1) AS head FROM part")
def _(t):
    return t("part").select("p_partkey", ids.before_first(F.col("p_type"), " ").alias("head"))


@query("f_path_segments", "SELECT page_id, len(list_filter(string_split(regexp_extract(url, '://[^/]+(/[^?#]*)', 1), '/'), lambda x: x <> '')) AS n FROM pages")
def _(t):
    return t("pages").select("page_id", long(F.size(ids.segments(F.regexp_extract("url", r"://[^/]+(/[^?#]*)", 1)))).alias("n"))


@query("f_join_path", "SELECT page_id, rtrim(regexp_extract(url, '^[^?#]*'), '/') || '/index' AS joined FROM pages")
def _(t):
    return t("pages").select("page_id", ids.join_path(F.regexp_extract("url", "^[^?#]*", 0), F.lit("/index")).alias("joined"))


@query("f_url_parameters", "SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page_number, regexp_extract(url, '://([^/:]+)', 1) AS host FROM pages")
def _(t):
    pairs = F.str_to_map(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("&"), F.lit("="))
    return t("pages").select("page_id", F.coalesce(F.try_element_at(pairs, F.lit("page")), F.lit("")).alias("page_number"), F.regexp_extract("url", "://([^/:]+)", 1).alias("host"))


@query("f_token_estimate", "SELECT conv_id, turn, length(text) // 4 AS tokens FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", words.token_estimate(F.col("text")).alias("tokens"))


@query("f_severity_ratio", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 10 >= 4 THEN 'critical' WHEN l_quantity / 10 >= 3 THEN 'high' WHEN l_quantity / 10 >= 2 THEN 'medium' ELSE 'low' END AS severity FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", ladders.severity(F.col("l_quantity"), F.lit(10), (2, 3, 4)).alias("severity"))


@query("f_confidence_level", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 50 >= 0.8 THEN 'high' WHEN l_quantity / 50 >= 0.5 THEN 'medium' WHEN l_quantity / 50 >= 0.3 THEN 'low' ELSE 'insufficient' END AS level FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", ladders.confidence_level(F.col("l_quantity") / 50).alias("level"))


@query("f_grade", "SELECT p_partkey, CASE WHEN p_size * 2 >= 90 THEN 'A' WHEN p_size * 2 >= 75 THEN 'B' WHEN p_size * 2 >= 60 THEN 'C' WHEN p_size * 2 >= 40 THEN 'D' ELSE 'F' END AS grade FROM part")
def _(t):
    return t("part").select("p_partkey", ladders.grade(F.col("p_size") * 2).alias("grade"))


@query("f_footprint", "SELECT c_custkey, CASE WHEN s < 25 THEN 'LOW' WHEN s < 50 THEN 'MEDIUM' WHEN s < 75 THEN 'HIGH' ELSE 'VERY_HIGH' END AS level, round(s, 6) AS score FROM (SELECT c_custkey, least(c_nationkey * 2.0, 30.0) + least(abs(c_acctbal) * 0.01, 60.0) AS s FROM customer)")
def _(t):
    foot = ladders.footprint([(F.col("c_nationkey"), 2.0, 30.0), (F.abs("c_acctbal"), 0.01, 60.0)])
    return t("customer").select("c_custkey", foot["level"].alias("level"), F.round(foot["score"], 6).alias("score"))


@query("f_json_props", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def _(t):
    return t("events").select("event_type", F.from_json("props", "k long")["k"].alias("k")).groupBy("event_type").agg(F.sum("k").alias("total"))


@query("f_duration", "SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS seconds FROM events GROUP BY user_id")
def _(t):
    return t("events").groupBy("user_id").agg(F.expr("timestampdiff(SECOND, min(ts), max(ts))").alias("seconds"))


@query("f_looks_like_sql", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)SELECT|INSERT|UPDATE|DELETE|WHERE|JOIN|INTO|VALUES|MERGE|CALL|FROM|SET')")
def _(t):
    return t("documents").where(code_text.looks_like_sql(F.col("text"))).select("doc_id")


# Detectors, verification, search, incremental


@query("d_hotspots", "SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS cognitive, l_linenumber AS complexity FROM lineitem WHERE l_quantity > 20 OR l_linenumber > 15 ORDER BY cognitive DESC, complexity DESC, id LIMIT 10")
def _(t):
    n = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("Function").alias("kind"), F.col("l_linenumber").alias("complexity"), F.col("l_quantity").alias("cognitive"),
                             F.lit(0).alias("nesting"), F.lit(1).alias("loc"), F.lit(0).alias("param_count"))
    return smells.hotspots(n).select("id", "cognitive", "complexity")


@query("d_god_class", """WITH c AS (SELECT o_custkey AS id, count(*) AS m, sum(o_totalprice) / 1000 AS loc, avg(o_totalprice) / 10000 AS cx FROM orders GROUP BY o_custkey)
SELECT id, m > 20 OR loc > 500 OR (m > 10 AND cx > 10) AS god, m > 30 OR (m > 15 AND cx > 10) OR (loc > 1000 AND m > 20) AS strict_god FROM c""")
def _(t):
    c = t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("m"), (F.sum("o_totalprice") / 1000).alias("loc"), (F.avg("o_totalprice") / 10000).alias("cx"))
    god = lambda strict: smells.god_class(F.col("m"), F.col("loc"), F.col("cx"), strict)
    return c.select("id", god(False).alias("god"), god(True).alias("strict_god"))


_ADDRESSES = ("/users/list", "/users/:id", "/profile", "/account/x", "/settings", "/login", "/register", "/reset-password", "/products/1", "/cart", "/checkout", "/orders/:id", "/admin/users", "/dashboard", "/api/v1/items", "/internal/jobs",
              "/reports", "/search", "/widgets", "/widget/part", "/", "/orders", "/orders/:id/lines", "/posts/new", "/inbox")
# Base path, name and category of each address.
_BASES = ("/users/list|User Management|user-facing", "/users|User Management|user-facing", "/profile|User Profile|user-facing", "/account/x|Account Management|user-facing", "/settings|Settings|user-facing", "/login|Authentication|user-facing",
          "/register|User Registration|user-facing", "/reset-password|Password Recovery|user-facing", "/products/1|Product Catalog|user-facing", "/cart|Shopping Cart|user-facing", "/checkout|Checkout|user-facing", "/orders|Order Management|user-facing",
          "/admin/users|User Management|admin", "/dashboard|Dashboard|admin", "/api/v1|V1|api-only", "/internal/jobs|Job Management|internal", "/reports|Reporting|user-facing", "/search|Search|user-facing", "/widgets|Widget Management|user-facing",
          "/widget/part|Part|user-facing", "|Home|user-facing", "/orders|Order Management|user-facing", "/orders|Order Management|user-facing", "/posts/new|Blog|user-facing", "/inbox|Messaging|user-facing")


@query("d_class_smells", """WITH c AS (SELECT o_custkey AS id, count(*) AS m, sum(o_totalprice) / 1000 AS loc, avg(o_totalprice) / 10000 AS cx, count(*) FILTER (o_orderstatus <> 'P') AS acc FROM orders GROUP BY o_custkey),
r AS (SELECT id, 'large_class' AS smell, loc / 500 AS x, [1.5, 2.0, 3.0] AS k FROM c WHERE loc > 500 UNION ALL SELECT id, 'too_many_methods', m / 20.0, [1.5, 2.0, 2.5] FROM c WHERE m > 20)
SELECT id, smell, CASE WHEN x >= k[3] THEN 'critical' WHEN x >= k[2] THEN 'high' WHEN x >= k[1] THEN 'medium' ELSE 'low' END AS severity FROM r
UNION ALL SELECT id, 'god_class', 'critical' FROM c WHERE m > 30 OR (m > 15 AND cx > 10) OR (loc > 1000 AND m > 20) UNION ALL SELECT id, 'data_class', 'low' FROM c WHERE m > 5 AND acc / m > 0.8""")
def _(t):
    """Customers as classes, their orders as methods; orders that are done or open are accessors."""
    c = t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("method_count"), (F.sum("o_totalprice") / 1000).alias("loc"), (F.avg("o_totalprice") / 10000).alias("avg_complexity"),
                                                                F.count_if(F.col("o_orderstatus") != "P").alias("accessor_count"))
    return smells.class_smells(c).select("id", "smell", "severity")


@query("d_features", "WITH r AS (SELECT string_split(([" + ", ".join(f"'{x}'" for x in _BASES) + f"])[CAST(p_partkey % {len(_BASES)} + 1 AS INTEGER)], '|') AS f, p_partkey % {len(_BASES)} AS k FROM part)" + """
SELECT f[1] AS base, f[2] AS name, count(DISTINCT k) AS n_routes, CASE WHEN count(DISTINCT k) <= 3 THEN 'simple' WHEN count(DISTINCT k) <= 8 THEN 'moderate' ELSE 'complex' END AS complexity, f[3] AS category FROM r GROUP BY f[1], f[2], f[3]""")
def _(t):
    """Routes by rule from the parts; those with one base path are a feature."""
    address = F.element_at(F.array(*map(F.lit, _ADDRESSES)), (F.col("p_partkey") % len(_ADDRESSES) + 1).cast("int"))
    routes = t("part").select(address.alias("route"), F.lit(None).cast("string").alias("component")).distinct()
    return reports.discover_features(routes).select("base", "name", "n_routes", "complexity", "category")


@query("d_readiness", """WITH c AS (SELECT count(*) AS n, count(l.doc_id) AS k, count(*) FILTER (d.n_chars > 50000 AND l.doc_id IS NULL) AS crit FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT least(100.0, greatest(0.0, round(k * 100.0 / n) - least(crit * 2, 20)) + 4) AS score FROM c""")
def _(t):
    known = t("labels").select(F.col("doc_id").alias("k")).distinct()
    j = t("documents").join(known, F.col("doc_id") == F.col("k"), "left")
    c = j.agg(F.avg(F.col("k").isNotNull().cast("double")).alias("cover"), F.count_if((F.col("n_chars") > 50000) & F.col("k").isNull()).alias("crit"))
    return c.select(reports.testing_score(F.col("cover"), F.col("crit"), F.lit(True), F.lit(False), F.lit(False))["score"].alias("score"))


_CLAIMS = """e AS (SELECT l_orderkey AS claim_id, l_quantity / 50 AS c, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.8 ELSE 0.6 END AS w, l_linestatus = 'O' AS pro FROM lineitem),
g AS (SELECT claim_id, sum(CASE WHEN pro THEN c * w END) / sum(CASE WHEN pro THEN w END) AS m, count(*) FILTER (pro) AS p, count(*) FILTER (NOT pro) AS k FROM e GROUP BY claim_id),
s AS (SELECT o.o_orderkey AS claim_id, o.o_custkey AS section, round(coalesce(g.m * (1 - 0.5 * g.k / (g.p + g.k)), 0), 9) AS confidence, g.p, g.k FROM orders o LEFT JOIN g ON o.o_orderkey = g.claim_id),
f AS (SELECT *, CASE WHEN k > 0 AND p = 0 THEN 'contradicted' WHEN p IS NOT NULL AND confidence >= 0.7 THEN 'verified' WHEN p IS NOT NULL AND confidence >= 0.4 THEN 'partially_verified' ELSE 'unverified' END AS status FROM s)"""


def _claims(t):
    ev = t("lineitem").select(F.col("l_orderkey").alias("claim_id"), (F.col("l_quantity") / 50).alias("confidence"), F.col("l_returnflag").alias("evidence_type"), (F.col("l_linestatus") == "O").alias("supports"))
    weight = F.when(F.col("evidence_type") == "A", 1.0).when(F.col("evidence_type") == "N", 0.8).otherwise(0.6)
    return verify.claim_scores(t("orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("section")), ev, weight)


@query("a29_claim_confidence", f"""WITH {_CLAIMS} SELECT claim_id, round(confidence, 6) AS confidence, status, CASE WHEN k > 0 AND p = 0 THEN 'critical' WHEN p IS NULL THEN 'high' WHEN confidence >= 0.7 THEN 'none' WHEN confidence >= 0.4 THEN 'low' WHEN confidence >= 0.2 THEN 'medium' ELSE 'high' END AS risk,
p IS NOT NULL AND NOT (k > 0 AND p = 0) AND confidence < 0.4 AS needs_review FROM f""")
def _(t):
    return _claims(t).select("claim_id", F.round("confidence", 6).alias("confidence"), "status", "risk", "needs_review")


@query("a30_section_stats", f"WITH {_CLAIMS} SELECT section, count(*) AS total, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'contradicted') AS contradicted, round(avg(confidence), 6) AS confidence FROM f GROUP BY section")
def _(t):
    return verify.section_stats(_claims(t)).select("section", "total", "verified", "contradicted", F.round("confidence", 6).alias("confidence"))


@query("a31_bundle_metrics", f"WITH {_CLAIMS}, x AS (SELECT section, count(*) AS total, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'contradicted') AS contradicted, avg(confidence) AS confidence FROM f GROUP BY section) SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(verified) AS BIGINT) AS verified, CAST(sum(contradicted) AS BIGINT) AS contradicted, round(avg(confidence), 6) AS confidence, false AS approved FROM x")
def _(t):
    return verify.bundle_metrics(verify.section_stats(_claims(t))).select("total", "verified", "contradicted", F.round("confidence", 6).alias("confidence"), "approved")


@query("a32_by_status", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM orders")
def _(t):
    g = t("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return g.unionByName(t("orders").agg(F.count("*").alias("n")).select(F.lit("all").alias("status"), "n"))


_BM25 = r"""WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark WHERE item_id % 20 = 0), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS m FROM d), x AS (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM d), i AS MATERIALIZED (SELECT doc_id, l, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM i GROUP BY term),
p AS (SELECT i.doc_id, i.term, ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * i.tf * 2.2 / (i.tf + 1.2 * (0.25 + 0.75 * i.l / s.m)) AS v FROM i JOIN f ON i.term = f.term CROSS JOIN s),
a AS (SELECT q.item_id, p.doc_id, sum(p.v) AS score FROM p JOIN q ON p.term = q.term GROUP BY q.item_id, p.doc_id),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM a) WHERE r <= 20)"""


@query("t1_bm25", _BM25 + " SELECT item_id, doc_id, round(score, 6) AS score FROM b")
def _(t):
    """The best documents of the questions: every benchmark item whose id is divisible by 20, against all documents."""
    return search.bm25_top(t("documents"), t("benchmark").where("item_id % 20 = 0"), "doc_id", "item_id").select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query("t1_bm25_combined", _BM25 + " SELECT b.item_id, b.doc_id, round(0.7 * b.score + 0.3 * coalesce(l.quality, 0.1), 6) AS score FROM b LEFT JOIN labels l ON b.doc_id = l.doc_id")
def _(t):
    ranks = t("labels").select("doc_id", F.col("quality").cast("double").alias("rank"))
    return search.blended(search.bm25_top(t("documents"), t("benchmark").where("item_id % 20 = 0"), "doc_id", "item_id"), ranks, "doc_id").select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query("x1_hash_diff", """WITH a AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 9 <> 0), b AS (SELECT doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 13 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'deleted' WHEN a.path IS NULL THEN 'added' WHEN a.h <> b.h THEN 'modified' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.path = b.path""")
def _(t):
    """Two snapshots of an index: one lacks every ninth file, the other every thirteenth."""
    d = t("documents").select(F.col("doc_id").alias("path"), "text")
    old = d.where("path % 9 <> 0").select("path", F.sha2("text", 256).alias("content_hash"))
    changed = F.when(F.col("path") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return incremental.diff_files(old, d.where("path % 13 <> 0").select("path", F.sha2(changed, 256).alias("content_hash")))


@query("x3_state_upsert", "SELECT doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN md5(text || '2') ELSE md5(text) END AS content_hash FROM documents WHERE doc_id % 10 <> 0")
def _(t):
    d = t("documents").select(F.col("doc_id").alias("path"), "text")
    new = d.where("path % 3 = 0").select("path", F.md5(F.concat("text", F.lit("2"))).alias("content_hash"))
    return incremental.save_state(d.select("path", F.md5("text").alias("content_hash")), new, d.where("path % 10 = 0"))


@query("x6_resume_filter", "SELECT doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return incremental.remaining(t("documents").select(F.col("doc_id").alias("path")), t("labels").select(F.col("doc_id").alias("path")))


@query("x9_retention", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def _(t):
    return incremental.unexpired(t("orders"), F.expr("timestamp_ntz'1997-01-01 00:00:00'"), "o_orderdate").select("o_orderkey")


@query("x7_windowed_activity", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def _(t):
    w = incremental.windowed_activity(t("events"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("value", 4).alias("value"))


@query("p1_adhoc_sql", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def _(t):
    from codelattice.plans.tools import read_only

    return read_only({"orders": t("orders")}, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > :least GROUP BY 1", {"least": 100000})
