"""Queries of linkers, named retrievals, coverage and document export."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelattice.operators import hops, links, reports, retrieval, search, smells, traversal
from codelattice.operators.lineage import cut
from codelattice.plans import graph_queries, table_queries
from codelattice.sources import parsers

on_graph, on_tables = graph_queries.query, table_queries.query
QUERIES, ORACLES = {}, {}  # these register with the two modules above


@on_tables("j13_linker_first_match", "SELECT 'SUPPLIES' AS type, c.c_custkey AS src, min(s.s_suppkey) AS dst FROM customer c JOIN supplier s ON lower(replace(c.c_name, 'Customer', '')) = lower(replace(s.s_name, 'Supplier', '')) GROUP BY c.c_custkey")
def _(t):
    a = t("customer").select(F.col("c_custkey").alias("id"), F.replace("c_name", F.lit("Customer"), F.lit("")).alias("name"))
    b = t("supplier").select(F.col("s_suppkey").alias("id"), F.replace("s_name", F.lit("Supplier"), F.lit("")).alias("name"))
    return links.link_first(a, b, "name", "SUPPLIES")


@on_tables("j14_composite_link", "SELECT DISTINCT 'SOLD' AS type, l.l_orderkey * 10 + l.l_linenumber AS src, p.p_partkey AS dst FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey AND l.l_linenumber = p.p_size")
def _(t):
    a = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("size"))
    b = t("part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("part"), F.col("p_size").alias("size"))
    return links.link_composite(a, b, ["part", "size"], "SOLD")


@on_tables("j15_symbol_resolution", """SELECT l.l_orderkey * 10 + l.l_linenumber AS id, s.s_suppkey IS NULL AS placeholder FROM lineitem l LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_nationkey = l.l_linenumber""")
def _(t):
    uses = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").cast("string").alias("name"), F.col("l_linenumber").cast("string").alias("module"))
    known = t("supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_suppkey").cast("string").alias("name"), F.col("s_nationkey").cast("string").alias("module"))
    return links.resolve_symbols(uses, known).select("id", "placeholder")


@on_tables("j16_include_placeholders", "SELECT d.doc_id AS src, d.doc_id + 50 AS dst, 4 AS weight, l.doc_id IS NULL AS placeholder FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id + 50 = l.doc_id")
def _(t):
    uses = t("documents").select(F.col("doc_id").alias("path"), (F.col("doc_id") + 50).alias("included"))
    return links.includes(uses, t("labels").select(F.col("doc_id").alias("path"))).select("src", "dst", "weight", "placeholder")


@on_tables("j22_containment_range", """WITH o AS (SELECT o_custkey AS path, o_orderkey AS id, CAST(o_totalprice / 1000 AS INTEGER) AS a, CAST(o_totalprice / 1000 AS INTEGER) + 60 AS b FROM orders), i AS (SELECT c_custkey AS path, c_custkey AS id, 120 AS line FROM customer),
k AS (SELECT i.id, o.id AS owner, row_number() OVER (PARTITION BY i.id ORDER BY o.b - o.a, o.id) AS r FROM i JOIN o ON i.path = o.path AND i.line BETWEEN o.a AND o.b) SELECT id, owner FROM k WHERE r = 1""")
def _(t):
    start = F.round(F.col("o_totalprice") / 1000).cast("int")
    outer = t("orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("id"), start.alias("start_line"), (start + 60).alias("end_line"))
    return links.contained(t("customer").select(F.col("c_custkey").alias("path"), F.col("c_custkey").alias("id"), F.lit(120).alias("line")), outer)


@on_graph("r14_flow_by_layer", """, s AS (SELECT src AS o, dst AS part FROM edges WHERE type = 'USES'), d AS (SELECT src AS part, dst AS sup FROM edges WHERE type = 'DEPENDS_ON')
SELECT n.id, count(DISTINCT s.part) AS parts, count(DISTINCT d.sup) AS suppliers FROM nodes n LEFT JOIN s ON n.id = s.o LEFT JOIN d ON s.part = d.part WHERE n.kind = 'Order' GROUP BY n.id""")
def _(n, e):
    """Suppliers travel as one list of numbers a part to where all parts of an order are."""
    used = cut(hops.of_type(e, "USES").select(F.col("src").alias("o"), F.col("dst").alias("part")), "used")
    lists = hops.number_lists(hops.of_type(e, "DEPENDS_ON"))
    wide = used.join(lists, F.col("part") == F.col("at")).select("o", "first", "near", "far", "n_ends")
    found = hops.dealt_numbers(wide, "o", "sup").groupBy("o", "sup").agg(F.lit(1).alias("_one")).groupBy("o").agg(F.count("sup").alias("suppliers"))
    g = used.groupBy("o").agg(F.count("part").alias("parts")).join(found, "o", "left")
    zero = F.lit(0).cast("long")
    return hops.of_kind(n, "Order").join(g, F.col("id") == F.col("o"), "left").select("id", F.coalesce("parts", zero).alias("parts"), F.coalesce("suppliers", zero).alias("suppliers"))


@on_graph("r18_menu_path", "SELECT n.id, [r.name, n.name] AS path FROM nodes n JOIN nodes r ON n.parent_id = r.id WHERE n.kind = 'Nation'")
def _(n, e):
    return traversal.ancestors(hops.of_kind(n, "Region", "Nation"), 3).where("depth = 1").select("id", "path")


@on_graph("r19_evidence_paths", """, a AS (SELECT src AS x, dst AS y FROM edges WHERE src IN (SELECT 'o:' || o_orderkey FROM orders WHERE o_orderkey % 20 = 0) AND type IN ('CALLS', 'USES', 'DEPENDS_ON')), b AS (SELECT a.x, e.dst AS z FROM a JOIN edges e ON e.src = a.y AND e.type IN ('CALLS', 'USES', 'DEPENDS_ON'))
SELECT x AS seed, y AS id, 1 AS depth FROM a UNION ALL SELECT x, z, 2 FROM b""")
def _(n, e):
    return traversal.paths(e, n.where("kind = 'Order' and cast(substr(id, 3) as bigint) % 20 = 0"), 3, types=("CALLS", "USES", "DEPENDS_ON")).select("seed", "id", "depth")


@on_graph("r21_rules_on_reachable", """, a AS (SELECT DISTINCT dst AS id FROM edges WHERE src IN (SELECT 'o:' || o_orderkey FROM orders WHERE o_orderkey % 20 = 0)), b AS (SELECT DISTINCT e.dst AS id FROM edges e JOIN a ON e.src = a.id), r AS (SELECT * FROM a UNION SELECT * FROM b)
SELECT r.id, coalesce(g.n, 0) AS rules FROM r LEFT JOIN (SELECT dst, count(*) AS n FROM edges WHERE type = 'DEPENDS_ON' GROUP BY dst) g ON r.id = g.dst""")
def _(n, e):
    found = traversal.reach(e, n.where("kind = 'Order' and cast(substr(id, 3) as bigint) % 20 = 0"), 1, 2).select("id").distinct()
    rules = hops.of_type(e, "DEPENDS_ON").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return found.join(rules, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("rules"))


@on_tables("a23_documentation_rollup", """SELECT count(*) FILTER (quality = 1) AS documented, count(*) FILTER (quality = 0) AS undocumented, count(*) FILTER (toxic = 1 AND quality = 0) AS deprecated, round(avg(CAST(quality AS DOUBLE)), 9) AS coverage FROM labels""")
def _(t):
    q = F.col("quality") == 1
    return t("labels").agg(F.count_if(q).alias("documented"), F.count_if(~q).alias("undocumented"), F.count_if((F.col("toxic") == 1) & ~q).alias("deprecated"), F.round(reports.ratio(q, 1.0), 9).alias("coverage"))


@on_tables("a28_mean_dependencies", "SELECT round(avg(n), 9) AS independence FROM (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey)")
def _(t):
    g = t("lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n"))
    return g.agg(F.round(F.avg("n"), 9).alias("independence"))


@on_tables("a39_screen_groups", r"""WITH s AS (SELECT replace(initcap_name, ' ', '') AS name FROM (SELECT p_name AS initcap_name FROM part)), g AS (SELECT name, regexp_replace(name, '(Entry|Results|Result|Detail|Details|List|Search|Edit|Create|Update|View|Add|Delete|Confirm|Confirmation|Summary|Form|Page|Screen|Popup|Dialog|Wizard|History|Report|Lookup|Select)$', '') AS prefix FROM s WHERE NOT regexp_matches(name, '(?i)^(index|error|login|logout|header|footer|menu|layout|common|template|include|main|home|test)'))
SELECT prefix, count(*) AS n_screens FROM g WHERE length(prefix) >= 3 GROUP BY prefix""")
def _(t):
    return reports.screen_groups(t("part").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("name"))).select("prefix", "n_screens")


@on_graph("a40_feature_candidates", """SELECT n.id AS src, min(g.id) AS dst FROM nodes n JOIN nodes g ON contains(lower(g.name), lower(n.name)) WHERE n.kind IN ('Nation', 'Region') AND g.kind IN ('Nation', 'Region') AND length(n.name) >= 3 GROUP BY n.id""")
def _(n, e):
    some = hops.of_kind(n, "Nation", "Region")
    return links.link_containing(some, some, "FEATURE_OF").select("src", "dst")


@on_graph("t4_fuzzy_lookup", "SELECT id, name FROM nodes WHERE kind = 'Nation' AND (contains(lower(name), 'nation_1') OR regexp_matches(lower(name), '.*nation.*1.*')) ORDER BY CASE WHEN lower(name) = 'nation_1' THEN 0 ELSE 1 END, name, id LIMIT 5")
def _(n, e):
    return search.fuzzy(hops.of_kind(n, "Nation"), "Nation_1", 5).select("id", "name")


@on_graph("t5_scored_entry_points", """SELECT id, CAST((CASE WHEN contains(lower(name), 'order') THEN 10 ELSE 0 END) + (CASE WHEN contains(lower(name), '12') THEN 10 ELSE 0 END) + round(10 * least(1.0, abs(weight) / 100000), 6) AS DOUBLE) AS score FROM nodes WHERE contains(lower(name), 'order') OR contains(lower(name), '12') ORDER BY score DESC, id LIMIT 40""")
def _(n, e):
    hits = [F.contains(F.lower("name"), F.lit(w)) for w in ("order", "12")]
    score = sum((F.when(h, 10).otherwise(0) for h in hits), F.lit(0)) + F.round(10 * F.least(F.lit(1.0), F.abs("weight") / 100000), 6)
    return n.where(hits[0] | hits[1]).select("id", score.cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(40)


@on_graph("t11_data_flow_mapping", "SELECT u.dst AS part, count(DISTINCT u.src) AS orders, min(u.src) AS first_order, coalesce(max(d.n), 0) AS suppliers FROM edges u LEFT JOIN (SELECT src, count(*) AS n FROM edges WHERE type = 'DEPENDS_ON' GROUP BY src) d ON u.dst = d.src WHERE u.type = 'USES' GROUP BY u.dst")
def _(n, e):
    use = hops.of_type(e, "USES").groupBy(F.col("dst").alias("part")).agg(F.count_distinct("src").alias("orders"), F.min("src").alias("first_order"))
    dep = hops.of_type(e, "DEPENDS_ON").groupBy(F.col("src").alias("p")).agg(F.count("*").alias("n"))
    return use.join(dep, F.col("part") == F.col("p"), "left").select("part", "orders", "first_order", F.coalesce("n", F.lit(0).cast("long")).alias("suppliers"))


@on_tables("t12_explode_outer", "SELECT p_partkey, unnest(CASE WHEN p_size > 25 THEN string_split(p_type, ' ') ELSE ['none'] END) AS word FROM part")
def _(t):
    words = F.when(F.col("p_size") > 25, F.split("p_type", " "))
    return t("part").select("p_partkey", F.explode(F.coalesce(words, F.array(F.lit("none")))).alias("word"))


@on_tables("t13_layers_of_parts", "SELECT CASE WHEN regexp_matches(p_type, '(?i)economy|promo') THEN 'front' WHEN p_size > 25 THEN 'middle' ELSE 'back' END AS layer, count(*) AS n, list_sort(list(DISTINCT p_brand)) AS brands FROM part GROUP BY 1")
def _(t):
    layer = F.when(F.col("p_type").rlike("(?i)economy|promo"), "front").when(F.col("p_size") > 25, "middle").otherwise("back")
    return t("part").groupBy(layer.alias("layer")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("p_brand")).alias("brands"))


@on_tables("t15_scoped_counts", "SELECT c.c_custkey AS feature, count(o.o_orderkey) AS screens FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE contains(lower(c.c_name), '1') GROUP BY c.c_custkey")
def _(t):
    features = t("customer").where(F.contains(F.lower("c_name"), F.lit("1"))).select(F.col("c_custkey").alias("feature"))
    return retrieval.scoped_counts(features, t("orders").select(F.col("o_custkey").alias("feature")))


@on_graph("d_cross_feature", """, l AS (SELECT DISTINCT b.parent_id AS feature, s.src AS component FROM edges s JOIN nodes b ON s.dst = b.id WHERE s.type = 'DEPENDS_ON')
SELECT a.feature AS a, b.feature AS b, 'entity' AS kind, count(*) AS n_shared FROM l a JOIN l b ON a.component = b.component AND a.feature < b.feature GROUP BY 1, 2""")
def _(n, e):
    home = n.select(F.col("id").alias("dst"), F.col("parent_id").alias("feature"))
    found = hops.of_type(e, "DEPENDS_ON").join(home, "dst").select("feature", F.lit("entity").alias("kind"), F.col("src").alias("component"))
    return links.cross_feature(found)


@on_tables("d_validation_chain", "SELECT l_orderkey AS action, count(l_returnflag) AS n_rules, list_sort(list(DISTINCT l_partkey)) AS fields, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS steps FROM lineitem GROUP BY l_orderkey")
def _(t):
    s = t("lineitem").select(F.col("l_orderkey").alias("action"), F.col("l_linenumber").alias("step"), F.col("l_partkey").alias("field"), F.col("l_returnflag").alias("rule"))
    return links.validation_chain(s).select("action", "n_rules", "fields", F.array_join(F.transform("steps", lambda x: x["step"].cast("string")), ",").alias("steps"))


@on_tables("d_metric_violations", "SELECT l_orderkey, l_linenumber, len(list_filter([l_quantity > 15, l_linenumber > 4, l_extendedprice > 50000], lambda x: x)) AS n FROM lineitem")
def _(t):
    n = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("complexity"), F.lit(0).alias("cognitive"), F.col("l_linenumber").alias("nesting"), (F.col("l_extendedprice") / 1000).alias("loc"), F.lit(0).alias("param_count"))
    return n.select("l_orderkey", "l_linenumber", F.size(smells.violations(F.lit("Function"))).cast("long").alias("n"))


@on_tables("d_overview", """SELECT (SELECT count(*) FROM documents) AS files, (SELECT CAST(sum(n_chars) AS BIGINT) FROM documents) AS loc, (SELECT count(*) FROM part) AS classes, (SELECT count(*) FROM orders) AS functions, (SELECT round(avg(quality), 9) FROM labels) AS documented""")
def _(t):
    one = t("documents").agg(F.count("*").alias("files"), F.sum("n_chars").alias("loc"))
    for d, name in (("part", "classes"), ("orders", "functions")):
        one = one.join(F.broadcast(t(d).agg(F.count("*").alias(name))))
    return one.join(F.broadcast(t("labels").agg(F.round(F.avg("quality"), 9).alias("documented"))))


@on_tables("s15_page_links", r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref\s*=\s*"([^"]*)"', 1)) AS links FROM pages WHERE len(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref\s*=\s*"([^"]*)"', 1)) > 0""")
def _(t):
    return parsers.markup(t("pages"), "page_id", "html").where("what = 'link'").groupBy("page_id").agg(F.count("*").alias("links"))


@on_tables("s23_serialise", """SELECT p_partkey, '{"brand":"' || p_brand || '","size":' || p_size || '}' AS json FROM part""")
def _(t):
    return t("part").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("json"))


@on_tables("s31_export", "SELECT c.c_custkey, '# ' || c.c_name || chr(10) || coalesce(string_agg('- ' || o.o_orderkey || ' ' || o.o_orderpriority, chr(10) ORDER BY o.o_orderkey), '') AS markdown FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey, c.c_name")
def _(t):
    line = F.concat(F.lit("- "), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority")
    rows = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("x"))
    text = F.concat(F.lit("# "), "c_name", F.lit("\n"), F.coalesce(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit("")))
    return t("customer").join(rows, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", text.alias("markdown"))
