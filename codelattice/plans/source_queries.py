"""Queries of build files, routes, modules, annotations and file types, of features, versions and the log channel; texts are written by rule from the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codelattice.operators import features, ranking, reports, smells
from codelattice.operators.lineage import cut
from codelattice.plans import graph_queries, retrieval_queries, table_queries
from codelattice.plans.web_queries import _written
from codelattice.sources import files, parsers
from codelattice.streaming import channel, incremental

on_code, on_graph, on_tables = retrieval_queries.query, graph_queries.query, table_queries.query
QUERIES, ORACLES = {}, {}  # these register with the modules above


def _builds(t):
    k, c = F.col("n_nationkey"), F.col
    plugin = F.when(k % 3 == 0, "  id 'java-library'\n  id(\"war\")").when(k % 3 == 1, "  id 'org.springframework.boot' version '3'").otherwise("  id 'kotlin'")
    text = _written("plugins {\n", plugin, "\n}\ninclude ':m", k, "', ':x'\ndependencies {\n  implementation project(':r", c("n_regionkey"), "')\n  api \"g.h:a", k, ":1.2\"\n  testImplementation 'junit:junit'\n}\n")
    return t("nation").select(k.alias("path"), text.alias("text"))


@on_tables("s19_gradle", """SELECT n_nationkey AS path, unnest(['module', 'module', 'project', 'dependency', 'dependency']) AS what, unnest([NULL, NULL, 'implementation', 'api', 'testImplementation']) AS scope, unnest([':m' || n_nationkey, ':x', 'r' || n_regionkey, 'g.h:a' || n_nationkey || ':1.2', 'junit:junit']) AS value FROM nation
UNION ALL SELECT n_nationkey, 'plugin', NULL, unnest(CASE n_nationkey % 3 WHEN 0 THEN ['java-library', 'war'] WHEN 1 THEN ['org.springframework.boot'] ELSE ['kotlin'] END) FROM nation""")
def _(t):
    return parsers.gradle(_builds(t))


@on_tables("s19_module_types", "SELECT n_nationkey AS path, CASE n_nationkey % 3 WHEN 0 THEN 'war' ELSE 'org.springframework.boot' END AS type FROM nation WHERE n_nationkey % 3 < 2")
def _(t):
    return parsers.module_type(parsers.gradle(_builds(t)))


@on_tables("s29_module_structure", """WITH d AS (SELECT DISTINCT 'DEPENDS_ON_MODULE' AS type, 'n' || s_nationkey AS src, 'n' || (s_suppkey % 40) AS dst FROM supplier WHERE s_suppkey % 40 < 25 UNION SELECT DISTINCT 'HAS_DEPENDENCY', 'n' || s_nationkey, 'g:a' || s_suppkey % 5 || ':1' FROM supplier)
SELECT * FROM d UNION ALL SELECT 'CONTAINS_FILE', 'n' || c_nationkey, 'f' || c_custkey FROM customer UNION ALL SELECT 'DEFINED_IN_MODULE', 'f' || c_custkey, 'n' || c_nationkey FROM customer""")
def _(t):
    n, s = lambda c: F.concat(F.lit("n"), F.col(c).cast("string")), t("supplier")
    none = F.lit(None).cast("string")
    own = s.select(n("s_nationkey").alias("module"), F.concat(F.lit("n"), (F.col("s_suppkey") % 40).cast("string")).alias("target"), *(none.alias(c) for c in ("group", "artifact", "version")))
    outside = s.select(n("s_nationkey").alias("module"), none.alias("target"), F.lit("g").alias("group"), F.concat(F.lit("a"), (F.col("s_suppkey") % 5).cast("string")).alias("artifact"), F.lit("1").alias("version"))
    held = t("customer").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("path"), n("c_nationkey").alias("module"))
    return files.module_structure(t("nation").select(n("n_nationkey").alias("module"), F.lit("/").alias("root")), own.union(outside), held)


@on_tables("s20_routes", """SELECT 'src/r' || n_nationkey || '.tsx' AS path, 'react' AS framework, unnest(['/n' || n_nationkey, '/n' || n_nationkey || '/:id']) AS route, unnest(['List', 'Item' || n_nationkey]) AS component FROM nation
UNION ALL SELECT 'src/a' || n_nationkey || '.ts', CASE WHEN n_nationkey % 2 = 0 THEN 'angular' ELSE 'vue' END, 'v' || n_nationkey, 'View' FROM nation UNION ALL SELECT 'web/pages/p' || n_nationkey || '/index.tsx', 'next', '/p' || n_nationkey, NULL FROM nation
UNION ALL SELECT 'web/pages/p' || n_nationkey || '/[id].tsx', 'next', '/p' || n_nationkey || '/[id]', NULL FROM nation""")
def _(t):
    k = F.col("n_nationkey")
    one = lambda path, text: F.struct(path.alias("path"), text.alias("text"))
    rows = F.array(
        one(_written("src/r", k, ".tsx"), _written('<Route path="/n', k, '" element={<List />} />\n<Route path="/n', k, '/:id" component={Item', k, "} />")),
        one(_written("src/a", k, ".ts"), _written(F.when(k % 2 == 0, "import { Routes } from '@angular/router';\n").otherwise("import Vue;\n"), "const r = [{ path: 'v", k, "', component: View }];")),
        one(_written("web/pages/p", k, "/index.tsx"), F.lit("export default 1")), one(_written("web/pages/p", k, "/[id].tsx"), F.lit("export default 1")),
        one(_written("web/pages/api/p", k, ".ts"), F.lit("export default 1")), one(_written("web/pages/_app", k, ".tsx"), F.lit("export default 1")))
    return parsers.code_routes(t("nation").select(F.inline(rows)))


@on_tables("s20_child_routes", "SELECT '/c' || c_nationkey || '/i' || c_custkey AS route, '/c' || c_nationkey AS parent FROM customer UNION ALL SELECT '/c' || c_nationkey || '/i' || c_custkey || '/edit/now', '/c' || c_nationkey || '/i' || c_custkey FROM customer WHERE c_custkey % 2 = 0")
def _(t):
    k = _written("/c", F.col("c_nationkey"), "/i", F.col("c_custkey"))
    more = F.when(F.col("c_custkey") % 2 == 0, F.array(_written("/c", F.col("c_nationkey")), k, F.concat(k, F.lit("/edit/now")))).otherwise(F.array(_written("/c", F.col("c_nationkey")), k))
    return parsers.child_routes(t("customer").select(F.explode(more).alias("route")))


@on_tables("s8_spring_kinds", "SELECT p_partkey AS path, (['SpringController', 'SpringController', 'SpringService', 'FlowHandler', 'SpringService'])[CAST(p_partkey % 6 AS INTEGER)] AS kind FROM part WHERE p_partkey % 6 > 0")
def _(t):
    texts = ("class Plain { }", "@Controller\nclass A { }", '@RestController("x")\nclass B { }', "@Service class C { }", "@Service class D extends BaseFlowHandler { }", "@Component\nclass E { }")
    text = F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return parsers.spring_kinds(t("part").select(F.col("p_partkey").alias("path"), text.alias("text")))


@on_tables("s5_dispatch", "SELECT language, count(*) AS n FROM (SELECT (['java', 'typescript', 'typescript', 'cpp', NULL, 'sql', 'python', 'csharp', 'go', 'cpp'])[CAST(p_partkey % 10 + 1 AS INTEGER)] AS language FROM part) WHERE language IS NOT NULL GROUP BY language")
def _(t):
    names = ("a/B.java", "a/b.tsx", "a.b/c.js", "x.HPP", "noext", "q.sql", "m.py", "P.cs", "s.go", "t.cc")
    path = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return t("part").select(parsers.language_of(path).alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("n"))


@on_code("s24_deleted_counts", """, g AS (SELECT id, file FROM nodes WHERE file IN (SELECT 'f:' || n_nationkey FROM nation WHERE n_nationkey % 5 = 0)), x AS (SELECT DISTINCT g.file, e.type, e.src, e.dst FROM edges e JOIN g ON g.id = e.src OR g.id = e.dst)
SELECT n.file AS path, n.n AS nodes_deleted, coalesce(r.n, 0) AS edges_deleted FROM (SELECT file, count(*) AS n FROM g GROUP BY file) n LEFT JOIN (SELECT file, count(*) AS n FROM x GROUP BY file) r ON n.file = r.file""")
def _(n, e):
    nodes = n.select(F.col("id").alias("entity_id"), F.col("file").alias("file_path"))
    return incremental.deletion_counts(nodes, e, n.where("kind = 'File' and cast(substr(id, 3) as int) % 5 = 0").select(F.col("id").alias("path")))


_LAYERS = """, u AS (SELECT n.file AS feature, n.id FROM nodes n WHERE n.name LIKE '%Controller'), a AS (SELECT DISTINCT u.feature, e.dst AS id FROM u JOIN edges e ON e.src = u.id AND e.type = 'HAS_METHOD'),
v AS (SELECT DISTINCT a.feature, e.dst AS id FROM a JOIN edges e ON e.src = a.id AND e.type = 'CALLS'), d AS (SELECT DISTINCT v.feature, e.dst AS id FROM v JOIN edges e ON e.src = v.id AND e.type IN ('CALLS', 'USES_TABLE')),
l AS (SELECT 'FEATURE_HAS_UI' AS type, feature AS src, id AS dst FROM u UNION ALL SELECT 'FEATURE_HAS_API', feature, id FROM a UNION ALL SELECT 'FEATURE_HAS_SERVICE', feature, id FROM v UNION ALL SELECT 'FEATURE_HAS_DATA', feature, id FROM d)"""


def _traced(n, e):
    routes = n.where("name like '%Controller'").select(F.col("file").alias("feature"), "id")
    return features.trace_features(routes, e, (("HAS_METHOD",), ("CALLS",), ("CALLS", "USES_TABLE")))


@on_code("d_feature_trace", f"""{_LAYERS}, f AS (SELECT src AS feature, count(*) FILTER (type = 'FEATURE_HAS_UI') AS n_ui, count(*) FILTER (type = 'FEATURE_HAS_API') AS n_api, count(*) FILTER (type = 'FEATURE_HAS_SERVICE') AS n_service, count(*) FILTER (type = 'FEATURE_HAS_DATA') AS n_data FROM l GROUP BY src)
SELECT *, CASE WHEN n_ui + n_api + n_service <= 3 THEN 'simple' WHEN n_ui + n_api + n_service <= 8 THEN 'moderate' ELSE 'complex' END AS complexity FROM f""")
def _(n, e):
    return _traced(n, e)[0]


@on_code("d_feature_edges", f"{_LAYERS} SELECT type, src, count(*) AS n, min(dst) AS first_dst FROM l GROUP BY type, src")
def _(n, e):
    return _traced(n, e)[1].groupBy("type", "src").agg(F.count("*").alias("n"), F.min("dst").alias("first_dst"))


@on_tables("d_cascades", "SELECT DISTINCT p_name AS source, s_name AS target, 'Changes to ' || p_name || ' may cascade to ' || s_name AS implication FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag <> 'N' AND (l_returnflag = 'A' OR p_size > 25)")
def _(t):
    p, s = lambda c: F.concat(F.lit("p"), F.col(c).cast("string")), lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    entities = t("part").select(p("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") > 25).alias("cascades")).union(t("supplier").select(s("s_suppkey"), "s_name", F.lit(None).cast("boolean")))
    kind = F.when(F.col("l_returnflag") == "N", "USES").otherwise("REFERENCES")
    return features.cascades(entities, t("lineitem").select(kind.alias("type"), p("l_partkey").alias("src"), s("l_suppkey").alias("dst"), F.when(F.col("l_returnflag") == "A", "ALL").alias("cascade")))


@on_tables("d_version_feedback", """SELECT c.conv_id AS artifact, 1 AS version1, 3 AS version2, coalesce(string_agg(x.text, ' | ' ORDER BY x.turn), '') AS feedback FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN conversations x ON x.conv_id = c.conv_id AND x.turn > 1 AND x.turn <= 3 AND x.role = 'user' GROUP BY c.conv_id""")
def _(t):
    history = t("conversations").select(F.col("conv_id").alias("artifact"), F.col("turn").alias("version"), F.when(F.col("role") == "user", F.col("text")).alias("feedback"))
    pairs = t("conversations").select(F.col("conv_id").alias("artifact"), F.lit(1).alias("version1"), F.lit(3).alias("version2")).distinct()
    return features.version_feedback(history, pairs).select("artifact", "version1", "version2", F.array_join("feedback", " | ").alias("feedback"))


@on_tables("x7_buffered_flushes", """WITH e AS (SELECT user_id % 3 AS channel, event_id AS id, epoch_us(ts) // 20000000 AS ms FROM events), f AS (SELECT *, min(ms) OVER (PARTITION BY channel) AS first_ms FROM e), t AS (SELECT *, (ms - first_ms) // 2000 AS tick FROM f),
n AS (SELECT *, (row_number() OVER (PARTITION BY channel, tick ORDER BY ms, id) - 1) // 20 AS part FROM t)
SELECT channel, tick, part, count(*) AS n, arg_min(id, (ms, id)) AS first, arg_max(id, (ms, id)) AS last FROM n GROUP BY channel, tick, part""")
def _(t):
    """Without failures a flush holds up to 20 entries of one interval, which SQL can tell by numbering. Time runs 20,000 times as fast, so that intervals hold several events."""
    e = t("events").select((F.col("user_id") % 3).alias("channel"), F.col("event_id").alias("id"), F.expr("unix_micros(cast(ts as timestamp)) div 20000000").alias("at_ms"))
    first = e.groupBy("channel").agg(F.min("at_ms").alias("first_ms"))
    found = channel.buffered_flushes(e).join(first, "channel").join(e.select("channel", F.col("id").alias("last"), F.col("at_ms").alias("last_ms")), ["channel", "last"])
    tick = F.expr("(last_ms - first_ms) div 2000")
    found = found.withColumn("tick", tick).withColumn("part", (F.row_number().over(Window.partitionBy("channel", "tick").orderBy("flush")) - 1).cast("long"))
    return found.select("channel", "tick", "part", F.col("n").cast("long").alias("n"), "first", "last")


@on_graph("p5_projections", "SELECT 'calls' AS name, count(*) FILTER (type = 'CALLS') AS n_edges FROM edges UNION ALL SELECT 'used', count(*) FILTER (type IN ('USES', 'DEPENDS_ON')) FROM edges")
def _(n, e):
    """Two named projections are made and listed after a third is dropped."""
    store = ranking.Projections(e.sparkSession)
    for name, types in (("calls", ("CALLS",)), ("used", ("USES", "DEPENDS_ON")), ("gone", ("CALLS",))):
        store.project(name, e, types)
    store.drop("gone")
    return store.listed()


@on_tables("p6_thresholds", "SELECT CAST(p_size % 5 AS INTEGER) AS low, count(*) AS n FROM part WHERE p_size > 40 GROUP BY p_size % 5")
def _(t):
    """A threshold of the smells, given by the caller, in place of its default."""
    m = t("part").select(F.col("p_size"), F.lit("Function").alias("kind"), F.lit(0).alias("complexity"), F.lit(0).alias("cognitive"), F.lit(0).alias("nesting"), F.col("p_size").alias("loc"), F.lit(0).alias("param_count"))
    found = m.where(F.size(smells.violations(F.col("kind"), limits={"loc": 40})) > 0)
    return found.groupBy((F.col("p_size") % 5).cast("int").alias("low")).agg(F.count("*").alias("n"))


@on_tables("s31_export_html", "SELECT c_custkey, '<h1>' || c_name || '</h1>' || chr(10) || '<ul>' || coalesce((SELECT string_agg('<li>' || o_orderkey || ' &amp; ' || o_orderpriority || '</li>', '' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') || '</ul>' AS body FROM customer")
def _(t):
    return _exported(t, "html")


@on_tables("s31_export_json", """SELECT c_custkey, '{"title":"' || c_name || '","children":[' || coalesce((SELECT string_agg('"' || o_orderkey || ' & ' || o_orderpriority || '"', ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') || ']}' AS body FROM customer""")
def _(t):
    return _exported(t, "json")


def _exported(t, fmt: str):
    children = t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("position"), F.concat(F.col("o_orderkey").cast("string"), F.lit(" & "), "o_orderpriority").alias("text"))
    out = reports.export(t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title")), children, fmt)
    return out.select(F.col("id").alias("c_custkey"), "body")


@on_code("d_overview_blocks", """, m AS (SELECT * FROM nodes WHERE kind = 'JavaMethod'), k AS (SELECT dst, count(*) AS c FROM edges WHERE type = 'CALLS' GROUP BY dst)
SELECT 'summary' AS block, 'files' AS item, CAST(count(*) FILTER (kind = 'File') AS DOUBLE) AS value FROM nodes UNION ALL SELECT 'summary', 'functions', count(*) FILTER (kind = 'JavaMethod') FROM nodes UNION ALL SELECT 'summary', 'classes', count(*) FILTER (kind IN ('JavaClass', 'SpringController', 'SpringService', 'Entity')) FROM nodes
UNION ALL SELECT 'summary', 'loc', coalesce(sum(size), 0) FROM nodes UNION ALL SELECT 'kinds', kind, count(*) FROM nodes GROUP BY kind UNION ALL SELECT 'modules', file, count(*) FROM m WHERE file IS NOT NULL GROUP BY file
UNION ALL (SELECT 'hotspots', id, size FROM m WHERE size IS NOT NULL ORDER BY size DESC, id LIMIT 10) UNION ALL SELECT 'complexity', 'mean of hotspots', round(avg(size), 6) FROM (SELECT size FROM m WHERE size IS NOT NULL ORDER BY size DESC, id LIMIT 10)
UNION ALL SELECT 'documentation', 'share', round(avg(CASE WHEN documented THEN 1.0 ELSE 0.0 END), 6) FROM m UNION ALL SELECT 'entry points', kind, count(*) FROM nodes WHERE kind = 'SpringController' GROUP BY kind UNION ALL SELECT 'relations', type, count(*) FROM edges GROUP BY type
UNION ALL (SELECT 'most called', dst, c FROM k ORDER BY c DESC, dst LIMIT 10) UNION ALL SELECT 'data', 'tables', count(*) FROM nodes WHERE kind = 'SQLTable' UNION ALL SELECT 'dead code', 'uncalled', count(*) FROM m WHERE id NOT IN (SELECT dst FROM k)""")
def _(n, e):
    return reports.overview(cut(n, "nodes"), cut(e, "edges"))
