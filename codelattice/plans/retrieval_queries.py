"""Queries of named retrievals, over the graph of code that is made by rule from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.operators import classify, detect, hops, keep, reports, retrieval, search
from codelattice.plans import code_graph, tools
from codelattice.plans.code_queries import pick, sql_pick
from codelattice.plans.table_queries import query as on_tables
from codelattice.sources import files as stores
from codelattice.sources import parsers
from codelattice.streaming import incremental

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (nodes, edges) as a query over the code graph, with its SQL."""
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(code_graph.nodes(spark, sf_dir), code_graph.edges(spark, sf_dir))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = code_graph.with_graph(sql)
        return f

    return add


_CONTROLLED = "s AS (SELECT m.id FROM nodes m JOIN nodes c ON m.parent_id = c.id WHERE m.kind = 'JavaMethod' AND c.name LIKE '%Controller')"
_K = "k AS (SELECT src, dst, min(line) AS line FROM edges WHERE type = 'CALLS' GROUP BY src, dst)"


def _controlled(n: DataFrame) -> DataFrame:
    """The methods of controllers: the entry points here."""
    holders = n.where("name like '%Controller'").select(F.col("id").alias("holder"))
    return n.where("kind = 'JavaMethod'").join(holders, F.col("parent_id") == F.col("holder"), "left_semi")


@query("r4_method_chain", f""", {_CONTROLLED}, {_K}, a AS (SELECT s.id AS seed, k.dst AS id, min(row(k.src, k.line)) AS last FROM s JOIN k ON k.src = s.id WHERE k.dst <> s.id GROUP BY 1, 2),
b AS (SELECT a.seed, k.dst AS id, min(row(k.src, k.line)) AS last FROM a JOIN k ON k.src = a.id WHERE k.dst <> a.seed AND NOT EXISTS (SELECT 1 FROM a x WHERE x.seed = a.seed AND x.id = k.dst) GROUP BY 1, 2),
u AS (SELECT seed, id, 1 AS depth, last FROM a UNION ALL SELECT seed, id, 2, last FROM b)
SELECT u.seed, u.id, n.name, p.name AS parent, u.depth, u.last[1] AS via, u.last[2] AS line FROM u JOIN nodes n ON u.id = n.id LEFT JOIN nodes p ON n.parent_id = p.id""")
def _(n, e):
    return retrieval.method_chain(n, e, _controlled(n), 2)


@query("r12_context_with_beans", f""", {_CONTROLLED}, {_K}, one AS (SELECT DISTINCT k.dst AS id FROM s JOIN k ON k.src = s.id), two AS (SELECT DISTINCT k.dst AS id FROM one JOIN k ON k.src = one.id), three AS (SELECT DISTINCT k.dst AS id FROM two JOIN k ON k.src = two.id),
near AS (SELECT n.* FROM nodes n WHERE n.id IN (SELECT id FROM one UNION SELECT id FROM two)), holders AS (SELECT n.* FROM nodes n WHERE n.id IN (SELECT parent_id FROM near)),
beside AS (SELECT n.* FROM nodes n WHERE n.kind IN ('JavaClass', 'SpringController', 'SpringService', 'Entity') AND n.file IN (SELECT file FROM near)),
u AS (SELECT id, name, 0 AS priority, 'BEAN' AS relationship FROM nodes WHERE lower(name) IN ('unit1service', 'unit3validator') AND kind NOT IN ('JavaMethod', 'File', 'SQLTable')
 UNION ALL SELECT n.id, n.name, 1, 'CALLS_1' FROM nodes n JOIN one USING (id) UNION ALL SELECT n.id, n.name, 2, 'CALLS_2' FROM nodes n JOIN two USING (id) UNION ALL SELECT id, name, 3, 'HOLDER' FROM holders
 UNION ALL SELECT id, name, 4, 'NAME' FROM nodes WHERE contains(lower(name), 'entity') OR contains(lower(name), 'green') UNION ALL SELECT id, name, 5, 'DATA_ACCESS' FROM holders WHERE regexp_matches(lower(name), 'dao|repository')
 UNION ALL SELECT n.id, n.name, 6, 'CALLS_3' FROM nodes n JOIN three USING (id) UNION ALL SELECT id, name, 7, 'VALIDATOR' FROM beside WHERE contains(lower(name), 'validator') UNION ALL SELECT id, name, 8, 'UTILITY' FROM beside WHERE regexp_matches(lower(name), 'util|helper')
 UNION ALL SELECT id, name, 9, 'ENTITY' FROM nodes WHERE kind = 'Entity' AND (contains(lower(name), 'entity') OR contains(lower(name), 'green'))
 UNION ALL SELECT n.id, n.name, 10, 'TABLE' FROM nodes n WHERE n.id IN (SELECT e.dst FROM edges e WHERE e.type = 'USES_TABLE' AND e.src IN (SELECT id FROM holders))),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY priority, id) AS r FROM u) SELECT id, name, priority, relationship FROM r WHERE r = 1""")
def _(n, e):
    beans = n.sparkSession.createDataFrame([("Unit1Service.save",), ("unit3validator.check",), ("nothing",)], "bean string")
    return retrieval.context(n, e, _controlled(n), ["entity", "green"], beans=beans)


@query("d_sql_of_chain", f""", {_CONTROLLED}, {_K}, one AS (SELECT DISTINCT s.id AS seed, k.dst AS id FROM s JOIN k ON k.src = s.id WHERE s.id <> k.dst)
SELECT DISTINCT one.seed, n.parent_id AS holder, e.dst AS "table" FROM one JOIN nodes n ON one.id = n.id JOIN edges e ON e.src = n.parent_id AND e.type = 'USES_TABLE'""")
def _(n, e):
    return retrieval.statements_of_chain(n, e, retrieval.method_chain(n, e, _controlled(n), 1))


@query("d_sql_of_holders", """SELECT n.id, n.name, count(DISTINCT e.dst) AS n_tables, list_sort(list(DISTINCT t.name)) AS tables FROM edges e JOIN nodes n ON e.src = n.id JOIN nodes t ON e.dst = t.id WHERE e.type = 'USES_TABLE' GROUP BY n.id, n.name""")
def _(n, e):
    return retrieval.statements_of_holders(n, e)


for _what, _kinds in (("classes", "'JavaClass', 'SpringController', 'SpringService', 'Entity'"), ("functions", "'JavaMethod'"), ("files", "'File'")):
    query(f"t8_{_what}", f"SELECT id, kind, name, file FROM nodes WHERE kind IN ({_kinds}) ORDER BY id LIMIT 100")(lambda n, e, what=_what: retrieval.query_repository(n, e, what))
for _what, _type in (("call_graph", "CALLS"), ("imports", "IMPORTS")):
    query(f"t8_{_what}", f"SELECT e.src, a.name AS caller, e.dst, b.name AS callee FROM (SELECT * FROM edges WHERE type = '{_type}' ORDER BY src, dst LIMIT 100) e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id")(
        lambda n, e, what=_what: retrieval.query_repository(n, e, what))


@query("t9_structural", "SELECT id, name, 'named' AS relation FROM nodes WHERE (contains(lower(name), 'dao') OR contains(lower(name), 'nation_2')) AND kind IN ('JavaClass', 'SpringController', 'SpringService', 'Entity', 'File') ORDER BY relation, id LIMIT 20")
def _(n, e):
    return retrieval.retrieve(n, e, "structural", ["Dao", "nation_2"])


@query("t9_locational", "SELECT id, name, 'exact' AS relation FROM nodes WHERE lower(name) = 'unit2dao'")
def _(n, e):
    return retrieval.retrieve(n, e, "locational", ["Unit2Dao"])


@query("t9_dependency", """, o AS (SELECT id FROM nodes WHERE contains(lower(name), 'src/nation_1') OR contains(lower(name), 'blue_rod')), u AS (
SELECT src AS id, 'caller' AS relation FROM edges WHERE type = 'CALLS' AND dst IN (SELECT id FROM o) UNION SELECT dst, 'callee' FROM edges WHERE type = 'CALLS' AND src IN (SELECT id FROM o)
UNION SELECT dst, 'import' FROM edges WHERE type = 'IMPORTS' AND src IN (SELECT id FROM o) UNION SELECT src, 'importer' FROM edges WHERE type = 'IMPORTS' AND dst IN (SELECT id FROM o))
SELECT u.id, n.name, u.relation FROM u JOIN nodes n ON u.id = n.id ORDER BY u.relation, u.id LIMIT 40""")
def _(n, e):
    return retrieval.retrieve(n, e, "dependency", ["src/nation_1", "blue_rod"], 40)


@query("t9_keyword", "SELECT id, name, 'keyword' AS relation FROM nodes WHERE contains(lower(name), 'europe') OR contains(lower(name), '9') ORDER BY relation, id LIMIT 20")
def _(n, e):
    return retrieval.retrieve(n, e, "keyword", ["Europe", "9"])


@query("t11_data_flow", """, c AS (SELECT dst AS id, count(*) AS callers FROM edges WHERE type = 'CALLS' GROUP BY dst), o AS (SELECT src AS id, count(*) AS callees FROM edges WHERE type = 'CALLS' GROUP BY src)
SELECT p.id AS holder, count(*) AS methods, CAST(sum(coalesce(c.callers, 0)) AS BIGINT) AS incoming, CAST(sum(coalesce(o.callees, 0)) AS BIGINT) AS outgoing FROM nodes m JOIN nodes p ON m.parent_id = p.id AND m.kind = 'JavaMethod' LEFT JOIN c ON m.id = c.id LEFT JOIN o ON m.id = o.id GROUP BY p.id""")
def _(n, e):
    return retrieval.call_flow(n, e)


@query("t13_entity_details", """, c AS (SELECT dst, count(*) AS c FROM edges WHERE type = 'CALLS' GROUP BY dst), m AS (SELECT h.src AS id, count(*) AS n, list_sort(list(DISTINCT x.name)) AS members, CAST(sum(coalesce(c.c, 0)) AS BIGINT) AS callers FROM edges h JOIN nodes x ON h.dst = x.id LEFT JOIN c ON c.dst = h.dst WHERE h.type = 'HAS_METHOD' GROUP BY h.src)
SELECT n.id, n.name, f.name AS file, coalesce(m.n, 0) AS n_members, coalesce(m.members, []) AS members, coalesce(m.callers, 0) AS n_callers FROM nodes n LEFT JOIN m ON n.id = m.id LEFT JOIN nodes f ON n.file = f.id WHERE n.kind = 'Entity'""")
def _(n, e):
    return retrieval.details(n, e, ("Entity",))


@query("t13_implementation_layers", """SELECT CASE WHEN regexp_matches(lower(name), '(action|controller)$') THEN 'controller' WHEN regexp_matches(lower(name), 'dao|repository') THEN 'data' WHEN regexp_matches(lower(name), 'service|builder|validator') THEN 'service' ELSE 'entity' END AS layer,
count(*) AS n, list_sort(list(DISTINCT name)) AS names FROM nodes WHERE contains(lower(name), 'unit') AND NOT contains(lower(name), 'test') GROUP BY 1""")
def _(n, e):
    return retrieval.implementation_layers(n, ["Unit"])


@query("t14_untested_critical", """, c AS (SELECT dst AS id, count(DISTINCT src) AS callers FROM edges WHERE type = 'CALLS' GROUP BY dst HAVING count(DISTINCT src) >= 5), t AS (SELECT DISTINCT e.dst FROM edges e JOIN nodes n ON e.src = n.id AND e.type = 'CALLS' AND n.size > 45)
SELECT n.id, n.name, c.callers FROM nodes n JOIN c ON n.id = c.id WHERE n.kind = 'JavaMethod' AND n.id NOT IN (SELECT dst FROM t) ORDER BY callers DESC, n.id LIMIT 100""")
def _(n, e):
    """Here methods of over 45 lines are the tests."""
    tests = hops.of_type(e, "CALLS").join(n.where("size > 45").select(F.col("id").alias("src")), "src", "left_semi")
    return retrieval.untested_critical(n, e, tests)


@query("t15_feature_list", """, f AS (SELECT file AS feature, count(*) FILTER (kind = 'JavaMethod') AS methods, count(*) FILTER (kind NOT IN ('JavaMethod', 'File')) AS classes FROM nodes WHERE file IS NOT NULL GROUP BY file), i AS (SELECT src, count(*) AS imports FROM edges WHERE type = 'IMPORTS' GROUP BY src)
SELECT n.name AS feature, f.methods, f.classes, coalesce(i.imports, 0) AS imports FROM f JOIN nodes n ON n.id = f.feature LEFT JOIN i ON i.src = f.feature""")
def _(n, e):
    return retrieval.feature_list(n, e)


@query("t15_search_by_scope", "SELECT 'class' AS scope, id, name FROM nodes WHERE kind IN ('JavaClass', 'SpringController', 'SpringService', 'Entity') AND contains(lower(name), '1') UNION ALL SELECT 'method', id, name FROM nodes WHERE kind = 'JavaMethod' AND contains(lower(name), 'red') UNION ALL SELECT 'table', id, name FROM nodes WHERE kind = 'SQLTable' AND contains(lower(name), 'a')")
def _(n, e):
    return retrieval.search_by_scope(n, {"class": (retrieval.CLASSES, "1"), "method": (retrieval.FUNCTIONS, "red"), "table": (("SQLTable",), "a")})


@query("a26_kind_histogram", "SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def _(n, e):
    return n.groupBy("kind").agg(F.count("*").alias("n"))


@query("a27_stereotype_stats", """SELECT CASE WHEN name LIKE '%Controller' THEN 'Controller' WHEN name LIKE '%Service' THEN 'Service' WHEN name LIKE '%Dao' THEN 'Repository' WHEN name LIKE '%Validator' THEN 'Validator' WHEN name LIKE '%Builder' THEN 'Builder' WHEN name LIKE '%Entity' THEN 'Entity' WHEN name LIKE '%Util' THEN 'Utility' ELSE 'Unknown' END AS stereotype, count(*) AS n
FROM nodes WHERE kind IN ('JavaClass', 'SpringController', 'SpringService', 'Entity') GROUP BY 1""")
def _(n, e):
    none = F.array().cast("array<string>")
    s = classify.stereotype_of(F.col("name"), none, none, none, none)["stereotype"]
    return n.where(F.col("kind").isin(*retrieval.CLASSES)).groupBy(s.alias("stereotype")).agg(F.count("*").alias("n"))


@query("a16_code_statistics", """SELECT count(*) FILTER (kind = 'File') AS files, count(*) FILTER (kind IN ('JavaClass', 'SpringController', 'SpringService', 'Entity')) AS classes, count(*) FILTER (kind = 'JavaMethod') AS methods, count(*) FILTER (kind = 'SpringService') AS services,
count(*) FILTER (kind = 'SpringController') AS controllers, count(*) FILTER (kind = 'Entity') AS entities, count(*) FILTER (regexp_matches(lower(name), 'dao|repository')) AS repositories, count(*) FILTER (kind = 'SQLTable') AS tables, CAST(sum(size) AS BIGINT) AS loc, round(avg(size), 4) AS mean_size,
max(size) AS largest, round(avg(CASE WHEN documented THEN 1.0 ELSE 0.0 END), 6) AS documented, (SELECT count(*) FROM edges WHERE type = 'IMPORTS') AS imports, (SELECT count(*) FROM edges WHERE type = 'CALLS') AS calls FROM nodes""")
def _(n, e):
    """One pass over the nodes and one over the edges."""
    is_ = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    one = n.agg(
        is_("File").alias("files"), is_(*retrieval.CLASSES).alias("classes"), is_(*retrieval.FUNCTIONS).alias("methods"), is_("SpringService").alias("services"), is_("SpringController").alias("controllers"), is_("Entity").alias("entities"),
        F.count_if(F.lower("name").rlike("dao|repository")).alias("repositories"), is_("SQLTable").alias("tables"), F.sum("size").alias("loc"), F.round(F.avg("size"), 4).alias("mean_size"), F.max("size").alias("largest"),
        F.round(reports.ratio(F.col("documented"), 1.0), 6).alias("documented"))
    return one.join(F.broadcast(e.agg(F.count_if(F.col("type") == "IMPORTS").alias("imports"), F.count_if(F.col("type") == "CALLS").alias("calls"))))


@query("s26_delete_repository", "SELECT id FROM nodes WHERE file IS NULL OR file <> 'f:3'")
def _(n, e):
    """One file's nodes stand for a repository: what is left without them."""
    return stores.without(n, "file", "f:3").select("id")


@query("l6_capped_without_order", "SELECT id, name FROM nodes WHERE kind = 'JavaMethod' AND NOT documented ORDER BY id LIMIT 50")
def _(n, e):
    return n.where("kind = 'JavaMethod' and not documented").orderBy("id").limit(50).select("id", "name")


@query("l9_capped_lists", """, k AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM edges WHERE type = 'CALLS') SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS first_callees FROM k WHERE r <= 10 GROUP BY src""")
def _(n, e):
    """The first ten callees of each method: cut before they are collected."""
    first = keep.keep_first(hops.of_type(e, "CALLS").select("src", "dst"), ["src"], [F.col("dst")], 10)
    return first.groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("first_callees"))


@query("g3_rank_fallback", """, d AS (SELECT dst, count(*) AS d FROM edges WHERE type IN ('CALLS', 'IMPORTS') GROUP BY dst) SELECT n.id, coalesce(d.d, 0) AS in_degree FROM nodes n LEFT JOIN d ON n.id = d.dst WHERE n.kind = 'File'""")
def _(n, e):
    """The named strategy does not exist, so the native rank takes its place."""
    from codelattice.operators import ranking

    return ranking.rank(n, e, "graph-library").join(n.where("kind = 'File'").select("id"), "id", "left_semi").select("id", "in_degree")


@query("p2_tools", "SELECT 'nodes_of_kind' AS tool, count(*) AS n FROM nodes WHERE kind = 'File' UNION ALL SELECT 'schema', (SELECT count(DISTINCT kind) FROM nodes) + (SELECT count(DISTINCT type) FROM edges) UNION ALL SELECT 'lookup', count(*) FROM nodes WHERE lower(name) = 'europe'")
def _(n, e):
    call = lambda tool, **x: tools.call_tool(tool, n, e, **x).agg(F.count("*").alias("n")).select(F.lit(tool).alias("tool"), "n")
    return call("nodes_of_kind", kind="File").unionByName(call("schema")).unionByName(call("lookup", name="Europe"))


@query("d_overview_report", """, k AS (SELECT dst AS id, count(*) AS c FROM edges WHERE type = 'CALLS' GROUP BY dst), h AS (SELECT size FROM nodes WHERE kind = 'JavaMethod' ORDER BY size DESC, id LIMIT 10)
SELECT (SELECT count(*) FROM nodes WHERE kind = 'File') AS files, (SELECT count(*) FROM nodes WHERE kind = 'JavaMethod') AS functions, (SELECT count(*) FROM nodes WHERE kind IN ('JavaClass', 'SpringController', 'SpringService', 'Entity')) AS classes, (SELECT CAST(sum(size) AS BIGINT) FROM nodes) AS loc,
(SELECT count(DISTINCT file) FROM nodes WHERE kind = 'JavaMethod') AS modules, (SELECT round(avg(size), 6) FROM h) AS hotspot_mean, (SELECT count(*) FROM nodes WHERE name LIKE '%Controller') AS entry_points, (SELECT count(*) FROM edges WHERE type = 'IMPORTS') AS imports,
(SELECT max(c) FROM k) AS most_called, (SELECT round(avg(CASE WHEN documented THEN 1.0 ELSE 0.0 END), 6) FROM nodes WHERE kind = 'JavaMethod') AS documented, (SELECT count(*) FROM nodes WHERE kind = 'SQLTable') AS tables""")
def _(n, e):
    """Eleven blocks in one row; the mean size is that of the ten largest methods only."""
    is_ = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    method = F.col("kind") == "JavaMethod"
    one = n.agg(is_("File").alias("files"), is_("JavaMethod").alias("functions"), is_(*retrieval.CLASSES).alias("classes"), F.sum("size").alias("loc"), F.count_distinct(F.when(method, F.col("file"))).alias("modules"),
                F.count_if(F.col("name").endswith("Controller")).alias("entry_points"), is_("SQLTable").alias("tables"), F.round(F.avg(F.when(method, F.col("documented").cast("double"))), 6).alias("documented"))
    hot = n.where(method).orderBy(F.col("size").desc_nulls_last(), "id").limit(10).agg(F.round(F.avg("size"), 6).alias("hotspot_mean"))
    calls = hops.of_type(e, "CALLS").groupBy("dst").agg(F.count("*").alias("c")).agg(F.max("c").alias("most_called"))
    return one.join(F.broadcast(hot)).join(F.broadcast(calls)).join(F.broadcast(hops.of_type(e, "IMPORTS").agg(F.count("*").alias("imports"))))


@query("d_readiness_report", """, m AS (SELECT n.*, coalesce(k.c, 0) AS callers FROM nodes n LEFT JOIN (SELECT dst, count(DISTINCT src) AS c FROM edges WHERE type = 'CALLS' GROUP BY dst) k ON n.id = k.dst WHERE n.kind = 'JavaMethod'),
t AS (SELECT avg(CASE WHEN size % 2 = 0 THEN 1.0 ELSE 0.0 END) AS cover, count(*) FILTER (size % 2 = 1 AND callers >= 20) AS crit FROM m), d AS (SELECT avg(CASE WHEN documented THEN 1.0 ELSE 0.0 END) AS every, avg(CASE WHEN callers >= 10 THEN CASE WHEN documented THEN 1.0 ELSE 0.0 END END) AS public,
 count(*) FILTER (callers >= 10 AND NOT documented) AS missing FROM m), s AS (SELECT least(100.0, greatest(0.0, round(t.cover * 100) - least(t.crit * 2, 20)) + 7) AS testing, greatest(0.0, round(round(d.public * 100) * 0.6 + round(d.every * 100) * 0.4) - least(d.missing * 0.5, 15.0)) AS documentation FROM t, d)
SELECT CAST(testing AS DOUBLE) AS testing, CAST(documentation AS DOUBLE) AS documentation, CAST(round((testing + documentation) / 2) AS DOUBLE) AS score, CASE WHEN round((testing + documentation) / 2) >= 90 THEN 'A' WHEN round((testing + documentation) / 2) >= 75 THEN 'B' WHEN round((testing + documentation) / 2) >= 60 THEN 'C'
 WHEN round((testing + documentation) / 2) >= 40 THEN 'D' ELSE 'F' END AS grade, round((testing + documentation) / 2) >= 75 AS ready FROM s""")
def _(n, e):
    """Methods of even size count as tested, those with ten callers as public, those with twenty as critical."""
    callers = hops.of_type(e, "CALLS").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers"))
    m = n.where("kind = 'JavaMethod'").join(callers, "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    tested, public = F.col("size") % 2 == 0, F.col("callers") >= 10
    g = m.agg(F.avg(tested.cast("double")).alias("cover"), F.count_if(~tested & (F.col("callers") >= 20)).alias("crit"), F.avg(F.col("documented").cast("double")).alias("every"),
              F.avg(F.when(public, F.col("documented").cast("double"))).alias("public"), F.count_if(public & ~F.col("documented")).alias("missing"))
    testing = reports.testing_score(F.col("cover"), F.col("crit"), F.lit(True), F.lit(True), F.lit(False))["score"]
    documentation = reports.documentation_score(F.col("public"), F.col("every"), F.col("missing"))["score"]
    s = g.select(testing.cast("double").alias("testing"), documentation.cast("double").alias("documentation"))
    r = reports.readiness(F.col("testing"), F.col("documentation"))
    return s.select("testing", "documentation", r["score"].cast("double").alias("score"), r["grade"].alias("grade"), r["ready"].alias("ready"))


# On the tables

_RULES = ("ValidationConstraint", "GuardClause", "ConditionalBusinessLogic", "TestAssertion", "Formula")


@on_tables("t10_evidence_lookup", f"""WITH r AS (SELECT p_partkey AS id, {sql_pick(_RULES)} AS k, p_type AS text FROM part) SELECT id, CASE WHEN k = 'Formula' THEN 'generic' ELSE k END AS kind, text,
CAST(CASE k WHEN 'ValidationConstraint' THEN 0.95 WHEN 'GuardClause' THEN 0.9 WHEN 'ConditionalBusinessLogic' THEN 1.0 WHEN 'TestAssertion' THEN 0.85 ELSE 0.5 END AS DOUBLE) AS weight FROM r WHERE contains(lower(text), 'promo')""")
def _(t):
    return retrieval.evidence(t("part").select(F.col("p_partkey").alias("id"), pick(_RULES).alias("kind"), F.col("p_type").alias("text")), "PROMO")


@on_tables("t6_lookup_with_suggestions", """WITH q AS (SELECT DISTINCT p_brand AS question, lower(split_part(p_type, ' ', 1)) AS w FROM part), m AS (SELECT DISTINCT lower(p_type) AS id FROM part),
s AS (SELECT q.question, m.id, count(*) / 6.0 AS score FROM q JOIN m ON contains(m.id, q.w) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS r FROM s)
SELECT question, id, round(score, 6) AS score, CASE WHEN r = 1 AND score > 0.1 THEN 'match' ELSE 'suggestion' END AS role FROM k WHERE r <= 6""")
def _(t):
    """Each brand asks for the first words of its types; a type scores a sixth for each of the words that it has."""
    q = t("part").select(F.col("p_brand").alias("question"), F.lower(F.split("p_type", " ")[0]).alias("w")).distinct()
    menu = t("part").select(F.lower("p_type").alias("id")).distinct()
    words = menu.select("id", F.explode(F.array_distinct(F.split("id", " "))).alias("w"))
    scored = q.join(words, "w").groupBy("question", "id").agg((F.count("*") / 6.0).alias("score"))
    return retrieval.lookup(scored, 0.1).select("question", "id", F.round("score", 6).alias("score"), "role")


_BUNDLES = ("a=1\\\n  2\nb : x\n# c=3\n", "key\\ one = v\\:w\n! note\n\nlast=", "plain", "a=1\na=2\\\n\\\n3")
_PAIRS = ("a=12;b=x", "key one=v:w;last=", "", "a=1;a=23")


@on_tables("w10_line_continuations", f"WITH x AS (SELECT p_partkey, {sql_pick(_PAIRS)} AS pairs FROM part) SELECT * FROM x WHERE pairs <> ''")
def _(t):
    files = t("part").select(F.col("p_partkey").alias("path"), pick(_BUNDLES).alias("text"))
    found = parsers.properties(files).groupBy(F.col("path").alias("p_partkey")).agg(F.array_sort(F.collect_list(F.concat("key", F.lit("="), "value"))).alias("x"))
    return found.select("p_partkey", F.array_join("x", ";").alias("pairs"))


_TEST_NAMES = ("a/UserTest.java", "src/test/java/X.java", "b.test.ts", "test/b.ts", "test/test_x.py", "lib/tests/x.py", "x_test.go", "A.Tests/Y.cs", "YSpec.cs", "test_a.cpp", "main.c")
_TEST_KINDS = ("JUnit", "JUnit", "Jest", "Mocha", "pytest", "pytest", "Go testing", "xUnit", "NUnit", "GoogleTest", "none")


@on_tables("w6_highest_priority", f"SELECT p_partkey, {sql_pick(_TEST_KINDS)} AS framework FROM part")
def _(t):
    return t("part").select("p_partkey", F.coalesce(detect.test_framework(pick(_TEST_NAMES), F.lit("")), F.lit("none")).alias("framework"))


@on_tables("x2_verified_changes", """WITH o AS (SELECT doc_id AS path, md5(text) AS h FROM documents WHERE length(text) % 7 <> 0), n AS (SELECT doc_id AS path, CASE WHEN length(text) % 5 = 0 THEN md5(text || '!') ELSE md5(text) END AS h FROM documents WHERE length(text) % 11 <> 0),
c AS (SELECT doc_id AS path FROM documents WHERE length(text) % 2 = 0)
SELECT c.path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'added' ELSE 'modified' END AS change FROM c LEFT JOIN o ON c.path = o.path LEFT JOIN n ON c.path = n.path WHERE (n.path IS NULL AND o.path IS NOT NULL) OR (o.path IS NULL AND n.path IS NOT NULL) OR o.h <> n.h""")
def _(t):
    """A list of changed paths is held against both snapshots' hashes: what did not change drops out."""
    d = t("documents").select(F.col("doc_id").alias("path"), "text", F.length("text").alias("n"))
    old = d.where("n % 7 <> 0").select("path", F.md5("text").alias("content_hash"))
    new = d.where("n % 11 <> 0").select("path", F.md5(F.when(F.col("n") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    return incremental.verify_changes(d.where("n % 2 = 0").select("path", F.lit("M").alias("status"), F.lit(None).cast("long").alias("old_path")), old, new)


@on_tables("x4_cleanup_deleted", """WITH g AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM g))
SELECT 'node' AS what, count(*) AS n FROM o UNION ALL SELECT 'edge', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)""")
def _(t):
    """Orders stand for nodes of files and their lines for edges, customers with a debt for deleted files."""
    nodes = t("orders").select(F.col("o_orderkey").alias("entity_id"), F.col("o_custkey").alias("file_path"))
    edges = t("lineitem").select(F.col("l_orderkey").alias("src"), F.lit(-1).cast("long").alias("dst"))
    kept, left = incremental.delete_files(nodes, edges, t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("path")))
    n = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return n(kept, "node").unionByName(n(left, "edge"))


@on_tables("t5_question_terms", r"""WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark), f AS (SELECT term, count(DISTINCT item_id) AS items FROM q GROUP BY term) SELECT term, items FROM f WHERE items > 1""")
def _(t):
    index = search.inverted_index(t("benchmark"), "item_id")
    return index.groupBy("term").agg(F.count("*").alias("items")).where("items > 1")
