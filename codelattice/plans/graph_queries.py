"""Queries on the sample graph: hops, joins, traversals, ranking, aggregates over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.operators import hops, keep, links, ranking, search, smells, traversal
from codelattice.operators.lineage import cut
from codelattice.plans.sample_graph import edges, nodes, with_graph

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (nodes, edges) as a query over the sample graph, with its SQL."""
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(nodes(spark, sf_dir), edges(spark, sf_dir))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_graph(sql, recursive="RECURSIVE" in sql).replace("/*RECURSIVE*/", "")
        return f

    return add


# Filters

@query("f1_label_disjunction", "SELECT id, kind, name FROM nodes WHERE kind = 'Nation' OR kind = 'Region'")
def _(n, e):
    return hops.of_kind(n, "Nation", "Region").select("id", "kind", "name")


@query("f2_lookup_by_key", "SELECT id, kind, name FROM nodes WHERE id = 'c:7'")
def _(n, e):
    return n.where(F.col("id") == "c:7").select("id", "kind", "name")


@query("f3_contains_ignoring_case", "SELECT id, name FROM nodes WHERE contains(lower(name), lower('An'))")
def _(n, e):
    return n.where(F.contains(F.lower("name"), F.lower(F.lit("An")))).select("id", "name")


@query("f4_starts_ends_with", "SELECT id, name FROM nodes WHERE name LIKE 'A%' OR name LIKE '%9'")
def _(n, e):
    return n.where(F.col("name").startswith("A") | F.col("name").endswith("9")).select("id", "name")


@query("f5_full_match_regex", "SELECT id, name FROM nodes WHERE regexp_full_match(name, '(?i).*er.*[0-4]')")
def _(n, e):
    return n.where(F.col("name").rlike("^(?i)(?:.*er.*[0-4])$")).select("id", "name")


@query("f6_in_list", "SELECT id, name FROM nodes WHERE id IN ('n:1', 'n:2', 'r:0', 'x:1')")
def _(n, e):
    return n.where(F.col("id").isin("n:1", "n:2", "r:0", "x:1")).select("id", "name")


@query("f7_null_and_coalesce", "SELECT id, coalesce(parent_id, 'root') AS parent FROM nodes WHERE parent_id IS NULL OR kind = 'Nation'")
def _(n, e):
    return n.where(F.col("parent_id").isNull() | (F.col("kind") == "Nation")).select("id", F.coalesce("parent_id", F.lit("root")).alias("parent"))


@query("f8_numeric_threshold", "SELECT id, weight FROM nodes WHERE weight > 300000 OR weight < -900")
def _(n, e):
    return n.where((F.col("weight") > 300000) | (F.col("weight") < -900)).select("id", "weight")


@query("f9_node_inequality", "SELECT a.dst AS id, count(*) AS n FROM edges a JOIN edges b ON a.dst = b.dst AND a.src <> b.src AND a.type = 'CALLS' AND b.type = 'CALLS' GROUP BY a.dst")
def _(n, e):
    # Ordered pairs of different callers, counted without making the pairs.
    calls = hops.of_type(e, "CALLS").select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("c"))
    return calls.where("c > 1").select(F.col("dst").alias("id"), (F.col("c") * (F.col("c") - 1)).alias("n"))


@query("f10_edge_type_filter", "SELECT type, count(*) AS n FROM edges WHERE type IN ('CALLS', 'USES') GROUP BY type")
def _(n, e):
    return hops.of_type(e, "CALLS", "USES").groupBy("type").agg(F.count("*").alias("n"))


@query("f11_all_edges_on_path", """, t AS (SELECT src, dst FROM edges WHERE type IN ('BELONGS_TO', 'CALLS'))
SELECT DISTINCT a.src AS seed, c.dst AS id FROM t a JOIN t b ON a.dst = b.src JOIN t c ON b.dst = c.src""")
def _(n, e):
    return traversal.reach(e, n, 3, 3, types=("BELONGS_TO", "CALLS"))


@query("f12_case_classification", "SELECT id, CASE WHEN kind IN ('Region', 'Nation') THEN 'place' WHEN kind IN ('Customer', 'Supplier') THEN 'party' ELSE 'item' END AS layer FROM nodes")
def _(n, e):
    return n.select("id", F.when(F.col("kind").isin("Region", "Nation"), "place").when(F.col("kind").isin("Customer", "Supplier"), "party").otherwise("item").alias("layer"))


@query("f13_map_projection", "SELECT id, struct_extract(struct_pack(name := name, kind := kind), 'name') AS name, struct_extract(struct_pack(name := name, kind := kind), 'kind') AS kind FROM nodes WHERE kind = 'Nation'")
def _(n, e):
    return hops.of_kind(n, "Nation").select("id", F.struct("name", "kind").alias("m")).select("id", "m.name", "m.kind")


@query("f14_distinct", "SELECT DISTINCT a.kind AS source_kind, e.type, b.kind AS target_kind FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id")
def _(n, e):
    a = n.select(F.col("id").alias("src"), F.col("kind").alias("source_kind"))
    b = n.select(F.col("id").alias("dst"), F.col("kind").alias("target_kind"))
    return e.join(a, "src").join(b, "dst").select("source_kind", "type", "target_kind").distinct()


@query("f18_relevance_floor", """, s AS (SELECT id, least(1.0, abs(weight) / 10000.0) AS score FROM nodes WHERE kind = 'Customer'),
k AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM s)
SELECT id, score FROM k WHERE r <= 100 AND (score >= 0.5 OR r <= 5)""")
def _(n, e):
    scored = hops.of_kind(n, "Customer").select("id", F.least(F.lit(1.0), F.abs("weight") / 10000.0).alias("score"))
    return keep.relevance_floor(scored)


# Joins

@query("j1_one_hop", "SELECT a.id AS a_id, b.id AS b_id, b.name AS b_name FROM nodes a JOIN edges e ON e.src = a.id AND e.type = 'BELONGS_TO' JOIN nodes b ON e.dst = b.id WHERE a.kind = 'Supplier'")
def _(n, e):
    return hops.hop(hops.prefixed(hops.of_kind(n, "Supplier"), "a"), e, n, types=("BELONGS_TO",)).select("a_id", "b_id", "b_name")


@query("j2_chain_of_hops", """SELECT a.id AS order_id, b.name AS customer, c.name AS nation, d.name AS region FROM nodes a
JOIN edges e ON e.src = a.id AND e.type = 'CALLS' JOIN nodes b ON e.dst = b.id JOIN edges f ON f.src = b.id AND f.type = 'BELONGS_TO' JOIN nodes c ON f.dst = c.id
JOIN edges g ON g.src = c.id AND g.type = 'BELONGS_TO' JOIN nodes d ON g.dst = d.id""")
def _(n, e):
    x = hops.hop(hops.prefixed(hops.of_kind(n, "Order"), "a"), e, n, types=("CALLS",), on="a_id", prefix="b")
    x = hops.hop(x, e, n, types=("BELONGS_TO",), on="b_id", prefix="c")
    x = hops.hop(x, e, n, types=("BELONGS_TO",), on="c_id", prefix="d")
    return x.select(F.col("a_id").alias("order_id"), F.col("b_name").alias("customer"), F.col("c_name").alias("nation"), F.col("d_name").alias("region"))


@query("j3_optional_match", """SELECT a.id AS a_id, count(b.id) AS n FROM nodes a LEFT JOIN (SELECT e.dst, o.id FROM edges e JOIN nodes o ON e.src = o.id AND o.weight > 200000 WHERE e.type = 'CALLS') b ON b.dst = a.id
WHERE a.kind = 'Customer' GROUP BY a.id""")
def _(n, e):
    back = e.select("type", F.col("dst").alias("src"), F.col("src").alias("dst"))
    x = hops.hop(hops.prefixed(hops.of_kind(n, "Customer"), "a"), back, n, types=("CALLS",), how="left", where=F.col("b_weight") > 200000)
    return x.groupBy("a_id").agg(F.count("b_id").alias("n"))


@query("j4_undirected", """, u AS (SELECT src, dst FROM edges WHERE type = 'BELONGS_TO' UNION ALL SELECT dst, src FROM edges WHERE type = 'BELONGS_TO')
SELECT a.id AS a_id, count(*) AS n FROM nodes a JOIN u ON u.src = a.id WHERE a.kind = 'Nation' GROUP BY a.id""")
def _(n, e):
    return hops.hop(hops.prefixed(hops.of_kind(n, "Nation"), "a"), e, n, types=("BELONGS_TO",), both_ways=True).groupBy("a_id").agg(F.count("*").alias("n"))


@query("j5_exists", "SELECT id, name FROM nodes a WHERE kind = 'Customer' AND EXISTS (SELECT 1 FROM edges e WHERE e.dst = a.id AND e.type = 'CALLS')")
def _(n, e):
    return hops.having(hops.of_kind(n, "Customer"), e, ("CALLS",), incoming=True).select("id", "name")


@query("j6_not_exists", """, c AS (SELECT DISTINCT dst FROM edges WHERE type = 'CALLS'), u AS (SELECT DISTINCT dst FROM edges WHERE type = 'USES')
SELECT a.id, a.name FROM nodes a LEFT JOIN c ON a.id = c.dst LEFT JOIN u ON a.id = u.dst WHERE a.kind IN ('Customer', 'Supplier', 'Nation') AND c.dst IS NULL AND u.dst IS NULL""")
def _(n, e):
    left = hops.having(hops.of_kind(n, "Customer", "Supplier", "Nation"), e, ("CALLS",), incoming=True, negate=True)
    return hops.having(left, e, ("USES",), incoming=True, negate=True).select("id", "name")


@query("j7_substring_join", """SELECT p.id, count(*) AS n FROM nodes p JOIN (SELECT DISTINCT left(lower(name), 3) AS w FROM nodes WHERE kind = 'Nation') r ON contains(lower(p.name), r.w) WHERE p.kind IN ('Part', 'Region', 'Nation') GROUP BY p.id""")
def _(n, e):
    needles = hops.of_kind(n, "Nation").select(F.left(F.lower("name"), F.lit(3)).alias("w")).distinct()
    return links.containing(hops.of_kind(n, "Part", "Region", "Nation").select("id", F.lower("name").alias("text")), needles, 3).groupBy("id").agg(F.count("*").alias("n"))


@query("j8_name_equality", "SELECT a.id AS a_id, b.id AS b_id FROM nodes a JOIN nodes b ON lower(replace(a.name, 'Customer', 'Supplier')) = lower(b.name) WHERE a.kind = 'Customer' AND b.kind = 'Supplier'")
def _(n, e):
    a = hops.of_kind(n, "Customer").select(F.col("id").alias("a_id"), F.lower(F.replace("name", F.lit("Customer"), F.lit("Supplier"))).alias("k"))
    b = hops.of_kind(n, "Supplier").select(F.col("id").alias("b_id"), F.lower("name").alias("k"))
    return a.join(b, "k").select("a_id", "b_id")


@query("j10_shared_dimension", """, l AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'DEPENDS_ON'), c AS (SELECT dst, count(*) AS c FROM l GROUP BY dst)
SELECT dst AS shared, c * (c - 1) AS n FROM c WHERE c > 1""")
def _(n, e):
    """Ordered pairs of different users of each supplier, counted from the users, never made."""
    c = hops.of_type(e, "DEPENDS_ON").select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("c"))
    return c.where("c > 1").select(F.col("dst").alias("shared"), (F.col("c") * (F.col("c") - 1)).alias("n"))


@query("j11_pairs_in_group", """, l AS (SELECT DISTINCT b.parent_id AS nation, s.src AS part FROM edges s JOIN nodes b ON s.dst = b.id WHERE s.type = 'DEPENDS_ON')
SELECT a.nation AS a, b.nation AS b, count(*) AS n_shared FROM l a JOIN l b ON a.part = b.part AND a.nation < b.nation GROUP BY a.nation, b.nation""")
def _(n, e):
    links = hops.of_type(e, "DEPENDS_ON").join(n.select(F.col("id").alias("dst"), F.col("parent_id").alias("nation")), "dst").select("nation", F.col("src").alias("part"))
    return hops.shared_dimension_pairs(links, "nation", "part")


@query("j12_neighbourhood", """, u AS (SELECT src AS id, 'out' AS direction, type, dst AS other FROM edges UNION ALL SELECT dst, 'in', type, src FROM edges)
SELECT u.id, u.direction, u.type, count(*) AS n, list_sort(list(DISTINCT b.name)) AS names FROM u JOIN nodes b ON u.other = b.id WHERE u.id IN (SELECT id FROM nodes WHERE kind = 'Supplier') GROUP BY ALL""")
def _(n, e):
    return hops.neighbourhood(n, e, hops.of_kind(n, "Supplier").select("id"))


@query("j17_shared_usage", """SELECT e.dst AS id, count(DISTINCT e.src) AS users FROM edges e WHERE e.type IN ('CALLS', 'USES', 'DEPENDS_ON') GROUP BY e.dst HAVING count(DISTINCT e.src) > 1""")
def _(n, e):
    return hops.of_type(e, "CALLS", "USES", "DEPENDS_ON").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("users")).where("users > 1")


@query("j20_staged_optional_joins", """, c AS (SELECT dst AS cust, count(*) AS n_orders FROM edges WHERE type = 'CALLS' GROUP BY dst),
u AS (SELECT x.dst AS cust, count(DISTINCT y.dst) AS n_parts FROM edges x JOIN edges y ON x.src = y.src AND y.type = 'USES' WHERE x.type = 'CALLS' GROUP BY x.dst)
SELECT a.id, coalesce(c.n_orders, 0) AS n_orders, coalesce(u.n_parts, 0) AS n_parts FROM nodes a LEFT JOIN c ON a.id = c.cust LEFT JOIN u ON a.id = u.cust WHERE a.kind = 'Customer'""")
def _(n, e):
    calls = hops.of_type(e, "CALLS").select("src", F.col("dst").alias("cust"))
    orders = calls.groupBy("cust").agg(F.count("*").alias("n_orders"))
    parts = calls.join(hops.of_type(e, "USES").select("src", F.col("dst").alias("part")), "src").groupBy("cust").agg(F.count_distinct("part").alias("n_parts"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = hops.of_kind(n, "Customer").select("id").join(orders, F.col("id") == orders["cust"], "left").drop("cust")
    return out.join(parts, F.col("id") == parts["cust"], "left").select("id", zero("n_orders"), zero("n_parts"))


@query("j21_first_of_each_stage", """, f AS (SELECT dst AS cust, min(src) AS first_order FROM edges WHERE type = 'CALLS' GROUP BY dst), p AS (SELECT src, min(dst) AS first_part FROM edges WHERE type = 'USES' GROUP BY src)
SELECT a.id, f.first_order, p.first_part FROM nodes a LEFT JOIN f ON a.id = f.cust LEFT JOIN p ON f.first_order = p.src WHERE a.kind = 'Customer'""")
def _(n, e):
    first = hops.of_type(e, "CALLS").groupBy(F.col("dst").alias("cust")).agg(F.min("src").alias("first_order"))
    part = hops.of_type(e, "USES").groupBy(F.col("src").alias("o")).agg(F.min("dst").alias("first_part"))
    out = hops.of_kind(n, "Customer").select("id").join(first, F.col("id") == F.col("cust"), "left")
    return out.join(part, F.col("first_order") == F.col("o"), "left").select("id", "first_order", "first_part")


# Traversals

@query("r1_reach_1_3", """, s AS (SELECT id FROM nodes WHERE kind = 'Customer'),
a AS (SELECT DISTINCT s.id AS seed, e.dst AS id FROM s JOIN edges e ON e.src = s.id), b AS (SELECT DISTINCT a.seed, e.dst AS id FROM a JOIN edges e ON e.src = a.id), c AS (SELECT DISTINCT b.seed, e.dst AS id FROM b JOIN edges e ON e.src = b.id)
SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c""")
def _(n, e):
    return traversal.reach(e, hops.of_kind(n, "Customer"), 1, 3)


@query("r1_walk_counts", """, s AS (SELECT id FROM nodes WHERE kind = 'Order'), a AS (SELECT s.id AS seed, e.dst AS id FROM s JOIN edges e ON e.src = s.id), b AS (SELECT a.seed, e.dst AS id FROM a JOIN edges e ON e.src = a.id)
SELECT seed, id, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY seed, id""")
def _(n, e):
    return traversal.count_walks(e, hops.of_kind(n, "Order"), 1, 2)


@query("r2_min_depth", """, a AS (SELECT id, 0 AS depth FROM nodes WHERE kind = 'Order'), b AS (SELECT DISTINCT e.dst AS id, 1 AS depth FROM edges e JOIN a ON e.src = a.id), c AS (SELECT DISTINCT e.dst AS id, 2 AS depth FROM edges e JOIN b ON e.src = b.id),
d AS (SELECT DISTINCT e.dst AS id, 3 AS depth FROM edges e JOIN c ON e.src = c.id), x AS (SELECT DISTINCT e.dst AS id, 4 AS depth FROM edges e JOIN d ON e.src = d.id)
SELECT id, min(depth) AS depth, greatest(0, 100 - 10 * min(depth)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d UNION ALL SELECT * FROM x) GROUP BY id""")
def _(n, e):
    """Depth from all entry points together: here every order is one."""
    found = traversal.depths(e, hops.of_kind(n, "Order"), 10)
    return found.select("id", "depth", F.greatest(F.lit(0), 100 - 10 * F.col("depth")).alias("score"))


@query("r3_call_chain_layers", """, z AS (SELECT dst AS id, min(src) AS via FROM edges WHERE src = 'o:3' GROUP BY dst), y AS (SELECT e.dst AS id, min(e.src) AS via FROM edges e JOIN z ON e.src = z.id GROUP BY e.dst),
c AS (SELECT 'o:3' AS id, 0 AS depth, CAST(NULL AS VARCHAR) AS via UNION ALL SELECT id, 1, via FROM z UNION ALL SELECT id, 2, via FROM y WHERE id NOT IN (SELECT id FROM z))
SELECT c.id, c.depth, c.via, CASE WHEN n.kind = 'Order' THEN 'Controller' WHEN n.kind IN ('Customer', 'Part') THEN 'Service' ELSE 'DAO' END AS layer FROM c JOIN nodes n ON c.id = n.id""")
def _(n, e):
    chain = traversal.call_chain(e, n.where("id = 'o:3'"), 2).drop("seed")
    named = chain.join(n.select("id", "kind"), "id")
    return named.select("id", "depth", "via", F.when(F.col("kind") == "Order", "Controller").when(F.col("kind").isin("Customer", "Part"), "Service").otherwise("DAO").alias("layer"))


@query("r5_upstream_callers", """, a AS (SELECT DISTINCT src AS id FROM edges WHERE dst = 'n:3'), b AS (SELECT DISTINCT e.src AS id FROM edges e JOIN a ON e.dst = a.id)
SELECT id, min(depth) AS depth FROM (SELECT 'n:3' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM a UNION ALL SELECT id, 2 FROM b) GROUP BY id""")
def _(n, e):
    return traversal.depths(e, n.where("id = 'n:3'"), 2, reverse=True)


@query("r6_callers_ranked", """, t AS (SELECT dst AS id, count(*) AS d FROM edges WHERE type IN ('CALLS', 'DEPENDS_ON') GROUP BY dst), a AS (SELECT DISTINCT src AS id, 1 AS depth FROM edges WHERE dst = 's:5'), b AS (SELECT DISTINCT e.src AS id, 2 AS depth FROM edges e JOIN a ON e.dst = a.id),
c AS (SELECT id, min(depth) AS depth FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id)
SELECT c.id, c.depth, coalesce(t.d, 0) AS in_degree FROM c LEFT JOIN t ON c.id = t.id ORDER BY c.depth, in_degree DESC, c.id LIMIT 150""")
def _(n, e):
    callers = traversal.depths(e, n.where("id = 's:5'"), 2, reverse=True).where("depth > 0")
    degree = hops.of_type(e, "CALLS", "DEPENDS_ON").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("d"))
    out = callers.join(degree, "id", "left").select("id", "depth", F.coalesce("d", F.lit(0).cast("long")).alias("in_degree"))
    return out.orderBy("depth", F.desc("in_degree"), "id").limit(150)


@query("r7_seed_expansion", """, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), a AS (SELECT DISTINCT n.id AS seed, u.dst AS id FROM nodes n JOIN u ON u.src = n.id WHERE n.kind = 'Region'),
b AS (SELECT DISTINCT a.seed, u.dst AS id FROM a JOIN u ON u.src = a.id), c AS (SELECT * FROM a UNION SELECT * FROM b),
k AS (SELECT c.seed, c.id, row_number() OVER (PARTITION BY c.seed ORDER BY n.weight DESC, c.id) AS r FROM c JOIN nodes n ON c.id = n.id)
SELECT seed, id FROM k WHERE r <= 500""")
def _(n, e):
    found = traversal.reach(e, hops.of_kind(n, "Region"), 1, 2, both_ways=True).join(n.select("id", "weight"), "id")
    return keep.keep_first(found, ["seed"], [F.col("weight").desc(), F.col("id")], 500).select("seed", "id")


@query("r8_path_arrays", """, a AS (SELECT n.id AS seed, e.dst AS id, list_value(n.id, e.dst) AS nodes, list_value(e.type) AS types FROM nodes n JOIN edges e ON e.src = n.id WHERE n.kind = 'Order'),
b AS (SELECT a.seed, e.dst AS id, list_append(a.nodes, e.dst) AS nodes, list_append(a.types, e.type) AS types FROM a JOIN edges e ON e.src = a.id)
SELECT seed, id, array_to_string(nodes, '>') AS nodes, array_to_string(types, '>') AS types FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def _(n, e):
    return traversal.paths(e, hops.of_kind(n, "Order"), 2).select("seed", "id", F.col("node_text").alias("nodes"), F.col("type_text").alias("types"))


@query("r9_flow_graph_edges", """, s AS (SELECT 'o:' || o_orderkey AS id FROM orders WHERE o_orderkey % 20 = 0), a AS (SELECT DISTINCT e.dst AS id FROM s JOIN edges e ON e.src = s.id), b AS (SELECT DISTINCT e.dst AS id FROM a JOIN edges e ON e.src = a.id),
r AS (SELECT * FROM s UNION SELECT * FROM a UNION SELECT * FROM b) SELECT DISTINCT e.type, e.src, e.dst FROM edges e JOIN r ON e.src = r.id""")
def _(n, e):
    near = traversal.reach(e, n.where("kind = 'Order' and cast(substr(id, 3) as bigint) % 20 = 0"), 0, 2).select(F.col("id").alias("src")).distinct()
    return e.join(near, "src", "left_semi").distinct().select("type", "src", "dst")


@query("r10_impact_level", """, a AS (SELECT DISTINCT dst AS seed, src AS id FROM edges), b AS (SELECT DISTINCT a.seed, e.src AS id FROM a JOIN edges e ON e.dst = a.id), c AS (SELECT DISTINCT b.seed, e.src AS id FROM b JOIN edges e ON e.dst = b.id),
r AS (SELECT seed, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c) GROUP BY seed)
SELECT n.id, coalesce(r.n, 0) AS reached, CASE WHEN coalesce(r.n, 0) = 0 THEN 'none' WHEN r.n <= 2 THEN 'low' WHEN r.n <= 5 THEN 'medium' WHEN r.n <= 10 THEN 'high' ELSE 'critical' END AS level FROM nodes n LEFT JOIN r ON n.id = r.seed WHERE n.kind IN ('Customer', 'Part', 'Nation')""")
def _(n, e):
    """Who depends on a node, over three hops of any type against the edges."""
    some = hops.of_kind(n, "Customer", "Part", "Nation")
    back = e.select("type", F.col("dst").alias("src"), F.col("src").alias("dst"))
    count = traversal.count_reached(back, some, 3).withColumnRenamed("n", "c")
    k = F.coalesce("c", F.lit(0).cast("long"))
    level = F.when(k == 0, "none").when(k <= 2, "low").when(k <= 5, "medium").when(k <= 10, "high").otherwise("critical")
    return some.join(count, F.col("id") == F.col("seed"), "left").select("id", k.alias("reached"), level.alias("level"))


@query("r11_context_by_priority", """, a AS (SELECT DISTINCT e.dst AS id, 1 AS priority FROM edges e WHERE e.src = 'o:5'), b AS (SELECT DISTINCT e.dst AS id, 2 AS priority FROM edges e JOIN a ON e.src = a.id),
c AS (SELECT id, 3 AS priority FROM nodes WHERE kind = 'Nation'), k AS (SELECT u.id, n.name, u.priority, row_number() OVER (PARTITION BY n.name ORDER BY u.priority, u.id) AS r FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) u JOIN nodes n ON u.id = n.id)
SELECT id, name, priority FROM k WHERE r = 1""")
def _(n, e):
    seed = n.where("id = 'o:5'")
    one, two = (traversal.reach(e, seed, k, k).select("id", F.lit(k).alias("priority")) for k in (1, 2))
    every = one.unionByName(two).unionByName(hops.of_kind(n, "Nation").select("id", F.lit(3).alias("priority"))).join(n.select("id", "name"), "id")
    return keep.keep_first(every, ["name"], [F.col("priority"), F.col("id")]).select("id", "name", "priority")


@query("r13_feature_trace", """, u AS (SELECT DISTINCT c.dst AS customer, u.dst AS part FROM edges c JOIN edges u ON u.src = c.src AND u.type = 'USES' WHERE c.type = 'CALLS'),
o AS (SELECT c.dst AS customer, count(DISTINCT c.src) AS n_orders FROM edges c WHERE c.type = 'CALLS' AND c.src IN (SELECT src FROM edges WHERE type = 'USES') GROUP BY c.dst),
d AS (SELECT u.customer, count(DISTINCT u.part) AS n_parts, count(DISTINCT e.dst) AS n_suppliers FROM u JOIN edges e ON e.src = u.part AND e.type = 'DEPENDS_ON' GROUP BY u.customer)
SELECT o.customer, o.n_orders, d.n_parts, d.n_suppliers FROM o JOIN d ON o.customer = d.customer""")
def _(n, e):
    """Orders of a customer that use parts, those parts, and the suppliers that they depend on. Suppliers travel as
    one list of numbers a part to where all parts of a customer are."""
    calls = hops.of_type(e, "CALLS").select(F.col("dst").alias("customer"), F.col("src").alias("o"))
    uses = hops.of_type(e, "USES").select(F.col("src").alias("o"), F.col("dst").alias("part"))
    suppliers = hops.number_lists(hops.of_type(e, "DEPENDS_ON"))
    bought = cut(calls.join(uses, "o"), "bought")
    orders = bought.groupBy("customer").agg(F.count_distinct("o").alias("n_orders"))
    used = cut(bought.select("customer", "part").distinct().join(suppliers.select(F.col("at").alias("part")).distinct(), "part", "left_semi"), "used")
    parts = used.groupBy("customer").agg(F.count("*").alias("n_parts"))
    wide = used.join(suppliers, F.col("part") == F.col("at")).select("customer", "first", "near", "far", "n_ends")
    found = hops.dealt_numbers(wide, "customer", "s").groupBy("customer", "s").agg(F.lit(1).alias("_one")).groupBy("customer").agg(F.count("s").alias("n_suppliers"))
    return orders.join(parts, "customer").join(found, "customer", "left").select("customer", "n_orders", "n_parts", F.coalesce("n_suppliers", F.lit(0).cast("long")).alias("n_suppliers"))


@query("r16_breadcrumbs", """, a AS (SELECT id, name, parent_id FROM nodes)
SELECT c.id, 2 AS depth, r.name || ' > ' || n.name || ' > ' || c.name AS trail FROM a c JOIN a n ON c.parent_id = n.id JOIN a r ON n.parent_id = r.id WHERE c.id LIKE 'c:%' OR c.id LIKE 's:%'""")
def _(n, e):
    found = traversal.ancestors(n.where("kind <> 'Order' and kind <> 'Part'"), 3)
    return found.where("id like 'c:%' or id like 's:%'").select("id", "depth", F.array_join("path", " > ").alias("trail"))


@query("r17_tree", """SELECT n.id, n.name, CASE n.kind WHEN 'Region' THEN 0 WHEN 'Nation' THEN 1 ELSE 2 END AS depth, CASE n.kind WHEN 'Region' THEN n.id WHEN 'Nation' THEN n.parent_id || '/' || n.id ELSE p.parent_id || '/' || n.parent_id || '/' || n.id END AS sort_path
FROM nodes n LEFT JOIN nodes p ON n.parent_id = p.id WHERE n.kind IN ('Region', 'Nation', 'Supplier')""")
def _(n, e):
    return traversal.tree(hops.of_kind(n, "Region", "Nation", "Supplier"), 3).select("id", "name", "depth", "sort_path")


@query("r20_siblings", "SELECT a.id AS a, count(b.id) AS siblings FROM nodes a JOIN nodes b ON a.parent_id = b.parent_id AND a.id <> b.id AND b.kind = 'Nation' WHERE a.kind = 'Nation' GROUP BY a.id")
def _(n, e):
    one = hops.of_kind(n, "Nation").select("id", "parent_id")
    size = one.groupBy("parent_id").agg((F.count("*") - 1).alias("siblings"))
    return one.join(size, "parent_id").where("siblings > 0").select(F.col("id").alias("a"), "siblings")


# Edges with cycles by rule: parts in groups of ten by key; in a group of even number parts 0, 1, 2 import in a circle, in one that is
# a multiple of four parts 3 to 9 do too, which part 0 imports, and part 0 imports itself in one that is a multiple of five.
_CYCLES = """, p AS (SELECT CAST(substr(id, 3) AS BIGINT) AS k FROM nodes WHERE kind = 'Part'), m AS (SELECT max(k) AS m FROM p),
g AS (SELECT k // 10 AS g, k % 10 AS r, k FROM p WHERE k // 10 < (SELECT m // 10 FROM m) AND k // 10 > 0)"""


@query("d_cyc_no_cycles", _CYCLES + """ SELECT 'p:' || CAST(g * 10 AS VARCHAR) AS component, CAST(3 AS BIGINT) AS n, 'high' AS severity FROM g WHERE r = 0 AND g % 2 = 0
UNION ALL SELECT 'p:' || CAST(g * 10 + 3 AS VARCHAR), 7, 'critical' FROM g WHERE r = 3 AND g % 4 = 0 UNION ALL SELECT 'p:' || CAST(g * 10 AS VARCHAR), 1, 'high' FROM g WHERE r = 0 AND g % 5 = 0 AND g % 2 = 1""")
def _(n, e):
    """Circles of imports, made by rule from the parts' keys, and imports between them; a component is named by its smallest part."""
    p = hops.of_kind(n, "Part").select(F.substring("id", 3, 20).cast("long").alias("k"))
    top = p.agg(F.floor(F.max("k") / 10).alias("top"))
    rows = p.join(F.broadcast(top)).select("k", F.floor(F.col("k") / 10).alias("g"), (F.col("k") % 10).alias("r"), "top").where("g > 0 and g < top")
    g, r = F.col("g"), F.col("r")
    first = F.when((g % 2 == 0) & (r < 3), g * 10 + (r + 1) % 3).when((g % 4 == 0) & (r >= 3), g * 10 + 3 + (r - 2) % 7)
    own, out = F.when((g % 5 == 0) & (r == 0), F.col("k")), F.when((g % 4 == 0) & (r == 0), F.col("k") + 5)
    to = rows.select("k", F.explode(F.array_compact(F.array(first, own, out))).alias("to"))
    edges_ = to.select(F.lit("IMPORTS").alias("type"), F.concat(F.lit("p:"), F.col("k").cast("string")).alias("src"), F.concat(F.lit("p:"), F.col("to").cast("string")).alias("dst"))
    found = smells.import_cycles(edges_).select("members", "severity")
    least = F.array_min(F.transform("members", lambda x: F.substring(x, 3, 20).cast("long")))
    return found.select(F.concat(F.lit("p:"), least.cast("string")).alias("component"), F.size("members").cast("long").alias("n"), "severity")


# Aggregates

@query("a1_counts", "SELECT (SELECT count(*) FROM edges) AS n_edges, count(*) AS n_nodes, count(DISTINCT kind) AS n_kinds FROM nodes")
def _(n, e):
    return n.agg(F.count("*").alias("n_nodes"), F.count_distinct("kind").alias("n_kinds")).join(F.broadcast(e.agg(F.count("*").alias("n_edges"))))


@query("a2_graph_totals", "SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges")
def _(n, e):
    return n.agg(F.count("*").alias("n_nodes")).join(F.broadcast(e.agg(F.count("*").alias("n_edges"))))


@query("a3_label_counts", "SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def _(n, e):
    return n.groupBy("kind").agg(F.count("*").alias("n"))


@query("a3_edge_type_counts", "SELECT type, count(*) AS n FROM edges GROUP BY type")
def _(n, e):
    return e.groupBy("type").agg(F.count("*").alias("n"))


@query("a14_collect_distinct", "SELECT parent_id, list_sort(list(DISTINCT kind)) AS kinds, count(*) AS n FROM nodes WHERE parent_id LIKE 'n:%' GROUP BY parent_id")
def _(n, e):
    return n.where(F.col("parent_id").startswith("n:")).groupBy("parent_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count("*").alias("n"))


@query("a15_nested_collect", """, s AS (SELECT parent_id AS nation, string_agg(name, ',' ORDER BY name) AS members FROM nodes WHERE kind = 'Supplier' GROUP BY parent_id)
SELECT r.id AS region, string_agg(n.name || ':' || coalesce(s.members, ''), ';' ORDER BY n.name) AS nations FROM nodes r JOIN nodes n ON n.parent_id = r.id LEFT JOIN s ON s.nation = n.id WHERE r.kind = 'Region' GROUP BY r.id""")
def _(n, e):
    inner = hops.of_kind(n, "Supplier").groupBy(F.col("parent_id").alias("nation")).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("members"))
    mid = hops.of_kind(n, "Nation").join(inner, F.col("id") == F.col("nation"), "left").select("parent_id", "name", F.coalesce("members", F.lit("")).alias("members"))
    outer = mid.groupBy(F.col("parent_id").alias("region")).agg(F.array_sort(F.collect_list(F.struct("name", "members"))).alias("x"))
    return outer.select("region", F.array_join(F.transform("x", lambda x: F.concat(x["name"], F.lit(":"), x["members"])), ";").alias("nations"))


@query("a36_shared_components", """SELECT e.dst AS id, count(DISTINCT e.src) AS n, CASE WHEN count(DISTINCT e.src) > 20 THEN 'core' WHEN count(DISTINCT e.src) > 5 THEN 'shared' ELSE 'local' END AS role FROM edges e WHERE e.type = 'USES' GROUP BY e.dst ORDER BY n DESC, id LIMIT 30""")
def _(n, e):
    c = hops.of_type(e, "USES").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n"))
    return c.withColumn("role", F.when(F.col("n") > 20, "core").when(F.col("n") > 5, "shared").otherwise("local")).orderBy(F.desc("n"), "id").limit(30)


@query("a37_having_shared", "SELECT dst AS id, count(DISTINCT src) AS n FROM edges WHERE type = 'DEPENDS_ON' GROUP BY dst HAVING count(DISTINCT src) > 1")
def _(n, e):
    return hops.of_type(e, "DEPENDS_ON").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n")).where("n > 1")


# Rank

_RANK = """, t AS (SELECT count(*) AS total FROM edges e JOIN nodes n ON e.src = n.id WHERE e.type IN ('CALLS', 'DEPENDS_ON')),
d AS (SELECT dst, count(*) AS d FROM edges WHERE type IN ('CALLS', 'DEPENDS_ON') GROUP BY dst),
w AS (SELECT n.id, coalesce(d.d, 0) AS in_degree, coalesce(d.d, 0) * 1.0 / t.total + 0.15 AS raw FROM nodes n CROSS JOIN t LEFT JOIN d ON n.id = d.dst)"""


@query("g1_native_rank", _RANK + " SELECT id, in_degree, round(raw / (SELECT max(raw) FROM w), 9) AS rank FROM w")
def _(n, e):
    return ranking.native_rank(n, e).select("id", "in_degree", F.round("rank", 9).alias("rank"))


@query("g1_rank_top10", _RANK + " SELECT id, in_degree FROM w ORDER BY raw DESC, id LIMIT 10")
def _(n, e):
    return ranking.top_ranked(ranking.native_rank(n, e)).select("id", "in_degree")


def _pagerank_sql(rounds: int) -> str:
    steps = ["p0 AS (SELECT id, 0.15 AS r FROM nodes)"]
    for k in range(1, rounds + 1):
        steps.append(f"p{k} AS (SELECT n.id, 0.15 + 0.85 * coalesce(g.g, 0) AS r FROM nodes n LEFT JOIN (SELECT s.dst, sum(p.r / s.o) AS g FROM s JOIN p{k - 1} p ON s.src = p.id GROUP BY s.dst) g ON n.id = g.dst)")
    return ", s AS (SELECT DISTINCT e.src, e.dst, o.o FROM edges e JOIN (SELECT src, count(DISTINCT dst) AS o FROM edges WHERE type IN ('CALLS', 'DEPENDS_ON') GROUP BY src) o ON e.src = o.src WHERE e.type IN ('CALLS', 'DEPENDS_ON')), " + ", ".join(
        s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps) + f" SELECT id, round(r, 6) AS rank FROM p{rounds}"


@query("g2_pagerank", _pagerank_sql(20))
def _(n, e):
    return ranking.pagerank(n, e).select("id", F.round("rank", 6).alias("rank"))


@query("w13_share_of_largest", "SELECT id, round(weight / max(weight) OVER (PARTITION BY kind), 9) AS share FROM nodes WHERE kind IN ('Customer', 'Part')")
def _(n, e):
    return ranking.share_of_largest(hops.of_kind(n, "Customer", "Part"), "weight", "kind", "share").select("id", F.round("share", 9).alias("share"))


# Search over nodes

@query("t2_fallback_search", _RANK + " SELECT n.id, round(least(1.0, w.raw / (SELECT max(raw) FROM w) + 0.5), 9) AS score FROM nodes n JOIN w ON n.id = w.id WHERE contains(lower(n.name), 'china') OR contains(lower(n.name), '0001') OR contains(lower(n.name), 'order 12')")
def _(n, e):
    ranked = n.join(ranking.native_rank(n, e).select("id", "rank"), "id")
    return search.fallback_search(ranked, ["China", "0001", "order 12"]).select("id", F.round("score", 9).alias("score"))


@query("t3_similar_by_keyword", """, k AS (SELECT n.id, n.name, w.p, row_number() OVER (PARTITION BY n.name ORDER BY w.p, n.id) AS r FROM nodes n JOIN (VALUES (0, 'order'), (1, 'an'), (2, '99')) w(p, w) ON contains(lower(n.name), w.w))
SELECT id, name, p AS priority FROM k WHERE r = 1 ORDER BY p, name LIMIT 50""")
def _(n, e):
    return search.similar_by_keyword(n, ["Order", "an", "99", "never"], 50).select("id", "name", "priority")


@query("t7_schema_discovery", "SELECT 'kind' AS what, kind AS name FROM nodes GROUP BY kind UNION SELECT 'type', type FROM edges GROUP BY type")
def _(n, e):
    return n.select(F.lit("kind").alias("what"), F.col("kind").alias("name")).distinct().unionByName(e.select(F.lit("type").alias("what"), F.col("type").alias("name")).distinct())


@query("t9_exact_then_partial", "SELECT id, name FROM nodes WHERE lower(name) = 'order 12'")
def _(n, e):
    return search.exact_then_partial(n, "Order 12").select("id", "name")


@query("t14_undocumented_public", """, u AS (SELECT dst, count(*) AS c FROM edges WHERE type IN ('CALLS', 'DEPENDS_ON') GROUP BY dst)
SELECT n.id, n.name, u.c AS callers FROM nodes n JOIN u ON u.dst = n.id WHERE n.kind IN ('Customer', 'Supplier') AND n.weight < 0 ORDER BY callers DESC, id LIMIT 100""")
def _(n, e):
    """Public nodes without documentation (here: a weight below 0) that others call, most called first."""
    return search.undocumented(hops.of_kind(n, "Customer", "Supplier").withColumn("documented", F.col("weight") >= 0), e, ("CALLS", "DEPENDS_ON")).select("id", "name", "callers")


@query("t16_existence", "SELECT type, count(*) > 0 AS present, count(*) AS n FROM edges GROUP BY type")
def _(n, e):
    return e.groupBy("type").agg((F.count("*") > 0).alias("present"), F.count("*").alias("n"))


@query("t17_module_edges", "SELECT a.id AS source, b.id AS target, coalesce(CAST(NULL AS INTEGER), 1) AS weight FROM nodes a LEFT JOIN nodes b ON a.parent_id = b.id WHERE a.kind = 'Nation' AND b.id IS NOT NULL")
def _(n, e):
    found = hops.hop(hops.prefixed(hops.of_kind(n, "Nation"), "a"), e, n, types=("BELONGS_TO",), how="left").where("b_id is not null")
    return found.select(F.col("a_id").alias("source"), F.col("b_id").alias("target"), F.coalesce(F.lit(None).cast("int"), F.lit(1)).alias("weight"))


@query("t18_starting_points", """, s AS (SELECT id, name, 'place' AS point, 1 AS priority FROM nodes WHERE kind = 'Region' UNION ALL SELECT id, name, 'large order', 2 FROM nodes WHERE kind = 'Order' AND weight > 400000 UNION ALL SELECT id, name, 'part', 3 FROM nodes WHERE kind = 'Part' AND weight > 2000)
SELECT * FROM s ORDER BY priority, id LIMIT 10""")
def _(n, e):
    pick = lambda cond, point, p: n.where(cond).select("id", "name", F.lit(point).alias("point"), F.lit(p).alias("priority"))
    every = pick("kind = 'Region'", "place", 1).unionByName(pick("kind = 'Order' and weight > 400000", "large order", 2)).unionByName(pick("kind = 'Part' and weight > 2000", "part", 3))
    return every.distinct().orderBy("priority", "id").limit(10)


@query("t19_connections", "SELECT c.dst AS source, u.dst AS target FROM edges c JOIN edges u ON c.src = u.src AND u.type = 'USES' WHERE c.type = 'CALLS' GROUP BY c.dst, u.dst")
def _(n, e):
    a = hops.of_type(e, "CALLS").select("src", F.col("dst").alias("source"))
    return a.join(hops.of_type(e, "USES").select("src", F.col("dst").alias("target")), "src").select("source", "target").distinct()


@query("d_dead_code", """, u AS (SELECT DISTINCT dst FROM edges WHERE type = 'CALLS'), x AS (SELECT id, kind, weight, CASE WHEN kind = 'Supplier' AND weight > 5000 THEN 'CacheHandler' WHEN kind = 'Supplier' AND weight < 0 THEN 'main' ELSE name END AS name FROM nodes)
SELECT x.id, x.name FROM x LEFT JOIN u ON u.dst = x.id WHERE x.kind IN ('Customer', 'Supplier') AND u.dst IS NULL AND NOT regexp_matches(lower(x.name), '^main$|^index$|controller$|handler$|endpoint$|^app$|^server$|^bootstrap$')""")
def _(n, e):
    """Customers and suppliers are exported; some suppliers get the names of entry points, which are never dead. Dependencies do not count as use here, calls do."""
    named = F.when((F.col("kind") == "Supplier") & (F.col("weight") > 5000), "CacheHandler").when((F.col("kind") == "Supplier") & (F.col("weight") < 0), "main").otherwise(F.col("name"))
    return smells.dead_code(n.withColumn("name", named).withColumn("is_exported", F.col("kind").isin("Customer", "Supplier")), e).select("id", "name")


@query("u1_union_scored", """, u AS (SELECT id, 1.0 AS score, 'region' AS layer FROM nodes WHERE kind = 'Region' UNION SELECT id, 0.8, 'nation' FROM nodes WHERE kind = 'Nation' AND name LIKE '%A%' UNION SELECT id, 0.6, 'supplier' FROM nodes WHERE kind = 'Supplier' AND weight > 0)
SELECT id, CAST(score AS DOUBLE) AS score, layer FROM u ORDER BY score DESC, id LIMIT 60""")
def _(n, e):
    pick = lambda cond, s, layer: n.where(cond).select("id", F.lit(s).alias("score"), F.lit(layer).alias("layer"))
    every = pick("kind = 'Region'", 1.0, "region").union(pick("kind = 'Nation' and name like '%A%'", 0.8, "nation")).union(pick("kind = 'Supplier' and weight > 0", 0.6, "supplier")).distinct()
    return every.orderBy(F.desc("score"), "id").limit(60)


@query("u4_union_of_sets", """, a AS (SELECT dst AS id, src AS x FROM edges WHERE type = 'CALLS' UNION SELECT dst, dst FROM edges WHERE type = 'CALLS') SELECT id, count(*) AS n FROM a GROUP BY id""")
def _(n, e):
    """Callers of a node and the node itself, counted as rows: no set is collected for its size."""
    calls = hops.of_type(e, "CALLS")
    return calls.select(F.col("dst").alias("id"), F.col("src").alias("x")).union(calls.select("dst", "dst")).distinct().groupBy("id").agg(F.count("*").alias("n"))


@query("u6_unmapped", "SELECT id FROM nodes WHERE kind IN ('Customer', 'Nation') EXCEPT SELECT dst FROM edges WHERE type = 'CALLS'")
def _(n, e):
    return hops.of_kind(n, "Customer", "Nation").select("id").exceptAll(hops.of_type(e, "CALLS").select(F.col("dst").alias("id")).distinct())


@query("l4_expression_sort", "SELECT id, length(name) - length(id) AS span FROM nodes WHERE kind = 'Part' ORDER BY span DESC, id LIMIT 25")
def _(n, e):
    return hops.of_kind(n, "Part").select("id", (F.length("name") - F.length("id")).alias("span")).orderBy(F.desc("span"), "id").limit(25)


@query("l5_order_by_size", "SELECT src AS id, count(*) AS n FROM edges WHERE type = 'USES' GROUP BY src ORDER BY n DESC, id LIMIT 20")
def _(n, e):
    """By the size of a list that is only counted."""
    return hops.of_type(e, "USES").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(20)
