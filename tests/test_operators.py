"""Operators on small hand-made frames."""

import pytest
from pyspark.sql import functions as F

from codelattice.functions import code_text, ids, ladders, words
from codelattice.operators import classify, detect, hops, keep, ranking, reports, search, smells, traversal, verify
from codelattice.plans import tools
from codelattice.schema import dangling_edges, duplicates
from codelattice.sources import parsers


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def graph(spark, pairs, kind="IMPORTS"):
    return spark.createDataFrame([(kind, a, b) for a, b in pairs], "type string, src string, dst string")


def nodes_of(spark, names):
    return spark.createDataFrame([(n, "File", n) for n in names], "id string, kind string, name string")


@pytest.mark.parametrize(("pairs", "want"), [
    ([("a", "b"), ("b", "a")], {("a", "b")}), ([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], {("a", "b", "c")}), ([("a", "b"), ("b", "c")], set()),
    ([("a", "a"), ("a", "b")], {("a",)}), ([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "e")], {("a", "b"), ("c", "d"), ("e", "f", "g")}), ([], set()),
])
def test_cycles(spark, pairs, want):
    found = smells.import_cycles(graph(spark, pairs)).collect()
    assert {tuple(r.members) for r in found} == want
    assert all(r.severity == ("critical" if len(r.members) > 3 else "high") for r in found)


def test_cycles_that_do_not_settle_raise(spark):
    e = graph(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c")]).select("src", "dst")
    with pytest.raises(RuntimeError):
        traversal.strong_components(e, rounds=1).collect()
    assert traversal.strong_components(e, rounds=2).count() == 4


def test_cycles_at_the_ends_of_a_long_chain(spark):
    """A chain in no order of its names, between two circles: its length is not the number of rounds."""
    import random

    names = [f"n{i:03}" for i in range(120)]
    random.Random(1).shuffle(names)
    pairs = list(zip(names, names[1:], strict=False)) + [(names[1], names[0]), (names[-1], names[-3])]
    found = {frozenset(r.members) for r in smells.import_cycles(graph(spark, pairs)).collect()}
    assert found == {frozenset(names[:2]), frozenset(names[-3:])}


def test_depths_and_chains(spark):
    e = graph(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "a"), ("x", "y")])
    seed = nodes_of(spark, ["a"])
    assert {(r.id, r.depth) for r in traversal.depths(e, seed, 10).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {(r.id, r.depth) for r in traversal.depths(e, seed, 10, reverse=True).collect()} == {("a", 0), ("d", 1), ("c", 2), ("b", 3)}
    assert {(r.id, r.depth, r.via) for r in traversal.call_chain(e, seed, 5).collect()} == {("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "c")}
    assert {tuple(r.nodes) for r in traversal.paths(e, seed, 3).collect()} == {("a", "b"), ("a", "c"), ("a", "b", "c"), ("a", "c", "d"), ("a", "b", "c", "d")}
    assert {(r.id, r.n) for r in traversal.count_walks(e, seed, 0, 2).collect()} == {("a", 1), ("b", 1), ("c", 2), ("d", 1)}
    assert {r.id for r in traversal.reach(e, seed, 0, 1).collect()} == {"a", "b", "c"}


def test_rank(spark):
    n = nodes_of(spark, "abcd")
    e = graph(spark, [("a", "b"), ("c", "b"), ("b", "d")], "CALLS")
    rank = {r.id: r.rank for r in ranking.native_rank(n, e).collect()}
    assert rank["b"] == 1.0 and rank["a"] == pytest.approx(0.15 / (2 / 3 + 0.15))
    assert {r.rank for r in ranking.native_rank(n, e.limit(0)).collect()} == {0.15}
    pr = {r.id: r.rank for r in ranking.pagerank(n, e).collect()}
    assert pr["a"] == pytest.approx(0.15) and pr["b"] == pytest.approx(0.15 + 0.85 * 0.3) and pr["d"] == pytest.approx(0.15 + 0.85 * pr["b"])


def test_tree(spark):
    menu = spark.createDataFrame([("1", None, "Top"), ("2", "1", "Mid"), ("3", "2", "Leaf"), ("4", "9", "Orphan")], "id string, parent_id string, name string")
    got = {r.id: (r.depth, r.path) for r in traversal.ancestors(menu, 5).collect()}
    assert got == {"1": (0, ["Top"]), "2": (1, ["Top", "Mid"]), "3": (2, ["Top", "Mid", "Leaf"]), "4": (0, ["Orphan"])}
    assert [r.id for r in traversal.tree(menu, 5).orderBy("sort_path").collect()] == ["1", "2", "3", "4"]


def test_smells(spark):
    rows = [("under", 50, 5, 4, 15, 20), ("over", 51, 6, 5, 16, 21), ("far", 150, 10, 8, 45, 60)]
    n = spark.createDataFrame(rows, "id string, loc int, param_count int, nesting int, complexity int, cognitive int")
    got = {(r.id, r.smell): r.severity for r in smells.smells(n).collect()}
    assert not any(i == "under" for i, _ in got)
    assert {s for (i, _), s in got.items() if i == "far"} == {"critical"}
    assert got["over", "long_method"] == "low" and got["over", "too_many_parameters"] == "medium" and got["over", "deep_nesting"] == "medium"
    classes = spark.createDataFrame([("god", 1200, 31, 3.0, 0), ("data", 60, 6, 1.0, 5), ("fine", 100, 5, 1.0, 5)], "id string, loc int, method_count int, avg_complexity double, accessor_count int")
    assert {(r.id, r.smell) for r in smells.class_smells(classes).collect()} == {("god", "god_class"), ("god", "large_class"), ("god", "too_many_methods"), ("data", "data_class")}
    total = {r.severity: (r.n, r.hours) for r in smells.smell_rollup(smells.smells(n)).collect()}
    assert total["critical"] == (5, 10.0)


def test_dead_code(spark):
    n = spark.createDataFrame([("f", "f", True), ("g", "g", True), ("c", "UserController", True), ("h", "h", False)], "id string, name string, is_exported boolean")
    assert [r.id for r in smells.dead_code(n, graph(spark, [("f", "g")], "CALLS")).collect()] == ["f"]


def test_text_metrics(spark):
    code = "/* head\n still */\nint f(int a) {\n  // note\n\n  if (a > 1 && a < 9) {\n    for (;;) { g(); }\n  } else if (a) {\n    h();\n  } else {\n    k();\n  }\n}"
    m = value(spark, code_text.text_metrics(F.lit(code)))
    assert (m["loc"], m["nesting"]) == (9, 2)
    assert value(spark, code_text.cyclomatic(F.lit(code))) == 1 + 2 + 1 + 1 + 1
    assert value(spark, code_text.cognitive(F.lit(code))) == 7
    count = lambda s: value(spark, code_text.parameter_count(F.lit(s)))
    assert [count(s) for s in ("f()", "f(a)", "f(Map<String, List<Integer>> m, int[] b)", "f( )")] == [0, 1, 2, 0]


def test_sql_text(spark):
    s = value(spark, code_text.sql_statement(F.lit("select a.id, b.name from orders a join items b on a.id = b.oid where 1=1")))
    assert (s.kind, s.main_table, s.tables, s.columns) == ("SELECT", "orders", ["orders", "items"], ["a.id", "b.name"])
    s = value(spark, code_text.sql_statement(F.lit("INSERT INTO t (x, y) VALUES (1, 2)")))
    assert (s.kind, s.main_table, s.columns) == ("INSERT", "t", ["x", "y"])
    s = value(spark, code_text.sql_statement(F.lit("update t set x = 1, y = 2 where z = 3")))
    assert (s.kind, s.main_table, s.columns) == ("UPDATE", "t", ["x", "y"])
    assert value(spark, code_text.sql_statement(F.lit("drop it"))).kind == "UNKNOWN"


def test_guards_and_rules(spark):
    g = value(spark, code_text.guard(F.lit("user == null")))
    assert (g.operand, g.operator, g.value, g.guard_kind) == ("user", "is_null", None, "null_check")
    assert value(spark, code_text.guard(F.lit("!isValid(x)"))).guard_kind == "state_check"
    b = value(spark, code_text.business_condition(F.lit("order.amount > 100")))
    assert b.words == ["amount"] and b.confidence == pytest.approx(0.6) and (b.variable, b.operator, b.threshold) == ("amount", "greater_than", "100")
    assert [v.rule for v in value(spark, code_text.validations(F.lit("@NotNull @Size(max=3) String x")))] == ["required", "length"]
    assert value(spark, code_text.markdown_sections(F.lit("intro\n# A\none\n\n## B\ntwo\n# A\nlast"))) == {"A": "last", "B": "two"}


def test_ids(spark):
    assert value(spark, ids.entity_id(F.lit("Class"), F.lit("My Repo"), F.lit("src\\A B.ts"))) == "class:my_repo:src/a_b.ts"
    assert value(spark, ids.path_parameters(F.lit("/a/{id}/:name/<x>/[y]"))) == ["id", "name", "x", "y"]
    assert value(spark, ids.base_path(F.lit("/users/:id/edit"))) == "/users"
    assert value(spark, ids.join_path(F.lit("/api/"), F.lit("/x"))) == "/api/x"
    assert value(spark, ids.source_type(F.lit("a/src/test/java/X.java"))) == "test"


def test_ladders(spark):
    name = lambda p, c=None: value(spark, ladders.feature_name(F.lit(p), c))
    assert name("/users").name == "User Management" and name("/thing/:x").name == "Thing Details" and name("/gadgets").name == "Gadget Management"
    assert (name("/zebra").name, name("/zebra").confidence) == ("Zebra", 0.5) and name("").name == "Home"
    assert name("/zebra", F.lit("UserProfilePage")).name == "User Profile"
    assert value(spark, ladders.feature_category(F.lit("/admin/x"))) == "admin"
    assert value(spark, ladders.severity(F.lit(90.0), F.lit(50.0), (1.5, 2.0, 3.0))) == "medium"
    assert [value(spark, ladders.layer(F.lit(k), F.lit(n))) for k, n in (("JSPPage", "x"), ("JavaClass", "OrderDao"), ("Thing", "y"))] == ["UI", "DAO", "Unknown"]
    assert value(spark, ladders.layer(F.lit("JavaMethod"), F.lit("save"), "chain", F.lit("OrderDao"))) == "DAO"


def test_words(spark):
    assert value(spark, words.keywords(F.lit("Where should the order total and ORDER date go?"))) == ["where", "order", "total", "date"]
    assert value(spark, words.compound(F.array(F.lit("add"), F.lit("Order"), F.lit("note")))).asDict() == {"subject": "ordernote", "actions": ["add"]}
    assert value(spark, words.question_type(F.lit("Where is it?"))) == "locational"
    assert value(spark, words.identifiers(F.lit("see OrderService and order_id in 'the cart'"))) == ["the cart", "OrderService", "order_id"]


def test_stereotypes(spark):
    none = F.array().cast("array<string>")
    def of(name, annotations=none, methods=none):
        r = value(spark, classify.stereotype_of(F.lit(name), annotations, none, methods, none))
        return r.stereotype, round(r.confidence, 4)

    assert of("UserController") == ("Controller", 0.75)
    assert of("UserController", F.array(F.lit("@RestController"))) == ("Controller", round((0.95 + 0.75) / 2 * 1.1, 4))
    assert of("OrderRepository", none, F.array(F.lit("findById")))[0] == "Repository"
    assert of("Plain") == ("Unknown", 0.0)


def test_tests_in_text(spark):
    text = "describe('cart', () => {\n  it('adds', () => {});\n  xit('later', () => {});\n\n});\nfit('alone', () => {});"
    rows = detect.test_cases(spark.createDataFrame([("a.test.ts", text)], "path string, text string")).where("case is not null and rule = 5").orderBy("line").collect()
    assert [(r.line, r.suite, r.case, r.skipped, r.focused) for r in rows] == [(2, "cart", "adds", False, False), (3, "cart", "later", True, False), (6, "cart", "alone", False, True)]
    path = lambda p: value(spark, detect.tested_path(F.lit(p)))
    assert [path(p) for p in ("src/a.test.ts", "x_test.go", "src/test/java/FooTest.java", "x.ts")] == ["src/a.ts", "x.go", "src/main/java/Foo.java", None]
    kind = lambda p, t: value(spark, detect.test_framework(F.lit(p), F.lit(t)))
    assert [kind("a.py", "import pytest\ndef test_x(): pass"), kind("a.py", "nothing"), kind("ATest.java", "@Test(groups = 1)"), kind("ATest.java", "@Nested")] == ["pytest", None, "TestNG", "JUnit5"]


def test_long_files_are_linear(spark):
    import time

    text = "\n".join(f"it('case {i}', f)" if i % 3 else "/* note\n*/ int x;" for i in range(40_000))
    began = time.perf_counter()
    files = spark.createDataFrame([("a.test.ts", text, "typescript")], "path string, text string, language string")
    assert detect.test_cases(files).where("rule = 5").count() == sum(1 for i in range(40_000) if i % 3)
    assert parsers.lines_of(files).count() > 20_000 and time.perf_counter() - began < 60


def test_frameworks(spark):
    manifests = spark.createDataFrame([("package.json", '{"dependencies": {"react": "1", "left-pad": "2"}}'), ("x/requirements.txt", "Flask==1\n"), ("package.json", "no json")], "path string, text string")
    texts = spark.createDataFrame([("from fastapi import FastAPI",), ("@RestController class X",), (None,)], "text string")
    got = {r.framework: (r.confidence, len(r.evidence)) for r in detect.frameworks(manifests, texts).collect()}
    assert got == {"React": (0.95, 1), "Flask": (0.95, 1), "FastAPI": (0.9, 1), "Spring Boot": (0.9, 1)}


def test_documentation(spark):
    score = lambda *a: value(spark, classify.doc_score(*(F.lit(x) for x in a)))
    assert score(True, "A long description", False, 0, 0, None, False).level == "excellent"
    full = score(True, "A long description", True, 2, 1, "int", False)
    assert full.score == pytest.approx(3 / 5) and full.documented
    assert score(False, None, False, 0, 0, None, False).level == "none"


def test_claims(spark):
    claims = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("c", "s2"), ("d", "s2")], "claim_id string, section string")
    ev = [("a", "code_reference", 0.9, True), ("a", "pattern", 0.5, True), ("b", "metrics", 0.8, True), ("b", "metrics", 0.8, False), ("c", "metrics", 0.9, False)]
    e = spark.createDataFrame(ev, "claim_id string, evidence_type string, confidence double, supports boolean")
    scored = verify.claim_scores(claims, e)
    got = {r.claim_id: (round(r.confidence, 6), r.status, r.risk, r.needs_review) for r in scored.collect()}
    assert got["a"] == (round((0.9 + 0.5 * 0.55) / 1.55, 6), "verified", "none", False)
    assert got["b"] == (round(0.8 * 0.75, 6), "partially_verified", "low", False)
    assert got["c"] == (0.0, "contradicted", "critical", False) and got["d"] == (0.0, "unverified", "high", False)
    sections = {r.section: (r.total, r.status) for r in verify.section_stats(scored).collect()}
    assert sections == {"s1": (2, "partially_verified"), "s2": (2, "contradicted")}
    assert not verify.bundle_metrics(verify.section_stats(scored)).first().approved


def test_search(spark):
    docs = spark.createDataFrame([("1", "order cart order"), ("2", "cart"), ("3", "zebra")], "id string, text string")
    q = spark.createDataFrame([("order",), ("cart",)], "term string")
    got = [r.id for r in search.bm25(docs, q).orderBy(F.desc("score")).collect()]
    assert got == ["1", "2"]
    n = nodes_of(spark, ["Cart", "CartItem", "Order"])
    assert {r.name for r in search.exact_then_partial(n, "cart").collect()} == {"Cart"}
    assert {r.name for r in search.exact_then_partial(n, "art").collect()} == {"Cart", "CartItem"}
    assert [(r.name, r.tier) for r in search.tiered([n.where("name = 'Cart'"), n]).orderBy("name").collect()] == [("Cart", 0), ("CartItem", 1), ("Order", 1)]


def test_relevance_floor(spark):
    s = spark.createDataFrame([(str(i), i / 10) for i in range(10)], "id string, score double")
    assert keep.relevance_floor(s).count() == 5
    assert keep.relevance_floor(s, least=2).count() == 5
    assert keep.relevance_floor(s, floor=0.95, least=2).count() == 2


def test_hops(spark):
    n, e = nodes_of(spark, "abc"), graph(spark, [("a", "b"), ("a", "z")])
    left = hops.hop(hops.prefixed(n, "a"), e, n, how="left")
    assert {(r.a_id, r.b_id) for r in left.collect()} == {("a", "b"), ("b", None), ("c", None)}
    modules = spark.createDataFrame([("app",), ("app/core",)], "root string")
    files = spark.createDataFrame([("app/core/x.ts",), ("app/corex/y.ts",), ("z.ts",)], "path string")
    assert {(r.path, r.root) for r in hops.longest_prefix(files, modules, fallback=":").collect()} == {("app/core/x.ts", "app/core"), ("app/corex/y.ts", "app"), ("z.ts", ":")}


def test_reports(spark):
    score = value(spark, reports.testing_score(F.lit(0.8), F.lit(3), F.lit(True), F.lit(False), F.lit(True)))
    assert (score.score, score.grade) == (81.0, "B")
    assert value(spark, reports.documentation_score(F.lit(1.0), F.lit(0.5), F.lit(4))).score == 78.0
    assert value(spark, reports.readiness(F.lit(80.0), F.lit(72.0))).ready
    routes = spark.createDataFrame([("/users/list", "UserList"), ("/users/list/:id", "UserList"), ("/admin", None)], "route string, component string")
    got = {r.base: (r.name, r.category, r.n_routes) for r in reports.discover_features(routes).collect()}
    assert got == {"/users/list": ("User Management", "user-facing", 2), "/admin": ("Admin Dashboard", "admin", 1)}
    screens = spark.createDataFrame([("OrderEntry",), ("OrderResults",), ("ErrorPage",)], "name string")
    assert [(r.prefix, r.n_screens) for r in reports.screen_groups(screens).collect()] == [("Order", 2)]
    first = reports.recommendations(spark, {"untested_critical": 1, "coverage": 0.9, "public_docs": 0.1, "doc_quality": 0.1}).collect()
    assert [r.priority for r in first] == ["critical", "medium", "low"]


def test_tools(spark):
    n, e = nodes_of(spark, "abc"), graph(spark, [("a", "b"), ("b", "c")])
    assert [r.id for r in tools.call_tool("callers", n, e, name="c").collect()] == ["b", "a"]
    with pytest.raises(KeyError):
        tools.call_tool("nothing", n, e)
    with pytest.raises(ValueError):
        tools.read_only({"n": n}, "DROP TABLE n")


def test_schema_checks(spark):
    n = spark.createDataFrame([("a",), ("a",), ("b",)], "entity_id string")
    assert [(r.entity_id, r.n) for r in duplicates(n, "entity_id").collect()] == [("a", 2)]
    assert dangling_edges(n, graph(spark, [("a", "b"), ("a", "q")])).count() == 1
