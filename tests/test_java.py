"""Java blocks, types, rules and SQL on small sources."""

import time

from pyspark.sql import functions as F

from codelattice.operators import rules, types
from codelattice.sources import elements, flows, java_blocks, sql_text

JAVA = '''package a;
/* class No { */
@Deprecated
public abstract class A<T extends B> extends B implements C, D<T> {
    String brace = "} {"; // }
    private static final Map<String, int[]> map = new HashMap<>();
    A(int... n) { this.n = n; }
    @Ann(value = "x;y", other = @In(1))
    public <X> X make(final @NotNull Map<String, List<X>> m, @Min(value = 2) int[] k)
            throws IOException {
        for (int i = 0; i < 3; i++) { if (i > 1) { run(i, k[0]); } else { stop(); } }
        Runnable r = new Runnable() { public void run() { go(); } };
        try { work(); } catch (Ex e) { throw new Ex("caught"); }
        char c = '{'; String t = """
            SELECT a, b
            FROM t WHERE c = '}'; """;
        return null;
    }
    abstract void open();
    enum Kind { ONE, TWO; int size() { return 2; } }
    interface Inner { void call(String s); }
    void after() { }
}
'''


def source(spark, *texts):
    return spark.createDataFrame([(f"F{i}.java", x) for i, x in enumerate(texts)], "path string, text string")


def test_members(spark):
    files = source(spark, JAVA, None, "", "}}} class X { void y() { }", "class Open { void z() {")
    found = java_blocks.blocks(files)
    held = [r for r in java_blocks.members(found, files).orderBy("path", "n").collect()]
    mine = [(r.kind, r.qualified, r.type) for r in held if r.path == "F0.java"]
    assert mine == [
        ("Class", "A", None), ("Field", "A.brace", "String"), ("Field", "A.map", "Map<String, int[]>"), ("Constructor", "A.A(int[])", None), ("Method", "A.make(Map,int[])", "X"), ("Method", "A.open()", "void"),
        ("Enum", "A.Kind", None), ("Method", "A.Kind.size()", "int"), ("Interface", "A.Inner", None), ("Method", "A.Inner.call(String)", "void"), ("Method", "A.after()", "void"),
    ]
    at = {r.qualified: r for r in held}
    assert at["A"].annotations == ["Deprecated"] and at["A"].last_line == 23 and at["A.make(Map,int[])"].annotations == ["Ann", "In"] and at["A.make(Map,int[])"].throws == ["IOException"]
    assert at["A.after()"].snippet == "    void after() { }" and at["A.make(Map,int[])"].snippet.splitlines()[-1] == "    }" and at["A.make(Map,int[])"].start_line == 8
    assert {r.qualified for r in held if r.path != "F0.java"} == {"X", "X.y()", "Open", "Open.z()"}
    assert [(r.exception, r.message) for r in java_blocks.thrown(found).collect()] == [("Ex", "caught")]
    said = {(r.receiver, r.name, r.arity) for r in java_blocks.calls(found).collect()}
    assert {(None, "run", 2), (None, "stop", 0), (None, "go", 0), (None, "work", 0)} <= said and not any(n in ("if", "for", "catch", "make") for _, n, _ in said)
    assert [r.sql for r in sql_text.statements(found).collect()] == ["SELECT a, b FROM t WHERE c = '}';"]
    assert java_blocks.blocks(files.limit(0)).count() == 0


def test_long_file_is_linear(spark):
    """100,000 methods in one file."""
    text = "class Big {\n" + "".join(f"  void m{i}(int a) {{ if (a == null) {{ return; }} }}\n" for i in range(100_000)) + "}"
    began = time.perf_counter()
    held = java_blocks.members(java_blocks.blocks(source(spark, text)))
    assert held.where("kind = 'Method' and owner = 'Big' and arity = 1").count() == 100_000
    assert time.perf_counter() - began < 120


def test_closure_and_overrides(spark):
    direct = spark.createDataFrame([("B", "A"), ("C", "B"), ("D", "C"), ("X", "Y"), ("Y", "X"), ("D", "I"), ("A", "A")], "sub string, super string")
    closure = types.supertype_closure(direct)
    assert {(r.sub, r.super): r.distance for r in closure.collect() if r.sub in "DX"} == {("D", "D"): 0, ("D", "C"): 1, ("D", "I"): 1, ("D", "B"): 2, ("D", "A"): 3, ("X", "X"): 0, ("X", "Y"): 1}
    methods = spark.createDataFrame([("A.f", "A", "f", 0, True), ("C.f", "C", "f", 0, True), ("I.f", "I", "f", 0, False), ("A.f1", "A", "f", 1, True), ("Lone.f", "Lone", "f", 0, True)], "id string, type string, name string, arity int, has_body boolean")
    calls = spark.createDataFrame([(1, "m", "A", "f", 0), (2, "m", "D", "f", 0), (3, "m", "I", "f", 0), (4, "m", "D", "f", 1), (5, "m", "X", "f", 0), (6, "m", "Lone", "f", 0)], "call int, src string, receiver_type string, name string, arity int")
    got = {}
    for r in types.resolve_invocations(calls, closure, methods).collect():
        got.setdefault(r.call, set()).add(r.target)
    assert got == {1: {"A.f", "C.f"}, 2: {"C.f"}, 3: {"C.f", "I.f"}, 4: {"A.f1"}, 6: {"Lone.f"}}


def test_guards_look_at_their_own_block(spark):
    java = '''class A {
  void m(Object x) {
    if (x != null) { if (n > 3) { throw new E("deep"); } }
    if (x == null) throw new E("bare");
    if (k >= 9) { log("throw new E"); }
    else if (!done) { return false; }
    if (amount > 5 && status == 2) { a(); } else { b(); }
    Assert.notNull(x); Preconditions.checkState(open, "closed"); Assert.state(up);
    assertThrows(E.class, () -> run()); assertTrue(ok(1, 2));
  }
}'''
    got = [(r.kind, r["name"], r.rule, r.outer) for r in rules.java_rules(source(spark, java, None)).collect()]
    assert sorted(x for x in got if x[0] == "GuardClause") == [
        ("GuardClause", "Guard_done", "State check on done", []), ("GuardClause", "Guard_n", "deep", ["x != null"]), ("GuardClause", "Guard_open", "State check: open", []),
        ("GuardClause", "Guard_up", "State check: up", []), ("GuardClause", "Guard_x", "bare", []),
    ]
    assert [x[2] for x in got if x[0] == "ConditionalBusinessLogic"] == ["When amount is > 5 | then calls a | else calls b"]
    assert sorted(x[2] for x in got if x[0] == "TestAssertion") == ["Test expects: () -> run() should throw E.class", "Test expects: ok(1, 2) should be true"]


def test_page_and_flow_rules(spark):
    page = '<input name="a" required pattern="x+" min="1" max="9" minlength="2" maxlength="5" type="email"><form:errors path="b.c"/><c:if test="${user.role == 1}"/><c:when test="${zzz}"/>${not empty a.b}${empty q}'
    files = spark.createDataFrame([("p", page), ("n", None)], "path string, text string")
    got = {(r["name"], r.rule, round(r.confidence, 2)) for r in rules.page_rules(elements.elements(files, clean=elements.without_code(F.col("text"), None)), files).collect()}
    assert got == {
        ("Required_a", "a is required", 0.85), ("Pattern_a", "a must match pattern: x+", 0.85), ("Min_a", "a must be at least 1", 0.85), ("Max_a", "a must be at most 9", 0.85), ("Length_a", "a length must be at least 2 at most 5", 0.85), ("Email_a", "a must be a valid email address", 0.85),
        ("ServerValidation_b.c", "b.c has server-side validation (errors displayed via form:errors)", 0.95), ("Condition_user.role", "When user.role == 1", 0.7), ("Guard_b", "b must not be empty", 0.8), ("Guard_q", "q is empty check", 0.8),
    }
    flow = '<flow><view-state id="v"><secured attributes="R"/><binder><binding property="p" required="true" converter="d"/></binder><transition on="n" to="w" condition="a"/></view-state><decision-state id="w"><if test="t" then="v"/></decision-state><action-state id="x"><evaluate expression="s.validate(a)"/><evaluate expression="o.total"/><evaluate expression="zzz"/></action-state></flow>'
    found = flows.flow_elements(spark.createDataFrame([("f", flow)], "path string, text string"))
    states = flows.flow_states(found)
    got = {(r.kind, r.rule, r.confidence) for r in rules.flow_rules(found, states, flows.flow_transitions(found, states)).collect()}
    assert got == {
        ("BusinessRule", "Access to v requires: R", 0.95), ("ValidationConstraint", "p is required in form binding", 0.85), ("ValidationConstraint", "p uses converter: d", 0.85), ("GuardClause", "Transition on 'n' to 'w' requires: a", 0.9),
        ("ConditionalBusinessLogic", "If t then go to v", 0.9), ("BusinessRule", "s.validate(a)", 0.9), ("BusinessRule", "o.total", 0.75),
    }


def test_sql_lineage(spark):
    texts = ["MERGE INTO a USING b ON a.x = b.y WHEN MATCHED THEN UPDATE SET a.z = 1", "update t set q = 1, r = (select max(s) from u) where k in (1)", "insert into v (m, n) select m, n from w join x on w.i = x.j", "delete from y where z is null", "SELECT * FROM c, d e WHERE e.f LIKE 'x'"]
    got = {r.kind: (r.reads, r.writes) for r in sql_text.lineage(spark.createDataFrame([(x,) for x in texts], "sql string")).collect()}
    assert got == {"MERGE": (["b"], ["a"]), "UPDATE": (["u"], ["t"]), "INSERT": (["w", "x"], ["v"]), "DELETE": ([], ["y"]), "SELECT": (["c", "d"], [])}
