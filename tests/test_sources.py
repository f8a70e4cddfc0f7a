"""Scanning, parsing, storing and incremental indexing."""

import pytest
from pyspark.sql import functions as F

from codelattice.sources import files, parsers
from codelattice.streaming import incremental

JAVA = """package com.shop;
import java.util.List;
/* comment
class Hidden {} */
public class Cart extends Base implements Store, Other<X> {
    private final int total = 0;
    public int add(int a, int b) throws Bad {
        if (a == null) {
            throw new Bad();
        }
        service.save(a);
        if (order.amount > 5) { b++; }
        return a;
    }
    interface Inner {}
}
"""
GO = 'package main\n\nimport (\n\t"fmt"\n)\n\ntype Shop struct {\n}\n\nfunc (s *Shop) Open() {\n}\n\nfunc main() {\n\tfmt.Println("x")\n}\n'
CS = "using System;\nnamespace Shop {\n  public class Item : Base, IThing {\n    public int Id { get; set; }\n    private string name = \"x\";\n    public void Sell(int n)\n    {\n    }\n  }\n}\n"
CPP = '#include <vector>\n#define MAX 3\nclass Shape {\n};\nint Shape::area() const {\n  return 1;\n}\nint main(int argc) {\n  return 0;\n}\n'
TS = "import { x } from './x';\nexport class Cart {\n  add(a: number): void {\n    if (a) {\n    }\n  }\n}\nexport const total = (c: Cart) => 1;\nexport function run() {\n}\nconst limit = 3;\ninterface Named {\n}\ntype Id = string;\n"
PY = 'import os\nfrom a import b\n\nX = 1\n\nclass C:\n    """Doc."""\n    def m(self, a, *, k):\n        return f(a)\n\nasync def g():\n    pass\n'


def source(spark, **texts):
    return spark.createDataFrame([(p.replace("__", "."), t) for p, t in texts.items()], "path string, text string")


def test_declarations(spark):
    rows = parsers.declarations(source(spark, A__java=JAVA, m__go=GO, i__cs=CS, s__cpp=CPP, c__ts=TS), "r").collect()
    of = lambda p: {(r.kind, r.name, r.container) for r in rows if r.path == p}
    assert of("A.java") >= {("PackageDeclaration", "com.shop", None), ("ImportDeclaration", "java.util.List", None), ("JavaClass", "Cart", None), ("JavaField", "total", "Cart"), ("JavaMethod", "add", "Cart"), ("JavaInterface", "Inner", None)}
    assert not any(r.name == "Hidden" for r in rows)
    assert of("m.go") == {("PackageClause", "main", None), ("ImportSpec", "fmt", None), ("GoStruct", "Shop", None), ("GoMethod", "Open", None), ("GoFunction", "main", None)}
    assert of("i.cs") == {("UsingDirective", "System", None), ("NamespaceDeclaration", "Shop", None), ("CSharpClass", "Item", None), ("Property", "Id", "Item"), ("Field", "name", "Item"), ("CSharpMethod", "Sell", "Item")}
    assert of("s.cpp") == {("IncludeDirective", "vector", None), ("MacroDefinition", "MAX", None), ("CppClass", "Shape", None), ("CppMethod", "Shape::area", None), ("CFunction", "main", None)}
    assert of("c.ts") == {("Import", "./x", None), ("Class", "Cart", None), ("Method", "add", "Cart"), ("Function", "total", None), ("Function", "run", None), ("Variable", "limit", None), ("Interface", "Named", None), ("TypeAlias", "Id", None)}
    assert len({r.entity_id for r in rows}) == len(rows)


def test_edges_and_types(spark):
    found = parsers.declarations(source(spark, A__java=JAVA, i__cs=CS), "r").cache()
    by_type = {(r.type, r.name, r.target) for r in parsers.supertypes(found).collect()}
    assert by_type == {("EXTENDS", "Cart", "Base"), ("IMPLEMENTS", "Cart", "Store"), ("IMPLEMENTS", "Cart", "Other"), ("IMPLEMENTS", "Item", "Base"), ("IMPLEMENTS", "Item", "IThing")}
    ids = {r.entity_id: r.name for r in found.collect()}
    edges = {(r.type, ids.get(r.src, r.src), ids[r.dst]) for r in parsers.declaration_edges(found).collect()}
    assert ("HAS_METHOD", "Cart", "add") in edges and ("DEFINES_CLASS", "file:A.java", "Cart") in edges and ("HAS_PROPERTY", "Item", "Id") in edges


def test_calls_are_resolved_by_name(spark):
    calls = parsers.invocations(source(spark, A__java=JAVA))
    assert ("service", "save") in {(r.receiver, r.callee) for r in calls.collect()}
    methods = spark.createDataFrame([("m1", "Save"), ("m0", "SAVE"), ("m2", "load")], "entity_id string, name string")
    assert [(r.callee, r.target) for r in parsers.resolve_calls(calls, methods).collect()] == [("save", "m0")]


def test_python(spark):
    rows = parsers.python_nodes(source(spark, a__py=PY, bad__py="def (")).collect()
    got = {(r.kind, r.name, r.owner, r.params) for r in rows}
    assert got == {("PythonModule", "", None, 0), ("PythonImport", "os", None, 0), ("PythonImport", "a.b", None, 0), ("PythonVariable", "X", None, 0), ("PythonClass", "C", None, 0), ("PythonMethod", "m", "C", 3), ("PythonFunction", "g", None, 0)}
    assert {r.path for r in rows} == {"a.py"} and [r.doc for r in rows if r.kind == "PythonClass"] == ["Doc."] and [r.calls for r in rows if r.name == "m"] == [["f"]]


def test_properties(spark):
    text = "# note\n! too\na.b = one\nc : two \\\n   more\n\nd\\:e=x=y\nbad line\n"
    rows = parsers.properties(spark.createDataFrame([("msg_de.properties", text), ("msg.properties", "k=v")], "path string, text string")).collect()
    assert {(r.locale, r.key, r.value) for r in rows} == {("de", "a.b", "one"), ("de", "c", "two more"), ("de", "d:e", "x=y"), (None, "k", "v")}


def test_gradle(spark):
    text = "include ':app', ':lib'\nplugins { id 'war'\n id 'org.springframework.boot' version '3' }\ndependencies {\n implementation project(':lib')\n  testImplementation 'a.b:c:1.0'\n}"
    rows = parsers.gradle(source(spark, build__gradle=text))
    assert {(r.what, r.scope, r.value) for r in rows.collect()} == {("module", None, ":app"), ("module", None, ":lib"), ("plugin", None, "war"), ("plugin", None, "org.springframework.boot"), ("project", "implementation", "lib"), ("dependency", "testImplementation", "a.b:c:1.0")}
    assert parsers.module_type(rows).first().type == "org.springframework.boot"


def test_markup(spark):
    text = '<%@ taglib uri="u" prefix="c" %><form action="/save"><input type="text" name="n"/><form:input path="user.name"/></form><jsp:include page="h.jsp"/><a href="/x">${user.id}</a><table>'
    rows = {(r.what, r.name, r.value) for r in parsers.markup(source(spark, p__jsp=text)).collect()}
    assert rows == {("taglib", "u", "c"), ("form", "/save", ""), ("field", "n", ""), ("binding", "user.name", ""), ("include", "h.jsp", ""), ("link", "/x", ""), ("expression", "user.id", ""), ("table", "table", "")}


def test_flows_menus_and_routes(spark):
    flow = '<flow><view-state id="a" view="v.jsp"><transition on="next" to="b"/><transition on="back" to="c"/></view-state><decision-state id="b"><if test="x.total > 5" then="c" else="a"/></decision-state><end-state id="c"/></flow>'
    rows = {(r.state, r.kind, r.event, r.target, r.otherwise) for r in parsers.web_flow(source(spark, f__xml=flow)).collect()}
    assert rows == {("a", "view-state", "next", "b", None), ("a", "view-state", "back", "c", None), ("b", "decision-state", "x.total > 5", "c", "a"), ("c", "end-state", None, None, None)}
    c = spark.range(1).select(parsers.flow_condition(F.lit("x.total > 5")).alias("c")).first().c
    assert (c.left, c.operator, c.right) == ("x.total", "greater", "5")
    menu = parsers.menu_items(source(spark, m__xml='<item id="1" label="Top"/><item id="2" parent="1" label="Sub" url="f1.html?x=1&amp;mode=edit"/>'))
    target = menu.where("id = '2'").select(parsers.menu_target(F.col("url")).alias("t")).first().t
    assert (target.flow, target.mode) == ("f1", "edit") and menu.where("parent_id is null").count() == 1
    code = source(spark, **{"App__tsx": '<Route path="/users" element={<Users />}/><Route path="/users/:id" element={<User />}/>'}).union(spark.createDataFrame([("src/pages/blog/[slug].tsx", "x"), ("src/pages/index.tsx", "x")], "path string, text string"))
    routes = parsers.code_routes(code)
    assert {(r.framework, r.route, r.component) for r in routes.collect()} == {("react", "/users", "Users"), ("react", "/users/:id", "User"), ("next", "/blog/[slug]", None), ("next", "/", None)}
    assert {(r.route, r.parent) for r in parsers.child_routes(routes).where("parent is not null").collect()} == {("/users/:id", "/users")}


def test_rules_in_java(spark):
    rows = {(r.kind, r.rule) for r in parsers.business_rules(source(spark, A__java=JAVA + "@NotNull String s;\nassertEquals(1, 2);\n")).collect()}
    assert rows == {("GuardClause", "null_check"), ("ConditionalBusinessLogic", "amount"), ("ValidationConstraint", "required"), ("TestAssertion", "assertEquals")}
    assert parsers.spring_kinds(source(spark, A__java="@RestController class A", B__java="@Service class B", C__java="class C")).count() == 2


def test_scan(spark, tmp_path):
    for p, t in (("src/a.py", "x"), ("src/a.test.ts", "x"), ("node_modules/m/i.js", "x"), ("b.java", "class B {}"), ("c.txt", "x")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    rows = files.scan(spark, str(tmp_path), "r", with_text=True).collect()
    assert {(r.path, r.name, r.ext, r.text) for r in rows} == {("src/a.py", "a.py", "py", "x"), ("b.java", "b.java", "java", "class B {}")}
    import hashlib

    assert {r.content_hash for r in rows if r.ext == "py"} == {hashlib.sha256(b"x").hexdigest()}


def test_store_and_upsert(spark, tmp_path):
    old = spark.createDataFrame([("a", "A", 1), ("b", "B", 1)], "entity_id string, kind string, v int")
    new = spark.createDataFrame([("b", "B", 2, 1), ("b", "B", 3, 2), ("c", "C", 4, 1)], "entity_id string, kind string, v int, ord int")
    merged = files.upsert_nodes(old, new, "ord")
    assert {(r.entity_id, r.v) for r in merged.collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert files.upsert_nodes(merged, new, "ord").count() == 3
    path = f"{tmp_path}/nodes"
    files.store(old, path, "kind")
    files.store(merged.where("kind = 'B'"), path, "kind")
    assert {(r.entity_id, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}
    edges = spark.createDataFrame([("r", "a", "zz")], "repo_id string, src string, dst string")
    assert {r.entity_id for r in files.with_stubs(old, edges).collect()} == {"a", "b", "zz"}


def test_incremental(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", None)], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("e", "1")], "path string, content_hash string")
    got = {r.path: r.change for r in incremental.diff_files(old, new).collect()}
    assert got == {"a": "unchanged", "b": "modified", "c": "deleted", "d": "modified", "e": "added"}
    assert {r.change for r in incremental.diff_files(old, new, force=True).where("path = 'a'").collect()} == {"modified"}
    assert {r.change for r in incremental.diff_files(old, new, old_version="1", version="2").where("path = 'a'").collect()} == {"modified"}
    listed = spark.createDataFrame([("a", "M", None), ("b", "M", None), ("e", "R", "c")], "path string, status string, old_path string")
    assert {(r.path, r.change) for r in incremental.verify_changes(listed, old, new).collect()} == {("b", "modified"), ("e", "added"), ("c", "deleted")}
    state = incremental.save_state(old, new, spark.createDataFrame([("c",)], "path string"))
    assert {(r.path, r.content_hash) for r in state.collect()} == {("a", "1"), ("b", "2"), ("d", "1"), ("e", "1")}


def test_delete_files(spark):
    n = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "entity_id string, file_path string")
    e = spark.createDataFrame([("1", "3"), ("3", "3"), ("3", "2")], "src string, dst string")
    nodes, edges = incremental.delete_files(n, e, spark.createDataFrame([("a",)], "path string"))
    assert [r.entity_id for r in nodes.collect()] == ["3"] and [(r.src, r.dst) for r in edges.collect()] == [("3", "3")]


def test_stream_resumes_and_repeats_no_batch(spark, tmp_path):
    src, out, ck = (f"{tmp_path}/{x}" for x in ("in", "out", "ck"))
    spark.range(5).write.parquet(src)
    for _ in range(2):
        incremental.ingest(incremental.stream_files(spark, src, "id long"), incremental.append_batch(out), ck).awaitTermination()
    assert spark.read.parquet(out).count() == 5
    spark.range(5, 7).write.mode("append").parquet(src)
    incremental.ingest(incremental.stream_files(spark, src, "id long"), incremental.append_batch(out), ck).awaitTermination()
    assert spark.read.parquet(out).count() == 7


def test_run_progress(spark):
    log = spark.createDataFrame([("r", "scanning", 0), ("r", "parsing", 5), ("r", "parsing", 7), ("q", "failed", None)], "run_id string, phase string, files int")
    assert {r.run_id: (r.phase, r.files, r.failed) for r in incremental.run_progress(log).collect()}["r"] == ("parsing", 12, False)


def test_files_are_found_read_and_deleted(spark, tmp_path):
    from codelattice.sources import files as stores

    (tmp_path / "src" / "deep").mkdir(parents=True)
    for name in ("src/a.ts", "src/deep/b.ts", "src/c.py"):
        (tmp_path / name).write_text(f"text of {name}")
    found = stores.find(spark, f"file://{tmp_path}", "src/**/*.ts").collect()
    assert [r.path.rsplit("/", 1)[1] for r in found] == ["a.ts", "b.ts"] and all(r.size > 0 for r in found)
    assert [r.text for r in stores.read_batch(spark, [found[0].path]).collect()] == ["text of src/a.ts"]
    path = f"file://{tmp_path}/store"
    stores.store(spark.createDataFrame([("r1", 1), ("r1", 2), ("r2", 3)], "repo_id string, id long"), path, "repo_id")
    assert stores.delete_repository(spark, path, "r1") == 2
    assert [r.id for r in spark.read.parquet(path).collect()] == [3]
    rows = spark.createDataFrame([("a", 1), (None, 2)], "repo_id string, id long")
    assert [r.id for r in stores.without(rows, "repo_id", "a").collect()] == [2]


def test_retrievals(spark):
    from codelattice.operators import retrieval

    nodes = spark.createDataFrame([
        ("m1", "JavaMethod", "save", "c1", "f1"), ("m2", "JavaMethod", "load", "c2", "f1"), ("m3", "JavaMethod", "find", "c3", "f2"), ("m4", "JavaMethod", "lone", None, None),
        ("c1", "SpringController", "OrderController", "f1", "f1"), ("c2", "JavaClass", "OrderDao", "f1", "f1"), ("c3", "JavaClass", "StringUtil", "f2", "f2"), ("t1", "SQLTable", "orders", None, None), ("f1", "File", "a.java", None, "f1"),
    ], "id string, kind string, name string, parent_id string, file string")
    edges = spark.createDataFrame([("CALLS", "m1", "m2", 4), ("CALLS", "m1", "m2", 2), ("CALLS", "m2", "m3", 7), ("CALLS", "m3", "m1", 1), ("USES_TABLE", "c2", "t1", None)], "type string, src string, dst string, line int")
    chain = retrieval.method_chain(nodes, edges, nodes.where("id = 'm1'"), 5)
    assert {(r.id, r.parent, r.depth, r.via, r.line) for r in chain.collect()} == {("m2", "OrderDao", 1, "m1", 2), ("m3", "StringUtil", 2, "m2", 7)}
    assert [(r.seed, r.holder, r.table) for r in retrieval.statements_of_chain(nodes, edges, chain).collect()] == [("m1", "c2", "t1")]
    found = {r.name: r.relationship for r in retrieval.context(nodes, edges, nodes.where("id = 'm1'"), ["lone"], beans=spark.createDataFrame([("OrderDao.x",)], "bean string")).collect()}
    assert found["OrderDao"] == "BEAN" and found["load"] == "CALLS_1" and found["find"] == "CALLS_2" and found["save"] == "CALLS_3" and found["lone"] == "NAME" and found["orders"] == "TABLE" and found["StringUtil"] == "HOLDER"
    scored = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.4), ("r", "c", 0.3)], "question string, id string, score double")
    assert {(r.question, r.id, r.role) for r in retrieval.lookup(scored).collect()} == {("q", "a", "match"), ("q", "b", "suggestion"), ("r", "c", "suggestion")}
    with pytest.raises(KeyError):
        retrieval.query_repository(nodes, edges, "nothing")
