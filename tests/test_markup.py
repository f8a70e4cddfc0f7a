"""Intervals, element tables, pages, menus and flows on small texts."""

import random
import time

from pyspark.sql import functions as F

from codelattice.operators import intervals, links
from codelattice.sources import elements, flows


def test_innermost_against_all_pairs(spark):
    rng = random.Random(3)
    spans = [(rng.choice("ab"), f"o{i}", a, a + rng.randint(-1, 30)) for i in range(150) for a in [rng.randint(0, 100)]]
    points = [(rng.choice("abc"), i, rng.randint(-5, 130)) for i in range(300)] + [(None, 900, 5), ("a", 901, None)]
    got = intervals.innermost(spark.createDataFrame(points, "path string, id long, at int"), spark.createDataFrame(spans, "path string, owner string, first int, last int")).collect()
    want = {}
    for path, i, at in points:
        around = [(last - first, owner) for p, owner, first, last in spans if p == path and at is not None and first <= at <= last]
        if around:
            want[i] = (min(around)[1], len(around))
    assert {r.id: (r.owner, r.depth) for r in got} == want and len(got) == len(want)


def test_innermost_is_linear_in_a_file(spark):
    """100,000 parts in one file, each holding one line, and as many nested ones."""
    n = 100_000
    outer = spark.range(n).select(F.lit("f").alias("path"), F.col("id").cast("string").alias("id"), (F.col("id") * 10).alias("start_line"), (F.col("id") * 10 + 8).alias("end_line"))
    nested = spark.range(n).select(F.lit("g").alias("path"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.col("id").alias("start_line"), (2 * n - F.col("id")).alias("end_line"))
    inner = spark.range(n).select(F.lit("f").alias("path"), "id", (F.col("id") * 10 + 3).alias("line")).union(spark.range(n).select(F.lit("g"), F.col("id") + n, F.col("id")))
    began = time.perf_counter()
    got = links.contained(inner, outer.union(nested)).where("owner = if(id < 100000, cast(id as string), concat('n', id - 100000))").count()
    assert got == 2 * n and time.perf_counter() - began < 60


PAGE = """<%-- <form> --%><div><!-- <p> --><form id=f action='a?b=1&amp;c=2' METHOD="post"><label for="x">X <b>bold</b></label><input id="x" name="n1">
<label>Around <input name="n2" required></label><table><tr><td class="label">Cell</td><td><select name="n3" title="pick"><option>One<option value="2" selected>Two</option></select></td></tr></table>
<input type="submit"><input></form></div></span><form><textarea name=n4 placeholder="a > b"></textarea></form><script>"<form><input name='z'>"</script><b><i>cross</b></i>"""


def test_elements(spark):
    files = spark.createDataFrame([("p", PAGE), ("none", None), ("empty", ""), ("text", "no tags < here >"), ("open", "<ul><li>a<li>b</ul>" * 3), ("long", "<a>" + "x" * 200_000 + "</a>" + f'<b c="{"y" * 200_000}"/>')], "path string, text string")
    found, all_tags = elements.elements(files), elements.tags(files)
    rows = found.collect()
    assert {r.key for r in rows} == {"p", "open", "long"}
    p = {r.at: r for r in rows if r.key == "p"}
    assert [p[a].tag for a in sorted(p)][:4] == ["div", "form", "label", "b"]
    form = p[2]
    assert form.parent == 1 and form.depth == 1 and form.attributes == {"id": "f", "action": "a?b=1&c=2", "method": "post"}
    assert all(r.parent == 0 or p[r.parent].at < r.at <= p[r.parent].last for r in p.values())
    assert [r.tag for r in p.values() if r.tag == "script"] == ["script"] and not any(r.attributes.get("name") == "z" for r in p.values())
    # Unclosed items hold only themselves, and so lie in the list.
    lists = [r for r in rows if r.key == "open"]
    assert len(lists) == 9 and all(r.depth == 1 and r.last == r.at for r in lists if r.tag == "li")
    assert [(r.action, r.method) for r in elements.forms(found).orderBy("form").collect()] == [("a?b=1&c=2", "POST"), ("", "GET")]
    fields = {r.name: r for r in elements.fields(found, all_tags).collect()}
    assert {n: (f.type, f.label, f.required) for n, f in fields.items()} == {"n1": ("input", "X bold", False), "n2": ("input", "Around", True), "n3": ("select", "Cell", False), "n4": ("textarea", None, False)}
    assert [tuple(o) for o in fields["n3"].options] == [("One", "One", False), ("2", "Two", True)]
    assert fields["n4"].placeholder == "a > b"
    assert [(r.type, r.value) for r in elements.submits(found, all_tags).collect()] == [("submit", None)]
    assert elements.elements(files.limit(0)).count() == 0


def test_condition_parts(spark):
    tests = ["flowScope.a == 'x'", "#{user.isAdmin()}", "!done", "a != null and b", "order.total>=10", "x.contains('y')", "flag", None, "a && b", "T(Math).abs(n) < 3", ""]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(tests)], "i int, c string").select("i", flows.condition_parts(F.col("c")).alias("p")).orderBy("i").collect()
    want = [("equals", "flowScope.a", "'x'"), ("custom", None, None), ("not", None, None), ("notEquals", "a", "null and b"), ("greaterThanOrEquals", "order.total", "10"), ("contains", None, None), ("custom", None, None), None, ("and", None, None), ("lessThan", "T(Math).abs(n)", "3"), ("custom", None, None)]
    assert [r.p and (r.p.operator, r.p.left, r.p.right) for r in got] == want
    assert got[0].p.variables == ["a", "flowScope"] and got[0].p.description == "When flowScope.a equals 'x'" and got[1].p.methods == ["user.isAdmin"] and got[1].p.is_expression
    assert got[2].p.description == "When condition is false: !done"


FLOW = """<flow><view-state id="aInquiry"><transition on="x" to="b" condition="p == 1"/><transition on="y" to="c"/></view-state>
<action-state id="b"><transition to="aInquiry"/><transition to="d" condition="q"/></action-state><view-state id="c" parent="#baseInquiry"><transition to="d" condition="r"/></view-state>
<view-state id="d"><transition to="c"/><transition to="lost"/></view-state><view-state id="never"/><end-state id="e"/><transition on="quit" to="e"/></flow>"""


def test_cyclic_flow(spark):
    files = spark.createDataFrame([("f", FLOW), ("other", "<beans/>"), ("null", None)], "path string, text string")
    found = flows.flow_elements(files)
    states = flows.flow_states(found)
    moves = flows.flow_transitions(found, states)
    defined = flows.flow_definitions(found)
    assert [tuple(r) for r in defined.collect()] == [("f", "aInquiry", ["e"], [])]
    assert {(r.source, r.event, r.target) for r in moves.collect()} == {("aInquiry", "x", "b"), ("aInquiry", "y", "c"), ("b", "default", "aInquiry"), ("b", "default", "d"), ("c", "default", "d"), ("d", "default", "c"), ("d", "default", "lost"), ("global", "quit", "e")}
    met = {r.state: (r.steps, r.via, r.conditions) for r in flows.screen_conditions(defined, moves).collect()}
    assert met == {"aInquiry": (0, None, []), "b": (1, "aInquiry", ["p == 1"]), "c": (1, "aInquiry", []), "d": (2, "b", ["p == 1", "q"]), "lost": (3, "d", ["p == 1", "q"])}
    shown = {r.screen: r for r in flows.screens(found, states, moves, defined).collect()}
    assert set(shown) == {"aInquiry", "c", "d", "never"}
    assert shown["aInquiry"].mode == "inquiry" and shown["aInquiry"].mode_source == "naming-pattern" and shown["aInquiry"].title == "A Inquiry"
    assert shown["c"].mode == "maintenance" and shown["c"].mode_source == "parent-inheritance" and shown["d"].pages == ["dEntry.jsp", "dResults.jsp"]


def test_pairs_of_a_hot_thing(spark, monkeypatch):
    from codelattice.operators import hops

    monkeypatch.setattr(hops, "PAIRED", 7)
    rows = [(i, "all") for i in range(60)] + [(i, f"k{i % 20}") for i in range(60)] + [(5, None), (1, "all")]
    got = hops.shared_dimension_pairs(spark.createDataFrame(rows, "f int, c string"), "f", "c").collect()
    assert {(r.a, r.b): r.n_shared for r in got} == {(a, b): 1 + (a % 20 == b % 20) for a in range(60) for b in range(a + 1, 60)}
