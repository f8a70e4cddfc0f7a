"""Plans and results that must hold as tables grow."""

import re

from pyspark.sql import functions as F

from codelattice.operators import traversal


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def fan(spark, first=3, second=2500):
    """Seeds o0, o1, ... with all of first parts, each with second suppliers."""
    uses = spark.range(first * 2).select(F.lit("USES").alias("type"), F.concat(F.lit("o"), (F.col("id") % 2).cast("string")).alias("src"), F.concat(F.lit("p"), F.floor(F.col("id") / 2).cast("string")).alias("dst"))
    on = spark.range(first * second).select(F.lit("DEPENDS_ON").alias("type"), F.concat(F.lit("p"), (F.col("id") % first).cast("string")).alias("src"), F.concat(F.lit("s"), F.floor(F.col("id") / first).cast("string")).alias("dst"))
    return uses.union(on)


def test_walks_are_not_shuffled_one_by_one(spark):
    seeds = spark.createDataFrame([("o0",), ("o1",), ("none",)], "id string")
    got = traversal.count_walks(fan(spark), seeds, 0, 2)
    assert not re.search(r"hashpartitioning\(seed#\d+, (id|to)#\d+", plan(got))
    rows = {(r.seed, r.id): r.n for r in got.collect()}
    assert len(rows) == 3 + 2 * 3 + 2 * 2500
    assert rows["o1", "s2499"] == 3 and rows["o0", "p2"] == 1 and rows["none", "none"] == 1


def test_traces_are_not_shuffled_pair_by_pair(spark, tmp_path, monkeypatch):
    from codelattice.plans import graph_queries, link_queries, registry  # noqa: F401

    e = fan(spark)
    calls = spark.createDataFrame([("CALLS", "o0", "c0"), ("CALLS", "o1", "c0"), ("CALLS", "o9", "c1")], "type string, src string, dst string")
    e = e.unionByName(calls).unionByName(spark.createDataFrame([("USES", "o2", "alone")], "type string, src string, dst string"))
    n = spark.createDataFrame([(f"o{i}", "Order") for i in range(4)], "id string, kind string")
    monkeypatch.setattr(graph_queries, "nodes", lambda *_: n)
    monkeypatch.setattr(graph_queries, "edges", lambda *_: e)
    got = registry.QUERIES["r13_feature_trace"](spark, "")
    assert [tuple(r) for r in got.collect()] == [("c0", 2, 3, 2500)]
    flow = registry.QUERIES["r14_flow_by_layer"](spark, "")
    assert sorted(tuple(r) for r in flow.collect()) == [("o0", 3, 2500), ("o1", 3, 2500), ("o2", 1, 0), ("o3", 0, 0)]
    for df, by, end in ((got, "customer", "s"), (flow, "o", "sup")):
        assert not re.search(rf"hashpartitioning\({by}#\d+, {end}#\d+", plan(df))


def test_owner_of_tied_lines_is_the_first_in_the_table(spark, tmp_path):
    import duckdb

    from codelattice.plans import code_graph

    rows = ", ".join(f"({o}, {p}, {s}, 1)" for p in range(40) for o, s in ((2, 9), (1, 7 - p % 5), (1, p % 3), (1, 5)))
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"copy (select * from (values {rows}) x(l_orderkey, l_partkey, l_suppkey, l_linenumber)) to '{tmp_path}/lineitem.parquet' (format parquet)")
    want = con.execute(f"select l_partkey, arg_min(l_suppkey, l_orderkey * 10 + l_linenumber) from '{tmp_path}/lineitem.parquet' group by 1 order by 1").fetchall()
    got = code_graph._owners(spark.read.parquet(f"{tmp_path}/lineitem.parquet"), "k").orderBy("k").collect()
    assert [tuple(r) for r in got] == want == [(p, 7 - p % 5) for p in range(40)]


def test_lines_without_a_supplier_or_key_own_nothing(spark, tmp_path):
    import duckdb

    from codelattice.plans import code_graph

    con = duckdb.connect()
    con.execute("set threads = 1")
    rows = "(1, 1, NULL, 1), (2, 1, 8, 1), (3, 1, 9, 1), (NULL, 2, 4, 1), (5, 2, 6, NULL), (9, 2, 7, 2), (1, 3, NULL, 1), (NULL, 4, 3, 1), (1, NULL, 5, 1)"
    con.execute(f"copy (select * from (values {rows}) x(l_orderkey, l_partkey, l_suppkey, l_linenumber)) to '{tmp_path}/lineitem.parquet' (format parquet)")
    want = con.execute(f"select l_partkey, arg_min(l_suppkey, l_orderkey * 10 + l_linenumber) from '{tmp_path}/lineitem.parquet' group by 1").fetchall()
    got = code_graph._owners(spark.read.parquet(f"{tmp_path}/lineitem.parquet"), "k").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) == [(1, 8), (2, 7), (3, None), (4, None), (None, 5)]


def test_calls_through_a_common_type_are_summed_once(spark):
    from codelattice.operators import types

    n = 3000
    closure = types.supertype_closure(spark.range(n).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("sub"), F.lit("Base").alias("super")))
    methods = spark.range(n).select(F.concat(F.lit("T"), F.col("id").cast("string"), F.lit(".act/0")).alias("id"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("type"), F.lit("act").alias("name"), F.lit(0).alias("arity"), F.lit(True).alias("has_body"))
    calls = spark.range(n).select(F.col("id").alias("call"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("src"), F.lit("Base").alias("receiver_type"), F.lit("act").alias("name"), F.lit(0).alias("arity"))
    more = spark.createDataFrame([(-1, "m0", "T7", "act", 0), (-2, "two", "T7", "act", 0), (-3, "two", "T8", "act", 0), (-4, "lost", "Base", "never", 0)], calls.schema)
    got = types.summed_targets(calls.union(more), closure, methods, F.count("target").alias("n"), F.min("target").alias("least"))
    rows = {r.src: (r.n, r.least) for r in got.collect()}
    assert len(rows) == n + 1 and rows["m5"] == rows["m0"] == (n, "T0.act/0") and rows["two"] == (2, "T7.act/0")


def test_reached_values_make_no_row_for_each_target_of_each_call(spark):
    from codelattice.operators import types
    from codelattice.plans import java_queries, registry  # noqa: F401

    n = 1500
    name = lambda p, c="id": F.concat(F.lit(p), F.col(c).cast("string"))
    closure = types.supertype_closure(spark.range(n).select(name("T").alias("sub"), F.lit("Base").alias("super")))
    act = spark.range(n).select(F.concat(name("T"), F.lit(".act/0")).alias("id"), name("T").alias("type"), F.lit("act").alias("name"), F.lit(0).alias("arity"), F.lit(True).alias("has_body"))
    own = spark.range(n).select(F.concat(F.lit("Deep.run"), F.col("id").cast("string"), F.lit("/0")).alias("id"), F.lit("Deep").alias("type"), name("run").alias("name"), F.lit(0).alias("arity"), F.lit(True).alias("has_body"))
    said = lambda receiver, called: spark.range(n).select(name("m").alias("src"), F.lit(receiver).alias("receiver_type"), called.alias("name"), F.lit(0).alias("arity"))
    calls = said("Base", F.lit("act")).union(said("Deep", name("run"))).union(said("Base", F.lit("never"))).union(said(None, F.lit("act")))
    value = F.regexp_replace(F.regexp_extract("target", r"\.(\w+)/", 1), r"\d+$", "")
    got = types.reached_values(calls, closure, act.union(own), value)
    rows = got.collect()
    assert sorted(map(tuple, rows)) == sorted((f"m{i}", x) for i in range(n) for x in ("act", "run"))
    shown = plan(registry.QUERIES["r4_chain_through_types"](spark, "/root/testdata/sf0.001"))
    assert not any(re.search(rf"hashpartitioning\({by}#\d+, target#", p) for by in ("src", "made_id") for p in (plan(got), shown))


def test_lists_of_numbers_hold_two_bytes_an_end(spark, monkeypatch):
    from codelattice.operators import hops
    from codelattice.plans import registry  # noqa: F401

    monkeypatch.setattr(hops, "LISTED", 400)
    few = spark.range(1500).select(F.concat(F.lit("p"), (F.col("id") % 2).cast("string")).alias("src"), F.concat(F.lit("s"), F.floor(F.col("id") / 2).cast("string")).alias("dst"))
    far = spark.range(40000).select(F.lit("all").alias("src"), F.concat(F.lit("z"), F.col("id").cast("string")).alias("dst"))
    more = spark.createDataFrame([("p0", "s1"), ("p0", None), ("none", None), ("two", "s0"), ("two", "z9999")], "src string, dst string")
    lists = hops.number_lists(few.union(far).union(more))
    rows = lists.collect()
    assert max(r.n_ends for r in rows) == 400 and sum(r.n_ends for r in rows) == 1500 + 40000 + 2
    assert [(r.near, r.far, r.n_ends) for r in rows if r["at"] == "none"] == [(None, None, 0)]
    assert [(r.near is None, r.far) for r in rows if r["at"] == "two"] == [(True, [0, 750 + 39999])]
    assert dict(lists.dtypes)["near"] == "array<smallint>" and all(r.far is None for r in rows if r["at"] not in ("two", "none"))
    got = hops.dealt_numbers(lists, "at", "n").groupBy("at").agg(F.count("*").alias("c"), F.count_distinct("n").alias("d"), F.min("n").alias("least"), F.max("n").alias("most")).collect()
    assert {r["at"]: tuple(r)[1:] for r in got} == {"p0": (750, 750, 0, 749), "p1": (750, 750, 0, 749), "all": (40000, 40000, 750, 40749), "two": (2, 2, 0, 40749)}


def test_traces_and_flows_shuffle_numbers_and_count_parts_without_suppliers(spark, monkeypatch):
    from codelattice.operators import hops
    from codelattice.plans import graph_queries, link_queries, registry  # noqa: F401

    calls = spark.createDataFrame([("CALLS", "o0", "c0"), ("CALLS", "o1", "c1"), ("USES", "o2", "p0"), ("USES", "o1", "p1"), ("DEPENDS_ON", "p1", None)], "type string, src string, dst string")
    e = fan(spark).where("src <> 'o1'").unionByName(calls)
    monkeypatch.setattr(graph_queries, "edges", lambda *_: e)
    monkeypatch.setattr(graph_queries, "nodes", lambda *_: spark.createDataFrame([("o0", "Order"), ("o1", "Order")], "id string, kind string"))
    monkeypatch.setattr(hops, "end_lists", None)  # names of suppliers are in no list
    assert sorted(map(tuple, registry.QUERIES["r13_feature_trace"](spark, "").collect())) == [("c0", 1, 3, 2500), ("c1", 1, 1, 2500)]
    assert sorted(map(tuple, registry.QUERIES["r14_flow_by_layer"](spark, "").collect())) == [("o0", 3, 2500), ("o1", 1, 2500)]
    e = e.where("not (src = 'p1' and dst is not null)")
    assert sorted(map(tuple, registry.QUERIES["r13_feature_trace"](spark, "").collect())) == [("c0", 1, 3, 2500), ("c1", 1, 1, 0)]


def test_a_path_is_written_without_its_text(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(traversal, "cut", lambda df, name, real=traversal.cut: written.setdefault(name, df.columns) and real(df, name))
    seeds = spark.createDataFrame([("o0",)], "id string")
    got = traversal.paths(fan(spark), seeds, 2).select("seed", "id", "node_text", "type_text")
    assert written["paths"] == ["nodes", "types", "said"] and got.count() == 3 + 3 * 2500


def test_lists_of_ends_are_dealt_out_once(spark, monkeypatch):
    from codelattice.operators import hops

    shown = []
    monkeypatch.setattr(hops, "cut", lambda df, name, real=hops.cut: (shown.append(plan(df)), real(df, name))[1])
    assert hops.end_lists(fan(spark)).agg(F.sum("n_ends")).first()[0] == 6 + 7500
    assert shown[0].count("Exchange") == 1


def test_labels_meet_the_texts_once(spark):
    from codelattice.sources import elements

    text = (
        "<label for=a>out</label><form><label for=a> For <b>a</b></label><label for=a>second</label><label for=b></label><label>Around <input id=b name=b aria-label=x></label>"
        "<label for=b></label><input name=c aria-label=Aria><span class='a label'>Before</span><input name=d><i>no</i><input name=e><input id=a name=f>"
        "<table><tr><td class=label>Cell</td><td><select name=g><option value=1>One<option selected> Two </option></select></td><td><textarea name=h></textarea></td></tr></table>"
        "<span class=label></span><input name=i><input></form><input name=lost>"
    )
    files = spark.createDataFrame([("p", text), ("q", text), ("r", None)], "path string, text string")
    found, tags = elements.elements(files), elements.tags(files)
    got = elements.fields(found, tags)
    assert plan(got).count("MapInPandas") == 2
    rows = {r.name: (r.label, r.type) for r in got.where("key = 'q'").collect()}
    assert rows == {"b": ("Around", "input"), "c": ("Aria", "input"), "d": ("Before", "input"), "e": (None, "input"), "f": ("For a", "input"), "g": ("Cell", "select"), "h": (None, "textarea"), "i": (None, "input")}
    chosen = [r.options for r in got.where("name = 'g'").collect()]
    assert len(chosen) == 2 and [tuple(x) for x in chosen[0]] == [("1", "One", False), ("Two", "Two", True)]
    assert got.where("options is not null").count() == 2 and got.count() == 16


def test_a_file_of_many_classes_is_read_in_parts(spark):
    from codelattice.plans import java_queries
    from codelattice.plans.sample_graph import table
    from codelattice.sources import java_blocks

    suppliers = spark.createDataFrame([(k, k % 2) for k in range(1, 13)] + [(13, None), (12, 0)], "s_suppkey long, s_nationkey int")
    frames = {"supplier": suppliers, "part": spark.range(40).select(F.col("id").alias("p_partkey")), "region": table(spark, "/root/testdata/sf0.001", "region")}
    rows = [tuple(r) for r in java_queries.java_files(frames.__getitem__).where("path <> 'Common.java'").collect()]
    parts = sorted((path.split("#")[0], int(path.split("#")[1]), text) for path, text in rows)
    assert len(parts) == 13 and {(k, text.count("public class Unit")) for _, k, text in parts} == {(k, 2 if k == 12 else 1) for k in range(1, 14)}
    whole = {f: "\n".join(text for g, _, text in parts if g == f) for f in ("n0.java", "n1.java")}
    assert all(text.startswith(f"package p.{f[:2]};\nimport") and text.count("Ghost") == 1 for f, text in whole.items())
    at = ("kind", "name", "owner", "qualified", "overload", "params", "annotations", "throws", "snippet")

    def held(files):
        out = java_blocks.members(java_blocks.blocks(files), files).select(java_queries._file(), *at, (F.col("last_line") - F.col("start_line")).alias("lines")).collect()
        return sorted((r for r in out if r["path"] in whole and r["owner"] != "Unit12" and r["name"] != "Unit12"), key=str)

    cut_up = spark.createDataFrame(rows, "path string, text string")
    one = spark.createDataFrame(list(whole.items()), "path string, text string")
    assert held(cut_up) == held(one) and len(held(one)) > 100


def test_elements_are_not_sorted(spark):
    from codelattice.sources import elements

    files = spark.createDataFrame([(f"p{i}", "<ul>" + f"<li><a x={i}>t</a></li></b><br/>" * (20 * i) + "</ul>") for i in range(80)], "path string, text string")
    found = elements.elements(files)
    assert "Sort" not in plan(found) and "Window" not in plan(found) and plan(found).count("Exchange") == 1
    got = {(r["key"], r["tag"]): (r.n, r.d, r.w) for r in found.groupBy("key", "tag").agg(F.count("*").alias("n"), F.max("depth").alias("d"), F.max(elements.inside("ul")).alias("w")).collect()}
    assert got["p79", "a"] == (1580, 2, 1) and got["p79", "br"] == (1580, 1, 1) and got["p3", "li"] == (60, 1, 1) and got["p0", "ul"] == (1, 0, None)
    assert len(got) == 79 * 4 + 1


def test_a_long_flow_is_walked_in_one_shuffle(spark):
    from codelattice.sources import flows

    moves = spark.createDataFrame([("f", f"s{i}", f"s{i + 1}", "next", i, f"c{i}" if i % 2 else None) for i in range(300)] + [("f", "s300", "s0", "back", 300, None), ("f", "global", "s5", "x", 301, None), ("g", "a", "b", "e", 1, "later"), ("g", "a", "b", "d", 2, "first")],
                                  "key string, source string, target string, event string, at int, condition string")
    defined = spark.createDataFrame([("f", "s0"), ("g", "a"), ("h", "lone")], "key string, start_state string")
    met = flows.screen_conditions(defined, moves)
    assert plan(met).count("Exchange") == 1
    rows = {(r["key"], r.state): (r.steps, r.via, r.conditions) for r in met.collect()}
    assert len(rows) == 301 + 2 + 1 and rows["f", "s4"] == (4, "s3", ["c1", "c3"]) and rows["f", "s300"][0] == 300
    assert rows["g", "b"] == (1, "a", ["first"]) and rows["h", "lone"] == (0, None, [])


def test_rank_ends_once_nothing_changes(spark, monkeypatch):
    from codelattice.operators import ranking

    written = []
    monkeypatch.setattr(ranking, "cut", lambda df, name, real=ranking.cut: (written.append(name), real(df, name))[1])
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    chain = spark.createDataFrame([("CALLS", "a", "b"), ("CALLS", "a", "c"), ("CALLS", "b", "c"), ("CALLS", "c", "out"), ("CALLS", "in", "d")], "type string, src string, dst string")
    got = {r.id: round(r.rank, 9) for r in ranking.pagerank(nodes, chain).collect()}
    assert got == {"a": 0.15, "b": 0.21375, "c": round(0.15 + 0.85 * (0.075 + 0.21375), 9), "d": 0.15}
    assert written.count("rank-change") == 3
    ring = spark.createDataFrame([("CALLS", "a", "b"), ("CALLS", "b", "a")], chain.schema)
    rank = 0.15
    for _ in range(4):
        rank = 0.15 + 0.85 * rank
    assert {r.id: round(r.rank, 9) for r in ranking.pagerank(nodes, ring, rounds=4).collect()} == {"a": round(rank, 9), "b": round(rank, 9), "c": 0.15, "d": 0.15}


def test_reached_nodes_are_counted_without_their_pairs(spark):
    back = fan(spark).select("type", F.col("dst").alias("src"), F.col("src").alias("dst"))
    more = spark.createDataFrame([("USES", "p0", "o9"), ("USES", "o9", "p0"), ("X", "s0", "s0")], "type string, src string, dst string")
    e = back.unionByName(more)
    seeds = e.select(F.col("src").alias("id")).unionByName(spark.createDataFrame([("none",), ("s1",)], "id string"))
    for high, types in ((1, ()), (2, ()), (3, ()), (3, ("USES", "DEPENDS_ON"))):
        got = traversal.count_reached(e, seeds, high, types=types)
        assert not re.search(r"hashpartitioning\(seed#", plan(got))
        want = traversal.reach(e, seeds, 1, high, types=types).groupBy("seed").count().collect()
        assert len(want) > 64 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    assert traversal.count_reached(e.where("false"), seeds, 3).collect() == []


def test_tasks_of_the_distinct_pairs_hold_so_many_lines(spark, monkeypatch):
    from codelattice.plans import sample_graph

    folder = "/root/testdata/sf0.001"
    e = sample_graph.edges(spark, folder)
    before = sorted(map(tuple, e.collect()))
    lines = sample_graph.table(spark, folder, "lineitem")
    monkeypatch.setattr(sample_graph, "PAIRED", 500)
    e = sample_graph.edges(spark, folder)
    for a, b in (("l_orderkey", "l_partkey"), ("l_partkey", "l_suppkey")):
        assert re.search(rf"hashpartitioning\({a}#\d+L, {b}#\d+L, {lines.count() // 500 + 1}\), REPARTITION_BY_NUM", plan(e))
    assert sorted(map(tuple, e.collect())) == before
    assert len(before) == len(set(before)) and sum(r[0] == "USES" for r in before) == lines.select("l_orderkey", "l_partkey").distinct().count()


def test_stereotypes_are_spread_and_compile_no_pattern_a_row(spark):
    from codelattice.operators import classify
    from codelattice.plans import code_queries, registry  # noqa: F401

    shown = plan(registry.QUERIES["d_stereotypes"](spark, "/root/testdata/sf0.001"))
    assert "REPARTITION_BY_NUM" in shown and re.search(r"RLIKE\([^,]*, \(Controller\)\$", shown)
    rows = [("A", None, None, None, None), (None, ["@Service"], None, None, None), ("XService", [None], [], ["GETAll", None], None), ("x", [], ["MyController"], None, ["ID"]), ("UserDTO", ["x@DataX", None], None, ["", None], [None])]
    df = spark.createDataFrame(rows, "name string, a array<string>, i array<string>, m array<string>, f array<string>")
    got = df.select(classify.stereotype_of(*(F.col(c) for c in ("name", "a", "i", "m", "f"))).alias("s")).select("s.*").collect()
    assert [(r[0], round(r[1], 6)) for r in got] == [("Unknown", 0.0), ("Service", 0.9), ("Service", 0.8), ("Controller", 0.6), ("DTO", 0.88)]


def test_flow_queries_write_only_what_they_read_again(spark, monkeypatch):
    from codelattice.plans import registry, web_queries

    written, cut = [], web_queries.cut
    monkeypatch.setattr(web_queries, "cut", lambda df, name: written.append(name) or cut(df, name))
    for name in ("s16_states", "s16_transitions", "s16_screens", "d_flow_rules"):
        written.clear()
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert written == ["flows"], name


def test_tags_are_matched_whole_once(spark):
    from codelattice.sources import elements

    text = "<a:B-c x=\"1 > 2\" y='&lt;\"' z=\"\" w=p&amp;q v Z='2'>é\U0001F600 > t\n</A:b-C >\n<i/>"
    df = spark.createDataFrame([(1, text), (2, None), (3, "no <1 tag")], "path long, text string")
    got = elements.tags(df)
    assert plan(got).count("(?s)^<(/?)") <= 1
    rows = [tuple(r)[1:] for r in got.orderBy("at").collect()]
    assert rows == [(1, False, "a:b-c", " x=\"1 > 2\" y='&lt;\"' z=\"\" w=p&amp;q v Z='2'", "é\U0001F600 > t\n", False), (2, True, "a:b-c", " ", "\n", False), (3, False, "i", "/", "", True)]
    assert elements.elements(df).where("at = 1").first().attributes == {"x": "1 > 2", "y": '<"', "z": "", "w": "p&q", "v": ""}


def test_paths_in_words_need_no_lists_of_the_longest(spark):
    e = spark.createDataFrame([("T", "a", "b"), (None, "b", "c"), ("U", "c", "a"), ("", "c", "d"), ("V", "a", None), (None, "a", "c")], "type string, src string, dst string")
    seeds = spark.createDataFrame([("a",), ("b",)], "id string")
    for high in (1, 2, 3):
        got = traversal.paths(e, seeds, high)
        rows = got.collect()
        assert len(rows) == (3, 7, 8)[high - 1]
        assert all(r.node_text == ">".join(r.nodes) and r.type_text == ">".join(t for t in r.types if t is not None) for r in rows)
    assert "array_append" not in plan(got.where(F.col("depth") == 3).select("seed", "node_text", "type_text"))


def test_elements_of_some_names_are_those_of_all(spark):
    from codelattice.sources import elements

    text = "<A ID='&lt;1&amp;lt;'><b/ ><c id=x>t<b>u</A>v<a><c></C ></b><d/>w</c><b id><e></a></e><c>\n</d><b x='>' y=\"</a>\" x=2 / >"
    files = spark.createDataFrame([("p", text), ("q", None), ("r", "no <1 tag"), ("s", text * 3), (None, text)], "path string, text string")
    every = elements.elements(files)
    holder = F.greatest(elements.inside("a"), elements.inside("c"))
    rows = every.select("key", "at", "last", "tag", "parent", "depth", F.array_sort(F.map_entries("attributes")).alias("x"), "text", F.array_sort(F.map_entries("within")).alias("w"), holder.alias("owner"))
    whole = {(r["key"], r["at"]): r for r in rows.collect()}
    assert [(r["at"], r.tag, r.text) for r in every.where("key = 'p'").orderBy("at").collect()] == [(r["at"], r.tag, r.text) for r in elements.tags(files).where("key = 'p' and not closing").orderBy("at").collect()]
    some = elements.elements(files, only=("b", "e"), owners=("a", "c"))
    got = some.select("key", "at", "last", "tag", "parent", "depth", F.array_sort(F.map_entries("attributes")).alias("x"), "text", F.array_sort(F.map_entries("within")).alias("w"), "owner").collect()
    assert sorted(got, key=str) == sorted((r for r in whole.values() if r.tag in ("b", "e")), key=str)
    ids = {(r["key"], r["at"]): r.attributes.get("id") for r in every.collect()}
    assert all(r["owner_name"] == (None if r.owner is None else ids[r["key"], r.owner]) for r in some.collect())
    assert ids["p", 1] == "<1&lt;" and whole["p", 2].tag == "b" and len(got) == 5 * 4 + 1 * 5


def test_transitions_are_read_in_one_pass(spark, monkeypatch):
    from codelattice.plans import registry, web_queries  # noqa: F401
    from codelattice.sources import flows

    written = []
    monkeypatch.setattr(flows, "cut", lambda df, name, real=flows.cut: written.append(name) or real(df, name))
    got = registry.QUERIES["s16_transitions"](spark, "/root/testdata/sf0.001")
    assert not written and "Join" not in plan(got) and plan(got).count("MapInArrow") == 1
    assert registry.QUERIES["s16_state_graph"](spark, "/root/testdata/sf0.001").count() and not written


def test_flow_rules_join_nothing_and_look_an_expression_up_twice(spark):
    from codelattice.operators import rules
    from codelattice.plans import java_queries, registry  # noqa: F401
    from codelattice.sources import flows

    shown = plan(registry.QUERIES["d_flow_rules"](spark, "/root/testdata/sf0.001"))
    assert "Join" not in shown and "Contains(lower" not in shown
    said = ("Price.up()", "a.isVALID(b)", "zzz", "", "TAX")
    flow = '<flow><decision-state id="d"><if test="t" then="v"/></decision-state><view-state><if test="u" then="w"/>' + "".join(f'<evaluate expression="{x}"/>' for x in said) + "</view-state><if test='x' then='y'/></flow>"
    found = flows.flow_elements(spark.createDataFrame([("f", flow)], "path string, text string"), only=(*flows.MOVES, *rules.FLOW_TAGS))
    got = rules.flow_rules(found, None, flows.flow_transitions(found))
    assert "Join" not in plan(got) and plan(got).count("amount|price") <= 2
    assert sorted((r.kind, r.rule, r.confidence, r.holder) for r in got.collect()) == [
        ("BusinessRule", "Price.up()", 0.75, "unknown"), ("BusinessRule", "TAX", 0.75, "unknown"), ("BusinessRule", "a.isVALID(b)", 0.9, "unknown"), ("ConditionalBusinessLogic", "If t then go to v", 0.9, "d")]


def test_depths_hold_no_share_of_all_edges(spark, monkeypatch):
    shown = []
    monkeypatch.setattr(traversal, "cut", lambda df, name, real=traversal.cut: (shown.append((name, plan(df))), real(df, name))[1])
    e = fan(spark).unionByName(fan(spark))
    seeds = spark.createDataFrame([("s7",), ("s7",), ("none",)], "id string")
    got = traversal.depths(e, seeds, 5, reverse=True)
    assert sorted(map(tuple, got.collect())) == [("none", 0), ("o0", 2), ("o1", 2), ("p0", 1), ("p1", 1), ("p2", 1), ("s7", 0)]
    edges = [p for name, p in shown if name == "edges"]
    assert len(edges) == 1 and "Aggregate" not in edges[0] and "Exchange" not in edges[0]
