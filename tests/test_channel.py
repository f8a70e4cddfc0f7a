"""The buffered channel against a plain fold, and features and reports on small frames."""

import random

import pytest

from codelattice.operators import features, reports
from codelattice.streaming import channel


def plain(entries, outages):
    """The rules read one by one: a list, a clock and a counter."""
    out = []
    for c in sorted({x[0] for x in entries}):
        mine = sorted((at, i) for k, i, at in entries if k == c)
        start, buffer, number, clock = mine[0][0], [], 0, 0

        def flush(at, fails):
            nonlocal buffer, number
            if buffer:
                number += 1
                logs, buffer = buffer, []
                if fails:
                    buffer = logs[-50:]
                out.append((c, number, at, len(logs), logs[0], logs[-1], not fails, len(buffer)))

        down = lambda at: any(a <= at < b for a, b in outages)
        for at, i in mine:
            while start + (clock + 1) * 2000 <= at:
                clock += 1
                flush(start + clock * 2000, down(start + clock * 2000))
            buffer.append(i)
            if len(buffer) >= 20:
                flush(at, down(at))
        flush(start + (clock + 1) * 2000, False)
    return out


@pytest.mark.parametrize("outages", [(), ((3000, 9000),), ((0, 4000), (6000, 30_000))])
def test_flushes(spark, outages):
    rng = random.Random(4)
    entries = [(rng.choice("abc"), i, int(rng.random() ** 2 * 20_000)) for i in range(600)] + [("d", 1000, 5), ("d", 1001, 5 + 2000), ("d", 1002, 90_000)]
    df = spark.createDataFrame(entries, "channel string, id long, at_ms long").repartition(4)
    got = [tuple(r) for r in channel.buffered_flushes(df, list(outages)).collect()]
    assert sorted(got) == sorted(plain(entries, outages))
    assert channel.buffered_flushes(df.limit(0)).count() == 0


def test_features(spark):
    routes = spark.createDataFrame([("f", "r1"), ("f", "r2"), ("g", "r3"), ("f", "r1")], "feature string, id string")
    edges = spark.createDataFrame([("API", "r1", "a"), ("API", "r2", "a"), ("API", "r1", "b"), ("USE", "a", "s"), ("USE", "b", "s"), ("DATA", "s", "d"), ("OTHER", "s", "x")], "type string, src string, dst string")
    found, links = features.trace_features(routes, edges, (("API",), ("USE",), ("DATA",)))
    assert {tuple(r) for r in found.collect()} == {("f", 2, 2, 1, 1, "moderate"), ("g", 1, 0, 0, 0, "simple")}
    assert links.count() == 7
    pairs = spark.createDataFrame([("a", 1, 3), ("b", 1, 2)], "artifact string, version1 int, version2 int")
    history = spark.createDataFrame([("a", 1, "no"), ("a", 3, "late"), ("a", 2, "early"), ("a", 4, "no"), ("b", 2, None)], "artifact string, version int, feedback string")
    assert {r.artifact: r.feedback for r in features.version_feedback(history, pairs).collect()} == {"a": ["early", "late"], "b": []}


def test_export(spark):
    docs = spark.createDataFrame([(1, "A<b"), (2, None)], "id int, title string")
    children = spark.createDataFrame([(1, 2, "y"), (1, 1, "x & z")], "id int, position int, text string")
    body = lambda fmt: {r.id: r.body for r in reports.export(docs, children, fmt).collect()}[1]
    assert body("md") == "# A<b\n- x & z\n- y" and body("html") == "<h1>A&lt;b</h1>\n<ul><li>x &amp; z</li><li>y</li></ul>" and body("json") == '{"title":"A<b","children":["x & z","y"]}'
    with pytest.raises(ValueError, match="pdf"):
        reports.export(docs, children, "pdf")
