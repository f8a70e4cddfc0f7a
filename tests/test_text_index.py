"""The stored index against one made anew."""

import random


from codelattice.operators import search
from codelattice.operators.text_index import TextIndex


def test_stored_index(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(words[int(60 * rng.random() ** 3)] for _ in range(rng.randint(0, 40)))
    docs = {f"d{i}": (rng.choice("ab"), text()) for i in range(200)} | {"null": (None, None), "empty": ("a", ""), "long": ("b", "w1 " * 5000 + "w59")}
    questions = spark.createDataFrame([(1, "w0 w1 w40"), (2, "w59 w58"), (3, "nothing here"), (4, " ".join(words)), (5, None), (6, "w0")], "question int, text string")
    index = TextIndex(spark, str(tmp_path / "index"), buckets=8)

    def frame(d):
        return spark.createDataFrame([(i, s, t) for i, (s, t) in d.items()], "id string, scope string, text string")

    def check():
        df = frame(docs)
        for most in (3, 20):
            got = {(r.question, r.id): round(r.score, 6) for r in index.search(questions, most).collect()}
            assert got == {(r.question, r.id): round(r.score, 6) for r in search.bm25_top(df, questions, most=most).collect()}
        by = {}
        full = search.bm25_top(df, questions, most=10**6).join(df.select("id", "scope"), "id").collect()
        for r in full:
            by.setdefault((r.question, r.scope), []).append((-round(r.score, 9), r.id))
        want = {(q, s, i): n + 1 for (q, s), x in by.items() for n, (_, i) in enumerate(sorted(x)[:4])}
        assert {(r.question, r.scope, r.id): r["rank"] for r in index.search(questions, 4, by_scope=True).collect()} == want

    assert index.update(frame(docs)) == {"indexed": len(docs), "unchanged": 0, "deleted": 0}
    check()
    for i in range(0, 200, 17):
        docs[f"d{i}"] = ("a", text())
    docs["new"] = ("b", "w59 w59 w3")
    gone = [f"d{i}" for i in range(1, 200, 29)]
    for i in gone:
        del docs[i]
    told = index.update(frame(docs), spark.createDataFrame([(i,) for i in [*gone, "never"]], "id string"))
    assert told["deleted"] == len(gone) and told["indexed"] + told["unchanged"] == len(docs) and 1 < told["indexed"] <= 14
    check()
    assert index.compact() > 0 and index.stale().count() == 0
    check()
    assert index.update(frame(docs)) == {"indexed": 0, "unchanged": len(docs), "deleted": 0}
    plan = index.search(questions.where("question = 6"), 2)
    assert plan.count() == 2 and TextIndex(spark, str(tmp_path / "none")).search(questions).count() == 0
