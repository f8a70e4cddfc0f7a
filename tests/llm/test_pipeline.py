import collections
import hashlib
import re
import string

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from codelattice.llm.common import cut, row_key
from codelattice.llm.toxicity import label_model, score_toxicity


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """Tables with the small corpus, toxic documents among it, labels and a benchmark."""
    d = str(tmp_path_factory.mktemp("tables"))
    insults = ["idiot moron", "stupid clown", "pathetic trash", "worthless scum", "disgusting loser"]
    toxic = [(1000 + i, " ".join(["abc def ghi jk", insults[i % 5], f"w{i} zz{i * 7}", insults[(i * 3 + 1) % 5], f"end{i} of{i} it{i}"]), "en", "t", 50, 7, 0.5, "own") for i in range(80)]
    every = docs.union(docs.sparkSession.createDataFrame(toxic, docs.schema))
    every.write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 90)] + [(1000 + i, 0, 1) for i in range(0, 60)] + [(None, 1, 1), (3, None, None), (1001, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    text = docs.where("doc_id = 12").first().text
    spark.createDataFrame([(1, " ".join(text.split()[:12])), (2, "never there at all in any of these")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_toxicity(spark, folder, empty):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    import zlib

    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.predicted == (r.doc_id is not None and r.doc_id >= 1000), r
    assert score_toxicity(empty, labels).count() == 0
    unlabelled = score_toxicity(docs, labels.limit(0)).collect()
    mean = lambda x: sum(x) / len(x)
    toxic = [r.score for r in unlabelled if r.doc_id is not None and r.doc_id >= 1000]
    assert mean(toxic) > 0.5 > mean([r.score for r in unlabelled if r.doc_id is not None and r.doc_id < 1000])


def test_labels_of_held_out_rows_are_not_read(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda x: sorted((str(r.doc_id), r.score) for r in score_toxicity(docs, x).collect())
    assert score(labels) == score(flipped)


def test_ids_are_no_input_of_a_score(spark, folder):
    """Equal texts have equal scores, and other ids for rows without a label change no score."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    copies = docs.where("doc_id between 1000 and 1040").withColumn("doc_id", F.col("doc_id") + 5000)
    every = docs.union(copies).union(copies.withColumn("doc_id", F.col("doc_id") * 3)).repartition(5)
    by_text = collections.defaultdict(set)
    rows = score_toxicity(every, labels).join(every.select(row_key("doc_id", "text").alias("row_key"), "text").distinct(), "row_key").collect()
    for r in rows:
        by_text[r.text].add(r.score)
    assert sum(len(x) for x in by_text.values()) == len(by_text) > 100
    marked = {r.doc_id for r in labels.collect()}
    every = every.where("doc_id is not null")
    other = every.withColumn("doc_id", F.when(F.col("doc_id").isin([x for x in marked if x is not None]), F.col("doc_id")).otherwise(F.col("doc_id") * 11 + 100_003))
    score = lambda d: collections.Counter(r.score for r in score_toxicity(d, labels).collect())
    assert score(other) == score(every)


def test_label_model_tells_good_voters_from_bad():
    import numpy as np

    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    v = np.stack([np.where(y, rng.random(4000) < p, rng.random(4000) < q) for p, q in ((0.9, 0.02), (0.8, 0.05), (0.7, 0.05), (0.5, 0.5))], 1).astype(int)
    none = np.zeros((4000, 3))
    none[:, 0] = 1
    assert ((label_model(v, none)[:, 0] > 0) == y).mean() > 0.95
    said = np.where(rng.random(4000) < 0.3, 1 + y, 0)  # a third has a label
    logit = label_model(v, np.eye(3)[said])
    assert ((logit[np.arange(4000), said] > 0) == y).mean() > 0.96


def test_label_model_against_loops_over_rows():
    import math

    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.integers(0, 2, (7, 3))
    counts = rng.integers(0, 6, (7, 3))
    rows = [(list(map(int, v[i])), s) for i in range(7) for s in range(3) for _ in range(counts[i, s])]
    most = max(sum(x) for x, _ in [(list(r), 0) for r in v])
    post = [(min(0.95, max(0.02, sum(x) / max(most, 1))), 0.02, 0.98)[s] for x, s in rows]
    for _ in range(3):
        w = {1: post, 0: [1 - p for p in post]}
        rate = {c: [(sum(a * x[k] for a, (x, _) in zip(w[c], rows, strict=True)) + (1 if c else 0.5)) / (sum(w[c]) + (2 if c else 20)) for k in range(3)] for c in (0, 1)}
        share_of = []
        for k in range(3):
            total = 0.0
            for j in range(3):
                for c in (0, 1):
                    cov = lambda m, n, c=c: sum(a * (x[m] - rate[c][m]) * (x[n] - rate[c][n]) for a, (x, _) in zip(w[c], rows, strict=True)) / max(sum(w[c]), 1)
                    total += min(1, max(0, cov(k, j) / math.sqrt(max(cov(k, k), 1e-9) * max(cov(j, j), 1e-9)))) / 2
            share_of.append(1 / max(total, 1))
        said = {c: (sum(a for a, (_, s) in zip(w[c], rows, strict=True) if s == 2) + (10 if c else 1)) / (sum(a for a, (_, s) in zip(w[c], rows, strict=True) if s) + 11) for c in (0, 1)}
        prior = min(0.5, max(1e-4, (sum(post) + 1) / (len(rows) + 2)))

        def logit(x, s, rate=rate, share_of=share_of, said=said, prior=prior):
            out = math.log(prior / (1 - prior))
            for k in range(3):
                p, q = rate[1][k], rate[0][k]
                out += share_of[k] * (math.log(p / q) if x[k] else math.log((1 - p) / (1 - q)))
            return out + (0, math.log((1 - said[1]) / (1 - said[0])), math.log(said[1] / said[0]))[s]

        post = [1 / (1 + math.exp(-max(-30, min(30, logit(x, s))))) for x, s in rows]
    want = [[logit(list(map(int, x)), s) for s in range(3)] for x in v]
    assert np.allclose(label_model(v, counts, rounds=3), want, atol=1e-9)


def test_scores_against_plain_python(spark, folder, monkeypatch):
    """Votes and scores worked out text by text from the stems and weights that were learned."""
    import math
    import re

    from codelattice.llm import toxicity as t

    seen = {}
    keep = lambda name, f: lambda *x, **y: seen.setdefault(name, f(*x, **y))
    monkeypatch.setattr(t, "learn_stems", keep("stems", t.learn_stems))
    monkeypatch.setattr(t, "fit_classifier", keep("model", t.fit_classifier))
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    docs = docs.union(docs.where("doc_id in (5, 1003)")).union(spark.createDataFrame([(5000, "idiot! " * 30_000, "en", "t", 1, 7, 0.5, "own")], docs.schema))
    got = t.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    folds = {(r.doc_id, r.text): r.fold for r in docs.withColumn("fold", F.expr(f"pmod(xxhash64(unhex(md5(coalesce(text, ''))), 1), {t.FOLDS})")).collect()}
    order = sorted(set().union(*seen["stems"]))
    w, bias = seen["model"]
    lexicon = [{x.decode() for x in y} for y in (t.INSULTS, t.CONTEMPT, t.PROFANITY, t.THREATS)]
    want = collections.Counter()
    for (i, text), fold in folds.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        counts = collections.Counter(s for x in words for s in t._stems(x.encode()) if s in set(order))
        own = seen["stems"][fold]
        hits = [sum(n for s, n in counts.items() if own.get(s) == k) for k in range(len(t.STEM_ODDS))]
        bad = sum(x in lexicon[0] | lexicon[1] | lexicon[2] for x in words)
        strong = sum(hits[3:])
        votes = [bool(set(words) & x) for x in lexicon] + [bad >= 2, bad * 200 >= len(words) > 0, bool(bad and t._AIMED.search((text or "").lower().encode())), (text or "").count("!") * 40 > len(words) > 0]
        votes += [n * t.DENSE > len(words) for n in hits] + [strong >= 4, strong >= 12, strong * t.DENSE > 8 * len(words) > 0]
        assert len(votes) == len(t.VOTERS)
        z = bias + sum(w[order.index(s)] * math.log1p(n) for s, n in counts.items()) + sum(w[len(order) + k] for k, x in enumerate(votes) if x)
        want[i, sum(1 << k for k, x in enumerate(votes) if x), round(1 / (1 + math.exp(-max(-30, min(30, z)))), 6)] += 1
    assert {(r.doc_id, r.votes, round(r.score, 6)) for r in got} == set(want)
    assert seen["stems"][0] and any(r.score > 0.5 for r in got if r.doc_id == 5000)


def key_of(i, text):
    return hashlib.md5(f"{'null' if i is None else i}\n{'true' if text is None else 'false'}{text or ''}".encode()).digest()


def brute_lines(rows):
    """Later places of three-line windows go; the order is null ids first, then id, then key."""
    once = sorted({x for x in rows if x[1] is not None}, key=lambda x: (x[0] is not None, x[0] or 0, key_of(*x)))
    seen, gone = set(), collections.defaultdict(set)
    for i, text in once:
        lines = [(n, x) for n, x in enumerate(text.split("\n")) if x.strip()]
        for k in range(len(lines) - 2):
            w = tuple(x for _, x in lines[k : k + 3])
            if w in seen:
                gone[i, text].update(n for n, _ in lines[k : k + 3])
            seen.add(w)
    return [(i, t if (i, t) not in gone else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i, t])) for i, t in rows]


def brute_near(rows):
    """All pairs: five-word shingles at 0.8; of each component the smallest id (null last, then key) stays, once."""
    once = sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0, key_of(*x)))
    words = [(t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)).encode().split() for _, t in once]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for w in words]
    label = list(range(len(once)))
    find = lambda x: x if label[x] == x else find(label[x])
    for i in range(len(once)):
        for j in range(i):
            if words[i] == words[j] or (words[i] and words[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [x for n, x in enumerate(once) if find(n) == n]


def brute_clean(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut_up = lambda t: word.findall((t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    bad = set()
    for t in items:
        w = cut_up(t)
        bad |= {tuple(w[k : k + min(10, len(w))]) for k in range(len(w) - min(10, len(w)) + 1)} if w else set()
    sizes = {len(x) for x in bad}
    return [(i, t) for i, t in rows if not any(tuple(w[k : k + n]) in bad for w in [cut_up(t)] for n in sizes for k in range(len(w) - n + 1))]


def test_pipeline(spark, folder):
    """Each stage against plain Python over its predecessor's rows, and the whole run against the stages."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for name, stage in cp.STAGES:
        kept.append(cut(stage(spark, kept[-1], folder), name))
    for df in kept[1:-1]:
        assert df.dtypes == docs.dtypes
    rows = [[(r.doc_id, r.text) for r in df.collect()] for df in kept]
    count = collections.Counter
    rejected = {(r.doc_id, bytes(r.row_key)) for r in score_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
    assert count(rows[1]) == count((i, t) for i, t in rows[0] if (i, key_of(i, t)) not in rejected) == count((i, t) for i, t in rows[0] if i is None or i < 1000)
    assert count(rows[2]) == count(brute_lines(rows[1])) and rows[2] != rows[1]
    assert count(rows[3]) == count(brute_near(rows[2])) and len(rows[3]) < len(set(rows[2]))
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert count(rows[4]) == count(brute_clean(rows[3], items)) and 12 in {i for i, _ in rows[3]} - {i for i, _ in rows[4]}
    source = {(r.doc_id, r.text): r.source for r in kept[4].collect()}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    had, got = count(), count()
    for x in rows[4]:
        had[source[x]] += words(x[1])
    for x in rows[5]:
        got[source[x]] += words(x[1])
    assert set(rows[5]) <= set(rows[4]) and max(count(rows[5]).values()) <= 3 and all(got[s] <= 3 * had[s] for s in had)
    assert abs(sum(got.values()) - sum(had.values())) <= 0.05 * sum(had.values())
    again = sorted((r.doc_id is None, r.doc_id or 0, r["copy"]) for r in cp.run(spark, folder).collect())
    assert again == sorted((r.doc_id is None, r.doc_id or 0, r["copy"]) for r in kept[5].collect())


def test_stages_on_empty_tables_and_clashing_names(spark, folder, empty):
    clash = spark.read.parquet(f"{folder}/documents.parquet").limit(30)
    for name in ("key", "copies", "copy", "row_key", "line_gone", "id", "row", "fp", "votes", "n_removed_lines", "size", "part"):
        clash = clash.withColumn(name, F.lit("own"))
    for name, stage in cp.STAGES:
        assert stage(spark, empty, folder).count() == 0
        out = cut(stage(spark, clash, folder), name)
        assert set(clash.columns) <= set(out.columns)
        assert out.where("key <> 'own' or copies <> 'own' or copy <> 'own' or row_key <> 'own' or line_gone <> 'own'").count() == 0
