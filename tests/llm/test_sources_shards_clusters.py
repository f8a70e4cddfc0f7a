"""Divergence of sources, shards and centroid clusters against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelattice.llm import clustering, divergence, sharding


def brute_divergence(rows, min_docs, top):
    words = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, df = {}, {}
    for text, lang, source in rows:
        terms = words.findall((text or "").translate(lower))
        counts.setdefault((lang or "", source or ""), Counter()).update(terms)
        df.setdefault(lang or "", Counter()).update(set(terms))
    out = set()
    share = lambda n, total, v: 1 + 1_000_000_000 * (n + 5) // (total + 5 * v)
    ps = {}
    for (lang, source), n in counts.items():
        kept = [t for t, k in df[lang].items() if k >= min_docs]
        total = sum(n[t] for t in kept)
        ps[lang, source] = {t: share(n[t], total, len(kept)) for t in kept}
    for (lang, source), p in ps.items():
        whole = Counter()
        for (x, _), n in counts.items():
            if x == lang:
                whole.update({t: n[t] for t in p})
        values = [(-sum(abs(p[t] - q[t]) for t in p), s) for (x, s), q in ps.items() if x == lang and s != source]
        out |= {(lang, source, "pair", s, -v, i + 1) for i, (v, s) in enumerate(sorted(values, key=lambda x: (x[0], x[1].encode())))}
        up = [(share(whole[t], sum(whole.values()), len(p)) - p[t], t) for t in p if counts[lang, source][t]]
        up = sorted((x for x in up if x[0] < 0), key=lambda x: (x[0], x[1].encode()))[:top]
        out |= {(lang, source, "term", t, -v, i + 1) for i, (v, t) in enumerate(up)}
    return out


def spoken(n=260, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5))) for _ in range(150)] + ["Élan", "日本", "ÜBER", "über"]
    rows = []
    for i in range(n):
        k = int(rng.random() ** 3 * 60)
        rows.append((" ".join(rng.choice(words[i % 3 * 10 :]).title() + rng.choice([" ", ", ", "1", "\n"]) for _ in range(k)), ["en", "de", None][i % 3], ["a", "a", "b", None, "", "ü", "c"][i % 7]))
    rows += [(None, "fr", "a"), ("", "fr", "b"), ("x" * 70_000 + " rare", "en", "a"), ("la " * 5000, "de", "b"), (None, "en", "only null")] + rows[:5]
    return rows


@pytest.mark.parametrize(("min_docs", "top"), [(30, 50), (3, 4), (1, 7)])
def test_divergence(spark, min_docs, top):
    rows = spoken()
    df = spark.createDataFrame([(*r, 9, "clash") for r in rows], "text string, lang string, source string, term int, item string").repartition(3)
    got = divergence.divergence(df, min_docs=min_docs, top=top).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute_divergence(rows, min_docs, top)


def test_divergence_small_parts(spark, monkeypatch):
    """Counts handed on often and a sketch full of collisions give the same rows."""
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "WIDTH", (64, 64))
    rows = spoken(120)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert {tuple(r) for r in divergence.divergence(df, min_docs=5).collect()} == brute_divergence(rows, 5, 50)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_sketch_never_underestimates(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(-(1 << 62), 1 << 62), rng.choice([1, 1, 2, 40, 300])) for _ in range(3000)] * 2
    sketch = divergence.document_sketch(spark.createDataFrame(rows, "h long, df long").repartition(5), 1 << 10)
    true = Counter()
    for h, n in rows:
        true[h] += n
    at = divergence._cells(np.array(list(true)), 1 << 10)
    low = np.min([sketch[r][at[r]] for r in range(divergence.DEPTH)], axis=0)
    assert all(x >= min(n, 255) for x, n in zip(low, true.values(), strict=True))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    x = np.arange(n)
    y = sharding.permute(x, n, 7)
    assert sorted(y.tolist()) == x.tolist()
    assert sharding.permute(y, n, 7, inverse=True).tolist() == x.tolist()
    big = 10**12 + 7
    some = np.array([0, 1, big - 1, 123456789012])
    assert sharding.permute(sharding.permute(some, big, 3), big, 3, inverse=True).tolist() == some.tolist()


def test_permutation_mixes():
    n = 20_000
    y = sharding.permute(np.arange(n), n, 42)
    assert abs(np.corrcoef(np.arange(n), y)[0, 1]) < 0.03
    cells = np.bincount(np.arange(n) * 10 // n * 10 + y * 10 // n, minlength=100)
    assert ((cells - n / 100) ** 2 / (n / 100)).sum() < 150


def test_shards(spark, docs, empty):
    rows = docs.collect()
    n, places = len(rows), sharding.shard_places(docs, 7).collect()
    assert sorted(p.row_number for p in places) == list(range(n))
    by = {}
    for p in places:
        by.setdefault(p.shard, []).append(p.slot)
        assert (p.shard, p.slot) == sharding.place_of(p.row_number, n, 7)
        assert sharding.row_at(p.shard, p.slot, n, 7) == p.row_number
    assert set(by) == set(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    fact = lambda t: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert Counter((p.doc_id, p.size, p.text_crc32) for p in places) == Counter((r.doc_id, *fact(r.text)) for r in rows)
    order = [p.doc_id for p in sorted(places, key=lambda p: p.row_number)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    again = sharding.shard_places(docs.orderBy(F.desc("text")).repartition(5), 7).collect()
    slim = lambda x: Counter((p.doc_id, p.size, p.text_crc32, p.row_number, p.shard, p.slot) for p in x)
    assert slim(again) == slim(places)
    assert sharding.shard_places(empty).count() == 0


def test_written_shards(spark, docs, tmp_path):
    df = docs.withColumn("slot", F.lit("own")).withColumn("shard_row", F.lit(1))
    table = sharding.write_shards(df, str(tmp_path / "shards"), 3)
    places = sharding.shard_places(df, 3)
    want = Counter((p.doc_id, p.size - 8, p.shard, p.slot) for p in places.collect())
    assert Counter((r.doc_id, len((r.text or "").encode()), r.shard, r.slot_) for r in table.collect()) == want
    for shard in range(3):
        files = sorted((tmp_path / "shards" / f"shard={shard}").glob("*.parquet"))
        slots = [r.slot_ for f in files for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(len(slots)))


def brute_clusters(rows, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [v for _, v in first]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((square(v, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        cs = [[sum(x) // at.count(j) for x in zip(*(v for (_, v), a in zip(kept, at, strict=True) if a == j), strict=True)] if j in at else c for j, c in enumerate(cs)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), name[j]) for i, j, d in found)


def vectors(seed=2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    rows = [(i, [c + rng.gauss(0, 0.4) for c in rng.choice(centres)]) for i in range(300)]
    rows += [(300 + i, [float(rng.randint(-1, 1)) if d < 3 else 0.0 for d in range(64)]) for i in range(150)]  # many ties
    rows += [(500, None), (501, [1.0] * 63), (502, [1.0] * 65), (503, [None] + [0.0] * 63), (504, [float("nan")] * 64), (505, [float("-inf")] + [0.0] * 63), (506, [])]
    rows += [(None, [0.25] * 64), (None, [0.5] * 64), (3, rows[3][1]), (3, rows[3][1]), (4, rows[5][1])]
    return rows


@pytest.mark.parametrize(("k", "rounds"), [(16, 3), (5, 6), (1, 2), (600, 1)])
def test_clusters(spark, k, rounds):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "own") for r in rows], "vec_id long, embedding array<double>, cluster int, upper string").repartition(3)
    got = clustering.cluster_vectors(df, k, rounds).collect()
    assert Counter(tuple(r)[:6] for r in got) == brute_clusters(rows, k, rounds)
    if (k, rounds) == (16, 3):
        assert sum(r.n_distances for r in got) < 0.7 * len(got) * k * (rounds + 1)


def test_clusters_of_large_components(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-9e6, 9e6]) if d == 0 else float(rng.randint(-3, 3)) for d in range(64)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(tuple(r)[:6] for r in clustering.cluster_vectors(df).collect()) == brute_clusters(rows, 16, 3)
    assert clustering.cluster_vectors(df.where("vec_id < 0")).collect() == []
    with pytest.raises(Exception, match="beyond"):
        clustering.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


def test_ties_after_moves():
    """Bounds that end level with a distance never prune it."""
    rng = np.random.default_rng(0)
    v = rng.integers(-2, 3, (500, 4))
    old = [[int(x) for x in r] for r in rng.integers(-2, 3, (9, 4))]
    at, upper, lower, _ = clustering.first_assignment(v, old)
    for _ in range(6):
        new = [[x + int(rng.integers(-1, 2)) for x in c] for c in old]
        at, upper, lower, _ = clustering.next_assignment(v, at, upper.copy(), lower.copy(), old, new)
        d = ((v[:, None, :] - np.array(new)[None]) ** 2).sum(axis=2)
        assert at.tolist() == d.argmin(axis=1).tolist()
        old = new
