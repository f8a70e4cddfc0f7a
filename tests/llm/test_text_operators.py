"""Every operator against a brute-force version on a small corpus, and on an empty one."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from codelattice.llm import decontamination, license_scan, line_dedup, mixing, simhash, sketches, suffix_dedup, token_counts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return df.collect()


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def bag(items):
    return collections.Counter(items)


def test_decontamination(spark, docs, empty):
    own = dict(texts_of(docs))
    some = own[3].split()
    bench = [("a", " ".join(some[2:16])), ("b", "two words"), ("c", None), ("d", "!!"), ("e", "Two WORDS"), ("f", " ".join(own[96].split()[50:75])),
             ("a", " ".join(some[2:16])), (None, "one"), ("g", "a b c d e f g h i j"), ("h", "never stands there at all")]
    items = spark.createDataFrame(bench, "item_id string, text string")

    def expected(text):
        w = WORD.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for item, t in bench:
            b = WORD.findall((t or "").translate(LOW))
            n = min(10, len(b))
            for s in range(len(b) - n + 1) if n else ():
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == b[s : s + n]:
                        hit.update(range(i, i + n))
                        if item:
                            found.add(item)
        return len(w), len(hit), tuple(sorted(found)), bool(hit)

    got = bag((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in rows_of(decontamination.decontaminate(docs, items)))
    assert got == bag((i, *expected(t)) for i, t in texts_of(docs))
    assert decontamination.decontaminate(empty, items).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).where("contaminated").count() == 0


def test_every_shared_window_shares_a_fingerprint():
    import numpy as np

    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    a = decontamination.window_fingerprints(h, 10, 5)
    b = decontamination.window_fingerprints(h[137:], 10, 5)
    assert (a[137:] == b).all()


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(docs, empty, tmp_path, name):
    import public_tokenizers

    path = str(public_tokenizers.path(name))
    with open(path, "rb") as f:
        count = token_counts._load("sentencepiece" if name.endswith(".model") else "tokenizers", f.read())
    want = bag((i, len((t or "").encode()), count([t or ""])[0], count([t or ""])[0] > 50) for i, t in texts_of(docs))
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second time from the cache
        got = bag(tuple(r) for r in rows_of(token_counts.count_tokens(docs, path, cache=cache, limit=50)))
        assert got == want
    stored = docs.sparkSession.read.parquet(f"{cache}/*")
    assert stored.count() == stored.distinct().count() == docs.selectExpr("coalesce(text, '')").distinct().count()
    assert token_counts.count_tokens(empty, path).count() == 0


def brute_simhash(text):
    from xxhash import xxh64_intdigest

    w = TOKEN.findall((text or "").translate(LOW))
    if not w:
        return 0
    parts = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(pairs):
    """(id, fingerprint) to the smallest id that links reach, by position."""
    label = list(range(len(pairs)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(pairs):
            for j, (_, b) in enumerate(pairs):
                if (a ^ b).bit_count() <= 4 and label[j] < label[i]:
                    label[i] = label[j]
                    changed = True
    ids = collections.defaultdict(list)
    for at, (i, _) in zip(label, pairs, strict=True):
        ids[at] += [i] if i is not None else []
    return [min(ids[at], default=None) for at in label]


@pytest.mark.parametrize("chunk", [2, 1024])
def test_simhash(docs, empty, chunk):
    pairs = [(i, brute_simhash(t)) for i, t in texts_of(docs)]
    want = bag((i, f"{fp:016x}", c) for (i, fp), c in zip(pairs, brute_components(pairs), strict=True))
    assert bag(tuple(r) for r in rows_of(simhash.near_duplicates(docs, chunk=chunk).select("doc_id", "fingerprint", "component_id"))) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("chunk", [3, 1024])
def test_close_fingerprints_with_large_buckets(spark, chunk):
    import random

    rng = random.Random(1)
    center, fps = rng.getrandbits(64), set()
    for _ in range(150):
        x = center
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.close_pairs(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), chunk=chunk)
    from codelattice.llm.common import connected_components

    got = collections.defaultdict(set)
    for r in connected_components(edges).collect():
        got[r.label].add(r.node)
    want = collections.defaultdict(set)
    for c, x in zip(brute_components(list(enumerate(fps))), fps, strict=True):
        want[c].add(signed(x))
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


@pytest.mark.parametrize("chunk", [3, 4096])
def test_similar_pairs_connect_as_all_pairs_do(spark, chunk):
    """One crowded bucket, and nodes that only reach the leader over others."""
    import random

    from codelattice.llm.common import connected_components

    rng = random.Random(2)
    fps = []
    for i in range(120):
        x = rng.getrandbits(64) if i % 4 == 0 or not fps else rng.choice(fps)
        for _ in range(rng.randint(1, 7)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(n, *[signed(x)] * simhash.LONGS, [1, 2 + n % 5]) for n, x in enumerate(fps)]
    names = ", ".join(f"f{i} long" for i in range(simhash.LONGS))
    edges = simhash.similar_pairs(spark.createDataFrame(rows, f"node long, {names}, blocks array<long>"), limit=4 * simhash.LONGS, chunk=chunk)
    got = {r.node: r.label for r in connected_components(edges).collect()}
    assert [got.get(n, n) for n in range(len(fps))] == brute_components(list(enumerate(fps)))


def test_similar_documents(spark, docs, empty):
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    texts = [[rng.choice(words) for _ in range(rng.choice([60, 200, 700]))] for _ in range(150)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    similar = []
    for i, t in enumerate(texts[:100]):
        near = list(t)
        for _ in range(max(1, len(t) // 60)):
            near[rng.randrange(len(near))] = "changed"
        rows.append((1000 + i, " ".join(near)))
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t, near))
        if len(a & b) >= 0.8 * len(a | b):
            similar.append(i)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[1000 + i] == i for i in similar) >= 0.95 * len(similar) > 60
    assert all(got[i] == i for i in range(150)) and all(c in (d, d - 1000) for d, c in got.items())
    small = rows_of(simhash.similar_documents(docs, chunk=2))
    at = collections.Counter((r.doc_id, r.component_id) for r in small)
    assert len(small) == docs.count() and at[(96, 96)] == 1 and at[(5, 5)] == 3 and at[(90, 90)] == at[(91, 90)] == at[(94, 90)] == at[(None, 90)] == 1
    assert all(at[(60 + i, i)] for i in range(10))
    kept = [r.component_id for r in small if r.kept]
    assert set(kept) == {r.component_id for r in small}
    assert simhash.similar_documents(empty).count() == 0


def edited_pairs(n=60, length=700):
    """(kind, text, edited text, similarity of their five-word shingles) for pairs of 0.8 to 0.9 whose difference is one run of words."""
    import random

    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    some = lambda k: [rng.choice(words) for _ in range(k)]
    for i in range(n):
        t = some(length)
        k = rng.randrange(length // 9 + 5, length // 4 - 5)
        m = rng.randrange(length // 19 + 5, length // 9 - 5)
        at = rng.randrange(length - m)
        for kind, near in (("appended", t + some(k)), ("replaced", t[:at] + some(m) + t[at + m :])):
            a, b = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t, near))
            yield kind, " ".join(t), " ".join(near), len(a & b) / len(a | b)


def test_texts_with_one_changed_run_share_a_block():
    import pandas as pd

    pairs = list(edited_pairs())
    assert all(0.8 <= s <= 0.9 for *_, s in pairs)
    for kind in ("appended", "replaced"):
        own = [x for x in pairs if x[0] == kind]
        blocks = lambda texts: next(simhash._signatures(iter([pd.DataFrame({"id": 0, "key": b"", "text": texts})])))["blocks"]
        found = [bool(set(a) & set(b)) for a, b in zip(blocks([x[1] for x in own]), blocks([x[2] for x in own]), strict=True)]
        assert all(found), (kind, sum(found), len(found))


@pytest.mark.parametrize("chunk", [2, 512])
def test_only_documents_of_the_similarity_are_linked(spark, chunk):
    """Groups of versions of 0.6 to 1 to each other, one changed run each: components as all pairs of 0.8 make them."""
    import random

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    texts = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([30, 120, 500]))]
        for _ in range(8):
            t = list(base)
            at, k = rng.randrange(len(t)), rng.randrange(1, max(2, len(t) // 6))
            t[at : at + k] = [rng.choice(words) for _ in range(rng.choice([0, k]))]
            texts.append(t)
    sets = [{tuple(t[j : j + 5]) for j in range(len(t) - 4)} for t in texts]
    label, changed = list(range(len(texts))), True
    alike = [(i, j, len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i in range(len(texts)) for j in range(i) if i // 8 == j // 8]
    assert sum(s >= 0.8 for *_, s in alike) > 100 and sum(0.7 <= s < 0.8 for *_, s in alike) > 100
    while changed:
        changed = False
        for i, j, s in alike:
            if s >= 0.8 and label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df, chunk=chunk).collect()}
    assert [got[i] for i in range(len(texts))] == label


def test_mixing(docs, empty):
    got = rows_of(mixing.mix_sources(docs))
    size = lambda t: len(TOKEN.findall(t or ""))
    assert bag((r.doc_id, r.size) for r in got) == bag((i, size(t)) for i, t in texts_of(docs))
    words = collections.Counter()
    for r in docs.select("source", "text").collect():
        words[r.source] += size(r.text)
    order = sorted((s for s in words if s is not None), key=lambda s: s.encode()) + [None]
    weight = dict(zip(order, [5, 2, 1] * len(order), strict=False))
    target, free, left = {}, set(order), sum(words.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * words[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * words[s]
            left -= target[s]
            free.discard(s)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == words[r.source_name]
        assert r.target == pytest.approx(target[r.source_name])
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[r.source_name] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(5, target[s] / 100)
    again = rows_of(mixing.mix_sources(docs))
    key = lambda rows: bag((r.doc_id, r.taken) for r in rows)
    assert key(again) == key(got)
    assert mixing.mix_sources(empty).count() == 0


def test_budget_is_met_where_a_choice_of_copies_meets_it():
    import itertools
    import random

    import numpy as np

    rng = random.Random(2)
    for most in (1, 3):
        for _ in range(40):
            lengths = sorted(rng.sample(range(0, 30), 4))
            counts = [rng.randint(1, 3 if most == 1 else 2) for _ in lengths]
            total = sum(a * b for a, b in zip(lengths, counts, strict=True))
            budget = rng.randint(0, total * most)
            take = mixing.fit_budget(np.array(lengths), np.array(counts), budget, most=most)
            assert all(0 <= a <= b * most for a, b in zip(take, counts, strict=True))
            sums = {sum(a * b for a, b in zip(lengths, x, strict=True)) for x in itertools.product(*(range(b * most + 1) for b in counts))}
            assert abs(budget - int((take * np.array(lengths)).sum())) == min(abs(budget - s) for s in sums)
    lengths = np.array([rng.randint(50, 3000) for _ in range(400)])
    counts = np.array([rng.randint(1, 50) for _ in lengths])
    for share in (0.01, 0.4, 1.7, 2.99):
        budget = int((lengths * counts).sum() * share)
        assert int((mixing.fit_budget(lengths, counts, budget, most=3) * lengths).sum()) == budget


def test_mix_of_a_small_source_is_exact(spark):
    """A source of few documents meets its target wherever zero to three copies of each can."""
    rows = [(i, " ".join(["w"] * n), "a") for i, n in enumerate((7, 11, 30, 64, 102))] + [(10 + i, " ".join(["w"] * 50), s) for i, s in enumerate("bbbbccccccccccc")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    import itertools

    sums = {sum(a * b for a, b in zip(x, (7, 11, 30, 64, 102), strict=True)) for x in itertools.product(range(4), repeat=5)}
    goal = next(r.target for r in got if r.source_name == "a")
    taken = sum(r.taken for r in got if r.source_name == "a")
    assert abs(taken - round(goal)) == min(abs(x - round(goal)) for x in sums)


def test_many_separate_hits(spark):
    """100,000 separate hits in one text, in time that grows with their number."""
    import time

    passage = " ".join(f"p{i}" for i in range(10))
    text = " ".join(f"{passage} x{i}" for i in range(100_000))
    df = spark.createDataFrame([(1, text), (2, passage + " " + passage), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(5, passage)], "item_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in decontamination.decontaminate(df, items).collect()}
    assert time.perf_counter() - began < 60
    assert got[1].n_hit == 1_000_000 and len(got[1].spans) == 100_000 and got[1].n_words == 1_100_000
    assert [(s.s, s.e) for s in got[2].spans] == [(0, 20)] and got[2].n_hit == 20 and got[3].n_hit == 0


def test_many_removed_lines(spark):
    """100,000 removed lines in one text, in time that grows with their number."""
    import time

    text = "\n".join(f"line {i}" for i in range(100_000))
    df = spark.createDataFrame([(1, text), (2, text + "\nown"), (3, "a\n" + text)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert time.perf_counter() - began < 60
    assert got[1].text == text and got[2].text == "own" and got[2].n_removed_lines == 100_000 and got[3].text == "a"


def test_licenses(spark, docs, empty):
    mit = " ".join(next(t for t in license_scan.TEMPLATES if t.label == "mit" and not t.base).words)
    more = spark.createDataFrame([
        (201, "MIT License\n\n" + mit.capitalize()),
        (202, "GNU General Public License; gnu general PUBLIC license"), (203, "cc by cc by-sa"), (204, "by cc"), (205, "Permission is hereby granted free of"), (206, "Redistribution and use in source and binary forms"),
        (207, "under the Apache License, Version 2.0"), (208, None), (209, "é cc by"), (210, ""), (211, "cc by " * 20_000), (212, "license mit " * 5_000 + mit), (207, "under the Apache License, Version 2.0"),
        (213, "granted hereby is permission free of charge"), (214, "of charge Permission is hereby granted, free of charge"), (None, "mit license"), (215, "GNU Lesser General Public License"),
    ], "doc_id long, text string")
    every = docs.select("doc_id", "text").union(more)
    got = rows_of(license_scan.scan_licenses(every))
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

    def expected(t):
        w = WORD.findall((t or "").translate(LOW))
        places = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        longer = {t.label for t in license_scan.TEMPLATES for k in range(len(w)) if tuple(w[k : k + t.key[1] - t.key[0]]) == t.words[slice(*t.key)]}
        return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(longer))

    assert bag((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got) == bag((i, *expected(t)) for i, t in texts_of(every))
    assert all(0 <= r.score <= 1 for r in got)
    at = {r.doc_id: r for r in got}
    assert at[201].labels == "mit" and at[201].score == pytest.approx(1.0) and at[212].score == pytest.approx(1.0)
    assert at[205].labels == at[213].labels == "" and at[206].labels == "bsd" and 0 < at[206].score < 1 and at[207].labels == "apache" and at[214].labels == "mit" and at[215].labels == "lgpl"
    assert at[211].n_base == 20_000 and at[212].n_base == 4_999
    assert license_scan.scan_licenses(empty).count() == 0


def test_sketches(docs, empty):
    def units(t):
        out = set()
        for line in t.split("\n"):
            out |= set(re.split(r"(?<=[.!?])\s+", line))
        return out - {""}

    def near(a, b):
        a, b = units(a), units(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    spread = {r.t: r.s for r in docs.selectExpr("coalesce(text, '') as t", "shiftrightunsigned(xxhash64(coalesce(text, '')), 11) as s").collect()}
    own = sorted(((i, t or "") for i, t in texts_of(docs)), key=lambda x: (x[0] is not None, x[0] or 0, spread[x[1]], x[1]), reverse=True)
    want = []
    for (i, t), (_, n) in zip(own, own[1:] + own[:1], strict=True):
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(near(t, e), 9), round(near(t, n), 9)))
    got = rows_of(sketches.fingerprint_documents(docs))
    assert bag((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == bag(want)
    prints = collections.defaultdict(set)
    for r in got:
        prints[r.doc_id].add(r.fingerprint)
    assert prints[0] == prints[60]
    assert sketches.fingerprint_documents(empty).count() == 0
    one = rows_of(sketches.fingerprint_documents(docs.where("doc_id = 7")))
    assert [r.near_next for r in one] == [1.0]


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_next_documents_in_ranges(spark, parts):
    """One id and the missing id hold many rows each, and are dealt over several ranges."""
    rows = [(i, f"text {i}") for i in range(60)] + [(20, f"same id {i}") for i in range(50)] + [(None, f"no id {i}") for i in range(40)] + [(3, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spread = {r.t: r.s for r in df.selectExpr("coalesce(text, '') as t", "shiftrightunsigned(xxhash64(coalesce(text, '')), 11) as s").collect()}
    own = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, spread[x[1]], x[1]), reverse=True)
    want = bag((i, t, n) for (i, t), (_, n) in zip(own, own[1:] + own[:1], strict=True))
    assert bag(tuple(r) for r in sketches.with_next(df, parts=parts).collect()) == want


def test_sketches_of_many_paragraphs(spark):
    """Thousands of differing paragraphs peel in retries of a few seconds: the work is not quadratic."""
    import time

    a = "\n".join(f"First text, line {i}." for i in range(12_000))
    b = "\n".join(f"First text, line {i}." if i % 3 else f"Second text, line {i}." for i in range(12_000))
    df = spark.createDataFrame([(2, a), (1, b)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in sketches.fingerprint_documents(df).collect()}
    assert got[2].near_next == pytest.approx(8_000 / 16_000) and time.perf_counter() - began < 60


def test_next_of_ids_that_are_texts(spark):
    df = spark.createDataFrame([("b", "B"), (None, "none"), ("a", "A"), ("c", None), ("ä", "AE")], "doc_id string, text string")
    got = {r.id: (r.text, r.next_text) for r in sketches.with_next(df, parts=3).collect()}
    assert got == {"ä": ("AE", ""), "c": ("", "B"), "b": ("B", "A"), "a": ("A", "none"), None: ("none", "AE")}


def test_facts_of_the_next_document(spark):
    df = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(40)], "doc_id long, text string")
    rows = sketches.with_next(df, parts=5, facts={"n": F.length("text")}).collect()
    assert len(rows) == 40 and all((r.n, r.next_n) == (len(r.text), len(r.next_text)) for r in rows)
    assert all(r.next_n == (r.id - 1) % 40 % 7 for r in rows)


@pytest.mark.parametrize("shared", [0, 1, 20, 37, 60, 400])
def test_differences_of_every_size_are_exact(spark, shared):
    """From none to more than a fixed sketch holds, on either side, and groups that need larger tables."""
    rows = [(n, "\n".join([f"Shared {shared} line {i}." for i in range(shared)] + [f"Own {n} line {i}." for i in range(n)])) for n in (0, 1, 5, 19, 38, 39, 41, 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.near_next for r in sketches.fingerprint_documents(df).collect()}
    ids = sorted(got, reverse=True)
    for n, m in zip(ids, ids[1:] + ids[:1], strict=True):
        assert got[n] == pytest.approx(shared / (shared + n + m) if shared + n + m else 1.0)


def test_half_of_a_short_line_stays_alike(spark):
    own = "One short line here. It has four sentences. The third stands here. And this is the last."
    df = spark.createDataFrame([(2, own), (1, "Another text altogether. Nothing is shared.")], "doc_id long, text string")
    got = {r.doc_id: r for r in sketches.fingerprint_documents(df).collect()}
    assert got[2].near_edited > 0 == got[2].near_next


def test_line_dedup(docs, empty):
    texts = sorted({(i, t) for i, t in texts_of(docs) if t is not None and i is not None})
    first, gone = {}, collections.defaultdict(set)
    for i, t in texts:
        lines = [(n, x) for n, x in enumerate(t.split("\n")) if re.search(r"\S", x)]
        for k in range(len(lines) - 2):
            w = lines[k : k + 3]
            if first.setdefault(tuple(x for _, x in w), (i, w[0][0])) != (i, w[0][0]):
                gone[i, t].update(n for n, _ in w)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_removed_lines"]
    for r in rows_of(got):
        if r.doc_id is None:
            continue
        assert r.n_hit == 7 and r.key == "own"
        options = {"\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i, t]): len(gone[i, t]) for i, t in texts if i == r.doc_id} or {None: 0}
        assert r.text in options and options[r.text] == r.n_removed_lines
    assert got.count() == docs.count()
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_with_null_ids_ties_and_repeated_rows(spark):
    text, longer = "one\ntwo\nthree", "zero\n" * 30_000 + "one\ntwo\nthree"
    rows = [(None, text), (None, text), (1, text), (1, text), (2, "a\none\ntwo\nthree\nb"), (3, None), (4, ""), (5, longer)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    at = bag((r.doc_id, r.text, r.n_removed_lines) for r in got)
    # A null id comes first, so its text stays; rows equal in id and text are one document. Windows overlap, so one zero stays.
    assert at == bag([(None, text, 0), (None, text, 0), (1, "", 3), (1, "", 3), (2, "a\nb", 2 + 1), (3, None, 0), (4, "", 0), (5, "zero", 30_002)])


def test_the_cover_has_every_difference():
    d, v = suffix_dedup.COVER, suffix_dedup.PERIOD
    assert {(a - b) % v for a in d for b in d} == set(range(v))


@pytest.mark.parametrize("block", [2000, 1 << 22])
def test_suffix_dedup(docs, empty, block):
    texts = [(i, (t or "").encode()) for i, t in texts_of(docs)]
    seen = collections.Counter(t[k : k + 200] for _, t in texts for k in range(len(t) - 199))
    want = []
    for i, t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (n and gone[n - 1]) for n, g in enumerate(gone))
        want.append((i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
    got = rows_of(suffix_dedup.remove_repeats(docs, block=block, bucket=20_000))
    assert sum(r.n_removed > 0 for r in got) > 20
    assert bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == bag(want)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_hot_keys_are_dealt_over_parts(spark):
    from codelattice.llm.common import join_hot

    keys = [0] * 500 + [1] * 300 + [None] * 20 + list(range(2, 60))
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    facts = spark.createDataFrame([(k, k * 10) for k in range(60)], "k long, v long")
    got = bag(tuple(r) for r in join_hot(rows, facts, "k", most=4, salts=3).select("k", "i", "v").collect())
    assert got == bag((k, i, k * 10) for i, k in enumerate(keys) if k is not None)
