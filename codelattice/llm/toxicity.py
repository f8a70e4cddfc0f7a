"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import cut, row_key
from codelattice.llm.decontamination import words_of

#: The documented bound of what is learned from: about so many labelled rows, and as many without a label (those whose hash is under
#: the bound's share of all).
SAMPLE = 20_000
#: Texts are dealt into so many folds by a hash of the text alone; a document's stem voters come from the other folds' rows.
FOLDS = 5
#: Each fold's lexicon keeps at most so many word stems.
STEMS = 4_096
#: Stems seen in fewer toxic rows of the sample are not kept.
SUPPORT = 4
#: The stems make voters by the strength of their log odds: each votes from so many on, as many of its stems as DENSE words have.
STEM_ODDS = (1.5, 2.0, 2.5, 3.0, 3.5, 4.0)
DENSE = 200
#: A row is rejected from this score on.
THRESHOLD = 0.3
#: Byte lengths of the word beginnings that can be stems, beside whole words.
PREFIXES = (4, 5, 6, 7, 8)

# English insults, by kind.
INSULTS = frozenset(b"idiot idiots moron morons imbecile fool fools stupid dumb dumbass retard retarded clown clowns loser losers jerk bastard asshole".split())
CONTEMPT = frozenset(b"trash garbage scum filth vermin worthless pathetic disgusting useless subhuman parasite parasites coward cowards".split())
PROFANITY = frozenset(b"fuck fucking fucked shit shitty bitch cunt dick piss crap damn whore slut".split())
THREATS = frozenset(b"kill die hang shoot murder hurt destroy hate".split())
_AIMED = re.compile(rb"\b(?:you|your|ur|he|she|they|these|those)\W+(?:\w+\W+){0,3}?(?:" + b"|".join(sorted(INSULTS | CONTEMPT | PROFANITY)) + rb")\b")

VOTERS = ("insult", "contempt", "profanity", "threat", "several", "dense", "aimed", "shouting", *(f"stems{x}" for x in STEM_ODDS), "strong4", "strong12", "strong_dense")


def _stems(word: bytes) -> list[bytes]:
    """A word's features: its beginnings, and the word itself with an end mark."""
    return [word[:n] for n in PREFIXES if len(word) > n] + [word + b"$"]


def _votes(text: str, words: list[bytes], hits: list[int]) -> int:
    """The voters' votes as bits, in the order of VOTERS; ``hits`` are the words with a stem of each strength. An empty text gets no vote."""
    unique = set(words)
    n_bad = sum(w in INSULTS or w in CONTEMPT or w in PROFANITY for w in words) if not unique.isdisjoint(INSULTS | CONTEMPT | PROFANITY) else 0
    votes = (
        not unique.isdisjoint(INSULTS), not unique.isdisjoint(CONTEMPT), not unique.isdisjoint(PROFANITY), not unique.isdisjoint(THREATS),
        n_bad >= 2, n_bad * 200 >= len(words) > 0, n_bad > 0 and _AIMED.search(text.lower().encode()) is not None,
        text.count("!") * 40 > len(words) > 0,
    )
    bits = sum(1 << i for i, v in enumerate(votes) if v)
    strong = sum(hits[len(hits) // 2 :])
    by_stems = (*(n * DENSE > len(words) for n in hits), strong >= 4, strong >= 12, strong * DENSE > 8 * len(words) > 0)
    return bits | sum(1 << (len(votes) + i) for i, v in enumerate(by_stems) if v)


def _reader(vocabulary: dict[bytes, int], voting: list[dict[int, int]]):
    """Rows (id, key, text_key, fold, text) to (id, key, text_key, votes, at, value): votes, and counts of the known stems.

    All stems of all folds are features; only those of ``voting[fold]`` (stem: its voter), learned from other folds' labels, vote."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, tuple[int, ...]] = {}
        for rows in batches:
            votes, ats, values = [], [], []
            for text, fold in zip(rows["text"], rows["fold"], strict=True):
                text = text or ""
                words = words_of(text.lower())
                counts: dict[int, int] = {}
                for w in words:
                    hit = known.get(w)
                    if hit is None:
                        if len(known) > 200_000:
                            known.clear()
                        hit = known[w] = tuple(vocabulary[s] for s in _stems(w) if s in vocabulary)
                    for i in hit:
                        counts[i] = counts.get(i, 0) + 1
                found = sorted(counts)
                hits = [0] * len(STEM_ODDS)
                for i in found:
                    if (voter := voting[fold].get(i)) is not None:
                        hits[voter] += counts[i]
                votes.append(_votes(text, words, hits))
                ats.append(found)
                values.append([float(np.log1p(counts[i])) for i in found])
            out = {"id": rows["id"], "key": rows["key"], "text_key": rows["text_key"], "votes": pd.Series(votes, dtype="int64", index=rows.index)}
            yield pd.DataFrame(out | {"at": pd.Series(ats, dtype=object, index=rows.index), "value": pd.Series(values, dtype=object, index=rows.index)})

    return read


def _stem_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many rows of (fold, toxic, text) each stem stands, in parts of at most about 50,000 counts."""
    columns = ["fold", "stem", "toxic", "n"]
    n: dict[tuple[int, bytes, int], int] = {}
    for rows in batches:
        for fold, toxic, text in zip(rows["fold"], rows["toxic"], rows["text"], strict=True):
            for x in {s for w in set(words_of((text or "").lower())) for s in _stems(w)}:
                n[fold, x, toxic] = n.get((fold, x, toxic), 0) + 1
            if len(n) > 50_000:
                yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=columns)
                n = {}
    yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=columns)


def learn_stems(sample: DataFrame, folds: int = FOLDS, most: int = STEMS, support: int = SUPPORT) -> list[dict[bytes, int]]:
    """For each fold the word stems that mark the toxic rows of the *other* folds of a bounded sample (fold, text, toxic),
    with the number of the voter that each belongs to.

    A stem is kept if it is in ``support`` toxic rows at least and its smoothed log odds are over 1.5;
    at most ``most`` by their weight of evidence, ties by the stem. Counting, weighing and choosing are
    distributed; only the chosen stems reach the driver.
    """
    size = {(r.fold, bool(r.toxic)): r.n for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    out = []
    counts = cut(sample.select("fold", "toxic", "text").mapInPandas(_stem_counts, "fold int, stem binary, toxic int, n long")
                 .groupBy("fold", "stem").agg(F.sum(F.col("n") * F.col("toxic")).alias("pos"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("neg")), "stems")
    for fold in range(folds):
        p, q = (sum(n for (f, t), n in size.items() if f != fold and t == toxic) for toxic in (True, False))
        if not p or not q:
            out.append({})
            continue
        g = counts.where(F.col("fold") != fold).groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= support)
        odds = F.log((F.col("pos") + 0.5) / (p + 1)) - F.log((F.col("neg") + 0.5) / (q + 1))
        best = g.withColumn("odds", odds).where(F.col("odds") > STEM_ODDS[0]).orderBy(F.desc(F.round(F.col("odds") * F.col("pos"), 9)), "stem").limit(most)
        out.append({bytes(r.stem): sum(r.odds > x for x in STEM_ODDS) - 1 for r in best.select("stem", "odds").collect()})
    return out


def label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Log odds of toxicity for each pattern of votes and each state of the label, by expectation maximisation.

    ``votes`` has a row of 0/1 for each pattern; ``counts`` has how many rows of that pattern have no
    label, the label clean and the label toxic. Every voter has a rate of voting in either class,
    which is its accuracy; the label is one more voter, which may abstain, with rates of its own.
    Voters that are correlated within the classes share their weight. The first guess is the label
    where there is one, else the share of voters that vote. Returns an array like ``counts``.
    """
    v, n = votes.astype(float), counts.astype(float)
    guess = np.clip(v.sum(axis=1) / max(v.sum(axis=1).max(initial=0), 1), 0.02, 0.95)
    post = np.stack([guess, np.full(len(v), 0.02), np.full(len(v), 0.98)], axis=1)
    logit = np.zeros(post.shape)
    for _ in range(rounds):
        one, zero = n * post, n * (1 - post)
        weight_one, weight_zero = one.sum(axis=1), zero.sum(axis=1)
        rate1 = (weight_one @ v + 1) / (weight_one.sum() + 2)
        rate0 = (weight_zero @ v + 0.5) / (weight_zero.sum() + 20)
        rho = np.zeros((v.shape[1], v.shape[1]))
        for w, r in ((weight_one, rate1), (weight_zero, rate0)):
            d = v - r
            cov = (d * w[:, None]).T @ d / max(w.sum(), 1)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            rho += np.clip(cov / np.outer(sd, sd), 0, 1) / 2
        weight = 1 / rho.sum(axis=1).clip(1)
        # The label's rates among labelled rows: how often it says toxic in either class.
        said1 = (one[:, 2].sum() + 10) / (one[:, 1:].sum() + 11)
        said0 = (zero[:, 2].sum() + 1) / (zero[:, 1:].sum() + 11)
        share = np.clip((one.sum() + 1) / (n.sum() + 2), 1e-4, 0.5)
        base = np.log(share / (1 - share)) + (v * np.log(rate1 / rate0) + (1 - v) * np.log((1 - rate1) / (1 - rate0))) @ weight
        logit = base[:, None] + np.array([0.0, np.log((1 - said1) / (1 - said0)), np.log(said1 / said0)])
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max(initial=0) < 1e-6:
            break
        post = new
    return logit


def fit_classifier(ats: list, values: list, votes: np.ndarray, target: np.ndarray, n_stems: int, l2: float = 0.3, rounds: int = 300):
    """Weights (stems, then voters) and bias of a logistic regression on soft labels."""
    rows = np.repeat(np.arange(len(ats)), [len(x) for x in ats])
    cols = np.concatenate([np.asarray(x, np.int64) for x in ats]) if len(rows) else np.zeros(0, np.int64)
    data = np.concatenate([np.asarray(x, float) for x in values]) if len(rows) else np.zeros(0)
    k = votes.shape[1]
    w, bias = np.zeros(n_stems + k), 0.0
    m = np.zeros(n_stems + k + 1)
    s = np.zeros(n_stems + k + 1)
    n = max(len(ats), 1)
    for t in range(1, rounds + 1):  # Adam, on the whole bounded sample
        z = bias + votes @ w[n_stems:] + np.bincount(rows, weights=data * w[cols], minlength=len(ats))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        g = np.concatenate([np.bincount(cols, weights=data * err[rows], minlength=n_stems), votes.T @ err, [err.sum()]])
        g[:-1] += l2 * w / n
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def held_out(id_col: str):
    """Whether a row is kept from learning: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _patterns(votes) -> np.ndarray:
    """Votes as rows of 0/1."""
    return (np.asarray(votes, np.int64)[:, None] >> np.arange(len(VOTERS))) & 1


def _under(hashed, bound: int, n: int):
    """Whether a 64-bit hash is among about ``bound`` of ``n``: a share of the hash's range, so no sort and no limit is needed."""
    share = 1.0 if n <= bound else bound / n
    return hashed <= F.lit(min((1 << 63) - 1, int((share - 0.5) * (1 << 64))))


def _target(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = SAMPLE, stems: int = STEMS, threshold: float = THRESHOLD,
) -> DataFrame:
    """Score every whole text for toxicity: ``id_col``, held_out, score, predicted, votes, row_key.

    Voters are English lexicons, patterns (several insults, a dense share of them, insults aimed
    at somebody, exclamation marks) and word stems. Stems are learned from about ``sample`` labelled
    rows in folds of texts: a document's stem voters come from the folds it is not in, so no vote rests on
    the label of the document or of a copy. The label model is fitted on the vote patterns of all documents (at
    most 3 * 2 ** len(VOTERS) counts), with the label as one more voter whose accuracy is estimated.
    Its posterior is what the linear classifier learns, for the labelled rows of the sample and about
    as many rows without a label, chosen by their text. Labels count only for rows that are not held out; rows with a held-out
    label are in no sample; of several labels of an id the largest counts; null labels and ids are no
    labels. Only the text is an input of a score, so equal
    texts have equal scores and other ids of rows without a label change none. Null and empty texts get the score of a text
    without any stem; without labels the lexicons and patterns decide. One row per input row; rows
    equal in id and text count once in a sample; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    known = (
        labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("toxic"))
        .where("label_id is not null and toxic in (0, 1)").where(~held_out("label_id"))
        .groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"), F.unhex(F.md5(F.coalesce(text_col, F.lit("")))).alias("text_key"))
    texts = texts.withColumn("fold", F.pmod(F.xxhash64("text_key", F.lit(1)), F.lit(FOLDS)).cast("int"))
    chosen = known.where(_under(F.xxhash64("label_id"), sample, known.count()))  # about ``sample`` small rows
    labelled = texts.join(F.broadcast(chosen), texts["id"] == chosen["label_id"]).drop("label_id").dropDuplicates(["key"])
    labelled = cut(labelled.select("fold", "toxic", "text", "key"), "labelled")
    by_fold = learn_stems(labelled, FOLDS, stems)
    vocabulary = {s: i for i, s in enumerate(sorted(set().union(*by_fold)))}
    voting = [{vocabulary[s]: voter for s, voter in x.items()} for x in by_fold]
    read = cut(texts.mapInPandas(_reader(vocabulary, voting), f"id {kind}, key binary, text_key binary, votes long, at array<int>, value array<double>"), "votes")

    voted = read.select("id", "key", "votes").join(known.withColumnRenamed("toxic", "said"), F.col("id") == F.col("label_id"), "left")
    patterns = voted.groupBy("votes").agg(
        F.count_if(F.col("said").isNull()).alias("none"), F.count_if(F.col("said") == 0).alias("clean"), F.count_if(F.col("said") == 1).alias("toxic"),
    ).orderBy("votes").toPandas()
    logits = label_model(_patterns(patterns["votes"]), patterns[["none", "clean", "toxic"]].to_numpy(float))
    at = {x: i for i, x in enumerate(patterns["votes"].tolist())}

    n_free = int(patterns["none"].sum())
    marked = labels.select(F.col(id_col).alias("label_id")).where(F.col("label_id").isNotNull()).distinct()
    free = read.join(marked, F.col("id") == F.col("label_id"), "left_anti").where(_under(F.xxhash64("text_key", F.lit(2)), sample, n_free))
    said = labelled.select(F.col("key").alias("own"), F.col("toxic").alias("said"))
    learned = read.join(F.broadcast(said), F.col("key") == F.col("own")).drop("own").unionByName(free.withColumn("said", F.lit(None).cast("int")))
    rows = learned.dropDuplicates(["key"]).orderBy("text_key", "said").select("votes", "at", "value", "said").toPandas()  # votes and numbers of about 2 * ``sample`` rows
    state = rows["said"].isna().map({True: 0, False: 1}).to_numpy(int) + rows["said"].fillna(0).to_numpy(int)
    target = _target(logits[[at[x] for x in rows["votes"]], state]) if len(rows) else np.zeros(0)
    w, bias = fit_classifier(list(rows["at"]), list(rows["value"]), _patterns(rows["votes"]).astype(float), target, len(vocabulary))
    model = spark.sparkContext.broadcast((w, bias))  # at most FOLDS * STEMS + len(VOTERS) numbers
    n_stems = len(vocabulary)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, bias = model.value
        voted: dict[int, float] = {}
        for rows in batches:
            for x in set(rows["votes"].tolist()) - voted.keys():
                voted[x] = bias + float(np.dot(_patterns([x])[0], w[n_stems:]))
            z = np.array([voted[x] + (float(np.dot(w[np.asarray(a, np.int64)], v)) if len(a) else 0.0) for x, a, v in zip(rows["votes"], rows["at"], rows["value"], strict=True)])
            yield pd.DataFrame({"id": rows["id"], "key": rows["key"], "votes": rows["votes"], "score": _target(z).round(12)})

    scored = read.mapInPandas(score, f"id {kind}, key binary, votes long, score double")
    return scored.select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "votes", F.col("key").alias("row_key"))
