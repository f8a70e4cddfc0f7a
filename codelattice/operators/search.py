"""Ranked search over text: an inverted index, BM25, and its blends with rank."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.operators.keep import keep_first
from codelattice.operators.lineage import cut

K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9_]+)"), F.lit(1))


def inverted_index(docs: DataFrame, key: str = "id", text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(term, key, tf, length). With ``only`` (term), just those terms: Spark joins them before the count
    and broadcasts them where they are few."""
    rows = docs.select(key, terms(F.col(text)).alias("t")).select(key, F.size("t").alias("length"), F.explode("t").alias("term"))
    if only is not None:
        rows = rows.join(only.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def bm25_top(docs: DataFrame, questions: DataFrame, key: str = "id", question: str = "question", text: str = "text", most: int = 20) -> DataFrame:
    """(question, key, score): the ``most`` best documents of every question (question, text).

    Texts are cut into words once; lengths and the wanted terms' counts come from that pass, written once. A
    document's part of a term is worked out before it meets the questions that ask for the term.
    """
    wanted = cut(questions.select(question, F.explode(F.array_distinct(terms(F.col("text")))).alias("term")), "questions")
    counted = docs.select(F.col(key), terms(F.col(text)).alias("t")).select(key, F.size("t").alias("length"), "t")
    index = cut(inverted_index(docs, key, text, wanted), "index")
    whole = counted.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    j = index.join(df, "term").join(F.broadcast(whole))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = j.select("term", key, part.alias("part")).join(wanted, "term").groupBy(question, key).agg(F.sum("part").alias("score"))
    return keep_first(scored, [question], [F.round("score", 9).desc(), F.col(key)], most)


def bm25(docs: DataFrame, query: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, score) of the documents with any term of ``query`` (term: as small as the question).

    The number of documents and their mean length come from one pass over all documents.
    """
    index = inverted_index(docs, key, text, query)
    whole = docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(terms(F.col(text)))).alias("mean"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    j = index.join(df, "term").join(F.broadcast(whole))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return j.groupBy(key).agg(F.sum(part).alias("score"))


def blended(scores: DataFrame, ranks: DataFrame, key: str = "id", text_weight: float = 0.7, default_rank: float = 0.1) -> DataFrame:
    """0.7 of the text score and 0.3 of the rank, which is ``default_rank`` where there is none."""
    others = [c for c in scores.columns if c not in (key, "score")]
    return scores.join(ranks.select(key, "rank"), key, "left").select(
        *others, key, (text_weight * F.col("score") + (1 - text_weight) * F.coalesce("rank", F.lit(default_rank))).alias("score"))


def contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))


def fallback_search(nodes: DataFrame, words: list[str], rank: str = "rank") -> DataFrame:
    """Nodes whose name has any of the words, scored min(1, rank + 0.5)."""
    return nodes.where(contains_any(F.col("name"), [w.lower() for w in words])).withColumn(
        "score", F.least(F.lit(1.0), F.coalesce(rank, F.lit(0.0)) + 0.5))


def similar_by_keyword(nodes: DataFrame, words: list[str], limit: int) -> DataFrame:
    """For each of the first three words the nodes with it in their name; each name once, under the
    first word that finds it."""
    table = F.array(*(F.struct(F.lit(n).alias("priority"), F.lit(w.lower()).alias("word")) for n, w in enumerate(words[:3])))
    hits = nodes.select("*", F.explode(table).alias("_k")).where(F.contains(F.lower("name"), F.col("_k.word"))).select(*nodes.columns, "_k.priority", "_k.word")
    return keep_first(hits, ["name"], [F.col("priority"), F.col("id")]).orderBy("priority", "name").limit(limit)


def fuzzy(nodes: DataFrame, question: str, most: int) -> DataFrame:
    """Nodes whose name contains the question, or its words in their order with anything between; an exact name comes first."""
    low = question.lower()
    words = [w for w in re.split(r"[\s_]+", low) if w]
    hit = F.contains(F.lower("name"), F.lit(low)) | F.lower("name").rlike(".*".join(map(re.escape, words)))
    return nodes.where(hit).orderBy(F.when(F.lower("name") == low, 0).otherwise(1), "name", "id").limit(most)


def exact_then_partial(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes of that name or, if there are none, those that contain it."""
    low = name.lower()
    hits = nodes.where(F.contains(F.lower("name"), F.lit(low))).withColumn("tier", F.when(F.lower("name") == low, 0).otherwise(1))
    return hits.join(F.broadcast(hits.agg(F.min("tier").alias("_best"))), F.col("tier") == F.col("_best")).drop("_best")


def tiered(frames: list[DataFrame], key: str = "name") -> DataFrame:
    """Several searches in order: each key once, from the first search that has it."""
    every = frames[0].withColumn("tier", F.lit(0))
    for n, f in enumerate(frames[1:], 1):
        every = every.unionByName(f.withColumn("tier", F.lit(n)), allowMissingColumns=True)
    return keep_first(every, [key], [F.col("tier"), F.col("id")])


def undocumented(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...], limit: int = 100) -> DataFrame:
    """Nodes that are not documented (a column of that name) but called, with the number of callers, most called first."""
    callers = edges.where(F.col("type").isin(*types)).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    return nodes.where("not documented").join(callers, "id").orderBy(F.desc("callers"), "id").limit(limit)
