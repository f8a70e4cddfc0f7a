"""A stored full-text index: postings by hash of the term, upkeep of changed documents only, top documents by score bounds."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType

from codelattice.operators.keep import keep_first
from codelattice.operators.lineage import Scratch, cut
from codelattice.operators.search import K1, B, terms
from codelattice.sources.buckets import BucketStore

#: Terms of a question, those of the highest bounds, by which its threshold is set.
SEEDS = 2


@F.pandas_udf(MapType(StringType(), IntegerType()))
def _counted(words: pd.Series) -> pd.Series:
    """How often each word stands in a list."""
    return words.map(lambda w: dict(Counter(w)))


class TextIndex:
    """Tables under a path:

    ``documents`` (id, scope, hash, length, version) and ``terms`` (term, df, max_tf) are bucket stores; ``postings`` (term, id, scope, version, tf, length), partitioned by
    a hash of the term, only grows; ``stale`` (id, version) names the versions that count no more. An update cuts only the texts that have changed, appends their
    postings and corrects the frequencies of their words, old (found by a scan of the postings' ids) and new, so a search gives what an index made anew would. ``compact`` drops stale postings.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "string", buckets: int = 64):
        self.spark, self.path, self.id_type, self.buckets = spark, path.rstrip("/"), id_type, buckets
        self.documents = BucketStore(spark, f"{self.path}/documents", f"id {id_type}, scope string, hash string, length int, version long", "id", buckets)
        self.terms = BucketStore(spark, f"{self.path}/terms", "term string, df long, max_tf int", "term", buckets)

    def _read(self, name: str, schema: str) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
        return self.spark.read.schema(schema).parquet(where.toString()) if there else self.spark.createDataFrame([], schema)

    def _bucket(self):
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def postings(self) -> DataFrame:
        return self._read("postings", f"term string, id {self.id_type}, scope string, version long, tf int, length int, bucket int")

    def stale(self) -> DataFrame:
        return self._read("stale", f"id {self.id_type}, version long")

    def update(self, rows: DataFrame, gone: DataFrame | None = None) -> dict[str, int]:
        """Take in (id, scope, text) rows and drop the documents ``gone`` (id): {"indexed", "unchanged", "deleted"}.

        A document counts as changed if the hash of its text or its scope differs from what is stored. Null texts have no words; of rows with
        one id the largest by scope and text counts; null ids are left out.
        """
        with Scratch(self.spark) as scratch:
            return self._update(rows, gone, scratch)

    def _update(self, rows: DataFrame, gone: DataFrame | None, scratch: Scratch) -> dict[str, int]:
        new = keep_first(rows.where("id is not null").select("id", "scope", "text"), ["id"], [F.col("scope").desc(), F.col("text").desc()])
        new = new.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
        old = self.documents.read()
        version = (old.agg(F.max("version")).first()[0] or 0) + 1
        seen = old.select("id", F.col("hash").alias("_hash"), F.col("scope").alias("_scope"))
        changed = new.join(seen, "id", "left").where("_hash is null or _hash <> hash or not (scope <=> _scope)").select("id", "scope", "hash", terms(F.col("text")).alias("w"))
        # One row a changed document, with its words counted: all that the postings and frequencies need.
        docs = scratch.cut(changed.select("id", "scope", "hash", F.size("w").alias("length"), F.lit(version).cast("long").alias("version"), _counted("w").alias("words")), "documents")
        drop = scratch.cut((gone.select("id") if gone is not None else docs.select("id").limit(0)).distinct().join(docs.select("id"), "id", "left_anti").join(old.select("id"), "id", "left_semi"), "dropped")
        replaced = scratch.cut(old.join(docs.select("id").union(drop.select("id")), "id", "left_semi").select("id", "version"), "replaced")
        n_replaced = replaced.count()
        # Frequencies: words of replaced versions leave, those of new ones come.
        words = docs.select("id", "scope", "version", "length", F.explode("words").alias("term", "tf"))
        delta = words.select("term", F.lit(1).alias("n"), "tf")
        if n_replaced:
            less = self.postings().select("term", "id", "version").join(replaced, ["id", "version"], "left_semi")
            delta = delta.union(less.select("term", F.lit(-1), F.lit(0)))
        delta = delta.groupBy("term").agg(F.sum("n").alias("n"), F.max("tf").alias("tf"))
        known = self.terms.read().select("term", "df", "max_tf")
        corrected = scratch.cut(delta.join(known, "term", "left").select("term", (F.coalesce("df", F.lit(0)) + F.col("n")).cast("long").alias("df"), F.greatest(F.coalesce("max_tf", F.lit(0)), "tf").cast("int").alias("max_tf")), "terms")
        if n_replaced:
            replaced.write.mode("append").parquet(f"{self.path}/stale")
        posted = words.select("term", "id", "scope", "version", "tf", "length", self._bucket().alias("bucket"))
        posted.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        self.terms.merge(corrected, props=None, unique=True)
        self.documents.merge(docs.drop("words"), props=None, unique=True)
        n_dropped = self.documents.delete(drop)["deleted"] if not drop.isEmpty() else 0
        n = docs.count()
        return {"indexed": n, "unchanged": new.count() - n, "deleted": n_dropped}

    def search(self, questions: DataFrame, most: int = 20, *, by_scope: bool = False, question: str = "question") -> DataFrame:
        """(question, scope, id, score, rank): the ``most`` best documents (of each scope) by BM25 of every question (question, text), ties by id.

        Only the buckets of asked terms are read. The SEEDS terms of the highest bounds give a first score, whose ``most``-th best is a threshold: terms whose
        bounds together stay under it can't lift a document over it by themselves, so documents that hold none of the other terms are never scored. A bound is what
        a term can give at most, from its stored frequency and its largest count. Results are those of scoring everything.
        """
        scope = F.col("scope") if by_scope else F.lit(None).cast("string").alias("scope")
        whole = self.documents.read().agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean"))
        asked = questions.select(F.col(question).alias("question"), F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        bound = F.col("idf") * F.col("max_tf") * (K1 + 1) / (F.col("max_tf") + K1 * (1 - B))
        best_first = Window.partitionBy("question").orderBy(F.desc("bound"), "term")
        wanted = asked.join(self.terms.read().where("df > 0"), "term").join(F.broadcast(whole)).withColumn("idf", idf).withColumn("bound", bound)
        wanted = cut(wanted.withColumn("place", F.row_number().over(best_first)), "asked")
        buckets = [r.b for r in wanted.select(self._bucket().alias("b")).distinct().collect()]  # at most ``buckets``
        live = self.postings().where(F.col("bucket").isin(buckets)).join(wanted.select("term").distinct(), "term", "left_semi").join(self.stale(), ["id", "version"], "left_anti")
        part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        hits = cut(live.join(wanted, "term").select("question", scope.alias("scope"), "id", "term", "place", part.alias("part")), "hits")

        group = Window.partitionBy("question", "scope").orderBy(F.desc("score"))
        first = hits.where(F.col("place") <= SEEDS).groupBy("question", "scope", "id").agg(F.sum("part").alias("score"))
        level = first.withColumn("r", F.row_number().over(group)).where(F.col("r") == most).select(F.col("question").alias("lq"), F.col("scope").alias("ls"), F.col("score").alias("level"))
        weak_first = Window.partitionBy("question").orderBy("bound", F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
        sums = wanted.withColumn("upto", F.sum("bound").over(weak_first)).select("question", "term", "upto")
        same = (F.col("question") == F.col("lq")) & F.col("scope").eqNullSafe(F.col("ls"))
        strong = hits.join(sums, ["question", "term"]).join(level, same, "left").where("level is null or upto + 1e-6 >= level")
        chosen = strong.select(F.col("question").alias("q"), F.col("scope").alias("s"), F.col("id").alias("i")).distinct()
        scored = hits.join(chosen, (F.col("question") == F.col("q")) & F.col("scope").eqNullSafe(F.col("s")) & (F.col("id") == F.col("i")), "left_semi").groupBy("question", "scope", "id").agg(F.sum("part").alias("score"))
        ranked = Window.partitionBy("question", "scope").orderBy(F.round("score", 9).desc(), "id")
        return scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most).withColumnRenamed("question", question)

    def compact(self) -> int:
        """Rewrite the buckets that hold stale postings without them; how many postings went. Frequencies are right already, but the largest counts of terms are not lowered."""
        old = self.postings()
        dead = cut(old.join(self.stale(), ["id", "version"], "left_semi"), "dead")
        touched = [r.bucket for r in dead.select("bucket").distinct().collect()]
        kept = cut(old.where(F.col("bucket").isin(touched)).join(self.stale(), ["id", "version"], "left_anti").select(old.columns), "kept")
        fs = lambda p: (p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()))
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        kept.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/postings")
        for b in set(touched) - {r.bucket for r in kept.select("bucket").distinct().collect()}:
            p, f = fs(path(f"{self.path}/postings/bucket={b}"))
            f.delete(p, True)
        p, f = fs(path(f"{self.path}/stale"))
        f.delete(p, True)
        return dead.count()
