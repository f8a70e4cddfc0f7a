"""A corpus in five stages: toxic documents go, repeated lines go, near-duplicates go, documents
with benchmark passages go, and the sources are mixed to their target weights.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm.common import cut, free_name, row_key
from codelattice.llm.decontamination import decontaminate
from codelattice.llm.line_dedup import dedup_lines
from codelattice.llm.mixing import mix_sources
from codelattice.llm.simhash import similar_documents
from codelattice.llm.toxicity import score_toxicity


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is not in ``keys`` (row_key)."""
    key = free_name(docs, "key")
    return docs.withColumn(key, row_key("doc_id", "text")).join(keys.select(F.col("row_key").alias(key)).distinct(), key, "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; all others stay as they are."""
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.where("predicted = 1"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later places of repeated three-line windows go; every document stays, if need be empty.
    n_chars follows the new text."""
    kept = dedup_lines(docs).select(docs.columns)
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast(dict(docs.dtypes)["n_chars"]), F.col("n_chars")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a five-word shingle similarity of 0.8 or more the one with
    the smallest id stays, once."""
    key = free_name(docs, "key")
    kept = similar_documents(docs).where("kept").select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, row_key("doc_id", "text")).join(kept, key, "left_semi").dropDuplicates([key]).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten words of a benchmark item (or a whole shorter item) go."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, numbered in ``copy``; rows equal in id and
    text share their number of copies. Where documents have a column ``copy`` the number's is ``copy_``."""
    key, n = free_name(docs, "key"), free_name(docs, "copies")
    copies = mix_sources(docs).groupBy(F.col("row_key").alias(key)).agg(F.sum("copies").cast("int").alias(n)).where(F.col(n) > 0)
    once = docs.withColumn(key, row_key("doc_id", "text")).dropDuplicates([key])
    return once.join(copies, key).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(free_name(docs, "copy")))


STAGES = [
    ("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination), ("mixing", mixing),
]

#: Trained scores, SimHash and a knapsack are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
