"""First, last and best rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key in a total order (Spark limits groups before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= n).drop("_at")


def relevance_floor(scored: DataFrame, *, floor: float = 0.5, least: int = 5, most: int = 100, score: str = "score", key: str = "id") -> DataFrame:
    """Rows with at least ``floor``, or else the best ``least`` rows; at most ``most``."""
    top = scored.orderBy(F.col(score).desc(), key).limit(most)
    w = Window.partitionBy(F.lit(0)).orderBy(F.col(score).desc(), key)  # over ``most`` rows
    return top.withColumn("_at", F.row_number().over(w)).where((F.col(score) >= floor) | (F.col("_at") <= least)).drop("_at")


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page and, on each row, the number of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key. Within ``new`` keys are
    unique; columns that only one side has are null on the other."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_props(old: DataFrame, new: DataFrame, key: str, props: str = "props") -> DataFrame:
    """Property maps of both, the newer value where both have one."""
    a, b = old.select(key, F.col(props).alias("_a")), new.select(key, F.col(props).alias("_b"))
    empty = F.create_map().cast("map<string,string>")
    fresh = F.coalesce("_b", empty)
    stale = F.map_filter(F.coalesce("_a", empty), lambda k, _: ~F.map_contains_key(fresh, k))
    return a.join(b, key, "full").select(key, F.map_concat(stale, fresh).alias(props))
