"""Mixing sources to target weights by fitting word budgets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.llm.common import cut, row_key

#: Weights of the sources in code-point order, repeated as often as needed.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source gives at most so many times its own words, and a document so many times its own.
MOST = 3
#: The knapsack table has at most so many cells; larger rests are first filled with long documents.
BUDGET_CELLS = 1 << 16
#: Parts that each (source, length) class is dealt into for ranking.
PARTS = 64


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in code-point order, null last, get the repeating weights. All words are shared by
    weight; a target stops at ``most`` times its source's words and the excess goes to the others
    by weight until none is above. In closed form: with sources in the order of cap / weight, the
    capped ones are a prefix, and the rest share what is left. Windows run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    table = F.array(*map(F.lit, weights))
    per = per.withColumn("weight", F.element_at(table, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * most
    by = Window.partitionBy(F.lit(0)).orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    level = per.select(
        "source", "source_size", "weight", cap.alias("cap"), F.row_number().over(by).alias("at"),
        ((F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
         / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"),
    )
    # The first source that is under its cap at the level left for it and those after it sets the level.
    under = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("at", "level"))
    level = level.withColumn("first", F.min(under).over(whole))
    return level.select(
        "source", "source_size",
        F.when(F.col("at") >= F.col("first.at"), F.col("first.level") * F.col("weight")).otherwise(F.col("cap")).cast("double").alias("target"),
    )


def _closest(lengths: np.ndarray, left: np.ndarray, rest: int, cells: int) -> np.ndarray:
    """How many of ``left`` of each length come closest to ``rest`` together, by a bounded-knapsack table."""
    take = np.zeros(len(lengths), np.int64)
    if rest <= 0:
        return take
    wide = rest + min(rest, cells, int(lengths.max(initial=0)))
    # last[s]: the length whose documents complete the sum s first; used[s]: how many of them.
    last = np.full(wide + 1, -1, np.int64)
    used = np.zeros(wide + 1, np.int64)
    reach = np.zeros(wide + 1, bool)
    reach[0] = True
    for i in np.argsort(-lengths, kind="stable"):
        w, c = int(lengths[i]), int(left[i])
        if reach[rest]:
            break
        if not w or not c or w > wide:
            continue
        old = reach.copy()
        for k in range(1, min(c, wide // w) + 1):
            new = np.zeros_like(reach)
            new[k * w :] = old[: wide + 1 - k * w]
            new &= ~reach
            if not new.any():
                break
            last[new], used[new] = i, k
            reach |= new
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - rest))])  # of two equally near the smaller
    while at > 0:
        i, k = int(last[at]), int(used[at])
        take[i] += k
        at -= k * int(lengths[i])
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, cells: int = BUDGET_CELLS, most: int = 1) -> np.ndarray:
    """How many copies of documents of each length to take, ``most`` a document, so that their words come closest to ``budget``.

    Every length first gives its even share of the budget, rounded down. Of what is left over, long documents
    fill the rest until it fits the table; a bounded-knapsack table over the copies that remain then
    finds the sum closest to it. Where that misses the budget, part of the even shares, at last as many words as the table has
    cells, is traded back and fitted anew: up to that budget every choice of copies is looked at.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total <= 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total * most:
        return counts * most
    best, gap = None, None
    for slack in (0, cells // 64, cells // 8, cells):
        goal = max(0, budget - slack)
        take = np.array([int(c) * goal // total for c in counts], np.int64)
        left = np.where(lengths > 0, counts * most - take, 0)
        rest = budget - int((take * lengths).sum())
        for i in np.argsort(-lengths, kind="stable"):
            if rest <= cells:
                break
            n = min(int(left[i]), (rest - cells // 2) // int(lengths[i])) if lengths[i] else 0
            if n > 0:
                take[i] += n
                left[i] -= n
                rest -= n * int(lengths[i])
        take = take + _closest(lengths, left, min(rest, cells * 4), cells)
        miss = abs(budget - int((take * lengths).sum()))
        if gap is None or miss < gap:
            best, gap = take, miss
        if not gap or not goal:
            break
    return best


def _fit(most: int, cells: int):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ignore_index=True)
        docs = rows["docs"].to_numpy(np.int64)
        copies = fit_budget(rows["size"].to_numpy(np.int64), docs, round(float(rows["target"].iloc[0])), cells, most)
        rows["whole"], rows["extra"] = copies // docs, copies % docs
        return rows[["source", "size", "target", "source_size", "whole", "extra"]]

    return fit


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 42, cells: int = BUDGET_CELLS,
) -> DataFrame:
    """Decide how often the mix takes each document.

    A document's size is its number of words (runs of characters other than space and U+0009 to
    U+000D; null: 0). A source's target is fitted by ``fit_budget``, with up to ``most`` copies of each
    document, on the source's table of exact lengths, which has a row per distinct length, never per document. The copies
    of a length are dealt evenly over its documents. Within a (source, length) class the seeded hash
    of the id, then the row's digest, orders documents; classes are dealt into ``PARTS`` by that
    hash, so that a class with a third of all rows is ranked by many tasks.

    Returns ``id_col``, size, source (as ``source_name``), source_size, target, taken, copies,
    row_key: one row per input row. Rows equal in id and text share a place in the order: ties are broken at
    random but stay the same while the input files do. Null sources form a source of their own;
    empty tables give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = cut(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
            row_key(id_col, text_col).alias("key"),
        ).withColumn("order", F.xxhash64(F.lit(seed), F.col("id"), F.col("key"))).withColumn("row", F.monotonically_increasing_id()),
        "sizes",
    )
    lengths = sizes.groupBy("source", "size").agg(F.count("*").alias("docs"))
    goal = source_targets(sizes, weights, most)
    goal = cut(goal.select("source", "source_size", "target"), "targets")
    # Spark groups null keys together; a marker keeps the null source apart from the empty string.
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    wanted = lengths.alias("l").join(goal.alias("g"), same("l", "g")).select("l.source", "size", "docs", "source_size", "target")
    schema = f"source {dict(sizes.dtypes)['source']}, size long, target double, source_size long, whole long, extra long"
    plan = cut(wanted.groupBy("source").applyInPandas(_fit(most, cells), schema), "takes")
    part = F.pmod(F.shiftright("order", 40), F.lit(PARTS)).alias("part")
    parts = sizes.groupBy("source", "size", part).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    parts = parts.alias("p").join(plan.alias("t"), same("p", "t") & (F.col("p.size") == F.col("t.size"))).select(
        "p.source", "p.size", "part", "before", "target", "source_size", "whole", "extra")
    ranked = sizes.select("*", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("order", "row")))
    copies = F.col("whole") + ((F.col("before") + F.col("rank")) <= F.col("extra")).cast("long")
    return ranked.alias("r").join(
        parts.alias("q"), same("r", "q") & (F.col("r.size") == F.col("q.size")) & (F.col("r.part") == F.col("q.part")),
    ).select(
        F.col("id").alias(id_col), F.col("r.size").alias("size"), F.col("r.source").alias("source_name"), "source_size", "target",
        (copies * F.col("r.size")).alias("taken"), copies.alias("copies"), F.col("r.key").alias("row_key"),
    )
