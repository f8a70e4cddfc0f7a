"""Which intervals of a file enclose a place: one sort a file, whatever the number of intervals."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def innermost(points: DataFrame, intervals: DataFrame, by: str = "path") -> DataFrame:
    """(id, owner, depth): the smallest interval of the same ``by`` that encloses a point, and how many do.

    ``points`` has ``by``, id and at; ``intervals`` has ``by``, owner, first and last, both included. Of intervals of equal length the smaller
    owner counts. Starts and points are sorted together and swept once per ``by``; open intervals wait in a heap by length and one by end, so n
    of them cost n log n and memory for those open at a time. They may overlap in any way. Points outside all intervals are
    left out, as are rows with a null in ``by``, place or end.
    """
    point_kind, owner_kind = dict(points.dtypes)["id"], dict(intervals.dtypes)["owner"]
    opens = intervals.select(by, F.col("first").cast("long").alias("pos"), F.lit(0).alias("is_point"), F.lit(None).cast(point_kind).alias("id"), "owner", F.col("last").cast("long").alias("last"))
    asks = points.select(by, F.col("at").cast("long").alias("pos"), F.lit(1).alias("is_point"), "id", F.lit(None).cast(owner_kind).alias("owner"), F.lit(0).cast("long").alias("last"))
    events = opens.where("last >= pos").union(asks).where(F.col(by).isNotNull() & F.col("pos").isNotNull())

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, sizes, ends, owners = None, [], [], []
        for rows in batches:
            out = []
            for key, pos, is_point, i, owner, last in zip(*(rows[c].tolist() for c in (by, "pos", "is_point", "id", "owner", "last")), strict=True):
                if key != group:
                    group, sizes, ends, owners = key, [], [], []
                if not is_point:
                    # A struct is compared by its fields; the count tells equal ones apart.
                    rank = tuple(owner.values()) if isinstance(owner, dict) else owner
                    heapq.heappush(sizes, (last - pos, rank, len(owners), last))
                    owners.append(owner)
                    heapq.heappush(ends, last)
                    continue
                while sizes and sizes[0][3] < pos:
                    heapq.heappop(sizes)
                while ends and ends[0] < pos:
                    heapq.heappop(ends)
                if sizes:
                    out.append((i, owners[sizes[0][2]], len(ends)))
            yield pd.DataFrame(out, columns=["id", "owner", "depth"])

    ordered = events.repartition(F.col(by)).sortWithinPartitions(by, "pos", "is_point")
    return ordered.mapInPandas(sweep, f"id {point_kind}, owner {owner_kind}, depth int")
