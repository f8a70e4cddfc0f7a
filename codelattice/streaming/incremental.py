"""Incremental re-indexing: hash comparison, index state, resume, retention, and a streaming ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codelattice.operators.keep import keep_first, upsert


def diff_files(old: DataFrame, new: DataFrame, *, force: bool = False, old_version: str | None = None, version: str | None = None) -> DataFrame:
    """(path, change): added, modified, unchanged or deleted, from (path, content_hash) of both sides.

    A missing hash counts as modified; with ``force`` or another index version every file that is
    still there is modified or added.
    """
    again = force or (version is not None and old_version != version)
    a = old.select("path", F.col("content_hash").alias("_old"), F.lit(True).alias("_had"))
    b = new.select("path", F.col("content_hash").alias("_new"), F.lit(True).alias("_has"))
    change = (
        F.when(F.col("_has").isNull(), "deleted").when(F.col("_had").isNull(), "added")
        .when(F.lit(again) | F.col("_old").isNull() | F.col("_new").isNull() | (F.col("_old") != F.col("_new")), "modified").otherwise("unchanged")
    )
    return a.join(b, "path", "full").select("path", change.alias("change"))


def verify_changes(listed: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """A version-control change list (path, status, old_path) checked against the hashes: listed
    files whose content did not change drop out; a rename is a removal and an addition, a copy an
    addition, a change of type a modification."""
    moved = listed.where(F.col("status") == "R").select(F.col("old_path").alias("path"))
    named = listed.select("path").unionByName(moved).distinct()
    return diff_files(old, new).join(named, "path", "left_semi").where("change <> 'unchanged'")


def save_state(old: DataFrame, processed: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """The index state after some files: their hashes replaced, deleted ones gone."""
    state = upsert(old, processed, "path")
    return state if deleted is None else state.join(deleted.select("path"), "path", "left_anti")


def remaining(files: DataFrame, processed: DataFrame) -> DataFrame:
    """What a resumed run still has to do."""
    return files.join(processed.select("path"), "path", "left_anti")


def delete_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of the given files; an edge goes with either end."""
    gone = nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("entity_id").alias("_gone"))
    kept = nodes.join(gone, nodes["entity_id"] == F.col("_gone"), "left_anti")
    left = edges.join(gone, edges["src"] == F.col("_gone"), "left_anti").join(gone, F.col("dst") == F.col("_gone"), "left_anti")
    return kept, left


def deletion_counts(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, nodes_deleted, edges_deleted): what ``delete_files`` takes away for each path; an edge counts for each of its ends' paths once. Paths without nodes
    have no row."""
    gone = nodes.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select(F.col("file_path").alias("path"), "entity_id")
    names = edges.columns
    by = lambda end: edges.join(gone.withColumnRenamed("entity_id", end), end).select("path", *names)
    n = gone.groupBy("path").agg(F.count("*").alias("nodes_deleted"))
    e = by("src").union(by("dst")).distinct().groupBy("path").agg(F.count("*").alias("edges_deleted"))
    return n.join(e, "path", "left").select("path", "nodes_deleted", F.coalesce("edges_deleted", F.lit(0).cast("long")).alias("edges_deleted"))


def unexpired(history: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Rows that retention keeps: those without an end, or with one that is not past."""
    return history.where(F.col(expires).isNull() | (F.col(expires) >= now))


def latest_checkpoint(checkpoints: DataFrame, run: str = "run_id", at: str = "updated_at", *tie: str) -> DataFrame:
    return keep_first(checkpoints, [run], [F.col(at).desc(), *map(F.col, tie)])


# The phases of a run, in order.
PHASES = ("pending", "scanning", "diffing", "parsing", "linking", "storing_nodes", "storing_edges", "ranking", "completed", "failed")


def run_progress(log: DataFrame) -> DataFrame:
    """Per run the furthest phase, how many files its batches stored, and whether it failed."""
    order = F.array_position(F.array(*map(F.lit, PHASES[:-1])), F.col("phase"))
    return log.groupBy("run_id").agg(
        F.max_by("phase", order).alias("phase"), F.sum(F.coalesce("files", F.lit(0))).alias("files"), F.bool_or(F.col("phase") == "failed").alias("failed"))


def stream_files(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream, so many at a time."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_batch).load(folder)


def ingest(stream: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = True, seconds: int = 2) -> StreamingQuery:
    """Store a stream batch by batch. The checkpoint resumes after a failure; ``store`` gets the
    batch's number, by which it tells a repeated batch."""
    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def append_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A store that keeps each batch in a folder of its number: writing it again replaces it."""
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return store


def windowed_activity(events: DataFrame, *, late: str = "10 minutes", window: str = "1 hour", at: str = "ts") -> DataFrame:
    """Events per window and type, for streams and tables; late events beyond the watermark drop out
    of a stream."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
