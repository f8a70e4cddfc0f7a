"""A store of keyed rows in hash buckets: merges and deletions rewrite the buckets that they touch, and no others."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.operators.keep import keep_first
from codelattice.operators.lineage import Scratch, cut

#: Columns of an edge that a match leaves as they were created.
CREATED = ("type", "created_at", "weight")


class BucketStore:
    """Rows under a path, partitioned by ``bucket``, a hash of the key modulo ``buckets``.

    A merge reads only the buckets of its keys (partition pruning), joins within them and replaces just those by dynamic partition overwrite; the merged rows are
    written to the shared folder before they replace anything, so a failure up to then leaves the store as it was.
    One writer at a time. The number of buckets belongs to the store; choose it so that a bucket is about one file.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "entity_id", buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def _stored(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
        schema = f"{self.schema}, bucket int"
        return self.spark.read.schema(schema).parquet(self.path) if there else self.spark.createDataFrame([], schema)

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int").alias("bucket")

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def lookup(self, keys: list) -> DataFrame:
        """The rows of some keys, from their buckets alone."""
        asked = self.spark.createDataFrame([(k,) for k in keys], f"{self.key} {dict(self.read().dtypes)[self.key]}")
        at = [r.bucket for r in asked.select(self._bucket()).distinct().collect()]
        return self._stored().where(F.col("bucket").isin(at)).drop("bucket").join(F.broadcast(asked), self.key, "left_semi")

    def _replace(self, rows: DataFrame, buckets: list[int]) -> None:
        with Scratch(self.spark) as scratch:
            rows = scratch.cut(rows, "merged")
            empty = set(buckets) - {r.bucket for r in rows.select("bucket").distinct().collect()}
            rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for b in empty:  # overwriting leaves partitions that have no rows any more
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={b}")
            folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)

    def merge(self, new: DataFrame, *, keep: tuple[str, ...] = (), props: str | None = "props", order: str | None = None, unique: bool = False) -> dict[str, int]:
        """Create rows with new keys and change those that match: {"created", "matched", "buckets"}.

        A match takes the new values, but for the columns ``keep``, which stay as created, and for nulls; of property maps both sides count, the newer
        value where both have one. Of rows with the same key the last by ``order`` counts (without one, the largest hash); null keys are an error. Rows that are
        known to be ``unique``, and written already, are not written once more.
        """
        with Scratch(self.spark) as scratch:
            return self._merge(new, keep, props, order, unique, scratch)

    def _merge(self, new: DataFrame, keep: tuple[str, ...], props: str | None, order: str | None, unique: bool, scratch: Scratch) -> dict[str, int]:
        columns = self.read().columns
        bad = F.raise_error(F.lit("a row without a key")).cast(dict(self.read().dtypes)[self.key])
        new = new.withColumn(self.key, F.coalesce(F.col(self.key), bad))
        held = [c for c in new.columns if "map<" not in dict(new.dtypes)[c]]
        first = new if unique else keep_first(new, [self.key], [F.col(order).desc() if order else F.xxhash64(*held).desc()])
        new = first.select(*(F.col(c) if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in self.read().dtypes), self._bucket())
        new = new if unique else scratch.cut(new, "new-rows")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        old = self._stored().where(F.col("bucket").isin(touched))
        a, b = old.select(*(F.col(c).alias(f"_a_{c}") for c in columns), F.col("bucket").alias("_a_bucket"), F.lit(True).alias("_had")), new.withColumn("_new", F.lit(True))
        joined = b.join(a, F.col(self.key) == F.col(f"_a_{self.key}"), "full")

        def value(c: str):
            mine, theirs = F.col(c), F.col(f"_a_{c}")
            if c == props:
                empty = F.create_map().cast(dict(new.dtypes)[c])
                stale = F.map_filter(F.coalesce(theirs, empty), lambda k, _: ~F.map_contains_key(F.coalesce(mine, empty), k))
                return F.when(theirs.isNull() & mine.isNull(), None).otherwise(F.map_concat(stale, F.coalesce(mine, empty)))
            return F.when(F.col("_had").isNotNull(), theirs).otherwise(mine) if c in keep else F.coalesce(mine, theirs)

        merged = joined.select(*(value(c).alias(c) for c in columns), F.coalesce("bucket", "_a_bucket").alias("bucket"))
        matched = new.join(old.select(self.key), self.key, "left_semi").count()
        total = new.count()
        self._replace(merged, touched)
        return {"created": total - matched, "matched": matched, "buckets": len(touched)}

    def delete(self, keys: DataFrame) -> dict[str, int]:
        """Delete the rows of some keys (a column of the key's name): {"deleted", "buckets"}."""
        with Scratch(self.spark) as scratch:
            gone = scratch.cut(keys.select(self.key, self._bucket()).where(F.col(self.key).isNotNull()).distinct(), "gone")
            touched = [r.bucket for r in gone.select("bucket").distinct().collect()]
            old = self._stored().where(F.col("bucket").isin(touched))
            n = old.join(gone.select(self.key), self.key, "left_semi").count()
            self._replace(old.join(gone.select(self.key), self.key, "left_anti"), touched)
        return {"deleted": n, "buckets": len(touched)}


def merge_edges(store: BucketStore, edges: DataFrame) -> dict[str, int]:
    """Edges with properties: a match keeps the type, time and weight of its creation and takes further properties."""
    return store.merge(edges, keep=CREATED)


def store_batches(rows: DataFrame, batches: int, save: Callable[[DataFrame, int], dict[str, int]], key: str = "entity_id", by: str | None = None) -> DataFrame:
    """Save rows in so many batches and tell of each: (batch, rows, created, matched, status, error).

    A row's batch is its column ``by``, else a hash of its key. A batch that fails is put on record with the first line of its error, and the others are saved all the same. The number of batches is
    the caller's; the loop runs on the driver, each batch's work on the cluster.
    """
    spark = rows.sparkSession
    dealt = cut(rows.withColumn("_batch", F.col(by).cast("int") if by else F.pmod(F.xxhash64(F.col(key)), F.lit(batches)).cast("int")), "batches")
    counts = {r._batch: r.n for r in dealt.groupBy("_batch").agg(F.count("*").alias("n")).collect()}
    out = []
    for number in sorted(counts):
        try:
            done = save(dealt.where(F.col("_batch") == number).drop("_batch"), number)
            out.append((number, counts[number], done.get("created", 0), done.get("matched", 0), "stored", None))
        except (PySparkException, Py4JError) as e:
            out.append((number, counts[number], 0, 0, "failed", next((x for x in str(e).splitlines() if x.strip()), type(e).__name__)[:200]))
    return spark.createDataFrame(out, "batch int, rows long, created long, matched long, status string, error string")


class Ledger:
    """What runs have done: (run, batch, path, phase) rows under a path, a folder for each run and batch.

    A batch is recorded after it is stored, in one write that replaces the batch's folder, so a batch that is repeated after a failure is recorded once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
        schema = "path string, phase string, run string, batch long"
        return self.spark.read.schema(schema).parquet(self.path) if there else self.spark.createDataFrame([], schema)

    def record(self, run: str, batch: int, paths: DataFrame, phase: str = "stored") -> None:
        paths.select("path", F.lit(phase).alias("phase")).write.mode("overwrite").parquet(f"{self.path}/run={run}/batch={batch}")

    def mark(self, run: str, phase: str) -> None:
        """Note that a run has failed or is completed; batch -1 holds the last such note."""
        self.record(run, -1, self.spark.createDataFrame([(None,)], "path string"), phase)

    def done(self, run: str) -> DataFrame:
        return self.rows().where((F.col("run") == run) & (F.col("phase") == "stored")).select("path").distinct()

    def state(self) -> DataFrame:
        """(run, files, batches, phase): what each run has stored, and failed, completed or running."""
        return self.rows().groupBy("run").agg(
            F.count_distinct(F.when(F.col("phase") == "stored", F.col("path"))).alias("files"), F.count_distinct(F.when(F.col("batch") >= 0, F.col("batch"))).alias("batches"),
            F.coalesce(F.max(F.when(F.col("batch") < 0, F.col("phase"))), F.lit("running")).alias("phase"))


def resumable(ledger: Ledger, run: str, parse: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame, int], object]) -> Callable[[DataFrame, int], None]:
    """A stream's batch function over scanned files (path, ...): files that the ledger has are skipped, the others are parsed, saved and then recorded.

    A run that is killed between saving and recording saves its batch again, so ``save`` has to replace by key, as a BucketStore does. A failure marks the run and goes on to the stream.
    """
    def step(batch: DataFrame, number: int) -> None:
        todo = cut(batch.join(ledger.done(run), "path", "left_anti"), "todo")
        if todo.isEmpty():
            return
        try:
            save(parse(todo), number)
            ledger.record(run, number, todo)
        except Exception:
            ledger.mark(run, "failed")
            raise

    return step
