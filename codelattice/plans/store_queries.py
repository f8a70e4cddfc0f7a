"""Queries of stores: merges into buckets, batches of which one fails, a run that resumes by its ledger, and the stored text index."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelattice.operators.lineage import cut, new_folder
from codelattice.operators.text_index import TextIndex
from codelattice.plans.table_queries import query
from codelattice.sources import buckets

QUERIES, ORACLES = {}, {}  # these register with the table queries

_EDGE = "entity_id string, type string, created_at int, weight int, props map<string, string>"


def _parts(t, suffix=""):
    p = F.col("p_partkey")
    return t("part").select(F.concat(F.lit("e"), p.cast("string"), F.lit(suffix)).alias("entity_id"), F.col("p_brand").alias("type"), F.lit(1).alias("created_at"), F.col("p_size").cast("int").alias("weight"), F.create_map(F.lit("type"), "p_type").alias("props"), p)


@query("s21_bucket_merge", """SELECT 'e' || p_partkey AS entity_id, p_brand AS type, 1 AS created_at, CAST(p_size AS INTEGER) AS weight, p_type AS props_type, CASE WHEN p_partkey % 100 = 7 THEN p_name END AS props_name FROM part WHERE p_partkey % 100 <> 9
UNION ALL SELECT 'e' || p_partkey || 'new', p_brand, 2, 99, NULL, p_name FROM part WHERE p_partkey % 100 = 8""")
def _(t):
    """Edges whose merge matches some (type, time and weight stay, properties join), creates others, and a deletion."""
    every = _parts(t)
    spark = every.sparkSession
    store = buckets.BucketStore(spark, new_folder(spark, "edges"), _EDGE, buckets=32)
    buckets.merge_edges(store, every.drop("p_partkey"))
    changed = lambda r, suffix="": _parts(t, suffix).join(t("part").select("p_partkey", "p_name"), "p_partkey").where(F.col("p_partkey") % 100 == r).select(
        "entity_id", "type", F.lit(2).alias("created_at"), F.lit(99).alias("weight"), F.create_map(F.lit("name"), "p_name").alias("props"))
    buckets.merge_edges(store, changed(7).union(changed(8, "new")))
    store.delete(every.where("p_partkey % 100 = 9"))
    return store.read().select("entity_id", "type", "created_at", "weight", F.col("props")["type"].alias("props_type"), F.col("props")["name"].alias("props_name"))


@query("s25_batches", """SELECT CAST(p_partkey % 6 AS INTEGER) AS batch, count(*) AS n, CASE WHEN p_partkey % 6 = 3 THEN 0 ELSE count(*) FILTER (p_partkey % 4 <> 0) END AS created, CASE WHEN p_partkey % 6 = 3 THEN 0 ELSE count(*) FILTER (p_partkey % 4 = 0) END AS matched,
CASE WHEN p_partkey % 6 = 3 THEN 'failed' ELSE 'stored' END AS status FROM part GROUP BY p_partkey % 6""")
def _(t):
    """Six batches into a store that has every fourth row; one batch holds rows without a key and fails alone."""
    every = _parts(t)
    spark = every.sparkSession
    store = buckets.BucketStore(spark, new_folder(spark, "nodes"), _EDGE, buckets=16)
    store.merge(every.where("p_partkey % 4 = 0").drop("p_partkey"))
    keyed = every.withColumn("batch", (F.col("p_partkey") % 6).cast("int")).withColumn("entity_id", F.when((F.col("batch") != 3) | (F.col("p_partkey") % 2 == 0), F.col("entity_id")))
    told = buckets.store_batches(keyed.drop("p_partkey"), 6, lambda df, _: store.merge(df.drop("batch")), by="batch")
    return told.select("batch", F.col("rows").alias("n"), "created", "matched", "status")


@query("x5_ledger_resume", """SELECT 'one' AS run, (SELECT count(*) FROM part) AS files, 3 AS batches, 'completed' AS phase, (SELECT count(*) FROM part) AS stored, (SELECT count(*) FROM part WHERE p_partkey % 3 = 0) AS first_version""")
def _(t):
    """A run whose third batch fails after saving is taken up again: what the ledger has is skipped, the rest is stored once."""
    files = cut(t("part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_partkey") % 3).alias("part")), "files")
    spark = files.sparkSession
    store = buckets.BucketStore(spark, new_folder(spark, "parsed"), "entity_id string, version int", buckets=16)
    ledger = buckets.Ledger(spark, new_folder(spark, "ledger"))

    def saving(version: int, failing: int):
        def save(rows, number):
            store.merge(rows.withColumn("version", F.lit(version)), props=None)
            if number == failing:
                raise RuntimeError("lost after saving")

        return buckets.resumable(ledger, "one", lambda f: f.select(F.col("path").alias("entity_id")), save)

    parts = [files.where(F.col("part") == i) for i in range(3)]
    try:
        for number, rows in enumerate(parts):
            saving(1, 1)(rows, number)
    except RuntimeError:
        pass
    for number, rows in enumerate(parts):
        saving(2, -1)(rows, number)
    ledger.mark("one", "completed")
    stored = store.read().agg(F.count("*").alias("stored"), F.count_if(F.col("version") == 1).alias("first_version"))
    return ledger.state().join(F.broadcast(stored)).select("run", "files", "batches", "phase", "stored", "first_version")


@query("t15_stored_index", r"""WITH q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'))) AS term FROM benchmark WHERE item_id % 20 = 0),
d AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS w FROM documents), tf AS (SELECT doc_id, lang, len(w) AS length, unnest(w) AS term FROM d),
c AS (SELECT doc_id, lang, length, term, count(*) AS tf FROM tf WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY term), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
s AS (SELECT q.item_id, c.lang, c.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM q JOIN c ON q.term = c.term JOIN f ON f.term = c.term, n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, lang ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) SELECT item_id, lang AS scope, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def _(t):
    """The five best documents of each language for every twentieth benchmark item, from an index that was built with other texts and further documents, then updated."""
    docs = t("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("scope"), "text")
    spark = docs.sparkSession
    index = TextIndex(spark, new_folder(spark, "index"), "bigint", 16)
    other = F.when(F.col("id") % 10 == 3, F.concat(F.col("text"), F.lit(" the and zz"))).otherwise(F.col("text"))
    extra = docs.where("id % 10 = 4").select((-F.col("id") - 1).alias("id"), "scope", "text")
    index.update(docs.where("id % 10 <> 5").withColumn("text", other).union(extra))
    index.update(docs, extra)
    found = index.search(t("benchmark").where("item_id % 20 = 0"), 5, by_scope=True, question="item_id")
    return found.select("item_id", "scope", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")
