"""The queries of this subpackage, each over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm.clustering import cluster_vectors
from codelattice.llm.decontamination import decontaminate
from codelattice.llm.divergence import divergence
from codelattice.llm.license_scan import scan_licenses
from codelattice.llm.line_dedup import dedup_lines
from codelattice.llm.mixing import mix_sources
from codelattice.llm.sharding import _A, _B, round_keys, shard_places
from codelattice.llm.simhash import near_duplicates
from codelattice.llm.sketches import fingerprint_documents
from codelattice.llm.suffix_dedup import remove_repeats
from codelattice.llm.token_counts import count_tokens
from codelattice.llm.toxicity import score_toxicity
from codelattice.llm.url_filter import filter_urls, host_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bx AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bx) WHERE len(w) >= n),
dx AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM di),
m AS (SELECT dx.doc_id, dx.i, dx.n, bx.item FROM dx JOIN bx ON dx.n = bx.n AND dx.g = bx.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages, fetched on day page_id mod 365 of 2024. The lists are dated by rule
    from the pages' own hosts, so that they grow with the input: see OP7_SQL."""
    pages = _table(spark, sf_dir, "pages").select(
        "page_id", "url", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(page_id % 365 as int))").alias("fetched_at"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    day = lambda n: f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast({n} as int))"
    entries = hosts.selectExpr("'hosts' as list", "host as domain", "'add' as action", f"{day('length(host) * 37 % 300')} as at").where("length(domain) % 3 = 0")
    entries = entries.union(hosts.selectExpr("'hosts'", "host", "'remove'", f"{day('length(host) * 37 % 300 + 45')}").where("length(host) % 3 = 0"))
    named = spark.createDataFrame(
        [("gambling", "casino-win.example.com", "add", 30), ("gambling", "casino-win.example.com", "remove", 200),
         ("gambling", "casino-win.example.com", "add", 300), ("gambling", "free-bets.example.com", "add", 100)],
        "list string, domain string, action string, day int",
    ).selectExpr("list", "domain", "action", f"{day('day')} as at")
    found = filter_urls(pages, entries.union(named))
    return found.select("page_id", "host", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), "blocked", "lists", "n_lists")


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', ''), '') AS host,
         TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 365 AS INTEGER)) AS t
  FROM pages),
h AS (SELECT DISTINCT host FROM p WHERE host IS NOT NULL AND length(host) % 3 = 0),
spans AS (
  SELECT 'hosts' AS list, host AS domain, TIMESTAMP '2024-01-01' + to_days(CAST(length(host) * 37 % 300 AS INTEGER)) AS a,
         TIMESTAMP '2024-01-01' + to_days(CAST(length(host) * 37 % 300 + 45 AS INTEGER)) AS b FROM h
  UNION ALL SELECT 'gambling', 'casino-win.example.com', TIMESTAMP '2024-01-01' + to_days(30), TIMESTAMP '2024-01-01' + to_days(200)
  UNION ALL SELECT 'gambling', 'casino-win.example.com', TIMESTAMP '2024-01-01' + to_days(300), NULL
  UNION ALL SELECT 'gambling', 'free-bets.example.com', TIMESTAMP '2024-01-01' + to_days(100), NULL),
m AS (
  SELECT DISTINCT p.host, p.t, s.list FROM (SELECT DISTINCT host, t FROM p WHERE host IS NOT NULL) p
  JOIN spans s ON (p.host = s.domain OR (ends_with(p.host, '.' || s.domain) AND contains(s.domain, '.')))
              AND s.a <= p.t AND (s.b IS NULL OR p.t < s.b)),
g AS (SELECT host, t, string_agg(list, ',' ORDER BY list) AS lists, count(*) AS n FROM m GROUP BY host, t)
SELECT p.page_id, p.host, strftime(p.t, '%Y-%m-%d') AS fetched_on, g.n IS NOT NULL AS blocked,
       coalesce(g.lists, '') AS lists, coalesce(g.n, 0) AS n_lists
FROM p LEFT JOIN g ON p.host = g.host AND p.t = g.t
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_removed_lines", F.length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("kept_md5"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


OP10_SQL = r"""
WITH s AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM s WHERE regexp_matches(line, '[^\s]')),
w AS (SELECT a.doc_id, a.pos AS a1, b.pos AS a2, c.pos AS a3, a.line || chr(10) || b.line || chr(10) || c.line AS win
      FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN l c ON a.doc_id = c.doc_id AND c.k = a.k + 2),
r AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, a1) AS place FROM w),
g AS (SELECT DISTINCT doc_id, unnest([a1, a2, a3]) AS pos FROM r WHERE place > 1),
k AS (SELECT s.doc_id, count(g.pos) AS gone, coalesce(string_agg(s.line, chr(10) ORDER BY s.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
      FROM s LEFT JOIN g ON s.doc_id = g.doc_id AND s.pos = g.pos GROUP BY s.doc_id)
SELECT d.doc_id, coalesce(k.gone, 0) AS n_removed_lines, length(k.kept) AS n_chars_kept, md5(k.kept) AS kept_md5
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n_lang FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.n_lang, coalesce(x.n, 0) AS n FROM g JOIN k ON g.lang = k.lang
      LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS (SELECT c.lang, c.source, c.term, c.n,
             1 + (1000000000 * (c.n + 5)::HUGEINT) // (sum(c.n) OVER (PARTITION BY c.lang, c.source) + 5 * v.v) AS p,
             1 + (1000000000 * (c.n_lang + 5)::HUGEINT) // (v.total_lang + 5 * v.v) AS q
      FROM c JOIN v ON c.lang = v.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM u) WHERE part = 'pair' OR rank <= 50
"""


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law is ``rows``: the permutation deals them out one by one."""
    places = shard_places(_table(spark, sf_dir, "documents"), 24)
    return places.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def _op12_sql(shards: int = 24, seed: int = 42) -> str:
    """Row numbers and the network's rounds as a recursive query; the CRC byte by byte."""
    keys = "[" + ", ".join(f"{k}::HUGEINT" for k in round_keys(seed)) + "]"
    whole = 1 << 64
    return f"""
WITH RECURSIVE crc(b, i, x) AS (
  SELECT b, 0, b::UBIGINT FROM range(256) t(b)
  UNION ALL SELECT b, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END FROM crc WHERE i < 8),
tab AS (SELECT list(x ORDER BY b) AS tab FROM crc WHERE i = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || chr(10) || (text IS NULL)::VARCHAR || coalesce(text, ''))) - 1 AS row_number FROM documents),
m AS (SELECT count(*) AS n, greatest(2, length(ltrim(bin(count(*) - 1), '0'))) AS bits FROM documents),
walk AS (
  SELECT row_number, n, bits // 2 AS lb, bits - bits // 2 AS rb, row_number::HUGEINT AS x, 0 AS r FROM d, m
  UNION ALL
  SELECT row_number, n, lb, rb,
         CASE WHEN r % 2 = 0 THEN (xor((x // (1::HUGEINT << rb))::UBIGINT, f >> (64 - lb))::HUGEINT << rb) + x % (1::HUGEINT << rb)
              ELSE x - x % (1::HUGEINT << rb) + xor((x % (1::HUGEINT << rb))::UBIGINT, f >> (64 - rb))::HUGEINT END, r + 1
  FROM (SELECT *, (xor(y, y >> 32)::HUGEINT * {_B} % {whole})::UBIGINT AS f
        FROM (SELECT *, (((CASE WHEN r % 2 = 0 THEN x % (1::HUGEINT << rb) ELSE x // (1::HUGEINT << rb) END) * {_A}::HUGEINT + {keys}[r % 8 + 1]) % {whole})::UBIGINT AS y FROM walk)
        WHERE r = 0 OR r % 8 > 0 OR x >= n)),
p AS (SELECT row_number, x AS place FROM walk WHERE r > 0 AND r % 8 = 0 AND x < n),
b AS (SELECT DISTINCT text, list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT) AS bytes FROM (SELECT text, hex(encode(text)) AS h FROM (SELECT DISTINCT text FROM d))),
k AS (SELECT text, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255)::BIGINT + 1])), 4294967295::UBIGINT) AS crc FROM b, tab)
SELECT d.doc_id, strlen(d.text) + 8 AS size, CAST(k.crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(p.place % {shards} AS INTEGER) AS shard,
       CAST(p.place // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, d.row_number
FROM d JOIN p ON d.row_number = p.row_number JOIN k ON d.text = k.text
"""


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_table(spark, sf_dir, "embeddings")).drop("n_distances")


def _op13_sql(k: int = 16, rounds: int = 3) -> str:
    """Every round against all centroids, component by component."""
    nearest = lambda c: f"SELECT vec_id, v, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT x.vec_id, x.v, c.j, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x, {c} c) GROUP BY vec_id, v"
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest(f'c{r}')})")
        steps.append(f"m{r} AS (SELECT j, i, CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT) AS y FROM (SELECT j, i, sum(y) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS y, unnest(range(64)) AS i FROM a{r}) GROUP BY j, i))")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT j, list(y ORDER BY i) AS v FROM m{r} GROUP BY j) m ON c.j = m.j)")
    return f"""
WITH x AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * e::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS j, v FROM x QUALIFY j < {k}),
{", ".join(steps)},
last AS MATERIALIZED ({nearest(f"c{rounds}")})
SELECT vec_id, CAST(l.j AS INTEGER) AS cluster, l.d AS distance, CAST(sum(l.d) OVER (PARTITION BY l.j) AS BIGINT) AS cluster_inertia, CAST(sum(l.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM last l JOIN c{rounds} c ON c.j = l.j
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_simhash": op3_simhash,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_mixing": op5_mixing,
    "op6_license_scan": op6_license_scan,
    "op7_url_filter": op7_url_filter,
    "op8_toxicity": op8_toxicity,
    "op9_fingerprints": op9_fingerprints,
    "op10_line_dedup": op10_line_dedup,
    "op11_divergence": op11_divergence,
    "op12_sharding": op12_sharding,
    "op13_clustering": op13_clustering,
}

ORACLES: dict[str, str] = {"op1_decontamination": OP1_SQL, "op7_url_filter": OP7_SQL, "op10_line_dedup": OP10_SQL, "op11_divergence": OP11_SQL, "op12_sharding": _op12_sql(), "op13_clustering": _op13_sql()}
