from pyspark.sql import functions as F

from codelattice.llm import url_filter

ENTRIES = [
    ("x", "bad.com", "add", "2024-01-10"), ("x", "bad.com", "remove", "2024-02-10"), ("x", "bad.com", "add", "2024-03-10"),
    ("y", "BAD.com", "add", "2024-01-01"), ("y", "bad.com", "add", "2024-01-05"), ("y", "sub.ok.org", "add", "2024-01-01"),
    ("y", "both.net", "add", "2024-01-01"), ("y", "both.net", "remove", "2024-01-01"), (None, "ok.org", "add", "2024-01-01"),
    ("z", None, "add", "2024-01-01"), ("z", "ok.org", "maybe", "2024-01-01"), ("z", "late.org", "remove", "2024-01-01"),
]
CAPTURES = [
    (1, "http://www.Bad.com:80/a", "2024-01-10"), (2, "https://bad.com/?q=http://ok.org", "2024-02-09"), (3, "http://bad.com", "2024-02-10"),
    (4, "http://u:p@a.sub.ok.org./", "2024-01-01"), (5, "http://ok.org/sub.ok.org", "2024-05-01"), (6, "http://notbad.com", "2024-05-01"),
    (7, None, "2024-05-01"), (8, "http://bad.com", None), (9, "bad.com/x", "2024-05-01"), (10, "http://both.net/", "2024-01-02"), (1, "http://www.Bad.com:80/a", "2024-01-10"),
    (11, "http://com/", "2024-05-01"), (12, "http://bad.com/", "2023-12-31"), (13, "http://late.org/", "2024-05-01"),
]


def test_url_filter(spark):
    entries = spark.createDataFrame(ENTRIES, "list string, domain string, action string, at string").withColumn("at", F.to_timestamp("at"))
    pages = spark.createDataFrame(CAPTURES, "page_id long, url string, fetched_at string").selectExpr("page_id", "url", "to_timestamp(fetched_at) as fetched_at", "'x' as lists", "1 as domain")
    rows = url_filter.filter_urls(pages, entries).collect()
    got = sorted((r.page_id, r.blocked, r["lists"], r.n_lists) for r in rows)
    want = {1: "x,y", 2: "x,y", 3: "y", 4: "y"}
    assert got == sorted((i, i in want, want.get(i, ""), len(want.get(i, "").split(",")) if i in want else 0) for i, _, _ in CAPTURES)
    assert url_filter.filter_urls(pages.limit(0), entries).count() == 0
    assert url_filter.filter_urls(pages, entries.limit(0)).where("blocked").count() == 0
