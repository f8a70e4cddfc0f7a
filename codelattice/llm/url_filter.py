"""URL filters: dated block-list entries joined as of each capture's fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without user, port or trailing dots; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def domains_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more (a host of one label: itself)."""
    labels = F.split(host, r"\.")
    last = F.greatest(F.size(labels) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, domain, valid_from, valid_to) from dated entries (list, domain, action, at).

    ``action`` is ``add`` or ``remove``. An entry holds until the next of its list and domain;
    the interval is half open and ``valid_to`` is null while nothing ends it. Of entries at one
    time the removal wins. Adjacent intervals are merged. Entries with a null list, domain, action
    or time are left out, as are other actions.
    """
    w = Window.partitionBy("list", "domain").orderBy("at")
    dated = (
        entries.select("list", F.lower("domain").alias("domain"), "action", "at")
        .where("list is not null and domain is not null and at is not null and action in ('add', 'remove')")
        .groupBy("list", "domain", "at").agg(F.max("action").alias("action"))
        .withColumn("was", F.lag("action").over(w)).where("was is null or was <> action")
        .withColumn("valid_to", F.lead("at").over(w))
    )
    return dated.where("action = 'add'").select("list", "domain", F.col("at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Evaluate every capture against the entries that were active when it was fetched.

    A capture matches an entry of its host or of any parent domain. The as-of join runs once for
    each distinct (host, time), so a host with a third of all captures is joined once a time and
    its captures get the verdict in a join that Spark can split.

    Returns ``id_col``, ``url_col``, host, ``time_col``, blocked, lists (names, sorted and
    comma-joined), n_lists: one row per capture, repeated rows included. A capture without host or
    time matches nothing; null domains never match; an empty list blocks nothing.
    """
    rows = captures.select(F.col(id_col), F.col(url_col), host_of(F.col(url_col)).alias("host"), F.col(time_col))
    places = rows.where(F.col("host").isNotNull() & F.col(time_col).isNotNull()).select("host", F.col(time_col).alias("t")).distinct()
    spans = validity_intervals(entries)
    found = (
        places.select("host", "t", F.explode(domains_of(F.col("host"))).alias("domain"))
        .join(spans, "domain")
        .where((F.col("valid_from") <= F.col("t")) & (F.col("valid_to").isNull() | (F.col("t") < F.col("valid_to"))))
        .groupBy("host", "t").agg(F.array_sort(F.collect_set("list")).alias("names"))
        .withColumnRenamed("host", "found_host")
    )
    return rows.join(found, (F.col("host") == F.col("found_host")) & (F.col(time_col) == F.col("t")), "left").select(
        id_col, url_col, "host", time_col, F.col("names").isNotNull().alias("blocked"),
        F.coalesce(F.array_join("names", ","), F.lit("")).alias("lists"),
        F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_lists"),
    )
