"""Summaries: counts, coverage, readiness and features, each over one pass of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions.ids import base_path
from codelattice.functions.ladders import feature_category, feature_name, grade, size_class


def share_of_total(df: DataFrame, key: str, value: str, decimals: int = 1) -> DataFrame:
    """(key, n, total, percent) with each group's share of the whole."""
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    whole = g.agg(F.sum("total").alias("_all"))
    return g.join(F.broadcast(whole)).select(key, "n", "total", F.round(F.try_divide(100.0 * F.col("total"), F.col("_all")), decimals).alias("percent"))


def ratio(condition: Column, empty: float) -> Column:
    """The share of rows with the condition; ``empty`` without rows."""
    return F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), F.lit(empty))


def metric_summary(nodes: DataFrame, *keys: str) -> DataFrame:
    """Lines, and mean and largest complexity; nodes without a figure count as 0 in the mean."""
    c = F.coalesce("complexity", F.lit(0))
    agg = [F.sum(F.coalesce("loc", F.lit(0))).alias("loc"), F.try_divide(F.sum(c).cast("double"), F.count("*")).alias("avg_complexity"), F.max("complexity").alias("max_complexity"), F.max("nesting").alias("max_nesting")]
    return nodes.groupBy(*keys).agg(*agg)


def testing_score(coverage: Column, critical: Column, unit: Column, integration: Column, e2e: Column) -> Column:
    """struct(score, grade): coverage in percent less 2 for each untested critical function (20 at
    most) plus 4, 3 and 3 for the kinds of tests there are."""
    percent = F.round(coverage * 100)
    base = F.greatest(F.lit(0.0), percent - F.least(critical * 2, F.lit(20)))
    bonus = F.when(unit, 4).otherwise(0) + F.when(integration, 3).otherwise(0) + F.when(e2e, 3).otherwise(0)
    score = F.least(F.lit(100.0), base + bonus)
    return F.struct(score.alias("score"), grade(score).alias("grade"))


def documentation_score(public: Column, overall: Column, undocumented: Column) -> Column:
    """struct(score, grade): 0.6 of the public and 0.4 of the whole coverage in percent, less 0.5 for
    each undocumented public entity (15 at most)."""
    score = F.greatest(F.lit(0.0), F.round(F.round(public * 100) * 0.6 + F.round(overall * 100) * 0.4) - F.least(undocumented * 0.5, F.lit(15.0)))
    return F.struct(score.alias("score"), grade(score).alias("grade"))


def readiness(testing: Column, documentation: Column) -> Column:
    """struct(score, grade, ready): the mean of both; ready from 75."""
    score = F.round((testing + documentation) / 2)
    return F.struct(score.alias("score"), grade(score).alias("grade"), (score >= 75).alias("ready"))


# Recommendations with their priority.
RECOMMENDATIONS = (("add tests for critical functions", "critical"), ("raise test coverage", "high"), ("document public entities", "medium"), ("improve documentation quality", "low"))
PRIORITY = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def by_priority(df: DataFrame, column: str = "priority") -> DataFrame:
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), F.col(column))
    return df.orderBy(rank, "recommendation")


def recommendations(spark, scores: dict[str, float]) -> DataFrame:
    """What to do first, from untested_critical, coverage, public_docs and doc_quality."""
    when = (scores["untested_critical"] > 0, scores["coverage"] < 0.5, scores["public_docs"] < 0.8, scores["doc_quality"] < 0.6)
    rows = [r for r, hit in zip(RECOMMENDATIONS, when, strict=True) if hit]
    return by_priority(spark.createDataFrame(rows, "recommendation string, priority string"))


def discover_features(routes: DataFrame, apis: DataFrame | None = None) -> DataFrame:
    """Features from routes (route, component): routes with one base path are a feature, with its
    name, category, size and API calls (route, api), if given."""
    r = routes.withColumn("base", base_path(F.col("route")))
    g = r.groupBy("base").agg(F.count("*").alias("n_routes"), F.min("component").alias("component"), F.array_sort(F.collect_set("route")).alias("routes"))
    if apis is not None:
        called = apis.withColumn("base", base_path(F.col("route"))).groupBy("base").agg(F.array_sort(F.collect_set("api")).alias("apis"))
        g = g.join(called, "base", "left")
    n_apis = F.coalesce(F.size("apis"), F.lit(0)) if apis is not None else F.lit(0)
    named = feature_name(F.col("base"), F.col("component"))
    return g.select("base", named["name"].alias("name"), named["confidence"].alias("confidence"), feature_category(F.col("base")).alias("category"),
                    size_class(F.col("n_routes") + n_apis).alias("complexity"), "n_routes", "routes", *(["apis"] if apis is not None else []))


def feature_stats(features: DataFrame) -> DataFrame:
    """Features by category, with the number of each complexity."""
    return features.groupBy("category").agg(F.count("*").alias("n"), *(F.count_if(F.col("complexity") == c).alias(c) for c in ("simple", "moderate", "complex")))


# Endings of screen names that do not belong to the feature, and names that are technical.
SCREEN_ENDINGS = ("Entry", "Results", "Result", "Detail", "Details", "List", "Search", "Edit", "Create", "Update", "View", "Add", "Delete", "Confirm", "Confirmation", "Summary", "Form", "Page", "Screen",
                  "Popup", "Dialog", "Wizard", "History", "Report", "Lookup", "Select")
TECHNICAL = r"(?i)^(index|error|login|logout|header|footer|menu|layout|common|template|include|main|home|test)"


def screen_prefix(name: Column) -> Column:
    return F.regexp_replace(name, "(" + "|".join(SCREEN_ENDINGS) + ")$", "")


def screen_groups(screens: DataFrame, name: str = "name") -> DataFrame:
    """Screens by the name that is left without its ending; technical names are left out."""
    return screens.where(~F.col(name).rlike(TECHNICAL)).withColumn("prefix", screen_prefix(F.col(name))).where("length(prefix) >= 3").groupBy("prefix").agg(
        F.count("*").alias("n_screens"), F.array_sort(F.collect_set(name)).alias("screens"))


def architecture(stereotypes: DataFrame, modules: int) -> Column:
    """From counts by stereotype: which patterns a code base shows, with their confidence."""
    has = lambda s: F.max(F.when(F.col("stereotype") == s, F.col("n")).otherwise(0)) > 0
    one = lambda cond, name, c: F.when(cond, F.struct(F.lit(name).alias("pattern"), F.lit(c).alias("confidence")))
    return F.array_compact(F.array(
        one(has("Controller") & has("Service") & has("Repository"), "Layered", 0.85), one(has("Controller") & has("Entity"), "MVC", 0.75), one(F.lit(modules > 1), "Modular", 0.70)))


def export(documents: DataFrame, children: DataFrame, fmt: str = "md") -> DataFrame:
    """(id, body): each document (id, title) with its children (id, position, text) in order, as Markdown, HTML or JSON."""
    if fmt not in ("md", "html", "json"):
        raise ValueError(f"no such format: {fmt}")
    listed = children.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]).alias("texts"))
    rows = documents.join(listed, "id", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = {
        "md": F.concat(F.lit("# "), "title", F.lit("\n"), F.array_join(F.transform("texts", lambda x: F.concat(F.lit("- "), x)), "\n")),
        "html": F.concat(F.lit("<h1>"), safe(F.col("title")), F.lit("</h1>\n<ul>"), F.array_join(F.transform("texts", lambda x: F.concat(F.lit("<li>"), safe(x), F.lit("</li>"))), ""), F.lit("</ul>")),
        "json": F.to_json(F.struct("title", F.col("texts").alias("children"))),
    }[fmt]
    return rows.select("id", body.alias("body"))


def overview(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """(block, item, value): an overview of a repository in eleven blocks: summary, kinds, modules, hotspots, complexity (the mean of the hotspots only), documentation, entry points,
    relations, most called, data and dead code. The lists of hotspots and most called parts end after ``top`` rows, ties by id."""
    method = F.col("kind") == "JavaMethod"
    row = lambda block, item, value: F.struct(F.lit(block).alias("block"), F.lit(item).alias("item"), value.cast("double").alias("value"))
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    scalars = nodes.agg(
        n("File").alias("files"), n("JavaMethod").alias("functions"), n("JavaClass", "SpringController", "SpringService", "Entity").alias("classes"), F.coalesce(F.sum("size"), F.lit(0)).alias("loc"),
        F.round(F.avg(F.when(method, F.coalesce("documented", F.lit(False)).cast("double"))), 6).alias("documented"), n("SQLTable").alias("tables"),
    )
    single = scalars.select(F.inline(F.array(*(row("summary", c, F.col(c)) for c in ("files", "functions", "classes", "loc")), row("documentation", "share", F.col("documented")), row("data", "tables", F.col("tables")))))
    counted = lambda df, block, item: df.groupBy(F.col(item).alias("item")).agg(F.count("*").cast("double").alias("value")).select(F.lit(block).alias("block"), "item", "value")
    hot = nodes.where(method & F.col("size").isNotNull()).orderBy(F.desc("size"), "id").limit(top).select(F.lit("hotspots").alias("block"), F.col("id").alias("item"), F.col("size").cast("double").alias("value"))
    mean = hot.agg(F.round(F.avg("value"), 6).alias("value")).select(F.lit("complexity").alias("block"), F.lit("mean of hotspots").alias("item"), "value")
    called = edges.where("type = 'CALLS'").groupBy("dst").agg(F.count("*").alias("c"))
    most = called.orderBy(F.desc("c"), "dst").limit(top).select(F.lit("most called").alias("block"), F.col("dst").alias("item"), F.col("c").cast("double").alias("value"))
    dead = nodes.where(method).join(called, F.col("id") == F.col("dst"), "left_anti").agg(F.count("*").cast("double").alias("value")).select(F.lit("dead code").alias("block"), F.lit("uncalled").alias("item"), "value")
    out = single
    for part in (counted(nodes, "kinds", "kind"), counted(nodes.where(method & F.col("file").isNotNull()), "modules", "file"), counted(nodes.where("kind = 'SpringController'"), "entry points", "kind"), counted(edges, "relations", "type"), hot, mean, most, dead):
        out = out.unionByName(part)
    return out
