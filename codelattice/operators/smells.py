"""Metric thresholds, hotspots, code smells, dead code and the debt they add up to."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions.ladders import severity
from codelattice.operators.traversal import strong_components

# Fixed values: (smell, metric, threshold, severity multipliers, category) of methods, classes and files.
METHOD_SMELLS = (
    ("long_method", "loc", 50, (1.5, 2.0, 3.0), "size"), ("too_many_parameters", "param_count", 5, (1.2, 1.5, 2.0), "size"), ("deep_nesting", "nesting", 4, (1.25, 1.5, 2.0), "complexity"),
    ("high_cyclomatic_complexity", "complexity", 15, (1.5, 2.0, 3.0), "complexity"), ("high_cognitive_complexity", "cognitive", 20, (1.5, 2.0, 3.0), "complexity"),
)
CLASS_SMELLS = (("large_class", "loc", 500, (1.5, 2.0, 3.0), "size"), ("too_many_methods", "method_count", 20, (1.5, 2.0, 2.5), "size"))
FILE_SMELLS = (("excessive_imports", "import_count", 20, (1.5, 2.0, 3.0), "coupling"),)
# Minutes of debt by severity, and names that are entry points.
DEBT_MINUTES = {"low": 15, "medium": 30, "high": 60, "critical": 120}
ENTRY_NAMES = r"(?i)^main$|^index$|controller$|handler$|endpoint$|^app$|^server$|^bootstrap$"
LIMITS = {"complexity": 15, "cognitive": 20, "nesting": 4, "loc": 50, "class_loc": 500, "param_count": 5}


def violations(kind: Column, limits: Mapping[str, float] = LIMITS) -> Column:
    """The metrics over their limit, in order; a class has a limit of its own for lines. Limits that are not given keep their default."""
    limits = {**LIMITS, **limits}
    loc_limit = F.when(kind.isin("Class", "JavaClass"), limits["class_loc"]).otherwise(limits["loc"])
    return F.array_compact(F.array(
        *(F.when(F.col(m) > limits[m], F.lit(m)) for m in ("complexity", "cognitive", "nesting")),
        F.when(F.col("loc") > loc_limit, F.lit("loc")), F.when(F.col("param_count") > limits["param_count"], F.lit("param_count"))))


def hotspots(nodes: DataFrame, n: int = 10, limits: Mapping[str, float] = LIMITS) -> DataFrame:
    """The ``n`` worst nodes over a limit, by cognitive and then cyclomatic complexity."""
    over = nodes.withColumn("violations", violations(F.col("kind"), limits)).where("size(violations) > 0")
    return over.orderBy(F.col("cognitive").desc_nulls_last(), F.col("complexity").desc_nulls_last(), "id").limit(n)


def god_class(methods: Column, loc: Column, avg_complexity: Column, strict: bool = False) -> Column:
    """Two readings: the smell's (strict) asks for more than the metric's."""
    if strict:
        return (methods > 30) | ((methods > 15) & (avg_complexity > 10)) | ((loc > 1000) & (methods > 20))
    return (methods > 20) | (loc > 500) | ((methods > 10) & (avg_complexity > 10))


def data_class(methods: Column, accessors: Column) -> Column:
    return (methods > 5) & (F.try_divide(accessors.cast("double"), methods.cast("double")) > 0.8)


def _rule(smell: str, metric: str, threshold: float, multipliers: tuple, category: str) -> Column:
    value = F.col(metric).cast("double")
    return F.when(value > threshold, F.struct(
        F.lit(smell).alias("smell"), F.lit(category).alias("category"), severity(value, F.lit(float(threshold)), multipliers).alias("severity"),
        value.alias("metric"), F.lit(float(threshold)).alias("threshold")))


def smells(nodes: DataFrame, rules: tuple = METHOD_SMELLS, extra: tuple[Column, ...] = ()) -> DataFrame:
    """One row for each smell of each node: all rules in one pass over the nodes."""
    found = F.array_compact(F.array(*(_rule(*r) for r in rules), *extra))
    return nodes.select("id", F.explode(found).alias("s")).select("id", "s.*")


def class_smells(classes: DataFrame) -> DataFrame:
    """Size smells, god classes and data classes, from loc, method_count, avg_complexity and accessor_count."""
    m = F.col("method_count").cast("double")
    one = lambda when, smell, level, metric, at: F.when(when, F.struct(
        F.lit(smell).alias("smell"), F.lit("design").alias("category"), F.lit(level).alias("severity"), metric.alias("metric"), F.lit(at).alias("threshold")))
    god = one(god_class(F.col("method_count"), F.col("loc"), F.col("avg_complexity"), strict=True), "god_class", "critical", m, 30.0)
    data = one(data_class(F.col("method_count"), F.col("accessor_count")), "data_class", "low", m, 5.0)
    return smells(classes, CLASS_SMELLS, (god, data))


def smell_rollup(found: DataFrame) -> DataFrame:
    """Counts by severity with the debt in minutes and in hours, rounded to one decimal."""
    minutes = F.element_at(F.create_map(*(F.lit(x) for kv in DEBT_MINUTES.items() for x in kv)), F.col("severity"))
    return found.groupBy("severity").agg(F.count("*").alias("n"), F.sum(minutes).alias("minutes")).withColumn(
        "hours", F.round(F.col("minutes") / 60.0, 1))


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Exported nodes that no call, import or inheritance points to and whose name is no entry point's."""
    used = edges.where(F.col("type").isin("CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "USES")).select(F.col("dst").alias("_used"))
    return nodes.where("is_exported").where(~F.col("name").rlike(ENTRY_NAMES)).join(used, F.col("id") == F.col("_used"), "left_anti")


def import_cycles(edges: DataFrame) -> DataFrame:
    """(component, members, severity) of circular imports and dependencies between files: over three
    members is critical, else high."""
    found = strong_components(edges.where(F.col("type").isin("IMPORTS", "DEPENDS_ON")))
    return found.groupBy("component").agg(F.array_sort(F.collect_set("id")).alias("members")).withColumn(
        "severity", F.when(F.size("members") > 3, "critical").otherwise("high"))
