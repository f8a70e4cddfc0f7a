"""Features traced from their routes to data, cascades between entities, and feedback between versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.functions.ladders import size_class
from codelattice.operators.hops import of_type

#: The layers of a feature and the edge from the feature to each.
LAYERS = (("UI", "FEATURE_HAS_UI"), ("API", "FEATURE_HAS_API"), ("SERVICE", "FEATURE_HAS_SERVICE"), ("DATA", "FEATURE_HAS_DATA"))


def trace_features(routes: DataFrame, edges: DataFrame, steps: Sequence[Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """Features (feature, n_ui, n_api, n_service, n_data, complexity) and their edges (type, src, dst), from (feature, id) routes.

    Each step leads on by edges of its types: from routes to endpoints, to services, to data. A feature has each part once, however many ways lead to it; nothing is
    counted over a product of layers. Complexity goes by all routes, endpoints and services.
    """
    layer = routes.select("feature", "id").distinct()
    found = [layer]
    for types in steps:
        step = of_type(edges, *types).select(F.col("src").alias("id"), F.col("dst").alias("to")).distinct()
        layer = layer.join(step, "id").select("feature", F.col("to").alias("id")).distinct()
        found.append(layer)
    links = None
    for (_, kind), rows in zip(LAYERS, found, strict=True):
        part = rows.select(F.lit(kind).alias("type"), F.col("feature").alias("src"), F.col("id").alias("dst"))
        links = part if links is None else links.unionByName(part)
    n = lambda kind: F.count_if(F.col("type") == kind)
    features = links.groupBy(F.col("src").alias("feature")).agg(*(n(kind).alias(f"n_{name.lower()}") for name, kind in LAYERS))
    return features.withColumn("complexity", size_class(F.col("n_ui") + F.col("n_api") + F.col("n_service"))), links


def cascades(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(source, target, implication): references between entities (id, name, cascades) whose relation (type, src, dst, cascade) or source cascades."""
    a, b = entities.select(F.col("id").alias("src"), F.col("name").alias("source"), "cascades"), entities.select(F.col("id").alias("dst"), F.col("name").alias("target"))
    rows = of_type(relations, "REFERENCES", "HAS_FIELD").join(a, "src").join(b, "dst").where(F.col("cascade").isNotNull() | F.coalesce("cascades", F.lit(False)))
    text = F.concat(F.lit("Changes to "), "source", F.lit(" may cascade to "), "target")
    return rows.select("source", "target", text.alias("implication")).distinct()


def version_feedback(history: DataFrame, pairs: DataFrame) -> DataFrame:
    """(artifact, version1, version2, feedback): for each asked pair of versions what users said of the versions after the first up to the second, in order.

    ``history`` has artifact, version and feedback; only the pairs' artifacts are joined, and a version range holds few rows.
    """
    said = history.where("feedback is not null").select("artifact", "version", "feedback")
    rows = pairs.join(said, "artifact", "left").where("version is null or (version > version1 and version <= version2)")
    g = rows.groupBy("artifact", "version1", "version2").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("version").isNotNull(), F.struct("version", "feedback")))), lambda x: x["feedback"]).alias("feedback"))
    none = F.array().cast("array<string>")
    return pairs.join(g, ["artifact", "version1", "version2"], "left").select("artifact", "version1", "version2", F.coalesce("feedback", none).alias("feedback"))
