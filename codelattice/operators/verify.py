"""Claims scored by weighted evidence, and differences between versions of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The weight of each kind of evidence; other kinds weigh OTHER.
WEIGHTS = {
    "business_rule": 1.0, "code_reference": 1.0, "validation_constraint": 0.95, "guard_clause": 0.90, "call_graph": 0.9, "test_assertion": 0.85, "data_flow": 0.85, "dependency": 0.8,
    "architecture": 0.75, "test_coverage": 0.7, "metrics": 0.65, "documentation": 0.6, "pattern": 0.55, "similar_feature": 0.5,
}
OTHER = 0.5


def claim_scores(claims: DataFrame, evidence: DataFrame, weight: Column | None = None) -> DataFrame:
    """(claim_id, section, confidence, status, risk, needs_review) for every claim.

    Confidence is the weighted mean of the supporting evidence, less half of the contradicting
    share; no evidence or only contradicting evidence gives 0. One aggregation of the evidence,
    joined to the claims so that those without any stay.
    """
    table = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    w = weight if weight is not None else F.coalesce(F.try_element_at(table, F.col("evidence_type")), F.lit(OTHER))
    e = evidence.select("claim_id", "supports", F.when(F.col("supports"), F.col("confidence") * w).alias("cw"), F.when(F.col("supports"), w).alias("w"))
    s = e.groupBy("claim_id").agg(F.sum("cw").alias("cw"), F.sum("w").alias("w"), F.count_if("supports").alias("pro"), F.count_if(~F.col("supports")).alias("contra"))
    j = claims.join(s, "claim_id", "left")
    mean = F.coalesce(F.try_divide("cw", "w"), F.lit(0.0))
    confidence = F.coalesce(mean * (1 - 0.5 * F.try_divide(F.col("contra").cast("double"), (F.col("pro") + F.col("contra")).cast("double"))), F.lit(0.0))
    # Rounded, so that the order in which evidence is summed never moves a claim across a threshold.
    j = j.withColumn("confidence", F.round(confidence, 9))
    only_contra = (F.col("contra") > 0) & (F.col("pro") == 0)
    none, c = F.col("pro").isNull(), F.col("confidence")
    status = F.when(only_contra, "contradicted").when(~none & (c >= 0.7), "verified").when(~none & (c >= 0.4), "partially_verified").otherwise("unverified")
    risk = F.when(only_contra, "critical").when(none, "high").when(c >= 0.7, "none").when(c >= 0.4, "low").when(c >= 0.2, "medium").otherwise("high")
    review = ~none & ~F.coalesce(only_contra, F.lit(False)) & (c < 0.4)
    return j.select("claim_id", "section", "confidence", status.alias("status"), risk.alias("risk"), review.alias("needs_review"))


def section_stats(scored: DataFrame, *keys: str) -> DataFrame:
    """Per section: claims by status, mean confidence, and the section's own status and risk."""
    g = scored.groupBy(*(keys or ("section",))).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "verified").alias("verified"),
        F.count_if(F.col("status").isin("unverified", "partially_verified")).alias("unverified"),
        F.count_if(F.col("status") == "contradicted").alias("contradicted"), F.count_if("needs_review").alias("needs_review"), F.avg("confidence").alias("confidence"))
    status = F.when(F.col("contradicted") > 0, "contradicted").when(F.col("verified") == F.col("total"), "verified").when(F.col("verified") > 0, "partially_verified").otherwise("unverified")
    risk = (
        F.when(F.col("contradicted") > 0, "critical").when(F.col("verified") == F.col("total"), "none")
        .when(F.col("verified") > 0, F.when(F.col("confidence") >= 0.6, "low").otherwise("medium")).otherwise("high")
    )
    return g.withColumn("status", status).withColumn("risk", risk)


def bundle_metrics(sections: DataFrame, *keys: str) -> DataFrame:
    """Per document: sums over sections, the mean of their means, and whether it is approved."""
    agg = [
        F.sum("total").alias("total"), F.sum("verified").alias("verified"), F.sum("needs_review").alias("needs_review"), F.sum("contradicted").alias("contradicted"),
        F.avg("confidence").alias("confidence"), F.bool_and(F.col("status") == "verified").alias("all_verified"),
    ]
    g = sections.groupBy(*keys).agg(*agg) if keys else sections.agg(*agg)
    c = F.col("confidence")
    status = F.when(F.col("contradicted") > 0, "contradicted").when(F.col("all_verified") | (c >= 0.6), "verified").when(c >= 0.4, "partially_verified").otherwise("unverified")
    risk = F.when(F.col("contradicted") > 0, "critical").when(F.col("all_verified"), "none").when(c >= 0.4, "low").when(c < 0.3, "high").otherwise("medium")
    return g.withColumn("status", status).withColumn("risk", risk).withColumn("approved", (F.col("contradicted") == 0) & (F.col("all_verified") | (c >= 0.4))).drop("all_verified")


def version_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change, before, after): added, removed and modified keys; unchanged ones are left out."""
    a, b = old.select(key, F.col(value).alias("before"), F.lit(True).alias("_a")), new.select(key, F.col(value).alias("after"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "modified")
    return a.join(b, key, "full").select(key, change.alias("change"), "before", "after").where("change is not null")
