"""Gates: compare an external score with the evidence of the argument graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.graph import structural_score

GATE_A, GATE_B = 0.06, 0.02  # fixed values: tolerance = a * ln(nodes + 1) + b, within 0.05..0.30


def _clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def gate(metrics: DataFrame, score: str, max_score: str, a: float = GATE_A, b: float = GATE_B,
         weights: dict | None = None) -> DataFrame:
    """Adds structural, evidence_score, tolerance, gap, verdict, reason and
    recommended_score to a row of graph_metrics (with depth and quality) that
    carries an external score."""
    s, m = F.col(score), F.col(max_score)
    external = F.when(m > 0, s / m).otherwise(0.0)
    nothing = (F.col("node_count") == 0) | ((F.col("evidence_count") == 0) & (F.col("claim_count") == 0))
    bare = (F.col("evidence_count") == 0) & (external > 0.3)
    d = metrics.withColumn("structural", structural_score(weights))
    d = d.withColumn("evidence_score", F.when(
        F.col("quality").isNull(), F.col("structural")).otherwise(0.5 * F.col("structural") + 0.5 * F.col("quality")))
    d = d.withColumn("tolerance", _clip(a * F.log(F.col("node_count") + 1.0) + b, 0.05, 0.30) * F.coalesce(
        _clip(F.col("quality") / 0.5, 0.5, 1.0), F.lit(1.0)))
    d = d.withColumn("gap", F.abs(external - F.col("evidence_score")))
    verdict = (
        F.when(nothing | bare, "REJECTED").when(F.col("gap") <= F.col("tolerance"), "CONFIRMED").otherwise("FLAGGED"))
    reason = (
        F.when(nothing, "no argument nodes").when(bare, "claims without evidence")
        .when(F.col("gap") <= F.col("tolerance"), "evidence supports the score").otherwise("gap exceeds tolerance"))
    return d.withColumn("verdict", verdict).withColumn("reason", reason).withColumn(
        "recommended_score", F.when(F.col("verdict") == "FLAGGED", F.col("evidence_score") * m))


def gate_topology(scored: DataFrame, external: str) -> DataFrame:
    """Gate over graph.topology_score; the external score is already 0..1."""
    t = F.col("topology_score")
    d = scored.withColumn("gap", F.abs(F.col(external) - t)).withColumn("tolerance", 0.39 * (1.0 - t) + 0.05)
    return d.withColumn("verdict", F.when(
        (F.col("evidence_count") == 0) & (F.col("claim_count") == 0), "REJECTED")
        .when(F.col("gap") <= F.col("tolerance"), "CONFIRMED").otherwise("FLAGGED"))


def detect_scale(scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Scale (100, 10, 5 or 1) by the largest score of a group, and the scaled mean."""
    top = F.max(score)
    scale = F.when(top > 10, 100.0).when(top > 5, 10.0).when(top > 1, 5.0).otherwise(1.0)
    return scores.groupBy(*keys).agg(
        F.avg(score).alias("mean_score"), scale.alias("scale"), (F.avg(score) / scale).alias("normalized"))
