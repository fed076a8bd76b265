"""Sinks: history, result and CSV exports, triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.operators.triples import ntriples


def _one(c: str):
    return F.format_string("%.1f", F.col(c).cast("double"))


def append_history(records: DataFrame, folder: str) -> None:
    records.write.mode("append").json(folder)


def document_csv(records: DataFrame) -> DataFrame:
    """Ten text columns per record; numbers with one decimal."""
    return records.select(
        F.col("document_title").alias("Document"), F.col("doc_type").alias("Type"), F.col("framework_name").alias("Framework"),
        _one("overall_score").alias("Score"), _one("max_possible").alias("Max"), _one("percentage").alias("Percentage"),
        F.when(F.col("passed").isNull(), "N/A").when(F.col("passed"), "PASS").otherwise("FAIL").alias("Passed"),
        F.col("agent_count").cast("string").alias("Agents"), F.col("debate_rounds").cast("string").alias("Rounds"), F.col("evaluated_at").cast("string").alias("Date"))


def criteria_csv(records: DataFrame) -> DataFrame:
    c = records.select("document_title", F.explode("criterion_scores").alias("c")).select("document_title", "c.*")
    return c.select(F.col("document_title").alias("Document"), F.col("criterion_title").alias("Criterion"), _one("consensus_score").alias("Score"),
                    _one("max_score").alias("Max"), _one("percentage").alias("Percentage"))


def write_csv(table: DataFrame, folder: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(folder)


def write_results(scored: DataFrame, metrics: DataFrame, folder: str) -> None:
    """Scores, metrics and a small markdown table of the metrics, as folders."""
    scored.write.mode("overwrite").json(f"{folder}/scores")
    metrics.write.mode("overwrite").json(f"{folder}/metrics")
    line = F.format_string("| %d | %.3f | %.3f | %.2f | %.2f |", "samples", "pearson_r", "qwk", "mae", "rmse")
    head = F.lit("| Samples | Pearson r | QWK | MAE | RMSE |\n| --- | --- | --- | --- | --- |\n")
    metrics.select(F.concat(head, line).alias("value")).write.mode("overwrite").text(f"{folder}/summary")


def write_ntriples(triples: DataFrame, folder: str) -> None:
    ntriples(triples).write.mode("overwrite").text(folder)
