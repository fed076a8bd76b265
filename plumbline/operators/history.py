"""Evaluation history: records(id, framework_name, document_title, doc_type,
document_type, percentage, passed, evaluated_at, criterion_scores[], weaknesses[])."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.ranking import counts_below, global_row_number, values_at_ranks


def build_records(sessions: DataFrame, overall: DataFrame, moderated: DataFrame, criteria: DataFrame) -> DataFrame:
    """History rows: criterion records (unknown criterion: title = id, max 10) and
    weaknesses, the criteria under 50 % as "title (NN%)"."""
    top = F.coalesce("max_score", F.lit(10.0))
    d = moderated.join(criteria.select("criterion_id", "title", "max_score"), "criterion_id", "left")
    rec = F.struct(
        "criterion_id", F.coalesce("title", "criterion_id").alias("criterion_title"), "consensus_score", top.alias("max_score"),
        F.when(top > 0, F.col("consensus_score") / F.nullif(top, F.lit(0.0)) * 100.0).otherwise(0.0).alias("percentage"))
    per = d.groupBy("session_id").agg(F.array_sort(F.collect_list(rec)).alias("criterion_scores"))
    weak = F.transform(
        F.filter("criterion_scores", lambda c: c["percentage"] < 50.0),
        lambda c: F.concat(c["criterion_title"], F.lit(" ("), F.round(c["percentage"]).cast("int").cast("string"), F.lit("%)")))
    return sessions.join(overall, "session_id").join(per, "session_id", "left").withColumn("weaknesses", weak)


def _sd(c, n) -> Column:
    return F.when(n > 1, F.stddev_samp(c)).otherwise(0.0)


def batch_summary(records: DataFrame) -> DataFrame:
    n = F.count("*")
    return records.agg(
        n.alias("total_documents"), F.avg("percentage").alias("mean_score"), _sd("percentage", n).alias("std_dev"),
        F.min("percentage").alias("min_score"), F.max("percentage").alias("max_score"),
        F.count_if(F.coalesce("passed", F.lit(False))).alias("pass_count"), F.count_if(~F.coalesce("passed", F.lit(True))).alias("fail_count"),
        (F.count_if(F.coalesce("passed", F.lit(False))) / n * 100.0).alias("pass_rate"))


def median(records: DataFrame, value: str = "percentage") -> DataFrame:
    """median_score: the middle value, or the mean of the two middle ones; null without rows."""
    middle = [v for _, v in values_at_ranks(records, value, lambda n: [(n - 1) // 2, n // 2])]
    return records.sparkSession.createDataFrame([(sum(middle) / len(middle) if middle else None,)], "median_score double")


def nearest_rank_percentiles(records: DataFrame, points=(25, 50, 75), value: str = "percentage") -> DataFrame:
    """sorted[round(p/100 * (n-1))] for each p, halves up, without interpolation or a full sort."""
    rank = lambda p, n: math.floor(p / 100.0 * (n - 1) + 0.5)
    rows = records.where(F.col(value).isNotNull()).count()
    found = dict(values_at_ranks(records, value, lambda n: [rank(p, n) for p in points]))
    return records.sparkSession.createDataFrame([(p, found[rank(p, rows)]) for p in points if rows], "p long, value double")


def criterion_averages(records: DataFrame) -> DataFrame:
    """Mean, deviation, weakest and strongest document per criterion title; ties
    go to the smaller title of the document."""
    c = records.select("document_title", F.explode("criterion_scores").alias("c")).select("document_title", "c.criterion_title", "c.percentage")
    n = F.count("*")
    return c.groupBy("criterion_title").agg(
        F.avg("percentage").alias("mean_percentage"), _sd("percentage", n).alias("std_dev"),
        F.min(F.struct("percentage", "document_title"))["document_title"].alias("weakest_doc"),
        F.min(F.struct((-F.col("percentage")).alias("k"), "document_title"))["document_title"].alias("strongest_doc"))


def score_histogram(records: DataFrame) -> DataFrame:
    """Ten buckets of ten points, the last closed at 100; empty ones kept."""
    p = F.col("percentage")
    found = records.where((p >= 0) & (p <= 100)).groupBy(F.least(F.floor(p / 10), F.lit(9)).alias("bucket")).agg(F.count("*").alias("n"))
    dim = records.sparkSession.range(10).withColumnRenamed("id", "bucket")
    return dim.join(found, "bucket", "left").fillna(0, subset=["n"])


def compare_to_history(current: DataFrame, history: DataFrame) -> DataFrame:
    """Each current record against the history of its framework: count, mean,
    deviation and the truncated percentage of history strictly below it. A record
    of a framework without history keeps its row: compared with 0, the rest null.

    Both sides enter one cumulative count per framework (history counts, current
    rows are looked up), so no record meets every other."""
    both = history.select("framework_name", "percentage", F.lit(1).alias("h")).unionByName(
        current.select("framework_name", "percentage", F.lit(0).alias("h")).distinct())
    below = counts_below(both, ["framework_name"], "percentage", "h").drop("h")
    n = F.count("*")
    stats = history.groupBy("framework_name").agg(
        n.alias("total_compared"), F.avg("percentage").alias("historical_mean"), _sd("percentage", n).alias("historical_std_dev"))
    return current.select("id", "framework_name", "percentage").join(stats, "framework_name", "left").join(below, ["framework_name", "percentage"], "left").select(
        "id", "framework_name", "percentage", F.coalesce("total_compared", F.lit(0)).alias("total_compared"), "historical_mean", "historical_std_dev",
        F.floor(F.col("below") / F.col("total_compared") * 100.0).alias("percentile"))


def criterion_comparison(current: DataFrame, history: DataFrame) -> DataFrame:
    flat = lambda df, *k: df.select(*k, "framework_name", F.explode("criterion_scores").alias("c")).select(*k, "framework_name", "c.criterion_title", "c.percentage")
    h = flat(history).groupBy("framework_name", "criterion_title").agg(F.avg("percentage").alias("historical_mean"))
    return flat(current, "id").join(h, ["framework_name", "criterion_title"]).withColumn("delta", F.col("percentage") - F.col("historical_mean"))


def cross_summary(records: DataFrame) -> DataFrame:
    n = F.count("*")
    return records.agg(
        n.alias("evaluations"), F.avg("percentage").alias("mean_score"), _sd("percentage", n).alias("std_dev"),
        F.min("percentage").alias("min_score"), F.max("percentage").alias("max_score"))


def score_timeline(records: DataFrame, total: str | None = None) -> DataFrame:
    cols = records.select("evaluated_at", "id", "document_title", "percentage")
    return global_row_number(cols, ["evaluated_at", "id"], "row_no", total)


def trend(records: DataFrame, step: float = 3.0) -> DataFrame:
    """Mean of the later half minus the earlier half in time order."""
    half = F.floor(F.col("n") / 2)
    d = score_timeline(records, "n").agg(
        F.max("n").alias("n"), (F.avg(F.when(F.col("row_no") > half, F.col("percentage"))) - F.avg(
            F.when(F.col("row_no") <= half, F.col("percentage")))).alias("delta"))
    return d.select("n", "delta", F.when(F.col("n") < 4, "insufficient_data").when(F.col("delta") > step, "improving").when(
        F.col("delta") < -step, "declining").otherwise("stable").alias("trend"))


def weakest_criteria(records: DataFrame, top: int = 3) -> DataFrame:
    return records.select(F.explode("criterion_scores").alias("c")).groupBy(F.col("c.criterion_title").alias("criterion_title")).agg(
        F.avg("c.percentage").alias("mean_percentage")).orderBy("mean_percentage", "criterion_title").limit(top)


def common_weaknesses(records: DataFrame, top: int = 5) -> DataFrame:
    return records.select(F.explode("weaknesses").alias("weakness")).groupBy("weakness").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "weakness").limit(top)


def by_document_type(records: DataFrame) -> DataFrame:
    kind = F.coalesce(F.nullif(F.col("document_type"), F.lit("")), F.nullif(F.col("doc_type"), F.lit("")), F.lit("unknown"))
    return records.groupBy(kind.alias("document_type")).agg(F.count("*").alias("n"))
