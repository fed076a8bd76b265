"""Agreement of predicted with expert scores: Pearson, QWK, MAE, RMSE, bands, ablation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def pearson(x: Column, y: Column, floor: float = 1e-12) -> Column:
    """Aggregate: 0 for fewer than two rows or (nearly) constant input."""
    n = F.count("*")
    denom = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.when((n < 2) | (n * denom < floor), 0.0).otherwise(F.covar_pop(x, y) / F.nullif(denom, F.lit(0.0)))


def rating(x: Column, top: Column, low: float = 0.0) -> Column:
    """Integer rating round(x - low) within 0..int(top - low)."""
    return F.greatest(F.least(F.round(x - low), F.floor(top - low).cast("double")), F.lit(0.0))


def qwk(p: Column, a: Column) -> Column:
    """Quadratic weighted kappa of integer ratings. With squared weights both the
    observed and the chance term are moments, so no confusion matrix is built:
    1 - E[(p-a)^2] / (E[p^2] + E[a^2] - 2 E[p] E[a])."""
    chance = F.avg(p * p) + F.avg(a * a) - 2.0 * F.avg(p) * F.avg(a)
    seen = F.avg((p - a) * (p - a))
    return F.when(F.count("*") == 0, 0.0).when(chance < 1e-12, 1.0).otherwise(1.0 - seen / F.nullif(chance, F.lit(0.0)))


def agreement(df: DataFrame, keys: list[str], predicted: str = "predicted", actual: str = "actual",
              max_score: str = "max_score") -> DataFrame:
    """All metrics per group in one aggregation; the rating range of a group is
    0..its largest max_score, looked up from a first small aggregation."""
    if not keys:
        return agreement(df.withColumn("_all", F.lit(1)), ["_all"], predicted, actual, max_score).drop("_all")
    d = df.join(df.groupBy(*keys).agg(F.max(max_score).alias("_top")), keys)
    p, a, m, t = F.col(predicted), F.col(actual), F.col(max_score), F.col("_top")
    d = d.withColumns({"_rp": rating(p, t), "_ra": rating(a, t)})
    off = F.count_if(F.when(m > 0, F.abs(p / m - a / m) > 0.3).otherwise(False))
    mae = F.avg(F.abs(p - a))
    return d.groupBy(*keys).agg(
        F.count("*").alias("samples"), pearson(p, a).alias("pearson_r"), qwk(F.col("_rp"), F.col("_ra")).alias("qwk"),
        mae.alias("mae"), F.when(F.max("_top") > 0, mae / F.max("_top")).otherwise(0.0).alias("nmae"),
        F.sqrt(F.avg((p - a) * (p - a))).alias("rmse"), F.avg(p).alias("mean_predicted"), F.avg(a).alias("mean_actual"),
        off.alias("hallucination_count"), (off / F.count("*")).alias("hallucination_rate"))


def per_group(df: DataFrame) -> DataFrame:
    """Metrics per rubric ('' counts as "default"), groups of one left out."""
    d = df.withColumn("rubric", F.when(F.col("rubric") == "", "default").otherwise(F.col("rubric")))
    return agreement(d, ["rubric"]).where("samples >= 2")


ABLATION = [  # label, structural score in use
    ("full_pipeline", True), ("no_structural", False), ("no_alignment", True), ("no_debate", True), ("no_validation", True),
]


def ablation(df: DataFrame) -> DataFrame:
    """Metrics per configuration; without structural scoring the prediction is half
    the maximum. df(structural, actual, max_score)."""
    cfg = F.array(*[F.struct(F.lit(n).alias("config"), F.lit(u).alias("use_structural")) for n, u in ABLATION])
    d = df.select("structural", "actual", "max_score", F.inline(cfg))
    predicted = F.when(F.col("use_structural"), F.greatest(F.least("structural", F.lit(1.0)), F.lit(0.0)) * F.col("max_score")).otherwise(
        F.col("max_score") * 0.5)
    return agreement(d.withColumn("predicted", predicted), ["config"])


def score_join(scored: DataFrame, samples: DataFrame) -> DataFrame:
    """scored(id, score) with the expert rows of the same id; others drop out."""
    return scored.select("id", F.col("score").alias("predicted")).join(samples, "id")


def blend(df: DataFrame, own_weight: float = 0.4) -> DataFrame:
    """Metrics of the external score, the deterministic one (own, 0..1), their
    blend and, when present, a calibrated score. df(external, own, actual, max_score[, calibrated])."""
    own = F.col("own") * F.col("max_score")
    kinds = [("external", F.col("external")), ("deterministic", own), ("blended", own * own_weight + F.col("external") * (1 - own_weight))]
    if "calibrated" in df.columns:
        kinds.append(("calibrated", F.col("calibrated")))
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("predicted")) for k, c in kinds])
    return agreement(df.select("actual", "max_score", F.inline(rows)), ["kind"])


BANDS = [(1.0, 1.5, "1.0-1.5"), (2.0, 2.5, "2.0-2.5"), (3.0, 3.5, "3.0-3.5"), (4.0, 4.5, "4.0-4.5"), (5.0, 5.0, "5.0")]


def score_bands(df: DataFrame) -> DataFrame:
    """Count, mean prediction and mean delta per expert band; empty bands kept."""
    band = reduce(lambda e, b: e.when(F.col("actual").between(b[0], b[1]), b[2]), BANDS, F.when(F.lit(False), ""))
    found = df.withColumn("band", band).where("band is not null").groupBy("band").agg(
        F.count("*").alias("n"), F.avg("predicted").alias("mean_predicted"),
        (F.avg("predicted") - F.avg("actual")).alias("mean_delta"))
    dim = df.sparkSession.createDataFrame([(b[2], b[0], b[1]) for b in BANDS], "band string, low double, high double")
    return dim.join(found, "band", "left").fillna(0, subset=["n", "mean_predicted", "mean_delta"])


def calibrate_bias(points: DataFrame) -> DataFrame:
    """(criterion_id, expert_score, system_score): bias and scale per criterion;
    scale = sd(expert)/sd(system), 1 when the latter is 0.01 or less."""
    sd = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    agg = points.groupBy("criterion_id").agg(
        F.count("*").alias("data_points"), (F.avg("system_score") - F.avg("expert_score")).alias("bias"),
        sd("expert_score").alias("e"), sd("system_score").alias("s"))
    return agg.select("criterion_id", "data_points", "bias",
                      F.when(F.col("s") > 0.01, F.col("e") / F.nullif(F.col("s"), F.lit(0.0))).otherwise(1.0).alias("scale_factor"))


def calibration_summary(points: DataFrame) -> DataFrame:
    e, s = F.col("expert_score") / F.col("max_score"), F.col("system_score") / F.col("max_score")
    return points.agg(F.count("*").alias("data_points"), F.avg(F.col("system_score") - F.col("expert_score")).alias("overall_bias"),
                      pearson(e, s, 1e-10).alias("correlation"))


def apply_calibration(scores: DataFrame, adjustments: DataFrame) -> DataFrame:
    x = (F.col("system_score") - F.col("bias")) * F.col("scale_factor")
    return scores.join(adjustments.select("criterion_id", "bias", "scale_factor"), "criterion_id").withColumn(
        "calibrated", F.greatest(F.least(x, F.col("max_score")), F.lit(0.0))).drop("bias", "scale_factor")


def split_train_test(df: DataFrame, key: str) -> DataFrame:
    """Deterministic half split by the first digit of the key's MD5, independent of row order."""
    return df.withColumn("is_train", F.substring(F.md5(F.col(key).cast("string")), 1, 1) < "8")


def weight_search(features: DataFrame, grid: list[tuple], names: list[str]) -> DataFrame:
    """Loss -pearson + 0.01 mae of every weight vector on train rows, with the same
    metrics on test rows, best first.

    features(f..., actual, max_score, is_train); the grid is a literal array that
    fans each row out in place, and rows collapse to one partial state per grid
    point and task before the only shuffle."""
    g = F.array(*[F.struct(F.lit(i).alias("grid_id"), *[F.lit(float(v)).alias(f"w_{n}") for n, v in zip(names, w)]) for i, w in enumerate(grid)])
    d = features.select(*names, "actual", "max_score", "is_train", F.inline(g))
    raw = sum((F.col(n) * F.col(f"w_{n}") for n in names), F.lit(0.0))
    d = d.withColumn("p", F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0)) * F.col("max_score"))

    def part(flag, label):
        p, a = (F.when(F.col("is_train") == flag, F.col(c)) for c in ("p", "actual"))
        n = F.count(p)
        den = F.sqrt(F.var_pop(p) * F.var_pop(a))
        r = F.when((n < 2) | (n * den < 1e-12), 0.0).otherwise(F.covar_pop(p, a) / F.nullif(den, F.lit(0.0)))
        return r.alias(f"{label}_pearson"), F.avg(F.abs(p - a)).alias(f"{label}_mae")

    out = d.groupBy("grid_id", *[f"w_{n}" for n in names]).agg(*part(True, "train"), *part(False, "test"))
    return out.withColumn("loss", -F.col("train_pearson") + F.col("train_mae") * 0.01).orderBy("loss", "grid_id")
