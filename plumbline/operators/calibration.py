"""Evidence profiles, anchor documents and anchor-calibrated scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions import text as T

PROFILE = [  # category, divisor in the feature vector
    ("counter_arguments", 1.0), ("sentence_variety", 5.0), ("cohesion_devices", 1.0), ("vocabulary_sophistication", 1.0),
    ("topic_sentences", 1.0), ("personal_voice", 1.0), ("rhetorical_devices", 5.0),
]
#: Anchors that one row holds.
BLOCK = 500


def evidence_profile(items: Column, text: Column) -> Column:
    """array<double>, length 10: scaled words, seven category counts, thesis flag,
    mean quality."""
    count = lambda cat: F.size(F.filter(items, lambda x: x["category"] == cat)).cast("double")
    n = F.size(items)
    mean = F.when(n > 0, F.aggregate(items, F.lit(0.0), lambda a, x: a + x["quality"]) / n).otherwise(0.0)
    return F.array(
        F.least(T.word_count(text) / 500.0, F.lit(2.0)), *[count(c) / k for c, k in PROFILE],
        (count("argument_thesis") > 0).cast("double"), mean)


def cosine(a: Column, b: Column, floor: float = 1e-10) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < floor) | (nb < floor), 0.0).otherwise(dot(a, b) / F.nullif(na * nb, F.lit(0.0)))


def build_anchors(profiled: DataFrame, per_band: int) -> DataFrame:
    """The first ``per_band`` samples of every half-point score band, by id."""
    band = F.round(F.col("score") * 2.0).cast("int")
    w = Window.partitionBy("band").orderBy("doc_id")
    return profiled.withColumn("band", band).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_band).drop("_rn")


def nearest_anchor(profiled: DataFrame, anchors: DataFrame) -> DataFrame:
    """Most similar anchor of each profile (ties: lower score, then lower id); null where there
    are no anchors.

    Anchors are dealt to rows of about BLOCK, and each distinct profile meets each of these rows; Spark
    decides by size how they travel. Profiles that many documents share are compared once."""
    blocks = max(1, -(-anchors.count() // BLOCK))
    dealt = anchors.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), F.struct(F.col("score").cast("double").alias("score"), F.col("doc_id").alias("id"), F.col("profile").alias("v")).alias("a"))
    dealt = dealt.groupBy("block").agg(F.collect_list("a").alias("anchors")).drop("block")
    nearness = lambda a: F.greatest(F.least(cosine(F.col("profile"), a["v"]), F.lit(1.0)), F.lit(0.0))
    best = F.array_min(F.transform("anchors", lambda a: F.struct((-nearness(a)).alias("far"), a["score"].alias("score"), a["id"].alias("id"))))
    found = profiled.select("profile").distinct().crossJoin(dealt).select("profile", best.alias("b")).groupBy("profile").agg(F.min("b").alias("_best"))
    return profiled.join(found, "profile", "left").select(
        *profiled.columns, F.col("_best.id").alias("anchor_id"), F.col("_best.score").alias("anchor_score"), (F.lit(0.0) - F.col("_best.far")).alias("similarity"))


def calibrated_score(nearest: DataFrame, external: str, max_score: Column) -> DataFrame:
    """Pull of the external score towards its anchor by 0.3 * similarity."""
    x = F.col(external)
    pulled = x + (F.col("anchor_score") - x) * (F.col("similarity") * 0.3)
    return nearest.withColumn("calibrated", F.when(F.col("anchor_id").isNull(), x).otherwise(
        F.greatest(F.least(pulled, max_score), F.lit(1.0))))
