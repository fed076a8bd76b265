"""Predictions meet items by keywords as if every pair of a document had been looked at."""

import random

from pyspark.sql import functions as F

from plumbline.functions import lexicons as L, text as T
from plumbline.operators import predictions


def test_overlaps_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    words = ["growth", "savings", "market", "region", "quality", "review", "budget", "schedule", "the", "of"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    preds = [(d, k, text(8)) for d in range(6) for k in range(5)]
    items = [(d, rng.choice(["evidence", "claim"]), text(10), rng.choice([None, 0.2, 0.9]), rng.choice([True, False])) for d in range(7) for _ in range(25)]
    items += items[:40] + [(1, "evidence", None, None, None)]
    p = spark.createDataFrame(preds, "doc_id long, prediction_no int, text string")
    i = spark.createDataFrame(items, "doc_id long, role string, text string, specificity double, quantified boolean")
    cols = ["role", "specificity", "quantified"]
    got = predictions._overlaps(p, i, cols).groupBy("doc_id", "prediction_no", *cols, F.round("o", 9).alias("o")).agg(F.sum("n").alias("n"))
    key = lambda c: T.keywords_list(F.col(c), L.STOP_PREDICT)
    pairs = p.withColumnRenamed("text", "pt").join(i, "doc_id").withColumn("o", F.round(T.overlap_list(key("pt"), key("text")), 9)).where("o > 0")
    want = pairs.groupBy("doc_id", "prediction_no", *cols, "o").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_evidence_that_shares_nothing_is_still_seen(spark):
    p = spark.createDataFrame([(1, 0, "market share grows", "qualitative_goal", None), (2, 0, "market share grows", "qualitative_goal", None)],
                              "doc_id long, prediction_no int, text string, prediction_type string, timeframe string")
    i = spark.createDataFrame([(1, "evidence", "unrelated weather report", None, True)], "doc_id long, role string, text string, specificity double, quantified boolean")
    got = {r.doc_id: (r.supporting, r.credibility, r.confidence) for r in predictions.assess_credibility(p, i).collect()}
    assert got == {1: (0, 0.0, 0.3), 2: (0, 0.0, 0.3)}
