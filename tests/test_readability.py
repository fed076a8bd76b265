"""Syllables and words of whole texts by cheaper patterns: the same as by the plain ones."""

import random

from pyspark.sql import functions as F

from plumbline.functions import text as T


def test_same_as_the_plain_patterns(spark):
    rng = random.Random(3)
    parts = list("abeyzséß1.,-'") + [" ", "\n", "\t", " ", "　", " ", "\x85", "E", "ate", "the", "brr "]
    texts = ["", " ", " ", "brr", "b c d", "\nb", None] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    low = T.plain_ws(F.lower("text"))
    plain = F.regexp_count(low, F.lit("[aeiouy]+")) - F.regexp_count(low, F.lit(r"[aeiouy][^aeiouy\s]+[aeiouy]*e(?:[^\p{L}\s]+)?(?!\S)")) + F.regexp_count(
        low, F.lit(r"(?<!\S)[^aeiouy\s]++(?!\S)"))
    got = d.select("text", T.readability(F.col("text")).alias("r"), T.syllable_total(F.col("text")).alias("s"), T.word_count(F.col("text")).alias("w"),
                   plain.alias("plain"), F.size(T.words(F.col("text"))).alias("n")).collect()
    for r in got:
        if r.text is not None:
            assert r.r.syllables == r.s == r.plain and r.w == r.n, r.text
            assert (r.r.grade == 0.0) == (r.n == 0) or r.n > 0


def test_a_text_is_read_once_for_syllables_and_grade(spark):
    from plumbline.catalog import load_all

    plan = load_all()[0]["p10_reading_grade"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[aeiouy][^aeiouy") == 1
