"""Queries that write their items read the texts once; shortcuts of patterns give what the plain ones give."""

import pytest
from pyspark.sql import functions as F

from plumbline.catalog import load_all
from plumbline.functions import lexicons as L, text as T
from plumbline.operators import adaptive


@pytest.mark.parametrize("name", ["g13_quote_check", "r7_verify_predictions", "r8_prediction_report", "validate_all"])
def test_texts_are_not_read_again(spark, name):
    plan = load_all()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "n_chars" not in plan


def test_revision_impact_joins_no_texts(spark):
    plan = load_all()[0]["d15_revision_impact"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "new_text" not in plan and "old_text" not in plan


def test_squashed_and_markers(spark):
    texts = ["", " ", "a", " A\tb  c  d\n\ne ", "x  y", "12% of 3.5 a%b%c %% 1e5 inf nanx -.5", "　q　"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(T.squashed(F.col("t")).alias("a"), F.array_join(T.words(F.lower("t")), " ").alias("b"), T.specificity_markers(F.col("t")).alias("n")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    assert rows[5].n == 7 and rows[1].n == 0


def test_sentences_are_cut_once_for_all_genres(spark):
    every = adaptive.items(F.col("t"), *L.CATEGORIES)
    one = F.concat(*[adaptive.items(F.col("t"), g) for g in L.CATEGORIES])
    df = spark.createDataFrame([("However, I think the objective is clear. We shall deliver 20 cases (Lee). Is it so? " * 2,)], "t string")
    r = df.select(every.alias("a"), one.alias("b")).first()
    assert r.a == r.b and r.a
    cuts = lambda c: str(c._jc.toString()).count("(?<=[.?!]) ")
    assert cuts(every) < cuts(one)


def test_rates_and_first_sentences_are_made_once(spark):
    """Inside a lambda nothing is shared: each use of an expression evaluates it again, for each marker."""
    from plumbline.operators import checks

    uses = lambda c, part: str(c._jc.toString()).count(part)
    assert uses(checks.transitions(), "(?s)^.*?[.!?]") == 1
    assert uses(checks.hedging(), L.HEDGES[0]) == 1
    texts = ["", " ", "'a' -b- c3! (d) e's f--g ... «h» ½ x y, Ä-ö! 漢字。 ..z", "A.b .c. d,"]
    edge = r"(?<!\S)[^\p{L}\p{N}\s]+|[^\p{L}\p{N}\s]+(?!\S)"
    plain = lambda c: T.words(F.regexp_replace(T.plain_ws(F.lower(c)), edge, ""))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.bare_words(F.col("t")).alias("a"), plain(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and len(rows[2].a) > 8
