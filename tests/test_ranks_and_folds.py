"""Exact ranks by sketches, folds of clamped additions, facts from neighbour bits."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import ranking
from plumbline.operators import history, panel, rules


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "percentage double")


@pytest.mark.parametrize("kind", ["narrow", "ties", "hot", "two", "few", "wide"])
def test_values_at_ranks(spark, monkeypatch, kind):
    monkeypatch.setattr(ranking, "FEW", 50)  # so that intervals have to be narrowed
    rng = random.Random(kind)
    values = {
        "narrow": [50 + rng.random() * 1e-6 for _ in range(5000)], "ties": [float(rng.randrange(7)) for _ in range(5000)],
        "hot": [42.0] * 4000 + [rng.random() * 100 for _ in range(2000)], "two": [1.0] * 3000 + [2.0] * 3001, "few": [3.0, 1.0, 2.0],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(3000)]}[kind]
    df, want = column(spark, values + [None]), sorted(values)
    n = len(values)
    ranks = sorted({0, 1, n // 4, n // 2, n - 1, 2 * n // 3} & set(range(n)))
    assert ranking.values_at_ranks(df, "percentage", lambda _: ranks) == [(r, want[r]) for r in ranks]
    assert history.median(df).first()[0] == pytest.approx((want[(n - 1) // 2] + want[n // 2]) / 2, rel=1e-12)


def test_ranks_without_rows(spark):
    none = column(spark, [None])
    assert history.median(none).first()[0] is None and history.nearest_rank_percentiles(none).isEmpty()
    assert [tuple(r) for r in history.nearest_rank_percentiles(column(spark, [5.0, 1.0])).collect()] == [(25, 1.0), (50, 5.0), (75, 5.0)]


def test_counts_below_in_any_range(spark):
    rng = random.Random(2)
    rows = [("a", 50 + rng.randrange(2000) * 1e-9, 1) for _ in range(4000)] + [("b", float(rng.randrange(3)), rng.randrange(2)) for _ in range(200)] + [("c", 7.0, 0), (None, 1.0, 1)]
    got = ranking.counts_below(spark.createDataFrame(rows, "k string, v double, h int"), ["k"], "v", "h").collect()
    assert len(got) == len({r[:2] for r in rows})
    for r in got:
        if r.k is not None:
            assert r.below == sum(h for k, v, h in rows if k == r.k and v < r.v) and r.h == sum(h for k, v, h in rows if (k, v) == (r.k, r.v))


def test_trust_of_many_pairs_by_levels(spark):
    rng = random.Random(3)
    rows = [(s, i, f"x{rng.randrange(2)}", "y", 1.0 if rng.random() < 0.35 else None) for i in range(600) for s in ([0] if i % 3 else [0, 1, 2])]
    start = [(0, "y", "x0", 0.9), (7, "y", "x0", 0.1)]
    want = {}
    for s, i, c, t, m in sorted(rows):
        key = (s, t, c)
        now = want.get(key, {k[:3]: k[3] for k in start}.get(key, 0.5))
        want[key] = min(now + 0.1, 1.0) if m is not None else max(now - 0.05, 0.0)
    ch = spark.createDataFrame(rows, "session_id long, seq long, challenger string, target string, score_to double")
    given = spark.createDataFrame(start, "session_id long, truster string, trustee string, trust_level double")
    for width in (2, 5, 1024):
        got = {(r.session_id, r.truster, r.trustee): r.trust_level for r in panel.trust_update(ch, given, width=width).collect()}
        assert got == pytest.approx(want)
    assert panel.trust_update(ch.limit(0)).isEmpty()


def test_facts_of_bits_are_those_of_the_rules(spark):
    rng = random.Random(4)
    types = ["Thesis", "SubClaim", "Evidence", "QuantifiedEvidence", "Citation", "Counter", "Rebuttal", "Structural"]
    nodes = [(d, i, rng.choice(types), None) for d in range(30) for i in range(rng.randint(1, 12))] + [(0, 0, "Thesis", None), (0, 0, "Evidence", None)]
    edges = [(d, rng.randrange(13), rng.choice(["Supports", "Supports", "Counters", "Rebuts", "Other"]), rng.randrange(13)) for d in range(31) for _ in range(rng.randint(0, 30))]
    n = spark.createDataFrame(nodes, "doc_id long, node_id long, node_type string, score double")
    e = spark.createDataFrame(edges, "doc_id long, src long, edge_type string, dst long")
    counts = {(r.doc_id, r.fact): r.c for r in rules.derive(n, e).groupBy("doc_id", "fact").agg(F.countDistinct("node_id").alias("c")).collect()}
    got = rules.mine_facts(n, e).collect()
    assert {r.doc_id for r in got} == {x[0] for x in nodes}
    for r in got:
        c = lambda f: counts.get((r.doc_id, f), 0)
        assert (r.strong_claims, r.weak_claims, r.unsupported_claims, r.sophisticated_arguments) == tuple(map(c, rules.FACTS[:4]))
        assert (r.evidenced_thesis, r.quantified_support, r.citation_support, r.deep_chains) == (c("EvidencedThesis") > 0, *map(c, rules.FACTS[5:]))
