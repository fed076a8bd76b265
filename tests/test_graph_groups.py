"""Depth and metrics by whole documents in tasks, and by joins for large ones, agree and read the graph once."""

import random

import pytest

from plumbline.operators import graph
from tests.test_graph_depth import depths, frame, plain_depth


def some_edges(seed):
    rng = random.Random(seed)
    return [(d, rng.randrange(n), rng.randrange(n)) if d % 5 == 0 else (d, *sorted(rng.sample(range(n), 2)))
            for d in range(20) for n in [rng.randint(2, 14)] for _ in range(rng.randint(1, 2 * n))]


@pytest.mark.parametrize("group,chunk", [(1 << 14, 1 << 17), (12, 16), (0, 1)])
def test_depth_at_any_size_of_document(spark, monkeypatch, group, chunk):
    monkeypatch.setattr(graph, "GROUP", group)
    monkeypatch.setattr(graph, "CHUNK", chunk)
    edges = some_edges(3)
    assert depths(spark, edges) == plain_depth(edges)


def test_only_edges_between_known_nodes_count(spark, monkeypatch):
    edges = [(1, 0, 1), (1, 1, 2), (1, 2, 9), (2, 0, 9), (3, 0, 0), (None, 0, 1)]
    n = spark.createDataFrame([(d, f"n{i}") for d in (1, 2, 3) for i in range(4)] + [(1, None)], "doc_id long, node_id string")
    e = frame(spark, edges).union(spark.createDataFrame([(1, None, "Supports", "n0"), (2, "n0", "Warrants", "n1")], "doc_id long, src string, edge_type string, dst string"))
    for group in (1 << 14, 0):
        monkeypatch.setattr(graph, "GROUP", group)
        assert {r.doc_id: r.max_depth for r in graph.support_depth(e, n).collect()} == {1: 2, 3: 0}


def test_metrics_with_depth(spark, monkeypatch):
    edges = some_edges(4)
    kinds = graph.NODE_TYPES
    n = spark.createDataFrame([(d, f"n{i}", kinds[(d + i) % len(kinds)], i / 8 if i % 3 else None) for d in range(21) for i in range(10)],
                              "doc_id long, node_id string, node_type string, score double")
    e = frame(spark, edges)
    want = sorted(map(repr, graph.graph_metrics(n, e, graph.support_depth(e, n)).collect()))
    for group in (1 << 14, 12):
        monkeypatch.setattr(graph, "GROUP", group)
        m = graph.metrics_with_depth(n, e)
        assert sorted(map(repr, m.select("doc_id", *[c for c in graph.graph_metrics(n, e).columns if c != "doc_id"], "max_depth").collect())) == want


def test_the_graph_is_read_once(spark):
    from plumbline.catalog import load_all

    plan = load_all()[0]["g8_structural_score"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_pagerank_at_any_size_of_document(spark, monkeypatch):
    edges = some_edges(5)
    n = spark.createDataFrame([(d, f"n{i}") for d in range(20) for i in range(11)], "doc_id long, node_id string")
    ranks = lambda: {(r.doc_id, r.node_id): r["rank"] for r in graph.pagerank(n, frame(spark, edges), iterations=7).collect()}
    whole = ranks()
    assert len(whole) == 220
    for group in (14, 0):
        monkeypatch.setattr(graph, "GROUP", group)
        assert ranks() == pytest.approx(whole, abs=1e-12)
