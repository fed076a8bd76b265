"""Top k of many queries: the grid against numpy, the index by its recall."""

import numpy as np

from plumbline.operators import vector_search as V


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


def plain(queries, vectors, k):
    out = set()
    unit = lambda v: np.asarray(v, float) / (np.linalg.norm(v) or 1)
    for q, a in queries:
        if a is not None:
            best = sorted(((-round(float((unit(b) * unit(a)).sum()), 9), i) for i, b in vectors if b is not None))[:k]
            out |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(best)}
    return out


def test_grid_with_repeated_null_and_zero_vectors(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 40)  # many blocks
    monkeypatch.setattr(V, "QUERIES", 3)
    rng = np.random.default_rng(1)
    same = rng.normal(size=6).round(2)
    rows = [(i, same if i % 3 == 0 else rng.normal(size=6).round(2)) for i in range(300)] + [(300, None), (301, np.zeros(6)), (302, 2 * same)]
    queries = [rows[i] for i in (0, 1, 2, 7, 9, 50, 300, 301)]
    got = {(r.query_id, r.vec_id, round(r.similarity, 9) + 0.0, r["rank"]) for r in V.exact_topk(frame(spark, queries), frame(spark, rows), 12).collect()}
    want = {(q, i, s + 0.0, n) for q, i, s, n in plain(queries, rows, 12)}
    assert {x[:2] + x[3:] for x in got} == {x[:2] + x[3:] for x in want} and max(abs(a[2] - b[2]) for a, b in zip(sorted(got), sorted(want))) < 1e-8
    assert V.exact_topk(frame(spark, []), frame(spark, rows), 3).isEmpty() and V.exact_topk(frame(spark, queries), frame(spark, []), 3).isEmpty()


def test_index_recall_and_exactness_with_all_probes(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q = e.where("vec_id % 100 = 0")
    cells = V.fit_cells(e)
    exact = {(r.query_id, r.vec_id) for r in V.exact_topk(q, e, 10).collect()}
    got = {(r.query_id, r.vec_id) for r in V.indexed_topk(q, e, 10, cells).collect()}
    assert len(exact) == 200 and len(got & exact) >= 0.9 * len(exact) and cells.probes < len(cells.centroids)
    assert {(r.query_id, r.vec_id) for r in V.indexed_topk(q, e, 10, cells, len(cells.centroids)).collect()} == exact


def test_index_of_few_and_of_clustered_rows(spark):
    one = frame(spark, [(1, [1, 0]), (2, None)])
    assert [(r.query_id, r.vec_id) for r in V.indexed_topk(one, one, 3, V.fit_cells(one)).collect()] == [(1, 1)]
    none = frame(spark, [])
    assert V.indexed_topk(none, none, 3, V.fit_cells(none)).isEmpty()
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(20, 16))
    near = frame(spark, [(i, middle[i % 20] + 0.01 * rng.normal(size=16)) for i in range(2000)])
    assert V.fit_cells(near, 20).probes <= 4  # clustered rows need few cells
