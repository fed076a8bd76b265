"""The most similar vectors of many queries at once: exact, or by an inverted file.

    exact_topk(queries, vectors, 10)
    cells = fit_cells(vectors)
    indexed_topk(queries, vectors, 10, cells)

Both return (query_id, vec_id, similarity, rank): cosine similarity, rounded to nine places,
ties by id. A null vector is neither a query nor a result; a vector of length 0 has similarity 0
to all. Queries and vectors meet in a grid: vectors are dealt to blocks of ``BLOCK`` by hash,
queries to blocks of ``QUERIES``, and each pair of blocks is one bounded group, so no cell and
no repeated vector makes a group large. A group keeps its own k best for each query; Spark
merges them by rank and drops the rest before the shuffle.

The inverted file's cells are k-means centroids fitted on at most ``SAMPLE`` rows (those with
the smallest id hashes); every row is in the index, in the cell that it is nearest to, and a query
looks into its ``probes`` nearest cells: as many as the ``NEAREST`` nearest neighbours of
``TUNED`` sample rows within the sample need for a recall of ``RECALL``. Vectors without clusters
so get many probes, and clustered ones few. At most ``MAX_CELLS`` centroids are sent to tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 8192
QUERIES = 1024
SAMPLE = 10_000
MAX_CELLS = 1024
TUNED = 500
NEAREST = 10
RECALL = 0.97

FOUND = "query_id long, vec_id long, similarity double"


def matrix(column) -> np.ndarray:
    """Unit rows of an Arrow list column without nulls; zero rows stay zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(length == 0, 1, length)


def _best(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k best vectors of ``right`` for each query of ``left``."""
    queries, vectors = matrix(left.column("vector")), matrix(right.column("vector"))
    q_ids, v_ids = (np.asarray(t.column("id").combine_chunks()) for t in (left, right))
    qs, vs, sims = [], [], []
    for i in range(len(queries) if len(vectors) else 0):
        s = np.round((vectors * queries[i]).sum(axis=1), 9)  # row by row: equal vectors get equal sums
        near = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
        top = near[np.lexsort((v_ids[near], -s[near]))][:k]
        qs.append(np.full(len(top), q_ids[i]))
        vs.append(v_ids[top])
        sims.append(s[top])
    join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
    return pa.table({"query_id": join(qs, pa.int64()), "vec_id": join(vs, pa.int64()), "similarity": join(sims, pa.float64())})


def _plain(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")


def _grid(queries: DataFrame, vectors: DataFrame, cells: dict[int, tuple[int, int]], k: int) -> DataFrame:
    """Top k over pairs of blocks. Both tables: (cell, id, vector); cells: rows of vectors
    and of queries in each cell."""
    blocks = {c: (max(1, math.ceil(v / BLOCK)), max(1, math.ceil(n / QUERIES))) for c, (v, n) in cells.items()}
    count = lambda at: F.create_map(*[x for c, b in blocks.items() for x in (F.lit(c), F.lit(b[at]))])[F.col("cell")]
    mine = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    v = vectors.select("cell", "id", "vector", count(0).alias("nv"), count(1).alias("nq")).select("cell", mine(F.col("nv")).alias("i"), every(F.col("nq")).alias("j"), "id", "vector")
    q = queries.select("cell", "id", "vector", count(0).alias("nv"), count(1).alias("nq")).select("cell", every(F.col("nv")).alias("i"), mine(F.col("nq")).alias("j"), "id", "vector")
    found = q.groupBy("cell", "i", "j").cogroup(v.groupBy("cell", "i", "j")).applyInArrow(lambda a, b: _best(a, b, k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_topk(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """All vectors are compared with all queries, in blocks."""
    one = F.lit(0).alias("cell")
    q, v = (_plain(x, key, vector).select(one, "id", "vector") for x in (queries, vectors))
    return _grid(q, v, {0: (v.count(), q.count())}, k)


@dataclass
class Cells:
    """Centroids (unit rows), and how many of the nearest a query looks into."""

    centroids: np.ndarray
    probes: int


def fit_cells(vectors: DataFrame, cells: int | None = None, recall: float = RECALL, key: str = "vec_id", vector: str = "embedding") -> Cells:
    """k-means over a sample; sqrt(rows) cells unless given, at most MAX_CELLS."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = _plain(vectors, key, vector)
    rows = v.count()
    cells = max(1, min(MAX_CELLS, cells or math.isqrt(rows), rows))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    sample = v.select("id", "vector", length.alias("length")).where("length > 0").orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = sample.select(F.transform("vector", lambda x: x / F.col("length")).alias("vector")).repartition(8).cache()
    try:
        unit = matrix(sample.toArrow().column("vector"))
        if cells < 2 or len(unit) < 2:
            return Cells(np.zeros((1, 1)), 1)
        found = np.array(KMeans(k=cells, seed=1, maxIter=8).fit(sample.select(array_to_vector("vector").alias("features"))).clusterCenters())
    finally:
        sample.unpersist()
    found /= np.maximum(np.sqrt((found * found).sum(axis=1, keepdims=True)), 1e-300)
    return Cells(found, _probes(unit, found, recall))


def _probes(unit: np.ndarray, centroids: np.ndarray, recall: float) -> int:
    """Cells that sample rows have to look into to meet their nearest ones in the sample."""
    queries = unit[:TUNED]
    order = np.argsort(np.argsort(-(queries @ centroids.T), axis=1, kind="stable"), axis=1)  # rank of each cell
    cell = np.concatenate([(unit[i:i + 1000] @ centroids.T).argmax(axis=1) for i in range(0, len(unit), 1000)])
    sims = queries @ unit.T
    sims[np.arange(len(queries)), np.arange(len(queries))] = -2  # a row finds itself with one probe
    k = min(NEAREST, len(unit) - 1)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    ranks = np.sort(np.take_along_axis(order, cell[near], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]) + 1


def nearest_cells(vector: Column | str, centroids: np.ndarray, n: int) -> Column:
    """The n cells that a vector is nearest to, nearest first."""

    @F.arrow_udf("array<int>")
    def cells(column: pa.Array) -> pa.Array:
        if len(centroids) == 1:
            return pa.array([[0]] * len(column), pa.list_(pa.int32()))
        near = matrix(column) @ centroids.T
        return pa.array(np.argsort(-near, axis=1, kind="stable")[:, :n].tolist(), pa.list_(pa.int32()))

    return cells(vector)


def indexed_topk(queries: DataFrame, vectors: DataFrame, k: int, cells: Cells, probes: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best vectors of the ``probes`` cells nearest to each query."""
    centroids = cells.centroids
    probes = min(len(centroids), probes or cells.probes)
    v = _plain(vectors, key, vector).select(F.element_at(nearest_cells("vector", centroids, 1), 1).alias("cell"), "id", "vector")
    q = _plain(queries, key, vector).select(F.explode(nearest_cells("vector", centroids, probes)).alias("cell"), "id", "vector")
    n_v, n_q = ({r["cell"]: r["count"] for r in x.groupBy("cell").count().collect()} for x in (v, q))  # MAX_CELLS rows at most
    both = {c: (n_v[c], n_q[c]) for c in n_v.keys() & n_q.keys()}
    if not both:
        return _grid(q, v, {0: (0, 0)}, k)
    inside = F.col("cell").isin(*both)
    return _grid(q.where(inside), v.where(inside), both, k)
