"""The caller's rule of m11: means of exactly one half do not depend on the order of the rows."""

from itertools import permutations

from plumbline.catalog.graph_queries import _heavy


def test_order_of_rows_does_not_matter(spark):
    scores = {"l1_1": 0.3, "l1_2": 0.66, "l1_4": 0.54}  # from the last to the first: 1.5000000000000002
    orders = list(permutations(scores))
    nodes = spark.createDataFrame([(i, n, scores[n]) for i, o in enumerate(orders) for n in o] + [(9, "a", 0.5), (9, "b", None)], "doc_id long, node_id string, score double").coalesce(1)
    edges = spark.createDataFrame([(i, n, "Supports", "o1") for i, o in enumerate(orders) for n in o] + [(9, "a", "Supports", "o1"), (9, "b", "Supports", "o1")],
                                  "doc_id long, src string, edge_type string, dst string").coalesce(1)
    assert sorted((r.doc_id, r.node_id) for r in _heavy(nodes, edges).collect()) == [(i, "o1") for i in range(len(orders))]
