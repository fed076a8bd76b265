"""Longest chains and PageRank against plain versions."""

import random

from plumbline.operators import graph


def plain_depth(edges):
    """Longest chain where nodes on a common cycle count as one worth its size less one."""
    out = {d: {} for d, *_ in edges}
    for d, a, b in set(edges):
        out[d].setdefault(a, set()).add(b)
        out[d].setdefault(b, set())
    depths = {}
    for d, g in out.items():
        reach = {}
        for a in g:
            seen, todo = set(), [a]
            while todo:
                for y in g[todo.pop()]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            reach[a] = seen
        group = {a: frozenset({b for b in g if a == b or (b in reach[a] and a in reach[b])}) for a in g}
        worth = {}

        def best(c):
            if c not in worth:
                nxt = {group[b] for a in c for b in g[a]} - {c}
                worth[c] = len(c) - 1 + max((1 + best(x) for x in nxt), default=0)
            return worth[c]

        depths[d] = max(best(c) for c in set(group.values()))
    return depths


def frame(spark, edges):
    return spark.createDataFrame([(d, f"n{a}", "Supports", f"n{b}") for d, a, b in edges], "doc_id long, src string, edge_type string, dst string")


def depths(spark, edges):
    return {r.doc_id: r.max_depth for r in graph.support_depth(frame(spark, edges)).collect()}


def test_depth_of_random_graphs(spark):
    rng = random.Random(1)
    edges = []
    for d in range(12):
        n = rng.randint(2, 4) if d % 4 == 1 else rng.randint(1, 12)
        for _ in range(rng.randint(1, 2 * n)):
            a, b = rng.randrange(n), rng.randrange(n)
            edges.append((d, a, b) if d % 4 == 1 or a < b else (d, b, a))  # some documents have cycles, all have loops
        if d % 4 == 0:
            edges += [(d, 100 + i, 101 + i) for i in range(rng.randint(1, 30))] + [(d, rng.randrange(n), 100)]
        if d == 5:
            edges += [(d, 200 + i, 200 + (i + 1) % 3) for i in range(3)]  # a cycle of its own
    assert depths(spark, edges) == plain_depth(edges)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    cuts = []
    own = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: cuts.append(1) or own(df))
    edges = [(1, i, i + 1) for i in range(3000)] + [(2, 0, 1), (2, 1, 2), (3, 5, 5)]
    assert depths(spark, edges) == {1: 3000, 2: 2, 3: 0}
    assert len(cuts) < 30


def test_pagerank_is_the_power_iteration(spark):
    rng = random.Random(2)
    nodes = [(d, f"n{i}") for d in range(8) for i in range(rng.randint(1, 9))]
    edges = [(d, rng.randrange(9), rng.randrange(9)) for d in range(8) for _ in range(rng.randint(0, 14))]
    n = spark.createDataFrame([(d, x, "SubClaim") for d, x in nodes], "doc_id long, node_id string, node_type string")
    got = {(r.doc_id, r.node_id): r["rank"] for r in graph.pagerank(n, frame(spark, edges + [(0, 0, 77)]), iterations=12, cut_every=4).collect()}
    assert set(got) == set(nodes)
    for d in range(8):
        mine = [x for k, x in nodes if k == d]
        e = [(f"n{a}", f"n{b}") for k, a, b in edges if k == d and f"n{a}" in mine and f"n{b}" in mine]
        out = {x: sum(a == x for a, _ in e) for x in mine}
        r = dict.fromkeys(mine, 1 / len(mine))
        for _ in range(12):
            lost = sum(r[x] for x in mine if not out[x])
            r = {x: 0.15 / len(mine) + 0.85 * lost / len(mine) + 0.85 * sum(r[a] / out[a] for a, b in e if b == x) for x in mine}
        top = max(r.values())
        assert all(abs(got[d, x] - max(r[x] / top, 0.1 / len(mine))) < 1e-9 for x in mine)
