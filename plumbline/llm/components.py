"""Connected components of a table of links, by DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import keep


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable), for every node of ``links`` (a, b).

    Distributed union-find: each round hooks all larger neighbours of a node, then all
    smaller ones, to the smallest (two aggregations with partial results in each task
    and two joins that Spark may split at large nodes). The number of rounds grows with
    the logarithm of the longest chain. Rounds are written to the shared folder. Links
    with a null end and links of a node to itself connect nothing."""
    pair = lambda hi, lo: (F.col(hi).alias("u"), F.col(lo).alias("v"))
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, state = keep(edges, "links"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select("v", "v").distinct()).distinct()
        state = now
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(*pair("v", "m")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(*pair("v", "m"))
        edges = keep(small.union(least.select("u", "m")).distinct(), "links")


def link_in_turns(pending: DataFrame, known: DataFrame, verify: Callable[[DataFrame], DataFrame], few: int, most: int, closest: int) -> DataFrame:
    """node, component: ``known`` after the links among all pairs (a, b, far) have been added to it.

    A turn gives ``verify`` about ``most`` pairs (a, b) and gets the links among them; pairs whose
    ends have come to one component need no look. While more than ``few`` are left, the first
    turns, ``closest`` of them, take the pair with the least ``far`` of any two components."""
    turn = 0
    while True:
        a, b = (known.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
        at = pending.join(a, "a", "left").join(b, "b", "left").select("a", "b", "far", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
        at = keep(at.where("ca <> cb"), "open-pairs")
        left = at.count()
        if not left:
            return known
        if turn < closest and left > few:
            best = F.min(F.struct("far", "a", "b")).alias("p")
            now = at.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(best).select("p.a", "p.b")
        else:
            now = at.where(F.pmod(F.xxhash64(F.lit(turn), "a", "b"), F.lit(1 + left // most)) == 0).select("a", "b")
        now = keep(now, "pairs-of-turn")
        known = components(keep(verify(now), "links-of-turn").union(known.select("node", "component")))
        pending, turn = at.select("a", "b", "far").join(now, ["a", "b"], "left_anti"), turn + 1
