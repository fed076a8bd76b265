"""Argument graphs: one node table and one edge table for all documents, keyed by doc_id.

``build_graph`` and ``graph_from_scores`` return the adjacency form, one row per
node with its outgoing edges as a short array; ``node_rows``/``edge_rows`` give
the flat tables. A graph may hold any share of all rows: metrics pre-aggregate
per node before they meet per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions import lexicons as L, text as T
from plumbline.session import cut_lineage, settle

CLAIM_TYPES = ["Thesis", "SubClaim"]
EVIDENCE_TYPES = ["Evidence", "QuantifiedEvidence", "Citation"]
NODE_TYPES = CLAIM_TYPES + EVIDENCE_TYPES + ["Counter", "Rebuttal", "Structural"]
SCORING_EDGES = ["Supports", "Warrants", "Counters", "Rebuts"]
RANK_EDGES = ["Supports", "Warrants", "Rebuts"]
SPAN = "struct<start:int,end:int>"
NODE_COLS = ["doc_id", "node_id", "node_type", "text", "score", "source_text", "span", "justification"]


def _edge(kind: str, dst: Column) -> Column:
    return F.struct(F.lit(kind).alias("edge_type"), dst.alias("dst"))


def build_graph(docs: DataFrame) -> DataFrame:
    """Graph of every document from ``sections[].items`` (see extraction.with_items).

    Narrow: one pass over each document row. The thesis is the first claim with
    confidence over 0.7; evidence supports the last claim before it in its
    section; claims after the thesis support it; without a thesis the first
    sub-claim is promoted, which adds no edges."""
    flat = F.flatten(F.transform("sections", lambda s: F.transform(s["items"], lambda it, i: F.struct(
        s["section_no"].alias("sec"), i.alias("ino"), it.alias("it")))))
    numbered = docs.withColumn("_items", F.transform(flat, lambda x, i: x.withField("pos", i)))
    is_main = lambda x: (x["it"]["item_type"].isin("claim", "argument")) & (x["it"]["confidence"] > 0.7)
    claimish = lambda x: x["it"]["item_type"].isin("claim", "argument", "prediction", "commitment")
    thesis = F.get(F.filter("_items", is_main), F.lit(0))["pos"]
    promoted = F.get(F.filter("_items", claimish), F.lit(0))["pos"]
    ided = numbered.withColumn("_thesis", thesis).withColumn("_first", F.coalesce(thesis, promoted))
    iri = lambda x: F.concat(F.lit("arg:s"), x["sec"] - 1, F.lit("_"), x["ino"])
    kind = lambda x: (
        F.when(claimish(x), F.when(x["pos"] == F.col("_first"), "Thesis").otherwise("SubClaim"))
        .when(x["it"]["item_type"] == "statistic", "QuantifiedEvidence")
        .when(x["it"]["item_type"] == "citation", "Citation").otherwise("Evidence"))

    def out_edges(x):
        earlier = F.filter("_items", lambda y: claimish(y) & (y["sec"] == x["sec"]) & (y["pos"] < x["pos"]))
        last = F.get(F.reverse(earlier), F.lit(0))
        main = F.get(F.filter("_items", lambda y: y["pos"] == F.col("_thesis")), F.lit(0))
        to_claim = F.when(~claimish(x) & last.isNotNull(), _edge("Supports", iri(last)))
        to_thesis = F.when(claimish(x) & (F.col("_thesis") < x["pos"]), _edge("Supports", iri(main)))
        return F.array_compact(F.array(to_claim, to_thesis))

    def chain(x):
        earlier = F.filter("_items", lambda y: claimish(y) & (y["sec"] == x["sec"]) & (y["pos"] < x["pos"]))
        last = F.get(F.reverse(earlier), F.lit(0))["pos"]
        beyond = lambda p: F.coalesce((F.col("_thesis") < p).cast("int"), F.lit(0))
        return F.when(claimish(x), beyond(x["pos"])).otherwise(F.coalesce(1 + beyond(last), F.lit(0)) * last.isNotNull().cast("int"))

    none_score, none_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    section_nodes = F.transform("sections", lambda s: F.struct(
        s["section_no"].alias("section_no"), F.lit(-1).alias("item_no"),
        F.concat(F.lit("arg:section_"), s["section_no"] - 1).alias("node_id"), F.lit("Structural").alias("node_type"),
        s["title"].alias("text"), none_score.alias("score"), none_text.alias("source_text"),
        F.lit(None).cast(SPAN).alias("span"), none_text.alias("justification"), F.lit(False).alias("promoted"), F.lit(0).alias("chain"),
        F.transform(s["items"], lambda it, i: _edge(
            "Contains", F.concat(F.lit("arg:s"), s["section_no"] - 1, F.lit("_"), i))).alias("edges")))
    item_nodes = F.transform("_items", lambda x: F.struct(
        x["sec"].alias("section_no"), x["ino"].alias("item_no"), iri(x).alias("node_id"), kind(x).alias("node_type"),
        x["it"]["text"].alias("text"), none_score.alias("score"), x["it"]["text"].alias("source_text"),
        F.struct(x["it"]["start"].cast("int").alias("start"), x["it"]["end"].cast("int").alias("end")).cast(SPAN).alias("span"),
        none_text.alias("justification"),
        F.coalesce((x["pos"] == F.col("_first")) & F.col("_thesis").isNull(), F.lit(False)).alias("promoted"), chain(x).alias("chain"),
        out_edges(x).alias("edges")))
    return ided.select("doc_id", F.inline(F.concat(section_nodes, item_nodes)))


def graph_from_scores(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) straight from scored nodes (doc_id, pos, node_iri, score,
    justification, source_text, span), pos counted from 0. The first node is the
    thesis; all others support it and, from the third on, also their predecessor.

    First node and predecessor come by equi-joins, so no document is gathered."""
    low, pos = F.lower("justification"), F.col("pos")
    kind = (
        F.when(pos == 0, "Thesis")
        .when(T.contains_any(low, L.NODE_EVIDENCE_WORDS),
              F.when(T.contains_any(low, L.NODE_QUANTIFIED_WORDS), "QuantifiedEvidence")
              .when(T.contains_any(low, L.NODE_CITATION_WORDS), "Citation").otherwise("Evidence"))
        .when(F.contains(low, F.lit("counter")), "Counter")
        .when(T.contains_any(low, L.NODE_CLOSING_WORDS), "Structural").otherwise("SubClaim"))
    nodes = scored.select(
        "doc_id", F.col("node_iri").alias("node_id"), kind.alias("node_type"),
        F.coalesce("source_text", "justification").alias("text"),
        F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0)).alias("score"), "source_text",
        F.col("span").cast(SPAN).alias("span"), "justification")
    ids = scored.select("doc_id", "pos", F.col("node_iri").alias("src"))
    first = ids.where("pos = 0").select("doc_id", F.col("src").alias("dst"))
    to_thesis = ids.where("pos > 0").join(first, "doc_id").where("src <> dst")
    to_previous = ids.where("pos > 1").join(
        ids.select("doc_id", (pos + 1).alias("pos"), F.col("src").alias("dst")), ["doc_id", "pos"])
    edge = lambda df: df.select("doc_id", "src", F.lit("Supports").alias("edge_type"), "dst")
    return nodes, edge(to_thesis).unionByName(edge(to_previous))


def graph_from_triples(triples: DataFrame, scored: DataFrame | None = None,
                       prefix: str = "http://example.org/arg/") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from (doc_id, s, p, o) triples: typed subjects with optional
    text, and the six edge predicates. Scores attach by full or by short name."""
    short = lambda c: F.regexp_replace(c, "^" + re.escape(prefix), "arg:")
    local = F.regexp_replace("o", r"^.*[/:#]", "")
    typed = triples.where("p = 'type'").select("doc_id", "s", local.alias("node_type")).where(
        F.col("node_type").isin(NODE_TYPES))
    texts = triples.where("p = 'hasText'").select("doc_id", "s", F.col("o").alias("text"))
    nodes = typed.join(texts, ["doc_id", "s"], "left")
    nothing = F.lit(None)
    if scored is None:
        nodes = nodes.withColumns({"score": nothing.cast("double"), "source_text": nothing.cast("string"),
                                   "span": nothing.cast(SPAN), "justification": nothing.cast("string")})
    else:
        pick = scored.select("doc_id", short(F.col("node_iri")).alias("node_id"), F.struct(
            F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0)).alias("score"), "source_text",
            F.col("span").cast(SPAN).alias("span"), "justification").alias("x"))
        nodes = nodes.withColumn("node_id", short(F.col("s"))).join(pick, ["doc_id", "node_id"], "left").select(*nodes.columns, "x.*")
    nodes = nodes.withColumn("node_id", short(F.col("s"))).select(*NODE_COLS)
    kind = {k.lower(): k for k in SCORING_EDGES + ["Contains", "References"]}
    names = F.create_map(*[F.lit(x) for kv in kind.items() for x in kv])
    edges = triples.where(F.col("p").isin(list(kind))).select(
        "doc_id", short(F.col("s")).alias("src"), names[F.col("p")].alias("edge_type"), short(F.col("o")).alias("dst")).distinct()
    return nodes, edges


def node_rows(graph: DataFrame) -> DataFrame:
    return graph.select(*NODE_COLS)


def edge_rows(graph: DataFrame) -> DataFrame:
    return graph.select("doc_id", F.col("node_id").alias("src"), F.explode("edges").alias("e")).select(
        "doc_id", "src", "e.edge_type", "e.dst")


def add_section_items(graph: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds externally extracted claims and evidence to a built graph.

    given(doc_id, section_no, role, no, text, quantified, evidence_type). An entry
    is skipped when an earlier node of its document has the same text. Build order
    is section by section: section node, rule items, claims, evidence.
    Returns flat (nodes, edges)."""
    order = F.struct("section_no", "phase", "no")
    built = graph.select(
        "doc_id", "section_no", F.when(F.col("item_no") < 0, 0).otherwise(1).alias("phase"), F.col("item_no").alias("no"),
        "text", "node_id", F.when(F.col("promoted"), "SubClaim").otherwise(F.col("node_type")).alias("node_type"),
        F.lit(False).alias("added"), "score", "source_text", "span", "justification")
    claim = F.col("role") == "claim"
    new = given.select(
        "doc_id", "section_no", F.when(claim, 2).otherwise(3).alias("phase"), F.col("no"), "text",
        F.concat(F.lit("arg:s"), F.col("section_no") - 1, F.when(claim, "_c").otherwise("_e"), F.col("no")).alias("node_id"),
        F.when(claim, "SubClaim").when(F.col("quantified"), "QuantifiedEvidence")
        .when(F.col("evidence_type") == "citation", "Citation").otherwise("Evidence").alias("node_type"),
        F.lit(True).alias("added"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("source_text"),
        F.lit(None).cast(SPAN).alias("span"), F.lit(None).cast("string").alias("justification"))
    # used several times below; written, so that the documents are read for items once
    everything = settle(built.unionByName(new), "section-items")
    first = everything.groupBy("doc_id", "text").agg(F.min(order).alias("first"))
    kept = (
        everything.join(first, ["doc_id", "text"])
        .where(~F.col("added") | (order == F.col("first"))).drop("first"))
    is_claim = F.col("node_type").isin(CLAIM_TYPES)
    last_claim = F.last(F.when(is_claim, F.col("node_id")), ignorenulls=True).over(
        Window.partitionBy("doc_id", "section_no").orderBy("phase", "no").rowsBetween(Window.unboundedPreceding, -1))
    leads = kept.where(is_claim).groupBy("doc_id").agg(
        F.min(F.when(F.col("node_type") == "Thesis", F.struct(order.alias("at"), "node_id"))).alias("thesis"),
        F.min(F.struct(order.alias("at"), "node_id")).alias("claim"))
    placed = kept.withColumn("last_claim", last_claim).join(leads, "doc_id", "left")
    supports = placed.where("added").select(
        "doc_id", F.col("node_id").alias("src"), F.lit("Supports").alias("edge_type"),
        F.when(is_claim, F.when(F.col("thesis.at") < order, F.col("thesis.node_id")))
        .otherwise(F.col("last_claim")).alias("dst")).where("dst is not null")
    contains = placed.where("added").select(
        "doc_id", F.concat(F.lit("arg:section_"), F.col("section_no") - 1).alias("src"),
        F.lit("Contains").alias("edge_type"), F.col("node_id").alias("dst"))
    lead_id = F.coalesce("thesis.node_id", "claim.node_id")
    nodes = placed.withColumn(
        "node_type", F.when(is_claim & (F.col("node_id") == lead_id), "Thesis").otherwise(F.col("node_type"))).select(*NODE_COLS)
    return nodes, edge_rows(graph).unionByName(contains).unionByName(supports)


def type_counts(nodes: DataFrame) -> DataFrame:
    """Distinct nodes per document and type, one column per type."""
    return (
        nodes.groupBy("doc_id").pivot("node_type", NODE_TYPES).agg(F.countDistinct("node_id"))
        .fillna(0, subset=NODE_TYPES))


def keyed_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, a, b, kind, score, whole): nodes (b is null, kind the node type) and edges (from a to b) in one
    table, known by 64-bit hashes of document and id. ``whole``: none of the ids is null."""
    key = lambda c: F.xxhash64("doc_id", c)
    n = nodes.select(
        "doc_id", key("node_id").alias("a"), F.lit(None).cast("long").alias("b"), F.col("node_type").alias("kind"),
        F.col("score").cast("double").alias("score"), F.col("node_id").isNotNull().alias("whole"))
    return n.unionByName(edges.select(
        "doc_id", key("src").alias("a"), key("dst").alias("b"), F.col("edge_type").alias("kind"),
        F.lit(None).cast("double").alias("score"), (F.col("src").isNotNull() & F.col("dst").isNotNull()).alias("whole")))


def _marks_from_rows(rows: DataFrame) -> DataFrame:
    none_t, none_s = F.lit(None).cast("string"), F.lit(None).cast("double")
    kind, node, no, yes = F.col("kind"), F.col("b").isNull(), F.lit(0), F.lit(1)
    touched, supported = kind.isin(SCORING_EDGES).cast("int"), (kind == "Supports").cast("int")
    mark = lambda nid, t, s, e, touch, sup: F.struct(
        nid.alias("node_id"), t.alias("node_type"), s.alias("score"), no.alias("chain"), e.alias("edge_n"), touch.alias("touched"), sup.alias("supported"))
    first = F.when(node, mark(F.col("a"), kind, F.col("score"), no, no, no)).otherwise(mark(F.col("a"), none_t, none_s, yes, touched, no))
    second = F.when(~node, mark(F.col("b"), none_t, none_s, no, touched, supported))
    return rows.select("doc_id", F.inline(F.array_compact(F.array(first, second))))


def _marks_from_graph(graph: DataFrame) -> DataFrame:
    """As _marks_from_tables in one pass over the adjacency form."""
    none_t, none_s = F.lit(None).cast("string"), F.lit(None).cast("double")
    mark = lambda nid, t, s, ch, e, touch, sup: F.struct(
        nid.alias("node_id"), t.alias("node_type"), s.alias("score"), ch.alias("chain"), e.alias("edge_n"), touch.alias("touched"), sup.alias("supported"))
    zero, one = F.lit(0), F.lit(1)
    scoring = lambda e: e["edge_type"].isin(SCORING_EDGES).cast("int")
    rows = F.concat(
        F.array(mark(F.col("node_id"), F.col("node_type"), F.col("score"), F.col("chain"), zero, zero, zero)),
        F.transform("edges", lambda e: mark(F.col("node_id"), none_t, none_s, zero, one, scoring(e), zero)),
        F.transform("edges", lambda e: mark(
            e["dst"], none_t, none_s, zero, zero, scoring(e), (e["edge_type"] == "Supports").cast("int"))))
    return graph.select("doc_id", F.inline(rows))


def graph_metrics(nodes: DataFrame, edges: DataFrame | None = None, depth: DataFrame | None = None) -> DataFrame:
    """Counts, connectivity, coverage and quality per document.

    ``nodes`` alone may be the adjacency form of build_graph, which knows its
    chain lengths; flat tables take ``depth`` from support_depth. Nodes meet their edges in one
    aggregation per (document, node), partially combined before the shuffle."""
    if edges is not None:
        out = _doc_metrics(_marks_from_rows(keyed_rows(nodes, edges))).drop("max_depth")
        return out if depth is None else out.join(depth.select("doc_id", "max_depth"), "doc_id", "left").fillna(0, subset=["max_depth"])
    return _doc_metrics(_marks_from_graph(nodes))


def metrics_with_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_metrics with support_depth, from one table of nodes and edges that is written once."""
    rows = settle(keyed_rows(nodes, edges), "graph-rows")
    small, large = _by_size(rows)
    own = _doc_metrics(_marks_from_rows(_dealt(small)))
    if large is not None:
        own = own.unionByName(_doc_metrics(_marks_from_rows(large)))
    return own.drop("max_depth").join(_depth(small, large, True), "doc_id", "left").fillna(0, subset=["max_depth"])


def _doc_metrics(marks: DataFrame) -> DataFrame:
    t = F.col("node_type")
    per_node = marks.groupBy("doc_id", "node_id").agg(
        F.count("node_type").alias("n"),
        F.count(F.when(t.isin(CLAIM_TYPES), 1)).alias("claims"),
        F.count(F.when(t.isin(EVIDENCE_TYPES), 1)).alias("evidence"),
        F.count(F.when(t == "Structural", 1)).alias("structural"),
        F.count(F.when(t == "Counter", 1)).alias("counter"),
        F.count(F.when(t == "Rebuttal", 1)).alias("rebuttal"),
        F.sum("score").alias("score_sum"), F.count("score").alias("score_n"), F.max("chain").alias("chain"),
        F.sum("edge_n").alias("edge_n"), F.max("touched").alias("touched"), F.max("supported").alias("supported"))
    loose = F.col("n") - F.col("structural")
    doc = per_node.groupBy("doc_id").agg(
        F.sum("n").alias("node_count"), F.sum("edge_n").alias("edge_count"),
        F.sum("claims").alias("claim_count"), F.sum("evidence").alias("evidence_count"),
        F.sum(loose).alias("loose"), F.sum(loose * F.col("touched")).alias("connected"),
        F.sum(F.col("claims") * F.col("supported")).alias("covered"),
        (F.sum("counter") > 0).alias("has_counter"), (F.sum("rebuttal") > 0).alias("has_rebuttal"),
        F.sum("score_sum").alias("score_sum"), F.sum("score_n").alias("score_n"), F.max("chain").alias("max_depth"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return doc.select(
        "doc_id", "max_depth", "node_count", "edge_count", "claim_count", "evidence_count",
        ratio("connected", "loose").alias("connectivity"), ratio("covered", "claim_count").alias("evidence_coverage"),
        "has_counter", "has_rebuttal",
        F.when(F.col("score_n") > 0, F.col("score_sum") / F.col("score_n")).alias("quality"))


#: Documents of at most so many rows (nodes and edges) are worked on whole inside a task; larger ones go by joins.
GROUP = 1 << 14
#: Rows that a task sorts, and rows that are worked on at once.
TASK_ROWS, CHUNK = 1 << 20, 1 << 17


def _by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of documents of at most ``GROUP`` rows, and those of larger ones or of none (None: there are no such)."""
    big = rows.groupBy("doc_id").count().where((F.col("count") > GROUP) | F.col("doc_id").isNull()).select("doc_id")
    big = cut_lineage(big)
    if big.isEmpty():
        return rows, None
    known = big.where("doc_id is not null")
    large = rows.join(known, "doc_id", "left_semi").unionByName(rows.where("doc_id is null"))
    return rows.where("doc_id is not null").join(known, "doc_id", "left_anti"), large


def _dealt(rows: DataFrame) -> DataFrame:
    """Dealt by document to as many tasks as the rows need, so that no task grows with the input."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // TASK_ROWS + 1)
    return rows.repartition(parts, "doc_id")


def _in_documents(rows: DataFrame, solve, schema: str) -> DataFrame:
    """``solve`` over tables of whole documents, the rows of each together; bounded by ``CHUNK`` and ``GROUP``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def take(table):
            for b in solve(table).to_batches():
                yield b

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < CHUNK:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            code = _codes(t)
            cut = int(np.argmax(code == code[-1]))  # where the last document, which may go on, begins
            if cut:
                yield from take(t.slice(0, cut))
            held, size = t.slice(cut).to_batches(), t.num_rows - cut
        if size:
            yield from take(pa.Table.from_batches(held).combine_chunks())

    return rows.sortWithinPartitions("doc_id").mapInArrow(run, schema)


def _codes(t: pa.Table) -> np.ndarray:
    """The number of each row's document, by first appearance."""
    return t.column("doc_id").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _ids(t: pa.Table, code: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row numbers of the nodes, their ids; row numbers of the edges, the ids of both ends; the number of ids."""
    edge = t.column("b").is_valid().to_numpy()
    nodes, edges = np.flatnonzero(~edge), np.flatnonzero(edge)
    a, b = t.column("a").to_numpy(), t.column("b").fill_null(0).to_numpy()
    ids, names = pd.factorize(np.concatenate([a[nodes], a[edges], b[edges]]))
    ends = ids[len(nodes):]
    return nodes, ids[:len(nodes)], edges, ends[:len(edges)], ends[len(edges):], len(names)


def _peeled_depths(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest chain that ends in each of n nodes, and which nodes no peeling from the sources reaches."""
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    start = np.searchsorted(src, np.arange(n + 1))
    depth, waits = np.zeros(n, np.int64), np.bincount(dst, minlength=n)
    ready = np.flatnonzero(waits == 0)
    while len(ready):
        k = start[ready + 1] - start[ready]
        at = np.repeat(start[ready] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        to = dst[at]
        np.maximum.at(depth, to, np.repeat(depth[ready] + 1, k))
        np.subtract.at(waits, to, 1)
        ready = np.unique(to[waits[to] == 0])
    return depth, waits > 0


def _depth(small: DataFrame, large: DataFrame | None, known: bool) -> DataFrame:
    """(doc_id, max_depth) of keyed rows. ``known``: only edges between nodes of the table count."""

    def solve(t: pa.Table) -> pa.Table:
        code = _codes(t)
        nodes, node, edges, src, dst, n = _ids(t, code)
        if known:
            there = np.zeros(n, bool)
            there[node] = True
            own = there[src] & there[dst]
            edges, src, dst = edges[own], src[own], dst[own]
        docs = code[edges]
        best = np.full(code.max() + 1, -1, np.int64)
        best[docs] = 0
        edge = src != dst
        depth, stuck = _peeled_depths(n, src[edge], dst[edge])
        np.maximum.at(best, docs, depth[dst])
        best[docs[stuck[dst]]] = -2
        first = np.flatnonzero(np.diff(code, prepend=-1))
        first = first[best[code[first]] != -1]
        k = best[code[first]]
        return pa.table({"doc_id": t.column("doc_id").take(pa.array(first)), "max_depth": pa.array(k, pa.int64(), mask=k < 0)})

    usable = lambda r: r.where("whole AND (b IS NULL OR kind = 'Supports')").select("doc_id", "a", "b")
    kind = small.schema["doc_id"].dataType.simpleString()
    out = cut_lineage(_in_documents(usable(_dealt(small)), solve, f"doc_id {kind}, max_depth bigint"))
    cyclic = out.where("max_depth is null").select("doc_id")
    hard = [] if large is None else [usable(large)]
    if not cyclic.isEmpty():
        hard.append(usable(small).join(cyclic, "doc_id", "left_semi"))
    out = out.where("max_depth is not null")
    for rows in hard:
        e = rows.where("b is not null").select("doc_id", F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
        if known:
            n = rows.where("b is null").select("doc_id", "a").distinct()
            e = e.join(n.withColumnRenamed("a", "src"), ["doc_id", "src"], "left_semi").join(n.withColumnRenamed("a", "dst"), ["doc_id", "dst"], "left_semi")
        out = out.unionByName(_joined_depth(e))
    return out


def support_depth(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Longest chain of Supports edges per document: (doc_id, max_depth); with ``nodes`` of
    edges between known nodes only.

    Nodes on a common cycle count as one that is worth its size less one edge; the
    chain is the longest over these, so it is exact without cycles and never cut.

    Nodes and edges are dealt by document, once, and peeled from the sources on, in chunks of many whole documents.
    Documents of over ``GROUP`` rows, and those in which cycles are left, go by joins. Documents
    without Supports edges have no row."""
    e = edges.where("edge_type = 'Supports'")
    n = (edges.select("doc_id", F.col("src").alias("node_id")) if nodes is None else nodes.select("doc_id", "node_id")).withColumns(
        {"node_type": F.lit("Structural"), "score": F.lit(None).cast("double")})
    rows = keyed_rows(n, e)
    if nodes is None:  # an edge that lacks an end leads nowhere
        rows = rows.where("b is not null").withColumns({"a": F.when(F.col("whole"), F.col("a")).otherwise(0), "b": F.when(F.col("whole"), F.col("b")).otherwise(0), "whole": F.lit(True)})
    small, large = _by_size(settle(rows, "graph-rows"))
    return _depth(small, large, nodes is not None)


def _joined_depth(e: DataFrame) -> DataFrame:
    """As support_depth, for documents of any size, of distinct edges (doc_id, src, dst).

    Stretches of nodes with one edge in and one out are contracted to one weighted edge by
    list ranking, in rounds that grow with the logarithm of a stretch; what branches is peeled
    from its sources on, one round a level. Documents of which something is left
    hold cycles, and only those are condensed."""
    e = cut_lineage(e)
    docs = e.select("doc_id").distinct().withColumn("k", F.lit(0).cast("long"))
    e = e.where("src <> dst")
    short, cyclic = _contracted(e)
    depth, stuck = _peeled(short)
    core = cut_lineage(cyclic.unionByName(stuck).distinct())
    out = docs.unionByName(depth)
    if not core.isEmpty():
        out = out.join(core, "doc_id", "left_anti").unionByName(_condensed_depth(cut_lineage(e.join(core, "doc_id", "left_semi"))))
        out = out.unionByName(docs.join(core, "doc_id", "left_semi"))
    return out.groupBy("doc_id").agg(F.max("k").alias("max_depth"))


def _contracted(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (doc_id, src, dst, w) between the nodes that are not inside a stretch, w being the
    edges that a stretch had; and the documents with a cycle of such nodes alone."""
    ends = e.select("doc_id", F.inline(F.array(
        F.struct(F.col("src").alias("node"), F.lit(0).alias("n_in"), F.lit(1).alias("n_out"), F.col("dst").alias("to")),
        F.struct(F.col("dst").alias("node"), F.lit(1).alias("n_in"), F.lit(0).alias("n_out"), F.lit(None).alias("to")))))
    inner = cut_lineage(ends.groupBy("doc_id", "node").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), F.max("to").alias("to")).where(
        "n_in = 1 AND n_out = 1").select("doc_id", "node", "to"))
    # Where does a stretch lead, and over how many edges? A node asks the one it points at, in doubling steps.
    here = inner.select("doc_id", F.col("node").alias("to"), F.lit(True).alias("inside"))
    asked = cut_lineage(inner.join(here, ["doc_id", "to"], "left").select("doc_id", "node", "to", F.lit(1).cast("long").alias("w"), F.col("inside").isNull().alias("done")))
    known, left, rounds = [asked.where("done")], asked.where("NOT done"), asked.count().bit_length() + 1
    for _ in range(rounds):
        if left.isEmpty():
            break
        answers = reduce(DataFrame.unionByName, known).unionByName(left).select(
            "doc_id", F.col("node").alias("to"), F.col("to").alias("next"), F.col("w").alias("more"), F.col("done").alias("ends"))
        step = cut_lineage(left.drop("done").join(answers, ["doc_id", "to"]).select("doc_id", "node", F.col("next").alias("to"), (F.col("w") + F.col("more")).alias("w"), F.col("ends").alias("done")))
        known, left = [*known, step.where("done")], step.where("NOT done")
    led = reduce(DataFrame.unionByName, known).select("doc_id", F.col("node").alias("dst"), F.col("to").alias("end"), F.col("w").alias("more"))
    entries = e.join(inner.select("doc_id", F.col("node").alias("src")), ["doc_id", "src"], "left_anti")
    short = entries.join(led, ["doc_id", "dst"], "left").select(
        "doc_id", "src", F.coalesce("end", "dst").alias("dst"), (F.coalesce("more", F.lit(0)) + 1).alias("w"))
    return cut_lineage(short.groupBy("doc_id", "src", "dst").agg(F.max("w").alias("w"))), left.select("doc_id").distinct()


def _peeled(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k): the longest weighted chain that sources begin, and the documents that
    are left with nodes no source leads to."""
    sides = e.select("doc_id", F.inline(F.array(
        F.struct(F.col("src").alias("node"), F.lit(0).alias("waits")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("waits")))))
    state = cut_lineage(sides.groupBy("doc_id", "node").agg(F.sum("waits").alias("waits")).withColumn("v", F.lit(0).cast("long")))
    best = []
    while True:
        ready, state = state.where("waits = 0"), state.where("waits > 0")
        if ready.isEmpty():
            break
        best.append(ready.groupBy("doc_id").agg(F.max("v").alias("k")))
        given = e.join(ready.select("doc_id", F.col("node").alias("src"), "v"), ["doc_id", "src"]).groupBy("doc_id", F.col("dst").alias("node")).agg(
            F.max(F.col("v") + F.col("w")).alias("new"), F.count("*").alias("n"))
        state = cut_lineage(state.join(given, ["doc_id", "node"], "left").select(
            "doc_id", "node", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"), F.greatest("v", F.coalesce("new", F.lit(0))).alias("v")))
    none = e.select("doc_id", F.lit(0).cast("long").alias("k")).limit(0)
    return reduce(DataFrame.unionByName, best, none), state.select("doc_id").distinct()


def _settle(values: DataFrame, edges: DataFrame, passed, better) -> DataFrame:
    """values(doc_id, node, v): pass v along edges(doc_id, src, dst) until none gets
    better; only nodes that changed pass theirs on."""
    values = cut_lineage(values)
    fresh = values
    while True:
        offers = fresh.withColumnRenamed("node", "src").join(edges, ["doc_id", "src"]).groupBy("doc_id", F.col("dst").alias("node")).agg(better(passed(F.col("v"))).alias("w"))
        fresh = cut_lineage(offers.join(values, ["doc_id", "node"]).where(better(F.array("w", "v"), True) != F.col("v")).select("doc_id", "node", F.col("w").alias("v")))
        if fresh.isEmpty():
            return values
        values = cut_lineage(values.join(fresh.withColumnRenamed("v", "w"), ["doc_id", "node"], "left").select("doc_id", "node", F.coalesce("w", "v").alias("v")))


def _lesser(c, array=False):
    return F.array_min(c) if array else F.min(c)


def _greater(c, array=False):
    return F.array_max(c) if array else F.max(c)


def _components(e: DataFrame) -> DataFrame:
    """(doc_id, node, scc): strongly connected components. Each round colours nodes by
    the least node that reaches them and takes what reaches that node back within its
    colour; at least one component per colour is found and taken out."""
    left = e.select("doc_id", F.col("src").alias("node")).union(e.select("doc_id", "dst")).distinct()
    done = None
    while True:
        left = cut_lineage(left)
        if left.isEmpty():
            return done
        has = lambda c: left.withColumnRenamed("node", c)  # noqa: B023,E731
        own = cut_lineage(e.join(has("src"), ["doc_id", "src"], "left_semi").join(has("dst"), ["doc_id", "dst"], "left_semi"))
        colour = _settle(left.withColumn("v", F.col("node")), own, lambda v: v, _lesser)
        paint = lambda c, n: colour.select("doc_id", F.col("node").alias(c), F.col("v").alias(n))  # noqa: B023,E731
        back = own.join(paint("src", "x"), ["doc_id", "src"]).join(paint("dst", "y"), ["doc_id", "dst"]).where("x = y").select("doc_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
        flag = _settle(colour.select("doc_id", "node", (F.col("node") == F.col("v")).cast("int").alias("v")), cut_lineage(back), lambda v: v, _greater)
        found = flag.where("v = 1").join(colour.withColumnRenamed("v", "scc"), ["doc_id", "node"]).select("doc_id", "node", "scc")
        done = found if done is None else done.unionByName(found)
        left = left.join(found, ["doc_id", "node"], "left_anti")


def _condensed_depth(e: DataFrame) -> DataFrame:
    scc = cut_lineage(_components(e))
    name = lambda c, n: scc.select("doc_id", F.col("node").alias(c), F.col("scc").alias(n))
    between = e.join(name("src", "a"), ["doc_id", "src"]).join(name("dst", "b"), ["doc_id", "dst"]).where("a <> b")
    size = scc.groupBy("doc_id", F.col("scc").alias("node")).agg((F.count("*") - 1).alias("v"))
    weighted = between.select("doc_id", F.col("a").alias("src"), F.col("b").alias("dst")).distinct().join(
        size.withColumnRenamed("node", "dst").withColumnRenamed("v", "worth"), ["doc_id", "dst"])
    # A chain to a component is one edge longer and gains what the component is worth.
    longest = _settle(size, cut_lineage(weighted), lambda v: v + 1 + F.col("worth"), _greater)
    return longest.groupBy("doc_id").agg(F.max("v").alias("k"))


STRUCTURAL_WEIGHTS = {  # fixed values
    "density": 0.25, "ev_ratio": 0.20, "connectivity": 0.20, "coverage": 0.15, "depth": 0.10, "counter": 0.10,
}


def structural_features() -> dict[str, Column]:
    n = F.col("node_count")
    both = F.col("has_counter").cast("int") + F.col("has_rebuttal").cast("int")
    return {
        "density": F.least(F.log(n + 1.0) / F.log(F.lit(12.0)), F.lit(1.0)),
        "ev_ratio": F.when(n > 0, F.col("evidence_count") / n).otherwise(0.0),
        "connectivity": F.col("connectivity"),
        "coverage": F.col("evidence_coverage"),
        "depth": F.least(F.col("max_depth") / 4.0, F.lit(1.0)),
        "counter": both / 2.0,
    }


def structural_score(weights: dict | None = None) -> Column:
    """Score 0..1 from the columns of graph_metrics (with depth)."""
    w = {**STRUCTURAL_WEIGHTS, **(weights or {})}
    f = structural_features()
    total = sum((f[k] * w[k] for k in STRUCTURAL_WEIGHTS), F.lit(0.0))
    return F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20,
             cut_every: int = 5) -> DataFrame:
    """Per-document PageRank over Supports, Warrants and Rebuts edges (parallel
    edges count twice, dangling mass is spread evenly), divided by the maximum of
    the document and floored at 1/(10 n): (doc_id, node_id, rank).

    Nodes and edges are dealt by document, once, and all rounds run on chunks of many whole
    documents; documents of over ``GROUP`` rows go by joins."""
    n = nodes.select("doc_id", "node_id", F.lit(None).cast("string").alias("node_type"), F.lit(None).cast("double").alias("score"))
    name = n.select("doc_id", F.xxhash64("doc_id", "node_id").alias("a"), F.lit(None).cast("long").alias("b"), "node_id")
    e = keyed_rows(n, edges.where(F.col("edge_type").isin(RANK_EDGES))).where("b is not null AND whole")
    rows = settle(name.unionByName(e.select("doc_id", "a", "b", F.lit(None).cast("string").alias("node_id"))), "rank-rows")
    small, large = _by_size(rows)

    def solve(t: pa.Table) -> pa.Table:
        code = _codes(t)
        at, node, _, src, dst, n = _ids(t, code)
        node, first = np.unique(node, return_index=True)
        at = at[first]
        doc = np.full(n, -1, np.int64)
        doc[node] = code[at]
        own = (doc[src] >= 0) & (doc[dst] >= 0)
        src, dst = src[own], dst[own]
        docs, out, mine = code.max() + 1, np.bincount(src, minlength=n), doc[node]
        size = np.bincount(mine, minlength=docs).astype(float)
        r = np.zeros(n)
        r[node] = 1.0 / size[mine]
        last = node[out[node] == 0]
        for _ in range(iterations):
            lost = np.bincount(doc[last], r[last], docs)
            got = np.bincount(dst, r[src] / out[src], n)
            r[node] = ((1 - damping) + damping * lost[mine]) / size[mine] + damping * got[node]
        top = np.zeros(docs)
        np.maximum.at(top, mine, r[node])
        take = lambda c: t.column(c).take(pa.array(at))
        return pa.table({"doc_id": take("doc_id"), "node_id": take("node_id"), "rank": np.maximum(r[node] / top[mine], 1.0 / (10.0 * size[mine]))})

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = _in_documents(_dealt(small), solve, f"doc_id {kind}, node_id string, rank double")
    if large is None:
        return out
    names = large.where("b is null").select("doc_id", "a", "node_id").distinct()
    by_joins = _joined_pagerank(
        names.select("doc_id", F.col("a").alias("node_id")), large.where("b is not null").select("doc_id", F.col("a").alias("src"), F.col("b").alias("dst")),
        damping, iterations, cut_every)
    return out.unionByName(by_joins.withColumnRenamed("node_id", "a").join(names, ["doc_id", "a"]).select("doc_id", "node_id", "rank"))


def _joined_pagerank(nodes: DataFrame, edges: DataFrame, damping: float, iterations: int, cut_every: int) -> DataFrame:
    """As pagerank, for documents of any size, over edges (doc_id, src, dst) that all count.

    Rounds only carry u_j, the mass that j steps from everywhere bring to a node: teleports
    and dangling mass are the same for all nodes of a document, so the rank is
    r_k = (sum over j < k of d^j c_(k-j) u_j + d^k u_k) / n with a few numbers c for each document,
    which follow from the dangling nodes' u_j in one aggregation at the end. The edges are
    shuffled by source once and read again by every round, whose only shuffle is
    that of partial sums of contributions; nodes that no walk of that length ends in drop out."""
    ids = cut_lineage(nodes.select("doc_id", "node_id").distinct())
    e = edges.join(ids.withColumnRenamed("node_id", "dst"), ["doc_id", "dst"], "left_semi").join(
        ids.withColumnRenamed("node_id", "src"), ["doc_id", "src"], "left_semi")
    out_deg = e.groupBy("doc_id", "src").agg(F.count("*").alias("out"))
    e = cut_lineage(e.join(out_deg, ["doc_id", "src"]).select("doc_id", "src", "dst", (1.0 / F.col("out")).alias("share")))
    by_src = e.repartition("doc_id", "src")
    steps = []
    u = None
    for j in range(1, iterations + 1):
        given = by_src.select("doc_id", "dst", F.col("share").alias("g")) if u is None else by_src.join(
            u.withColumnRenamed("node_id", "src"), ["doc_id", "src"]).select("doc_id", "dst", (F.col("share") * F.col("u")).alias("g"))
        u = given.groupBy("doc_id", F.col("dst").alias("node_id")).agg(F.sum("g").alias("u"))
        if j % cut_every == 0 and j < iterations:
            u = cut_lineage(u)
            if u.isEmpty():
                break
        steps.append(u.withColumn("j", F.lit(j)))
    none = lambda df: df.withColumns({"u": F.lit(None).cast("double"), "j": F.lit(None).cast("int")})
    all_steps = reduce(DataFrame.unionByName, steps)
    marks = none(ids).withColumns({"known": F.lit(True), "leaves": F.lit(False)}).unionByName(
        none(e.select("doc_id", F.col("src").alias("node_id")).distinct()).withColumns({"known": F.lit(False), "leaves": F.lit(True)})).unionByName(
        all_steps.withColumns({"known": F.lit(False), "leaves": F.lit(False)}))
    at = [F.lit(1.0), *[F.coalesce(F.sum(F.when(F.col("j") == j, F.col("u"))), F.lit(0.0)) for j in range(1, iterations + 1)]]
    wide = cut_lineage(marks.groupBy("doc_id", "node_id").agg(F.max("leaves").alias("leaves"), F.array(*at).alias("u")))
    sizes = wide.groupBy("doc_id").agg(
        F.count("*").cast("double").alias("n"), F.array(*[F.sum(F.when(~F.col("leaves"), F.col("u")[j]).otherwise(0.0)) for j in range(iterations + 1)]).alias("lost"))
    d, k = damping, iterations
    constants = F.expr(f"""aggregate(sequence(1, {k}), cast(array() as array<double>), (c, i) -> concat(c, array(
        1 - {d} + {d} / n * (aggregate(if(i < 2, array(), sequence(0, i - 2)), 0D, (s, j) -> s + pow({d}, j) * c[i - 2 - j] * lost[j]) + pow({d}, i - 1) * lost[i - 1]))))""")
    rank = F.expr(f"(aggregate(sequence(0, {k - 1}), 0D, (s, j) -> s + pow({d}, j) * c[{k - 1} - j] * u[j]) + pow({d}, {k}) * u[{k}]) / n")
    ranked = wide.join(sizes.select("doc_id", "n", constants.alias("c")), "doc_id").select("doc_id", "node_id", "n", rank.alias("r"))
    top = ranked.groupBy("doc_id").agg(F.max("r").alias("top"))
    floor = 1.0 / (F.col("n") * 10.0)
    return ranked.join(top, "doc_id").select(
        "doc_id", "node_id",
        F.greatest(F.when(F.col("top") > 0, F.col("r") / F.col("top")).otherwise(floor), floor).alias("rank"))


#: Quotes that meet a text at once are at most 2^8; characters of a piece of text in which covered spans are joined.
QUOTE_BITS = 8
PIECE = 4096


def _quotes_in_texts(quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, quotes: array of at most 2^QUOTE_BITS of the rows' structs ``q``, doc_text).

    A text is copied to blocks of quotes, not to each of them, and a document with any
    number of quotes is many blocks. Blocks follow the order by document and node in a task."""
    blocks = quotes.sortWithinPartitions("doc_id", "q.node_id").withColumn("_block", F.shiftright(F.monotonically_increasing_id(), QUOTE_BITS))
    blocks = blocks.groupBy("doc_id", "_block").agg(F.collect_list("q").alias("quotes"))
    return blocks.join(documents.select("doc_id", F.col("text").alias("doc_text")), "doc_id")


def verify_spans(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Checks node quotes against their document and measures the covered share.

    Covered characters are the union of all found spans: gaps and islands by start inside
    pieces of ``PIECE`` characters, at whose borders spans are cut, so that spans of one
    document are joined by many tasks."""
    quotes = nodes.select("doc_id", F.struct("node_id", "source_text", F.col("span.start").alias("start"), F.col("span.end").alias("end")).alias("q"))

    def check(q):
        src, start, end = q["source_text"], q["start"], q["end"]
        at_span = F.coalesce((end <= F.length("doc_text")) & (F.substr(F.col("doc_text"), start + 1, end - start) == src), F.lit(False))
        found = F.position(src, F.col("doc_text")) - 1
        return F.struct(src.isNotNull().alias("has_source"), F.when(at_span, start).when(found >= 0, found).alias("a"), F.length(src).alias("len"))

    checked = _quotes_in_texts(quotes, documents).select("doc_id", F.length("doc_text").alias("doc_len"), F.inline(F.transform("quotes", check)))
    checked = checked.withColumn("ok", F.coalesce(F.col("has_source") & F.col("a").isNotNull(), F.lit(False)))
    counts = checked.groupBy("doc_id").agg(
        F.count("*").alias("total_nodes"), F.count_if("has_source").alias("nodes_with_source"),
        F.count_if("ok").alias("verified_count"), F.count_if(F.col("has_source") & ~F.col("ok")).alias("failed_count"),
        F.max("doc_len").alias("doc_len"))
    spans = checked.where(F.col("ok") & (F.col("len") > 0)).select("doc_id", F.col("a").cast("long").alias("a"), (F.col("a") + F.col("len")).cast("long").alias("b")).distinct()
    spans = spans.select("doc_id", "a", "b", F.explode(F.expr(f"sequence(a div {PIECE}, (b - 1) div {PIECE})")).alias("piece")).select(
        "doc_id", "piece", F.greatest("a", F.col("piece") * PIECE).alias("a"), F.least("b", (F.col("piece") + 1) * PIECE).alias("b")).distinct()
    w = Window.partitionBy("doc_id", "piece").orderBy("a", "b")
    before = F.coalesce(F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = spans.withColumn("new", F.greatest(F.col("b") - F.greatest("a", before), F.lit(0))).groupBy("doc_id").agg(
        F.sum("new").alias("covered"))
    return counts.join(covered, "doc_id", "left").select(
        "doc_id", "total_nodes", "nodes_with_source", "verified_count", "failed_count",
        F.when(F.col("doc_len") > 0, F.coalesce("covered", F.lit(0)) / F.col("doc_len")).otherwise(0.0).alias("coverage"))


def node_consensus(node_scores: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, node_id, agent_id, score) -> mean, population deviation and an
    uncertainty flag per node. An agent scoring a node twice counts once (first)."""
    one = node_scores.groupBy("doc_id", "node_id", "agent_id").agg(F.min_by("score", "seq").alias("score"))
    std = F.when(F.count("*") < 2, 0.0).otherwise(F.stddev_pop("score"))
    return one.groupBy("doc_id", "node_id").agg(
        F.count("*").alias("agents"), F.avg("score").alias("mean"), std.alias("std_dev"),
        (std > threshold).alias("uncertain"))


def consensus_summary(consensus: DataFrame) -> DataFrame:
    return consensus.groupBy("doc_id").agg(
        F.count_if("uncertain").alias("uncertain_count"), F.avg("std_dev").alias("mean_divergence"))


def completeness(nodes: DataFrame, documents: DataFrame, threshold: float) -> DataFrame:
    """Share of a document's sentences matched by a node quote: substring either
    way, or word Jaccard at or above the threshold."""
    quotes = nodes.where("source_text is not null").groupBy("doc_id").agg(
        F.collect_set("source_text").alias("quotes"))
    q = documents.select("doc_id", T.sentences_dot(F.col("text"), 15).alias("sents")).join(quotes, "doc_id", "left")
    q = q.withColumn("qs", F.transform(
        F.coalesce("quotes", F.array().cast("array<string>")), lambda x: F.struct(x.alias("t"), F.array_distinct(T.words(x)).alias("w"))))

    def hit(s):
        def near(n):
            union = F.size(F.array_union(s["w"], n["w"]))
            return F.coalesce(F.size(F.array_intersect(s["w"], n["w"])) / F.nullif(union, F.lit(0)) >= threshold, F.lit(False))
        return F.exists("qs", lambda n: F.contains(s["t"], n["t"]) | F.contains(n["t"], s["t"])) | F.exists("qs", near)

    tokens = F.transform("sents", lambda s: F.struct(s.alias("t"), F.array_distinct(T.words(s)).alias("w")))
    q = q.withColumn("missing", F.transform(F.filter(tokens, lambda s: ~hit(s)), lambda s: s["t"]))
    total = F.size("sents")
    covered = total - F.size("missing")
    return q.select(
        "doc_id", total.cast("bigint").alias("total_sentences"), covered.cast("bigint").alias("covered_sentences"),
        F.when(total == 0, 100.0).otherwise(covered / total * 100.0).alias("coverage_pct"),
        F.col("missing").alias("uncovered_sentences"))


def quote_check(nodes: DataFrame, documents: DataFrame, examples: int = 5) -> DataFrame:
    """Share of non-structural nodes whose quote occurs in the document: verbatim,
    or with white space collapsed and case ignored, or by its first 30 characters."""
    squash = T.squashed
    quotes = nodes.where("node_type <> 'Structural'").select(
        "doc_id", F.struct("node_id", "node_type", F.coalesce("source_text", F.lit("")).alias("q")).alias("q"))

    def check(x):
        return T.let(squash(x["q"]), lambda qn: F.struct(
            x["node_id"].alias("node_id"), x["node_type"].alias("node_type"), x["q"].alias("q"),
            ((x["q"] != "") & (F.contains("doc_text", x["q"]) | F.contains("doc_norm", qn)
                               | ((F.octet_length(qn) > 30) & F.contains("doc_norm", F.substring(qn, 1, 30))))).alias("found")))

    checked = _quotes_in_texts(quotes, documents).withColumn("doc_norm", squash(F.col("doc_text"))).select("doc_id", F.inline(F.transform("quotes", check)))
    failing = F.when(~F.col("found") & (F.col("q") != ""), F.struct(
        F.col("node_id"), F.concat(F.lit("["), "node_type", F.lit("] "), F.substring("q", 1, 60)).alias("quote")))
    # used twice below; written, so that the texts are read once
    checked = settle(checked.select("doc_id", "node_id", "found", failing.alias("f")), "quote-checks")
    # the first few failures by node id: a bounded minimum kept per document
    ranked = checked.where("f is not null").select("doc_id", "node_id", "f").withColumn(
        "rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("node_id"))).where(F.col("rn") <= examples)
    shown = ranked.groupBy("doc_id").agg(F.array_sort(F.collect_list("f")).alias("f")).select(
        "doc_id", F.transform("f", lambda x: x["quote"]).alias("failures"))
    out = checked.groupBy("doc_id").agg(
        F.count_if("found").alias("verified"), F.count_if(~F.col("found")).alias("unverified"))
    return out.join(shown, "doc_id", "left").select(
        "doc_id", "verified", "unverified", (F.col("verified") / (F.col("verified") + F.col("unverified"))).alias("rate"),
        F.coalesce("failures", F.array().cast("array<string>")).alias("failures"))


def topology_score(counts: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Score from type counts alone, scaled by the quote verification rate."""
    c = {t: F.col(t) for t in NODE_TYPES}
    total = sum((c[t] for t in NODE_TYPES), F.lit(0))
    ev, claims = c["Evidence"] + c["QuantifiedEvidence"] + c["Citation"], c["Thesis"] + c["SubClaim"]
    one = F.lit(1)
    ratio = ev / F.greatest(claims, one)
    raw = (
        0.20 * F.least(total / 10.0, F.lit(1.0)) + 0.25 * F.least(ratio / 2.0, F.lit(1.0))
        + 0.15 * (c["Counter"] > 0).cast("int") + 0.10 * (c["Rebuttal"] > 0).cast("int")
        + 0.15 * (c["QuantifiedEvidence"] / F.greatest(ev, one)) + 0.10 * (c["Citation"] / F.greatest(ev, one))
        + 0.05 * (c["Counter"] / F.greatest(claims, one)))
    base = counts if rates is None else counts.join(rates.select("doc_id", "rate"), "doc_id", "left")
    rate = F.lit(1.0) if rates is None else F.coalesce("rate", F.lit(0.0))
    return base.select(
        "doc_id", total.cast("bigint").alias("node_count"), ev.cast("bigint").alias("evidence_count"),
        claims.cast("bigint").alias("claim_count"), raw.alias("raw_score"), (raw * rate).alias("topology_score"))


def framework_from_topology(counts: DataFrame) -> DataFrame:
    c = {t: F.col(t) for t in NODE_TYPES}
    total = sum((c[t] for t in NODE_TYPES), F.lit(0))
    ev, claims = c["Evidence"] + c["QuantifiedEvidence"] + c["Citation"], c["Thesis"] + c["SubClaim"]
    n, k = F.greatest(total, F.lit(1)), F.greatest(claims, F.lit(1))
    quant, cite = c["QuantifiedEvidence"] / n, c["Citation"] / n
    pick = (
        F.when((quant > 0.2) & (cite > 0.05), "technical_documentation")
        .when(((c["Counter"] + c["Rebuttal"]) / k > 0.15) & (claims > 5), "policy_greenbook")
        .when(cite > 0.1, "nhs_clinical_governance")
        .when((ev / k < 0.5) & (total < 10), "generic_quality")
        .when((ev > claims) & (c["QuantifiedEvidence"] == 0) & (c["Citation"] == 0), "academic_essay")
        .otherwise("generic_quality"))
    return counts.select("doc_id", pick.alias("framework_id"))


def audit_trail(nodes: DataFrame) -> DataFrame:
    return nodes.select("doc_id", "node_id", "node_type", F.coalesce("source_text", "text").alias("quote"))
