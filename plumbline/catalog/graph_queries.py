"""Queries over argument graphs (G), mined facts (M) and gates (T)."""

from pyspark.sql import Window, functions as F

from plumbline.catalog.base import (
    CTE, any_of, big, clip, jac, marked_documents, q, r6, register, run_sql, section_documents, sents_dot, table, trim, words)
from plumbline.catalog import text_queries as TQ
from plumbline.functions import lexicons as L, text as T
from plumbline.operators import extraction, gate, graph, rules, sections
from plumbline.plans.document_gate import document_gate, document_graph

# --- a graph per customer: orders and lineitems argue for it ---------------------
CTE["h_nodes"] = """
  SELECT c_custkey AS doc_id, 'c' || c_custkey AS node_id, 'Thesis' AS node_type, c_name AS text, CAST(NULL AS DOUBLE) AS score FROM customer
  UNION ALL SELECT o_custkey, 'o' || o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'Structural' ELSE 'SubClaim' END, o_orderpriority, NULL FROM orders
  UNION ALL SELECT o_custkey, 'l' || l_orderkey || '_' || l_linenumber,
    CASE WHEN l_linenumber = 7 THEN 'Counter' WHEN l_linenumber = 6 THEN 'Rebuttal' WHEN min(l_returnflag) = 'R' THEN 'QuantifiedEvidence'
         WHEN min(l_returnflag) = 'A' THEN 'Citation' ELSE 'Evidence' END, min(l_linestatus), min(l_quantity) / 50
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey, l_orderkey, l_linenumber"""
CTE["h_edges"] = """
  SELECT o_custkey AS doc_id, 'o' || o_orderkey AS src, 'Supports' AS edge_type, 'c' || o_custkey AS dst FROM orders
  UNION ALL SELECT o_custkey, 'c' || o_custkey, 'Contains', 'o' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT o_custkey, 'l' || l_orderkey || '_' || l_linenumber,
    CASE WHEN l_linenumber = 7 THEN 'Counters' WHEN l_linenumber = 6 THEN 'Rebuts' ELSE 'Supports' END,
    CASE WHEN l_linenumber = 7 THEN 'c' || o_custkey WHEN l_linenumber = 6 THEN 'l' || l_orderkey || '_7'
         WHEN l_linenumber = 1 THEN 'o' || l_orderkey ELSE 'l' || l_orderkey || '_' || (l_linenumber - 1) END
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT DISTINCT o_custkey, 'l' || l_orderkey || '_' || l_linenumber, 'Supports', 'o' || l_orderkey
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber IN (2, 4)"""


def _h(s, d):
    n = run_sql(s, d, "h_nodes").withColumns({
        "source_text": F.lit(None).cast("string"), "span": F.lit(None).cast(graph.SPAN), "justification": F.lit(None).cast("string")})
    return n, run_sql(s, d, "h_edges")


def metrics_sql(nodes, edges, depth=None):
    ev, cl = "node_type IN ('Evidence', 'QuantifiedEvidence', 'Citation')", "node_type IN ('Thesis', 'SubClaim')"
    scoring = "edge_type IN ('Supports', 'Warrants', 'Counters', 'Rebuts')"
    return f"""
  SELECT n.doc_id, node_count, coalesce(edge_count, 0) AS edge_count, claim_count, evidence_count,
         CASE WHEN loose > 0 THEN connected * 1.0 / loose ELSE 0.0 END AS connectivity,
         CASE WHEN claim_count > 0 THEN covered * 1.0 / claim_count ELSE 0.0 END AS evidence_coverage, has_counter, has_rebuttal, quality
         {", coalesce(dp.k, 0) AS max_depth" if depth else ""}
  FROM (SELECT n.doc_id, count(*) AS node_count, count(*) FILTER ({cl}) AS claim_count, count(*) FILTER ({ev}) AS evidence_count,
               count(*) FILTER (node_type <> 'Structural') AS loose, count(*) FILTER (node_type <> 'Structural' AND t.node_id IS NOT NULL) AS connected,
               count(*) FILTER ({cl} AND s.node_id IS NOT NULL) AS covered, bool_or(node_type = 'Counter') AS has_counter,
               bool_or(node_type = 'Rebuttal') AS has_rebuttal, avg(score) AS quality
        FROM {nodes} n
        LEFT JOIN (SELECT doc_id, src AS node_id FROM {edges} WHERE {scoring} UNION SELECT doc_id, dst FROM {edges} WHERE {scoring}) t
          ON t.doc_id = n.doc_id AND t.node_id = n.node_id
        LEFT JOIN (SELECT DISTINCT doc_id, dst AS node_id FROM {edges} WHERE edge_type = 'Supports') s ON s.doc_id = n.doc_id AND s.node_id = n.node_id
        GROUP BY n.doc_id) n
  LEFT JOIN (SELECT doc_id, count(*) AS edge_count FROM {edges} GROUP BY doc_id) e ON e.doc_id = n.doc_id
  {f"LEFT JOIN {depth} dp ON dp.doc_id = n.doc_id" if depth else ""}"""


def depth_ctes(prefix, nodes, edges):
    CTE[f"{prefix}_sup"] = f"""SELECT DISTINCT e.doc_id, e.src, e.dst FROM {edges} e JOIN {nodes} a ON a.doc_id = e.doc_id AND a.node_id = e.src
      JOIN {nodes} b ON b.doc_id = e.doc_id AND b.node_id = e.dst WHERE edge_type = 'Supports'"""
    CTE[f"{prefix}_walk"] = f"""SELECT DISTINCT doc_id, dst AS node_id, 1 AS k FROM {prefix}_sup
      UNION SELECT e.doc_id, e.dst, w.k + 1 FROM {prefix}_walk w JOIN {prefix}_sup e ON e.doc_id = w.doc_id AND e.src = w.node_id"""
    CTE[f"{prefix}_depth"] = f"SELECT doc_id, max(k) AS k FROM {prefix}_walk GROUP BY doc_id"


STRUCT = ("(0.25 * least(ln(node_count + 1) / ln(12), 1) + 0.20 * (CASE WHEN node_count > 0 THEN evidence_count * 1.0 / node_count ELSE 0 END) "
          "+ 0.20 * connectivity + 0.15 * evidence_coverage + 0.10 * least(max_depth / 4.0, 1) "
          "+ 0.10 * (CAST(has_counter AS INT) + CAST(has_rebuttal AS INT)) / 2.0)")

# --- graphs built from documents: sections, and single section ------------------
def graph_ctes(p, items, secs, source):
    """items(doc_id, section_no, item_no, item_type, text, start, confidence), secs(doc_id, section_no, title)"""
    CTE[f"{p}_pos"] = f"""
      SELECT *, min(pos) FILTER (item_type = 'claim' AND confidence > 0.7) OVER (PARTITION BY doc_id) AS thesis,
             min(pos) FILTER (claimish) OVER (PARTITION BY doc_id) AS first_claim,
             last_value(CASE WHEN claimish THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id, section_no ORDER BY pos
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_claim
      FROM (SELECT *, 'arg:s' || (section_no - 1) || '_' || item_no AS iri, item_type IN ('claim', 'prediction', 'commitment') AS claimish,
                   row_number() OVER (PARTITION BY doc_id ORDER BY section_no, item_no) AS pos FROM {items})"""
    CTE[f"{p}_nodes"] = f"""
      SELECT doc_id, section_no, -1 AS item_no, 'arg:section_' || (section_no - 1) AS node_id, 'Structural' AS node_type, title AS text,
             CAST(NULL AS VARCHAR) AS source_text, CAST(NULL AS BIGINT) AS start, CAST(NULL AS DOUBLE) AS score, false AS promoted FROM {secs}
      UNION ALL SELECT doc_id, section_no, item_no, iri, CASE WHEN claimish THEN CASE WHEN pos = coalesce(thesis, first_claim) THEN 'Thesis' ELSE 'SubClaim' END
             WHEN item_type = 'statistic' THEN 'QuantifiedEvidence' ELSE 'Citation' END, text, text, start, NULL,
             thesis IS NULL AND pos = first_claim FROM {p}_pos"""
    CTE[f"{p}_edges"] = f"""
      SELECT doc_id, 'arg:section_' || (section_no - 1) AS src, 'Contains' AS edge_type, iri AS dst FROM {p}_pos
      UNION ALL SELECT a.doc_id, a.iri, 'Supports', b.iri FROM {p}_pos a JOIN {p}_pos b ON a.doc_id = b.doc_id AND b.pos = a.last_claim WHERE NOT a.claimish
      UNION ALL SELECT a.doc_id, a.iri, 'Supports', b.iri FROM {p}_pos a JOIN {p}_pos b ON a.doc_id = b.doc_id AND b.pos = a.thesis
        WHERE a.claimish AND a.thesis < a.pos"""
    depth_ctes(p, f"{p}_nodes", f"{p}_edges")
    CTE[f"{p}_metrics"] = metrics_sql(f"{p}_nodes", f"{p}_edges", f"{p}_depth")


CTE["sitems_pos"] = """SELECT doc_id, section_no, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY start, item_no) - 1 AS item_no,
  item_type, text, start, confidence FROM (SELECT i.doc_id, i.section_no, it.rule_no * 100000 + it.n AS item_no, it.item_type AS item_type, it.text AS text, it.start AS start,
  it.confidence AS confidence FROM skept_items i)"""
CTE["mitems"] = """SELECT doc_id, 1 AS section_no, row_number() OVER (PARTITION BY doc_id ORDER BY it.confidence DESC, it.rule_no, it.n) - 1 AS item_no,
  it.item_type AS item_type, it.text AS text, it.start AS start, it.confidence AS confidence FROM kept_items"""
CTE["msecs"] = "SELECT doc_id, 1 AS section_no, 'main' AS title FROM documents"
graph_ctes("gp", "sitems", "secs", None)       # parity order
graph_ctes("gt", "sitems_pos", "secs", None)   # items by text position
graph_ctes("gm", "mitems", "msecs", None)      # one section per document


def _g(s, d, order="confidence"):
    return document_graph(section_documents(s, d), segmented=True, order=order)


for _name, _p, _order in (("g1_graph", "gp", "confidence"), ("g1_graph_position", "gt", "position")):
    register(f"{_name}_nodes", f"SELECT doc_id, node_id, node_type, text, source_text, {big('start')} AS span_start FROM {_p}_nodes")(
        lambda s, d, o=_order: graph.node_rows(_g(s, d, o)).select(
            "doc_id", "node_id", "node_type", "text", "source_text", F.col("span.start").alias("span_start")))
    register(f"{_name}_edges", f"SELECT * FROM {_p}_edges")(lambda s, d, o=_order: graph.edge_rows(_g(s, d, o)))
    register(f"{_name}_metrics", f"""
      SELECT doc_id, {big('node_count')} AS node_count, {big('edge_count')} AS edge_count, {big('claim_count')} AS claim_count,
        {big('evidence_count')} AS evidence_count, {r6('connectivity')} AS connectivity, {r6('evidence_coverage')} AS evidence_coverage,
        {big('max_depth')} AS max_depth, {r6(STRUCT)} AS structural FROM {_p}_metrics""")(
        lambda s, d, o=_order: graph.graph_metrics(_g(s, d, o)).withColumn("structural", graph.structural_score()).drop(
            "has_counter", "has_rebuttal", "quality"))

# externally extracted claims and evidence: the fallback rules over each section
_low = "lower(t)"
CTE["given"] = f"""
  SELECT doc_id, section_no, role, row_number() OVER (PARTITION BY doc_id, section_no, role ORDER BY n) - 1 AS no, t AS text, qn AS quantified,
         CASE WHEN role = 'evidence' THEN CASE WHEN qn THEN 'statistical' ELSE 'citation' END END AS evidence_type
  FROM (SELECT doc_id, section_no, n, t, CASE WHEN role = 'evidence' THEN {any_of(_low, L.FALLBACK_QUANTIFIED)} END AS qn, role FROM
    (SELECT doc_id, section_no, n, t, unnest(list_filter([CASE WHEN {any_of(_low, L.FALLBACK_CLAIMS)} THEN 'claim' END,
        CASE WHEN (contains(t, '(') AND contains(t, ')') AND {any_of(_low, L.FALLBACK_PAREN_EVIDENCE)}) OR {any_of(_low, L.FALLBACK_EVIDENCE)} THEN 'evidence' END],
        lambda x: x IS NOT NULL)) AS role
     FROM (SELECT doc_id, section_no, unnest(l) AS t, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, section_no, {sents_dot('text', 15)} AS l FROM secs))))"""
CTE["g2_all"] = """
  SELECT doc_id, section_no, CASE WHEN item_no < 0 THEN 0 ELSE 1 END AS phase, item_no AS no, text, node_id,
         CASE WHEN promoted THEN 'SubClaim' ELSE node_type END AS node_type, false AS added FROM gp_nodes
  UNION ALL SELECT doc_id, section_no, CASE role WHEN 'claim' THEN 2 ELSE 3 END, no, text,
         'arg:s' || (section_no - 1) || CASE role WHEN 'claim' THEN '_c' ELSE '_e' END || no,
         CASE WHEN role = 'claim' THEN 'SubClaim' WHEN quantified THEN 'QuantifiedEvidence' WHEN evidence_type = 'citation' THEN 'Citation' ELSE 'Evidence' END,
         true FROM given"""
CTE["g2_kept"] = """
  SELECT *, node_type IN ('Thesis', 'SubClaim') AS c, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, phase, no) AS pos FROM
    (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY section_no, phase, no) AS rn FROM g2_all) WHERE NOT added OR rn = 1"""
CTE["g2_pos"] = """
  SELECT *, min(pos) FILTER (node_type = 'Thesis') OVER (PARTITION BY doc_id) AS thesis, min(pos) FILTER (c) OVER (PARTITION BY doc_id) AS lead_claim,
         last_value(CASE WHEN c THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id, section_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_claim
  FROM g2_kept"""


def _g2(s, d):
    sec = sections.sectioned(section_documents(s, d))
    g = graph.build_graph(extraction.with_items(sec))
    rows = sec.select("doc_id", F.inline("sections")).select(
        "doc_id", "section_no", F.posexplode(extraction.fallback_items(F.col("text"))).alias("at", "x")).select("doc_id", "section_no", "at", "x.*")
    from pyspark.sql import Window
    no = F.row_number().over(Window.partitionBy("doc_id", "section_no", "role").orderBy("at")) - 1
    return graph.add_section_items(g, rows.withColumn("no", no))


register("g2_section_items_nodes", """
  SELECT doc_id, node_id, CASE WHEN c AND pos = coalesce(thesis, lead_claim) THEN 'Thesis' ELSE node_type END AS node_type, text FROM g2_pos""")(
    lambda s, d: _g2(s, d)[0].select("doc_id", "node_id", "node_type", "text"))
register("g2_section_items_edges", """
  SELECT * FROM gp_edges
  UNION ALL SELECT doc_id, 'arg:section_' || (section_no - 1), 'Contains', node_id FROM g2_pos WHERE added
  UNION ALL SELECT a.doc_id, a.node_id, 'Supports', b.node_id FROM g2_pos a JOIN g2_pos b ON a.doc_id = b.doc_id
    AND b.pos = CASE WHEN a.c THEN CASE WHEN a.thesis < a.pos THEN a.thesis END ELSE a.last_claim END WHERE a.added""")(lambda s, d: _g2(s, d)[1])

# --- scored nodes: the turns of a conversation ------------------------------------
JUST = ("CASE turn % 7 WHEN 0 THEN 'opening claim' WHEN 1 THEN 'cites data and a number' WHEN 2 THEN 'a quote from the source' "
        "WHEN 3 THEN 'counter position' WHEN 4 THEN 'plain evidence' WHEN 5 THEN 'closing remark' ELSE 'develops the point' END || ' by ' || role")
CTE["scored_nodes"] = f"""
  SELECT conv_id AS doc_id, turn AS pos, 'n' || turn AS node_iri, (length(text) % 130) / 100.0 AS score, {JUST} AS justification,
         CASE WHEN turn % 3 = 0 THEN text END AS source_text FROM conversations"""


def _scored(s, d):
    return run_sql(s, d, "scored_nodes").select(
        "doc_id", "pos", "node_iri", F.col("score").cast("double").alias("score"), "justification", "source_text",
        F.lit(None).cast(graph.SPAN).alias("span"))


register("g3_scored_graph_nodes", f"""
  SELECT doc_id, node_iri AS node_id, CASE WHEN pos = 0 THEN 'Thesis' WHEN {any_of('j', L.NODE_EVIDENCE_WORDS)} THEN
      CASE WHEN {any_of('j', L.NODE_QUANTIFIED_WORDS)} THEN 'QuantifiedEvidence' WHEN {any_of('j', L.NODE_CITATION_WORDS)} THEN 'Citation' ELSE 'Evidence' END
    WHEN contains(j, 'counter') THEN 'Counter' WHEN {any_of('j', L.NODE_CLOSING_WORDS)} THEN 'Structural' ELSE 'SubClaim' END AS node_type,
    coalesce(source_text, justification) AS text, {r6('least(score, 1)')} AS score FROM (SELECT *, lower(justification) AS j FROM scored_nodes)""")(
    lambda s, d: graph.graph_from_scores(_scored(s, d))[0].select("doc_id", "node_id", "node_type", "text", "score"))
register("g3_scored_graph_edges", """
  SELECT a.doc_id, a.node_iri AS src, 'Supports' AS edge_type, b.node_iri AS dst FROM scored_nodes a JOIN scored_nodes b
    ON a.doc_id = b.doc_id AND ((b.pos = 0 AND a.pos > 0) OR (a.pos > 1 AND b.pos = a.pos - 1 AND b.pos > 0))
  UNION ALL SELECT a.doc_id, a.node_iri, 'Supports', b.node_iri FROM scored_nodes a JOIN scored_nodes b ON a.doc_id = b.doc_id AND b.pos = 0
    WHERE false""")(lambda s, d: graph.graph_from_scores(_scored(s, d))[1])

CTE["h_triples"] = """
  SELECT doc_id, 'http://example.org/arg/' || node_id AS s, 'type' AS p, 'http://example.org/arg/' || node_type AS o FROM h_nodes
  UNION ALL SELECT doc_id, 'http://example.org/arg/' || node_id, 'hasText', text FROM h_nodes WHERE node_type <> 'Thesis'
  UNION ALL SELECT doc_id, 'http://example.org/arg/' || src, lower(edge_type), 'http://example.org/arg/' || dst FROM h_edges"""


def _triples(s, d):
    n, e = _h(s, d)
    pre = F.lit("http://example.org/arg/")
    iri = lambda c: F.concat(pre, c)
    return (
        n.select("doc_id", iri("node_id").alias("s"), F.lit("type").alias("p"), iri("node_type").alias("o"))
        .unionByName(n.where("node_type <> 'Thesis'").select("doc_id", iri("node_id").alias("s"), F.lit("hasText").alias("p"), F.col("text").alias("o")))
        .unionByName(e.select("doc_id", iri("src").alias("s"), F.lower("edge_type").alias("p"), iri("dst").alias("o"))))


register("g4_graph_from_triples", """
  SELECT doc_id, node_type AS kind, 'arg:' || node_id AS a, CASE WHEN node_type <> 'Thesis' THEN text END AS b FROM h_nodes
  UNION ALL SELECT DISTINCT doc_id, edge_type, 'arg:' || src, 'arg:' || dst FROM h_edges""")(
    lambda s, d: (lambda ne: ne[0].select("doc_id", F.col("node_type").alias("kind"), F.col("node_id").alias("a"), F.col("text").alias("b"))
                  .unionByName(ne[1].select("doc_id", F.col("edge_type").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))))(
        graph.graph_from_triples(_triples(s, d))))

_types = ", ".join(f"count(DISTINCT node_id) FILTER (node_type = '{t}') AS \"{t}\"" for t in graph.NODE_TYPES)
CTE["h_types"] = f"SELECT doc_id, {_types} FROM h_nodes GROUP BY doc_id"
CTE["gm_types"] = f"SELECT doc_id, {_types} FROM gm_nodes GROUP BY doc_id"
register("g5_type_counts", "SELECT * FROM h_types")(lambda s, d: graph.type_counts(_h(s, d)[0]))

depth_ctes("h", "h_nodes", "h_edges")
CTE["h_metrics"] = metrics_sql("h_nodes", "h_edges", "h_depth")


@register("g6_graph_metrics", f"""
  SELECT doc_id, {big('node_count')} AS node_count, {big('edge_count')} AS edge_count, {big('claim_count')} AS claim_count,
    {big('evidence_count')} AS evidence_count, {r6('connectivity')} AS connectivity, {r6('evidence_coverage')} AS evidence_coverage,
    has_counter, has_rebuttal, {r6('quality')} AS quality FROM h_metrics""")
def _g6(s, d):
    return graph.graph_metrics(*_h(s, d))


@register("g7_support_depth", f"SELECT doc_id, {big('k')} AS max_depth FROM h_depth")
def _g7(s, d):
    n, e = _h(s, d)
    return graph.support_depth(e, n)


@register("g8_structural_score", f"SELECT doc_id, {big('max_depth')} AS max_depth, {r6(STRUCT)} AS structural FROM h_metrics")
def _g8(s, d):
    n, e = _h(s, d)
    m = graph.metrics_with_depth(n, e)
    return m.select("doc_id", "max_depth", graph.structural_score().alias("structural"))


ITER = 6
CTE["pr_e"] = """SELECT e.doc_id, e.src, e.dst, count(*) AS w FROM h_edges e JOIN h_nodes a ON a.doc_id = e.doc_id AND a.node_id = e.src
  JOIN h_nodes b ON b.doc_id = e.doc_id AND b.node_id = e.dst WHERE edge_type IN ('Supports', 'Warrants', 'Rebuts') GROUP BY ALL"""
CTE["pr_base"] = """SELECT n.doc_id, n.node_id, count(*) OVER (PARTITION BY n.doc_id) AS n, o.out FROM h_nodes n LEFT JOIN
  (SELECT doc_id, src, sum(w) AS out FROM pr_e GROUP BY ALL) o ON o.doc_id = n.doc_id AND o.src = n.node_id"""
CTE["pr_0"] = "SELECT *, CAST(1.0 AS DOUBLE) / n AS r FROM pr_base"
for _i in range(1, ITER + 1):
    CTE[f"pr_{_i}"] = f"""
      SELECT b.doc_id, b.node_id, b.n, b.out, 0.15 / b.n + 0.85 * l.lost / b.n + 0.85 * coalesce(g.got, 0) AS r FROM pr_base b
      JOIN (SELECT doc_id, sum(CASE WHEN out IS NULL THEN r ELSE 0 END) AS lost FROM pr_{_i - 1} GROUP BY doc_id) l ON l.doc_id = b.doc_id
      LEFT JOIN (SELECT e.doc_id, e.dst, sum(p.r / p.out * e.w) AS got FROM pr_e e JOIN pr_{_i - 1} p ON p.doc_id = e.doc_id AND p.node_id = e.src GROUP BY ALL) g
        ON g.doc_id = b.doc_id AND g.dst = b.node_id"""


@register("g9_pagerank", f"""
  SELECT doc_id, node_id, {r6('greatest(r / max(r) OVER (PARTITION BY doc_id), 1.0 / (n * 10))')} AS rank FROM pr_{ITER}""")
def _g9(s, d):
    return graph.pagerank(*_h(s, d), iterations=ITER)


# quotes: the extracted items of each marked text and one benchmark passage
CTE["quotes"] = """
  SELECT doc_id, node_id, node_type, source_text, start FROM gm_nodes WHERE node_type <> 'Structural'
  UNION ALL SELECT d.doc_id, 'b' || b.item_id, 'Evidence', b.text, NULL FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
  UNION ALL SELECT doc_id, 'x', 'SubClaim', NULL, NULL FROM documents"""


def _quotes(s, d):
    n = graph.node_rows(document_graph(marked_documents(s, d))).where("node_type <> 'Structural'")
    cols = ["doc_id", "node_id", "node_type", "source_text", "span"]
    ids = table(s, d, "documents").select("doc_id")
    b = table(s, d, "benchmark").select((F.col("item_id")).alias("item_id"), F.col("text").alias("source_text"))
    none = F.lit(None).cast(graph.SPAN).alias("span")
    passages = ids.withColumn("item_id", F.col("doc_id") % b.agg(F.count("*")).scalar()).join(b, "item_id").select(
        "doc_id", F.concat(F.lit("b"), "item_id").alias("node_id"), F.lit("Evidence").alias("node_type"), "source_text", none)
    blank = ids.select("doc_id", F.lit("x").alias("node_id"), F.lit("SubClaim").alias("node_type"), F.lit(None).cast("string").alias("source_text"), none)
    return n.select(*cols).unionByName(passages).unionByName(blank)


CTE["q_at"] = """
  SELECT q.doc_id, q.node_id, q.source_text, length(m.text) AS doc_len, CASE WHEN q.start IS NOT NULL AND q.start + length(q.source_text) <= length(m.text)
      AND substring(m.text, CAST(q.start AS BIGINT) + 1, length(q.source_text)) = q.source_text THEN q.start
    WHEN strpos(m.text, q.source_text) > 0 THEN strpos(m.text, q.source_text) - 1 END AS a, length(q.source_text) AS len FROM quotes q JOIN marked m ON m.doc_id = q.doc_id"""
CTE["q_new"] = """
  SELECT doc_id, sum(greatest(b - greatest(a, prev), 0)) AS covered FROM (
    SELECT *, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM
      (SELECT DISTINCT doc_id, a, a + len AS b FROM q_at WHERE a IS NOT NULL)) GROUP BY doc_id"""


@register("g10_verify_spans", f"""
  SELECT q.doc_id, count(*) AS total_nodes, count(source_text) AS nodes_with_source, count(a) AS verified_count,
         count(*) FILTER (source_text IS NOT NULL AND a IS NULL) AS failed_count,
         {r6('CASE WHEN max(doc_len) > 0 THEN coalesce(max(covered), 0) * 1.0 / max(doc_len) ELSE 0 END')} AS coverage
  FROM q_at q LEFT JOIN q_new n ON n.doc_id = q.doc_id GROUP BY q.doc_id""")
def _g10(s, d):
    return graph.verify_spans(_quotes(s, d), marked_documents(s, d))


# consensus: an agent is a shift of the day, a node is an event type of one user
CTE["node_scores"] = """
  SELECT user_id AS doc_id, event_type AS node_id, 'a' || (event_id % 4) AS agent_id, event_id AS seq, value / 100 AS score FROM events"""
CTE["consensus"] = """
  SELECT doc_id, node_id, count(*) AS agents, avg(score) AS mean, CASE WHEN count(*) < 2 THEN 0.0 ELSE stddev_pop(score) END AS std_dev
  FROM (SELECT doc_id, node_id, agent_id, min_by(score, seq) AS score FROM node_scores GROUP BY ALL) GROUP BY doc_id, node_id"""


@register("g11_node_consensus", f"""
  SELECT doc_id, node_id, agents, {r6('mean')} AS mean, {r6('std_dev')} AS std_dev, std_dev > 0.15 AS uncertain FROM consensus""")
def _g11(s, d):
    return graph.node_consensus(run_sql(s, d, "node_scores"), 0.15)


@register("g11_consensus_summary", f"""
  SELECT doc_id, count(*) FILTER (std_dev > 0.15) AS uncertain_count, {r6('avg(std_dev)')} AS mean_divergence FROM consensus GROUP BY doc_id""")
def _g11b(s, d):
    return graph.consensus_summary(graph.node_consensus(run_sql(s, d, "node_scores"), 0.15))


CTE["q_sets"] = f"SELECT doc_id, list(DISTINCT source_text) AS qs FROM quotes WHERE source_text IS NOT NULL GROUP BY doc_id"
CTE["q_sents"] = f"SELECT doc_id, unnest({sents_dot('text', 15)}) AS s FROM marked"
CTE["q_hit"] = f"""
  SELECT s.doc_id, s, len(list_filter(qs, lambda t: contains(s, t) OR contains(t, s))) > 0 OR
    len(list_filter(qs, lambda t: {jac(f"list_distinct({words('s')})", f"list_distinct({words('t')})")} >= 0.6)) > 0 AS hit
  FROM q_sents s JOIN q_sets q ON q.doc_id = s.doc_id"""


@register("g12_completeness", f"""
  SELECT d.doc_id, count(h.s) AS total_sentences, count(*) FILTER (h.hit) AS covered_sentences,
         {r6('CASE WHEN count(h.s) = 0 THEN 100 ELSE count(*) FILTER (h.hit) * 100.0 / count(h.s) END')} AS coverage_pct
  FROM documents d LEFT JOIN q_hit h ON h.doc_id = d.doc_id GROUP BY d.doc_id""")
def _g12(s, d):
    return graph.completeness(_quotes(s, d), marked_documents(s, d), 0.6).drop("uncovered_sentences")


_squash = lambda x: f"array_to_string({words(f'lower({x})')}, ' ')"
CTE["q_norm"] = f"SELECT doc_id, text, {_squash('text')} AS norm FROM marked"
CTE["q_check"] = f"""
  SELECT q.doc_id, q.node_id, q.node_type, qt, qt <> '' AND (contains(m.text, qt) OR contains(m.norm, qn) OR (strlen(qn) > 30 AND contains(m.norm, substring(qn, 1, 30)))) AS found
  FROM (SELECT *, coalesce(source_text, '') AS qt, {_squash("coalesce(source_text, '')")} AS qn FROM quotes) q JOIN q_norm m ON m.doc_id = q.doc_id"""
CTE["q_rates"] = """SELECT doc_id, count(*) FILTER (found) AS verified, count(*) FILTER (NOT found) AS unverified,
  count(*) FILTER (found) * 1.0 / count(*) AS rate,
  coalesce(array_to_string((list('[' || node_type || '] ' || substring(qt, 1, 60) ORDER BY node_id) FILTER (NOT found AND qt <> ''))[:5], '|'), '') AS failures
  FROM q_check GROUP BY doc_id"""


@register("g13_quote_check", f"SELECT doc_id, verified, unverified, {r6('rate')} AS rate, failures FROM q_rates")
def _g13(s, d):
    return graph.quote_check(_quotes(s, d), marked_documents(s, d)).withColumn("failures", F.array_join("failures", "|"))


_EV, _CL = '("Evidence" + "QuantifiedEvidence" + "Citation")', '("Thesis" + "SubClaim")'
_TOT = "(" + " + ".join(f'"{t}"' for t in graph.NODE_TYPES) + ")"
TOPO = (f"(0.20 * least({_TOT} / 10.0, 1) + 0.25 * least({_EV} * 1.0 / greatest({_CL}, 1) / 2, 1) + 0.15 * CAST(\"Counter\" > 0 AS INT) "
        f"+ 0.10 * CAST(\"Rebuttal\" > 0 AS INT) + 0.15 * \"QuantifiedEvidence\" / greatest({_EV}, 1) + 0.10 * \"Citation\" / greatest({_EV}, 1) "
        f"+ 0.05 * \"Counter\" / greatest({_CL}, 1))")
CTE["topo"] = f"""
  SELECT t.doc_id, {_TOT} AS node_count, {_EV} AS evidence_count, {_CL} AS claim_count, {TOPO} AS raw_score, {TOPO} * coalesce(r.rate, 0) AS topology_score
  FROM gm_types t LEFT JOIN q_rates r ON r.doc_id = t.doc_id"""


def _topo(s, d):
    n = graph.node_rows(document_graph(marked_documents(s, d)))
    return graph.topology_score(graph.type_counts(n), graph.quote_check(_quotes(s, d), marked_documents(s, d)))


@register("g14_topology_score", f"""
  SELECT doc_id, {big('node_count')} AS node_count, {big('evidence_count')} AS evidence_count, {big('claim_count')} AS claim_count,
         {r6('raw_score')} AS raw_score, {r6('topology_score')} AS topology_score FROM topo""")
def _g14(s, d):
    return _topo(s, d)


@register("g15_framework_from_topology", f"""
  SELECT doc_id, CASE WHEN "QuantifiedEvidence" * 1.0 / t > 0.2 AND "Citation" * 1.0 / t > 0.05 THEN 'technical_documentation'
    WHEN ("Counter" + "Rebuttal") * 1.0 / greatest({_CL}, 1) > 0.15 AND {_CL} > 5 THEN 'policy_greenbook'
    WHEN "Citation" * 1.0 / t > 0.1 THEN 'nhs_clinical_governance' WHEN {_EV} * 1.0 / greatest({_CL}, 1) < 0.5 AND {_TOT} < 10 THEN 'generic_quality'
    WHEN {_EV} > {_CL} AND "QuantifiedEvidence" = 0 AND "Citation" = 0 THEN 'academic_essay' ELSE 'generic_quality' END AS framework_id
  FROM (SELECT *, greatest({_TOT}, 1) AS t FROM h_types)""")
def _g15(s, d):
    return graph.framework_from_topology(graph.type_counts(_h(s, d)[0]))


@register("g16_audit_trail", "SELECT doc_id, node_id, node_type, coalesce(source_text, text) AS quote FROM gp_nodes")
def _g16(s, d):
    return graph.audit_trail(graph.node_rows(_g(s, d)))


# --- M: mined facts ---------------------------------------------------------------
CTE["h_ev"] = """SELECT DISTINCT e.doc_id, e.src, e.dst FROM h_edges e JOIN h_nodes n ON n.doc_id = e.doc_id AND n.node_id = e.src
  WHERE edge_type = 'Supports' AND node_type IN ('Evidence', 'QuantifiedEvidence', 'Citation')"""
CTE["h_claims"] = """SELECT n.doc_id, n.node_id, count(e.src) AS n FROM (SELECT DISTINCT doc_id, node_id FROM h_nodes WHERE node_type IN ('Thesis', 'SubClaim')) n
  LEFT JOIN h_ev e ON e.doc_id = n.doc_id AND e.dst = n.node_id GROUP BY ALL"""
_M = {
    "StrongClaim": "SELECT doc_id, node_id FROM h_claims WHERE n >= 2",
    "WeakClaim": "SELECT doc_id, node_id FROM h_claims WHERE n = 1",
    "UnsupportedClaim": "SELECT doc_id, node_id FROM h_claims WHERE n = 0",
    "SophisticatedArgument": """SELECT DISTINCT n.doc_id, n.node_id FROM h_nodes n JOIN h_edges c ON c.doc_id = n.doc_id AND c.dst = n.node_id AND c.edge_type = 'Counters'
      JOIN h_edges r ON r.doc_id = c.doc_id AND r.dst = c.src AND r.edge_type = 'Rebuts' WHERE n.node_type = 'Thesis'""",
    "EvidencedThesis": """SELECT DISTINCT n.doc_id, n.node_id FROM h_nodes n WHERE n.node_type = 'Thesis' AND (EXISTS (SELECT 1 FROM h_ev e WHERE e.doc_id = n.doc_id AND e.dst = n.node_id)
      OR EXISTS (SELECT 1 FROM h_edges x JOIN h_ev e ON e.doc_id = x.doc_id AND e.dst = x.src WHERE x.edge_type = 'Supports' AND x.doc_id = n.doc_id AND x.dst = n.node_id))""",
    "QuantifiedSupport": "SELECT DISTINCT n.doc_id, n.node_id FROM h_nodes n JOIN h_ev e ON e.doc_id = n.doc_id AND e.src = n.node_id WHERE node_type = 'QuantifiedEvidence'",
    "CitationSupport": "SELECT DISTINCT n.doc_id, n.node_id FROM h_nodes n JOIN h_ev e ON e.doc_id = n.doc_id AND e.src = n.node_id WHERE node_type = 'Citation'",
    "DeepChain": """SELECT DISTINCT e.doc_id, e.src AS node_id FROM h_ev e JOIN h_edges x ON x.doc_id = e.doc_id AND x.src = e.dst AND x.edge_type = 'Supports'
      JOIN h_nodes t ON t.doc_id = x.doc_id AND t.node_id = x.dst AND t.node_type = 'Thesis'""",
}
for _k, _v in _M.items():
    CTE[f"f_{_k.lower()}"] = _v
for _i, _k in enumerate(_M, 1):
    register(f"m{_i}_{_k.lower()}", f"SELECT doc_id, node_id, '{_k}' AS fact FROM f_{_k.lower()}")(
        lambda s, d, k=_k: rules.DEFAULT_RULES[k](*_h(s, d)))
_n = lambda k: f"(SELECT count(*) FROM f_{k.lower()} f WHERE f.doc_id = d.doc_id)"
CTE["facts"] = "SELECT d.doc_id, " + ", ".join(f"coalesce(max(c) FILTER (k = '{k}'), 0) AS {k.lower()}" for k in _M) + " FROM (SELECT DISTINCT doc_id FROM h_nodes) d LEFT JOIN (" + " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS k, count(*) AS c FROM f_{k.lower()} GROUP BY doc_id" for k in _M) + ") x ON x.doc_id = d.doc_id GROUP BY d.doc_id"


@register("m9_mined_facts", """
  SELECT doc_id, strongclaim AS strong_claims, weakclaim AS weak_claims, unsupportedclaim AS unsupported_claims, strongclaim + weakclaim AS supported_claims,
    sophisticatedargument AS sophisticated_arguments, CAST(0 AS BIGINT) AS circular_arguments, evidencedthesis > 0 AS evidenced_thesis,
    evidencedthesis = 0 AS unevidenced_thesis, quantifiedsupport AS quantified_support, citationsupport AS citation_support, deepchain AS deep_chains FROM facts""")
def _m9(s, d):
    return rules.mine_facts(*_h(s, d))


@register("m10_fact_features", "SELECT f.doc_id, " + ", ".join(
    f"{r6(x)} AS f{i}" for i, x in enumerate([
        "strongclaim * 1.0 / greatest(claim_count, 1)", "weakclaim * 1.0 / greatest(claim_count, 1)", "unsupportedclaim * 1.0 / greatest(claim_count, 1)",
        "CASE WHEN evidencedthesis > 0 THEN 1 ELSE 0 END", "CASE WHEN sophisticatedargument > 0 THEN 1 ELSE 0 END", "quantifiedsupport", "citationsupport",
        "deepchain"])) + " FROM facts f JOIN h_metrics m ON m.doc_id = f.doc_id")
def _m10(s, d):
    n, e = _h(s, d)
    claims = n.where(F.col("node_type").isin(graph.CLAIM_TYPES)).groupBy("doc_id").agg(F.count("*").alias("claim_count"))
    f = rules.facts_to_features(rules.mine_facts(n, e).join(claims, "doc_id"), "claim_count")
    return f.select("doc_id", *[F.col("features")[i].alias(f"f{i}") for i in range(8)])


def _heavy(nodes, edges):
    """A caller's rule: claims backed by evidence scoring over one half on average.

    Means of exactly one half are frequent, and which side of it a sum of doubles falls on
    depends on the order of addition: scores are added from the last supporter to the first,
    row by row over a sorted window, so that a claim of any size holds one row in memory."""
    ev = nodes.select("doc_id", F.col("node_id").alias("src"), "score").where("score is not null")
    order = Window.partitionBy("doc_id", "dst").orderBy(F.desc("src"), F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = edges.where("edge_type = 'Supports'").join(ev, ["doc_id", "src"]).select(
        "doc_id", F.col("dst").alias("node_id"), F.sum("score").over(order).alias("total"), F.count("*").over(order).alias("n"))
    return sums.groupBy("doc_id", "node_id").agg((F.max_by("total", "n") / F.max("n")).alias("m")).where("m > 0.5").select("doc_id", "node_id")


@register("m11_user_rule", """
  SELECT e.doc_id, e.dst AS node_id, 'HeavilyBacked' AS fact FROM h_edges e JOIN h_nodes n ON n.doc_id = e.doc_id AND n.node_id = e.src
  WHERE edge_type = 'Supports' AND n.score IS NOT NULL GROUP BY e.doc_id, e.dst HAVING avg(n.score) > 0.5""")
def _m11(s, d):
    return rules.derive(*_h(s, d), rules={"HeavilyBacked": _heavy})


# criteria = parts, scored where a large line has been returned; agents = customers, needs = urgent orders
@register("m12_quality_violations", """
  SELECT 'criterion_scored' AS rule, 'error' AS severity, CAST(p_partkey AS VARCHAR) AS subject FROM part
    WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R')
  UNION ALL SELECT 'agent_has_needs', 'warning', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def _m12(s, d):
    scored = table(s, d, "lineitem").where("l_quantity >= 45 AND l_returnflag = 'R'").select(F.col("l_partkey").alias("criterion_id"))
    return rules.quality_violations(
        table(s, d, "part").select(F.col("p_partkey").alias("criterion_id")), scored,
        table(s, d, "customer").select(F.col("c_custkey").alias("agent_id")),
        table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("agent_id")))


# --- T: gates -------------------------------------------------------------------
def gate_sql(metrics, score, mx):
    ev = f"(CASE WHEN quality IS NULL THEN {STRUCT} ELSE 0.5 * {STRUCT} + 0.5 * quality END)"
    tol = f"({clip('0.06 * ln(node_count + 1) + 0.02', 0.05, 0.30)} * coalesce({clip('quality / 0.5', 0.5, 1.0)}, 1))"
    return f"""SELECT *, CASE WHEN node_count = 0 OR (evidence_count = 0 AND claim_count = 0) OR (evidence_count = 0 AND {score} * 1.0 / {mx} > 0.3) THEN 'REJECTED'
      WHEN gap <= tolerance THEN 'CONFIRMED' ELSE 'FLAGGED' END AS verdict FROM
      (SELECT *, {STRUCT} AS structural, {ev} AS evidence_score, {tol} AS tolerance, abs({score} * 1.0 / {mx} - {ev}) AS gap FROM {metrics})"""


CTE["gate_in"] = "SELECT m.*, l.quality AS score FROM gm_metrics m JOIN labels l ON l.doc_id = m.doc_id"
CTE["gate_in"] = "SELECT m.* EXCLUDE (quality), m.quality, l.quality AS score FROM gm_metrics m JOIN labels l ON l.doc_id = m.doc_id"
CTE["gated"] = gate_sql("gate_in", "score", "1")


@register("document_gate", f"""
  SELECT doc_id, {big('node_count')} AS node_count, {big('evidence_count')} AS evidence_count, {big('claim_count')} AS claim_count, {r6('structural')} AS structural,
         {r6('tolerance')} AS tolerance, verdict, CASE WHEN verdict = 'FLAGGED' THEN {r6('evidence_score')} END AS recommended_score FROM gated""")
def _gate(s, d):
    scores = table(s, d, "labels").select("doc_id", F.col("quality").cast("double").alias("score"), F.lit(1.0).alias("max_score"))
    return document_gate(marked_documents(s, d), scores).select(
        "doc_id", "node_count", "evidence_count", "claim_count", "structural", "tolerance", "verdict", "recommended_score")


# external score of a customer: account balance on a scale of 11000
CTE["hgate_in"] = "SELECT m.*, c.c_acctbal AS score FROM h_metrics m JOIN customer c ON c.c_custkey = m.doc_id"
CTE["hgated"] = gate_sql("hgate_in", "score", "11000")


@register("t1_gate", f"""
  SELECT doc_id, {r6('structural')} AS structural, {r6('evidence_score')} AS evidence_score, {r6('tolerance')} AS tolerance, {r6('gap')} AS gap, verdict,
         CASE WHEN verdict = 'FLAGGED' THEN {r6('evidence_score * 11000')} END AS recommended_score FROM hgated""")
def _t1(s, d):
    n, e = _h(s, d)
    m = graph.metrics_with_depth(n, e).join(
        table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_acctbal").alias("score")), "doc_id")
    return gate.gate(m.withColumn("max_score", F.lit(11000.0)), "score", "max_score").select(
        "doc_id", "structural", "evidence_score", "tolerance", "gap", "verdict", "recommended_score")


@register("t2_gate_topology", f"""
  SELECT doc_id, {r6('topology_score')} AS topology_score, {r6('gap')} AS gap, {r6('tolerance')} AS tolerance,
    CASE WHEN evidence_count = 0 AND claim_count = 0 THEN 'REJECTED' WHEN gap <= tolerance THEN 'CONFIRMED' ELSE 'FLAGGED' END AS verdict
  FROM (SELECT t.*, abs(l.quality - topology_score) AS gap, 0.39 * (1 - topology_score) + 0.05 AS tolerance FROM topo t JOIN labels l ON l.doc_id = t.doc_id)""")
def _t2(s, d):
    t = _topo(s, d).join(table(s, d, "labels").select("doc_id", F.col("quality").cast("double").alias("external")), "doc_id")
    return gate.gate_topology(t, "external").select("doc_id", "topology_score", "gap", "tolerance", "verdict")


@register("t3_detect_scale", f"""
  SELECT user_id, {r6('avg(value)')} AS mean_score, CASE WHEN max(value) > 10 THEN 100.0::DOUBLE WHEN max(value) > 5 THEN 10 WHEN max(value) > 1 THEN 5 ELSE 1 END AS scale,
    {r6('avg(value) / CASE WHEN max(value) > 10 THEN 100.0 WHEN max(value) > 5 THEN 10 WHEN max(value) > 1 THEN 5 ELSE 1 END')} AS normalized
  FROM events GROUP BY user_id""")
def _t3(s, d):
    return gate.detect_scale(table(s, d, "events"), ["user_id"], "value")
