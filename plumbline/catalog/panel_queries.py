"""Queries over panel scores (D) and report tables (T4)."""

from pyspark.sql import functions as F

from plumbline.catalog.base import CTE, big, clip, q, r6, register, run_sql, table
from plumbline.catalog.graph_queries import STRUCT
from plumbline.catalog.text_queries import quality_sql, signal_sql
from plumbline.catalog.base import marked_documents
from plumbline.functions import dims
from plumbline.operators import graph, panel

# a session is a user, a round is six days, an agent is a six-hour shift
CTE["pscores"] = """
  SELECT user_id AS session_id, CAST(floor((day(ts) - 1) / 6) AS INT) + 1 AS round, 'a' || CAST(floor(hour(ts) / 6) AS INT) AS agent_id,
         event_type AS criterion_id, least(10, sum(CAST(round(value * 100) AS BIGINT)) / (count(*) * 1e3)) AS score, 10 * 1e0 AS max_score
  FROM events GROUP BY user_id, CAST(floor((day(ts) - 1) / 6) AS INT) + 1, 'a' || CAST(floor(hour(ts) / 6) AS INT), event_type"""
# wide panels: ten users share a session, an agent is an hour of the day
CTE["wscores"] = """
  SELECT CAST(floor(user_id / 10) AS BIGINT) AS session_id, 1 AS round, 'h' || hour(ts) AS agent_id, event_type AS criterion_id,
         least(10, sum(CAST(round(value * 100) AS BIGINT)) / (count(*) * 1e3)) AS score, 10 * 1e0 AS max_score
  FROM events GROUP BY CAST(floor(user_id / 10) AS BIGINT), 'h' || hour(ts), event_type"""
CTE["wtrust"] = """
  SELECT DISTINCT 'h' || hour(ts) AS truster, 'h' || ((hour(ts) + 7) % 24) AS trustee, 0.3 * 1e0 + hour(ts) / 48 AS trust_level FROM events
  UNION ALL SELECT DISTINCT 'h' || hour(ts), 'h' || ((hour(ts) * 5 + 1) % 20), 0.2 * 1e0 + hour(ts) / 60 FROM events"""
CTE["pcriteria"] = """
  SELECT DISTINCT event_type AS criterion_id, upper(event_type) AS title, 10 * 1e0 AS max_score, 40 * 1e0 AS pass_mark,
    CASE event_type WHEN 'view' THEN 0.3 WHEN 'click' THEN 0.2 WHEN 'purchase' THEN 0.25 WHEN 'signup' THEN 0.15 ELSE 0.1 END * 1e0 AS weight FROM events"""
CTE["pchallenges"] = """
  SELECT user_id AS session_id, CAST(floor((day(ts) - 1) / 6) AS INT) + 1 AS round, event_id AS seq, 'a' || (event_id % 4) AS challenger,
         'a' || (CAST(floor(event_id / 4) AS BIGINT) % 4) AS target, event_type AS criterion_id, value / 20 AS score_from,
         CASE WHEN event_id % 3 <> 0 THEN value / 20 + (event_id % 5 - 2) * 0.5 * 1e0 END AS score_to
  FROM events WHERE event_id % 4 <> CAST(floor(event_id / 4) AS BIGINT) % 4"""
P = lambda s, d: run_sql(s, d, "pscores")
W = lambda s, d: run_sql(s, d, "wscores")
C = lambda s, d: run_sql(s, d, "pcriteria")
CH = lambda s, d: run_sql(s, d, "pchallenges")

# the distinct event types carry an intent text for each panel
CTE["panel_intents"] = "SELECT DISTINCT o_orderstatus AS code FROM orders"


@register("d1_panel_trust", """
  SELECT m.role AS role, count(DISTINCT c.c_custkey) AS customers, sum(CASE WHEN m.role = 'Panel Moderator' THEN 0.6 ELSE 0.5 END * (p.n - 1))::DOUBLE AS trust_given
  FROM customer c JOIN (VALUES %s) m(domain, role) ON m.domain = CASE c.c_nationkey %% 7 %s END
  JOIN (VALUES %s) p(domain, n) ON p.domain = m.domain GROUP BY m.role""" % (
    ", ".join(f"({q(r[0])}, {q(r[4])})" for r in dims.panel_rows()),
    " ".join(f"WHEN {i} THEN {q(k)}" for i, k in enumerate(dims.PANELS)),
    ", ".join(f"({q(k)}, {len(v) + 1})" for k, v in dims.PANELS.items())))
def _d1(s, d):
    """Trust handed out by each role when every customer gets the panel of a domain."""
    trust = dims.panel_trust(dims.panel_dim(s)).groupBy("domain", F.col("truster").alias("agent_id")).agg(F.sum("trust_level").alias("given"))
    members = dims.panel_dim(s).join(trust, ["domain", "agent_id"])
    pick = "CASE c_nationkey % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(dims.PANELS)) + " END"
    c = table(s, d, "customer").select("c_custkey", F.expr(pick).alias("domain"))
    return c.join(members, "domain").groupBy("role").agg(
        F.countDistinct("c_custkey").alias("customers"), F.sum("given").alias("trust_given"))


AGENTS = ["academic_0", "academic_1", "academic_2", "academic_3"]
CRITERIA = [(c[0], c[3]) for c in dims.FRAMEWORKS["academic_essay"][3]]


@register("d2_structural_panel_scores", f"""
  SELECT doc_id, agent_id, criterion_id, max_score, {r6(clip(STRUCT + ' * max_score', 0, 'max_score'))} AS score FROM h_metrics
  CROSS JOIN (SELECT unnest([{', '.join(map(q, AGENTS))}]) AS agent_id) a
  CROSS JOIN (VALUES {', '.join(f"({q(i)}, {m}::DOUBLE)" for i, m in CRITERIA)}) c(criterion_id, max_score)""")
def _d2(s, d):
    from plumbline.catalog.graph_queries import _h
    n, e = _h(s, d)
    m = graph.metrics_with_depth(n, e).select("doc_id", graph.structural_score().alias("structural"))
    return panel.structural_panel_scores(m, AGENTS, CRITERIA)


CTE["pdis"] = """SELECT a.session_id, a.round, a.criterion_id, a.agent_id AS agent_a, a.score AS score_a, b.agent_id AS agent_b, b.score AS score_b,
  abs(a.score - b.score) AS delta FROM pscores a JOIN pscores b ON a.session_id = b.session_id AND a.round = b.round AND a.criterion_id = b.criterion_id
  AND a.agent_id < b.agent_id WHERE abs(a.score - b.score) > 2"""


@register("d3_disagreements", f"""SELECT session_id, {big('round')} AS round, criterion_id, agent_a, {r6('score_a')} AS score_a, agent_b, {r6('score_b')} AS score_b,
  {r6('delta')} AS delta FROM pdis""")
def _d3(s, d):
    return panel.disagreements(P(s, d))


CTE["pdrift"] = """SELECT a.session_id, a.round, coalesce(avg(abs(a.score - b.score)), 0) AS drift FROM pscores a LEFT JOIN pscores b
  ON a.session_id = b.session_id AND a.agent_id = b.agent_id AND a.criterion_id = b.criterion_id AND b.round = a.round - 1 WHERE a.round > 1 GROUP BY ALL"""


@register("d4_d5_drift", f"SELECT session_id, {big('round')} AS round, {r6('drift')} AS drift, drift < 0.5 AS converged FROM pdrift")
def _d4(s, d):
    return panel.drift(P(s, d))


# reconciliation of round 1, step by step
CTE["rec_0"] = "SELECT session_id, criterion_id, agent_id, score, max_score, true AS active, 0 AS used FROM pscores WHERE round = 1"
for _i in range(1, 5):
    CTE[f"rec_p{_i}"] = f"""
      SELECT *, list_reduce(pulls, lambda cur, x: greatest(least(cur + (x - cur) * 0.3, max_score), 0), score) AS nxt, len(pulls) > 0 AS hit FROM
        (SELECT b.session_id, b.criterion_id, b.agent_id, b.max_score, b.score, b.active, b.used,
           coalesce(list(a.score ORDER BY a.agent_id) FILTER (a.score IS NOT NULL), []) AS pulls
         FROM rec_{_i - 1} b LEFT JOIN rec_{_i - 1} a ON a.session_id = b.session_id AND a.criterion_id = b.criterion_id AND a.agent_id < b.agent_id
           AND abs(a.score - b.score) > 2 GROUP BY ALL)"""
    CTE[f"rec_{_i}"] = f"""
      SELECT p.session_id, criterion_id, agent_id, CASE WHEN go THEN nxt ELSE score END AS score, max_score, go AND change >= 0.5 AS active,
        used + CAST(go AS INT) AS used FROM rec_p{_i} p JOIN (SELECT session_id, bool_or(hit) AND bool_and(active) AS go, avg(abs(score - nxt)) AS change
        FROM rec_p{_i} GROUP BY session_id) t ON t.session_id = p.session_id"""


@register("d6_reconcile", f"SELECT session_id, {big('used')} AS rounds_used, criterion_id, agent_id, {r6('score')} AS score, max_score FROM rec_4")
def _d6(s, d):
    return panel.reconcile(P(s, d).where("round = 1"))


@register("d7_trust_update", f"""
  SELECT session_id, target AS truster, challenger AS trustee, {r6("list_reduce(list(CASE WHEN score_to IS NOT NULL THEN 0.1::DOUBLE ELSE -0.05 END ORDER BY seq), lambda t, x: greatest(least(t + x, 1), 0), 0.5::DOUBLE)")} AS trust_level
  FROM pchallenges GROUP BY session_id, target, challenger""")
def _d7(s, d):
    return panel.trust_update(CH(s, d))


CTE["wstats"] = """
  SELECT session_id, round, criterion_id, count(*) AS n, avg(score) AS panel_mean, CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(score) END AS panel_std_dev,
         CASE WHEN sum(w) > 0 THEN sum(score * w) / sum(w) ELSE 0 END AS consensus_score
  FROM (SELECT s.*, coalesce(t.w, 1) AS w FROM wscores s LEFT JOIN (SELECT trustee, avg(trust_level) AS w FROM wtrust GROUP BY trustee) t ON t.trustee = s.agent_id) GROUP BY ALL"""
CTE["wdissent"] = """SELECT s.session_id, s.round, s.criterion_id, s.agent_id, s.score, abs(s.score - panel_mean) / panel_std_dev AS deviations FROM wscores s
  JOIN wstats t ON t.session_id = s.session_id AND t.criterion_id = s.criterion_id WHERE panel_std_dev > 0 AND abs(s.score - panel_mean) > 2 * panel_std_dev"""
CTE["wmod"] = """SELECT t.*, coalesce(x.c, 0) AS dissents FROM wstats t LEFT JOIN (SELECT session_id, criterion_id, count(*) AS c FROM wdissent GROUP BY ALL) x
  ON x.session_id = t.session_id AND x.criterion_id = t.criterion_id"""
MOD = lambda s, d: panel.moderate(W(s, d), run_sql(s, d, "wtrust"))


@register("d8_moderate", f"""SELECT session_id, {big('round')} AS round, criterion_id, n, {r6('panel_mean')} AS panel_mean, {r6('panel_std_dev')} AS panel_std_dev,
  {r6('consensus_score')} AS consensus_score, dissents FROM wmod""")
def _d8(s, d):
    return MOD(s, d)


@register("d8_dissents", f"SELECT session_id, {big('round')} AS round, criterion_id, agent_id, {r6('score')} AS score, {r6('deviations')} AS deviations FROM wdissent")
def _d8b(s, d):
    return panel.dissents(W(s, d), MOD(s, d))


CTE["woverall"] = """
  SELECT session_id, sum(consensus_score * weight) AS total_score, sum(c.max_score * weight) AS max_possible,
    sum(consensus_score * weight) / sum(c.max_score * weight) * 100 AS percentage, max(pass_mark) AS mark,
    array_to_string((list(m.criterion_id ORDER BY consensus_score / c.max_score DESC, m.criterion_id))[:3], '|') AS top_strengths,
    array_to_string((list(m.criterion_id ORDER BY consensus_score / c.max_score, m.criterion_id))[:3], '|') AS top_weaknesses
  FROM wmod m JOIN pcriteria c ON c.criterion_id = m.criterion_id GROUP BY session_id"""


@register("d9_overall", f"""SELECT session_id, {r6('total_score')} AS total_score, {r6('max_possible')} AS max_possible, {r6('percentage')} AS percentage,
  percentage >= mark AS passed, top_strengths, top_weaknesses FROM woverall""")
def _d9(s, d):
    return panel.overall(MOD(s, d), C(s, d), ["session_id"]).withColumns({
        "top_strengths": F.array_join("top_strengths", "|"), "top_weaknesses": F.array_join("top_weaknesses", "|")})


@register("d10_most_contested", f"""SELECT session_id, criterion_id, count(*) AS challenges, {r6('count(*) + coalesce(sum(abs(score_to - score_from)), 0)')} AS contentiousness
  FROM pchallenges GROUP BY ALL""")
def _d10(s, d):
    return panel.most_contested(CH(s, d))


CTE["recorded"] = "SELECT user_id AS session_id, event_type AS criterion_id, 'a' || (event_id % 4) AS agent_id, value AS score, 500 * 1e0 AS max_score, ts, event_id FROM events"


@register("d11_latest_scores", f"""SELECT session_id, criterion_id, agent_id, {r6('score')} AS score, max_score FROM
  (SELECT *, row_number() OVER (PARTITION BY session_id, criterion_id ORDER BY ts DESC, event_id DESC) AS rn FROM recorded) WHERE rn = 1""")
def _d11(s, d):
    return panel.latest_scores(run_sql(s, d, "recorded"), ["ts", "event_id"])


CTE["feed"] = """SELECT user_id AS session_id, 'a' || (event_id % 4) AS agent_id, CASE WHEN event_id % 2 = 0 THEN 'depth' ELSE 'rigour' END AS criterion_id, event_id AS source_id,
  CASE event_type WHEN 'view' THEN 'evidence' WHEN 'click' THEN 'citation' WHEN 'purchase' THEN 'quantified_data' WHEN 'signup' THEN 'claim' ELSE 'other' END AS evidence_type,
  props AS text, value / 100 - 0.1 * 1e0 AS strength FROM events"""
CTE["fnodes"] = f"""SELECT session_id, agent_id, criterion_id, 'urn:feed:' || agent_id || ':' || criterion_id || ':' || source_id AS node_id,
  CASE evidence_type WHEN 'quantified_data' THEN 'QuantifiedEvidence' WHEN 'citation' THEN 'Citation' WHEN 'claim' THEN 'SubClaim' ELSE 'Evidence' END AS node_type,
  text, {clip('strength', 0, 1)} AS score FROM feed"""
FEED = lambda s, d: panel.feed_nodes(run_sql(s, d, "feed"))


@register("d12_feed_nodes", f"SELECT session_id, agent_id, criterion_id, node_id, node_type, text, {r6('score')} AS score FROM fnodes")
def _d12(s, d):
    return FEED(s, d)


@register("d12_feed_edges", "SELECT session_id, agent_id, criterion_id, node_id AS src, 'Supports' AS edge_type, 'urn:criterion:' || criterion_id AS dst FROM fnodes")
def _d12b(s, d):
    return panel.feed_edges(FEED(s, d))


CTE["counter_ev"] = """SELECT user_id AS session_id, 'a' || (event_id % 4) AS target_agent, 'depth' AS criterion_id, 'a' || ((event_id + 1) % 4) AS challenger, event_id AS source_id,
  props AS text, value / 60 AS strength FROM events WHERE event_type = 'error'"""


@register("d13_inhibit", f"""
  SELECT n.session_id, n.agent_id, n.criterion_id, node_id, node_type, text, {r6(f"score * CASE WHEN c.m IS NULL THEN 1 ELSE 1 - {clip('0.3 * c.m', 0, 0.5)} END")} AS score FROM fnodes n
  LEFT JOIN (SELECT session_id, target_agent, criterion_id, avg(strength) AS m FROM counter_ev GROUP BY ALL) c
    ON c.session_id = n.session_id AND c.target_agent = n.agent_id AND c.criterion_id = n.criterion_id
  UNION ALL SELECT session_id, target_agent, criterion_id, 'urn:feed:challenge:' || challenger || ':' || criterion_id || ':' || source_id, 'Counter', text, {r6(clip('strength', 0, 1))} FROM counter_ev""")
def _d13(s, d):
    return panel.inhibit(FEED(s, d), run_sql(s, d, "counter_ev"))


# connectivity is 1 (every node supports its criterion), coverage and depth are 0
CTE["fstruct"] = """SELECT session_id, agent_id, criterion_id, least(0.25 * least(ln(count(*) + 1) / ln(12), 1)
  + 0.20 * (count(*) FILTER (node_type <> 'SubClaim')) / count(*) + 0.20, 1) AS structural FROM fnodes GROUP BY ALL"""
CTE["fconv"] = """SELECT session_id, criterion_id, count(*) AS agents, avg(structural * 10) AS mean_score, var_pop(structural * 10) AS variance
  FROM fstruct GROUP BY ALL HAVING count(*) >= 2"""


def _fconv(s, d):
    key = F.concat_ws("|", "session_id", "agent_id", "criterion_id").alias("doc_id")
    n = FEED(s, d)
    e = panel.feed_edges(n).select(key, "src", "edge_type", "dst")
    m = graph.graph_metrics(n.select(key, "node_id", "node_type", "score"), e).withColumn("max_depth", F.lit(0))
    part = F.split("doc_id", r"\|")
    return panel.panel_convergence(m.where("node_count > 0").select(
        part[0].cast("bigint").alias("session_id"), part[1].alias("agent_id"), part[2].alias("criterion_id"),
        graph.structural_score().alias("structural"), F.lit(10.0).alias("max_score")))


@register("d14_panel_convergence", f"SELECT session_id, criterion_id, agents, {r6('mean_score')} AS mean_score, {r6('variance')} AS variance, variance < 1 AS converged FROM fconv")
def _d14(s, d):
    return _fconv(s, d)


@register("d14_convergence_summary", f"""SELECT session_id, count(*) AS criteria, {r6('avg(variance)')} AS average_variance, bool_and(variance < 1) AS converged FROM fconv GROUP BY session_id""")
def _d14b(s, d):
    return panel.convergence_summary(_fconv(s, d))


_q = lambda x: signal_sql(*quality_sql(x))
CTE["revised"] = f"SELECT d.doc_id, {_q('m.text')} - {_q('d.text')} AS dq FROM documents d JOIN marked m ON m.doc_id = d.doc_id"
CTE["rscores"] = """SELECT doc_id, 'quality' AS criterion_id, quality * 8e0 AS score, 10 * 1e0 AS max_score FROM labels
  UNION ALL SELECT doc_id, 'safety', (1 - toxic) * 12e0, 12 * 1e0 FROM labels"""
_new = clip("score + dq * max_score * 0.3", 0, "max_score")


@register("d15_revision_impact", f"""SELECT s.doc_id, criterion_id, score, {r6('dq')} AS quality_delta, {r6(_new)} AS new_score, {r6(f'{_new} - score')} AS delta
  FROM rscores s JOIN revised r ON r.doc_id = s.doc_id""")
def _d15(s, d):
    quality = lambda df, name: df.select("doc_id", panel.text_quality(F.col("text")).alias(name))
    v = quality(table(s, d, "documents"), "old_quality").join(quality(marked_documents(s, d), "new_quality"), "doc_id")
    return panel.revision_impact(v, run_sql(s, d, "rscores"))


@register("d17_batches", f"""SELECT (row_number() OVER (ORDER BY conv_id, turn) - 1) // 25 AS batch_no, conv_id, turn FROM conversations""")
def _d17(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("o"))
    return panel.batches(c, "o", 25).select("batch_no", "conv_id", "turn")


@register("d17_batch_prompts", """SELECT batch_no, count(*) AS samples, md5(string_agg('### ' || doc_id || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id)) AS prompt
  FROM (SELECT doc_id, text, (row_number() OVER (ORDER BY doc_id) - 1) // 25 AS batch_no FROM documents) GROUP BY batch_no""")
def _d17b(s, d):
    x = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return panel.batch_prompts(panel.batches(x, "id", 25), "id").withColumn("prompt", F.md5(F.col("prompt").cast("binary")))


# --- T4 report tables --------------------------------------------------------------
@register("t4_scorecard", f"""SELECT session_id, m.criterion_id, coalesce(title, m.criterion_id) AS title, {r6('consensus_score')} AS consensus_score, c.max_score AS max_score,
  {r6('weight')} AS weight, {r6('consensus_score * weight')} AS weighted, dissents FROM wmod m LEFT JOIN pcriteria c ON c.criterion_id = m.criterion_id""")
def _t4(s, d):
    return panel.scorecard(MOD(s, d), C(s, d), ["session_id"])


CTE["pgaps"] = """SELECT DISTINCT CAST(floor(user_id / 10) AS BIGINT) AS session_id, event_type AS criterion_id, 'gap at hour ' || hour(ts) AS gap FROM events WHERE value < 1"""


@register("t4_recommendations", f"""SELECT m.session_id, m.criterion_id, title, {r6('consensus_score')} AS consensus_score, {r6('consensus_score / c.max_score')} AS ratio, gap
  FROM wmod m JOIN pcriteria c ON c.criterion_id = m.criterion_id LEFT JOIN pgaps g ON g.session_id = m.session_id AND g.criterion_id = m.criterion_id
  WHERE consensus_score / c.max_score < 0.7""")
def _t4b(s, d):
    return panel.recommendations(MOD(s, d), C(s, d), run_sql(s, d, "pgaps"), ["session_id"])


@register("t4_executive_summary", f"""SELECT o.session_id, {r6('total_score')} AS total_score, {r6('max_possible')} AS max_possible, {r6('percentage')} AS percentage, mark AS pass_mark,
  CASE WHEN percentage >= mark THEN 'PASS' ELSE 'FAIL' END AS result, m.n AS criteria_evaluated, coalesce(r.n, 0) AS debate_rounds, top_strengths, top_weaknesses FROM woverall o
  JOIN (SELECT session_id, count(*) AS n FROM wmod GROUP BY 1) m USING (session_id) LEFT JOIN (SELECT session_id, count(DISTINCT round) AS n FROM pscores GROUP BY 1) r USING (session_id)""")
def _t4_summary(s, d):
    out = panel.executive_summary(panel.overall(MOD(s, d), C(s, d), ["session_id"]), MOD(s, d), P(s, d), C(s, d), ["session_id"])
    return out.withColumns({"top_strengths": F.array_join("top_strengths", "|"), "top_weaknesses": F.array_join("top_weaknesses", "|")})


# nations are the known agents, their domain is their region's number
CTE["pagents"] = "SELECT 'a' || n_nationkey AS agent_id, n_name AS name, 'Reviewer ' || n_nationkey AS role, 'area ' || n_regionkey AS domain FROM nation WHERE n_nationkey <> 2"


@register("t4_panel_list", """SELECT s.session_id, s.agent_id, coalesce(a.name, s.agent_id) AS name, role, domain FROM (SELECT DISTINCT session_id, agent_id FROM pscores) s LEFT JOIN pagents a USING (agent_id)""")
def _t4_panel(s, d):
    return panel.panel_list(P(s, d), run_sql(s, d, "pagents"))


@register("t4_debate_trail", f"""SELECT s.session_id, {big('s.round')} AS round, s.scores, coalesce(x.n, 0) AS disagreements, {r6('drift')} AS drift, coalesce(drift < 0.5, false) AS converged,
  coalesce(challenges, 0) AS challenges, coalesce(moved, 0) AS moved
  FROM (SELECT session_id, round, count(*) AS scores FROM pscores GROUP BY ALL) s
  LEFT JOIN (SELECT session_id, round, count(*) AS n FROM pdis GROUP BY ALL) x ON x.session_id = s.session_id AND x.round = s.round
  LEFT JOIN pdrift d ON d.session_id = s.session_id AND d.round = s.round
  LEFT JOIN (SELECT session_id, round, count(*) AS challenges, count(score_to) AS moved FROM pchallenges GROUP BY ALL) c ON c.session_id = s.session_id AND c.round = s.round""")
def _t4c(s, d):
    return panel.debate_trail(P(s, d), CH(s, d))


@register("q9_lineage", f"""
  SELECT session_id, CAST(0 AS BIGINT) AS stage_no, 'score' AS stage, count(*) AS n FROM pscores GROUP BY session_id
  UNION ALL SELECT session_id, 1, 'debate', count(*) FROM pchallenges GROUP BY session_id
  UNION ALL SELECT session_id, 2, 'moderate', count(*) FROM wmod GROUP BY session_id""")
def _q9(s, d):
    return panel.lineage({"score": P(s, d), "debate": CH(s, d), "moderate": MOD(s, d)})


@register("q4_scores_of_round", f"SELECT session_id, agent_id, criterion_id, {r6('score')} AS score, max_score FROM pscores WHERE round = 2")
def _q4(s, d):
    return P(s, d).where("round = 2").drop("round")


@register("q5_score_history", f"SELECT session_id, {big('round')} AS round, {r6('score')} AS score FROM pscores WHERE agent_id = 'a1' AND criterion_id = 'view'")
def _q5(s, d):
    return P(s, d).where("agent_id = 'a1' and criterion_id = 'view'").select("session_id", "round", "score").orderBy("session_id", "round")
