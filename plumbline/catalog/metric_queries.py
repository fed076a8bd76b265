"""Queries over agreement metrics (B), calibration and history (H)."""

from pyspark.sql import functions as F

from plumbline.catalog.base import CTE, big, clip, q, r6, register, run_sql, table, words
from plumbline.catalog.graph_queries import STRUCT, _h
from plumbline.operators import adaptive, agreement as A, calibration as K, graph, history as H

CTE["samples"] = """SELECT event_id AS id, event_type AS rubric, least(value / 12, 10) AS actual, 10 * 1e0 AS max_score,
  least(value / 12 * 0.7 + (event_id % 7) * 0.4 * 1e0, 10) AS predicted FROM events"""
SAMPLES = lambda s, d: run_sql(s, d, "samples")


def metric_sql(src, key):
    """One row per key; a confusion matrix gives kappa, unlike the Spark side."""
    k = key or "1"
    keyed = f"(SELECT *, {k} AS gk FROM {src})"
    return f"""
      SELECT m.gk, samples, pearson_r, CASE WHEN den < 1e-12 THEN 1 ELSE 1 - num / den END AS qwk, mae, mae / top AS nmae, rmse, mean_predicted, mean_actual,
             hallucination_count, hallucination_count * 1.0 / samples AS hallucination_rate
      FROM (SELECT gk, count(*) AS samples, CASE WHEN count(*) < 2 OR count(*) * sqrt(var_pop(predicted) * var_pop(actual)) < 1e-12 THEN 0
                   ELSE covar_pop(predicted, actual) / sqrt(var_pop(predicted) * var_pop(actual)) END AS pearson_r, avg(abs(predicted - actual)) AS mae,
              sqrt(avg((predicted - actual) ** 2)) AS rmse, avg(predicted) AS mean_predicted, avg(actual) AS mean_actual, max(max_score) AS top,
              count(*) FILTER (max_score > 0 AND abs(predicted / max_score - actual / max_score) > 0.3) AS hallucination_count FROM {keyed} GROUP BY gk) m
      JOIN (SELECT o.gk, sum((p - a) * (p - a) * c * 1.0 / n) AS num FROM (SELECT gk, p, a, count(*) AS c FROM ({{r}}) GROUP BY ALL) o JOIN (SELECT gk, count(*) AS n FROM ({{r}}) GROUP BY gk) t
              ON t.gk = o.gk GROUP BY o.gk) x ON x.gk = m.gk
      JOIN (SELECT a.gk, sum((a.p - b.a) * (a.p - b.a) * a.c * 1.0 / n * b.c / n) AS den FROM (SELECT gk, p, count(*) AS c FROM ({{r}}) GROUP BY ALL) a
              JOIN (SELECT gk, a, count(*) AS c FROM ({{r}}) GROUP BY ALL) b ON b.gk = a.gk JOIN (SELECT gk, count(*) AS n FROM ({{r}}) GROUP BY gk) t ON t.gk = a.gk GROUP BY a.gk) y ON y.gk = m.gk""".replace(
        "{r}", f"SELECT gk, greatest(least(round(predicted), floor(top)), 0) AS p, greatest(least(round(actual), floor(top)), 0) AS a FROM (SELECT *, max(max_score) OVER (PARTITION BY gk) AS top FROM {keyed})")


_M = ", ".join([big("samples") + " AS samples"] + [f"{r6(c)} AS {c}" for c in "pearson_r qwk mae nmae rmse mean_predicted mean_actual".split()] +
               [big("hallucination_count") + " AS hallucination_count", r6("hallucination_rate") + " AS hallucination_rate"])
CTE["met_all"] = metric_sql("samples", "")
CTE["met_rubric"] = metric_sql("samples", "rubric")


@register("b1_b4_agreement", f"SELECT {_M} FROM met_all")
def _b1(s, d):
    return A.agreement(SAMPLES(s, d), [])


@register("b5_per_group", f"SELECT gk AS rubric, {_M} FROM met_rubric WHERE samples >= 2")
def _b5(s, d):
    return A.per_group(SAMPLES(s, d))


CTE["hsamples"] = f"SELECT m.doc_id, {STRUCT} AS structural, greatest(c_acctbal, 0) / 1000 AS actual, 12 * 1e0 AS max_score FROM h_metrics m JOIN customer c ON c.c_custkey = m.doc_id"
CTE["abl"] = f"""SELECT config, actual, max_score, CASE WHEN u THEN {clip('structural', 0, 1)} * max_score ELSE max_score * 0.5 END AS predicted FROM hsamples
  CROSS JOIN (VALUES {', '.join(f"({q(n)}, {str(u).lower()})" for n, u in A.ABLATION)}) v(config, u)"""
CTE["met_abl"] = metric_sql("abl", "config")


def _hsamples(s, d):
    n, e = _h(s, d)
    m = graph.metrics_with_depth(n, e)
    c = table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), (F.greatest("c_acctbal", F.lit(0.0)) / 1000).alias("actual"))
    return m.withColumn("structural", graph.structural_score()).join(c, "doc_id").withColumn("max_score", F.lit(12.0))


@register("b6_ablation", f"SELECT gk AS config, {_M} FROM met_abl")
def _b6(s, d):
    return A.ablation(_hsamples(s, d).select("structural", "actual", "max_score"))


CTE["ext_scores"] = "SELECT o_custkey AS id, avg(o_totalprice) / 50000 AS score FROM orders GROUP BY o_custkey"
CTE["joined"] = """SELECT x.score AS predicted, greatest(c_acctbal, 0) / 1000 AS actual, 12 * 1e0 AS max_score, c_custkey FROM ext_scores x JOIN customer c ON c.c_custkey = x.id"""
CTE["met_join"] = metric_sql("joined", "")


def _ext(s, d):
    return table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg((F.avg("o_totalprice") / 50000).alias("score"))


@register("b7_score_join", f"SELECT {_M} FROM met_join")
def _b7(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.greatest("c_acctbal", F.lit(0.0)) / 1000).alias("actual"), F.lit(12.0).alias("max_score"))
    return A.agreement(A.score_join(_ext(s, d), c), [])


CTE["blend_in"] = "SELECT h.structural AS own, x.score AS external, h.actual, h.max_score FROM hsamples h JOIN ext_scores x ON x.id = h.doc_id"
CTE["blend_rows"] = """SELECT 'external' AS kind, external AS predicted, actual, max_score FROM blend_in UNION ALL SELECT 'deterministic', own * max_score, actual, max_score FROM blend_in
  UNION ALL SELECT 'blended', own * max_score * 0.4 + external * 0.6, actual, max_score FROM blend_in"""
CTE["met_blend"] = metric_sql("blend_rows", "kind")


@register("b9_blend", f"SELECT gk AS kind, {_M} FROM met_blend")
def _b9(s, d):
    x = _ext(s, d).select(F.col("id").alias("doc_id"), F.col("score").alias("external"))
    return A.blend(_hsamples(s, d).join(x, "doc_id").select(F.col("structural").alias("own"), "external", "actual", "max_score"))


CTE["band_in"] = "SELECT CAST(l_quantity * 2 AS INT) % 12 / 2 AS actual, l_discount * 40 + l_tax * 10 AS predicted FROM lineitem"


@register("b10_score_bands", f"""SELECT b.band, b.low, b.high, count(s.actual) AS n, {r6('coalesce(avg(predicted), 0)')} AS mean_predicted, {r6('coalesce(avg(predicted) - avg(actual), 0)')} AS mean_delta
  FROM (VALUES {', '.join(f"({q(n)}, {a}::DOUBLE, {z}::DOUBLE)" for a, z, n in A.BANDS)}) b(band, low, high) LEFT JOIN band_in s ON s.actual BETWEEN b.low AND b.high GROUP BY ALL""")
def _b10(s, d):
    return A.score_bands(run_sql(s, d, "band_in"))


CTE["points"] = "SELECT l_orderkey AS document_id, l_returnflag || l_linestatus AS criterion_id, l_quantity / 5 AS expert_score, l_quantity / 6 + l_discount * 10 AS system_score, 10 * 1e0 AS max_score FROM lineitem"
CTE["adjust"] = """SELECT criterion_id, count(*) AS data_points, avg(system_score) - avg(expert_score) AS bias,
  CASE WHEN stddev_samp(system_score) > 0.01 THEN stddev_samp(expert_score) / stddev_samp(system_score) ELSE 1 END AS scale_factor FROM points GROUP BY criterion_id"""
PTS = lambda s, d: run_sql(s, d, "points")


@register("b11_calibrate_bias", f"SELECT criterion_id, data_points, {r6('bias')} AS bias, {r6('scale_factor')} AS scale_factor FROM adjust")
def _b11(s, d):
    return A.calibrate_bias(PTS(s, d))


@register("b11_calibration_summary", f"SELECT count(*) AS data_points, {r6('avg(system_score - expert_score)')} AS overall_bias, {r6('corr(expert_score / max_score, system_score / max_score)')} AS correlation FROM points")
def _b11b(s, d):
    return A.calibration_summary(PTS(s, d))


@register("b12_apply_calibration", f"""SELECT criterion_id, {r6('avg(c)')} AS mean_calibrated, {r6('min(c)')} AS low, {r6('max(c)')} AS high FROM
  (SELECT p.criterion_id, {clip('(system_score - bias) * scale_factor', 0, 'max_score')} AS c FROM points p JOIN adjust a ON a.criterion_id = p.criterion_id) GROUP BY criterion_id""")
def _b12(s, d):
    p = PTS(s, d)
    return A.apply_calibration(p, A.calibrate_bias(p)).groupBy("criterion_id").agg(
        F.avg("calibrated").alias("mean_calibrated"), F.min("calibrated").alias("low"), F.max("calibrated").alias("high"))


# profiles: essay items of the whole text; expert score from the document length
CTE["prof"] = f"""
  SELECT d.doc_id, (length(d.text) % 9) / 2 + 1 AS score, [least(len({words('d.text')}) / 500.0, 2), coalesce(counter_arguments, 0), coalesce(sentence_variety, 0) / 5.0,
    coalesce(cohesion_devices, 0), coalesce(vocabulary_sophistication, 0), coalesce(topic_sentences, 0), coalesce(personal_voice, 0), coalesce(rhetorical_devices, 0) / 5.0,
    CASE WHEN argument_thesis > 0 THEN 1 ELSE 0 END, coalesce(mq, 0)]::DOUBLE[] AS profile
  FROM marked d LEFT JOIN (SELECT doc_id, avg(quality) AS mq, {', '.join(f"count(*) FILTER (category = '{c}') AS {c}" for c in [x for x, _ in K.PROFILE] + ['argument_thesis'])}
    FROM ad_marked GROUP BY doc_id) a ON a.doc_id = d.doc_id"""
from plumbline.catalog.text_queries import _adaptive_cte  # noqa: E402

CTE["ad_marked"] = _adaptive_cte("essay", "marked")
CTE["anch"] = "SELECT doc_id, score, profile, CAST(round(score * 2) AS INT) AS band FROM (SELECT *, row_number() OVER (PARTITION BY CAST(round(score * 2) AS INT) ORDER BY doc_id) AS rn FROM prof) WHERE rn <= 2"
CTE["near"] = f"""SELECT p.doc_id, p.score, a.doc_id AS anchor_id, a.score AS anchor_score, {clip('CASE WHEN list_dot_product(p.profile, p.profile) < 1e-20 OR list_dot_product(a.profile, a.profile) < 1e-20 THEN 0 ELSE list_cosine_similarity(p.profile, a.profile) END', 0, 1)} AS similarity
  FROM prof p CROSS JOIN anch a"""
CTE["nearest"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(similarity, 12) DESC, anchor_score, anchor_id) AS rn FROM near) WHERE rn = 1"


def _prof(s, d):
    from plumbline.catalog.base import marked_documents
    m = marked_documents(s, d).select("doc_id", "text", adaptive.items(F.col("text"), "essay").alias("items"))
    return m.select("doc_id", ((F.length("text") % 9) / 2 + 1).alias("score"), K.evidence_profile(F.col("items"), F.col("text")).alias("profile"))


@register("b13_evidence_profile", "SELECT doc_id, " + ", ".join(f"{r6(f'profile[{i + 1}]')} AS f{i}" for i in range(10)) + " FROM prof")
def _b13(s, d):
    return _prof(s, d).select("doc_id", *[F.col("profile")[i].alias(f"f{i}") for i in range(10)])


@register("b14_anchors", f"SELECT doc_id, {r6('score')} AS score, {big('band')} AS band FROM anch")
def _b14(s, d):
    return K.build_anchors(_prof(s, d), 2).select("doc_id", "score", "band")


def _near(s, d):
    from plumbline.session import cut_lineage
    p = cut_lineage(_prof(s, d))
    return K.nearest_anchor(p, K.build_anchors(p, 2))


@register("j9_nearest_anchor", f"SELECT doc_id, {r6('similarity')} AS similarity FROM nearest")
def _j9(s, d):
    return _near(s, d).select("doc_id", "similarity")


@register("b15_calibrated_score", f"SELECT doc_id, anchor_id, {r6('anchor_score')} AS anchor_score, {r6(clip('4.2 + (anchor_score - 4.2) * similarity * 0.3', 1, 5))} AS calibrated FROM nearest")
def _b15(s, d):
    return K.calibrated_score(_near(s, d).withColumn("external", F.lit(4.2)), "external", F.lit(5.0)).select("doc_id", "anchor_id", "anchor_score", "calibrated")


@register("b16_split_train_test", "SELECT o_orderkey, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) < '8' AS is_train FROM orders")
def _b16(s, d):
    return A.split_train_test(table(s, d, "orders").select("o_orderkey"), "o_orderkey")


FEATS = list(graph.STRUCTURAL_WEIGHTS)
GRID = [(a, b, c, 0.15, dd, 0.10) for a in (0.15, 0.25, 0.35) for b in (0.10, 0.20, 0.30) for c in (0.10, 0.20) for dd in (0.05, 0.10)]
CTE["wfeat"] = f"""SELECT doc_id, least(ln(node_count + 1) / ln(12), 1) AS density, evidence_count * 1.0 / node_count AS ev_ratio, connectivity, evidence_coverage AS coverage,
  least(max_depth / 4.0, 1) AS depth, (CAST(has_counter AS INT) + CAST(has_rebuttal AS INT)) / 2.0 AS counter, greatest(c_acctbal, 0) / 1000 AS actual, 12::DOUBLE AS max_score, doc_id % 2 = 0 AS is_train
  FROM h_metrics JOIN customer ON c_custkey = doc_id"""
_pred = "least(greatest(" + " + ".join(f"{f} * w[{i + 1}]" for i, f in enumerate(FEATS)) + ", 0), 1) * max_score"
CTE["wgrid"] = f"""SELECT g.i AS grid_id, is_train, actual, {_pred} AS p FROM wfeat CROSS JOIN (SELECT unnest(l) AS w, generate_subscripts(l, 1) - 1 AS i FROM
  (SELECT [{', '.join('[' + ', '.join(f'{v}::DOUBLE' for v in w) + ']' for w in GRID)}] AS l)) g"""
_c = lambda f: f"coalesce(covar_pop(p, actual) FILTER ({f}) / nullif(sqrt(var_pop(p) FILTER ({f}) * var_pop(actual) FILTER ({f})), 0), 0)"
_mae = lambda f: f"avg(abs(p - actual)) FILTER ({f})"


@register("b17_weight_search", f"""SELECT grid_id, {r6(_c('is_train'))} AS train_pearson, {r6(_mae('is_train'))} AS train_mae, {r6(_c('NOT is_train'))} AS test_pearson,
  {r6(_mae('NOT is_train'))} AS test_mae, {r6('-' + _c('is_train') + ' + 0.01 * ' + _mae('is_train'))} AS loss FROM wgrid GROUP BY grid_id""")
def _b17(s, d):
    f = _hsamples(s, d)
    f = f.select("doc_id", *[c.alias(k) for k, c in graph.structural_features().items()], "actual", "max_score", (F.col("doc_id") % 2 == 0).alias("is_train"))
    return A.weight_search(f, GRID, FEATS).drop(*[f"w_{n}" for n in FEATS])


# --- H: orders are evaluation records, their lines criterion scores ------------------
CTE["hrec"] = """SELECT o_orderkey AS id, o_orderpriority AS framework_name, 'Order ' || o_orderkey AS document_title, o_orderstatus AS doc_type,
  CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'invoice' END AS document_type, least(o_totalprice / 5000, 100) AS percentage,
  CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice > 200000 END AS passed, o_orderdate AS evaluated_at FROM orders"""
CTE["hcrit"] = """SELECT l_orderkey AS id, 'L' || l_linenumber || l_returnflag AS criterion_title, l_quantity / 5 AS consensus_score, 10 * 1e0 AS max_score, l_quantity * 2 AS percentage FROM lineitem"""


def _hist(s, d):
    r = run_sql(s, d, "hrec")
    c = run_sql(s, d, "hcrit").groupBy("id").agg(F.collect_list(F.struct("criterion_title", "consensus_score", "max_score", "percentage")).alias("criterion_scores"))
    weak = F.transform(F.filter("criterion_scores", lambda x: x["percentage"] < 50), lambda x: x["criterion_title"])
    none = F.array().cast("array<struct<criterion_title:string,consensus_score:double,max_score:double,percentage:double>>")
    return r.join(c, "id", "left").withColumn("criterion_scores", F.coalesce("criterion_scores", none)).withColumn("weaknesses", weak)


@register("h1_batch_summary", f"""SELECT count(*) AS total_documents, {r6('avg(percentage)')} AS mean_score, {r6('stddev_samp(percentage)')} AS std_dev, {r6('min(percentage)')} AS min_score,
  {r6('max(percentage)')} AS max_score, count(*) FILTER (passed) AS pass_count, count(*) FILTER (NOT passed) AS fail_count, {r6('count(*) FILTER (passed) * 100.0 / count(*)')} AS pass_rate FROM hrec""")
def _h1(s, d):
    return H.batch_summary(run_sql(s, d, "hrec"))


@register("h1_median", f"SELECT {r6('median(percentage)')} AS median_score FROM hrec")
def _h1b(s, d):
    return H.median(run_sql(s, d, "hrec"))


@register("h2_criterion_averages", f"""SELECT criterion_title, {r6('avg(c.percentage)')} AS mean_percentage, {r6('stddev_samp(c.percentage)')} AS std_dev,
  (list(document_title ORDER BY c.percentage, document_title))[1] AS weakest_doc, (list(document_title ORDER BY c.percentage DESC, document_title))[1] AS strongest_doc
  FROM hcrit c JOIN hrec r ON r.id = c.id GROUP BY criterion_title""")
def _h2(s, d):
    return H.criterion_averages(_hist(s, d))


@register("h3_score_histogram", """SELECT b.bucket, count(r.id) AS n FROM (SELECT unnest(range(10)) AS bucket) b LEFT JOIN hrec r ON percentage BETWEEN 0 AND 100 AND least(floor(percentage / 10), 9) = b.bucket GROUP BY b.bucket""")
def _h3(s, d):
    return H.score_histogram(run_sql(s, d, "hrec"))


# current records: those after 2000, some of a framework without history; history: all before
CTE["hcur"] = "SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN 'new ' || framework_name ELSE framework_name END AS framework_name) FROM hrec WHERE evaluated_at >= TIMESTAMP '2000-01-01'"
CTE["hpast"] = "SELECT * FROM hrec WHERE evaluated_at < TIMESTAMP '2000-01-01'"


def _split(s, d):
    h = _hist(s, d)
    cut = F.lit("2000-01-01").cast("timestamp")
    new = F.when(F.col("id") % 7 == 0, F.concat(F.lit("new "), "framework_name")).otherwise(F.col("framework_name"))
    return h.where(F.col("evaluated_at") >= cut).withColumn("framework_name", new), h.where(F.col("evaluated_at") < cut)


@register("h4_compare_to_history", f"""SELECT c.id, c.framework_name, {r6('c.percentage')} AS percentage, count(h.id) AS total_compared, {r6('avg(h.percentage)')} AS historical_mean,
  {r6('stddev_samp(h.percentage)')} AS historical_std_dev, {big('floor(count(*) FILTER (h.percentage < c.percentage) * 1.0 / nullif(count(h.id), 0) * 100)')} AS percentile
  FROM hcur c LEFT JOIN hpast h ON h.framework_name = c.framework_name GROUP BY c.id, c.framework_name, c.percentage""")
def _h4(s, d):
    return H.compare_to_history(*_split(s, d))


@register("h4_criterion_comparison", f"""SELECT x.id, x.criterion_title, x.framework_name, {r6('x.percentage')} AS percentage, {r6('h.m')} AS historical_mean, {r6('x.percentage - h.m')} AS delta
  FROM (SELECT c.id, framework_name, criterion_title, k.percentage FROM hcur c JOIN hcrit k ON k.id = c.id) x
  JOIN (SELECT framework_name, criterion_title, avg(k.percentage) AS m FROM hpast c JOIN hcrit k ON k.id = c.id GROUP BY ALL) h ON h.framework_name = x.framework_name AND h.criterion_title = x.criterion_title""")
def _h4b(s, d):
    return H.criterion_comparison(*_split(s, d))


@register("h5_cross_summary", f"SELECT count(*) AS evaluations, {r6('avg(percentage)')} AS mean_score, {r6('stddev_samp(percentage)')} AS std_dev, {r6('min(percentage)')} AS min_score, {r6('max(percentage)')} AS max_score FROM hrec")
def _h5(s, d):
    return H.cross_summary(run_sql(s, d, "hrec"))


CTE["htime"] = "SELECT *, row_number() OVER (ORDER BY evaluated_at, id) AS row_no, count(*) OVER () AS n FROM hrec"
_dl = "(avg(percentage) FILTER (row_no > n // 2) - avg(percentage) FILTER (row_no <= n // 2))"


@register("h6_trend", f"SELECT max(n) AS n, {r6(_dl)} AS delta, CASE WHEN max(n) < 4 THEN 'insufficient_data' WHEN {_dl} > 3 THEN 'improving' WHEN {_dl} < -3 THEN 'declining' ELSE 'stable' END AS trend FROM htime")
def _h6(s, d):
    return H.trend(run_sql(s, d, "hrec"))


@register("h7_weakest_criteria", f"SELECT criterion_title, {r6('avg(percentage)')} AS mean_percentage FROM hcrit WHERE id IN (SELECT id FROM hrec) GROUP BY criterion_title ORDER BY avg(percentage), criterion_title LIMIT 3")
def _h7(s, d):
    return H.weakest_criteria(_hist(s, d))


@register("h8_common_weaknesses", "SELECT criterion_title AS weakness, count(*) AS n FROM hcrit WHERE percentage < 50 AND id IN (SELECT id FROM hrec) GROUP BY criterion_title ORDER BY n DESC, weakness LIMIT 5")
def _h8(s, d):
    return H.common_weaknesses(_hist(s, d))


@register("h9_by_document_type", "SELECT coalesce(nullif(document_type, ''), nullif(doc_type, ''), 'unknown') AS document_type, count(*) AS n FROM hrec GROUP BY 1")
def _h9(s, d):
    return H.by_document_type(run_sql(s, d, "hrec"))


@register("h10_nearest_rank_percentiles", f"""SELECT CAST(p AS BIGINT) AS p, {r6('l[CAST(round(p / 100.0 * (len(l) - 1)) AS BIGINT) + 1]')} AS value FROM (SELECT list_sort(list(percentage)) AS l FROM hrec) CROSS JOIN (SELECT unnest([25, 50, 75]) AS p)""")
def _h10(s, d):
    return H.nearest_rank_percentiles(run_sql(s, d, "hrec"))


@register("h11_score_timeline", f"SELECT row_no, evaluated_at, id, document_title, {r6('percentage')} AS percentage FROM htime")
def _h11(s, d):
    return H.score_timeline(run_sql(s, d, "hrec"))


@register("s10_build_record", f"""SELECT o.session_id, {r6('percentage')} AS percentage, coalesce(w.l, '') AS weaknesses, c.n AS criteria FROM woverall o
  LEFT JOIN (SELECT session_id, string_agg(title || ' (' || CAST(round(consensus_score / c.max_score * 100) AS INT) || '%)', '|' ORDER BY m.criterion_id) AS l
             FROM wmod m JOIN pcriteria c ON c.criterion_id = m.criterion_id WHERE consensus_score / c.max_score * 100 < 50 GROUP BY session_id) w ON w.session_id = o.session_id
  LEFT JOIN (SELECT session_id, count(*) AS n FROM wmod GROUP BY session_id) c ON c.session_id = o.session_id""")
def _s10(s, d):
    from plumbline.catalog.panel_queries import C, MOD
    from plumbline.operators import panel
    m = MOD(s, d)
    o = panel.overall(m, C(s, d), ["session_id"])
    r = H.build_records(o.select("session_id"), o, m, C(s, d))
    return r.select("session_id", "percentage", F.array_join("weaknesses", "|").alias("weaknesses"), F.size("criterion_scores").alias("criteria"))
