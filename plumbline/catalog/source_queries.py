"""Queries over sources and sinks: given tables are written in each format into the
shared folder and read back through the readers.

Files hold a bounded number of records: arrays of up to ``GROUP`` neighbours, or one
record printed over several lines."""

import uuid

from pyspark.sql import functions as F

from plumbline.catalog.base import CTE, big, r6, register, table
from plumbline.operators import agreement as A
from plumbline.session import shared_dir
from plumbline.sources import readers, sinks

GROUP = 1000


def _folder(s, name):
    return f"{shared_dir(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _arrays(rows, key, folder):
    """JSON arrays of up to GROUP records, one for each file."""
    cols = [c for c in rows.columns if c != "_key"]
    packed = rows.withColumn("_group", F.floor(F.col(key) / GROUP)).groupBy("_group").agg(F.to_json(F.collect_list(F.struct(*cols)), {"pretty": "true"}).alias("value"))
    packed.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return folder


@register("s1_read_labeled", f"""SELECT 'c' || c_custkey AS id, c_name AS text, {r6('c_acctbal')} AS expert_score, 12.0::DOUBLE AS max_score,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS domain, '' AS rubric FROM customer""")
def _s1(s, d):
    c = table(s, d, "customer").select(
        F.col("c_custkey").alias("_key"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("text"), F.col("c_acctbal").cast("double").alias("expert_score"),
        F.lit(12.0).alias("max_score"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("domain"), F.lit(1).alias("surplus"))
    return readers.read_labeled(s, _arrays(c, "_key", _folder(s, "s1")))


@register("s2_read_text_corpus", "SELECT text || chr(10) AS text, 'txt' AS doc_type, count(*) AS n FROM benchmark GROUP BY text")
def _s2(s, d):
    folder = _folder(s, "s2")
    table(s, d, "benchmark").select("text").write.option("maxRecordsPerFile", 1).text(folder)
    return readers.read_text_corpus(s, folder).groupBy("text", "doc_type").agg(F.count("*").alias("n"))


@register("s4_read_framework", f"""SELECT 'f' || r_regionkey AS framework_id, r_name AS framework_name, 50.0::DOUBLE + r_regionkey AS pass_mark,
  (SELECT {r6('sum(0.5::DOUBLE + n_nationkey / 10.0)')} FROM nation x WHERE x.n_regionkey = r_regionkey) AS total_weight, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS criterion_no,
  trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g')) AS criterion_id, n_name AS title, {r6('0.5::DOUBLE + n_nationkey / 10.0')} AS weight, 2 AS levels FROM nation JOIN region ON r_regionkey = n_regionkey""")
def _s4(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    level = lambda i: F.struct(F.concat(F.lit(f"level {i} of "), "n_name").alias("level"), F.lit(f"{i}-{i + 1}").alias("score_range"), F.lit("d").alias("descriptor"))
    c = F.struct("n_nationkey", F.col("n_name").alias("title"), F.lit(10.0).alias("max_score"), (0.5 + F.col("n_nationkey") / 10.0).alias("weight"), F.array(level(1), level(2)).alias("rubric"))
    f = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(c)).alias("criteria"))
    rows = f.select(F.col("r_regionkey").alias("_key"), F.concat(F.lit("f"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), (50.0 + F.col("r_regionkey")).alias("pass_mark"), "criteria")
    back = readers.read_framework(s, _arrays(rows, "_key", _folder(s, "s4")))
    return back.select("framework_id", "framework_name", "pass_mark", "total_weight", "criterion_no", "criterion_id", "title", "weight", F.size("rubric_levels").alias("levels"))


@register("s6_read_graph_scores", f"""SELECT 'o' || l_orderkey AS doc_id, l_linenumber AS line, 'n' || l_linenumber AS node_iri, {r6('l_discount')} AS score,
  CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus ELSE '' END AS justification, CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber END AS span_start FROM lineitem""")
def _s6(s, d):
    l = table(s, d, "lineitem")
    node = F.struct(
        "l_linenumber", F.concat(F.lit("n"), "l_linenumber").alias("node_iri"), F.col("l_discount").cast("double").alias("score"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).alias("justification"),
        F.when(F.col("l_linenumber") % 3 == 0, F.array(F.col("l_linenumber").cast("int"), F.lit(99))).alias("source_span"))
    o = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(node)).alias("node_scores"))
    rows = o.select(F.col("l_orderkey").alias("_key"), F.concat(F.lit("o"), "l_orderkey").alias("id"), "node_scores")
    back = readers.read_graph_scores(s, _arrays(rows, "_key", _folder(s, "s6")))
    return back.select("doc_id", F.substring("node_iri", 2, 9).cast("bigint").alias("line"), "node_iri", "score", "justification", F.col("span.start").alias("span_start"))


@register("s7_read_score_batches", f"SELECT 's' || s_suppkey AS id, {r6('s_acctbal')} AS score FROM supplier UNION ALL SELECT 'p' || p_partkey, {r6('p_retailprice')} FROM part")
def _s7(s, d):
    folder = _folder(s, "s7")
    one = table(s, d, "supplier").select(F.col("s_suppkey").alias("_key"), F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_acctbal").cast("double").alias("score"))
    two = table(s, d, "part").select(F.col("p_partkey").alias("_key"), F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_retailprice").cast("double").alias("score"))
    for i, rows in enumerate((one, two), 1):
        _arrays(rows, "_key", f"{folder}/batch_{i}_scores.json")
    _arrays(one, "_key", f"{folder}/other_scores.json")
    return readers.read_score_batches(s, folder)


@register("s8_read_extractions", """SELECT 'o' || l_orderkey AS doc_id, 'claim' AS role, l_linestatus AS text, l_linenumber > 3 AS verifiable, NULL::BOOLEAN AS quantified FROM lineitem
  UNION ALL SELECT 'o' || l_orderkey, 'evidence', l_returnflag, NULL, l_quantity > 25 FROM lineitem""")
def _s8(s, d):
    claim = F.struct(F.col("l_linestatus").alias("text"), F.lit(0.5).alias("specificity"), (F.col("l_linenumber") > 3).alias("verifiable"))
    evidence = F.struct(F.lit("s").alias("source"), F.lit("t").alias("type"), F.col("l_returnflag").alias("text"), (F.col("l_quantity") > 25).alias("quantified"))
    o = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(claim).alias("claims"), F.collect_list(evidence).alias("evidence"))
    rows = o.select(F.col("l_orderkey").alias("_key"), F.concat(F.lit("o"), "l_orderkey").alias("id"), "claims", "evidence")
    return readers.read_extractions(s, _arrays(rows, "_key", _folder(s, "s8"))).select("doc_id", "role", "text", "verifiable", "quantified")


# records in lines, as appended, and records printed over a whole file each
CTE["hfiles"] = """SELECT 'o' || o_orderkey AS id, o_orderpriority AS framework_name, least(o_totalprice / 5000, 100) AS percentage, o_orderdate::TIMESTAMP AS evaluated_at FROM orders
  UNION ALL SELECT 'n' || n_nationkey, n_name, n_nationkey * 1.0, TIMESTAMP '2020-01-01' FROM nation"""


@register("s9_history", f"SELECT id, framework_name, {r6('percentage')} AS percentage, evaluated_at FROM hfiles")
def _s9(s, d):
    folder = _folder(s, "s9")
    o = table(s, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("framework_name"),
                                     F.least(F.col("o_totalprice") / 5000, F.lit(100)).cast("double").alias("percentage"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("evaluated_at"))
    sinks.append_history(o, folder)
    n = table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("framework_name"), F.col("n_nationkey").cast("double").alias("percentage"), F.lit("2020-01-01T00:00:00Z").alias("evaluated_at"))
    n.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode("append").option("maxRecordsPerFile", 1).text(folder)
    return readers.read_history(s, folder).select("id", "framework_name", "percentage", F.col("evaluated_at").cast("timestamp_ntz").alias("evaluated_at"))


@register("s13_write_results", f"SELECT {big('count(*)')} AS samples, {r6('avg(abs(c_acctbal - c_nationkey))')} AS mae, {big('count(*)')} AS rows_written FROM customer")
def _s13(s, d):
    folder = _folder(s, "s13")
    scored = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("predicted"), F.col("c_nationkey").cast("double").alias("actual"), F.lit(12.0).alias("max_score"))
    sinks.write_results(scored, A.agreement(scored, []), folder)
    m = s.read.schema("samples bigint, mae double").json(f"{folder}/metrics")
    n = s.read.schema("id bigint").json(f"{folder}/scores").agg(F.count("*").alias("rows_written"))
    return m.join(n)


@register("s16_read_anchors", f"""SELECT 'p' || p_partkey AS doc_id, {r6('p_retailprice')} AS score, {r6('least(p_size * 100 / 500.0, 2.0)')} AS words, p_size % 4 AS counter, {r6('(p_size % 7) / 5.0')} AS variety,
  CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS thesis FROM part""")
def _s16(s, d):
    size = F.col("p_size").cast("double")
    zero = [F.lit(0.0).alias(n) for n in ("num_cohesion_devices", "num_vocabulary_markers", "num_topic_sentences", "num_personal_voice", "num_rhetorical_devices", "avg_quality")]
    profile = F.struct((size * 100).alias("word_count"), (size % 4).alias("num_counter_arguments"), (size % 7).alias("num_complex_sentences"), *zero, (F.col("p_size") % 2 == 0).alias("has_thesis"))
    rows = table(s, d, "part").select(F.col("p_partkey").alias("_key"), F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_retailprice").cast("double").alias("score"), profile.alias("evidence_profile"))
    p = readers.read_anchors(s, _arrays(rows, "_key", _folder(s, "s16")))
    at = lambda i: F.col("profile")[i]
    return p.select("doc_id", "score", at(0).alias("words"), at(1).cast("bigint").alias("counter"), at(2).alias("variety"), at(8).alias("thesis"))
