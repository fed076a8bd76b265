"""Registered queries against their SQL on the smallest tables.

A quick cross-section by default; PLUMBLINE_ALL=1 runs every query."""

import os

import pytest

from compare import compare, connect
import __spark_entry__ as entry

FOLDER = os.environ.get("FOLDER", "/root/testdata/sf0.001")
QUICK = [
    "document_gate", "p1_sections", "p5d_sentences_ws", "p9_keywords", "p10_reading_grade", "x6_x7_items", "x14_adaptive_essay", "g1_graph_position_metrics",
    "g6_graph_metrics", "g7_support_depth", "m9_mined_facts", "d6_reconcile", "d8_moderate", "b5_per_group", "h4_compare_to_history", "h11_score_timeline",
    "v3_number_consistency", "v15_argument_flow", "r1_r4_predictions", "j1_align_sections", "f3_firewall_verdict", "w2_verify_snippets", "q7_kg_nodes",
    "s3_classify_lots", "s1_read_labeled", "s2_read_text_corpus", "s4_read_framework", "s6_read_graph_scores", "s7_read_score_batches", "s8_read_extractions", "s9_history",
    "s13_write_results", "s16_read_anchors", "b16_split_train_test", "x8_word_jaccard", "w3_verification_summary", "st1_firewall_stream", "st2_evidence_stream", "st3_latest_score_stream", "st4_drift_stream",
    "f2_lexicon_index", "j6_semantic_topk_many", "st1_lexicon_stream", "st2_evidence_windows", "t4_gap_list", "t4_executive_summary", "t4_panel_list", "h10_nearest_rank_percentiles", "d7_trust_update", "g9_pagerank",
    "g10_verify_spans", "g13_quote_check", "m12_quality_violations", "b15_calibrated_score",
]
NAMES = list(entry.queries()) if os.environ.get("PLUMBLINE_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, note = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_contract_needs_no_session():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.oracle_sql()) > 190


def test_event_windows(spark):
    from plumbline.streaming import streams

    schema = spark.read.parquet(f"{FOLDER}/events.parquet").schema
    from pyspark.sql import functions as F
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(FOLDER).select(
        "ts", F.lit("a").alias("agent_id"), F.col("event_type").alias("criterion_id"))
    q = streams.evidence_windows(s).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("w")
    days = spark.read.parquet(f"{FOLDER}/events.parquet").groupBy(F.to_date("ts").alias("d"), "event_type").count()
    last = got.agg(F.max("window_start")).first()[0]
    want = days.where(F.col("d") <= F.to_date(F.lit(last))).agg(F.sum("count")).first()[0]
    assert got.agg(F.sum("nodes")).first()[0] == want
