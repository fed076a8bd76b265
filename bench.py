"""Times headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "document_gate", "p1_sections", "p3_word_count", "p5a_sentences_dot15", "p9_keywords", "p10_reading_grade", "p12_significant_numbers",
    "x6_x7_items", "x14_adaptive_essay", "x18_repetition", "g1_graph_position_metrics", "g6_graph_metrics", "g7_support_depth", "g9_pagerank",
    "g10_verify_spans", "g12_completeness", "m9_mined_facts", "v3_number_consistency", "r5_credibility", "j1_align_sections",
    "j6_semantic_topk", "f3_firewall_verdict", "d3_disagreements", "d7_trust_update", "d8_moderate", "b5_per_group",
    "h4_compare_to_history", "h10_nearest_rank_percentiles", "h11_score_timeline", "s14_triples", 
    "st3_latest_score_stream", "validate_all", "b8_deterministic_score", "b6_ablation", "b17_weight_search", "r8_prediction_report", "g14_topology_score",
    "t1_gate", "t2_gate_topology", "d16_scoring_tasks", "w3_verification_summary", "j6_semantic_topk_many", "f3_lexicon_verdict", "h1_median",
]


def main():
    from plumbline.catalog import load_all
    from plumbline.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()[0]
    spark.read.parquet(f"{folder}/documents.parquet").count()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        t0 = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
