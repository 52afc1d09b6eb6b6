"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores. Names given on
the command line replace the default list.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from factloom.plans import catalog  # noqa: E402
from factloom.plans.tables import INPUT_PARTITIONS  # noqa: E402
from factloom.session import local_session  # noqa: E402

HEADLINE = (
    "S4_page_text", "S7_upsert", "T1_clean", "T7_chunks", "T6_sizes", "E6_answer_json", "E7_record_shaping", "E10_predicate_rewrite",
    "E13_record_dedup", "R1_document_batches", "R3_verdict_status", "R4_review_outcomes", "D3_fingerprint", "D4_within_document",
    "D5_cross_document", "D6_cross_type", "D8_global_fingerprint", "D10_exact_duplicates", "D11_three_layers", "L7_link_names",
    "L8_discover", "L12_backfill_links", "M3_pair_requests", "M7_merged_facts", "M10_components", "A2_similar_candidates", "A9_relation_candidates",
    "P2_benchmarks", "P3_competitors", "P4_profiles", "Q1_query_facts", "Q3_document_list", "Q11_graph_edges", "Q13_entity_details",
    "Q14_derived_relations", "Q15_timelines", "Q20_summaries", "Q21_knowledge_base", "K2_quality_issues", "K9_contained_names",
    "K15_lint", "K16_clean_qualifiers", "M1_merge_suggestions", "M9_name_clusters", "E11_completion_requests", "A3_suggestions",
    "L11_link_facts", "ST1_incremental_ingest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cores, shuffle_partitions=max(int(cores), 8), name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set(INPUT_PARTITIONS, cores)  # the tables have one row group each
    queries = catalog.all_queries()
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the session
    took = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    match = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": float(match.group(1)) if match else None}))
    spark.stop()


if __name__ == "__main__":
    main()
