"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from marginalia.plans import registry

HEADLINE = (
    "usg_03_daily_rollup", "usg_04_refresh_rollup", "usg_05_report_by_day", "qta_08_threshold_alerts", "qta_07_reconcile",
    "aud_01_audit_rows", "log_01_latency_report", "sec_01_lockouts", "msk_01_masked_text", "ing_04_exact_duplicates",
    "cln_05_kept_blocks", "cln_06_clean_stats", "src_06_heading_path", "chk_01_token_estimate", "chk_04_sentences",
    "chk_05_chunks", "emb_03_pending_chunks", "emb_06_distinct_texts", "ver_02_active_chunks", "job_01_job_ledger",
    "ret_03_exact_top_k", "ret_09_select_context", "ret_11_lexical_top_k", "ctx_01_context_blocks", "cit_02_citations",
    "ans_01_assembled_answers", "ntf_01_collapse_ten_minutes", "usg_07_stream_rollup", "chk_07_chunk_stats",
    "cln_07_languages", "ret_03_settings_context", "ret_04_approximate_top_k", "ret_10_trace", "ret_14_merge_adjacent",
    "qta_05_reservations",
)


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 16))
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-shared-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = registry.queries()
    spark.read.parquet(f"{base}/events.parquet").count()  # start the JVM's readers before the clock runs
    took = {}
    for name in names:
        start = time.perf_counter()
        known[name](spark, base).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_wall_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(base.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
