"""Time the headline queries (BENCH_ALL=1: every query) at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import importlib.util
import json
import os
import sys
import time

HEADLINE = (
    "latest_per_feed feed_list recent_errors_per_feed due_retries search_entries page_entries reconcile_items "
    "translation_plan sink_entries_upsert refresh_rollup usage_totals usage_by_kind_status latency_percentiles "
    "failure_streak rate_limit_fixed idempotency_bucket job_lifecycle domain_rule_match cidr_block_match chunk_pack "
    "section_split text_clean_corpus language_routing content_choice html_tag_audit html_link_audit reading_stats "
    "thread_assembly thread_markdown outline_paths publish_feed ingest_rss ingest_usage_log"
).split()


def main() -> None:
    here = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, here)
    from feedloom.session import build_session

    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(here, "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = entry.queries()
    names = list(queries) if os.environ.get("BENCH_ALL") else [n for n in HEADLINE if n in queries]
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()
    times = {}
    for name in names:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        if os.environ.get("BENCH_ALL"):
            print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
