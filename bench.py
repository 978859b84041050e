"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line, seconds as the median of warm runs."""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "topn_dst_port", "topn_dst_ip", "flows_page", "flows_page_next", "flows_any_ip", "flows_filter_all", "timeseries_scan", "timeseries_rollup", "totals", "event_counts_rule_name", "events_text_search", "rollup_minute", "rollup_hour", "rollup_day",
    "aggregate_5min", "lpm_geo", "asof_identity", "first_seen_destination", "distinct_sliding", "beaconing", "vlan_pairs", "alert_dedupe", "timeline_union", "redact_tokens", "syslog_decode", "ipfix_decode",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from tidewire.plans.registry import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, cold = {}, {}
    for name in HEADLINE:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        cold[name], seconds[name] = round(took[0], 3), round(statistics.median(took[1:]), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "cold": cold, "sf": float(sf[1]) if sf else None, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
