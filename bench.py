"""Times the headline queries, each after one warm-up run; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from reachline.plans import queries
from reachline.session import build_session, remove_work_paths

HEADLINE = [
    "customer_rollup", "customer_tags", "customer_stats", "customer_search", "recent_orders",
    "order_items_nested", "segment_membership", "segment_sizes", "dispatch_plan",
    "receipts_deduped", "receipt_fold", "event_log", "communications_upsert",
    "status_histogram", "attributed_revenue", "campaign_performance", "campaign_stats",
    "campaign_completion", "communications_page", "conversion_orders", "dashboard_stats",
    "segment_responses", "message_drafts", "segment_membership_many", "segment_saved",
    "constraint_violations", "campaign_communications", "customer_pages",
    "receipt_fold_stream", "communications_stream", "live_campaigns_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session("reachline-bench", f"local[{cores}]", **{
        "spark.sql.shuffle.partitions": cores, "spark.ui.enabled": "false",
        "spark.driver.memory": "6g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    available = queries()

    def run(name: str) -> float:
        begun = time.perf_counter()
        available[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - begun, 3)

    seconds = {}
    for name in HEADLINE:
        run(name)  # compiles the plan's code
        seconds[name] = run(name)
        remove_work_paths(spark)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total",
                      "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
