"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

import contextlib
import io
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "import_projects", "drop_reasons", "boq_trade_rollup", "global_ratios", "price_normalize", "price_report", "bill_items",
    "cost_breakdown", "fee_priority_merge", "crosscheck", "upsert_latest", "duplicate_audit", "training_stats", "sufficiency",
    "coefficient_fallback", "weighted_fusion", "percentile_interval", "full_estimate", "similar_topk", "text_features",
    "intent_labels", "fold_metrics", "residual_stats",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    with contextlib.redirect_stdout(io.StringIO()):
        from takeoff.plans.queries import QUERIES
        from takeoff.session import local_session

        spark = local_session(cpus, "takeoff-bench")
        QUERIES["value_counts"](spark, sf).write.format("noop").mode("overwrite").save()  # start the JVM and the pools
    times = {}
    for name in [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
