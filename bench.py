"""Times the headline queries and prints one JSON line.

Every result is written in full to the ``noop`` sink, so all rows and columns are computed. One
small untimed query starts the JVM's code first. Accounts per second of the briefing are given
because the published figure is a time per account.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from acctlens.queries import registry  # noqa: E402
from acctlens.session import build_session  # noqa: E402

HEADLINE = [
    "order_metrics", "product_coverage", "opp_metrics", "backorder_metrics", "customer_360",
    "account_risk_summary", "feature_matrix", "on_demand_score", "revenue_trend", "delivery_reliability",
    "whitespace_score", "peer_benchmark", "deep_insights", "decide_action", "account_briefing",
    "briefing_payload", "outbound_batches", "metric_by_region_bu", "fk_resolve", "audit_triage",
    "cidr_match", "latest_by_key", "whitespace_families",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry()
    queries["scan_counts"](spark, sf_dir).collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    accounts = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "accounts": accounts,
        "briefing_accounts_per_sec": round(accounts / times["account_briefing"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
