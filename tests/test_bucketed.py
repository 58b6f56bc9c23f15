"""The star over bucketed tables: same rows, and no shuffle of facts."""

import re

from acctlens.plans.gold import build_c360
from acctlens.sources import bench_tables as bt
from acctlens.sources.bucketed import KEYS, co_partition, drop_bucketed
from acctlens.sources.tables import Catalog


def test_no_exchange_of_facts(spark, sf_dir):
    entities = bt.BenchTables(spark, sf_dir).entities()
    cat = Catalog(schema="default")
    tables = co_partition(entities, cat, 4, "bucket_test_")
    try:
        assert all(tables[n].exceptAll(entities[n]).isEmpty() and tables[n].count() == entities[n].count() for n in ("sf_task", "cur_sales_order_line"))
        gold = build_c360(tables, bt.EVENTS_AS_OF, bt.SOURCE, 7)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = build_c360(tables, bt.EVENTS_AS_OF, bt.SOURCE, 7)._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        exchanged = re.findall(r"Exchange hashpartitioning\(([a-zA-Z_]+)#", plan)
        assert exchanged and not {"sales_order_header_key", "AccountId", "product_key"} & set(exchanged), exchanged
        # Above a scan of a fact, before any shuffle, the rows have been reduced; headers this small are broadcast.
        depth, scan = {}, []
        for line in plan.splitlines():
            level = len(line) - len(line.lstrip(" :+-*()0123456789"))
            depth = {k: v for k, v in depth.items() if k < level}
            if "FileScan" in line and any(f"bucket_test_{n.lower()}" in line.lower() for n in KEYS):
                above = [depth[k] for k in sorted(depth, reverse=True)]
                scan.append(above)
                first = next(i for i, node in enumerate(above) if "Exchange" in node)
                assert "BroadcastExchange" in above[first] or any("Aggregate" in node for node in above[:first]), above
            depth[level] = line.strip()
        assert len(scan) >= len(KEYS)
        want = build_c360(entities, bt.EVENTS_AS_OF, bt.SOURCE, 7)

        def plain(df):
            return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())

        assert plain(gold) == plain(want)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        drop_bucketed(spark, cat, "bucket_test_")
