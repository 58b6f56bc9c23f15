"""The number of buckets follows the largest fact."""

from acctlens.sources import bench_tables as bt
from acctlens.sources.bucketed import KEYS, bucket_count, co_partition, drop_bucketed
from acctlens.sources.tables import Catalog


def test_buckets_follow_the_largest_fact(spark, sf_dir):
    entities = bt.BenchTables(spark, sf_dir).entities()
    most = max(entities[n].count() for n in KEYS)
    assert bucket_count(entities) == 1 and bucket_count(entities, most) == 1
    assert bucket_count(entities, 1000) == -(-most // 1000) > 1
    cat = Catalog(schema="default")
    empty = {n: df.where("false") for n, df in entities.items()}
    tables = co_partition(empty, cat, prefix="sizes_test_")
    try:
        assert all(tables[n].isEmpty() for n in KEYS)
    finally:
        drop_bucketed(spark, cat, "sizes_test_")
