import json

import pytest
from pyspark.sql import functions as F

from acctlens.schemas import AUDIT_LOG, CRM_ACCOUNTS, MIRROR, parsed
from acctlens.sources import logs, outbound, tables as tb


def test_snapshot_replaces_rows_and_schema(spark, frame, tmp_path):
    for cat in (tb.Catalog(directory=str(tmp_path)), tb.Catalog(schema="default")):
        tb.write_snapshot(frame([(1, "a")], "x int, y string"), cat, "snap")
        tb.write_snapshot(frame([(2.5,)], "z double"), cat, "snap")
        out = tb.read_table(spark, cat, "snap")
        assert out.columns == ["z"] and [r.z for r in tb.preview(out).collect()] == [2.5]
    tb.drop_tables(spark, tb.Catalog(schema="default"), ["snap", "never_there"])
    assert not spark.catalog.tableExists("default.snap")


def test_clustered_layout_splits_a_hot_pair(spark):
    df = spark.range(20000).select(
        F.col("id").cast("string").alias("sf_account_id"),
        F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("industry"), F.lit("r").alias("region"))
    out = tb.clustered(df, ["industry", "region"], "sf_account_id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 20000 / 3


@pytest.mark.parametrize("dims, bits", [(1, 5), (2, 1), (2, 5), (3, 3), (4, 2)])
def test_hilbert_curve_takes_one_step_at_a_time(dims, bits):
    from itertools import product

    cells = sorted(product(range(1 << bits), repeat=dims), key=lambda c: tb.hilbert_place(list(c), bits))
    assert sorted(tb.hilbert_place(list(c), bits) for c in cells) == list(range(1 << bits * dims))
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(cells, cells[1:]))


def test_clustered_layout_skips_files_by_either_column(spark, tmp_path):
    """File statistics alone leave out at least half of the files for a filter on one of the columns."""
    import glob

    import pyarrow.parquet as pq

    df = spark.range(40000).select(
        F.col("id").cast("string").alias("sf_account_id"), F.concat(F.lit("i"), F.xxhash64("id") % 6).alias("industry"),
        F.concat(F.lit("r"), F.xxhash64("id", F.lit(2)) % 5).alias("region"), F.lit(1).alias("_curve"))
    df = df.withColumn("region", F.when(F.col("sf_account_id") != "7", F.col("region")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        tb.write_clustered(df, tb.Catalog(directory=str(tmp_path)), "t", ["industry", "region"], "sf_account_id")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    out = tb.read_table(spark, tb.Catalog(directory=str(tmp_path)), "t")
    assert out.exceptAll(df).count() == 0 and out.count() == 40000
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/t/data-*/*.parquet")]
    assert len(files) >= 24
    for name, values in (("industry", [r[0] for r in df.select("industry").distinct().collect()]), ("region", [f"r{i}" for i in range(-4, 5)])):
        for value in values:
            met = 0
            for meta in files:
                at = meta.schema.names.index(name)
                ends = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
                met += any(s.min <= value <= s.max for s in ends)
            assert met <= len(files) / 2, (name, value, met)


def test_refresh_gold(spark, sf_dir, tmp_path):
    from acctlens.operators import metrics as m
    from acctlens.plans.gold import refresh_gold
    from acctlens.sources import bench_tables as bt

    cat = tb.Catalog(directory=str(tmp_path))
    entities = bt.BenchTables(spark, sf_dir).entities()
    for _ in range(2):
        refresh_gold(entities, bt.EVENTS_AS_OF, bt.SOURCE, cat, window_days=7)
    gold = tb.read_table(spark, cat, "customer_360")
    assert gold.count() == m.account_base(
        entities["sf_account"], entities["sf_cdm_key_mapping"], bt.SOURCE).count()
    assert gold.schema["opp_product_families"].dataType.typeName() == "array"


def test_settle_uses_the_shared_folder(spark, frame):
    out = tb.settle(frame([(1,)], "x int"), "t")
    folder = spark.conf.get("spark.checkpoint.dir")
    assert [r.x for r in out.collect()] == [1]
    assert all(folder in f for f in out.inputFiles())


def test_refresh_gold_refuses_double_keys(spark, sf_dir, tmp_path):
    from acctlens.plans.gold import refresh_gold
    from acctlens.sources import bench_tables as bt

    entities = bt.BenchTables(spark, sf_dir).entities()
    twice = entities["sf_cdm_key_mapping"].union(entities["sf_cdm_key_mapping"].limit(1))
    with pytest.raises(ValueError, match="occurs 2 times"):
        refresh_gold({**entities, "sf_cdm_key_mapping": twice}, bt.EVENTS_AS_OF, bt.SOURCE, tb.Catalog(directory=str(tmp_path)))


def test_make_and_conform(spark):
    df = tb.make_table(spark, [("A", 1)], "account_id string, customer_shipto_key int")
    wide = df.withColumns({c: F.lit(None) for c in parsed(CRM_ACCOUNTS).names if c not in df.columns})
    out = tb.conform(wide.withColumn("extra", F.lit(1)), CRM_ACCOUNTS)
    assert out.schema.simpleString() == parsed(CRM_ACCOUNTS).simpleString()
    assert len(parsed(AUDIT_LOG).fields) == 7 and all(parsed(s).fields for s in MIRROR.values())


@pytest.mark.parametrize("rows, parts, batch, framed", [(1, 1, 200, 1), (450, 1, 200, 3), (450, 1, 7, 65), (1500, 4, 200, 8), (0, 1, 200, 0)])
def test_write_outbound(spark, tmp_path, rows, parts, batch, framed):
    df = spark.range(0, rows, 1, parts).select(F.col("id").alias("Id"), F.to_json(F.struct(F.col("id").alias("Id"))).alias("body"))
    outbound.write_outbound(df, str(tmp_path / "feed"), batch=batch)
    batches = outbound.read_batches(spark, str(tmp_path / "feed"))
    lines = [json.loads(r.line) for r in batches.collect()]
    assert sorted(r["Id"] for r in lines) == list(range(rows))
    assert batches.select("batch").distinct().count() == framed
    # Files follow bytes, and the same records make the same batches.
    assert len([f for f in (tmp_path / "feed").iterdir() if f.name.startswith("part-")]) <= 8
    again = outbound.frame_batches(df.repartition(5), batch=batch)
    assert sorted(r.batch for r in again.collect()) == sorted({r.batch for r in batches.collect()})
    assert tuple(outbound.check_batches(batches, batch=batch).first()) == (rows, 0, 0)
    if rows == 450:
        assert outbound.check_batches(batches.union(batches), batch=batch).first()["repeated_ids"] == 450


def test_batches_of_several_groups(spark, monkeypatch):
    monkeypatch.setattr(outbound, "GROUP", 100)
    df = spark.range(1000).select(F.col("id").alias("Id"), F.lit('{"a": "x, [y]"}').alias("body"))
    framed = outbound.frame_batches(df, batch=30).collect()
    assert sum(r.n for r in framed) == 1000 and max(r.n for r in framed) <= 30 and len({r.batch for r in framed}) == len(framed)
    assert sum(len(json.loads(r.line)["records"]) for r in framed) == 1000


def test_ledger_resends_what_is_new_or_failed(spark, frame, tmp_path):
    ledger = outbound.delivery_ledger(str(tmp_path / "ledger"), buckets=2)

    def feed(*rows):
        return frame([*rows], "Id string, body string, _done_ string")

    def waiting(df):
        return sorted((r.Id or "none", r.body) for r in outbound.pending(df, ledger).collect())

    def results(df, **success):
        return df.select(F.col("Id").alias("id"), outbound.digest().alias("digest"), F.create_map(
            *[F.lit(x) for pair in success.items() for x in pair])[F.col("Id")].alias("success"), F.lit(None).cast("string").alias("errors"))

    first = feed(("a", "1", ""), ("b", "1", ""), ("c", "1", ""), (None, "1", ""))
    assert len(waiting(first)) == 4
    outcome = results(first, a=True, b=False)
    for _ in range(2):                    # entered twice
        outbound.record_outcomes(ledger, outcome, 1)
        assert waiting(first) == [("b", "1"), ("c", "1"), ("none", "1")]
    second = feed(("a", "2", ""), ("b", "1", ""), ("c", "1", ""))
    assert waiting(second) == [("a", "2"), ("b", "1"), ("c", "1")]
    outbound.record_outcomes(ledger, results(second, a=True, b=True, c=True), 2)
    assert waiting(second) == [] and waiting(feed(("a", "1", ""))) == []


def test_reconcile(frame):
    results = frame([(3, False, "c"), (1, True, None), (2, False, "b"), (4, None, "d"), (5, False, "e")],
                    "id int, success boolean, errors string")
    assert tuple(outbound.reconcile(results).first()) == (1, 4)
    by = outbound.reconcile(results.withColumn("object", F.col("id") % 2), ["object"])
    assert sorted(tuple(r) for r in by.collect()) == [(0, 0, 2), (1, 1, 2)]
    assert [tuple(r) for r in outbound.first_errors(results).collect()] == [(2, "b"), (3, "c"), (4, "d")]


def test_scan_log(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_text("  CALLOUT_REQUEST\tone \nnothing\nexception\n" + " FATAL " + "x" * 400 + "\n")
    out = sorted(r.value for r in logs.scan_log(logs.read_log(spark, str(path))).collect())
    assert out[0] == "CALLOUT_REQUEST\tone" and len(out) == 2 and len(out[1]) == 300
