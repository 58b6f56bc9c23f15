import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from acctlens.operators.rollups import latest_by_key
from acctlens.schemas import MIRROR, parsed
from acctlens.streaming.mirror import Mirror, start_mirror


def changes(n, seed):
    rnd = random.Random(seed)
    for i in range(n):
        ts = datetime(2026, 1, 1) + timedelta(minutes=rnd.randrange(60))
        yield {"Id": f"T{rnd.randrange(40)}", "AccountId": f"A{rnd.randrange(5)}", "ActivityDate": "2026-01-02",
               "IsDeleted": rnd.random() < 0.1, "change_ts": ts.isoformat(), "change_seq": seed * 10000 + i}


@pytest.fixture
def ingest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    mirror = Mirror(str(tmp_path / "mirror"), parsed(MIRROR["sf_task"]))

    def add(seed, n=200):
        (source / f"{seed}.json").write_text("\n".join(json.dumps(c) for c in changes(n, seed)))

    def run(**options):
        start_mirror(spark, mirror, str(source), str(tmp_path / "cp"), **options).awaitTermination()

    def expected():
        return latest_by_key(spark.read.schema(mirror.schema).json(str(source)), "Id", ["change_ts", "change_seq"])

    return mirror, add, run, expected


def same(a, b):
    return a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_mirror_equals_batch(spark, ingest):
    mirror, add, run, expected = ingest
    add(1), add(2), add(3)
    run(max_files=1)                      # three micro-batches, changes out of order
    assert same(mirror.read(spark), expected())
    add(4)
    run()
    assert same(mirror.read(spark), expected())


def test_nothing_before_the_first_batch(spark, ingest):
    mirror, _, _, _ = ingest
    assert mirror.read(spark).count() == 0 and mirror.read(spark).columns == mirror.schema.names


def test_replay(spark, ingest):
    mirror, add, run, expected = ingest
    add(1)
    run()
    before = mirror.read(spark).collect()
    batch = spark.read.schema(mirror.schema).json(str(mirror.folder).replace("mirror", "in"))
    mirror.store_batch(batch, 0)         # the same batch again
    assert sorted(before) == sorted(mirror.read(spark).collect())


def test_many_batches_keep_reads_bounded(spark, tmp_path):
    """Against a replay of all changes in plain Python, with late and repeated rows, through many merges."""
    mirror = Mirror(str(tmp_path / "m"), parsed("Id string, v bigint, change_ts bigint, change_seq bigint"), buckets=4, max_deltas=5)
    rnd, newest, stored = random.Random(5), {}, []
    for batch in range(40):
        rows = [(f"K{rnd.randrange(60)}", rnd.randrange(1000), rnd.randrange(batch + 1), batch * 100 + i) for i in range(6)]
        rows += rnd.sample(stored, min(len(stored), 2))
        stored += rows
        for r in rows:
            newest[r[0]] = max(newest.get(r[0], r), r, key=lambda x: x[2:])
        mirror.store_batch(spark.createDataFrame(rows, mirror.schema), batch)
        folders = mirror.table.version(spark).folders
        assert len(folders) <= mirror.buckets + mirror.max_deltas
        if batch % 13 == 4:
            assert sorted(map(tuple, mirror.read(spark).collect())) == sorted(newest.values())
    files = mirror.read(spark).inputFiles()
    assert len(files) <= mirror.buckets + mirror.max_deltas
    assert sorted(map(tuple, mirror.read(spark).collect())) == sorted(newest.values())
    pinned, number = mirror.read(spark), mirror.table.version(spark).number
    mirror.compact(spark)
    assert sorted(map(tuple, pinned.collect())) == sorted(map(tuple, mirror.read(spark, number).collect())) == sorted(newest.values())
    assert mirror.table.vacuum(spark, keep=1, older_than=-5) and sorted(map(tuple, mirror.read(spark).collect())) == sorted(newest.values())


def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    mirror = Mirror(str(tmp_path / "m"), parsed("Id string, v bigint, change_ts bigint, change_seq bigint"), buckets=8, max_deltas=2)

    def store(n, *keys):
        mirror.store_batch(spark.createDataFrame([(k, n, n, n) for k in keys], mirror.schema), n)

    keys = [f"K{i}" for i in range(100)]
    store(1, *keys), store(2, *keys)
    before = mirror.table.version(spark).notes["base"]
    assert len(before) == 8
    store(3, "K7"), store(4, "K7")
    after = mirror.table.version(spark).notes["base"]
    assert sum(before[k] != after[k] for k in before) == 1
    assert {r["Id"]: r["v"] for r in mirror.read(spark).collect()} == {k: 4 if k == "K7" else 2 for k in keys}


def test_changed_keys(spark, tmp_path):
    mirror = Mirror(str(tmp_path / "m"), parsed("Id string, v bigint, change_ts bigint, change_seq bigint"), max_deltas=4)
    for n in range(1, 4):
        mirror.store_batch(spark.createDataFrame([(f"K{n}", n, n, n), ("all", n, n, n)], mirror.schema), n)
    assert sorted(r[0] for r in mirror.changed_keys(spark, 1).collect()) == ["K2", "K3", "all"]
    assert sorted(r[0] for r in mirror.changed_keys(spark, 0).collect()) == ["K1", "K2", "K3", "all"]
    mirror.compact(spark)
    assert mirror.changed_keys(spark, 1) is None


def test_metrics_over_a_mirror(spark, ingest):
    from acctlens.operators.metrics import activity_metrics

    mirror, add, run, expected = ingest
    add(1)
    run()
    out = activity_metrics(mirror.read(spark), date(2026, 1, 5))
    live = expected().where("IsDeleted = false").count()
    assert out.agg(F.sum("total_activities")).first()[0] == live


def test_ingest_all_and_refresh(spark, tmp_path, sf_dir):
    from acctlens.sources.bench_tables import BenchTables
    from acctlens.sources.tables import Catalog, read_table
    from acctlens.streaming.refresh import ingest_all, object_mirrors, refresh_from_mirrors

    def put(name, *rows):
        folder = tmp_path / "in" / name
        folder.mkdir(parents=True, exist_ok=True)
        stamped = [{"IsDeleted": False, "change_ts": "2026-01-01T00:00:00", "change_seq": i, **r}
                   for i, r in enumerate(rows)]
        (folder / f"{len(list(folder.iterdir()))}.json").write_text("\n".join(map(json.dumps, stamped)))

    account = {"Id": "S1", "Name": "One", "Industry": "x", "AccountSource": "mine",
               "Description": "CDM Key: 3 | Demo Account ID: A-3"}
    put("sf_account", account, {**account, "Id": "S2", "Name": "Two", "AccountSource": "else"})
    put("sf_contact", {"Id": "C1", "AccountId": "S1"}, {"Id": "C2", "AccountId": "S1"})
    put("sf_opportunity", {"Id": "O1", "AccountId": "S1", "Amount": 9.0, "IsClosed": False, "IsWon": False})
    put("sf_case", {"Id": "K1", "AccountId": "S1", "IsClosed": False, "IsEscalated": True, "Priority": "High"})
    put("sf_task", {"Id": "T1", "AccountId": "S1", "ActivityDate": "2026-01-02"})

    mirrors, cat = object_mirrors(str(tmp_path / "m")), Catalog(directory=str(tmp_path / "gold"))
    b = BenchTables(spark, sf_dir)
    orders = {k: v for k, v in b.entities().items() if k.startswith("cur_")}

    def refresh():
        ingest_all(spark, mirrors, str(tmp_path / "in"), str(tmp_path / "cp"))
        refresh_from_mirrors(spark, mirrors, orders, date(2026, 1, 12), "mine", cat)
        return read_table(spark, cat, "customer_360").collect()

    # S2 took over the account id later, so S1 has no mapping and S2 is of another source
    assert refresh() == []
    put("sf_account", {**account, "Id": "S2", "Description": None, "change_ts": "2026-01-03T00:00:00"})
    put("sf_contact", {"Id": "C2", "AccountId": "S1", "IsDeleted": True, "change_ts": "2026-01-03T00:00:00"})
    [row] = refresh()
    assert (row.sf_account_id, row.customer_shipto_key, row.total_contacts) == ("S1", 3, 1)
    assert row.days_since_last_activity == 10 and row.open_pipeline_value == 9.0 and row.total_orders > 0
    assert row.has_escalated_cases and row.escalated_case_count == 1
