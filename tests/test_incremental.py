"""The maintained gold table against a rebuild, after change sets, repeated refreshes and a new date."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from acctlens.operators.maintain import SumState, signed
from acctlens.plans import incremental
from acctlens.plans.gold import build_c360
from acctlens.plans.incremental import GoldView
from acctlens.schemas import parsed
from acctlens.sources import bench_tables as bt

DIMENSIONS = ["sf_account", "sf_cdm_key_mapping", "cur_customer_shipto", "cur_customer_sales_org", "cur_product"]


def plain(gold):
    def value(x):
        return round(x, 6) if isinstance(x, float) else x

    return sorted(tuple(map(value, r)) for r in gold.collect())


@pytest.fixture
def state(tmp_path):
    schema = parsed("key string, value string")
    return SumState(str(tmp_path / "state"), ("key", "value"), tuple(f.dataType for f in schema.fields), ("amount",), 4)


def test_sums_follow_changes(spark, frame, state):
    def rows(*given):
        return frame(list(given), "key string, value string, amount double")

    def now():
        return sorted((r["key"], r["value"], float(r["amount"]), r["_rows"]) for r in state.read(spark).collect())

    touched = state.apply(spark, signed((None, rows(("a", "x", 0.1), ("a", "x", 0.2), ("a", "y", 1.0), ("b", "x", 5.0), (None, "x", 1.0), ("c", None, 1.0))), "amount"), 1)
    assert sorted(r[0] for r in touched.collect()) == ["a", "b"]
    assert now() == [("a", "x", 0.3, 2), ("a", "y", 1.0, 1), ("b", "x", 5.0, 1)]
    change = signed((rows(("a", "x", 0.1), ("b", "x", 5.0)), rows(("a", "z", None), ("d", "x", 2.0))), "amount")
    for _ in range(2):                    # a repeated refresh is applied once
        touched = state.apply(spark, change, 2)
        assert sorted(r[0] for r in touched.collect()) == ["a", "b", "d"]
        assert now() == [("a", "x", 0.2, 1), ("a", "y", 1.0, 1), ("a", "z", 0.0, 1), ("d", "x", 2.0, 1)]
    some = state.read(spark, frame([("a",), ("nobody",)], "key string"))
    assert {r["key"] for r in some.collect()} == {"a"}


def test_reads_open_touched_buckets_only(spark, frame, state):
    rows = frame([(f"k{i}", "x", 1.0) for i in range(200)], "key string, value string, amount double")
    state.apply(spark, signed((None, rows), "amount"), 1)
    state.mirror.compact(spark)
    assert len(state.mirror.read(spark).inputFiles()) == 4
    assert len(state.mirror.read_keys(spark, frame([("k7",)], "key string")).inputFiles()) == 1


def test_view_equals_rebuild(spark, sf_dir, tmp_path, monkeypatch):
    b = bt.BenchTables(spark, sf_dir)
    now = b.entities()
    view = GoldView(str(tmp_path / "view"), bt.SOURCE, window_days=7, buckets=2)
    dimensions = {name: now[name] for name in DIMENSIONS}
    early = now["sf_task"].where("CAST(Id AS BIGINT) % 3 > 0")
    late = now["sf_task"].where("CAST(Id AS BIGINT) % 3 = 0")
    view.refresh({"sf_account": (None, now["sf_account"]), **{t: (None, now[t]) for s in incremental.SIDES.values() for t in s.tables if t != "sf_task"},
                  "sf_task": (None, early)}, dimensions, bt.EVENTS_AS_OF)

    def rebuilt(tables, as_of):
        return plain(build_c360({**now, **tables}, as_of, bt.SOURCE, 7))

    assert plain(view.read(spark)) == rebuilt({"sf_task": early}, bt.EVENTS_AS_OF)
    before = view._mirror(view.read(spark).schema).table.version(spark).folders

    # All cases go, an account changes its source, and the rest of the tasks come; the first try dies half way.
    leaver = now["sf_account"].orderBy("Id").where(F.col("AccountSource") == bt.SOURCE).limit(1)
    accounts = now["sf_account"].join(leaver.select("Id"), "Id", "left_anti")
    changes = {"sf_task": (None, late), "sf_case": (now["sf_case"], None), "sf_account": (leaver, None)}

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(GoldView, "_rows", killed)
    with pytest.raises(KeyboardInterrupt):
        view.refresh(changes, {**dimensions, "sf_account": accounts}, bt.EVENTS_AS_OF)
    monkeypatch.undo()
    assert plain(view.read(spark)) == rebuilt({"sf_task": early}, bt.EVENTS_AS_OF)
    view.refresh(changes, {**dimensions, "sf_account": accounts}, bt.EVENTS_AS_OF)
    after = {"sf_account": accounts, "sf_case": now["sf_case"].limit(0)}
    assert plain(view.read(spark)) == rebuilt(after, bt.EVENTS_AS_OF)
    # Old folders stay: only rows of touched accounts have been written.
    assert set(before) < set(view._mirror(view.read(spark).schema).table.version(spark).folders)

    later = bt.EVENTS_AS_OF + timedelta(days=3)
    view.refresh({}, {**dimensions, "sf_account": accounts}, later)
    assert plain(view.read(spark)) == rebuilt(after, later) and isinstance(later, date)
