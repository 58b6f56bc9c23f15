"""The number of tasks follows the input, so that the memory of one does not."""

import pytest

import __spark_entry__ as entry_points
from acctlens.operators import metrics as m
from acctlens.session import fit_tasks
from acctlens.sources.bucketed import ORDER

SETTINGS = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes",
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum")


@pytest.fixture
def settings(spark):
    was = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k in SETTINGS:
        spark.conf.unset(k)
    yield lambda: [spark.conf.get(k, None) for k in SETTINGS]
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_tasks_follow_the_input(spark, settings):
    fit_tasks(spark, 1)
    assert settings() == ["8m", "16m", spark.conf.get("spark.sql.shuffle.partitions")]
    fit_tasks(spark, 6 << 30)
    assert settings() == ["8m", "16m", "768"]
    # What a session has set smaller stays.
    spark.conf.set(SETTINGS[0], "2097152")
    spark.conf.set(SETTINGS[1], "1m")
    fit_tasks(spark, 0)
    assert settings()[:2] == ["2097152", "1m"]


def test_queries_fit_the_session(spark, sf_dir, settings):
    entry_points.queries()["customer_360"](spark, sf_dir)
    assert settings()[:2] == ["8m", "16m"]


def test_order_side_counts_orders_and_families_once(spark, frame):
    header = frame([(1, 7), (1, 7), (2, 7), (3, None), (4, 8), (None, 9)], f"{ORDER} long, customer_shipto_key long")
    line = frame(
        [(1, 10, 2.0, 3.0), (1, 10, 1.0, 1.0), (1, 11, 1.0, 5.0), (2, 10, None, 1.0), (3, 12, 1.0, 1.0), (4, 99, 4.0, 1.0), (None, 10, 1.0, 1.0)],
        f"{ORDER} long, product_key long, qty_ordered double, unit_price double")
    product = frame([(10, "a"), (11, "b"), (12, None)], "product_key long, prduct_type_description string")
    got = {r[0]: tuple(r)[1:] for r in m.order_side(header, line, product).collect()}
    # The header of order 1 is there twice: its values add up, and it counts once.
    assert got == {7: (2, 24.0, 4.0, 2, "a, b"), None: (1, 1.0, 1.0, 0, ""), 8: (1, 4.0, 4.0, None, None)}
