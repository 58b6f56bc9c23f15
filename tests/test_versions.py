"""Versioned tables: readers that survive refreshes, writers that fail or lose, and cleaning up."""

import pytest
from pyspark.sql import functions as F

from acctlens.sources.versions import MANIFESTS, CommitConflict, Files, VersionedTable


@pytest.fixture
def table(tmp_path):
    return VersionedTable(str(tmp_path / "table"))


def numbers(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_versions_follow_each_other(spark, table):
    with pytest.raises(Exception, match="no version"):
        table.read(spark)
    assert table.version(spark).number == 0
    table.overwrite(spark.range(3))
    table.overwrite(spark.range(5).withColumn("more", F.lit("x")), {"why": "schema"})
    assert numbers(table.read(spark)) == [0, 1, 2, 3, 4] and table.read(spark).columns == ["id", "more"]
    assert numbers(table.read(spark, 1)) == [0, 1, 2] and table.read(spark, 1).columns == ["id"]
    assert table.version(spark).notes == {"why": "schema"} and table.numbers(spark) == [1, 2]
    table.overwrite(spark.range(0))
    assert table.read(spark).count() == 0


def test_reader_keeps_its_version(spark, table):
    table.overwrite(spark.range(3))
    early = table.read(spark)
    table.overwrite(early.union(spark.range(3, 4)))
    assert numbers(early) == [0, 1, 2] and numbers(table.read(spark)) == [0, 1, 2, 3]


def test_writer_that_dies_before_the_switch_changes_nothing(spark, table, monkeypatch):
    table.overwrite(spark.range(3))

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(Files, "write_new", killed)
    with pytest.raises(KeyboardInterrupt):
        table.overwrite(spark.range(9))
    monkeypatch.undo()
    assert numbers(table.read(spark)) == [0, 1, 2] and table.numbers(spark) == [1]
    # Its folder lies about until it is old enough.
    assert table.vacuum(spark) == []
    assert len(table.vacuum(spark, older_than=-5)) == 1
    assert numbers(table.read(spark)) == [0, 1, 2]


def test_task_failure_changes_nothing(spark, table):
    table.overwrite(spark.range(3))
    with pytest.raises(Exception):
        table.overwrite(spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("bad row"))).otherwise(F.col("id")).alias("id")))
    assert numbers(table.read(spark)) == [0, 1, 2]


def test_second_of_two_writers_loses(spark, table):
    base = table.overwrite(spark.range(1))
    first, second = table.stage(spark.range(2)), table.stage(spark.range(3))
    table.commit(spark, base, [first], spark.range(1).schema)
    with pytest.raises(CommitConflict):
        table.commit(spark, base, [second], spark.range(1).schema)
    assert numbers(table.read(spark)) == [0, 1]
    assert [n for n in Files(spark, table.folder).names(MANIFESTS) if n.startswith(".") and not n.endswith(".crc")] == []


def test_vacuum_keeps_what_kept_versions_name(spark, table):
    for n in range(1, 6):
        table.overwrite(spark.range(n))
    assert len(table.vacuum(spark, keep=2, older_than=-5)) == 3
    assert table.numbers(spark) == [4, 5]
    assert numbers(table.read(spark, 4)) == [0, 1, 2, 3] and numbers(table.read(spark)) == [0, 1, 2, 3, 4]
