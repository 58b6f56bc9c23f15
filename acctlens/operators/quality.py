"""Checks on keys, lengths and available fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from acctlens.sources.tables import literal_column


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once; empty when the one-row-per-key promise holds."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def assert_unique(df: DataFrame, key: str) -> None:
    worst = duplicate_keys(df, key).orderBy(F.desc("copies"), F.col(key)).first()
    if worst is not None:
        raise ValueError(f"{key}={worst[0]!r} occurs {worst[1]} times")


def length_violations(df: DataFrame, limits: dict[str, int], key: str) -> DataFrame:
    """One row per value longer than its target field: key, field, length, limit."""
    checks = F.array(*[
        F.struct(
            F.lit(field).alias("field"), F.length(field).alias("length"), F.lit(n).alias("max_length")
        )
        for field, n in limits.items()
    ])
    return df.select(key, F.explode(checks).alias("c")).select(key, "c.*").where("length > max_length")


def missing_fields(needed: list[str], df: DataFrame) -> DataFrame:
    """Needed field names the table does not have (schema only, no data read)."""
    spark = df.sparkSession
    want = literal_column(spark, "field", needed)
    have = literal_column(spark, "name", [c.lower() for c in df.columns])
    return want.join(have, F.lower("field") == F.col("name"), "left_anti")


def missing_json_fields(df: DataFrame, json_col: str, needed: list[str]) -> DataFrame:
    """Needed fields that JSON documents lack, with the number of documents lacking each."""
    keys = F.coalesce(F.json_object_keys(F.col(json_col)), F.array().cast("array<string>"))
    lacking = F.array_except(F.array(*map(F.lit, needed)), keys)
    return df.select(F.explode(lacking).alias("field")).groupBy("field").agg(
        F.count(F.lit(1)).alias("rows_missing")
    )


def choose_format(df: DataFrame, needed: list[str]) -> str:
    """'columns' when the target has every typed field, else 'text'."""
    have = {c.lower() for c in df.columns}
    return "columns" if {n.lower() for n in needed} <= have else "text"
