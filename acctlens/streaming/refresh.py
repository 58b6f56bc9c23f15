"""Ingest of all mirrored objects followed by a rebuild of the gold table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from acctlens.operators.mapping import key_mapping
from acctlens.plans.gold import refresh_gold
from acctlens.schemas import MIRROR, parsed
from acctlens.sources.tables import Catalog
from acctlens.streaming.mirror import Mirror, start_mirror


def object_mirrors(folder: str) -> dict[str, Mirror]:
    """The five mirrored objects, each in its own folder."""
    return {name: Mirror(f"{folder}/{name}", parsed(spec)) for name, spec in MIRROR.items()}


def ingest_all(
    spark: SparkSession, mirrors: dict[str, Mirror], source: str, checkpoint: str, fmt: str = "json"
) -> None:
    """Take in everything that has arrived under ``source/<object>``; the objects run side by side."""
    running = [
        start_mirror(spark, mirror, f"{source}/{name}", f"{checkpoint}/{name}", fmt)
        for name, mirror in mirrors.items()
    ]
    for stream in running:
        stream.awaitTermination()


def refresh_from_mirrors(
    spark: SparkSession, mirrors: dict[str, Mirror], orders: dict[str, DataFrame], as_of: date,
    source: str, cat: Catalog,
) -> None:
    """Full rebuild of the gold table from the mirrors and the order-side tables.

    The key mapping comes from the accounts' key texts; of two accounts with the same own id the
    later changed one counts.
    """
    objects = {name: mirror.read(spark) for name, mirror in mirrors.items()}
    mapping = key_mapping(objects["sf_account"], "Description", ["change_ts", "change_seq"])
    refresh_gold({**objects, "sf_cdm_key_mapping": mapping, **orders}, as_of, source, cat)
