"""Mapping between the customer system's ids, the own account ids and the order-side keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from acctlens.functions import text as tx


def key_mapping(accounts: DataFrame, text_col: str, order: list[str]) -> DataFrame:
    """(sf_account_id, customer_shipto_key, account_id) read from the key text.

    Rows without an account mark drop out, and so do deleted rows where the table has the flag. An
    account id that occurs twice keeps the row that is last in the given order.
    """
    text = F.col(text_col)
    if "IsDeleted" in accounts.columns:
        accounts = accounts.where(~F.coalesce("IsDeleted", F.lit(False)))
    parsed = accounts.select(
        F.col("Id").alias("sf_account_id"),
        tx.parse_cdm_key(text).alias("customer_shipto_key"),
        tx.parse_account_id(text).alias("account_id"),
        F.struct(*order).alias("_order"),
    ).where(F.col("account_id").isNotNull())
    last = F.max_by(F.struct("sf_account_id", "customer_shipto_key"), "_order")
    return parsed.groupBy("account_id").agg(last.alias("_row")).select("_row.*", "account_id")
