"""Load of customer tables into the customer system: one payload per object."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from acctlens.functions import codes, text as tx
from acctlens.operators.joins import resolve_fk


def account_payload(accounts: DataFrame, source: str) -> DataFrame:
    return accounts.select(
        F.col("account_name").alias("Name"),
        F.col("industry_segment").alias("Industry"),
        F.col("annual_revenue").alias("AnnualRevenue"),
        tx.key_text(F.col("customer_shipto_key"), F.col("account_id")).alias("Description"),
        F.lit(codes.ACCOUNT_TYPE).alias("Type"),
        F.lit(source).alias("AccountSource"),
    )


def contact_payload(contacts: DataFrame, mapping: DataFrame) -> DataFrame:
    return _with_account(contacts, mapping).select(
        F.col("sf_account_id").alias("AccountId"),
        F.col("first_name").alias("FirstName"),
        F.col("last_name").alias("LastName"),
        F.col("title").alias("Title"),
        F.col("email").alias("Email"),
        F.col("phone").alias("Phone"),
    )


def opportunity_payload(opportunities: DataFrame, mapping: DataFrame) -> DataFrame:
    return _with_account(opportunities, mapping).select(
        F.col("sf_account_id").alias("AccountId"),
        tx.left(F.col("opportunity_name"), codes.NAME_LIMIT).alias("Name"),
        F.col("stage_name").alias("StageName"),
        F.col("amount").alias("Amount"),
        F.col("close_date").cast("string").alias("CloseDate"),
        F.col("probability").alias("Probability"),
        F.col("forecast_category").alias("ForecastCategoryName"),
        F.concat(F.lit("Product Family: "), F.coalesce(F.col("product_family"), F.lit("None"))).alias("Description"),
    )


def case_payload(cases: DataFrame, mapping: DataFrame, origin: str) -> DataFrame:
    return _with_account(cases, mapping).select(
        F.col("sf_account_id").alias("AccountId"),
        tx.left(F.col("subject"), codes.SUBJECT_LIMIT).alias("Subject"),
        codes.case_status(F.col("status")).alias("Status"),
        F.col("priority").alias("Priority"),
        F.col("case_type").alias("Type"),
        F.lit(origin).alias("Origin"),
    )


def task_payload(activities: DataFrame, mapping: DataFrame) -> DataFrame:
    return _with_account(activities, mapping).select(
        F.col("sf_account_id").alias("WhatId"),
        tx.left(F.col("subject"), codes.SUBJECT_LIMIT).alias("Subject"),
        F.col("activity_date").cast("string").alias("ActivityDate"),
        codes.task_status(F.col("completed")).alias("Status"),
        F.lit(codes.TASK_PRIORITY).alias("Priority"),
        F.concat(F.lit("Type: "), F.col("activity_type"), F.lit(" | Created by: "),
                 F.coalesce(F.col("created_by"), F.lit("None"))).alias("Description"),
    )


def _with_account(child: DataFrame, mapping: DataFrame) -> DataFrame:
    matched, _ = resolve_fk(child, mapping.select("account_id", "sf_account_id"))
    return matched
