"""Explicit schemas of the entity tables, as DDL text, and the fixed feature order."""

from __future__ import annotations

from pyspark.sql import types as T


def parsed(spec: str) -> T.StructType:
    """The schema as an object; needs an active session."""
    return T.StructType.fromDDL(spec)


# Generated customer tables.
CRM_ACCOUNTS = (
    "account_id string, customer_shipto_key bigint, account_name string, industry_segment string, "
    "billing_state string, billing_region string, annual_revenue double, account_status string, "
    "created_date date, owner_rep_name string"
)
CRM_OPPORTUNITIES = (
    "opportunity_id string, account_id string, opportunity_name string, stage_name string, "
    "amount double, close_date date, created_date date, product_family string, probability int, "
    "forecast_category string"
)
CRM_CONTACTS = (
    "contact_id string, account_id string, first_name string, last_name string, title string, "
    "email string, phone string, last_activity_date date, created_date date"
)
CRM_CASES = (
    "case_id string, account_id string, case_type string, status string, priority string, "
    "subject string, created_date date, closed_date date"
)
CRM_ACTIVITIES = (
    "activity_id string, account_id string, activity_type string, subject string, "
    "activity_date date, completed boolean, created_by string"
)

# Change records of the mirrored customer objects, as the ingest job reads them.
_CHANGE = "change_ts timestamp, change_seq bigint"
MIRROR = {
    "sf_account": (
        "Id string, Name string, Industry string, AnnualRevenue double, AccountSource string, "
        f"Description string, IsDeleted boolean, {_CHANGE}"
    ),
    "sf_contact": (f"Id string, AccountId string, IsDeleted boolean, {_CHANGE}"),
    "sf_opportunity": (
        "Id string, AccountId string, Amount double, IsClosed boolean, IsWon boolean, "
        f"Description string, IsDeleted boolean, {_CHANGE}"
    ),
    "sf_case": (
        "Id string, AccountId string, IsClosed boolean, IsEscalated boolean, Priority string, "
        f"IsDeleted boolean, {_CHANGE}"
    ),
    "sf_task": (
        f"Id string, AccountId string, ActivityDate date, IsDeleted boolean, {_CHANGE}"
    ),
}

AUDIT_LOG = (
    "event_time timestamp, source_ip_address string, service_name string, action_name string, "
    "user_identity struct<email:string>, "
    "response struct<status_code:int, error_message:string>, request_params map<string,string>"
)

# Model input, in training order (fixed values).
FEATURES = [
    "annual_revenue", "days_since_last_activity", "total_activities", "recent_activities_90d",
    "total_contacts", "open_pipeline_value", "total_closed_won", "total_closed_lost",
    "total_cases", "open_case_count", "escalated_case_count", "high_priority_open_cases",
    "total_orders", "total_order_value", "backorder_line_count", "total_backorder_qty",
    "pct_qty_backordered", "product_families_purchased",
]
