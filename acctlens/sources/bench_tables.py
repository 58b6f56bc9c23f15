"""The entity tables derived from the star-schema test tables.

Every rule is a plain column expression over whole tables. Account ids are ``AC-<customer key>``.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from acctlens.functions import codes, text as tx
from acctlens.operators.mapping import key_mapping
from acctlens.sources.tables import Catalog, read_table

SOURCE = "CRM Import"
OTHER_SOURCE = "Partner"
EVENTS_AS_OF = date(2024, 1, 31)
AUDIT_AS_OF = datetime(2024, 1, 31)
ORDERS_AS_OF = date(2001, 8, 2)
ACTIVITY_WINDOW = 7
AUDIT_HOURS = 72


class BenchTables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.cat = spark, Catalog(directory=sf_dir, suffix=".parquet")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """A test table; its schema is read once per instance."""
        if name not in self._raw:
            self._raw[name] = read_table(self.spark, self.cat, name)
        return self._raw[name]

    def crm_accounts(self) -> DataFrame:
        """Accounts before the load: own id and order-side key."""
        key = F.col("c_custkey")
        return self.raw("customer").select(
            F.concat(F.lit("A-"), F.lpad(key.cast("string"), 8, "0")).alias("account_id"),
            key.alias("customer_shipto_key"),
            F.col("c_name").alias("account_name"),
            F.col("c_mktsegment").alias("industry_segment"),
            (F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 100).alias("annual_revenue"),
            F.col("c_acctbal").alias("balance"),
        )

    def sf_account(self) -> DataFrame:
        return self.crm_accounts().select(
            F.concat(F.lit("AC-"), F.col("customer_shipto_key")).alias("Id"),
            F.col("account_name").alias("Name"),
            F.col("industry_segment").alias("Industry"),
            F.col("annual_revenue").alias("AnnualRevenue"),
            F.when(F.col("balance") < -500, OTHER_SOURCE).otherwise(SOURCE).alias("AccountSource"),
            tx.key_text(F.col("customer_shipto_key"), F.col("account_id")).alias("Description"),
        )

    def sf_cdm_key_mapping(self) -> DataFrame:
        return key_mapping(self.sf_account(), "Description", ["Id"])

    def _events(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", "event_type", "value", "ts",
            F.concat(F.lit("AC-"), F.col("user_id")).alias("AccountId"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
            (F.col("value") < 1).alias("IsDeleted"),
        )

    def sf_task(self) -> DataFrame:
        return self._events().where("event_type <> 'error'").select(
            F.col("event_id").cast("string").alias("Id"), "AccountId",
            F.col("ts").cast("date").alias("ActivityDate"), "IsDeleted",
        )

    def sf_contact(self) -> DataFrame:
        """One contact per kind of event an account ever had."""
        seen = self.raw("events").select("user_id", "event_type").distinct()
        return seen.select(
            F.concat_ws("-", "user_id", "event_type").alias("Id"),
            F.concat(F.lit("AC-"), F.col("user_id")).alias("AccountId"),
            F.lit(False).alias("IsDeleted"),
        )

    def sf_opportunity(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.raw("orders").select(
            F.col("o_orderkey").cast("string").alias("Id"),
            F.concat(F.lit("AC-"), F.col("o_custkey")).alias("AccountId"),
            F.col("o_totalprice").alias("Amount"),
            (status != "O").alias("IsClosed"),
            (status == "F").alias("IsWon"),
            F.concat(F.lit("Product Family: "), F.col("o_orderpriority")).alias("Description"),
            F.lit(False).alias("IsDeleted"),
        )

    def sf_case(self) -> DataFrame:
        k = F.col("k")
        return self._events().where("event_type = 'error'").select(
            F.col("event_id").cast("string").alias("Id"), "AccountId",
            (F.col("value") < 30).alias("IsClosed"),
            (F.col("value") > 100).alias("IsEscalated"),
            F.when(k >= 95, "Critical").when(k >= 90, "High").when(k >= 40, "Medium")
            .otherwise("Low").alias("Priority"),
            "IsDeleted",
        )

    def cur_customer_shipto(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("customer_shipto_key"),
            F.col("c_nationkey").alias("customer_sales_org_key"),
        )

    def cur_customer_sales_org(self) -> DataFrame:
        nation, region = self.raw("nation"), self.raw("region")
        return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").alias("customer_sales_org_key"),
            F.lit("Rep").alias("rp_emp_first"), F.col("n_name").alias("rp_emp_last"),
            F.lit("Manager").alias("mg_emp_first"), F.col("r_name").alias("mg_emp_last"),
            F.col("n_name").alias("business_unit"), F.col("r_name").alias("rg_code_region"),
        )

    def cur_product(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_key"),
            F.col("p_type").alias("prduct_type_description"),
        )

    def cur_sales_order_header(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("sales_order_header_key"),
            F.col("o_custkey").alias("customer_shipto_key"),
        )

    def cur_sales_order_line(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("sales_order_header_key"),
            F.col("l_partkey").alias("product_key"),
            F.col("l_quantity").alias("qty_ordered"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        )

    def cur_shipment_line(self) -> DataFrame:
        """Shipped lines with their customer, promise date and ship date."""
        back = F.expr("l_returnflag = 'R' AND l_linestatus = 'O'")
        return (
            self.raw("lineitem")
            .join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("o_custkey").alias("customer_shipto_key"),
                F.when(back, "Backordered").otherwise("Shipped").alias("status_description"),
                F.when(back, F.col("l_quantity")).otherwise(0.0).alias("backorder_qty"),
                F.col("l_quantity").alias("total_qty"),
                F.date_add(F.col("o_orderdate").cast("date"), 30).alias("promised_date"),
                F.col("l_shipdate").cast("date").alias("actual_date"),
            )
        )

    def order_revenue(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_custkey").alias("customer_shipto_key"),
            F.col("o_orderdate").alias("order_date"),
            F.col("o_totalprice").alias("order_value"),
        )

    def audit_log(self) -> DataFrame:
        e, user = self.raw("events"), F.col("user_id")
        kind, error = F.col("event_type"), F.col("event_type") == "error"
        block = F.pmod(user, F.lit(3))
        a, b = F.pmod(user, F.lit(256)), F.pmod(F.col("event_id"), F.lit(256))
        head = F.when(block == 0, "13.110.").when(block == 1, "10.0.").otherwise("172.20.")
        return e.select(
            F.col("event_id"),
            F.col("ts").alias("event_time"),
            F.concat(head, a, F.lit("."), b).alias("source_ip_address"),
            F.when(kind.isin("click", "error"), "serving-endpoints").otherwise("accounts").alias("service_name"),
            F.when(kind == "click", "invocation").otherwise(kind).alias("action_name"),
            F.struct(F.concat(F.lit("user"), user, F.lit("@example.com")).alias("email")).alias("user_identity"),
            F.struct(
                F.when(error, 403).otherwise(200).alias("status_code"),
                F.when(error, "request rejected").alias("error_message"),
            ).alias("response"),
        )

    # Customer tables as they look before the load, for the payload and rollup queries.

    def _own_id(self, key: Column) -> Column:
        return F.concat(F.lit("A-"), F.lpad(key.cast("string"), 8, "0"))

    def crm_opportunities(self) -> DataFrame:
        status, prio = F.col("o_orderstatus"), F.col("o_orderpriority")
        stage = (
            F.when(status == "F", "Closed Won").when(status == "P", "Closed Lost")
            .when(prio == "1-URGENT", "Negotiation/Review").when(prio == "2-HIGH", "Proposal/Price Quote")
            .when(prio == "3-MEDIUM", "Qualification").otherwise("Prospecting")
        )
        day = F.col("o_orderdate").cast("date")
        return self.raw("orders").select(
            F.concat(F.lit("O-"), F.col("o_orderkey")).alias("opportunity_id"),
            self._own_id(F.col("o_custkey")).alias("account_id"),
            F.concat(F.lit("Order "), F.col("o_orderkey"), F.lit(" - "), prio).alias("opportunity_name"),
            stage.alias("stage_name"),
            F.col("o_totalprice").alias("amount"),
            F.date_add(day, 60).alias("close_date"),
            prio.alias("product_family"),
        )

    def crm_contacts(self) -> DataFrame:
        seen = self.raw("events").select("user_id", "event_type").distinct()
        return seen.select(
            self._own_id(F.col("user_id")).alias("account_id"),
            F.initcap("event_type").alias("first_name"),
            F.concat(F.lit("User"), F.col("user_id")).alias("last_name"),
            F.lit("Buyer").alias("title"),
            F.concat("event_type", F.lit("."), "user_id", F.lit("@example.com")).alias("email"),
            F.lit("(555) 555-0100").alias("phone"),
        )

    def crm_cases(self) -> DataFrame:
        """Support cases from error events; type and priority follow the event's ``k``."""
        e = self.raw("events").where("event_type = 'error'")
        k, value = F.get_json_object("props", "$.k").cast("int"), F.col("value")
        kinds = F.array(*map(F.lit, codes.CASE_TYPES))
        status = (
            F.when(value > 100, "Escalated").when(value < 30, "Closed").when(value < 60, "In Progress")
            .otherwise("Open")
        )
        return e.select(
            F.col("event_id").cast("string").alias("case_id"),
            self._own_id(F.col("user_id")).alias("account_id"),
            kinds[F.pmod(k, F.lit(6))].alias("case_type"),
            status.alias("status"),
            F.when(k >= 95, "Critical").when(k >= 90, "High").when(k >= 40, "Medium")
            .otherwise("Low").alias("priority"),
        ).withColumn("subject", F.concat("case_type", F.lit(" - "), "account_id"))

    def crm_activities(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").where("event_type <> 'error'").select(
            F.col("event_id").cast("string").alias("activity_id"),
            self._own_id(F.col("user_id")).alias("account_id"),
            F.when(kind == "click", "Call").when(kind == "view", "Email").otherwise("Meeting")
            .alias("activity_type"),
            F.concat(kind, F.lit(" "), F.col("event_id")).alias("subject"),
            F.col("ts").cast("date").alias("activity_date"),
            (F.col("value") >= 5).alias("completed"),
            F.concat(F.lit("Rep "), F.col("user_id")).alias("created_by"),
        )

    def entities(self) -> dict[str, DataFrame]:
        names = [
            "sf_account", "sf_cdm_key_mapping", "sf_task", "sf_contact", "sf_opportunity", "sf_case",
            "cur_customer_shipto", "cur_customer_sales_org", "cur_product", "cur_sales_order_header",
            "cur_sales_order_line", "cur_shipment_line", "order_revenue",
        ]
        return {name: getattr(self, name)() for name in names}
