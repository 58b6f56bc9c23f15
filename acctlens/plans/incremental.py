"""The gold table as a maintained view: change sets in, rewritten rows of the touched accounts out.

Each side of the gold table is kept as sums and counted values (:mod:`acctlens.operators.maintain`). A
refresh adds its change sets to them, finds the accounts that they touch, makes the gold rows of those accounts from the
states, and puts them into the gold mirror, whose other rows stay. Facts are not read again: scans and shuffles
follow the change sets and the touched accounts. A new date changes the days since the last activity of all accounts, so
all rows are made again then, from the states alone.

Change sets hold rows as they were and as they are. Orders change as wholes: a changed header or line comes with its
header and all lines of its order, on both sides. A change of a dimension (product, sales organisation) needs a rebuild.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from acctlens.functions import risk, text as tx
from acctlens.operators import metrics as m
from acctlens.operators.maintain import Changes, SumState, signed
from acctlens.plans.gold import COLUMNS, ZERO_DEFAULTS, default_zero, risk_flags, with_risk_score
from acctlens.sources.tables import settle
from acctlens.streaming.mirror import Mirror

ACCOUNT, CUSTOMER = "sf_account_id", "customer_shipto_key"
Tables = dict[str, DataFrame]


def _one(test: Column, value: Column | int = 1) -> Column:
    return F.when(test, value).otherwise(0)


def _activity(t: Tables) -> DataFrame:
    return m.drop_deleted(t["sf_task"]).select(F.col("AccountId").alias(ACCOUNT), F.col("ActivityDate").alias("value"))


def _contact(t: Tables) -> DataFrame:
    return m.drop_deleted(t["sf_contact"]).select(F.col("AccountId").alias(ACCOUNT))


def _opportunity(t: Tables) -> DataFrame:
    amount, closed, won = F.col("Amount").cast("double"), F.col("IsClosed"), F.col("IsWon")
    return m.drop_deleted(t["sf_opportunity"]).select(
        F.col("AccountId").alias(ACCOUNT), _one(~closed, amount).alias("open"), _one(won, amount).alias("won"),
        _one(closed & ~won, amount).alias("lost"), _one(closed).alias("n_closed"), _one(won).alias("n_won"),
        F.regexp_extract(F.col("Description"), tx.FAMILY_PATTERN, 1).alias("value"))


def _case(t: Tables) -> DataFrame:
    is_open, high = ~F.col("IsClosed"), F.col("Priority").isin("High", "Critical")
    return m.drop_deleted(t["sf_case"]).select(
        F.col("AccountId").alias(ACCOUNT), _one(is_open).alias("open"), _one(F.col("IsEscalated")).alias("escalated"),
        _one(high & is_open).alias("high"))


def _order(t: Tables) -> DataFrame:
    """A row for each (order, family) of the changed orders; the order's first one stands for it in the count."""
    value, order = F.col("qty_ordered") * F.col("unit_price"), "sales_order_header_key"
    known = m.product_families(t["cur_product"]).withColumn("known", F.lit(1))
    lines = t["cur_sales_order_line"].join(known, "product_key", "left").groupBy(order, F.col("family").alias("value")).agg(
        F.sum(value.cast("decimal(38,9)")).alias("amount"), F.count(value).alias("lines"), F.sum("known").alias("known"))
    first = lines.groupBy(order).agg(F.min(F.struct(F.col("value").isNull().alias("none"), "value")).alias("first"))
    counted = lines.join(first, order).withColumn("orders", F.col("value").eqNullSafe(F.col("first.value")).cast("int"))
    return t["cur_sales_order_header"].select(order, CUSTOMER).join(counted, order).select(
        CUSTOMER, "amount", "lines", "known", "orders", "value")


def _shipment(t: Tables) -> DataFrame:
    return t["cur_shipment_line"].select(
        CUSTOMER, _one(F.col("status_description") == "Backordered").alias("late"), F.col("backorder_qty").alias("back"),
        F.col("total_qty").alias("shipped"))


@dataclass(frozen=True)
class Side:
    """A side of the gold table: the tables it changes with, its rows, and what is kept of them."""

    tables: tuple[str, ...]
    rows: Callable[[Tables], DataFrame]
    key: str
    measures: tuple[str, ...] = ()
    value: T.DataType | None = None


SIDES = {
    "activity": Side(("sf_task",), _activity, ACCOUNT, (), T.DateType()),
    "contact": Side(("sf_contact",), _contact, ACCOUNT),
    "opportunity": Side(("sf_opportunity",), _opportunity, ACCOUNT, ("open", "won", "lost", "n_closed", "n_won"), T.StringType()),
    "case": Side(("sf_case",), _case, ACCOUNT, ("open", "escalated", "high")),
    "order": Side(("cur_sales_order_header", "cur_sales_order_line"), _order, CUSTOMER, ("amount", "lines", "known", "orders"), T.StringType()),
    "shipment": Side(("cur_shipment_line",), _shipment, CUSTOMER, ("late", "back", "shipped")),
}


def _number(name: str, kind: str) -> Column:
    return F.col(name).cast(kind)


@dataclass(frozen=True)
class GoldView:
    """The maintained gold table in a shared folder, for accounts of one source."""

    folder: str
    source: str
    key_type: T.DataType = T.LongType()
    window_days: int = 90
    buckets: int = 16

    def _sums(self, name: str) -> SumState:
        side = SIDES[name]
        return SumState(f"{self.folder}/{name}_sums", (side.key,), (self._type(side.key),), side.measures, self.buckets)

    def _values(self, name: str) -> SumState:
        side = SIDES[name]
        return SumState(f"{self.folder}/{name}_values", (side.key, "value"), (self._type(side.key), side.value), (), self.buckets)

    def _type(self, key: str) -> T.DataType:
        return self.key_type if key == CUSTOMER else T.StringType()

    def _mirror(self, schema: T.StructType) -> Mirror:
        return Mirror(f"{self.folder}/gold", schema, ACCOUNT, ("_refresh",), self.buckets)

    def read(self, spark: SparkSession) -> DataFrame:
        """The gold table as of the last refresh."""
        rows = self._mirror(T.StructType())
        schema = rows.table.version(spark).schema
        return self._mirror(schema).read(spark).where("NOT _gone").select(*COLUMNS)

    def refresh(self, changes: dict[str, Changes], dimensions: Tables, as_of: date) -> None:
        """Take in the change sets (by table) and bring the gold rows of the touched accounts up to date.

        ``dimensions`` are the tables sf_account, sf_cdm_key_mapping, cur_customer_shipto, cur_customer_sales_org and
        cur_product as they are now; change sets of the first two name the accounts that they touch. The first
        refresh takes all rows as new. A refresh that failed is repeated with the same change sets.
        """
        spark = dimensions["sf_account"].sparkSession
        gold = self._mirror(T.StructType())
        number = (gold.last_batch(spark) or 0) + 1
        accounts, customers = [], []
        for name, side in SIDES.items():
            if any(t in changes for t in side.tables):
                for keys in self._take(spark, name, changes, dimensions, number):
                    (accounts if side.key == ACCOUNT else customers).append(keys)
        for table, key in (("sf_account", "Id"), ("sf_cdm_key_mapping", ACCOUNT)):
            accounts += [df.select(F.col(key).alias(ACCOUNT)) for df in changes.get(table, ()) if df is not None]
        mapping = dimensions["sf_cdm_key_mapping"].select(ACCOUNT, CUSTOMER)
        for keys in customers:
            accounts.append(mapping.join(keys.select(CUSTOMER).distinct(), CUSTOMER, "left_semi").select(ACCOUNT))
        # A new date touches all accounts that there are.
        if gold.said(spark).get("as_of", as_of.isoformat()) != as_of.isoformat():
            accounts.append(dimensions["sf_account"].select(F.col("Id").alias(ACCOUNT)))
        touched = spark.createDataFrame([], f"{ACCOUNT} string")
        for keys in accounts:
            touched = touched.unionByName(keys)
        touched = settle(touched.where(F.col(ACCOUNT).isNotNull()).distinct(), "touched")
        rows = self._rows(spark, touched, dimensions, as_of)
        gone = touched.join(rows.select(ACCOUNT), ACCOUNT, "left_anti")
        stamped = rows.withColumn("_gone", F.lit(False)).unionByName(gone.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        stamped = stamped.withColumn("_refresh", F.lit(number).cast("bigint"))
        self._mirror(stamped.schema).store_rows(stamped, number, {"as_of": as_of.isoformat()})

    def _take(self, spark: SparkSession, name: str, changes: dict[str, Changes], dimensions: Tables, number: int) -> list[DataFrame]:
        """Add a side's change set to its states; the keys that it touches."""
        side, parts = SIDES[name], []
        for i in range(2):
            tables = {t: changes.get(t, (None, None))[i] for t in side.tables}
            whole = all(df is not None for df in tables.values())
            parts.append(side.rows({**dimensions, **tables}) if whole else None)
        rows = signed((parts[0], parts[1]), *side.measures)
        if rows is None:
            return []
        rows = settle(rows, "changes")
        keys = [self._sums(name).apply(spark, rows.drop("value"), number)]
        if side.value is not None:
            keys.append(self._values(name).apply(spark, rows.select(side.key, "value", "_rows"), number))
        return keys

    def _rows(self, spark: SparkSession, touched: DataFrame, dimensions: Tables, as_of: date) -> DataFrame:
        """The gold rows of some accounts, from the states."""
        accounts = dimensions["sf_account"].join(touched.withColumnRenamed(ACCOUNT, "Id"), "Id", "left_semi")
        base = settle(m.account_base(accounts, dimensions["sf_cdm_key_mapping"], self.source), "base")
        customers = base.select(CUSTOMER).where(F.col(CUSTOMER).isNotNull()).distinct()
        bound = F.date_sub(F.lit(as_of), self.window_days)

        def sums(name: str) -> DataFrame:
            return self._sums(name).read(spark, touched if SIDES[name].key == ACCOUNT else customers)

        def values(name: str) -> DataFrame:
            return self._values(name).read(spark, touched if SIDES[name].key == ACCOUNT else customers)

        last = values("activity").groupBy(ACCOUNT).agg(
            F.max("value").alias("last_activity_date"), F.datediff(F.lit(as_of), F.max("value")).alias("days_since_last_activity"),
            F.sum(F.when(F.col("value") >= bound, F.col("_rows")).otherwise(0)).alias("recent_activities_90d"))
        families = values("opportunity").groupBy(ACCOUNT).agg(F.array_sort(F.collect_list("value")).alias("opp_product_families"))
        bought = values("order").groupBy(CUSTOMER).agg(
            F.count("value").alias("n_families"), F.concat_ws(", ", F.array_sort(F.collect_list("value"))).alias("families"))
        rate = F.when(F.col("n_closed") > 0, _number("n_won", "double") * 100.0 / _number("n_closed", "double"))
        shipped = F.when(F.col("shipped") > 0, _number("back", "double") * 100.0 / _number("shipped", "double")).otherwise(F.lit(0.0))
        known = F.col("known") > 0
        sides = [
            m.sales_org(dimensions["cur_customer_shipto"].join(customers, CUSTOMER, "left_semi"), dimensions["cur_customer_sales_org"]),
            sums("order").join(bought, CUSTOMER, "left").select(
                CUSTOMER, _number("orders", "bigint").alias("total_orders"), _number("amount", "double").alias("total_order_value"),
                F.when(F.col("lines") > 0, _number("amount", "double") / _number("lines", "double")).alias("avg_line_value"),
                F.when(known, F.coalesce("n_families", F.lit(0))).alias("product_families_purchased"),
                F.when(known, F.coalesce("families", F.lit(""))).alias("product_family_list")),
            sums("shipment").select(
                CUSTOMER, _number("late", "bigint").alias("backorder_line_count"), _number("back", "double").alias("total_backorder_qty"),
                F.round(shipped, 1).alias("pct_qty_backordered")),
            sums("activity").select(ACCOUNT, F.col("_rows").alias("total_activities")),
            last,
            sums("contact").select(ACCOUNT, F.col("_rows").alias("total_contacts")),
            sums("opportunity").select(
                ACCOUNT, _number("open", "double").alias("open_pipeline_value"), _number("won", "double").alias("total_closed_won"),
                _number("lost", "double").alias("total_closed_lost"), F.round(rate, 1).alias("win_rate_pct")),
            families,
            sums("case").select(
                ACCOUNT, F.col("_rows").alias("total_cases"), _number("open", "bigint").alias("open_case_count"),
                _number("escalated", "bigint").alias("escalated_case_count"), _number("high", "bigint").alias("high_priority_open_cases")),
        ]
        for side in sides:
            base = base.join(side, CUSTOMER if CUSTOMER in side.columns else ACCOUNT, "left")
        base = base.withColumns({
            "days_since_last_activity": risk.clamp_days(F.col("days_since_last_activity")),
            # An account with opportunities has a set of families, be it empty.
            "opp_product_families": F.when(F.col("open_pipeline_value").isNotNull(), F.coalesce("opp_product_families", F.array().cast("array<string>")))})
        return settle(with_risk_score(risk_flags(default_zero(base, ZERO_DEFAULTS))).select(*COLUMNS), "gold_rows")
