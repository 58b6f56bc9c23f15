"""Registered queries: each operator over the whole test tables.

Every entry is a function of (spark, sf_dir). Dates are written as text and arrays as joined
text; sums of doubles are rounded and one mean is cut to single precision, since their last bits
depend on the order of addition.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from acctlens.functions import codes, network as net, text as tx
from acctlens.operators import audit, joins, mapping, metrics as m, peers, quality, rollups
from acctlens.operators.metric_layer import account_metrics
from acctlens.plans import briefing as br, customer_load as load, gold as g, insights as ins, scoring as sc
from acctlens.plans.incremental import GoldView
from acctlens.schemas import FEATURES
from acctlens.session import fit_tasks
from acctlens.sources import bench_tables as bt, logs, outbound
from acctlens.sources.bench_tables import BenchTables
from acctlens.sources.bucketed import co_partition, drop_bucketed
from acctlens.sources.tables import Catalog, literal_column, read_table, scratch_path, settle
from acctlens.sources.versions import Files, VersionedTable
from acctlens.streaming.mirror import Mirror, start_mirror

Query = Callable[[SparkSession, str], DataFrame]

ASSESSED = "2024-01-31T12:00:00.000Z"
# Ranges set aside for documentation, and one that holds a third of the test addresses.
ALLOWED = ["13.110.0.0/15", "192.0.2.0/24", "198.51.100.0/24", "2001:db8::/32"]
LOG_KEYWORDS = ["Licensed", "License", "reserved", "@mail"]
RAW_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Test tables that the gold table is made of.
GOLD_TABLES = ["region", "nation", "customer", "part", "orders", "lineitem", "events"]

_REGISTRY: dict[str, Query] = {}


def query(fn: Callable[[BenchTables], DataFrame]) -> Callable[[BenchTables], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = BenchTables(spark, sf_dir)
        source = Files(spark, tables.cat.directory)
        fit_tasks(spark, sum(source.size(tables.cat.path(name).rsplit("/", 1)[1]) for name in GOLD_TABLES))
        return fn(tables)

    _REGISTRY[fn.__name__] = run
    return fn


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


def _text(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def _rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _gold(b: BenchTables) -> DataFrame:
    return g.build_c360(b.entities(), bt.EVENTS_AS_OF, bt.SOURCE, bt.ACTIVITY_WINDOW)


# Gold tables that have been refreshed, by application, source folder and state of the source.
_REFRESHED: dict[tuple, Catalog] = {}


def _refreshed(b: BenchTables) -> DataFrame:
    """The refreshed gold table, written once per application and state of the source, and then read.

    The state of the source is the newest change of its tables, so changed tables are read anew, as is a
    table whose files have been removed.
    """
    source = Files(b.spark, b.cat.directory)
    changed = max(source.modified(b.cat.path(name).rsplit("/", 1)[1]) for name in GOLD_TABLES)
    key = (b.spark.conf.get("spark.app.id"), b.cat.directory, changed)
    known = _REFRESHED.get(key)
    if known is None or not VersionedTable(known.path("customer_360")).numbers(b.spark):
        cat = Catalog(directory=scratch_path(b.spark, "gold"))
        g.refresh_gold(b.entities(), bt.EVENTS_AS_OF, bt.SOURCE, cat, window_days=bt.ACTIVITY_WINDOW)
        _REFRESHED[key] = cat
    return read_table(b.spark, _REFRESHED[key], "customer_360")


def _scored(b: BenchTables) -> DataFrame:
    return sc.rule_scored(_refreshed(b))


def _coverage(b: BenchTables) -> DataFrame:
    """Customer and family pairs as a written table: the lines are read once for all its uses."""
    pairs = m.customer_families(b.cur_sales_order_header(), b.cur_sales_order_line(), b.cur_product())
    return settle(pairs, "customer_families")


def _scored_and_insights(b: BenchTables) -> tuple[DataFrame, DataFrame]:
    scored = sc.rule_scored(_refreshed(b))
    insights = ins.deep_insights({
        "scored": scored, "customer_families": _coverage(b), "order_revenue": b.order_revenue(),
        "cur_shipment_line": b.cur_shipment_line(), "cur_product": b.cur_product(),
        "cur_customer_shipto": b.cur_customer_shipto(),
    }, bt.ORDERS_AS_OF)
    return scored, insights


def _summary_and_insights(b: BenchTables) -> tuple[DataFrame, DataFrame]:
    scored, insights = _scored_and_insights(b)
    return scored.select(*sc.SUMMARY, "top_risk_driver"), insights


# --- sources -------------------------------------------------------------------------------


@query
def scan_counts(b: BenchTables) -> DataFrame:
    return rollups.row_counts({name: b.raw(name) for name in RAW_TABLES})


@query
def log_filter(b: BenchTables) -> DataFrame:
    lines = logs.text_lines(b.raw("documents"), "doc_id", "text")
    return logs.scan_log(lines, LOG_KEYWORDS, 300)


def _feed(b: BenchTables) -> DataFrame:
    """The change feed, written as files of newline-delimited JSON and read back by batch."""
    path = scratch_path(b.spark, "feed")
    payload = sc.publish(_scored(b), b.sf_account(), ASSESSED)
    outbound.write_outbound(br.outbound_record(payload), path)
    return outbound.read_batches(b.spark, path)


@query
def outbound_batches(b: BenchTables) -> DataFrame:
    """Records, batches over the limit and repeated ids of the written feed."""
    return outbound.check_batches(_feed(b))


@query
def outbound_records(b: BenchTables) -> DataFrame:
    """The batches taken apart again: every record once."""
    return _feed(b).select(
        F.get_json_object("line", "$.Id").alias("id"),
        F.get_json_object("line", "$.attributes.type").alias("kind"),
        F.get_json_object("line", "$.Description").alias("description"),
    )


@query
def outbound_files(b: BenchTables) -> DataFrame:
    """The change feed's files read as JSON."""
    path = scratch_path(b.spark, "feed")
    outbound.write_outbound(br.outbound_record(sc.publish(_scored(b), b.sf_account(), ASSESSED)), path)
    batches = b.spark.read.schema("batch string, records array<struct<Id: string, Description: string>>").json(path)
    return batches.select(F.inline("records"))


@query
def delivery_ledger(b: BenchTables) -> DataFrame:
    """Three runs of a feed of all accounts: a third fails at first, a fifth changes later. How often each was sent, and to what end."""
    ledger = outbound.delivery_ledger(scratch_path(b.spark, "ledger"), buckets=4)
    record = F.to_json(F.struct("Id", F.col("Description")), {"ignoreNullFields": "false"})
    number = F.col("customer_shipto_key")
    accounts = b.sf_account().join(b.sf_cdm_key_mapping().select(F.col("sf_account_id").alias("Id"), number), "Id")
    early = accounts.select("Id", record.alias("body"))
    changed = F.when(number % 5 == 0, F.concat("Description", F.lit(" | moved"))).otherwise(F.col("Description"))
    late = accounts.withColumn("Description", changed).select("Id", record.alias("body"))
    sent = []
    for run, feed in enumerate((early, late, late), 1):
        waiting = settle(outbound.pending(feed, ledger), "waiting")
        path = scratch_path(b.spark, "feed")
        outbound.write_outbound(waiting, path)
        lines = outbound.read_batches(b.spark, path)
        key = F.get_json_object("line", "$.Id")
        results = settle(lines.select(
            key.alias("id"), outbound.digest("line").alias("digest"), "batch",
            F.lit(True if run > 1 else None).alias("sure"), F.substring(key, 4, 20).cast("bigint").alias("n")), "results")
        results = results.withColumn("success", F.col("sure").isNotNull() | (F.col("n") % 3 > 0)).withColumn(
            "errors", F.when(~F.col("success"), "rejected"))
        outbound.record_outcomes(ledger, results, run)
        sent.append(results.select("id", "batch"))
    times = reduce(DataFrame.unionByName, sent).groupBy("id").agg(F.count(F.lit(1)).alias("sent"))
    known = ledger.read(b.spark).groupBy("id").agg(F.count_if("success").alias("delivered"), F.count_if(~F.col("success")).alias("failed"))
    return times.join(known, "id")


def _results(b: BenchTables) -> DataFrame:
    failed = F.col("event_type") == "error"
    return b.raw("events").select(
        F.col("event_id").alias("id"), (~failed).alias("success"),
        F.when(failed, F.concat(F.lit("rejected "), "props")).alias("errors"),
    )


@query
def reconcile_results(b: BenchTables) -> DataFrame:
    return outbound.reconcile(_results(b))


@query
def reconcile_objects(b: BenchTables) -> DataFrame:
    """Deliveries per object; the parity of the id stands for it."""
    kind = F.when(F.col("id") % 2 == 0, "Account").otherwise("Contact").alias("object")
    return outbound.reconcile(_results(b).select("*", kind), ["object"])


@query
def reconcile_errors(b: BenchTables) -> DataFrame:
    return outbound.first_errors(_results(b), n=3)


# --- gold table and its parts ----------------------------------------------------------------


@query
def account_base(b: BenchTables) -> DataFrame:
    return m.account_base(b.sf_account(), b.sf_cdm_key_mapping(), bt.SOURCE)


@query
def sales_org(b: BenchTables) -> DataFrame:
    return m.sales_org(b.cur_customer_shipto(), b.cur_customer_sales_org())


@query
def activity_metrics(b: BenchTables) -> DataFrame:
    out = m.activity_metrics(b.sf_task(), bt.EVENTS_AS_OF, bt.ACTIVITY_WINDOW)
    return _text(out, "last_activity_date")


@query
def contact_metrics(b: BenchTables) -> DataFrame:
    return m.contact_metrics(b.sf_contact())


@query
def opp_metrics(b: BenchTables) -> DataFrame:
    out = m.opp_metrics(b.sf_opportunity())
    out = out.withColumn("opp_product_families", F.array_join("opp_product_families", "|"))
    return _rounded(out, 2, "open_pipeline_value", "total_closed_won", "total_closed_lost")


@query
def case_metrics(b: BenchTables) -> DataFrame:
    return m.case_metrics(b.sf_case())


@query
def order_metrics(b: BenchTables) -> DataFrame:
    out = m.order_metrics(b.cur_sales_order_header(), b.cur_sales_order_line())
    out = _rounded(out, 2, "total_order_value")
    return out.withColumn("avg_line_value", F.col("total_order_value") / F.col("valued_lines"))


@query
def backorder_metrics(b: BenchTables) -> DataFrame:
    return m.backorder_metrics(b.cur_shipment_line())


@query
def product_coverage(b: BenchTables) -> DataFrame:
    return m.product_coverage(b.cur_sales_order_header(), b.cur_sales_order_line(), b.cur_product())


def _gold_output(gold: DataFrame) -> DataFrame:
    out = _text(gold, "last_activity_date")
    out = out.withColumn("opp_product_families", F.array_join("opp_product_families", "|"))
    out = _rounded(out, 2, "open_pipeline_value", "total_closed_won", "total_closed_lost", "total_order_value")
    return out.withColumn("avg_line_value", F.col("avg_line_value").cast("float").cast("double"))


@query
def customer_360(b: BenchTables) -> DataFrame:
    return _gold_output(_gold(b))


@query
def gold_table(b: BenchTables) -> DataFrame:
    """The gold table written in its clustered layout and read back."""
    cat = Catalog(directory=scratch_path(b.spark, "tables"))
    g.refresh_gold(b.entities(), bt.EVENTS_AS_OF, bt.SOURCE, cat, window_days=bt.ACTIVITY_WINDOW)
    return _gold_output(read_table(b.spark, cat, "customer_360"))


@query
def bucketed_gold(b: BenchTables) -> DataFrame:
    """The gold table over facts that are bucketed by their keys."""
    prefix = f"acctlens_{uuid.uuid4().hex}_"
    tables = co_partition(b.entities(), Catalog(schema="default"), prefix=prefix)
    gold = settle(g.build_c360(tables, bt.EVENTS_AS_OF, bt.SOURCE, bt.ACTIVITY_WINDOW), "gold")
    drop_bucketed(b.spark, Catalog(schema="default"), prefix)
    return _gold_output(gold)


def _change_sets(b: BenchTables) -> tuple[dict, dict]:
    """(the tables as they were, as first change sets; what has changed since): added, moved, withdrawn and altered rows."""
    now, part = b.entities(), F.xxhash64
    first: dict = {}
    later: dict = {}

    def put(name: str, key: str, moved: dict | None = None) -> None:
        """Of ten rows one is new, one has been altered, and one was there twice under another key."""
        turn = F.pmod(part(key), F.lit(10))
        df = now[name]
        was = df.where(turn == 1).withColumns(moved or {})
        extra = df.where(turn == 2).withColumns(moved or {})
        first[name] = (None, df.where(turn > 1).unionByName(was).unionByName(extra))
        later[name] = (was.unionByName(extra), df.where(turn.isin(0, 1)))

    other = {"AccountId": F.lit("AC-3")}
    put("sf_task", "Id", {**other, "ActivityDate": F.lit("2024-01-31").cast("date")})
    put("sf_contact", "Id", other)
    put("sf_opportunity", "Id", {**other, "Amount": F.lit(7.5), "Description": F.lit("Product Family: withdrawn")})
    put("sf_case", "Id", {**other, "IsEscalated": F.lit(True)})
    # Orders come with their lines.
    order = "sales_order_header_key"
    turn, lines = F.pmod(part(order), F.lit(10)), now["cur_sales_order_line"]
    header = now["cur_sales_order_header"]
    moved = header.where(turn == 1).withColumn("customer_shipto_key", F.lit(5).cast("bigint"))
    first["cur_sales_order_header"] = (None, header.where(turn > 1).unionByName(moved))
    first["cur_sales_order_line"] = (None, lines.where(turn > 0))
    later["cur_sales_order_header"] = (moved, header.where(turn < 2))
    later["cur_sales_order_line"] = (lines.where(turn == 1), lines.where(turn < 2))
    shipped, late = now["cur_shipment_line"], F.pmod(F.col("customer_shipto_key"), F.lit(10)) == 0
    first["cur_shipment_line"] = (None, shipped.where(~late).unionByName(shipped.where(late).withColumn("backorder_qty", F.lit(1.0))))
    later["cur_shipment_line"] = (shipped.where(late).withColumn("backorder_qty", F.lit(1.0)), shipped.where(late))
    changed = now["sf_account"].where(F.pmod(part("Id"), F.lit(10)) == 0)
    first["sf_account"] = (None, now["sf_account"])
    later["sf_account"] = (changed.withColumn("Name", F.lit("former")), changed)
    return first, later


@query
def incremental_gold(b: BenchTables) -> DataFrame:
    """The gold table built from earlier tables and then brought up to date by change sets alone."""
    first, later = _change_sets(b)
    names = ["sf_account", "sf_cdm_key_mapping", "cur_customer_shipto", "cur_customer_sales_org", "cur_product"]
    now = b.entities()
    dimensions = {name: now[name] for name in names}
    part = F.pmod(F.xxhash64("Id"), F.lit(10))
    was = {**dimensions, "sf_account": now["sf_account"].withColumn("Name", F.when(part == 0, "former").otherwise(F.col("Name")))}
    view = GoldView(scratch_path(b.spark, "view"), bt.SOURCE, window_days=bt.ACTIVITY_WINDOW)
    view.refresh(first, was, bt.EVENTS_AS_OF)
    view.refresh(later, dimensions, bt.EVENTS_AS_OF)
    return _gold_output(view.read(b.spark))


@query
def risk_score_raw(b: BenchTables) -> DataFrame:
    return _refreshed(b).select("sf_account_id", "risk_score_raw")


@query
def risk_flags(b: BenchTables) -> DataFrame:
    return _refreshed(b).select("sf_account_id", "is_stale_account", "has_escalated_cases", "has_backorders")


@query
def cap_audit(b: BenchTables) -> DataFrame:
    return rollups.cap_audit(_refreshed(b))


# --- scoring ---------------------------------------------------------------------------------


@query
def feature_matrix(b: BenchTables) -> DataFrame:
    money = ["open_pipeline_value", "total_closed_won", "total_closed_lost", "total_order_value"]
    return _rounded(sc.feature_matrix(_refreshed(b)), 2, *money)


@query
def json_roundtrip(b: BenchTables) -> DataFrame:
    """Feature records written as JSON and read back."""
    records = sc.feature_json(sc.feature_matrix(_refreshed(b)))
    back = F.from_json("record", ", ".join(f"{c} double" for c in FEATURES)).alias("f")
    return records.select("sf_account_id", back).select(
        "sf_account_id", "f.annual_revenue", "f.days_since_last_activity", "f.total_orders",
        "f.pct_qty_backordered", "f.product_families_purchased",
    )


@query
def risk_category_counts(b: BenchTables) -> DataFrame:
    return rollups.category_counts(_scored(b))


@query
def top_risk_driver(b: BenchTables) -> DataFrame:
    return _scored(b).select("sf_account_id", "top_risk_driver")


@query
def account_risk_summary(b: BenchTables) -> DataFrame:
    """The published summary, written and read back."""
    cat = Catalog(directory=scratch_path(b.spark, "summary"))
    sc.publish_summary(_scored(b), cat)
    return _rounded(read_table(b.spark, cat, "account_risk_summary"), 2, "open_pipeline_value")


@query
def top_risk_accounts(b: BenchTables) -> DataFrame:
    top = rollups.top_k(_scored(b), [F.desc("ml_risk_score"), F.col("sf_account_id")], 15)
    return top.select("sf_account_id", "account_name", "ml_risk_score", "risk_category")


def _requests(b: BenchTables) -> DataFrame:
    """One scoring request per event; some name an account that does not exist."""
    k = F.get_json_object("props", "$.k").cast("double")
    return b.raw("events").select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("AC-"), F.col("user_id") * 11).alias("sf_account_id"),
        F.when(k >= 50, k).alias("days_since_last_activity"),
    )


@query
def on_demand_score(b: BenchTables) -> DataFrame:
    return sc.on_demand_score(_requests(b), _refreshed(b))


def _model(b: BenchTables) -> tuple[DataFrame, PipelineModel]:
    """The refreshed gold table and a model of its composite score, trained on unfilled features."""
    gold = _refreshed(b)
    labelled = sc.raw_features(gold).join(gold.select("sf_account_id", "risk_score_raw"), "sf_account_id")
    return gold, sc.train(labelled, "risk_score_raw")


@query
def ml_score(b: BenchTables) -> DataFrame:
    gold, model = _model(b)
    scored = sc.model_scored(gold, sc.score(sc.raw_features(gold), model))
    return scored.select("sf_account_id", "ml_risk_score", "risk_category", "top_risk_driver")


@query
def ml_score_checks(b: BenchTables) -> DataFrame:
    """What must hold of the model's scores: all accounts, each once, and a small mean error."""
    gold, model = _model(b)
    both = sc.score(sc.raw_features(gold), model).join(gold.select("sf_account_id", "risk_score_raw"), "sf_account_id")
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("sf_account_id").alias("accounts"),
        (F.avg(F.abs(F.col("ml_risk_score") - F.col("risk_score_raw"))) < 3).alias("small_error"),
    )


@query
def ml_importances(b: BenchTables) -> DataFrame:
    return sc.feature_importances(_model(b)[1])


@query
def ml_importance_checks(b: BenchTables) -> DataFrame:
    return sc.feature_importances(_model(b)[1]).agg(
        F.count(F.lit(1)).alias("features"), F.round(F.sum("importance"), 6).alias("total"),
        (F.min("importance") >= 0).alias("none_negative"),
    )


def _cross_validated(b: BenchTables) -> DataFrame:
    gold = _refreshed(b)
    labelled = sc.raw_features(gold).join(gold.select("sf_account_id", "risk_score_raw"), "sf_account_id")
    return sc.cross_validate(labelled, "risk_score_raw", folds=4, rounds=8)


@query
def ml_folds(b: BenchTables) -> DataFrame:
    """A row per fold: its rows, those trained on, the error of their mean, and whether the model does better."""
    folds = _cross_validated(b)
    return folds.select("fold", "rows", "trained", F.round("mean_error", 6).alias("mean_error"), (F.col("error") < F.col("mean_error")).alias("better"))


@query
def ml_permutation(b: BenchTables) -> DataFrame:
    """What the error of a model gains when a feature's values change places among the accounts."""
    gold, model = _model(b)
    labelled = sc.raw_features(gold).join(gold.select("sf_account_id", "risk_score_raw"), "sf_account_id")
    return sc.permutation_importances(model, labelled, "risk_score_raw")


@query
def ml_permutation_checks(b: BenchTables) -> DataFrame:
    """What must hold of it: all features, and the days without activity, which make the score, matter."""
    days = F.max(F.when(F.col("feature") == "days_since_last_activity", F.col("gain")))
    return ml_permutation(b).agg(F.count(F.lit(1)).alias("features"), (days > 0.1).alias("days_matter"))


# --- rollups, lookups and load ---------------------------------------------------------------


@query
def story_check(b: BenchTables) -> DataFrame:
    out = rollups.story_check(
        b.crm_accounts(), b.crm_activities(), b.crm_cases(), b.crm_opportunities()
    )
    return _text(out, "last_activity_date")


@query
def stage_summary(b: BenchTables) -> DataFrame:
    return rollups.summarize(
        b.crm_opportunities(), ["stage_name"],
        {"deals": F.count(F.lit(1)), "total_value": F.round(F.sum("amount"), 2)}, [F.col("stage_name")],
    )


@query
def family_summary(b: BenchTables) -> DataFrame:
    return rollups.summarize(
        b.crm_opportunities(), ["product_family"],
        {"deals": F.count(F.lit(1)), "total_value": F.round(F.sum("amount"), 2)},
        [F.desc("total_value"), F.col("product_family")],
    )


@query
def case_matrix(b: BenchTables) -> DataFrame:
    return rollups.summarize(
        b.crm_cases(), ["case_type", "status"], {"cases": F.count(F.lit(1))},
        [F.col("case_type"), F.col("status")],
    )


@query
def stage_forecast(b: BenchTables) -> DataFrame:
    stage = F.col("stage_name")
    return b.crm_opportunities().select(
        "opportunity_id", "stage_name",
        codes.stage_probability(stage).alias("probability"),
        codes.stage_forecast(stage).alias("forecast_category"),
    )


@query
def segment_lookup(b: BenchTables) -> DataFrame:
    """Customers by the name of their nation and, as names the lookup does not have, of their region."""
    nation, region = b.raw("nation"), b.raw("region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    segments = places.select("n_name", F.col("r_name").alias("segment"), F.col("n_nationkey").alias("rank"))
    named = b.raw("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    names = named.select("c_custkey", F.explode(F.array("n_name", "r_name")).alias("n_name"))
    return joins.classify_by_lookup(names, segments, "n_name", "Regional Lab")


@query
def account_owner(b: BenchTables) -> DataFrame:
    accounts = b.crm_accounts().select("account_id", "customer_shipto_key")
    return joins.attach_owner(accounts, b.cur_customer_shipto(), b.cur_customer_sales_org())


@query
def key_mapping(b: BenchTables) -> DataFrame:
    return b.sf_cdm_key_mapping()


@query
def key_mapping_changes(b: BenchTables) -> DataFrame:
    """The mapping over a change history: one id many times, the newest changes deletions."""
    e = b.raw("events")
    own = F.concat(F.lit("A-"), F.lpad(F.col("user_id").cast("string"), 8, "0"))
    accounts = e.select(
        F.concat(F.lit("AC-"), "event_id").alias("Id"), (F.col("event_type") == "error").alias("IsDeleted"),
        tx.key_text(F.when(F.col("value") > 20, F.col("user_id")), own).alias("Description"), "ts", "event_id",
    )
    return mapping.key_mapping(accounts, "Description", ["ts", "event_id"])


def _mapping(b: BenchTables) -> DataFrame:
    return b.sf_cdm_key_mapping().select("account_id", "sf_account_id")


@query
def fk_resolve(b: BenchTables) -> DataFrame:
    matched, _ = joins.resolve_fk(b.crm_cases().select("case_id", "account_id"), _mapping(b))
    return matched


@query
def fk_orphans(b: BenchTables) -> DataFrame:
    """Against the accounts with revenue, so that some cases have none."""
    loaded = mapping.key_mapping(b.sf_account().where("AnnualRevenue > 0"), "Description", ["Id"])
    return joins.fk_counts(b.crm_cases(), loaded)


@query
def crm_account_payload(b: BenchTables) -> DataFrame:
    return load.account_payload(b.crm_accounts(), bt.SOURCE)


@query
def crm_contact_payload(b: BenchTables) -> DataFrame:
    return load.contact_payload(b.crm_contacts(), _mapping(b))


@query
def crm_opportunity_payload(b: BenchTables) -> DataFrame:
    stage = F.col("stage_name")
    deals = b.crm_opportunities().withColumns({
        "probability": codes.stage_probability(stage), "forecast_category": codes.stage_forecast(stage),
    })
    return load.opportunity_payload(deals, _mapping(b))


@query
def crm_case_payload(b: BenchTables) -> DataFrame:
    return load.case_payload(b.crm_cases(), _mapping(b), bt.SOURCE)


@query
def crm_task_payload(b: BenchTables) -> DataFrame:
    return load.task_payload(b.crm_activities(), _mapping(b))


@query
def text_codec_write(b: BenchTables) -> DataFrame:
    """The target has a text field only."""
    return sc.publish(_scored(b), b.sf_account(), ASSESSED)


@query
def assessed_text(b: BenchTables) -> DataFrame:
    """Times of the events as the customer system takes them: UTC, ISO text, milliseconds as zeros."""
    return b.raw("events").select("event_id", tx.iso_utc(F.col("ts").cast("timestamp")).alias("assessed"))


@query
def typed_publish(b: BenchTables) -> DataFrame:
    """The target has the typed fields."""
    target = b.sf_account().withColumns({c: F.lit(None).cast("string") for c in sc.TYPED_FIELDS})
    return sc.publish(_scored(b), target, ASSESSED)


@query
def missing_columns(b: BenchTables) -> DataFrame:
    """Needed fields that the account table lacks, and one that it has."""
    return quality.missing_fields(["Id", *sc.TYPED_FIELDS], b.sf_account())


@query
def text_codec_parse(b: BenchTables) -> DataFrame:
    """Accounts whose description holds the key text only, the score text, a broken score, or JSON."""
    key = F.col("c_custkey")
    score = F.round(F.col("c_acctbal") / 100.0, 1)
    written = tx.score_text(key, score, F.lit("Medium"), F.lit(ASSESSED))
    document = F.concat(F.lit('{"risk_score": '), score.cast("string"), F.lit(', "risk_category": "High"}'))
    text = (
        F.when(F.col("c_acctbal") < 0, tx.key_text(key, F.lit("A-1")))
        .when(F.col("c_mktsegment") == "BUILDING", document)
        .when(F.col("c_mktsegment") == "MACHINERY", F.replace(written, F.lit("Score: "), F.lit("Score: x")))
        .otherwise(written)
    )
    accounts = b.raw("customer").select(
        F.concat(F.lit("AC-"), key).alias("Id"), F.col("c_name").alias("Name"), text.alias("Description")
    )
    return sc.read_published_scores(accounts)


@query
def length_violations(b: BenchTables) -> DataFrame:
    return quality.length_violations(b.raw("documents"), {"text": 2000, "source": 4}, "doc_id")


@query
def duplicate_keys(b: BenchTables) -> DataFrame:
    return quality.duplicate_keys(b.raw("lineitem"), "l_orderkey")


@query
def first_match(b: BenchTables) -> DataFrame:
    found = rollups.first_match(b.raw("customer"), "c_name", "99", "c_custkey")
    return found.select("c_custkey", "c_name")


@query
def missing_fields(b: BenchTables) -> DataFrame:
    return quality.missing_json_fields(b.raw("events"), "props", ["k", "label", "score"])


@query
def latest_by_key(b: BenchTables) -> DataFrame:
    return rollups.latest_by_key(b.raw("events"), "user_id", ["ts", "event_id"]).drop("ts")


# --- metric layer and insights ---------------------------------------------------------------


def _metric(b: BenchTables, dims: list[str], measures: list[str], *money: str) -> DataFrame:
    return _rounded(account_metrics(_scored(b)).query(dims, measures), 2, *money)


@query
def metric_by_industry(b: BenchTables) -> DataFrame:
    measures = [
        "account_count", "total_revenue", "high_risk_accounts", "pct_high_risk", "max_risk_score",
        "avg_risk_score", "revenue_at_risk", "stale_accounts", "total_activities", "open_cases",
        "escalated_cases", "order_value",
    ]
    out = _metric(b, ["industry"], measures, "total_revenue", "revenue_at_risk", "order_value")
    return _rounded(out, 6, "pct_high_risk", "avg_risk_score")


@query
def metric_by_region_bu(b: BenchTables) -> DataFrame:
    measures = [
        "account_count", "avg_revenue", "avg_days_inactive", "total_contacts", "open_pipeline",
        "closed_won", "win_value_rate", "total_orders", "backorder_lines",
    ]
    out = _metric(b, ["region", "business_unit"], measures, "open_pipeline", "closed_won")
    return _rounded(out, 3, "avg_revenue", "avg_days_inactive", "win_value_rate")


@query
def metric_all_dims(b: BenchTables) -> DataFrame:
    dims = [
        "manager_name", "rep_name", "risk_category", "top_risk_driver_kind", "is_stale_account",
        "has_escalated_cases", "has_backorders", "revenue_band",
    ]
    return account_metrics(_scored(b)).query(dims, ["account_count", "total_orders"])


@query
def metric_sets(b: BenchTables) -> DataFrame:
    """Industry, region, both and all accounts in one pass, the totals told from missing values by their number."""
    sets = [["industry", "region"], ["industry"], ["region"], []]
    measures = ["account_count", "total_orders", "open_cases", "high_risk_accounts", "pct_high_risk", "win_value_rate"]
    out = account_metrics(sc.rule_scored(_refreshed(b))).query_sets(sets, measures)
    return _rounded(out, 6, "pct_high_risk", "win_value_rate")


@query
def revenue_trend(b: BenchTables) -> DataFrame:
    out = ins.revenue_trend(b.order_revenue(), bt.ORDERS_AS_OF)
    return _rounded(out, 2, "recent_revenue", "prior_revenue")


@query
def delivery_reliability(b: BenchTables) -> DataFrame:
    return ins.delivery_reliability(b.cur_shipment_line())


@query
def whitespace_families(b: BenchTables) -> DataFrame:
    gaps = peers.whitespace_families(b.cur_customer_shipto(), _coverage(b), m.product_families(b.cur_product()))
    return gaps.withColumn("families", F.array_join("families", "|"))


@query
def whitespace_score(b: BenchTables) -> DataFrame:
    return peers.whitespace_score(b.cur_customer_shipto(), _coverage(b), m.product_families(b.cur_product()))


@query
def peer_benchmark(b: BenchTables) -> DataFrame:
    scored = sc.rule_scored(_refreshed(b)).select("sf_account_id", "industry", "ml_risk_score")
    return _rounded(peers.peer_benchmark(scored, "ml_risk_score"), 6, "industry_avg_risk")


@query
def revenue_at_risk(b: BenchTables) -> DataFrame:
    value = F.round(F.col("ml_risk_score") * F.col("annual_revenue") / 100.0, 2)
    return _scored(b).select("sf_account_id", value.alias("revenue_at_risk"))


@query
def deep_insights(b: BenchTables) -> DataFrame:
    return _scored_and_insights(b)[1]


# The decisions as their configuration document names them (fixed values).
DECISIONS = json.dumps({
    "next_action": {"type": "choice", "criteria": ["re_engage", "escalate_ops", "protect_pipeline", "expand_relationship", "routine_checkin"]},
    "urgency": {"type": "score", "criteria": ["Routine", "Low", "Medium", "High", "Critical"]},
    "exec_attention": {"type": "noul"},
})

# --- decisions and briefing ------------------------------------------------------------------


@query
def decide_action(b: BenchTables) -> DataFrame:
    summary, insights = _summary_and_insights(b)
    signals = summary.join(insights, "sf_account_id", "left")
    decided = br.decide(signals, br.spec_from_document(DECISIONS)).select("sf_account_id", "decision.*")
    return decided.select("*", "action_probabilities.*").drop("action_probabilities")


@query
def classify_action(b: BenchTables) -> DataFrame:
    summary, insights = _summary_and_insights(b)
    signals = summary.join(insights, "sf_account_id", "left")
    return br.classify_action(signals, br.default_spec()).select("sf_account_id", "action_type")


@query
def recommendations(b: BenchTables) -> DataFrame:
    summary, insights = _summary_and_insights(b)
    signals = summary.join(insights, "sf_account_id", "left")
    return br.recommend(signals).select("sf_account_id", "recommendations")


@query
def account_briefing(b: BenchTables) -> DataFrame:
    return br.brief_accounts(*_summary_and_insights(b))


@query
def briefing_payload(b: BenchTables) -> DataFrame:
    """The JSON documents, read back field by field."""
    documents = br.briefing_payload(br.brief_accounts(*_summary_and_insights(b)))
    fields = (
        "risk_score double, risk_category string, action_type string, action_confidence double, "
        "urgency_score double, exec_attention_prob double, top_risk_driver string, "
        "recommendations string, rev_trend_pct double, revenue_at_risk bigint, "
        "risk_vs_industry double, industry string, delivery_pushed_pct double"
    )
    has_null = F.col("Description").contains('"rev_trend_pct":null')
    return documents.select(
        "Id", has_null.alias("trend_is_null"), F.from_json("Description", fields).alias("d")
    ).select(F.col("Id").alias("sf_account_id"), "trend_is_null", "d.*")


# --- audit log -------------------------------------------------------------------------------


@query
def audit_triage(b: BenchTables) -> DataFrame:
    return audit.sort_triage(audit.audit_triage(b.audit_log(), bt.AUDIT_AS_OF, bt.AUDIT_HOURS))


@query
def cidr_match(b: BenchTables) -> DataFrame:
    """Each event's address, of either family, against the allowed networks: as a table and as a
    plain expression."""
    networks = literal_column(b.spark, "cidr", ALLOWED)
    turn, number = F.col("event_id") % 7, F.hex(F.col("event_id") % 65536)
    address = F.when(turn == 0, F.concat(F.lit("2001:db8::"), number)).when(
        turn == 1, F.concat(F.lit("2001:db9:0:0::"), number)).otherwise(F.col("source_ip_address"))
    log = b.audit_log().select("event_id", address.alias("source_ip_address"))
    listed = net.in_networks(F.col("source_ip_address"), ALLOWED).alias("in_list")
    return audit.cidr_match(log, "source_ip_address", networks).select("*", listed)


def _ledger(b: BenchTables) -> DataFrame:
    """A network for each customer, wide and narrow ones, nested and apart, and its number's digits as IPv6."""
    key = F.col("c_custkey")
    four = F.concat(F.lit("172.20."), key % 256, F.lit("."), (key * 7) % 256, F.lit("/"), 20 + key % 13)
    six = F.concat(F.lit("2001:db8:"), F.hex(key % 4096), F.lit("::/"), 33 + key % 90)
    return b.raw("customer").select(F.explode(F.array(four, six)).alias("cidr"))


@query
def network_ledger(b: BenchTables) -> DataFrame:
    """Each event's address against networks that grow in number with the customers."""
    turn, number = F.col("event_id") % 3, F.hex(F.col("event_id") % 8192)
    ip = F.when(turn == 0, F.concat(F.lit("2001:db8:"), number, F.lit("::"), number)).otherwise(
        F.concat(F.lit("172.20."), F.col("event_id") % 251, F.lit("."), F.col("user_id") % 256))
    return audit.cidr_match(b.raw("events").select("event_id", ip.alias("ip")), "ip", _ledger(b))


@query
def merged_networks(b: BenchTables) -> DataFrame:
    """The disjoint ranges that the IPv4 networks of the customers cover."""
    return audit.merged_networks(_ledger(b)).where("family = 4").select("first_low", "last_low")


@query
def callout_verdicts(b: BenchTables) -> DataFrame:
    """Callout messages, their address as JSON after a rejection, with address and verdict."""
    log = b.audit_log().select("event_id", "source_ip_address", "response.status_code")
    address = F.when(
        F.col("status_code") == 403, F.format_string('{"ip": "%s"}', "source_ip_address")
    ).otherwise(F.col("source_ip_address"))
    message = F.concat(F.lit("IP="), address, F.lit(" | DB_STATUS="), F.col("status_code"))
    return log.select("event_id", message.alias("message")).select(
        "event_id", net.message_ip(F.col("message")).alias("ip"),
        net.callout_verdict(F.col("message"), ALLOWED).alias("verdict"),
    )


@query
def subnet_rollup(b: BenchTables) -> DataFrame:
    return audit.subnet_rollup(b.audit_log(), "source_ip_address")


@query
def distinct_subnets(b: BenchTables) -> DataFrame:
    seen = b.audit_log().select(net.subnet(F.col("source_ip_address"), 24).alias("subnet"))
    return audit.distinct_values(seen, "subnet")


@query
def private_ip_class(b: BenchTables) -> DataFrame:
    ip = F.col("source_ip_address")
    kind = F.when(net.is_private(ip), "PRIVATE").otherwise("PUBLIC")
    return b.audit_log().groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("events"))


# --- streaming -------------------------------------------------------------------------------


def _mirror_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed into a mirror with the newest event per user, then read back."""
    folder = scratch_path(spark, "mirror")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    mirror = Mirror(f"{folder}/data", events.schema, key="user_id", order=("ts", "event_id"))
    start_mirror(
        spark, mirror, f"{sf_dir}/events.parquet*", f"{folder}/checkpoint", fmt="parquet"
    ).awaitTermination()
    return mirror.read(spark).drop("ts")


_REGISTRY["stream_mirror"] = _mirror_events
