import json
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from acctlens.operators.mapping import key_mapping
from acctlens.plans import briefing as br, customer_load as load, gold as g, insights as ins, scoring as sc
from acctlens.schemas import FEATURES

AS_OF = date(2026, 10, 1)


@pytest.fixture
def inputs(frame):
    return {
        "sf_account": frame([
            ("S1", "One", "x", 100.0, "mine"), ("S2", "Two", "x", None, "mine"), ("S3", "Three", "y", 5.0, "other"),
            ("S4", "Four", "y", 5.0, "mine"), ("S5", "Five", "y", 5.0, "mine"),
        ], "Id string, Name string, Industry string, AnnualRevenue double, AccountSource string"),
        "sf_cdm_key_mapping": frame([("S1", 1), ("S2", 2), ("S3", 3), ("S5", None)],
                                    "sf_account_id string, customer_shipto_key bigint"),
        "sf_task": frame([("S1", date(2026, 6, 23), False)], "AccountId string, ActivityDate date, IsDeleted boolean"),
        "sf_contact": frame([("S1", False), ("S1", True)], "AccountId string, IsDeleted boolean"),
        "sf_opportunity": frame([("S1", 10.0, False, False, "Product Family: X", False)],
                                "AccountId string, Amount double, IsClosed boolean, IsWon boolean, "
                                "Description string, IsDeleted boolean"),
        "sf_case": frame([("S1", False, True, "High", False)],
                         "AccountId string, IsClosed boolean, IsEscalated boolean, Priority string, IsDeleted boolean"),
        "cur_customer_shipto": frame([(1, 10), (2, 10)], "customer_shipto_key bigint, customer_sales_org_key bigint"),
        "cur_customer_sales_org": frame(
            [(10, "R", "P", "M", "G", "bu", "reg")],
            "customer_sales_org_key bigint, rp_emp_first string, rp_emp_last string, mg_emp_first string, "
            "mg_emp_last string, business_unit string, rg_code_region string"),
        "cur_product": frame([(7, "fam")], "product_key bigint, prduct_type_description string"),
        "cur_sales_order_header": frame([(100, 1), (101, None)],
                                        "sales_order_header_key bigint, customer_shipto_key bigint"),
        "cur_sales_order_line": frame([(100, 7, 2.0, 3.0), (101, 7, 1.0, 1.0)],
                                      "sales_order_header_key bigint, product_key bigint, qty_ordered double, unit_price double"),
        "cur_shipment_line": frame([(1, "Backordered", 4.0, 100.0)],
                                   "customer_shipto_key bigint, status_description string, backorder_qty double, total_qty double"),
    }


def test_gold(inputs):
    out = g.build_c360(inputs, AS_OF, "mine")
    assert out.columns == g.COLUMNS
    rows = {r.sf_account_id: r for r in out.collect()}
    assert set(rows) == {"S1", "S2", "S5"}
    one, two, five = rows["S1"], rows["S2"], rows["S5"]
    assert one.days_since_last_activity == 100 and one.risk_score_raw == 44.0   # 20 + 12.5 + 6 + 5
    assert one.total_contacts == 1 and one.opp_product_families == ["X"]
    assert (one.total_orders, one.total_order_value, one.avg_line_value) == (1, 6.0, 6.0)
    assert (one.rep_name, one.region, one.product_family_list) == ("R P", "reg", "fam")
    assert one.is_stale_account and one.has_escalated_cases and one.has_backorders
    assert (two.days_since_last_activity, two.risk_score_raw, two.is_stale_account) == (365, 40.0, True)
    assert two.win_rate_pct is None and two.avg_line_value is None and two.product_family_list is None
    assert two.total_orders == 0 and two.has_backorders is False and two.annual_revenue is None
    assert five.rep_name is None and five.total_orders == 0   # no order-side key: matches nothing


def test_gold_is_one_row_per_account(spark, sf_dir):
    from acctlens.queries import registry

    gold = registry()["customer_360"](spark, sf_dir)
    base = registry()["account_base"](spark, sf_dir)
    stats = gold.agg(F.count("*").alias("n"), F.count_distinct("sf_account_id").alias("d"),
                     F.max("risk_score_raw").alias("top")).first()
    assert stats.n == stats.d == base.count() and stats.top <= 100


@pytest.fixture
def scored(inputs):
    return sc.rule_scored(g.build_c360(inputs, AS_OF, "mine"))


def test_summary(scored):
    rows = sc.account_risk_summary(scored).collect()
    assert [r.sf_account_id for r in rows] == ["S1", "S2", "S5"]
    assert rows[0].risk_category == "Medium" and rows[0].top_risk_driver == "Inactivity (100 days)"


def test_features_and_foreign_model(scored):
    features = sc.feature_matrix(scored)
    assert features.columns == ["sf_account_id", *FEATURES]
    assert {f.dataType.typeName() for f in features.schema.fields[1:]} == {"double"}
    assert features.where("sf_account_id = 'S2'").first()["annual_revenue"] == 0.0

    def model(frame: pd.DataFrame) -> pd.Series:
        assert list(frame.columns) == FEATURES
        return frame["days_since_last_activity"] / 10.0 + 0.05

    got = {r.sf_account_id: r.ml_risk_score for r in sc.score(features, model).collect()}
    assert got == {"S1": 10.1, "S2": 36.6, "S5": 36.6}
    record = json.loads(sc.feature_json(features).first()["record"])
    assert list(record) == FEATURES


def test_model_scored_drops_accounts_without_score(scored, frame):
    scores = frame([("S1", 70.0), ("S9", 1.0)], "sf_account_id string, ml_risk_score double")
    rows = sc.model_scored(scored.drop("ml_risk_score"), scores).collect()
    assert [(r.sf_account_id, r.risk_category) for r in rows] == [("S1", "High")]


def test_train(spark):
    u = F.rand(3)
    data = spark.range(300).select(
        F.col("id").cast("string").alias("sf_account_id"),
        *[(u * 100 if c == "days_since_last_activity" else F.rand(5)).alias(c) for c in FEATURES],
    ).withColumn("label", F.col("days_since_last_activity") * 0.5)
    model = sc.train(data, "label", rounds=5)
    top = sc.feature_importances(model).collect()
    assert top[0].feature == "days_since_last_activity" and len(top) == 18
    assert sum(r.importance for r in top) == pytest.approx(1.0)
    error = sc.score(data, model).join(data, "sf_account_id").agg(
        F.avg(F.abs(F.col("ml_risk_score") - F.col("label")))).first()[0]
    assert error < 3


def test_on_demand(scored, frame):
    requests = frame([(1, "S1", None), (2, "S1", 0.0), (3, "S9", 5.0), (4, None, None)],
                     "request_id bigint, sf_account_id string, days_since_last_activity double")
    rows = {r.request_id: r for r in sc.on_demand_score(requests, scored).collect()}
    assert (rows[1].risk_score, rows[1].risk_category, rows[1].success) == (44.0, "Medium", True)
    assert rows[2].risk_score == 24.0 and rows[2].risk_category == "Low"
    assert (rows[1].found, rows[3].found, rows[4].found) == (True, False, False)
    assert rows[3].success and rows[3].risk_score == 1.0 and rows[4].risk_score == 0.0
    # a record of its own, and two that can't be scored: neither ends the job
    bare = frame([(5, None, 200.0, 1.0), (6, "S1", 1e15, 0.0), (7, "S1", float("nan"), 0.0)],
                 "request_id bigint, sf_account_id string, days_since_last_activity double, escalated_case_count double")
    rows = {r.request_id: r for r in sc.on_demand_score(bare, scored).collect()}
    assert rows[5].risk_score == 53.0 and rows[5].success and not rows[5].found
    assert [rows[i].error for i in (6, 7)] == ["Not a usable number: days_since_last_activity"] * 2
    assert rows[6].risk_score is None and not rows[6].success and rows[6].found


def test_publish_and_read_back(scored):
    texts = sc.publish_text(scored, "2026-10-01T12:00:00.000Z")
    accounts = texts.select("Id", F.lit("n").alias("Name"), "Description")
    rows = {r.sf_account_id: r for r in sc.read_published_scores(accounts).collect()}
    assert (rows["S1"].risk_score, rows["S1"].risk_category, rows["S1"].success) == (44.0, "Medium", True)
    # no order-side key: the text starts with the score
    assert rows["S5"].risk_score == 40.0
    typed = ["Id", *sc.TYPED_FIELDS]
    assert sc.publish(scored, scored, "t").columns == ["Id", "Description"]
    target = scored.select(*[F.lit(None).alias(c) for c in typed])
    assert sc.publish(scored, target, "t").columns == typed


# --- insights --------------------------------------------------------------------------------


def test_revenue_trend(frame):
    orders = frame([
        (1, date(2026, 9, 30), 10.0), (1, date(2026, 7, 3), 10.0),   # last 90 days, first day included
        (1, date(2026, 7, 2), 40.0), (1, date(2026, 4, 4), 59.0),    # 90 days before
        (1, date(2026, 10, 1), 500.0), (1, date(2026, 4, 3), 500.0), # outside
        (2, date(2026, 9, 1), 5.0),
    ], "customer_shipto_key bigint, order_date date, order_value double")
    out = {r.customer_shipto_key: r for r in ins.revenue_trend(orders, AS_OF).collect()}
    assert (out[1].recent_revenue, out[1].prior_revenue, out[1].rev_trend_pct) == (20.0, 99.0, -79.8)
    assert out[2].rev_trend_pct is None


def test_delivery(frame):
    d = date(2026, 1, 10)
    lines = frame([(1, d, date(2026, 1, 12)), (1, d, date(2026, 1, 15)), (1, d, d), (1, d, None), (2, d, d)],
                  "customer_shipto_key bigint, promised_date date, actual_date date")
    out = {r.customer_shipto_key: r for r in ins.delivery_reliability(lines).collect()}
    assert (out[1].pct_delivery_pushed, out[1].avg_days_pushed) == (66.7, 3.5)
    assert (out[2].pct_delivery_pushed, out[2].avg_days_pushed) == (0.0, None)


def test_scans_push_filters_and_prune(spark, sf_dir):
    from acctlens.sources.bench_tables import BenchTables, ORDERS_AS_OF, AUDIT_AS_OF
    from acctlens.operators.audit import audit_triage

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    b = BenchTables(spark, sf_dir)
    trend = plan(ins.revenue_trend(b.order_revenue(), ORDERS_AS_OF))
    assert "GreaterThanOrEqual(o_orderdate" in trend and "o_comment" not in trend
    triage = plan(audit_triage(b.audit_log(), AUDIT_AS_OF, 72))
    assert "GreaterThan(ts" in triage and "props" not in triage
    gold = plan(g.build_c360(b.entities(), AS_OF, "CRM Import"))
    assert "Python" not in gold and "Cartesian" not in gold and "NestedLoop" not in gold


# --- decisions and briefing ------------------------------------------------------------------


SIGNALS = ("sf_account_id string, days_since_last_activity int, pct_qty_backordered double, open_case_count bigint, "
           "open_pipeline_value double, ml_risk_score double, rev_trend_pct double, pct_delivery_pushed double, "
           "families_missing bigint")


def test_decide(frame):
    df = frame([
        ("dark", 365, 0.0, 0, 0.0, 40.0, -50.0, 0.0, 0),
        ("ops", 10, 60.0, 9, 0.0, 60.0, None, 0.0, 0),
        ("deal", 1, 0.0, 0, 9.0, 90.0, None, None, None),
        ("well", 1, 0.0, 0, 0.0, 0.0, 5.0, 0.0, 2),
    ], SIGNALS)
    rows = {r.sf_account_id: r for r in br.decide(df, br.default_spec()).select("sf_account_id", "decision.*").collect()}
    assert [rows[k].action_type for k in ("dark", "ops", "deal", "well")] == [
        "re_engage", "escalate_ops", "protect_pipeline", "expand_relationship"]
    for r in rows.values():
        assert 0.2 <= r.action_confidence <= 1 and 0 <= r.urgency_score <= 4 and 0 <= r.exec_attention_prob <= 1
    assert rows["deal"].urgency_label == "Critical" and rows["well"].urgency_label == "Routine"
    assert rows["deal"].exec_attention_prob > 0.9
    single = br.classify_action(df, br.default_spec()).collect()
    assert {r.sf_account_id: r.action_type for r in single} == {k: r.action_type for k, r in rows.items()}


def test_spec_from_document(frame):
    text = json.dumps({
        "action": {"type": "choice", "criteria": {"re_engage": "a", "routine_checkin": "b", "new_label": "c"}},
        "urgency": {"type": "score", "criteria": ["calm", "busy", "hot"]},
        "exec": {"type": "noul", "instructions": "?"},
    })
    df = frame([("dark", 365, 0.0, 0, 0.0, 100.0, None, 0.0, 0)], SIGNALS)
    row = br.decide(df, br.spec_from_document(text)).select("decision.*").first()
    assert (row.action_type, row.urgency_label, row.urgency_score) == ("re_engage", "hot", 2.0)
    assert set(row.action_probabilities.asDict()) == {"re_engage", "routine_checkin", "new_label"}
    assert sum(row.action_probabilities) == pytest.approx(1.0, abs=1e-5)
    with pytest.raises(ValueError, match="noul, score"):
        br.spec_from_document('{"a": {"type": "choice", "criteria": {}}}')


def test_recommend(frame):
    df = frame([("dark", 365, 16.0, 0, 0.0, 40.0, None, None, None), ("well", 1, 0.0, 0, 0.0, 0.0, 5.0, 0.0, 0)], SIGNALS)
    rows = {r.sf_account_id: r.recommendations.split("\n") for r in br.recommend(df).collect()}
    assert rows["dark"] == ["Book a visit: no contact for 365 days.",
                            "Review backorders: 16% of the quantity is open.", "Keep the regular check-in."]
    assert rows["well"] == ["Keep the regular check-in.", "Confirm the contact list.", "Share the latest catalog."]


def test_briefing_payload(frame):
    briefing = frame([("S1", "Ünal", 44.0, "Medium", None, None, 1.5, 0.0, "d", "a\nb", None, 12.9, None, "x", None)],
                     "sf_account_id string, account_name string, ml_risk_score double, risk_category string, "
                     "action_type string, action_confidence double, urgency_score double, exec_attention_prob double, "
                     "top_risk_driver string, recommendations string, rev_trend_pct double, revenue_at_risk double, "
                     "risk_vs_industry double, industry string, pct_delivery_pushed double")
    payload = br.briefing_payload(briefing)
    document = json.loads(payload.first()["Description"])
    assert document["rev_trend_pct"] is None and document["action_type"] is None
    assert (document["revenue_at_risk"], document["action_confidence"], document["delivery_pushed_pct"]) == (12, 0, 0)
    assert list(document)[:3] == ["risk_score", "risk_category", "action_type"] and len(document) == 13
    record = json.loads(br.outbound_record(payload).first()["body"])
    assert record["attributes"] == {"type": "Account"} and json.loads(record["Description"]) == document


def test_briefing_forms_agree(spark, sf_dir):
    from acctlens.queries import _summary_and_insights
    from acctlens.sources.bench_tables import BenchTables

    summary, insights = _summary_and_insights(BenchTables(spark, sf_dir))
    one = br.brief_accounts(summary, insights)
    three = br.account_briefing(summary, br.account_decisions(summary, insights), insights)
    assert one.columns == three.columns == br.BRIEFING and len(br.BRIEFING) == 15
    assert one.exceptAll(three).count() == 0 and one.count() == three.count()


# --- load ------------------------------------------------------------------------------------


def test_key_mapping(frame):
    accounts = frame([
        ("S1", "CDM Key: 1 | Demo Account ID: A"), ("S2", "CDM Key: 2 | Demo Account ID: A"),
        ("S3", "nothing"), ("S4", None), ("S5", "Demo Account ID: B"),
    ], "Id string, Description string")
    rows = sorted(tuple(r) for r in key_mapping(accounts, "Description", ["Id"]).collect())
    assert rows == [("S2", 2, "A"), ("S5", None, "B")]


def test_payloads(frame):
    mapping = frame([("A", "S1")], "account_id string, sf_account_id string")
    cases = frame([("A", "x" * 300, "Open", "High", "t"), ("Z", "s", "Open", "Low", "t")],
                  "account_id string, subject string, status string, priority string, case_type string")
    rows = load.case_payload(cases, mapping, "o").collect()
    assert len(rows) == 1 and len(rows[0].Subject) == 255 and rows[0].Status == "New" and rows[0].Origin == "o"
    tasks = frame([("A", "s", date(2026, 1, 2), False, "Call", None)],
                  "account_id string, subject string, activity_date date, completed boolean, "
                  "activity_type string, created_by string")
    task = load.task_payload(tasks, mapping).first()
    assert (task.WhatId, task.ActivityDate, task.Status, task.Description) == (
        "S1", "2026-01-02", "Not Started", "Type: Call | Created by: None")
    opps = frame([("A", "n" * 130, "Closed Won", 1.5, date(2026, 1, 2), "F", 100, "Closed")],
                 "account_id string, opportunity_name string, stage_name string, amount double, close_date date, "
                 "product_family string, probability int, forecast_category string")
    opp = load.opportunity_payload(opps, mapping).first()
    assert len(opp.Name) == 120 and opp.Description == "Product Family: F" and opp.CloseDate == "2026-01-02"
