from datetime import datetime

import pytest
from pyspark.sql import functions as F

from acctlens.functions import codes, network as net, risk, text as tx

lit = F.lit


@pytest.mark.parametrize("args, expected", [
    ((365, 2, 20.0, 2), 100.0),
    ((100, 1, 4.0, 1), 44.0),
    ((365, 0, 0.0, 0), 40.0),
    ((-50, 0, 0.0, 0), -10.0),
    ((0, 0, 0.0, 0), 0.0),
])
def test_risk_score(value, args, expected):
    days, esc, pct, hi = map(lit, args)
    assert value(risk.risk_score_raw(days, esc, pct, hi)) == expected


def test_risk_score_defaults_and_floor(value):
    none = lit(None).cast("int")
    assert value(risk.risk_score_raw(lit(100), none, none, none)) == 20.0
    assert value(risk.risk_score_raw(lit(-50), none, none, none, floor=True)) == 0.0


@pytest.mark.parametrize("score, expected", [
    (55.0, "High"), (54.9, "Medium"), (42.5, "Medium"), (25.0, "Medium"), (24.9, "Low"),
])
def test_category(value, score, expected):
    assert value(risk.risk_category(lit(score))) == expected


def test_rounding_before_category(value):
    """Half is rounded away from zero, so 24.95 counts as 25.0."""
    assert value(risk.risk_category(F.round(lit(24.95), 1))) == "Medium"


@pytest.mark.parametrize("args, expected", [
    ((91, 50.0, 9, 0.0), "Inactivity (91 days)"),
    ((90, 15.1, 9, 0.0), "Backorder Exposure (15%)"),
    ((90, 16.5, 0, 0.0), "Backorder Exposure (16%)"),
    ((90, 15.0, 4, 0.0), "Open Cases (4)"),
    ((90, 15.0, 3, 0.0), "No Active Pipeline"),
    ((90, 15.0, 3, 1.0), "Healthy"),
    ((90, 1234567.0, 3, 1.0), "Backorder Exposure (1234567%)"),
])
def test_driver(value, args, expected):
    assert value(risk.top_risk_driver(*map(lit, args))) == expected


def test_clamp(value):
    assert value(risk.clamp_days(lit(None).cast("int"))) == 365
    assert value(risk.clamp_days(lit(9999))) == 365
    assert value(risk.clamp_days(lit(-3))) == -3


def test_key_text(value):
    text = "CDM Key: 84 | Demo Account ID: A-0084"
    assert value(tx.key_text(lit(84), lit("A-0084"))) == text
    assert value(tx.parse_cdm_key(lit(text))) == 84
    assert value(tx.parse_account_id(lit(text))) == "A-0084"
    assert value(tx.parse_account_id(lit("no mark"))) is None
    assert value(tx.parse_account_id(lit(None).cast("string"))) is None
    assert value(tx.parse_account_id(lit("Demo Account ID:\t B \n"))) == "B"
    assert value(tx.parse_cdm_key(lit("CDM Key: | x"))) is None
    unknown = tx.key_text(lit(None).cast("int"), lit("A-1"))
    assert value(tx.parse_cdm_key(unknown)) is None and value(tx.parse_account_id(unknown)) == "A-1"


def test_score_text_round_trip(value):
    assessed = "2026-10-01T12:00:00.000Z"
    text = tx.score_text(lit(1), lit(55.0), lit("High"), lit(assessed))
    assert value(text) == "CDM Key: 1 | Risk Score: 55.0 | Risk Category: High | Assessed: " + assessed
    r = value(tx.read_score(text))
    assert (r.score, r.category, r.assessed, r.success, r.error) == (55.0, "High", assessed, True, None)


@pytest.mark.parametrize("text, score, category, success", [
    (None, None, None, False),
    ("CDM Key: 1", None, None, False),
    ("Risk Score: 7", None, None, True),
    ("Risk Score:  | Risk Category: Low", None, "Low", True),
    ("Risk Score: 3.5 | Risk Category: Low ", 3.5, "Low", True),
    ("Risk Score: abc | Risk Category: Low", None, None, False),
    ('{"risk_score": 63.0, "risk_category": "High"}', 63.0, "High", True),
])
def test_read_score(value, text, score, category, success):
    r = value(tx.read_score(lit(text).cast("string")))
    assert (r.score, r.category, r.success) == (score, category, success)
    assert (r.error is None) == success


def test_small_texts(value):
    assert value(tx.first_name_part(lit("Proposal/Price Quote"))) == "Proposal"
    assert value(tx.mail_address(lit("Ada"), lit("Birk"), lit("A & B Very Long Company Name"))) == \
        "ada.birk@abverylongcompanynam.com"
    assert value(tx.json_field_or_raw(lit('{"ip": "1.2.3.4"}'), "ip")) == "1.2.3.4"
    assert value(tx.json_field_or_raw(lit(" 1.2.3.4 \n"), "ip")) == "1.2.3.4"


@pytest.mark.parametrize("status, expected", [
    ("Open", "New"), ("In Progress", "Working"), ("Escalated", "Escalated"), ("Closed", "Closed"),
])
def test_case_status(value, status, expected):
    assert value(codes.case_status(lit(status))) == expected


def test_code_tables(value):
    assert value(codes.stage_probability(lit("Negotiation/Review"))) == 75
    assert value(codes.stage_forecast(lit("Closed Lost"))) == "Omitted"
    assert value(codes.stage_forecast(lit("unknown"))) is None
    assert value(codes.task_status(lit(True))) == "Completed"
    assert value(codes.task_status(lit(None).cast("boolean"))) == "Not Started"


def test_network(value):
    assert value(net.ip_to_long(lit("1.2.3.4"))) == 16909060
    assert value(net.ip_to_long(lit("1.2.3.256"))) is None
    assert value(net.ip_to_long(lit("x"))) is None
    assert value(net.subnet(lit("1.2.3.4"), 24)) == "1.2.3.0/24"
    assert value(net.subnet(lit("1.2.3.4"), 16)) == "1.2.0.0/16"
    allowed = ["13.108.0.0/14", "160.8.0.0/13"]
    assert value(net.in_networks(lit("13.110.5.6"), allowed)) is True
    assert value(net.in_networks(lit("13.112.0.0"), allowed)) is False
    assert value(net.in_networks(lit("junk"), allowed)) is False
    six = ["2001:db8::/32", "::1/128", "::ffff:0:0/96"]
    for text, inside in [("2001:db8::5", True), ("2001:DB8:1:2:3:4:5:6", True), ("2001:db9::5", False), ("::1", True),
                         ("::2", False), ("::ffff:1.2.3.4", True), ("::", False), ("1::2::3", False), ("2001:db8:::", False),
                         ("1:2:3:4:5:6:7", False), ("2001:db8::10000", False), ("1.2.3.4", False), ("2001:db8::", True)]:
        assert value(net.in_networks(lit(text), six)) is inside, text
    assert value(net.network_range(lit("2001:db8::/129"))) is None and value(net.network_range(lit("x/3"))) is None
    assert value(net.network_range(lit("10.0.0.0/-1"))) is None and value(net.network_range(lit("10.0.0.0/x"))) is None
    assert value(net.is_private(lit("172.99.0.1"))) is True
    assert value(net.is_private(lit("8.8.8.8"))) is False


@pytest.mark.parametrize("message, ip, verdict", [
    ('IP={"ip":"13.110.5.6"} | DB_STATUS=403', "13.110.5.6", "listed but rejected"),
    ("IP= 13.110.5.6 | DB_STATUS=200", "13.110.5.6", "works"),
    ("IP=8.8.8.8 | DB_STATUS=403", "8.8.8.8", "not listed: add 8.8.8.8/32"),
    ("timeout", None, "no address"),
    (None, None, "no address"),
])
def test_callout_verdict(value, message, ip, verdict):
    text = lit(message).cast("string")
    assert value(net.message_ip(text)) == ip
    assert value(net.callout_verdict(text, ["13.108.0.0/14"])) == verdict


def test_iso_text_is_utc(value, spark):
    moment = lit("2026-01-31 23:30:05.678").cast("timestamp")
    assert value(tx.iso_utc(moment)) == "2026-01-31T23:30:05.000Z"
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert value(tx.iso_utc(moment)) == "2026-02-01T04:30:05.000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_least_ignores_null(value):
    assert value(F.least(lit(40), lit(None).cast("int"))) == 40


def test_texts_round_trip_for_any_id(spark):
    """Ids of any characters but the marks survive writing and reading, stripped at both ends."""
    from hypothesis import given, settings, strategies as st

    letters = st.characters(blacklist_categories=["Cs", "Cc", "Zs", "Zl", "Zp"])
    cases = []

    @settings(max_examples=60, database=None)
    @given(st.integers(0, 10**15), st.text(letters, min_size=1, max_size=30),
           st.decimals(0, 100, places=1, allow_nan=False))
    def collect(key, account_id, score):
        cases.append((key, account_id, float(score)))

    collect()
    df = spark.createDataFrame(cases, "k bigint, a string, s double")
    out = df.select(
        "k", "a", "s", tx.parse_cdm_key(tx.key_text(F.col("k"), F.col("a"))).alias("k2"),
        tx.parse_account_id(tx.key_text(F.col("k"), F.col("a"))).alias("a2"),
        tx.read_score(tx.score_text(F.col("k"), F.col("s"), F.lit("Low"), F.lit("t")))["score"].alias("s2"),
    )
    assert [tuple(r) for r in out.where("k <> k2 OR a <> a2 OR s <> s2 OR a2 IS NULL OR s2 IS NULL").collect()] == []
