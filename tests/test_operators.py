import random
from collections import Counter, defaultdict
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from acctlens.operators import audit, joins, metrics as m, peers, quality, rollups
from acctlens.operators.metric_layer import MetricLayer, account_metrics

AS_OF = date(2026, 10, 1)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=repr)


def test_activity_metrics(frame):
    task = frame([
        ("a", date(2026, 7, 3), False),    # exactly 90 days back
        ("a", date(2026, 7, 2), False),
        ("a", date(2026, 11, 1), False),   # a future day counts as recent and gives negative days
        ("a", date(2026, 11, 2), True),
        ("b", date(2026, 9, 1), None),     # unknown flag drops out
        ("c", None, False),
        (None, date(2026, 9, 1), False),
    ], "AccountId string, ActivityDate date, IsDeleted boolean")
    out = {r.sf_account_id: r for r in m.activity_metrics(task, AS_OF).collect()}
    assert set(out) == {"a", "c", None}
    assert (out["a"].days_since_last_activity, out["a"].total_activities, out["a"].recent_activities_90d) == (-31, 3, 2)
    assert out["c"].days_since_last_activity is None and out["c"].recent_activities_90d == 0


def test_opp_metrics(frame):
    opps = frame([
        ("a", 10.0, False, False, "Product Family: X", False),
        ("a", 20.0, True, True, "Product Family: Y", False),
        ("a", 5.0, True, False, "none", False),
        ("a", 5.0, True, False, None, False),
        ("a", 99.0, True, True, "Product Family: Z", True),
        ("b", 7.0, False, False, "Product Family: X", False),
    ], "AccountId string, Amount double, IsClosed boolean, IsWon boolean, Description string, IsDeleted boolean")
    out = {r.sf_account_id: r for r in m.opp_metrics(opps).collect()}
    a = out["a"]
    assert (a.open_pipeline_value, a.total_closed_won, a.total_closed_lost) == (10.0, 20.0, 10.0)
    assert (a.total_closed_opps, a.total_won_opps, a.win_rate_pct) == (3, 1, 33.3)
    assert a.opp_product_families == ["", "X", "Y"]
    assert out["b"].win_rate_pct is None
    blank = {r.sf_account_id: r for r in m.opp_metrics(opps, drop_blank=True).collect()}
    assert blank["a"].opp_product_families == ["X", "Y"]


def test_case_metrics(frame):
    cases = frame([
        ("a", False, True, "High", False), ("a", False, False, "Critical", False),
        ("a", True, True, "High", False), ("a", False, False, "Low", False),
        ("a", False, True, "High", True),
    ], "AccountId string, IsClosed boolean, IsEscalated boolean, Priority string, IsDeleted boolean")
    assert rows_of(m.case_metrics(cases)) == [("a", 4, 3, 2, 2)]


def test_order_metrics_like_a_plain_join(frame):
    """Random orders with repeated header rows, missing parts and a hot order."""
    rnd = random.Random(1)
    headers = [(i, rnd.choice([1, 2, 3, None])) for i in range(40)] + [(5, 1), (5, 2), (6, 3), (6, 3)]
    lines = [(rnd.choice([7, 7, rnd.randrange(50)]), rnd.randrange(6), float(rnd.randrange(1, 5)),
              rnd.choice([1.5, 2.0, None])) for _ in range(400)]
    products = [(p, f"f{p % 3}") for p in range(5)] + [(0, "f9"), (1, None)]
    header = frame(headers, "sales_order_header_key bigint, customer_shipto_key bigint")
    line = frame(lines, "sales_order_header_key bigint, product_key bigint, qty_ordered double, unit_price double")
    product = frame(products, "product_key bigint, prduct_type_description string")

    orders, values, families = defaultdict(set), defaultdict(list), defaultdict(set)
    for h, c in headers:
        for lh, p, q, u in lines:
            if lh == h:
                orders[c].add(h)
                values[c] += [] if u is None else [q * u]
                families[c] |= {f for pk, f in products if pk == p}
    got = {r.customer_shipto_key: r for r in m.order_metrics(header, line).collect()}
    assert set(got) == set(orders)
    for c, r in got.items():
        assert r.total_orders == len(orders[c])
        assert r.total_order_value == pytest.approx(sum(values[c]))
        assert r.avg_line_value == pytest.approx(sum(values[c]) / len(values[c]))
    cover = {r.customer_shipto_key: r for r in m.product_coverage(header, line, product).collect()}
    for c, r in cover.items():
        names = sorted(f for f in families[c] if f)
        assert (r.product_families_purchased, r.product_family_list) == (len(names), ", ".join(names))


def test_order_metrics_decimals(frame):
    header = frame([(1, 1)], "sales_order_header_key bigint, customer_shipto_key bigint")
    line = frame([(1, 0.1), (1, 0.2)], "sales_order_header_key bigint, unit_price double").select(
        "sales_order_header_key", F.lit(1).alias("qty_ordered"),
        F.col("unit_price").cast("decimal(10,2)").alias("unit_price"))
    assert rows_of(m.order_metrics(header, line)) == [(1, 1, 0.3, 0.15, 2)]


def test_backorder_metrics(frame):
    ship = frame([
        (1, "Backordered", 2, 8), (1, "Shipped", 0, 8), (2, "Shipped", 0, 0), (3, "Shipped", None, None),
    ], "customer_shipto_key bigint, status_description string, backorder_qty int, total_qty int")
    out = {r.customer_shipto_key: r for r in m.backorder_metrics(ship).collect()}
    assert (out[1].backorder_line_count, out[1].pct_qty_backordered) == (1, 12.5)
    assert out[2].pct_qty_backordered == 0 and out[3].pct_qty_backordered == 0
    assert out[3].total_backorder_qty is None


def test_sales_org_null_part(frame):
    customer = frame([(1, 10), (2, 11)], "customer_shipto_key bigint, customer_sales_org_key bigint")
    org = frame([(10, "A", "B", "C", None, "bu", "r")],
                "customer_sales_org_key bigint, rp_emp_first string, rp_emp_last string, mg_emp_first string, "
                "mg_emp_last string, business_unit string, rg_code_region string")
    assert rows_of(m.sales_org(customer, org)) == [(1, "A B", None, "bu", "r")]


# --- joins with hot keys ---------------------------------------------------------------------


def hot_rows(n=3000):
    """A third of the rows on one key, a third on NULL, the rest spread; some keys unknown."""
    return [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i % 500}") for i in range(n)]


DIM = [("hot", 1)] + [(f"k{i}", i) for i in range(400)] + [(None, -1)]


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("share", [0.001, 0.1, 0.9])
def test_lookup_join(frame, how, null_safe, share):
    fact = frame(hot_rows(), "id bigint, k string")
    dim = frame(DIM, "k string, v bigint")
    out = joins.lookup_join(fact, dim, "k", how, null_safe=null_safe, share=share)
    table = dict(DIM)
    want = [(i, k, table.get(k) if null_safe or k is not None else None) for i, k in hot_rows()]
    if how == "inner":
        want = [r for r in want if r[2] is not None]
    assert out.columns == ["id", "k", "v"]
    assert rows_of(out) == sorted(want, key=repr)


def test_lookup_join_spreads_hot_and_null_keys(spark, frame):
    """No partition of the shuffle join holds a large part of the rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fact, dim = frame(hot_rows(8000), "id bigint, k string"), frame(DIM, "k string, v bigint")
        sizes = [r["n"] for r in joins.lookup_join(fact, dim, "k")
                 .groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        plain = [r["n"] for r in fact.join(dim, "k", "left")
                 .groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 0.2 * 8000 < 0.3 * 8000 < max(plain)


def test_order_joins_split_hot_orders_and_products(spark):
    """Past the broadcast threshold, adaptive execution splits the hot keys of both line joins."""
    conf = {
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    ids = spark.range(0, 60000, 1, 8)
    line = ids.select(
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("sales_order_header_key"),
        F.when(F.col("id") % 5 < 2, 5).otherwise(F.col("id") % 900).alias("product_key"))
    header = ids.select(F.col("id").alias("sales_order_header_key"), (F.col("id") % 50).alias("customer_shipto_key"))
    product = spark.range(900).select(
        F.col("id").alias("product_key"), F.md5(F.col("id").cast("string")).alias("prduct_type_description"))
    for key, setting in conf.items():
        spark.conf.set(key, setting)
    try:
        df = m.customer_families(header, line, product)
        got = rows_of(df)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for key in conf:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    plain = header.join(line, "sales_order_header_key").join(product, "product_key")
    assert got == rows_of(plain.select("customer_shipto_key", "prduct_type_description").distinct())
    side = m.order_side(header, line.withColumns({"qty_ordered": F.lit(1), "unit_price": F.lit(2.0)}), product)
    by_customer = plain.groupBy("customer_shipto_key").agg(
        F.countDistinct("sales_order_header_key").alias("o"), F.countDistinct("prduct_type_description").alias("f"),
        (F.count("*") * 2.0).alias("v"))
    assert rows_of(side, "customer_shipto_key", "total_orders", "product_families_purchased", "total_order_value") == rows_of(
        by_customer, "customer_shipto_key", "o", "f", "v")


def test_hot_order_of_one_family_stays_small(spark):
    """Without adaptive execution: each reducer of the order join gets a handful of the hot order."""
    line = spark.range(0, 40000, 1, 8).select(
        F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("sales_order_header_key"), (F.col("id") % 5).alias("product_key"))
    pairs = line.select("sales_order_header_key", "product_key").distinct()
    assert pairs.where("sales_order_header_key = 7").count() == 5


def test_key_only_frames_are_spread(spark):
    """A third of the rows on one key and a third on none, and nothing but the key."""
    fact = spark.range(0, 9000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, F.col("id")).alias("k"))
    dim = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {key: spark.conf.get(key) for key in conf}
    for key, setting in conf.items():
        spark.conf.set(key, setting)
    try:
        out = joins.lookup_join(fact, dim, "k", repeats=True)
        assert out.where("k = 1").agg(F.count("v"), F.max("v")).first() == (3001, 2)
        assert out.count() == 9000 and out.where("k IS NULL").count() == 3000
        once = fact.groupBy("k").count()
        assert once.count() < 3100
        assert rows_of(joins.fk_counts(fact, dim, "k")) == [(4000, 5000)]
    finally:
        for key, setting in before.items():
            spark.conf.set(key, setting)


def test_left_join_on_spread(frame):
    left = frame([("a", 1), ("b", None), ("c", None), ("d", 9)], "id string, key bigint")
    right = frame([(1, "x"), (None, "y"), (2, "z")], "key bigint, v string")
    out = joins.left_join_on_spread(joins.spread_null_key(left, "key", "id", "_s"), right, "key", "_s")
    assert rows_of(out, "id", "v") == [("a", "x"), ("b", None), ("c", None), ("d", None)]


def test_resolve_fk(frame):
    child = frame([(1, "a"), (2, "a"), (3, "z"), (4, None)], "id bigint, account_id string")
    mapping = frame([("a", "S1"), ("b", "S2"), (None, "S3")], "account_id string, sf_account_id string")
    matched, orphans = joins.resolve_fk(child, mapping)
    assert rows_of(matched) == [(1, "a", "S1"), (2, "a", "S1")]
    assert rows_of(orphans) == [(3, "z"), (4, None)]
    assert rows_of(joins.fk_counts(child, mapping)) == [(2, 2)]


def test_attach_owner(frame):
    account = frame([("A", 1), ("B", 2), ("C", 3)], "account_id string, customer_shipto_key bigint")
    customer = frame([(1, 10), (1, 11), (2, 12)], "customer_shipto_key bigint, customer_sales_org_key bigint")
    org = frame([(10, "R", "One"), (11, "R", "Two")],
                "customer_sales_org_key bigint, rp_emp_first string, rp_emp_last string")
    out = joins.attach_owner(account, customer, org)
    assert rows_of(out, "account_id", "owner_rep_name") == [("A", "R One"), ("B", None), ("C", None)]


def test_classify_by_lookup(frame):
    names = frame([("x",), ("y",), ("n",), (None,)], "name string")
    segments = frame([("x", "first", 1), ("x", "second", 2), ("y", "second", 2)],
                     "name string, segment string, rank int")
    out = joins.classify_by_lookup(names, segments, "name", "other")
    assert rows_of(out) == sorted([("x", "first"), ("y", "second"), ("n", "other"), (None, "other")], key=repr)


# --- rollups, quality, peers -----------------------------------------------------------------


def test_latest_by_key(frame):
    rows = [(k, t, s, f"{k}{t}{s}" if s else None) for k in "ab" for t in (1, 3, 2) for s in (0, 5, 4)]
    df = frame(rows, "id string, ts int, seq int, v string")
    assert rows_of(rollups.latest_by_key(df, "id", ["ts", "seq"])) == [("a", 3, 5, "a35"), ("b", 3, 5, "b35")]


def test_latest_by_key_ties_and_nulls(frame):
    rows = [
        (None, 1, None, "old"), (None, 2, None, "new"), ("a", None, 1, "null is oldest"), ("a", -1, None, "kept"),
        ("b", None, None, "only"), ("c", 5, 1, "same"), ("c", 5, 1, "same"), ("d", 1, 1, "x"), ("d", 1, 1, "y"), ("d", 0, 9, "z"),
    ]
    df = frame(rows, "id string, ts int, _top0 int, v string")
    got = rows_of(rollups.latest_by_key(df, "id", ["ts", "_top0"]))
    assert [r for r in got if r[0] != "d"] == sorted(
        [(None, 2, None, "new"), ("a", -1, None, "kept"), ("b", None, None, "only"), ("c", 5, 1, "same")], key=repr)
    tied = [r for r in got if r[0] == "d"]
    assert len(tied) == 1 and tied[0] in rows
    again = rows_of(rollups.latest_by_key(df.repartition(5, "v"), "id", ["ts", "_top0"]))
    assert again == got
    assert rollups.latest_by_key(df.where("false"), "id", ["ts"]).count() == 0


def test_latest_by_key_against_all_versions(spark):
    df = spark.range(20_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 ELSE xxhash64(id) % 500 END AS k", "xxhash64(id, 1) % 40 AS ts", "xxhash64(id, 2) % 9 AS seq",
        "map('a', xxhash64(id, 3)) AS props", "xxhash64(id, 4) % 3 AS v")
    best = {}
    for r in df.collect():
        best.setdefault(r.k, []).append((r.ts, r.seq, r.v))
    rows = rollups.latest_by_key(df, ["k"], ["ts", "seq"]).collect()
    assert sorted(r.k for r in rows) == sorted(best)
    for r in rows:
        assert (r.ts, r.seq) == max(x[:2] for x in best[r.k]) and (r.ts, r.seq, r.v) in best[r.k]


def test_latest_by_key_aggregates_keys_and_order_only(spark, sf_dir):
    df = rollups.latest_by_key(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", ["ts", "event_id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Window" not in plan


def test_cap_audit_and_counts(frame):
    gold = frame([(365,), (365,), (364,)], "days_since_last_activity int")
    assert rows_of(rollups.cap_audit(gold)) == [("365 (capped)", 2, 365), ("Normal", 1, 364)]
    cats = frame([("High",), ("High",), ("Low",)], "risk_category string")
    assert rows_of(rollups.category_counts(cats)) == [(2, 0, 1)]
    assert rows_of(rollups.row_counts({"g": gold, "c": cats})) == [("c", 3), ("g", 3)]


def test_first_match_and_top_k(frame):
    df = frame([(3, "x beta"), (1, None), (2, "a beta"), (4, "gamma")], "id int, name string")
    assert rows_of(rollups.first_match(df, "name", "beta", "id")) == [(2, "a beta")]
    assert [r.id for r in rollups.top_k(df, [F.desc("id")], 2).collect()] == [4, 3]


def test_top_k_plan(frame):
    df = rollups.top_k(frame([(1, 2.0)], "id int, s double"), [F.desc("s"), F.col("id")], 3)
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().toString()


def test_story_check_names(frame):
    accounts = frame([("A", "one"), ("B", "two")], "account_id string, account_name string")
    acts = frame([("A", date(2026, 1, 2))], "account_id string, activity_date date")
    cases = frame([("B", "Open"), ("B", "In Progress")], "account_id string, status string")
    opps = frame([("A",), ("A",)], "account_id string")
    all_rows = rollups.story_check(accounts, acts, cases, opps)
    assert rows_of(all_rows) == [
        ("A", "one", 1, date(2026, 1, 2), 0, 0, 2), ("B", "two", 0, None, 2, 1, 0)]
    assert rollups.story_check(accounts, acts, cases, opps, ["two"]).count() == 1


def test_quality(frame):
    df = frame([("a", "xx", "{}"), ("b", "xxxx", '{"k": 1}'), ("b", None, None)], "id string, t string, j string")
    with pytest.raises(ValueError, match="id='b' occurs 2"):
        quality.assert_unique(df, "id")
    quality.assert_unique(df.limit(1), "id")
    assert rows_of(quality.length_violations(df, {"t": 3, "id": 5}, "id")) == [("b", "t", 4, 3)]
    assert rows_of(quality.missing_fields(["ID", "z"], df)) == [("z",)]
    assert rows_of(quality.missing_json_fields(df, "j", ["k", "m"])) == [("k", 2), ("m", 3)]
    assert quality.choose_format(df, ["ID", "T"]) == "columns"
    assert quality.choose_format(df, ["id", "score"]) == "text"


def test_peer_benchmark(frame):
    df = frame([("a", "x", 10.0), ("b", "x", 20.0), ("c", None, 4.0), ("d", None, 6.0)],
               "id string, industry string, score double")
    out = peers.peer_benchmark(df, "score")
    assert rows_of(out, "id", "industry_avg_risk", "risk_vs_industry") == [
        ("a", 15.0, -5.0), ("b", 15.0, 5.0), ("c", 5.0, -1.0), ("d", 5.0, 1.0)]


def test_whitespace(frame):
    cover = frame([(1, "x"), (1, "y"), (2, "x"), (3, None)], "customer_shipto_key bigint, family string")
    families = frame([("x",), ("y",), ("z",), (None,)], "family string")
    # customer 3 has no known product, customer 4 no order
    customers = frame([(1,), (2,), (3,), (4,), (None,)], "customer_shipto_key bigint")
    gaps = {r.customer_shipto_key: r.families for r in peers.whitespace_families(customers, cover, families).collect()}
    assert gaps == {1: ["z"], 2: ["y", "z"], 3: ["x", "y", "z"], 4: ["x", "y", "z"]}
    score = {r.customer_shipto_key: r for r in peers.whitespace_score(customers, cover, families).collect()}
    assert (score[1].families_bought, score[1].portfolio_avg_families, score[1].families_vs_portfolio) == (2, 0.75, 1.25)
    assert score[3].families_missing == score[4].families_missing == 3


# --- audit -----------------------------------------------------------------------------------


LOG = "event_time timestamp, source_ip_address string, service_name string, action_name string, " \
      "user_identity struct<email:string>, response struct<status_code:int, error_message:string>"


def test_audit_triage(frame):
    now = datetime(2026, 10, 1, 12)
    def event(hour, service, action, status):
        return (datetime(2026, 10, 1, hour), "1.2.3.4", service, action, ("u",), (status, None))
    log = frame([
        event(11, "serving-x", "list", 403),      # in both subsets
        event(11, "serving-x", "list", 403),
        event(11, "Serving", "List", 200),        # capital letter: no match
        event(10, "acc", "myEndpoint", 200),      # capital letter: no match
        event(10, "acc", "endpointGet", 200),
        event(9, "acc", "x", 403),                # exactly three hours old: out
    ], LOG)
    out = audit.sort_triage(audit.audit_triage(log, now))
    assert [(r.source, r.service_name, r.cnt) for r in out.collect()] == [
        ("403_events", "serving-x", 2), ("serving_events", "serving-x", 2), ("serving_events", "acc", 1)]


def test_cidr_match(frame):
    ips = ["13.110.5.6"] * 50 + ["160.15.255.255", "160.16.0.0", "8.8.8.8", "bad", None, "1.2.3.4", "9.9.9.9"]
    df = frame([(i, ip) for i, ip in enumerate(ips)], "id bigint, ip string")
    nets = ["13.108.0.0/14", "160.8.0.0/13", "1.2.3.4/32", "13.110.0.0/16", "junk", "9.9.9.0/33"]
    out = audit.cidr_match(df, "ip", frame([(c,) for c in nets], "cidr string"))
    hits = Counter(r.ip for r in out.collect() if r.in_allowed)
    assert out.count() == len(ips)
    assert hits == {"13.110.5.6": 50, "160.15.255.255": 1, "1.2.3.4": 1}
    assert audit.cidr_match(df, "ip", frame([("0.0.0.0/0",)], "cidr string")).where("in_allowed").count() == 55
    six = frame([(1, "2001:db8::5"), (2, "2001:db9::5"), (3, "1.2.3.4"), (4, "::ffff:8.8.8.8")], "id bigint, ip string")
    out = audit.cidr_match(six, "ip", frame([("2001:db8::/32",), ("::ffff:8.0.0.0/104",)], "cidr string"))
    assert rows_of(out.where("in_allowed"), "id") == [(1,), (4,)]


def test_subnets(frame):
    df = frame([("1.2.3.4",), ("1.2.3.9",), ("bad",), (None,)], "ip string")
    assert rows_of(audit.subnet_rollup(df, "ip")) == [("1.2.0.0/16",), ("1.2.3.0/24",)]


# --- metric layer ----------------------------------------------------------------------------


def test_metric_sets_in_one_pass(frame):
    df = frame([("a", None, 1.0), ("a", "x", 2.0), (None, "x", 4.0)], "industry string, region string, annual_revenue double")
    layer = MetricLayer(df, {"industry": F.upper("industry"), "region": F.col("region")}, {"n": F.count(F.lit(1)), "rich": F.count_if(F.col("industry") == "a")})
    out = layer.query_sets([["industry", "region"], ["industry"], ["region"], []], ["n", "rich"])
    assert sorted(map(str, rows_of(out.select("industry", "region", "grouping_id", "n", "rich")))) == sorted(map(str, [
        ("A", None, 0, 1, 1), ("A", "x", 0, 1, 1), (None, "x", 0, 1, 0), ("A", None, 1, 2, 2), (None, None, 1, 1, 0),
        (None, None, 2, 1, 1), (None, "x", 2, 2, 1), (None, None, 3, 3, 2)]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("LogicalRDD") + plan.count("LocalRelation") <= 1
    assert rows_of(layer.query_sets([[]], ["n"]).select("n", "grouping_id")) == [(3, 0)]
    with pytest.raises(KeyError):
        layer.query_sets([["nothing"]], ["n"])


def test_metric_layer(frame):
    cols = ["industry", "ml_risk_score", "risk_category", "annual_revenue", "total_closed_won", "total_closed_lost"]
    df = frame([("x", 60.0, "High", 10.0, 1.0, 1.0), ("x", 10.0, "Low", 30.0, 8.0, 0.0),
                ("y", 10.0, "Low", 1.0, 0.0, 0.0)],
               "industry string, ml_risk_score double, risk_category string, annual_revenue double, "
               "total_closed_won double, total_closed_lost double")
    layer = account_metrics(df)
    assert len(layer.dims) == 11 and len(layer.measures) == 20 and cols == df.columns
    out = layer.query(["industry"], ["account_count", "win_value_rate", "pct_high_risk"])
    assert rows_of(out) == [("x", 2, 90.0, 50.0), ("y", 1, None, 0.0)]
    whole = layer.query([], ["avg_revenue"], where=F.col("industry") == "x")
    assert rows_of(whole) == [(20.0,)]
    with pytest.raises(KeyError):
        layer.query(["nope"], ["account_count"])
