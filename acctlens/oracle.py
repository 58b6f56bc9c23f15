"""The registered queries again, as SQL over the raw test tables.

Written from the query definitions and not from the DataFrame code, so the two check each other.
Shared table expressions stand in ``_CTE``; :func:`_with` adds those a statement names.
"""

from __future__ import annotations

import re

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
LOG_KEYWORDS = ["Licensed", "License", "reserved", "@mail"]
ASSESSED = "2024-01-31T12:00:00.000Z"

_CTE: dict[str, str] = {
    # --- entity tables
    "sf_account": """
        SELECT 'AC-' || c_custkey AS Id, c_name AS Name, c_mktsegment AS Industry,
               greatest(c_acctbal, 0.0) * 100 AS AnnualRevenue, c_custkey,
               CASE WHEN c_acctbal < -500 THEN 'Partner' ELSE 'CRM Import' END AS AccountSource,
               'A-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS account_id
        FROM customer""",
    "ev": """
        SELECT event_id, event_type, value, ts, user_id, 'AC-' || user_id AS AccountId,
               'A-' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS account_id,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value < 1 AS IsDeleted
        FROM events""",
    "sf_task": "SELECT AccountId, CAST(ts AS DATE) AS ActivityDate FROM ev WHERE event_type <> 'error' AND NOT IsDeleted",
    "sf_case": """
        SELECT AccountId, value < 30 AS IsClosed, value > 100 AS IsEscalated,
               CASE WHEN k >= 95 THEN 'Critical' WHEN k >= 90 THEN 'High' WHEN k >= 40 THEN 'Medium' ELSE 'Low' END AS Priority
        FROM ev WHERE event_type = 'error' AND NOT IsDeleted""",
    "ship": """
        SELECT o_custkey AS ck, l_returnflag = 'R' AND l_linestatus = 'O' AS back, l_quantity AS qty,
               CAST(o_orderdate AS DATE) + 30 AS promised, CAST(l_shipdate AS DATE) AS actual
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    # --- metrics
    "account_base": """
        SELECT Id AS sf_account_id, Name AS account_name, Industry AS industry,
               AnnualRevenue AS annual_revenue, c_custkey AS customer_shipto_key
        FROM sf_account WHERE AccountSource = 'CRM Import'""",
    "sales_org": """
        SELECT c_custkey AS customer_shipto_key, 'Rep ' || n_name AS rep_name,
               'Manager ' || r_name AS manager_name, n_name AS business_unit, r_name AS region
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "activity_metrics": """
        SELECT AccountId AS sf_account_id, max(ActivityDate) AS last_date,
               DATE '2024-01-31' - max(ActivityDate) AS days, count(*) AS total_activities,
               CAST(sum(CASE WHEN ActivityDate >= DATE '2024-01-24' THEN 1 ELSE 0 END) AS BIGINT) AS recent_activities_90d
        FROM sf_task GROUP BY 1""",
    "contact_metrics": """
        SELECT 'AC-' || user_id AS sf_account_id, count(DISTINCT event_type) AS total_contacts
        FROM events GROUP BY 1""",
    "opp_metrics": """
        SELECT 'AC-' || o_custkey AS sf_account_id,
               round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS open_pipeline_value,
               round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS total_closed_won,
               round(sum(CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN o_totalprice ELSE 0 END), 2) AS total_closed_lost,
               count(*) FILTER (o_orderstatus <> 'O') AS total_closed_opps,
               count(*) FILTER (o_orderstatus = 'F') AS total_won_opps,
               round(CASE WHEN count(*) FILTER (o_orderstatus <> 'O') > 0 THEN
                   CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) * 100.0
                   / count(*) FILTER (o_orderstatus <> 'O') END, 1) AS win_rate_pct,
               array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS opp_product_families
        FROM orders GROUP BY 1""",
    "case_metrics": """
        SELECT AccountId AS sf_account_id, count(*) AS total_cases,
               count(*) FILTER (NOT IsClosed) AS open_case_count,
               count(*) FILTER (IsEscalated) AS escalated_case_count,
               count(*) FILTER (Priority IN ('High', 'Critical') AND NOT IsClosed) AS high_priority_open_cases
        FROM sf_case GROUP BY 1""",
    "order_metrics": """
        SELECT o_custkey AS customer_shipto_key, count(DISTINCT o_orderkey) AS total_orders,
               round(sum(l_quantity * (l_extendedprice / l_quantity)), 2) AS total_order_value,
               avg(l_quantity * (l_extendedprice / l_quantity)) AS avg_line_value, count(*) AS valued_lines
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
    "backorder_metrics": """
        SELECT ck AS customer_shipto_key, count(*) FILTER (back) AS backorder_line_count,
               sum(CASE WHEN back THEN qty ELSE 0.0 END) AS total_backorder_qty, sum(qty) AS total_shipped_qty,
               round(CASE WHEN sum(qty) > 0 THEN sum(CASE WHEN back THEN qty ELSE 0.0 END) * 100.0 / sum(qty) ELSE 0 END, 1)
                   AS pct_qty_backordered
        FROM ship GROUP BY 1""",
    "coverage": """
        SELECT DISTINCT o_custkey AS customer_shipto_key, p_type AS family
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey""",
    "product_coverage": """
        SELECT customer_shipto_key, count(family) AS product_families_purchased,
               array_to_string(list_sort(list(family)), ', ') AS product_family_list
        FROM coverage GROUP BY 1""",
    "parts": """
        SELECT ab.*, so.rep_name, so.manager_name, so.business_unit, so.region,
               CAST(am.last_date AS VARCHAR) AS last_activity_date,
               least(365, coalesce(am.days, 365)) AS days_since_last_activity,
               coalesce(am.total_activities, 0) AS total_activities,
               coalesce(am.recent_activities_90d, 0) AS recent_activities_90d,
               coalesce(cm.total_contacts, 0) AS total_contacts,
               coalesce(om.open_pipeline_value, 0) AS open_pipeline_value,
               coalesce(om.total_closed_won, 0) AS total_closed_won,
               coalesce(om.total_closed_lost, 0) AS total_closed_lost,
               om.win_rate_pct, om.opp_product_families,
               coalesce(cs.total_cases, 0) AS total_cases,
               coalesce(cs.open_case_count, 0) AS open_case_count,
               coalesce(cs.escalated_case_count, 0) AS escalated_case_count,
               coalesce(cs.high_priority_open_cases, 0) AS high_priority_open_cases,
               coalesce(ord.total_orders, 0) AS total_orders,
               coalesce(ord.total_order_value, 0) AS total_order_value,
               CAST(CAST(ord.avg_line_value AS FLOAT) AS DOUBLE) AS avg_line_value,
               coalesce(bo.backorder_line_count, 0) AS backorder_line_count,
               coalesce(bo.total_backorder_qty, 0) AS total_backorder_qty,
               coalesce(bo.pct_qty_backordered, 0) AS pct_qty_backordered,
               coalesce(pc.product_families_purchased, 0) AS product_families_purchased,
               pc.product_family_list
        FROM account_base ab
        LEFT JOIN sales_org so USING (customer_shipto_key)
        LEFT JOIN activity_metrics am USING (sf_account_id)
        LEFT JOIN contact_metrics cm USING (sf_account_id)
        LEFT JOIN opp_metrics om USING (sf_account_id)
        LEFT JOIN case_metrics cs USING (sf_account_id)
        LEFT JOIN order_metrics ord USING (customer_shipto_key)
        LEFT JOIN backorder_metrics bo USING (customer_shipto_key)
        LEFT JOIN product_coverage pc USING (customer_shipto_key)""",
    "gold": """
        SELECT *, days_since_last_activity > 90 AS is_stale_account,
               escalated_case_count > 0 AS has_escalated_cases,
               backorder_line_count > 0 AS has_backorders,
               CAST(least(100, round(least(40, days_since_last_activity * 0.2)
                   + least(25, escalated_case_count * 12.5) + least(25, pct_qty_backordered * 1.5)
                   + least(10, high_priority_open_cases * 5))) AS DOUBLE) AS risk_score_raw
        FROM parts""",
    "scored": """
        SELECT *, round(risk_score_raw, 1) AS ml_risk_score,
               CASE WHEN risk_score_raw >= 55 THEN 'High' WHEN risk_score_raw >= 25 THEN 'Medium' ELSE 'Low' END AS risk_category,
               CASE WHEN days_since_last_activity > 90 THEN 'Inactivity (' || days_since_last_activity || ' days)'
                    WHEN pct_qty_backordered > 15 THEN 'Backorder Exposure (' || CAST(round_even(pct_qty_backordered, 0) AS BIGINT) || '%)'
                    WHEN open_case_count > 3 THEN 'Open Cases (' || open_case_count || ')'
                    WHEN open_pipeline_value = 0 THEN 'No Active Pipeline' ELSE 'Healthy' END AS top_risk_driver
        FROM gold""",
    # --- insights
    "trend_sums": """
        SELECT o_custkey AS customer_shipto_key,
               sum(CASE WHEN o_orderdate >= DATE '2001-08-02' - 90 THEN o_totalprice ELSE 0 END) AS recent,
               sum(CASE WHEN o_orderdate < DATE '2001-08-02' - 90 THEN o_totalprice ELSE 0 END) AS prior
        FROM orders
        WHERE o_orderdate >= DATE '2001-08-02' - 180 AND o_orderdate < DATE '2001-08-02' GROUP BY 1""",
    "revenue_trend": """
        SELECT customer_shipto_key, round(recent, 2) AS recent_revenue, round(prior, 2) AS prior_revenue,
               CASE WHEN prior <> 0 THEN round((recent - prior) * 100.0 / prior, 1) END AS rev_trend_pct
        FROM trend_sums""",
    "delivery_reliability": """
        SELECT ck AS customer_shipto_key,
               round(avg(CASE WHEN actual > promised THEN 100.0 ELSE 0.0 END), 1) AS pct_delivery_pushed,
               round(avg(CASE WHEN actual > promised THEN actual - promised END), 1) AS avg_days_pushed
        FROM ship GROUP BY 1""",
    "bought": """
        SELECT c_custkey AS customer_shipto_key, count(family) AS n
        FROM customer LEFT JOIN coverage ON customer_shipto_key = c_custkey GROUP BY 1""",
    "whitespace_score": """
        SELECT customer_shipto_key, n AS families_bought,
               round((SELECT avg(n) FROM bought), 2) AS portfolio_avg_families,
               round(n - (SELECT avg(n) FROM bought), 2) AS families_vs_portfolio,
               (SELECT count(DISTINCT p_type) FROM part) - n AS families_missing
        FROM bought""",
    "peers": """
        SELECT *, avg(ml_risk_score) OVER (PARTITION BY industry) AS industry_avg FROM scored""",
    "insights": """
        SELECT sf_account_id, industry, rev_trend_pct, round(industry_avg, 4) AS industry_avg_risk,
               round(ml_risk_score - industry_avg, 1) AS risk_vs_industry,
               round(ml_risk_score * annual_revenue / 100.0, 2) AS revenue_at_risk,
               pct_delivery_pushed, avg_days_pushed, families_bought, portfolio_avg_families,
               families_vs_portfolio, families_missing
        FROM peers LEFT JOIN revenue_trend USING (customer_shipto_key)
        LEFT JOIN delivery_reliability USING (customer_shipto_key)
        LEFT JOIN whitespace_score USING (customer_shipto_key)""",
    # --- decisions
    "signals": """
        SELECT s.*, i.* EXCLUDE (sf_account_id, industry),
               greatest(0.0, -coalesce(i.rev_trend_pct, 0.0)) / 100.0 AS fall
        FROM scored s JOIN insights i USING (sf_account_id)""",
    "logits": """
        SELECT sf_account_id,
               CAST(days_since_last_activity AS DOUBLE) / CAST(90.0 AS DOUBLE) + fall AS a1,
               CAST(pct_qty_backordered AS DOUBLE) / CAST(15.0 AS DOUBLE) + CAST(open_case_count AS DOUBLE) / CAST(3.0 AS DOUBLE) AS a2,
               CASE WHEN open_pipeline_value > 0 THEN ml_risk_score / CAST(25.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS a3,
               (100.0 - ml_risk_score) / CAST(40.0 AS DOUBLE) AS a4, CAST(1.0 AS DOUBLE) AS a5,
               least(4.0, greatest(0.0, ml_risk_score / CAST(25.0 AS DOUBLE))) AS urgency,
               (ml_risk_score - 55.0) / CAST(10.0 AS DOUBLE) + fall AS attention
        FROM signals""",
    "exps": """
        SELECT *, exp(a1 - greatest(a1, a2, a3, a4, a5)) AS e1, exp(a2 - greatest(a1, a2, a3, a4, a5)) AS e2,
               exp(a3 - greatest(a1, a2, a3, a4, a5)) AS e3, exp(a4 - greatest(a1, a2, a3, a4, a5)) AS e4,
               exp(a5 - greatest(a1, a2, a3, a4, a5)) AS e5
        FROM logits""",
    "probs": """
        SELECT *, round(e1 / (e1 + e2 + e3 + e4 + e5), 6) AS p1, round(e2 / (e1 + e2 + e3 + e4 + e5), 6) AS p2,
               round(e3 / (e1 + e2 + e3 + e4 + e5), 6) AS p3, round(e4 / (e1 + e2 + e3 + e4 + e5), 6) AS p4,
               round(e5 / (e1 + e2 + e3 + e4 + e5), 6) AS p5
        FROM exps""",
    "decisions": """
        SELECT sf_account_id,
               CASE greatest(p1, p2, p3, p4, p5) WHEN p1 THEN 're_engage' WHEN p2 THEN 'escalate_ops'
                   WHEN p3 THEN 'protect_pipeline' WHEN p4 THEN 'expand_relationship' ELSE 'routine_checkin' END AS action_type,
               round(greatest(e1, e2, e3, e4, e5) / (e1 + e2 + e3 + e4 + e5), 4) AS action_confidence,
               round(urgency, 2) AS urgency_score,
               ['Routine', 'Low', 'Medium', 'High', 'Critical'][CAST(round(urgency) AS INTEGER) + 1] AS urgency_label,
               round(1.0 - abs(urgency - CAST(round(urgency) AS INTEGER)), 4) AS urgency_confidence,
               round(1.0 / (1.0 + exp(-attention)), 4) AS exec_attention_prob,
               p1 AS re_engage, p2 AS escalate_ops, p3 AS protect_pipeline, p4 AS expand_relationship, p5 AS routine_checkin
        FROM probs""",
    "texts": """
        SELECT sf_account_id, unnest([
            {'w': CASE WHEN days_since_last_activity > 90 THEN CAST(days_since_last_activity AS DOUBLE) / CAST(90.0 AS DOUBLE) ELSE 0.0 END, 'i': 0,
             't': 'Book a visit: no contact for ' || days_since_last_activity || ' days.'},
            {'w': CASE WHEN pct_qty_backordered > 15 THEN CAST(pct_qty_backordered AS DOUBLE) / CAST(15.0 AS DOUBLE) ELSE 0.0 END, 'i': 1,
             't': 'Review backorders: ' || CAST(round(pct_qty_backordered) AS BIGINT) || '% of the quantity is open.'},
            {'w': CAST(open_case_count AS DOUBLE) / CAST(4.0 AS DOUBLE), 'i': 2, 't': 'Close open cases: ' || open_case_count || ' are waiting.'},
            {'w': CASE WHEN rev_trend_pct < 0 THEN -rev_trend_pct / CAST(50.0 AS DOUBLE) ELSE 0.0 END, 'i': 3,
             't': 'Ask about the drop in orders: revenue changed by ' || CAST(round(coalesce(rev_trend_pct, 0)) AS BIGINT) || '%.'},
            {'w': CASE WHEN pct_delivery_pushed > 25 THEN CAST(pct_delivery_pushed AS DOUBLE) / CAST(100.0 AS DOUBLE) ELSE 0.0 END, 'i': 4,
             't': 'Explain deliveries: ' || CAST(round(coalesce(pct_delivery_pushed, 0)) AS BIGINT) || '% of the lines shipped late.'},
            {'w': CASE WHEN open_pipeline_value > 0 THEN 0.4 ELSE 0.0 END, 'i': 5,
             't': 'Secure the open pipeline of ' || CAST(round(open_pipeline_value) AS BIGINT) || '.'},
            {'w': CASE WHEN families_missing > 0 THEN 0.3 ELSE 0.0 END, 'i': 6,
             't': 'Offer product families not bought yet: ' || coalesce(families_missing, 0) || '.'},
            {'w': 0.2, 'i': 7, 't': 'Keep the regular check-in.'},
            {'w': 0.1, 'i': 8, 't': 'Confirm the contact list.'},
            {'w': 0.05, 'i': 9, 't': 'Share the latest catalog.'}]) AS r
        FROM signals""",
    "ranked": """
        SELECT sf_account_id, r.t AS t,
               row_number() OVER (PARTITION BY sf_account_id ORDER BY round(r.w, 6) DESC, r.i) AS n
        FROM texts WHERE r.w > 0""",
    "recommended": """
        SELECT sf_account_id, string_agg(t, chr(10) ORDER BY n) AS recommendations
        FROM ranked WHERE n <= 3 GROUP BY 1""",
    "briefing": """
        SELECT sf_account_id, account_name, ml_risk_score, risk_category, action_type, action_confidence,
               urgency_score, exec_attention_prob, top_risk_driver, recommendations, rev_trend_pct,
               revenue_at_risk, risk_vs_industry, industry, pct_delivery_pushed
        FROM signals JOIN decisions USING (sf_account_id) JOIN recommended USING (sf_account_id)""",
    # --- customer tables before the load
    "crm_opps": """
        SELECT 'O-' || o_orderkey AS opportunity_id,
               'A-' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS account_id,
               'Order ' || o_orderkey || ' - ' || o_orderpriority AS opportunity_name,
               CASE WHEN o_orderstatus = 'F' THEN 'Closed Won' WHEN o_orderstatus = 'P' THEN 'Closed Lost'
                    WHEN o_orderpriority = '1-URGENT' THEN 'Negotiation/Review'
                    WHEN o_orderpriority = '2-HIGH' THEN 'Proposal/Price Quote'
                    WHEN o_orderpriority = '3-MEDIUM' THEN 'Qualification' ELSE 'Prospecting' END AS stage_name,
               o_totalprice AS amount, CAST(o_orderdate AS DATE) + 60 AS close_date, o_orderpriority AS product_family
        FROM orders""",
    "opps": """
        SELECT *, CAST(CASE stage_name WHEN 'Prospecting' THEN 10 WHEN 'Qualification' THEN 25
                   WHEN 'Proposal/Price Quote' THEN 50 WHEN 'Negotiation/Review' THEN 75
                   WHEN 'Closed Won' THEN 100 ELSE 0 END AS INTEGER) AS probability,
               CASE stage_name WHEN 'Prospecting' THEN 'Pipeline' WHEN 'Qualification' THEN 'Pipeline'
                   WHEN 'Proposal/Price Quote' THEN 'Best Case' WHEN 'Negotiation/Review' THEN 'Commit'
                   WHEN 'Closed Won' THEN 'Closed' ELSE 'Omitted' END AS forecast_category
        FROM crm_opps""",
    "crm_cases": """
        SELECT CAST(event_id AS VARCHAR) AS case_id, account_id, ['Instrument Service', 'Shipping Issue', 'Billing Dispute', 'Product Quality', 'Order Inquiry', 'Technical Support'][k % 6 + 1] AS case_type,
               CASE WHEN value > 100 THEN 'Escalated' WHEN value < 30 THEN 'Closed'
                    WHEN value < 60 THEN 'In Progress' ELSE 'Open' END AS status,
               CASE WHEN k >= 95 THEN 'Critical' WHEN k >= 90 THEN 'High' WHEN k >= 40 THEN 'Medium' ELSE 'Low' END AS priority
        FROM ev WHERE event_type = 'error'""",
    "mapped": "SELECT account_id, Id AS sf_account_id FROM sf_account",
    "loaded": "SELECT account_id, Id AS sf_account_id FROM sf_account WHERE AnnualRevenue > 0",
    "described": """
        SELECT Id, 'CDM Key: ' || c_custkey || ' | Demo Account ID: ' || account_id AS Description FROM sf_account""",
    # --- audit log
    "audit": """
        SELECT event_id, ts AS event_time,
               CASE user_id % 3 WHEN 0 THEN '13.110.' WHEN 1 THEN '10.0.' ELSE '172.20.' END
                   || (user_id % 256) || '.' || (event_id % 256) AS source_ip_address,
               CASE WHEN event_type IN ('click', 'error') THEN 'serving-endpoints' ELSE 'accounts' END AS service_name,
               CASE WHEN event_type = 'click' THEN 'invocation' ELSE event_type END AS action_name,
               'user' || user_id || '@example.com' AS auth_email,
               CAST(CASE WHEN event_type = 'error' THEN 403 ELSE 200 END AS INTEGER) AS status_code,
               CASE WHEN event_type = 'error' THEN 'request rejected' END AS error_message
        FROM events""",
    "recent_audit": "SELECT * FROM audit WHERE event_time > TIMESTAMP '2024-01-31' - INTERVAL 72 HOURS",
}

_TRIAGE = "service_name, action_name, source_ip_address, auth_email, status_code, error_message"


def _with(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a statement with the table expressions it needs, in order of definition."""
    known = {**_CTE, **(extra or {})}
    needed: set[str] = set()
    queue = [body]
    while queue:
        sql = queue.pop()
        for name, text in known.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
                needed.add(name)
                queue.append(text)
    parts = [f"{name} AS ({text.strip()})" for name, text in known.items() if name in needed]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


# CRC-32 of an account id, bit by bit; the constants are those of the checksum itself.
_CRC = """xor(4294967295::UBIGINT, list_reduce(list_transform(string_split(sf_account_id, ''), lambda s: ascii(s)::UBIGINT),
    lambda c, b: list_reduce(range(8)::UBIGINT[], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END,
                             xor(c, b)), 4294967295::UBIGINT))"""

# Networks of the customers: IPv4 ends within 172.20/16, IPv6 ends within 2001:db8/32. Offsets are cut to the network.
_LEDGER = """
    SELECT f // fs * fs AS four_low, f // fs * fs + fs - 1 AS four_high, s // ss * ss AS six_low, s // ss * ss + ss - 1 AS six_high
    FROM (SELECT c_custkey % 256 * 256 + c_custkey * 7 % 256 AS f, CAST(1 AS BIGINT) << CAST(12 - c_custkey % 13 AS INTEGER) AS fs,
                 CAST(c_custkey % 4096 AS HUGEINT) << 80 AS s, CAST(1 AS HUGEINT) << CAST(95 - c_custkey % 90 AS INTEGER) AS ss FROM customer)"""


def _cidr_test(ip: str) -> str:
    """13.110.0.0/15, 192.0.2.0/24, 198.51.100.0/24 and 2001:db8::/32, by the texts of their addresses."""
    return (
        f"(starts_with({ip}, '13.110.') OR starts_with({ip}, '13.111.') OR starts_with({ip}, '192.0.2.') "
        f"OR starts_with({ip}, '198.51.100.') OR starts_with({ip}, '2001:db8:'))"
    )


def oracle_sql() -> dict[str, str]:
    log_test = " OR ".join(f"contains(line, '{k}')" for k in LOG_KEYWORDS)
    features = (
        "sf_account_id, annual_revenue, CAST(days_since_last_activity AS DOUBLE) AS days_since_last_activity, "
        + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in [
            "total_activities", "recent_activities_90d", "total_contacts", "open_pipeline_value",
            "total_closed_won", "total_closed_lost", "total_cases", "open_case_count",
            "escalated_case_count", "high_priority_open_cases", "total_orders", "total_order_value",
            "backorder_line_count", "total_backorder_qty", "pct_qty_backordered", "product_families_purchased",
        ])
    )
    score_text = (
        "'CDM Key: ' || customer_shipto_key || ' | Risk Score: ' || ml_risk_score || "
        f"' | Risk Category: ' || risk_category || ' | Assessed: {ASSESSED}'"
    )
    broken = "c_acctbal >= 0 AND c_mktsegment = 'MACHINERY'"
    bodies = {
        "scan_counts": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in RAW_TABLES),
        "log_filter": f"""
            SELECT doc_id, CAST(n - 1 AS INTEGER) AS line_no,
                   substr(trim(line, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)), 1, 300) AS value
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)
            WHERE {log_test}""",
        "outbound_records": f"SELECT sf_account_id AS id, 'Account' AS kind, {score_text} AS description FROM scored",
        "outbound_batches": "SELECT count(*) AS records, CAST(0 AS BIGINT) AS oversized, CAST(0 AS BIGINT) AS repeated_ids FROM scored",
        "delivery_ledger": """
            SELECT 'AC-' || k AS id, 1 + CAST(k % 3 = 0 OR k % 5 = 0 AS BIGINT) AS sent,
                   CASE WHEN k % 3 = 0 THEN 1 WHEN k % 5 = 0 THEN 2 ELSE 1 END AS delivered,
                   CAST(k % 3 = 0 AND k % 5 = 0 AS BIGINT) AS failed
            FROM (SELECT c_custkey AS k FROM customer)""",
        "metric_sets": """
            SELECT industry, region, CAST(grouping(industry, region) AS BIGINT) AS grouping_id, count(*) AS account_count,
                   CAST(sum(total_orders) AS BIGINT) AS total_orders, CAST(sum(open_case_count) AS BIGINT) AS open_cases,
                   count(*) FILTER (risk_category = 'High') AS high_risk_accounts,
                   round(count(*) FILTER (risk_category = 'High') * 100.0::DOUBLE / count(*), 6) AS pct_high_risk,
                   round(CASE WHEN sum(total_closed_won + total_closed_lost) <> 0
                         THEN sum(total_closed_won) * 100.0::DOUBLE / sum(total_closed_won + total_closed_lost) END, 6) AS win_value_rate
            FROM scored GROUP BY GROUPING SETS ((industry, region), (industry), (region), ())""",
        "ml_folds": f"""
            SELECT * FROM (WITH f AS (SELECT {_CRC} % 4 AS fold, CAST(risk_score_raw AS DOUBLE) AS y FROM gold),
            s AS (SELECT fold, count(*) AS n, sum(y) AS total FROM f GROUP BY 1),
            a AS (SELECT count(*) AS n, sum(y) AS total FROM f),
            m AS (SELECT s.fold, a.n - s.n AS trained, (a.total - s.total) / (a.n - s.n) AS mean FROM s, a)
            SELECT CAST(f.fold AS INTEGER) AS fold, count(*) AS rows, any_value(trained) AS trained,
                   round(avg(abs(y - mean)), 6) AS mean_error, true AS better FROM f JOIN m ON m.fold = f.fold GROUP BY f.fold)""",
        "ml_permutation_checks": "SELECT CAST(18 AS BIGINT) AS features, true AS days_matter",
        "assessed_text": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') AS assessed FROM events",
        "missing_columns": "SELECT unnest(['Risk_Score__c', 'Risk_Category__c', 'Last_Risk_Assessment__c']) AS field",
        "ml_score_checks": "SELECT count(*) AS rows, count(*) AS accounts, true AS small_error FROM gold",
        "ml_importance_checks": "SELECT CAST(18 AS BIGINT) AS features, CAST(1.0 AS DOUBLE) AS total, true AS none_negative",
        "reconcile_objects": """
            SELECT CASE WHEN event_id % 2 = 0 THEN 'Account' ELSE 'Contact' END AS object,
                   count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed
            FROM events GROUP BY 1""",
        "reconcile_results": """
            SELECT count(*) FILTER (event_type <> 'error') AS succeeded,
                   count(*) FILTER (event_type = 'error') AS failed FROM events""",
        "reconcile_errors": """
            SELECT event_id AS id, 'rejected ' || props AS errors FROM events
            WHERE event_type = 'error' ORDER BY event_id LIMIT 3""",
        "account_base": "SELECT * FROM account_base",
        "sales_org": "SELECT * FROM sales_org",
        "activity_metrics": """
            SELECT sf_account_id, CAST(last_date AS VARCHAR) AS last_activity_date, CAST(days AS INTEGER) AS days_since_last_activity,
                   total_activities, recent_activities_90d FROM activity_metrics""",
        "contact_metrics": "SELECT * FROM contact_metrics",
        "opp_metrics": "SELECT * FROM opp_metrics",
        "case_metrics": "SELECT * FROM case_metrics",
        "order_metrics": """
            SELECT customer_shipto_key, total_orders, total_order_value,
                   total_order_value / valued_lines AS avg_line_value, valued_lines FROM order_metrics""",
        "backorder_metrics": "SELECT * FROM backorder_metrics",
        "product_coverage": "SELECT * FROM product_coverage",
        "customer_360": "SELECT * FROM gold",
        "risk_score_raw": "SELECT sf_account_id, risk_score_raw FROM gold",
        "risk_flags": "SELECT sf_account_id, is_stale_account, has_escalated_cases, has_backorders FROM gold",
        "cap_audit": """
            SELECT CASE WHEN days_since_last_activity >= 365 THEN '365 (capped)' ELSE 'Normal' END AS status,
                   count(*) AS accounts, CAST(max(days_since_last_activity) AS INTEGER) AS max_days FROM gold GROUP BY 1""",
        "feature_matrix": f"SELECT {features} FROM gold",
        "json_roundtrip": """
            SELECT sf_account_id, annual_revenue, CAST(days_since_last_activity AS DOUBLE) AS days_since_last_activity,
                   CAST(total_orders AS DOUBLE) AS total_orders, CAST(pct_qty_backordered AS DOUBLE) AS pct_qty_backordered,
                   CAST(product_families_purchased AS DOUBLE) AS product_families_purchased FROM gold""",
        "risk_category_counts": """
            SELECT count(*) FILTER (risk_category = 'High') AS high, count(*) FILTER (risk_category = 'Medium') AS medium,
                   count(*) FILTER (risk_category = 'Low') AS low FROM scored""",
        "top_risk_driver": "SELECT sf_account_id, top_risk_driver FROM scored",
        "account_risk_summary": """
            SELECT sf_account_id, account_name, ml_risk_score, risk_category, CAST(days_since_last_activity AS INTEGER) AS days_since_last_activity,
                   pct_qty_backordered, open_pipeline_value, annual_revenue, open_case_count, top_risk_driver FROM scored""",
        "top_risk_accounts": """
            SELECT sf_account_id, account_name, ml_risk_score, risk_category FROM scored
            ORDER BY ml_risk_score DESC, sf_account_id LIMIT 15""",
        "on_demand_score": """
            SELECT r.event_id AS request_id, 'AC-' || (r.user_id * 11) AS sf_account_id, s AS risk_score,
                   CASE WHEN s >= 55 THEN 'High' WHEN s >= 25 THEN 'Medium' ELSE 'Low' END AS risk_category,
                   g.sf_account_id IS NOT NULL AS found, true AS success, CAST(NULL AS VARCHAR) AS error
            FROM ev r LEFT JOIN gold g ON g.sf_account_id = 'AC-' || (r.user_id * 11),
            LATERAL (SELECT CAST(least(100, round(
                least(40, CASE WHEN r.k >= 50 THEN r.k ELSE coalesce(g.days_since_last_activity, 0) END * 0.2)
                + least(25, coalesce(g.escalated_case_count, 0) * 12.5) + least(25, coalesce(g.pct_qty_backordered, 0) * 1.5)
                + least(10, coalesce(g.high_priority_open_cases, 0) * 5))) AS DOUBLE) AS s)""",
        "story_check": """
            SELECT a.account_id, a.Name AS account_name, coalesce(total_activities, 0) AS total_activities, last_activity_date,
                   coalesce(total_cases, 0) AS total_cases, coalesce(open_or_escalated, 0) AS open_or_escalated,
                   coalesce(total_opportunities, 0) AS total_opportunities
            FROM sf_account a
            LEFT JOIN (SELECT account_id, count(*) AS total_activities, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS last_activity_date
                       FROM ev WHERE event_type <> 'error' GROUP BY 1) USING (account_id)
            LEFT JOIN (SELECT account_id, count(*) AS total_cases, count(*) FILTER (status IN ('Open', 'Escalated')) AS open_or_escalated
                       FROM crm_cases GROUP BY 1) USING (account_id)
            LEFT JOIN (SELECT account_id, count(*) AS total_opportunities FROM crm_opps GROUP BY 1) USING (account_id)""",
        "stage_summary": "SELECT stage_name, count(*) AS deals, round(sum(amount), 2) AS total_value FROM crm_opps GROUP BY 1",
        "family_summary": "SELECT product_family, count(*) AS deals, round(sum(amount), 2) AS total_value FROM crm_opps GROUP BY 1",
        "case_matrix": "SELECT case_type, status, count(*) AS cases FROM crm_cases GROUP BY 1, 2",
        "stage_forecast": "SELECT opportunity_id, stage_name, probability, forecast_category FROM opps",
        "segment_lookup": """
            WITH placed AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
            SELECT c_custkey, n_name, r_name AS segment FROM placed
            UNION ALL SELECT c_custkey, r_name, 'Regional Lab' FROM placed""",
        "account_owner": """
            SELECT account_id, c.c_custkey AS customer_shipto_key, 'Rep ' || n_name AS owner_rep_name
            FROM sf_account a LEFT JOIN customer c USING (c_custkey) LEFT JOIN nation ON c_nationkey = n_nationkey""",
        "key_mapping": """
            SELECT Id AS sf_account_id, CAST(regexp_extract(Description, 'CDM Key: *([0-9]+)', 1) AS BIGINT) AS customer_shipto_key,
                   trim(split_part(Description, 'Demo Account ID:', 2)) AS account_id FROM described""",
        "key_mapping_changes": """
            SELECT 'AC-' || event_id AS sf_account_id, CASE WHEN value > 20 THEN user_id END AS customer_shipto_key,
                   'A-' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS account_id
            FROM events WHERE event_type <> 'error'
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
        "fk_resolve": "SELECT case_id, account_id, sf_account_id FROM crm_cases JOIN mapped USING (account_id)",
        "fk_orphans": """
            SELECT count(sf_account_id) AS matched, count(*) - count(sf_account_id) AS skipped
            FROM crm_cases LEFT JOIN loaded USING (account_id)""",
        "crm_account_payload": """
            SELECT Name, Industry, AnnualRevenue, 'CDM Key: ' || c_custkey || ' | Demo Account ID: ' || account_id AS Description,
                   'Customer' AS Type, 'CRM Import' AS AccountSource FROM sf_account""",
        "crm_contact_payload": """
            SELECT sf_account_id AS AccountId, upper(event_type[1]) || event_type[2:] AS FirstName, 'User' || user_id AS LastName,
                   'Buyer' AS Title, event_type || '.' || user_id || '@example.com' AS Email, '(555) 555-0100' AS Phone
            FROM (SELECT DISTINCT user_id, account_id, event_type FROM ev) JOIN mapped USING (account_id)""",
        "crm_opportunity_payload": """
            SELECT sf_account_id AS AccountId, substr(opportunity_name, 1, 120) AS Name, stage_name AS StageName, amount AS Amount,
                   CAST(close_date AS VARCHAR) AS CloseDate, probability AS Probability, forecast_category AS ForecastCategoryName,
                   'Product Family: ' || product_family AS Description
            FROM opps JOIN mapped USING (account_id)""",
        "crm_case_payload": """
            SELECT sf_account_id AS AccountId, substr(case_type || ' - ' || account_id, 1, 255) AS Subject,
                   CASE status WHEN 'Open' THEN 'New' WHEN 'Escalated' THEN 'Escalated' WHEN 'Closed' THEN 'Closed' ELSE 'Working' END AS Status,
                   priority AS Priority, case_type AS Type, 'CRM Import' AS Origin
            FROM crm_cases JOIN mapped USING (account_id)""",
        "crm_task_payload": """
            SELECT sf_account_id AS WhatId, event_type || ' ' || event_id AS Subject, CAST(CAST(ts AS DATE) AS VARCHAR) AS ActivityDate,
                   CASE WHEN value >= 5 THEN 'Completed' ELSE 'Not Started' END AS Status, 'Normal' AS Priority,
                   'Type: ' || CASE event_type WHEN 'click' THEN 'Call' WHEN 'view' THEN 'Email' ELSE 'Meeting' END
                       || ' | Created by: Rep ' || user_id AS Description
            FROM ev JOIN mapped USING (account_id) WHERE event_type <> 'error'""",
        "text_codec_write": f"SELECT sf_account_id AS Id, {score_text} AS Description FROM scored",
        "text_codec_parse": f"""
            SELECT 'AC-' || c_custkey AS sf_account_id,
                   CASE WHEN c_acctbal >= 0 AND NOT ({broken}) THEN c_name END AS account_name,
                   CASE WHEN c_acctbal >= 0 AND NOT ({broken}) THEN round(c_acctbal / 100.0::DOUBLE, 1) END AS risk_score,
                   CASE WHEN c_acctbal < 0 OR ({broken}) THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 'High' ELSE 'Medium' END AS risk_category,
                   CASE WHEN c_acctbal >= 0 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN '{ASSESSED}' END AS assessed,
                   c_acctbal >= 0 AND NOT ({broken}) AS success,
                   CASE WHEN c_acctbal < 0 THEN 'No risk score found. Run the batch scoring job first.'
                        WHEN {broken} THEN 'Risk score is not a number.' END AS error
            FROM customer""",
        "length_violations": """
            SELECT doc_id, 'text' AS field, CAST(length(text) AS INTEGER) AS length, 2000 AS max_length FROM documents WHERE length(text) > 2000
            UNION ALL
            SELECT doc_id, 'source', CAST(length(source) AS INTEGER), 4 FROM documents WHERE length(source) > 4""",
        "missing_fields": """
            SELECT field, count(*) AS rows_missing FROM events, (SELECT unnest(['k', 'label', 'score']) AS field)
            WHERE NOT json_exists(props, '$.' || field) GROUP BY 1""",
        "latest_by_key": """
            SELECT event_id, user_id, event_type, value, props FROM events
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
        "metric_by_industry": """
            SELECT industry, count(*) AS account_count, round(sum(annual_revenue), 2) AS total_revenue,
                   count(*) FILTER (risk_category = 'High') AS high_risk_accounts,
                   round(count(*) FILTER (risk_category = 'High') * 100.0::DOUBLE / count(*), 6) AS pct_high_risk,
                   max(ml_risk_score) AS max_risk_score, round(avg(ml_risk_score), 6) AS avg_risk_score,
                   round(sum(ml_risk_score * annual_revenue / 100.0), 2) AS revenue_at_risk,
                   count(*) FILTER (is_stale_account) AS stale_accounts, CAST(sum(total_activities) AS BIGINT) AS total_activities,
                   CAST(sum(open_case_count) AS BIGINT) AS open_cases, CAST(sum(escalated_case_count) AS BIGINT) AS escalated_cases,
                   round(sum(total_order_value), 2) AS order_value
            FROM scored GROUP BY 1""",
        "metric_by_region_bu": """
            SELECT region, business_unit, count(*) AS account_count, round(avg(annual_revenue), 3) AS avg_revenue,
                   round(avg(days_since_last_activity), 3) AS avg_days_inactive, CAST(sum(total_contacts) AS BIGINT) AS total_contacts,
                   round(sum(open_pipeline_value), 2) AS open_pipeline, round(sum(total_closed_won), 2) AS closed_won,
                   round(sum(total_closed_won) * 100.0 / nullif(sum(total_closed_won + total_closed_lost), 0), 3) AS win_value_rate,
                   CAST(sum(total_orders) AS BIGINT) AS total_orders, CAST(sum(backorder_line_count) AS BIGINT) AS backorder_lines
            FROM scored GROUP BY 1, 2""",
        "metric_all_dims": """
            SELECT manager_name, rep_name, risk_category, trim(split_part(top_risk_driver, '(', 1)) AS top_risk_driver_kind,
                   is_stale_account, has_escalated_cases, has_backorders,
                   CASE WHEN annual_revenue >= 500000 THEN 'large' WHEN annual_revenue >= 100000 THEN 'mid' ELSE 'small' END AS revenue_band,
                   count(*) AS account_count, CAST(sum(total_orders) AS BIGINT) AS total_orders
            FROM scored GROUP BY ALL""",
        "revenue_trend": "SELECT * FROM revenue_trend",
        "delivery_reliability": "SELECT * FROM delivery_reliability",
        "whitespace_families": """
            SELECT c_custkey AS customer_shipto_key, coalesce(string_agg(f.family, '|' ORDER BY f.family) FILTER (b.family IS NULL), '') AS families
            FROM customer CROSS JOIN (SELECT DISTINCT p_type AS family FROM part) f
            LEFT JOIN coverage b ON b.customer_shipto_key = c_custkey AND b.family = f.family GROUP BY 1""",
        "whitespace_score": "SELECT * FROM whitespace_score",
        "peer_benchmark": """
            SELECT sf_account_id, industry, ml_risk_score, round(industry_avg, 6) AS industry_avg_risk,
                   round(ml_risk_score - industry_avg, 1) AS risk_vs_industry FROM peers""",
        "revenue_at_risk": "SELECT sf_account_id, round(ml_risk_score * annual_revenue / 100.0, 2) AS revenue_at_risk FROM scored",
        "deep_insights": "SELECT * FROM insights",
        "decide_action": "SELECT * FROM decisions",
        "recommendations": "SELECT * FROM recommended",
        "account_briefing": "SELECT * FROM briefing",
        "briefing_payload": """
            SELECT sf_account_id, rev_trend_pct IS NULL AS trend_is_null, ml_risk_score AS risk_score, risk_category, action_type,
                   action_confidence, urgency_score, exec_attention_prob, top_risk_driver, recommendations, rev_trend_pct,
                   CAST(trunc(coalesce(revenue_at_risk, 0)) AS BIGINT) AS revenue_at_risk, coalesce(risk_vs_industry, 0.0) AS risk_vs_industry,
                   industry, coalesce(pct_delivery_pushed, 0.0) AS delivery_pushed_pct
            FROM briefing""",
        "audit_triage": f"""
            SELECT '403_events' AS source, {_TRIAGE}, count(*) AS cnt FROM recent_audit WHERE status_code = 403 GROUP BY ALL
            UNION ALL
            SELECT 'serving_events', {_TRIAGE}, count(*) FROM recent_audit
            WHERE service_name LIKE '%serv%' OR action_name LIKE '%serv%' OR action_name LIKE '%endpoint%' OR action_name LIKE '%invoc%'
            GROUP BY ALL""",
        "cidr_match": f"""
            SELECT event_id, source_ip_address, {_cidr_test('source_ip_address')} AS in_allowed,
                   {_cidr_test('source_ip_address')} AS in_list
            FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '2001:db8::' || hex(event_id % 65536)
                         WHEN 1 THEN '2001:db9:0:0::' || hex(event_id % 65536) ELSE source_ip_address END AS source_ip_address FROM audit)""",
        "network_ledger": f"""
            WITH nets AS ({_LEDGER}),
            log AS (SELECT event_id, event_id % 3 = 0 AS six, event_id % 8192 AS w, user_id % 256 AS d, event_id % 251 AS c FROM events)
            SELECT event_id, CASE WHEN six THEN '2001:db8:' || hex(w) || '::' || hex(w) ELSE '172.20.' || c || '.' || d END AS ip,
                   EXISTS (SELECT 1 FROM nets n WHERE CASE WHEN six THEN n.six_low <= (w::HUGEINT << 80) + w AND (w::HUGEINT << 80) + w <= n.six_high
                                                      ELSE n.four_low <= c * 256 + d AND c * 256 + d <= n.four_high END) AS in_allowed
            FROM log""",
        "merged_networks": f"""
            WITH nets AS (SELECT DISTINCT four_low AS a, four_high AS b FROM ({_LEDGER})),
            seen AS (SELECT a, b, max(b) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM nets),
            opened AS (SELECT a, b, max(CASE WHEN reach IS NULL OR a > reach THEN a END) OVER (ORDER BY a, b) AS start FROM seen)
            SELECT 2886991872 + start AS first_low, 2886991872 + max(b) AS last_low FROM opened GROUP BY start""",
        "callout_verdicts": f"""
            SELECT event_id, source_ip_address AS ip,
                   CASE WHEN NOT ({_cidr_test('source_ip_address')}) THEN 'not listed: add ' || source_ip_address || '/32'
                        WHEN status_code = 403 THEN 'listed but rejected' ELSE 'works' END AS verdict FROM audit""",
        "subnet_rollup": """
            SELECT DISTINCT regexp_replace(source_ip_address, '[.][0-9]+$', '.0/24') AS cidr FROM audit
            UNION SELECT DISTINCT regexp_replace(source_ip_address, '[.][0-9]+[.][0-9]+$', '.0.0/16') FROM audit""",
        "distinct_subnets": "SELECT DISTINCT regexp_replace(source_ip_address, '[.][0-9]+$', '.0/24') AS subnet FROM audit",
        "private_ip_class": """
            SELECT CASE WHEN source_ip_address LIKE '10.%' OR source_ip_address LIKE '172.%' OR source_ip_address LIKE '192.168.%'
                        THEN 'PRIVATE' ELSE 'PUBLIC' END AS kind, count(*) AS events FROM audit GROUP BY 1""",
    }
    bodies["stream_mirror"] = bodies["latest_by_key"]
    bodies["gold_table"] = bodies["incremental_gold"] = bodies["bucketed_gold"] = bodies["customer_360"]
    bodies["outbound_files"] = bodies["text_codec_write"]
    bodies["typed_publish"] = f"""
        SELECT sf_account_id AS Id, ml_risk_score AS Risk_Score__c, risk_category AS Risk_Category__c,
               '{ASSESSED}' AS Last_Risk_Assessment__c FROM scored"""
    bodies["classify_action"] = "SELECT sf_account_id, action_type FROM decisions"
    bodies["duplicate_keys"] = "SELECT l_orderkey, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1"
    bodies["first_match"] = "SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '99') ORDER BY c_custkey LIMIT 1"
    return {name: _with(body) for name, body in bodies.items()}
