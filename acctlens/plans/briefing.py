"""Structured decisions, recommendations, and the briefing sent back to the customer system.

The decision scores come from deterministic rules over the account's signals. A scorer is a
function from (frame, spec) to the same struct column, so a model may take its place.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

URGENCY_LABELS = ["Routine", "Low", "Medium", "High", "Critical"]


@dataclass(frozen=True)
class DecisionSpec:
    """One logit per action label, an urgency between 0 and the top level, one yes/no logit."""

    actions: dict[str, Column]
    urgency: Column
    attention: Column
    levels: tuple[str, ...] = tuple(URGENCY_LABELS)


def _num(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def default_spec() -> DecisionSpec:
    """Labels are fixed values; the weights are this library's choice."""
    score = _num("ml_risk_score")
    fall = F.greatest(F.lit(0.0), -_num("rev_trend_pct")) / 100.0
    return DecisionSpec(
        actions={
            "re_engage": _num("days_since_last_activity") / 90.0 + fall,
            "escalate_ops": _num("pct_qty_backordered") / 15.0 + _num("open_case_count") / 3.0,
            "protect_pipeline": F.when(_num("open_pipeline_value") > 0, score / 25.0).otherwise(0.0),
            "expand_relationship": (100.0 - score) / 40.0,
            "routine_checkin": F.lit(1.0),
        },
        urgency=F.least(F.lit(4.0), F.greatest(F.lit(0.0), score / 25.0)),
        attention=(score - 55.0) / 10.0 + fall,
    )


def spec_from_document(text: str, rules: DecisionSpec | None = None) -> DecisionSpec:
    """Specification from its JSON document (a configuration text, not data).

    The document holds one decision of each type: a ``choice`` whose criteria name the labels, a
    ``score`` whose criteria list the levels, and a ``noul`` (yes or no). Labels the rules do not
    know get a logit of 0; the urgency is stretched to the number of levels.
    """
    rules = rules or default_spec()
    by_type = {d["type"]: d for d in json.loads(text).values()}
    missing = {"choice", "score", "noul"} - set(by_type)
    if missing:
        raise ValueError(f"decision types missing: {', '.join(sorted(missing))}")
    labels, levels = by_type["choice"]["criteria"], by_type["score"]["criteria"]
    stretch = (len(levels) - 1) / (len(rules.levels) - 1)
    return replace(
        rules,
        actions={label: rules.actions.get(label, F.lit(0.0)) for label in labels},
        urgency=rules.urgency * stretch,
        levels=tuple(levels),
    )


def rule_scorer(spec: DecisionSpec) -> Column:
    """Softmax over the action logits, its first maximum, and the two other decisions.

    The probabilities keep six decimals while they are compared: of labels equal to that precision
    the one listed first wins.
    """
    top = F.greatest(*spec.actions.values())
    weights = [F.exp(logit - top) for logit in spec.actions.values()]
    norm = reduce(add, weights)
    shares = {label: F.round(w / norm, 6) for label, w in zip(spec.actions, weights)}
    ranked = F.array(*[
        F.struct(share.alias("p"), F.lit(-i).alias("rank"), F.lit(label).alias("label"))
        for i, (label, share) in enumerate(shares.items())
    ])
    best = F.array_max(ranked)
    level = F.round(spec.urgency).cast("int")
    return F.struct(
        best["label"].alias("action_type"),
        F.round(F.greatest(*[w / norm for w in weights]), 4).alias("action_confidence"),
        F.round(spec.urgency, 2).alias("urgency_score"),
        F.array(*[F.lit(x) for x in spec.levels])[level].alias("urgency_label"),
        F.round(1.0 - F.abs(spec.urgency - level), 4).alias("urgency_confidence"),
        F.round(1.0 / (1.0 + F.exp(-spec.attention)), 4).alias("exec_attention_prob"),
        F.struct(*[share.alias(label) for label, share in shares.items()]).alias("action_probabilities"),
    )


def decide(
    df: DataFrame, spec: DecisionSpec, scorer: Callable[[DecisionSpec], Column] = rule_scorer
) -> DataFrame:
    """Adds all decisions as one struct column, ``decision``."""
    return df.withColumn("decision", scorer(spec))


def classify_action(df: DataFrame, spec: DecisionSpec) -> DataFrame:
    """Single-label variant: only the action."""
    return df.withColumn("action_type", rule_scorer(spec)["action_type"])


Template = tuple[Column, Column]


def default_templates() -> list[Template]:
    """(strength, text) pairs; a template with no strength is left out."""
    def whole(name: str) -> Column:
        return F.round(_num(name)).cast("bigint").cast("string")

    days, back = _num("days_since_last_activity"), _num("pct_qty_backordered")
    pipeline, trend = _num("open_pipeline_value"), _num("rev_trend_pct")
    pushed, gaps = _num("pct_delivery_pushed"), _num("families_missing")
    return [
        (F.when(days > 90, days / 90.0).otherwise(0.0),
         F.concat(F.lit("Book a visit: no contact for "), whole("days_since_last_activity"), F.lit(" days."))),
        (F.when(back > 15, back / 15.0).otherwise(0.0),
         F.concat(F.lit("Review backorders: "), whole("pct_qty_backordered"), F.lit("% of the quantity is open."))),
        (_num("open_case_count") / 4.0,
         F.concat(F.lit("Close open cases: "), whole("open_case_count"), F.lit(" are waiting."))),
        (F.when(trend < 0, -trend / 50.0).otherwise(0.0),
         F.concat(F.lit("Ask about the drop in orders: revenue changed by "), whole("rev_trend_pct"), F.lit("%."))),
        (F.when(pushed > 25, pushed / 100.0).otherwise(0.0),
         F.concat(F.lit("Explain deliveries: "), whole("pct_delivery_pushed"), F.lit("% of the lines shipped late."))),
        (F.when(pipeline > 0, F.lit(0.4)).otherwise(0.0),
         F.concat(F.lit("Secure the open pipeline of "), whole("open_pipeline_value"), F.lit("."))),
        (F.when(gaps > 0, F.lit(0.3)).otherwise(0.0),
         F.concat(F.lit("Offer product families not bought yet: "), whole("families_missing"), F.lit("."))),
        (F.lit(0.2), F.lit("Keep the regular check-in.")),
        (F.lit(0.1), F.lit("Confirm the contact list.")),
        (F.lit(0.05), F.lit("Share the latest catalog.")),
    ]


def recommend(df: DataFrame, templates: list[Template] | None = None, n: int = 3) -> DataFrame:
    """Adds the n strongest texts, one per line; equal strengths keep template order."""
    entries = F.array(*[
        F.struct(F.round(weight, 6).alias("w"), F.lit(-i).alias("rank"), text.alias("text"))
        for i, (weight, text) in enumerate(templates or default_templates())
    ])
    ranked = F.sort_array(F.filter(entries, lambda e: e["w"] > 0), asc=False)
    texts = F.transform(F.slice(ranked, 1, n), lambda e: e["text"])
    return df.withColumn("recommendations", F.array_join(texts, "\n"))


BRIEFING = [
    "sf_account_id", "account_name", "ml_risk_score", "risk_category", "action_type",
    "action_confidence", "urgency_score", "exec_attention_prob", "top_risk_driver",
    "recommendations", "rev_trend_pct", "revenue_at_risk", "risk_vs_industry", "industry",
    "pct_delivery_pushed",
]


def account_decisions(summary: DataFrame, insights: DataFrame) -> DataFrame:
    """Decisions and recommendations per account from its summary and insight signals."""
    signals = summary.join(insights, "sf_account_id", "left")
    decided = recommend(decide(signals, default_spec()))
    return decided.select("sf_account_id", "decision.*", "recommendations")


def account_briefing(summary: DataFrame, decisions: DataFrame, insights: DataFrame) -> DataFrame:
    """Joins three tables of one row per account; an account without a part keeps NULLs."""
    return (
        summary.join(decisions, "sf_account_id", "left")
        .join(insights, "sf_account_id", "left")
        .select(*BRIEFING)
    )


def brief_accounts(summary: DataFrame, insights: DataFrame) -> DataFrame:
    """The same briefing from one join, for use where no decision table is kept."""
    signals = summary.join(insights, "sf_account_id", "left")
    return recommend(decide(signals, default_spec())).select("*", "decision.*").select(*BRIEFING)


def briefing_payload(briefing: DataFrame) -> DataFrame:
    """(Id, Description): one JSON document per account.

    A missing or zero number is written as 0, except the revenue trend, which stays null.
    """
    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias(name)

    document = F.struct(
        F.col("ml_risk_score").alias("risk_score"), "risk_category", "action_type",
        number("action_confidence"), number("urgency_score"), number("exec_attention_prob"),
        "top_risk_driver", "recommendations", F.col("rev_trend_pct").cast("double").alias("rev_trend_pct"),
        F.coalesce(F.col("revenue_at_risk").cast("bigint"), F.lit(0)).alias("revenue_at_risk"),
        number("risk_vs_industry"), "industry",
        F.coalesce(F.col("pct_delivery_pushed").cast("double"), F.lit(0.0)).alias("delivery_pushed_pct"),
    )
    return briefing.select(
        F.col("sf_account_id").alias("Id"),
        F.to_json(document, {"ignoreNullFields": "false"}).alias("Description"),
    )


def outbound_record(payload: DataFrame, kind: str = "Account") -> DataFrame:
    """(Id, body): the update record with its type tag, as one JSON line."""
    record = F.struct(F.struct(F.lit(kind).alias("type")).alias("attributes"), "Id", "Description")
    return payload.select("Id", F.to_json(record, {"ignoreNullFields": "false"}).alias("body"))
