"""Feature matrix, model training and scoring, risk summary and on-demand scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from acctlens.functions import risk, text as tx
from acctlens.operators.joins import lookup_join
from acctlens.operators.metrics import require_key
from acctlens.operators.quality import choose_format
from acctlens.schemas import FEATURES
from acctlens.sources.tables import Catalog, settle, write_snapshot

# Accounts of a group within which permuted values change places.
SWAP_ROWS = 20_000

SUMMARY = [
    "sf_account_id", "account_name", "ml_risk_score", "risk_category", "days_since_last_activity",
    "pct_qty_backordered", "open_pipeline_value", "annual_revenue", "open_case_count",
]


def feature_matrix(gold: DataFrame, cols: list[str] = FEATURES) -> DataFrame:
    """Account id and the features in training order, as doubles with 0 for NULL and NaN."""
    values = raw_features(gold, cols)
    return values.select("sf_account_id", *[_filled(F.col(c)).alias(c) for c in cols])


def raw_features(gold: DataFrame, cols: list[str] = FEATURES) -> DataFrame:
    """Account id and the features as doubles with their gaps, for training."""
    return require_key(gold, "sf_account_id").select("sf_account_id", *[F.col(c).cast("double").alias(c) for c in cols])


def _filled(value: Column) -> Column:
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def feature_json(features: DataFrame, cols: list[str] = FEATURES) -> DataFrame:
    """Scoring-service record per row."""
    return features.select("sf_account_id", F.to_json(F.struct(*cols)).alias("record"))


def train(
    features: DataFrame, label: str, seed: int = 42, rounds: int = 20, cols: list[str] = FEATURES
) -> PipelineModel:
    """Mean imputer and gradient-boosted trees."""
    filled = [f"{c}_filled" for c in cols]
    return Pipeline(stages=[
        Imputer(inputCols=cols, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="features"),
        GBTRegressor(featuresCol="features", labelCol=label, seed=seed, maxIter=rounds),
    ]).fit(features)


def score(
    features: DataFrame,
    model: PipelineModel | Callable[[pd.DataFrame], pd.Series],
    cols: list[str] = FEATURES,
) -> DataFrame:
    """(sf_account_id, ml_risk_score) with one decimal.

    A Spark model runs in the plan. Any other model is a function from a frame of features to
    predictions, called on Arrow batches; the key stays in its row, so order does not matter.
    """
    if isinstance(model, PipelineModel):
        predicted = model.transform(features).select("sf_account_id", "prediction")
    else:
        def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame({
                    "sf_account_id": frame["sf_account_id"],
                    "prediction": pd.Series(model(frame[cols]), dtype="float64").to_numpy(),
                })

        predicted = features.select("sf_account_id", *cols).mapInPandas(
            predict, schema="sf_account_id string, prediction double"
        )
    return predicted.select("sf_account_id", F.round("prediction", 1).alias("ml_risk_score"))


def feature_importances(model: PipelineModel, cols: list[str] = FEATURES) -> DataFrame:
    """Feature, importance and percentage with one decimal, strongest first (18 model values)."""
    regressor = model.stages[-1]
    spark = SparkSession.active()
    rows = [(c, float(v)) for c, v in zip(cols, regressor.featureImportances.toArray())]
    table = spark.createDataFrame(rows, "feature string, importance double")
    pct = F.round(F.col("importance") * 100, 1)
    return table.withColumn("importance_pct", pct).orderBy(F.desc("importance"), "feature")


def fold_of(key: str = "sf_account_id", folds: int = 5) -> Column:
    """The fold of a row by a checksum of its key, the same on every run and partitioning."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds)).cast("int")


def cross_validate(
    features: DataFrame, label: str, folds: int = 5, seed: int = 42, rounds: int = 20, cols: list[str] = FEATURES
) -> DataFrame:
    """A row per fold with rows: fold, rows, trained, error, mean_error.

    Each fold is scored by a model of the other folds; both errors are mean absolute ones, the second that of
    the other folds' mean label. The frame is settled, as every model reads it. Fitting goes fold by fold, as each is a job of
    its own.
    """
    known = settle(features.where(F.col(label).isNotNull()).withColumn("_fold", fold_of(folds=folds)), "folds")
    out = None
    for fold in range(folds):
        rest, own = known.where(F.col("_fold") != fold), known.where(F.col("_fold") == fold)
        if own.isEmpty() or rest.isEmpty():
            continue
        model = train(rest, label, seed, rounds, cols)
        mean = rest.agg(F.avg(label).alias("mean"), F.count(F.lit(1)).alias("n")).first()
        row = model.transform(own).agg(
            F.count(F.lit(1)).alias("rows"), F.avg(F.abs(F.col("prediction") - F.col(label))).alias("error"),
            F.avg(F.abs(F.col(label) - F.lit(mean["mean"]))).alias("mean_error"))
        row = row.select(F.lit(fold).alias("fold"), "rows", F.lit(mean["n"]).cast("bigint").alias("trained"), "error", "mean_error")
        out = row if out is None else out.unionByName(row)
    if out is None:
        return features.sparkSession.createDataFrame([], "fold int, rows long, trained long, error double, mean_error double")
    return out


def permutation_importances(
    model: PipelineModel, features: DataFrame, label: str, cols: list[str] = FEATURES
) -> DataFrame:
    """(feature, gain): what the mean absolute error gains when the feature's values change places.

    Accounts are dealt to groups and put in a hashed order there; each takes the value of the one before
    it. Scored in one pass, a row for each feature and account.
    """
    known = features.where(F.col(label).isNotNull()).select("sf_account_id", label, *cols)
    groups = 1 + known.count() // SWAP_ROWS
    group = Window.partitionBy(F.pmod(F.xxhash64("sf_account_id"), F.lit(groups))).orderBy(F.xxhash64("sf_account_id", F.lit(1)), "sf_account_id")
    rest = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct(*cols)
    swapped = settle(known.withColumn("_other", F.coalesce(F.lag(own).over(group), F.last(own).over(rest))), "swapped")
    which = F.explode(F.array(*[F.lit(c) for c in ["", *cols]])).alias("feature")
    rows = swapped.select("*", which).withColumns(
        {c: F.when(F.col("feature") == c, F.col("_other")[c]).otherwise(F.col(c)) for c in cols})
    errors = model.transform(rows).groupBy("feature").agg(F.avg(F.abs(F.col("prediction") - F.col(label))).alias("error"))
    # One row for each feature.
    plain = errors.where("feature = ''").select(F.col("error").alias("plain")).scalar()
    return errors.where("feature <> ''").select("feature", (F.col("error") - plain).alias("gain")).orderBy(F.desc("gain"), "feature")


def rule_scored(gold: DataFrame) -> DataFrame:
    """Gold with the composite score standing in for the model's, plus category and driver."""
    return with_category(gold.withColumn("ml_risk_score", F.round("risk_score_raw", 1)))


def model_scored(gold: DataFrame, scores: DataFrame) -> DataFrame:
    """Gold with a model's scores; accounts without a score drop out."""
    return with_category(gold.join(scores, "sf_account_id"))


def with_category(df: DataFrame) -> DataFrame:
    """Category from the rounded score, and the first matching driver."""
    return df.withColumns({
        "risk_category": risk.risk_category(F.col("ml_risk_score")),
        "top_risk_driver": risk.top_risk_driver(
            F.col("days_since_last_activity"), F.col("pct_qty_backordered"),
            F.col("open_case_count"), F.col("open_pipeline_value"),
        ),
    })


def account_risk_summary(scored: DataFrame) -> DataFrame:
    """Nine summary columns and the driver. The table has no order; readers of its top sort that."""
    return scored.select(*SUMMARY, "top_risk_driver")


def publish_summary(scored: DataFrame, cat: Catalog, name: str = "account_risk_summary") -> None:
    """Replace the published summary table and its schema."""
    write_snapshot(account_risk_summary(scored), cat, name)


def rule_score_column() -> Column:
    """Composite score computed from feature columns; counts go back to exact numbers first."""
    def exact(name: str) -> Column:
        return F.col(name).try_cast("decimal(18,6)")

    return risk.risk_score_raw(
        exact("days_since_last_activity"), exact("escalated_case_count"),
        F.col("pct_qty_backordered"), exact("high_priority_open_cases"),
    )


def on_demand_score(
    requests: DataFrame, gold: DataFrame, scorer: Callable[[], Column] = rule_score_column
) -> DataFrame:
    """Score, category, found, success and error per request (request_id, sf_account_id).

    The record a request carries is scored, whether its account is known or not; features it lacks
    come from the account if that is known, and are 0 otherwise. A feature that is not a number, or
    beyond what the score is computed in, ends in that request's error and gives no score. The
    category follows the unrounded score.
    """
    known = feature_matrix(gold).withColumn("_found", F.lit(True))
    own = [c for c in FEATURES if c in requests.columns]
    asked = requests.select("request_id", "sf_account_id", *[F.col(c).alias(f"_req_{c}") for c in own])
    joined = lookup_join(asked, known, "sf_account_id")
    filled = joined.withColumns({
        c: F.coalesce(*([F.col(f"_req_{c}").cast("double")] if c in own else []), F.col(c), F.lit(0.0))
        for c in FEATURES
    })
    bad = F.array_compact(F.array(*[
        F.when(F.col(c).try_cast("decimal(18,6)").isNull(), F.lit(c)) for c in FEATURES
    ]))
    checked = filled.withColumn("_bad", F.array_join(bad, ", "))
    value, good = scorer(), F.col("_bad") == ""
    return checked.select(
        "request_id", "sf_account_id",
        F.when(good, F.round(value, 1)).alias("risk_score"),
        F.when(good, risk.risk_category(value)).alias("risk_category"),
        F.coalesce(F.col("_found"), F.lit(False)).alias("found"),
        good.alias("success"),
        F.when(~good, F.concat(F.lit("Not a usable number: "), F.col("_bad"))).alias("error"),
    )


def publish_text(scored: DataFrame, assessed_at: str) -> DataFrame:
    """(Id, Description): the key-value text written back to the customer system."""
    return scored.select(
        F.col("sf_account_id").alias("Id"),
        tx.score_text(
            F.col("customer_shipto_key"), F.col("ml_risk_score"), F.col("risk_category"),
            F.lit(assessed_at),
        ).alias("Description"),
    )


def publish_columns(scored: DataFrame, assessed_at: str) -> DataFrame:
    """Typed fields for a target that has them; see quality.choose_format."""
    return scored.select(
        F.col("sf_account_id").alias("Id"),
        F.col("ml_risk_score").cast("double").alias("Risk_Score__c"),
        F.col("risk_category").alias("Risk_Category__c"),
        F.lit(assessed_at).alias("Last_Risk_Assessment__c"),
    )


TYPED_FIELDS = ["Risk_Score__c", "Risk_Category__c", "Last_Risk_Assessment__c"]


def publish(scored: DataFrame, target: DataFrame, assessed_at: str) -> DataFrame:
    """Typed fields if the target table has them all, else the key-value text."""
    typed = choose_format(target, TYPED_FIELDS) == "columns"
    return publish_columns(scored, assessed_at) if typed else publish_text(scored, assessed_at)


def read_published_scores(accounts: DataFrame, text_col: str = "Description") -> DataFrame:
    """Last published score per account, with a success flag and an error text."""
    parsed = accounts.select("Id", "Name", tx.read_score(F.col(text_col)).alias("r"))
    return parsed.select(
        F.col("Id").alias("sf_account_id"),
        F.when(F.col("r.success"), F.col("Name")).alias("account_name"),
        F.col("r.score").alias("risk_score"),
        F.col("r.category").alias("risk_category"),
        F.col("r.assessed").alias("assessed"),
        F.col("r.success").alias("success"),
        F.col("r.error").alias("error"),
    )
