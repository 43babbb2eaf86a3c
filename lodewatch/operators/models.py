"""Versioned models and what is learned from feedback, as append-only tables.

log: (model, seq, action, version, accuracy, auc, trained_on, weights), one row for each promotion or
rollback, in the order of seq; nothing in it changes. feedback: (model, seq, predicted, actual).
Every function looks at all models at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import learn

# Feedback that a retraining looks at and needs, the loss of accuracy that calls for one, rows that calibration needs.
RECENT, LEAST, LOSS, ENOUGH, DEFAULT_WEIGHT = 20, 10, 0.1, 5, 0.05

LOG = "model string, seq long, action string, version string, accuracy double, auc double, trained_on long, weights map<string,double>"


def current(log: DataFrame) -> DataFrame:
    """model, version, accuracy, auc, trained_on, weights: of each model the version in force.

    A rollback puts a version promoted before it in force again, with the figures of its first
    promotion; one to a version that was never promoted before changes nothing. Rows of a null model
    are those of no model and are left out.
    """
    figures = F.struct("seq", "accuracy", "auc", "trained_on", "weights")
    first = log.where("action = 'promote' and model is not null").groupBy("model", "version").agg(F.min_by(figures, "seq").alias("of"))
    moves = log.where("action in ('promote', 'rollback')").select("model", "seq", "action", "version", figures.alias("own"))
    known = moves.join(first, ["model", "version"]).where("action = 'promote' or of.seq < seq")
    last = known.groupBy("model").agg(F.max_by(F.struct("version", F.when(F.col("action") == "promote", F.col("own")).otherwise(F.col("of")).alias("f")), "seq").alias("m"))
    return last.select("model", "m.version", "m.f.accuracy", "m.f.auc", "m.f.trained_on", "m.f.weights")


def runs(log: DataFrame) -> DataFrame:
    """log with previous, the version promoted last before, and promoted: false for a rollback."""
    w = Window.partitionBy("model").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("action") == "promote", F.col("version")), True).over(w)
    return log.withColumns({"previous": before, "promoted": F.col("action") == "promote"})


def recent(feedback: DataFrame, most: int = RECENT) -> DataFrame:
    """model, n, accuracy: of each model's last feedback."""
    w = Window.partitionBy("model").orderBy(F.desc("seq"))
    rows = feedback.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most)
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("predicted") == F.col("actual"), F.lit(False)).cast("int")).alias("accuracy"))


def retrain(feedback: DataFrame, log: DataFrame) -> DataFrame:
    """model, n, accuracy, drop, due: whether each model with feedback should be trained anew.

    With too little recent feedback never; without a version in force (or one of accuracy 0) always;
    else if the accuracy fell by more than LOSS. Accuracies are compared to nine places.
    """
    rows = recent(feedback).join(current(log).select("model", F.col("accuracy").alias("was")), "model", "left")
    drop = F.round(F.when(F.col("was") > 0, F.col("was") - F.col("accuracy")), 9)
    return rows.withColumn("drop", drop).select("model", "n", "accuracy", "drop", ((F.col("n") >= LEAST) & (F.col("drop").isNull() | (F.col("drop") > LOSS))).alias("due"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """model, predicted, total, correct, accuracy by predicted label; a row with a null label sums up the model."""
    right = F.count_if(F.col("predicted") == F.col("actual"))
    sets = feedback.where("predicted is not null").groupingSets([["model", "predicted"], ["model"]], "model", "predicted")
    return sets.agg(F.count("*").alias("total"), right.alias("correct"), F.round(right / F.count("*"), 6).alias("accuracy"))


def calibrated(rows: DataFrame, features: Sequence[str], manual: Mapping[str, float], label: str = "label") -> tuple[dict[str, float], float, int]:
    """Weights, intercept and rows they come from: of rows labelled normal or malicious, or the manual ones if there are too few."""
    binary = rows.where(F.col(label).isin("normal", "malicious")).withColumn("__y", (F.col(label) == "malicious").cast("int"))
    counted = binary.agg(F.count("*"), F.min("__y"), F.max("__y")).first()
    if counted[0] < ENOUGH or counted[1] == counted[2]:
        return {f: manual.get(f, DEFAULT_WEIGHT) for f in features}, 0.0, counted[0]
    model = learn.train(binary, features, "__y")
    return {f: round(float(w), 3) for f, w in zip(features, model.coefficients, strict=True)}, round(float(model.intercept), 3), counted[0]


def promoted(log: DataFrame, model: str, version: str, accuracy: float, auc: float, trained_on: int, weights: Mapping[str, float]) -> DataFrame:
    """The row to append that puts a new version in force."""
    return _next(log, model, "promote", version, accuracy, auc, trained_on, dict(weights))


def rolled_back(log: DataFrame, model: str, version: str) -> DataFrame:
    """The row to append that puts an old version in force."""
    return _next(log, model, "rollback", version, None, None, 0, None)


def _next(log: DataFrame, model: str, *rest) -> DataFrame:
    last = log.where(F.col("model") == model).agg(F.max("seq")).first()[0]
    return log.sparkSession.createDataFrame([(model, 0 if last is None else last + 1, *rest)], LOG)
