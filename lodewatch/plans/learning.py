"""Versioned models and feedback bound to documents and their labels: a source is a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models
from .tables import read


def feedback(spark, sf_dir):
    """A long document is predicted to be good; its label says what it is."""
    docs = read(spark, sf_dir, "documents").where("source is not null").select("doc_id", F.col("source").alias("model"), F.when(F.col("n_chars") > 600, "good").otherwise("bad").alias("predicted"))
    actual = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("actual"))
    return docs.join(actual, "doc_id").select("model", F.col("doc_id").alias("seq"), "predicted", "actual")


def log(spark, sf_dir):
    """Two versions a source, with accuracies by its characters; some go back to the first, some to one that never was."""
    sizes = read(spark, sf_dir, "documents").where("source is not null").groupBy(F.col("source").alias("model")).agg(F.sum("n_chars").alias("n"))
    row = lambda seq, action, version, accuracy: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(action).alias("action"), F.lit(version).alias("version"), accuracy.cast("double").alias("accuracy"))
    one, two, none = (5 + F.col("n") % 6) / 10, F.col("n") % 9 / 10, F.lit(None)
    moves = F.array(row(0, "promote", "v1", one), row(1, "promote", "v2", two), F.when(F.col("n") % 2 == 0, row(2, "rollback", "v1", none)), F.when(F.col("n") % 3 == 0, row(3, "rollback", "v9", none)))
    rows = sizes.select("model", F.explode(F.array_compact(moves)).alias("m")).select("model", "m.*")
    return rows.select("model", "seq", "action", "version", "accuracy", F.col("accuracy").alias("auc"), F.lit(1).cast("long").alias("trained_on"), F.create_map(F.lit("x"), "accuracy").alias("weights"))


def models_in_force(spark, sf_dir):
    return models.current(log(spark, sf_dir)).select("model", "version", "accuracy")


def training_runs(spark, sf_dir):
    return models.runs(log(spark, sf_dir)).select("model", "seq", "version", "previous", "promoted")


def retraining_due(spark, sf_dir):
    rows = models.retrain(feedback(spark, sf_dir), log(spark, sf_dir))
    return rows.select("model", "n", F.round("accuracy", 6).alias("accuracy"), F.round("drop", 6).alias("drop"), "due")


def feedback_by_label(spark, sf_dir):
    return models.feedback_stats(feedback(spark, sf_dir))


FEEDBACK_CTE = """feedback AS (SELECT source AS model, doc_id AS seq, CASE WHEN n_chars > 600 THEN 'good' ELSE 'bad' END AS predicted, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS actual FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL)"""
LOG_CTE = """sizes AS (SELECT source AS model, sum(n_chars)::BIGINT AS n FROM documents WHERE source IS NOT NULL GROUP BY 1),
  log AS (SELECT model, 0::BIGINT AS seq, 'promote' AS action, 'v1' AS version, (5 + n % 6) / 10.0::DOUBLE AS accuracy FROM sizes UNION ALL SELECT model, 1, 'promote', 'v2', n % 9 / 10.0::DOUBLE FROM sizes
    UNION ALL SELECT model, 2, 'rollback', 'v1', NULL FROM sizes WHERE n % 2 = 0 UNION ALL SELECT model, 3, 'rollback', 'v9', NULL FROM sizes WHERE n % 3 = 0),
  force AS (SELECT model, CASE WHEN n % 2 = 0 THEN 'v1' ELSE 'v2' END AS version, CASE WHEN n % 2 = 0 THEN (5 + n % 6) / 10.0::DOUBLE ELSE n % 9 / 10.0::DOUBLE END AS accuracy FROM sizes)"""

QUERIES = {f.__name__: f for f in (models_in_force, training_runs, retraining_due, feedback_by_label)}
ORACLE_SQL = {
    "models_in_force": f"WITH {LOG_CTE} SELECT * FROM force",
    "training_runs": f"WITH {LOG_CTE} SELECT model, seq, version, CASE seq WHEN 0 THEN NULL WHEN 1 THEN 'v1' ELSE 'v2' END AS previous, action = 'promote' AS promoted FROM log",
    "retraining_due": f"""WITH {LOG_CTE}, {FEEDBACK_CTE}, last AS (SELECT model, count(*) AS n, avg((predicted = actual)::INT) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY seq DESC) AS r FROM feedback) WHERE r <= {models.RECENT} GROUP BY model),
  d AS (SELECT model, n, last.accuracy, CASE WHEN force.accuracy > 0 THEN round(force.accuracy - last.accuracy, 9) END AS fell FROM last JOIN force USING (model))
  SELECT model, n, round(accuracy, 6) AS accuracy, round(fell, 6) AS drop, n >= {models.LEAST} AND (fell IS NULL OR fell > {models.LOSS}) AS due FROM d""",
    "feedback_by_label": f"WITH {FEEDBACK_CTE} SELECT model, predicted, count(*) AS total, count(*) FILTER (predicted = actual) AS correct, round(avg((predicted = actual)::INT), 6) AS accuracy FROM feedback GROUP BY GROUPING SETS ((model, predicted), (model))",
}
