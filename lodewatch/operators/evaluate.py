"""How predictions compare with the truth, and how values spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import ratio


def confusion(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn and the usual ratios from columns actual and predicted (0 or 1)."""
    hit = lambda a, p: F.count_if((F.col("actual") == a) & (F.col("predicted") == p))
    c = rows.groupBy(*by).agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    measures = {"accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": precision, "recall": recall, "specificity": ratio(tn, tn + fp), "f1": ratio(2 * precision * recall, precision + recall), "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp)}
    return c.withColumns({k: F.round(v, 6) for k, v in measures.items()})


def roc_auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """n, positives, auc: the chance that a positive scores above a negative, half for ties.

    Labels are summed per distinct score first. Each score's rank then comes from a cumulative
    count by ranges of scores, so no task sorts all of them.
    """
    by_score = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    # Coarse ranges give every score the negatives of all lower ranges; a window inside a range gives the rest.
    ranged = by_score.withColumn("range", F.floor(F.col("s") * 256))
    below = ranged.groupBy("range").agg(F.sum("neg").alias("neg"))
    lower = below.withColumn("base", F.sum("neg").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).select("range", F.coalesce("base", F.lit(0)).alias("base"))  # a row a range
    w = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(lower, "range").withColumn("under", F.col("base") + F.coalesce(F.sum("neg").over(w), F.lit(0)))
    found = joined.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)).alias("won"))
    return found.select((F.col("positives") + F.col("negatives")).alias("n"), "positives", F.round(ratio(F.col("won"), F.col("positives") * F.col("negatives")), 6).alias("auc"))


def percentiles(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, population std, nearest-rank p50, p95, p99 and the other definition's q95 (index floor(n * p))."""
    # Counting equal values first keeps a key's distinct values, not its rows, in the window.
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumn("up", F.sum("k").over(w.orderBy(value))).withColumn("n", F.sum("k").over(w))
    at = lambda rank: F.min(F.when(F.col("up") >= rank, F.col(value)))
    nearest = lambda p: at(F.ceil(F.lit(p) * F.col("n")))
    spread = rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"))
    found = ranked.groupBy(*by).agg(nearest(0.5).alias("p50"), nearest(0.95).alias("p95"), nearest(0.99).alias("p99"), at(F.floor(F.lit(0.95) * F.col("n")) + 1).alias("q95"))
    return spread.join(found, list(by))


def bayes(rows: DataFrame) -> DataFrame:
    """relation, n, prior, likelihood, posterior: the likelihood is observed for nine parts and 0.5 for one."""
    per = rows.groupBy("relation").agg(F.count("*").alias("n"), (0.9 * F.count_if("bad") / F.count("*") + 0.05).alias("likelihood"))
    total = per.agg(F.sum("n").alias("all"))
    joined = per.crossJoin(F.broadcast(total)).withColumn("prior", F.col("n") / F.col("all"))  # one row
    yes, no = F.col("likelihood") * F.col("prior"), (1 - F.col("likelihood")) * (1 - F.col("prior"))
    return joined.select("relation", "n", F.round("prior", 6).alias("prior"), F.round("likelihood", 6).alias("likelihood"), F.round(yes / (yes + no), 6).alias("posterior"))
