"""Series by key: slope, smoothing, cumulative sums, drift levels, baselines and deviations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import ratio
from .scan import lookup

ALPHA = 0.3
SLACK = 0.5


def trend(series: DataFrame, by: str, order: Sequence[str], value: str) -> DataFrame:
    """by, n, mean, std, slope, ewma, cusum, drift, level of each series.

    The exponential mean is a closed sum of powers; the cumulative sum max(0, c + z - k) is the
    running sum less its running minimum, so both are plain windows and aggregates.
    """
    w = Window.partitionBy(by)
    ordered = w.orderBy(*order)
    rows = series.withColumns({"i": F.row_number().over(ordered) - 1, "n": F.count("*").over(w), "mean": F.avg(value).over(w), "std": F.stddev_samp(value).over(w)})
    z = F.when(F.coalesce("std", F.lit(0.0)) == 0, F.lit(0.0)).otherwise((F.col(value) - F.col("mean")) / F.col("std") - SLACK)
    rows = rows.withColumn("s", F.sum(z).over(ordered))
    rows = rows.withColumn("c", F.col("s") - F.least(F.lit(0.0), F.min("s").over(ordered)))
    weight = F.when(F.col("i") == 0, 1.0).otherwise(ALPHA) * F.pow(F.lit(1 - ALPHA), F.col("n") - 1 - F.col("i"))
    found = rows.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.coalesce(F.regr_slope(F.col(value), F.col("i")), F.lit(0.0)).alias("slope"),
        F.sum(weight * F.col(value)).alias("ewma"), F.max_by("c", "i").alias("cusum"),
    )
    drift = F.greatest(ratio(F.abs("slope"), F.abs("mean")), ratio(F.col("cusum"), F.abs("mean") * F.col("n")))
    return found.withColumn("drift", drift).withColumn("level", level(F.col("drift")))


def level(drift: Column) -> Column:
    return F.when(drift > 0.2, "HIGH").when(drift > 0.1, "MEDIUM").when(drift > 0.03, "LOW").otherwise("NONE")


def overall(trends: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The worst level and how many series have each."""
    rank = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3}
    return trends.groupBy(*by).agg(F.max_by("level", lookup(F.col("level"), rank, 0)).alias("level"), *[F.count_if(F.col("level") == x).alias(x.lower()) for x in rank])


def direction(snapshots: DataFrame, by: str, order: Sequence[str], score: str, critical: str) -> DataFrame:
    """by, d_score, d_critical, direction of the last two snapshots of each key."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    last = snapshots.withColumn("r", F.row_number().over(w)).where("r <= 2")
    now = lambda c: F.max(F.when(F.col("r") == 1, F.col(c)))
    before = lambda c: F.max(F.when(F.col("r") == 2, F.col(c)))
    found = last.groupBy(by).agg((now(score) - before(score)).alias("d_score"), (now(critical) - before(critical)).alias("d_critical"), F.count("*").alias("k")).where("k = 2").drop("k")
    way = F.when((F.col("d_score") < -5) | (F.col("d_critical") < 0), "improving").when((F.col("d_score") > 5) | (F.col("d_critical") > 0), "worsening").otherwise("stable")
    return found.withColumn("direction", way)


def order_deviations(events: DataFrame, by: str, order: Sequence[str], stage: str, index: dict[str, int]) -> DataFrame:
    """by, deviations, n: how often the next event belongs to an earlier stage."""
    i = lookup(F.col(stage), index, None)
    rows = events.withColumn("i", i).withColumn("next", F.lead("i").over(Window.partitionBy(by).orderBy(*order)))
    return rows.groupBy(by).agg(F.count_if(F.col("next") < F.col("i")).alias("deviations"), F.count("*").alias("n"))


#: Measures are added up as whole numbers of this part, so that no order of adding changes a sum.
PLACES = 10_000


def exact_mean(value: Column) -> Column:
    return F.sum(whole(value)).cast("double") / F.count(value) / PLACES


def exact_std(value: Column) -> Column:
    """The population deviation from exact sums: n * sum of squares - square of sum is n * n times the variance."""
    n, v = F.count(value).cast("decimal(12,0)"), whole(value).cast("decimal(18,0)")
    total, squares = F.sum(v).cast("decimal(18,0)"), F.sum(v * v).cast("decimal(26,0)")
    return F.sqrt((n * squares - total * total).cast("double")) / F.count(value) / PLACES


def whole(value: Column) -> Column:
    return F.round(value * PLACES).cast("long")


def baseline(records: DataFrame, by: str, measures: Sequence[str]) -> DataFrame:
    """by, n and mean, population std, min and max of each measure."""
    aggs = [f(F.col(m)).alias(f"{m}_{name}") for m in measures for name, f in (("mean", exact_mean), ("std", exact_std), ("min", F.min), ("max", F.max))]
    return records.groupBy(by).agg(F.count("*").alias("n"), *aggs)


def typical(records: DataFrame, by: str, record: str, item: str, share: float) -> DataFrame:
    """by, item, share of items that at least so large a part of the key's records have."""
    used = records.select(by, record, item).distinct()  # read once: what follows starts from its rows
    total = used.select(by, record).distinct().groupBy(by).agg(F.count(record).alias("records"))
    used = used.groupBy(by, item).agg(F.count("*").alias("n"))
    return used.join(total, by).withColumn("share", F.col("n") / F.col("records")).where(F.col("share") >= share).select(by, item, "share")


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return F.when(F.coalesce(std, F.lit(0.0)) == 0, F.lit(0.0)).otherwise((value - mean) / std)


def normality(records: DataFrame, stats: DataFrame, by: str, measures: Sequence[str]) -> DataFrame:
    """records with z_<measure>, normality (1 at the mean, 0 far away) and outlier."""
    joined = records.join(stats, by).withColumns({f"z_{m}": z_score(F.col(m), F.col(f"{m}_mean"), F.col(f"{m}_std")) for m in measures})
    total = sum((F.abs(f"z_{m}") for m in measures), F.lit(0.0))
    outlier = F.greatest(*[F.abs(f"z_{m}") for m in measures]) > 3 if len(measures) > 1 else F.abs(f"z_{measures[0]}") > 3
    return joined.withColumn("normality", F.greatest(F.lit(0.0), 1 - total / (3.0 * len(measures)))).withColumn("outlier", outlier)


def deviations(records: DataFrame, stats: DataFrame, by: str, measures: Sequence[str], least: int = 3) -> DataFrame:
    """One row per record and measure beyond two deviations, with a severity."""
    rows = normality(records, stats.where(F.col("n") >= least), by, measures)
    found = F.array_compact(F.array(*[F.when(F.abs(f"z_{m}") > 2, F.struct(F.lit(m).alias("measure"), F.col(f"z_{m}").alias("z"))) for m in measures]))
    keep = [c for c in records.columns if c not in measures]
    return rows.select(*keep, F.explode(found).alias("d")).select(*keep, "d.*").withColumn("severity", F.when(F.abs("z") > 3, "HIGH").otherwise("MEDIUM"))
