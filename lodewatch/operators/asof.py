"""Nearest-in-time and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import settle


# How many milliseconds before or after it a process may start that an act is laid to.
REACH = {"produced": 2_999, "tool": 9_999, "inferred_read": 29_999}


def nearest(left: DataFrame, right: DataFrame, by: str, ts: str, right_id: str, tolerance: int | None = None) -> DataFrame:
    """Each left row with the right row of the same key that is nearest in time, and the gap.

    Rows are dealt by ranges of key and time, so a key with a third of all rows is many ranges. In
    each range two running windows find the last right row before and the first after; what a range
    has at its ends is carried over to the key's next ranges, a row a range. No pair is built. Of
    equally near rows the earlier in time wins, then the smaller id. Left rows with none within the
    tolerance get nulls; so do those whose key or time is null. ts is a long. All rows of one key and
    one time are in one range.
    """
    columns = left.columns
    both = left.withColumn("__right", F.lit(None).cast("struct<ts:bigint,id:bigint>")).unionByName(
        right.where(F.col(ts).isNotNull()).select(by, ts, F.struct(F.col(ts).cast("long").alias("ts"), F.col(right_id).cast("long").alias("id")).alias("__right")), allowMissingColumns=True
    )
    dealt = settle(both.repartitionByRange(by, ts).withColumn("__part", F.spark_partition_id()))
    # the smallest id among equal times: order by time, then id descending, last one wins
    ranges = Window.partitionBy(by, "__part")
    before = F.last("__right", True).over(ranges.orderBy(F.col(ts), F.col("__right").isNull(), F.desc("__right.id")).rowsBetween(Window.unboundedPreceding, 0))
    # the same looked at from the end of time: a frame that runs forward is kept up row by row
    after = F.last("__right", True).over(ranges.orderBy(F.desc(ts), F.col("__right").isNull(), F.desc("__right.id")).rowsBetween(Window.unboundedPreceding, 0))
    found = dealt.withColumns({"__before": before, "__after": after}).where("__right is null").join(F.broadcast(carried(dealt, by)), [by, "__part"], "left")
    found = found.withColumns({"__before": F.coalesce("__before", "__earlier"), "__after": F.coalesce("__after", "__later")})
    gap_b, gap_a = F.col(ts) - F.col("__before.ts"), F.col("__after.ts") - F.col(ts)
    best = F.when(F.col("__after").isNull() | (gap_b <= gap_a), F.col("__before")).otherwise(F.col("__after"))
    found = found.withColumn("__best", best).withColumn("gap", F.abs(F.col(ts) - F.col("__best.ts")))
    near: Column = F.col(by).isNotNull() & (F.lit(True) if tolerance is None else F.col("gap") <= tolerance)
    return found.select(*columns, F.when(near & F.col("gap").isNotNull(), F.col("__best.id")).alias("nearest_id"), F.when(near, F.col("gap")).alias("gap"))


def carried(dealt: DataFrame, by: str) -> DataFrame:
    """by, __part, __earlier, __later: the last right row of a key's ranges before, the first of those behind.

    Only ranges of a key that lies in several have a row, so there are no more than ranges.
    """
    ends = dealt.where(F.col(by).isNotNull()).groupBy(by, "__part").agg(F.max(F.struct("__right.ts", (-F.col("__right.id")).alias("minus"))).alias("last"), F.min("__right").alias("first"), F.count("__right").alias("n"))
    some = lambda x: F.when(F.col("n") > 0, x)
    ends = ends.select(by, "__part", some(F.struct(F.col("last.ts").alias("ts"), (-F.col("last.minus")).alias("id"))).alias("last"), some(F.col("first")).alias("first"))
    up, down = Window.partitionBy(by).orderBy("__part"), Window.partitionBy(by).orderBy(F.desc("__part"))
    others = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows = ends.select(by, "__part", F.last("last", True).over(others(up)).alias("__earlier"), F.last("first", True).over(others(down)).alias("__later"))
    return rows.where("__earlier is not null or __later is not null")


def laid_to(acts: DataFrame, processes: DataFrame, by: str, ts: str, act_id: str, process_id: str, edge: str) -> DataFrame:
    """by, process, act, edge, gap: an edge from the process nearest to each act, within the reach of its kind."""
    found = nearest(acts.select(by, F.col(act_id).alias("act"), ts), processes, by, ts, process_id, REACH[edge]).where("nearest_id is not null")
    return found.select(by, F.col("nearest_id").alias("process"), "act", F.lit(edge).alias("edge"), "gap")


def within(left: DataFrame, right: DataFrame, by: str, ts: str, reach: int, most: int | None, left_id: str, right_id: str) -> DataFrame:
    """Right rows within `reach` of each left row, the `most` nearest of them.

    Both sides are cut into buckets of `reach`; a right row is sent to its bucket and both
    neighbours, so the join is an equi-join on key and bucket.
    """
    bucket = F.floor(F.col(ts) / reach)
    a = left.select(by, F.col(left_id).alias("left_id"), F.col(ts).alias("left_ts"), bucket.alias("__b"))
    b = right.select(by, F.col(right_id).alias("right_id"), F.col(ts).alias("right_ts"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__b"))
    joined = a.join(b, [by, "__b"]).where((F.abs(F.col("left_ts") - F.col("right_ts")) <= reach) & (F.col("left_id") != F.col("right_id")))
    joined = joined.select(by, "left_id", "right_id", F.abs(F.col("left_ts") - F.col("right_ts")).alias("gap"))
    if most is None:
        return joined
    w = Window.partitionBy("left_id").orderBy("gap", "right_id")
    return joined.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
