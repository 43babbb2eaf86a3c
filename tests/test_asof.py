import random

import pytest
from pyspark.sql import functions as F

from lodewatch.operators import asof


def brute(left, right, tolerance):
    out = {}
    for key, ts, name in left:
        near = sorted((abs(t - ts), t, i) for k, t, i in right if k == key and key is not None and ts is not None and t is not None)
        out[name] = (near[0][2], near[0][0]) if near and (tolerance is None or near[0][0] <= tolerance) else (None, None)
    return out


@pytest.mark.parametrize("tolerance", [None, 5])
def test_nearest_with_a_key_of_a_third_of_all_rows(spark, tolerance):
    rng = random.Random(3)
    key = lambda: rng.choice(["hot", "hot", "a", "b", "c", "d", None])
    left = [(key(), rng.randrange(3000) if rng.random() < 0.97 else None, f"l{k}") for k in range(900)]
    right = [(key(), rng.randrange(0, 3000, 7), k % 250) for k in range(400)] + [("only", None, 7), ("hot", None, 8)]
    lefts = spark.createDataFrame(left, "k string, ts long, name string").repartition(8)
    rights = spark.createDataFrame(right, "k string, ts long, id long").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges stay apart, as with more rows
    try:
        got = asof.nearest(lefts, rights, "k", "ts", "id", tolerance).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.name: (r.nearest_id, r.gap) for r in got} == brute(left, right, tolerance) and len(got) == 900


def test_a_hot_key_is_many_ranges(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 100).otherwise(-1).alias("k"), (F.col("id") * 17 % 30_011).alias("ts"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        from lodewatch.functions.tables import settle

        dealt = settle(rows.repartitionByRange("k", "ts").withColumn("part", F.spark_partition_id()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = dealt.where("k = -1").groupBy("part").count().collect()
    assert len(hot) >= 5 and max(r["count"] for r in hot) < 30_000 / 4


def test_empty_sides(spark):
    some = spark.createDataFrame([("a", 5, 1)], "k string, ts long, id long")
    assert [(r.nearest_id, r.gap) for r in asof.nearest(some, some.limit(0), "k", "ts", "id").collect()] == [(None, None)]
    assert asof.nearest(some.limit(0), some, "k", "ts", "id").count() == 0
    assert [tuple(r) for r in asof.laid_to(some.withColumn("ts", F.col("ts") + 2999), some, "k", "ts", "id", "id", "produced").collect()] == [("a", 1, 1, "produced", 2999)]
    assert asof.laid_to(some.withColumn("ts", F.col("ts") + 3000), some, "k", "ts", "id", "id", "produced").count() == 0
