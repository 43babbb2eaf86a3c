"""Written tables."""

import pytest
from pyspark.sql import functions as F

from lodewatch.functions.tables import settle, shuffling
from lodewatch.operators import chains
from lodewatch.operators import builds, trends
from lodewatch.plans import QUERIES
from tests.test_oracles import SF_DIR


def test_a_table_that_is_small_only_on_disk_is_not_broadcast(spark):
    rows = settle(spark.range(1_000_000).select((F.col("id") % 1000).alias("g"), "id"))
    joined = rows.join(rows.select("g", F.col("id").alias("other")), "g")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["typical_tools", "contract_violations", "trust_dimensions", "feature_vector"])
def test_orders_and_lines_are_dealt_in_partitions_that_are_not_merged(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2


def test_a_record_counts_once_for_an_item_and_for_its_key(spark):
    uses = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 1, "b"), (1, 2, "a"), (1, None, "c"), (2, 3, None)], "key int, build int, tool string")
    shares = {(r["key"], r["tool"]): r["share"] for r in trends.typical(uses, "key", "build", "tool", 0.0).collect()}
    assert shares == {(1, "a"): 1.0, (1, "b"): 0.5, (1, "c"): 0.5, (2, None): 1.0}
    assert {(r["key"], r["tool"], r["records"], r["state"]) for r in builds.contract(uses, "key", "build", "tool", 2).collect()} == {(1, "a", 2, "REQUIRED"), (1, "b", 1, "REQUIRED"), (1, "c", 1, "REQUIRED")}


def test_rounds_of_chains_broadcast_nothing(spark, monkeypatch):
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before, seen = spark.conf.get(limit), []
    monkeypatch.setattr(chains, "settle", lambda df: seen.append(spark.conf.get(limit)) or settle(df))
    nodes = spark.createDataFrame([(0, k, 50) for k in range(3)], "project long, seq int, risk_score int")
    edges = spark.createDataFrame([(0, 0, 1, "causal", 0.9), (0, 1, 2, "causal", 0.9)], "project long, src int, dst int, kind string, confidence double")
    assert {tuple(r.nodes) for r in chains.attack_chains(nodes, edges, ["project"]).collect()} == {(0, 1), (0, 1, 2)}
    assert set(seen) == {"-1"} and spark.conf.get(limit) == before


def test_limits_come_back_after_an_error(spark):
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(limit, None) for limit in limits]
    failed = shuffling(lambda df: df.missing)
    try:
        failed(spark.range(1))
    except Exception:  # noqa: BLE001
        pass
    assert [spark.conf.get(limit, None) for limit in limits] == before
