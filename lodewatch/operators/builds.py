"""Build records: trust in seven dimensions, verdicts, hermeticity, contracts, red-team rules, features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import bounded, half_up, ratio
from ..functions.text import short_hash

#: Weights of the dimensions that a caller gives as columns; redteam.trust has the seven of a whole record.
DIMENSIONS = {"toolchain": 0.18, "inputs": 0.18, "artifacts": 0.15, "network": 0.15, "process": 0.12, "environment": 0.12, "history": 0.10}


def trust(records: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Adds each dimension, bounded to 0..100, and their weighted sum."""
    rows = records.withColumns({d: half_up(bounded(c)) for d, c in dimensions.items()})
    total = sum((F.col(d) * w for d, w in DIMENSIONS.items()), F.lit(0.0))
    return rows.withColumn("trust", F.round(total, 4))


def trust_score(deductions: Sequence[tuple[Column, float, float]], additions: Column) -> Column:
    """100 less each count times its cost, each capped, plus additions."""
    lost = sum((F.least(count * cost, F.lit(cap)) for count, cost, cap in deductions), F.lit(0.0))
    return bounded(100 - lost + additions)


def trust_verdict(score: Column) -> Column:
    return F.when(score >= 80, "CLEAN").when(score >= 50, "REVIEW").otherwise("BLOCK")


def hermetic(network: Column, unknown: Column, paths: Column, stages: Column, violations: Column, baseline: Column, secrets: Column) -> Column:
    """How closed a build was: 100 less capped deductions."""
    cap = lambda x, top: F.least(x, F.lit(top))
    return bounded(100 - cap(8 * network, 30) - cap(5 * unknown, 20) - cap(10 * paths, 20) - cap(5 * stages, 20) - cap(10 * violations, 40) - F.when(baseline, 0).otherwise(15) - cap(8 * secrets, 30))


def fingerprint(rows: DataFrame, by: Sequence[str], item: Column) -> DataFrame:
    """by, items, dna: a short hash of the sorted distinct items of a record."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set(item.cast("string"))).alias("items")).select(*by, F.size("items").alias("items"), short_hash(F.array_join("items", "|")).alias("dna"))


def contract(uses: DataFrame, key: str, record: str, tool: str, least: int) -> DataFrame:
    """key, tool, records, first_record, state: required, or new, once the key has so many records."""
    used = uses.select(key, record, tool).distinct()  # read once: what follows starts from its rows
    total = used.select(key, record).distinct().groupBy(key).agg(F.count(record).alias("all"), F.max(record).alias("last"))
    per = used.groupBy(key, tool).agg(F.count("*").alias("records"), F.min(record).alias("first_record"))
    rows = per.join(total, key).where(F.col("all") >= least)
    state = F.when(F.col("first_record") == F.col("last"), "NEW_TOOL").when(F.col("records") * 2 >= F.col("all"), "REQUIRED")
    return rows.withColumn("state", state).where("state is not null").select(key, tool, "records", "first_record", "state")


def rules_fired(records: DataFrame, key: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """key, rule for every rule a record fires, unpivoted from one pass over the records."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return records.select(*key, F.explode(hits).alias("rule"))


def detection_rate(fired: DataFrame, records: DataFrame, by: str, record: str) -> DataFrame:
    """by, rule, rate, status over all of a key's records."""
    total = records.groupBy(by).agg(F.countDistinct(record).alias("all"))
    found = fired.groupBy(by, "rule").agg(F.countDistinct(record).alias("hits")).join(total, by)
    rate = ratio(F.col("hits"), F.col("all"))
    return found.select(by, "rule", F.round(rate, 6).alias("rate"), F.when(rate >= 0.8, "detected").when(rate >= 0.3, "partial").otherwise("missed").alias("status"))


def features(records: DataFrame, key: str, caps: dict[str, float]) -> DataFrame:
    """key and each measure over its cap, 1 at most."""
    return records.select(key, *[F.round(F.least(F.col(c) / cap, F.lit(1.0)), 8).alias(c) for c, cap in caps.items()])


# The features of a build record in order, with the value that counts as 1; `+` caps at it.
FEATURES = {
    "avg_confidence": "100", "edge_node_ratio": "5+", "max_depth": "20+", "component_count": "10+", "graph_density": "1", "graph_entropy": "1", "is_dag": "1", "scc_count": "50+", "idom_count": "50+", "confidence_spread": "100+",
    "max_fan_out": "20+", "avg_fan_out": "10+", "largest_component_ratio": "1", "avg_betweenness": "1+", "max_betweenness": "1", "avg_closeness": "1+", "max_closeness": "1", "root_eccentricity": "20+", "avg_branch_factor": "10+",
    "process_tree_depth": "20+", "longest_chain_ms": "60000+", "critical_path_ms": "60000+", "avg_edge_latency_ms": "30000+", "max_edge_latency_ms": "60000+", "edge_latency_variance": "1000000+", "temporal_span_ms": "120000+",
    "global_prior": "1", "overall_posterior": "1", "spawned_posterior": "1", "accessed_posterior": "1", "connected_posterior": "1", "uploaded_posterior": "1", "exfiltrated_posterior": "1", "hijack_risk": "1", "dominant_changed": "1",
    "toolchain_shift": "1", "dominant_idom_count": "50+", "process_count": "100+", "file_op_count": "200+", "network_count": "50+", "secret_count": "20+", "compiler_count": "20+", "anomaly_count": "20+", "exfil_risk_count": "10+",
    "critical_secret_count": "10+", "orphan_count": "5+", "fileless_count": "5+", "doh_count": "5+", "named_pipe_count": "5+", "ld_preload_count": "5+", "suspicious_maps_count": "5+", "response_file_changes": "10+",
    "secret_path_length": "20+", "network_path_length": "50+", "compiler_diversity": "10+", "toolchain_entropy": "1", "contract_violation_ratio": "1+", "file_read_ratio": "1+", "secret_to_process_ratio": "5+",
    "network_to_process_ratio": "10+", "hermetic_score": "100", "reproducibility_score": "100", "observation_confidence": "100", "inference_degradation": "1+", "observation_degradation": "1+", "confidence_variance": "1000+",
    "total_processes": "100+", "total_hash_links": "100+", "exit_state": "1",
}
# Weights of the features that trust is learned from.
LEARNED = {"avg_confidence": 0.15, "edge_node_ratio": 0.05, "hermetic_score": 0.12, "reproducibility_score": 0.08, "anomaly_count": 0.12, "exfil_risk_count": 0.10, "critical_secret_count": 0.10, "max_depth": 0.05, "component_count": 0.03}


def exit_state(code: Column) -> Column:
    """0 for success, 1 for failure, a half where it is not known."""
    return F.when(code.isNull(), 0.5).when(code == 0, 0.0).otherwise(1.0)


def feature_vector(records: DataFrame, *keys: str) -> DataFrame:
    """keys and all features, each over the value that counts as 1; records have a column of each name."""

    def one(name: str) -> Column:
        top = float(FEATURES[name].rstrip("+"))
        value = F.least(F.col(name).cast("double"), F.lit(top)) if FEATURES[name].endswith("+") else F.col(name)
        return F.round(value / top, 8).alias(name)

    return records.select(*keys, *[one(name) for name in FEATURES])


def learned_trust(records: DataFrame, *keys: str) -> DataFrame:
    """keys, trust: the weighted sum of nine features in whole per cent."""
    percent = lambda n: half_up(F.least(F.col(n) / float(FEATURES[n].rstrip("+")), F.lit(1.0)) * 100)
    total = sum((percent(n) * w for n, w in LEARNED.items()), F.lit(0.0))
    return records.select(*keys, half_up(F.round(total, 9)).cast("int").alias("trust"))
