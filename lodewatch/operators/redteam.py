"""Detection rules over build records, labels and trust from them, and campaigns of trials.

A record is a row with the arrays tools and anomalies and counts (network, dns, processes, modified,
secrets, violations, ...). Every rule is a column, so a record meets all rules in one projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import bounded, half_up

# Tools by what they account for.
KNOWN_TOOLS = ["npm", "node", "tsc", "esbuild", "webpack", "vite", "rollup", "gcc", "g++", "make", "cargo", "rustc", "go", "javac", "mvn", "gradle"]
NETWORK_TOOLS = ["npm", "yarn", "pnpm", "curl", "wget", "cargo", "go"]
COMPILERS = ["tsc", "gcc", "g++", "javac", "rustc", "go", "cargo"]
WRITERS = [*COMPILERS, "esbuild", "webpack", "vite"]
# Words in an anomaly's text, by rule.
WORDS = {
    "DR-006": ["named pipe"],
    "DR-007": ["PATH", "LD_PRELOAD", "environment"],
    "DR-009": ["ETW", "EtwEventWrite", "provider", "VirtualProtect"],
    "DR-010": ["syscall", "ntdll", "NtCreate", "NtWrite"],
    "DR-011": ["PATH priority", "tool hash", "signature", "fake"],
    "DR-012": ["parent", "chain", "spawn"],
    "DR-013": ["named pipe", "pipe", "IPC"],
    "DR-014": ["DoH", "DoT", "dns-query", "base64", "TXT query"],
    "DR-015": ["VirtualAlloc", "WriteProcessMemory", "CreateRemoteThread", "fileless", "memory"],
}
MOST_PROCESSES, MOST_QUERIES = 50, 10
# The trust dimensions and their weights.
TRUST = {"toolchain_identity": 0.18, "input_identity": 0.18, "artifact_integrity": 0.15, "behavior": 0.15, "network": 0.12, "graph": 0.12, "trend": 0.10}
PROCESS_NAMES = r"^(?:gcc|g\+\+|clang|ld|make|cmake|ninja|python|node|rustc|cargo|go|javac|curl|wget|git|strip|ar|ranlib|nm|objcopy|readelf|configure)\z"


def mentions(anomalies: Column, words: Sequence[str]) -> Column:
    return F.exists(anomalies, lambda a: reduce(lambda x, y: x | y, [a.contains(w) for w in words]))


def has_tool(tools: Column, names: Sequence[str]) -> Column:
    return F.exists(tools, lambda t: F.lower(t).isin(*names))


def detections() -> dict[str, Column]:
    """The fifteen rules as columns of a record."""
    tools, anomalies = F.col("tools"), F.col("anomalies")
    rules = {
        "DR-001": F.exists(tools, lambda t: ~F.lower(t).isin(*KNOWN_TOOLS)),
        "DR-002": (F.col("network") > 0) & ~has_tool(tools, NETWORK_TOOLS),
        "DR-003": (F.col("secrets") > 0) & ~has_tool(tools, COMPILERS),
        "DR-004": (F.col("processes") > MOST_PROCESSES) | (F.col("processes") == 0),
        "DR-005": (F.col("modified") > 0) & ~has_tool(tools, WRITERS),
        "DR-008": F.col("violations") > 0,
        **{rule: mentions(anomalies, words) for rule, words in WORDS.items()},
    }
    rules["DR-014"] = rules["DR-014"] | (F.col("dns") > MOST_QUERIES)
    return dict(sorted(rules.items()))


def fired(records: DataFrame, *keys: str) -> DataFrame:
    """keys, rule: a row for each rule that a record meets."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(rule)) for rule, c in detections().items()]))
    return records.select(*keys, F.explode(hits).alias("rule"))


def campaigns(records: DataFrame, attacks: DataFrame, by: str, order: Sequence[str], last: int = 10) -> DataFrame:
    """by, attack, rate, state: how many of an attack's expected rules fire in the last records of each key.

    attacks: (attack, rules). From 0.8 detected, from 0.3 partial, else missed.
    """
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    recent = records.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= last)
    seen = fired(recent, by).distinct()
    wanted = attacks.select("attack", F.size("rules").alias("of"), F.explode("rules").alias("rule"))
    hits = seen.join(F.broadcast(wanted), "rule").groupBy(by, "attack").agg(F.count("*").alias("hit"))  # attacks are a short list
    every = records.select(by).distinct().join(F.broadcast(attacks.select("attack", F.size("rules").alias("of"))))
    rate = F.coalesce("hit", F.lit(0)) / F.col("of")
    rows = every.join(hits, [by, "attack"], "left").select(by, "attack", F.round(rate, 6).alias("rate"))
    return rows.withColumn("state", F.when(F.col("rate") >= 0.8, "detected").when(F.col("rate") >= 0.3, "partial").otherwise("missed"))


def auto_label(anomalies: Column, exfil: Column, hermetic: Column, critical: Column, exit_code: Column, secrets: Column) -> Column:
    """malicious, anomalous, normal or null, in this order."""
    starts = lambda text: F.size(F.filter(anomalies, lambda a: a.startswith(text)))
    worst = F.exists(anomalies, lambda a: a.startswith("[CRITICAL]") | F.lower(a).contains("exfil") | F.lower(a).contains("injection"))
    return (
        F.when(worst | (starts("[HIGH]") >= 3) | (exfil > 0), "malicious")
        .when((starts("[HIGH]") > 0) | (starts("[MEDIUM]") >= 3) | (hermetic < 30) | (critical > 0), "anomalous")
        .when((exit_code == 0) & (F.size(anomalies) == 0) & (secrets == 0), "normal")
    )


def trust(records: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """Adds the seven dimensions, trust, purity and deterministic; a record is held against the one before it of its key.

    Columns: tool_hashes and artifact_hashes (maps), inputs (fingerprint, null if none), input_modified, input_new,
    input_removed, anomalies, network, suspicious_hosts, reads, process_names, tools, hash_links, duration.
    """
    w = Window.partitionBy(by).orderBy(*order)
    before = {f"__{c}": F.lag(c).over(w) for c in ("tool_hashes", "artifact_hashes", "inputs", "duration")}
    r = records.withColumns(before).withColumn("__first", F.row_number().over(w) == 1)
    differ = lambda now, was: F.size(F.filter(F.map_keys(now), lambda k: was[k] != now[k]))
    same_artifacts = F.coalesce(F.to_json("artifact_hashes") == F.to_json("__artifact_hashes"), F.lit(False))
    changed_tools = F.when(F.col("__tool_hashes").isNotNull(), differ(F.col("tool_hashes"), F.col("__tool_hashes"))).otherwise(0)
    changed_artifacts = F.when(F.col("__artifact_hashes").isNotNull(), differ(F.col("artifact_hashes"), F.col("__artifact_hashes"))).otherwise(0)
    anomalies = F.size("anomalies")
    names = F.col("process_names")
    unknown = F.size(F.filter(names, lambda n: ~n.rlike(PROCESS_NAMES)))
    change = F.when(F.col("__duration") > 0, F.abs(F.col("duration") - F.col("__duration")) / F.col("__duration") * 100).otherwise(0.0)
    timed = F.when(F.col("__first"), 0).when(change < 10, 10).when(change > 50, -10).otherwise(0)
    scores = {
        "toolchain_identity": 100 - F.when(F.size("tool_hashes") == 0, 20).otherwise(0) - 15 * changed_tools,
        "input_identity": 100 - F.when(F.col("inputs").isNull(), 0).otherwise(F.least(F.col("input_modified") * 8 + (F.col("input_new") + F.col("input_removed")) * 5, F.lit(40))),
        "artifact_integrity": 100 - F.when(F.size("artifact_hashes") == 0, 0).otherwise(F.least(changed_artifacts * 10, F.lit(40))),
        "behavior": 100 - F.least(anomalies * 15, F.lit(45)),
        "network": 100 - F.least(F.col("network") * 5, F.lit(25)) - F.when((F.col("network") > 0) & (F.col("suspicious_hosts") > 0), 25).otherwise(0),
        "graph": 100 - F.least(unknown * 5, F.lit(20)),
        "trend": 80 + F.when(F.col("hash_links") > 0, 10).otherwise(0) + timed,
    }
    r = r.withColumns({d: bounded(s).cast("int") for d, s in scores.items()})
    total = sum((F.col(d) * x for d, x in TRUST.items()), F.lit(0.0))
    expected = F.filter(names, lambda n: F.array_contains("tools", n))
    purity = F.when(F.size("tools") == 0, 100).otherwise(half_up(F.size(expected) / F.greatest(F.size("tools"), F.lit(1)) * 100)).cast("int")
    fixed = F.col("__first") | F.col("inputs").isNull() | F.col("__inputs").isNull() | (F.col("inputs") != F.col("__inputs")) | same_artifacts
    return r.withColumns({"trust": half_up(F.round(total, 9)).cast("int"), "purity": purity, "deterministic": fixed}).drop(*before, "__first")
