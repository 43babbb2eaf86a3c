"""Session events as behaviours: classifiers, timing signals, inference, risk and session summaries.

Events are rows (session, seq, ts in microseconds, kind, host, bytes). A behaviour is a row
(session, seq, ts, type, confidence). Every operator is a projection, a grouped aggregate with
partial sums, or a window within one session.
"""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import bounded, half_up, ratio
from .scan import lookup

SECOND = 1_000_000

# Risk weight of each behaviour.
WEIGHTS = {
    "repo_indexed": 25, "git_history_read": 35, "git_objects_read": 40, "git_bundle_created": 60, "git_bundle_uploaded": 90,
    "git_archive_created": 50, "secrets_scanned": 30, "secrets_exfiltrated": 95, "embeddings_generated": 20, "full_repo_snapshot": 85,
    "canary_exfiltrated": 99, "mass_file_read": 15, "suspicious_connection": 30, "ai_prompt_sent": 10, "code_upload": 50,
    "prompt_injection_attempt": 70, "process_suspicious": 20, "dns_suspicious": 25, "tls_suspicious": 25, "anti_evasion_detected": 60,
    "preparation_detected": 40, "process_chain_detected": 50, "monitor_awareness_detected": 70, "monitor_disabled": 80, "canary_read": 70,
    "canary_modified": 75, "fake_secret_read": 80, "fake_secret_exfiltrated": 95, "contaminated_git_read": 75, "evidence_chain_detected": 65,
    "pre_operational_snapshot_detected": 60,
}

# Groups whose members together multiply the risk.
SEQUENCES = [
    (("preparation_detected",), 1.3),
    (("git_history_read", "git_objects_read", "mass_file_read"), 1.4),
    (("git_bundle_created", "git_archive_created"), 1.8),
    (("dns_suspicious", "tls_suspicious"), 1.2),
    (("code_upload", "git_bundle_uploaded", "secrets_exfiltrated", "canary_exfiltrated"), 2.0),
]

# Technique, tactic and stage of each behaviour; any other is T1078, defense evasion, other.
TECHNIQUES = [
    ("repo_indexed", "T1213", "Collection", "Collection"),
    ("git_history_read", "T1213", "Collection", "Collection"),
    ("git_objects_read", "T1213", "Collection", "Collection"),
    ("git_bundle_created", "T1074", "Collection", "Packaging"),
    ("git_bundle_uploaded", "T1041", "Exfiltration", "Exfiltration"),
    ("git_archive_created", "T1560", "Collection", "Packaging"),
    ("secrets_scanned", "T1555", "Credential Access", "Collection"),
    ("secrets_exfiltrated", "T1041", "Exfiltration", "Exfiltration"),
    ("embeddings_generated", "T1213", "Collection", "Collection"),
    ("full_repo_snapshot", "T1074", "Collection", "Collection"),
    ("canary_exfiltrated", "T1041", "Exfiltration", "Exfiltration"),
    ("mass_file_read", "T1005", "Collection", "Collection"),
    ("suspicious_connection", "T1071", "Command and Control", "Other"),
    ("ai_prompt_sent", "T1071", "Command and Control", "Other"),
    ("code_upload", "T1041", "Exfiltration", "Exfiltration"),
    ("prompt_injection_attempt", "T1567", "Exfiltration", "Exfiltration"),
    ("process_suspicious", "T1059", "Execution", "Other"),
    ("dns_suspicious", "T1572", "Command and Control", "Other"),
    ("tls_suspicious", "T1572", "Command and Control", "Other"),
    ("anti_evasion_detected", "T1564", "Defense Evasion", "Other"),
    ("preparation_detected", "T1590", "Reconnaissance", "Preparation"),
    ("process_chain_detected", "T1059", "Execution", "Other"),
    ("monitor_awareness_detected", "T1497", "Defense Evasion", "Other"),
    ("monitor_disabled", "T1562", "Defense Evasion", "Other"),
    ("canary_read", "T1005", "Collection", "Collection"),
    ("canary_modified", "T1565", "Impact", "Other"),
    ("fake_secret_read", "T1555", "Credential Access", "Collection"),
    ("fake_secret_exfiltrated", "T1041", "Exfiltration", "Exfiltration"),
    ("contaminated_git_read", "T1213", "Collection", "Collection"),
    ("evidence_chain_detected", "T1074", "Collection", "Collection"),
    ("pre_operational_snapshot_detected", "T1590", "Reconnaissance", "Preparation"),
]
NO_TECHNIQUE = ("T1078", "Defense Evasion", "Other")
STAGES = ["Preparation", "Collection", "Packaging", "Exfiltration", "Other"]


def flow_type(host_known: Column, sent: Column, prompt: Column, dns: Column, sni: Column, mib: float, kib50: float) -> Column:
    """The behaviour of a flow; later tests override earlier ones."""
    return (
        F.when(sni, "tls_suspicious")
        .when(dns, "dns_suspicious")
        .when(host_known & (sent > mib), "code_upload")
        .when(host_known & prompt, "ai_prompt_sent")
        .when(host_known, "suspicious_connection")
        .when(prompt & (sent > kib50), "code_upload")
    )


def flow_confidence(evidence: Column, artifacts: Column, large: Column, huge: Column, tls: Column) -> Column:
    bonus = lambda c, x: F.when(c, x).otherwise(0.0)
    return F.least(F.lit(0.99), 0.5 + 0.15 * evidence + 0.10 * artifacts + bonus(large, 0.15) + bonus(huge, 0.10) + bonus(tls, 0.05))


def rhythm(events: DataFrame, least: int = 20, least_gap: float = 10_000, most_cv: float = 0.15) -> DataFrame:
    """session, n, avg_gap, cv, artificial: how regular the gaps between events are."""
    w = Window.partitionBy("session").orderBy("ts", "seq")
    gaps = events.withColumn("gap", F.col("ts") - F.lag("ts").over(w))
    found = gaps.groupBy("session").agg(F.count("*").alias("n"), F.avg("gap").alias("avg_gap"), F.stddev_pop("gap").alias("std"))
    cv = ratio(F.col("std"), F.col("avg_gap"))
    regular = (F.col("n") >= least) & (F.col("avg_gap") >= least_gap) & (cv < most_cv)
    return found.select("session", "n", F.col("avg_gap"), cv.alias("cv"), F.coalesce(regular, F.lit(False)).alias("artificial"))


def hopping(events: DataFrame, least: int = 6, changes: int = 3, span: int = 120 * SECOND) -> DataFrame:
    """session, windows, hops: tumbling spans in which the kind changes often."""
    w = Window.partitionBy("session").orderBy("ts", "seq")
    rows = events.withColumn("span", F.floor(F.col("ts") / span)).withColumn("change", (F.col("kind") != F.lag("kind").over(w)).cast("int"))
    spans = rows.groupBy("session", "span").agg(F.count("*").alias("n"), F.coalesce(F.sum("change"), F.lit(0)).alias("hops"))
    return spans.where((F.col("n") >= least) & (F.col("hops") >= changes)).groupBy("session").agg(F.count("*").alias("windows"), F.max("hops").alias("hops"))


def fragmented(events: DataFrame, least: int, total: float, chunk: float, span: int, flows: int) -> DataFrame:
    """session, host, n, bytes, avg_chunk, span_us of destinations that receive much in many small parts."""
    found = events.groupBy("session", "host").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), (F.max("ts") - F.min("ts")).alias("span_us"))
    found = found.withColumn("avg_chunk", F.col("bytes") / F.col("n"))
    keep = (F.col("n") >= least) & (F.col("bytes") >= total) & ((F.col("avg_chunk") < chunk) | ((F.col("span_us") > span) & (F.col("n") > flows)))
    return found.where(keep)


def distributed(events: DataFrame, large: float, hosts: int = 3) -> DataFrame:
    """session, hosts: sessions that sent a large flow to several hosts."""
    found = events.groupBy("session").agg(F.countDistinct(F.when(F.col("bytes") > large, F.col("host"))).alias("hosts"))
    return found.where(F.col("hosts") >= hosts)


def read_write(events: DataFrame, read: Column, write: Column, sensitive: Column, least: int, most_ratio: float, sensitive_least: int) -> DataFrame:
    """session, reads, writes, sensitive, confidence: reading without writing."""
    found = events.groupBy("session").agg(F.count_if(read).alias("reads"), F.count_if(write).alias("writes"), F.count_if(read & sensitive).alias("sensitive"))
    share = F.col("reads") / F.greatest(F.col("writes"), F.lit(1))
    keep = (F.col("reads") >= least) & (share > most_ratio) & ((F.col("sensitive") >= sensitive_least) | (F.col("reads") >= 2.5 * least))
    confidence = F.when(F.col("sensitive") >= 2 * sensitive_least, 0.8).when(F.col("sensitive") >= sensitive_least, 0.75).otherwise(0.65)
    return found.where(keep).withColumn("confidence", confidence)


def mass_reads(events: DataFrame, span: int, least: int, distinct: int) -> DataFrame:
    """session, start, n, kinds of tumbling windows with many reads."""
    found = events.groupBy("session", (F.floor(F.col("ts") / span) * span).alias("start")).agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts"))
    return found.where((F.col("n") >= least) & (F.col("hosts") >= distinct))


def evasion_score(signals: DataFrame, weights: dict[str, float], order: str = "seq") -> DataFrame:
    """session, score: weights times confidence, rounded, 100 at most.

    Added up in the signals' order, so that which way a half goes does not depend on how rows are
    dealt. A running sum, so a session of any number of signals needs no row to hold them.
    """
    part = lookup(F.col("type"), weights, 0.0) * F.col("confidence")
    so_far = Window.partitionBy("session").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = signals.select("session", order, F.sum(part).over(so_far).alias("total"))
    return sums.groupBy("session").agg(bounded(half_up(F.max_by("total", order))).cast("int").alias("score"))


def inferred(behaviors: DataFrame, exfil: DataFrame) -> DataFrame:
    """session, rule, type, confidence: behaviours that follow from others, rule by rule in order.

    exfil: (session, sent) whether something left the machine. Later rules see what earlier ones
    added; the flags named at the start are read once.
    """
    flag = lambda t: F.bool_or(F.col("type") == t).alias(t)
    kinds = ["git_bundle_created", "mass_file_read", "git_history_read", "git_objects_read", "canary_read", "secrets_scanned", "full_repo_snapshot", "git_bundle_uploaded", "canary_exfiltrated", "secrets_exfiltrated", "suspicious_connection", "preparation_detected", "code_upload"]
    s = behaviors.groupBy("session").agg(*[flag(t) for t in kinds]).join(exfil, "session", "left")
    s = s.withColumn("out", F.col("code_upload") | F.col("git_bundle_uploaded") | F.coalesce("sent", F.lit(False)))
    s = s.withColumn("r04", F.col("git_bundle_created") & ~F.col("full_repo_snapshot"))
    s = s.withColumn("r05", F.col("mass_file_read") & F.col("git_history_read") & ~F.col("full_repo_snapshot") & ~F.col("r04"))
    s = s.withColumn("r06", F.col("git_bundle_created") & F.col("out") & ~F.col("git_bundle_uploaded"))
    s = s.withColumn("r07", F.col("canary_read") & F.col("out") & ~F.col("canary_exfiltrated"))
    s = s.withColumn("r08", F.col("git_objects_read") & F.col("out") & ~F.col("full_repo_snapshot") & ~F.col("r04") & ~F.col("r05"))
    s = s.withColumn("r10", F.col("preparation_detected") & F.coalesce("sent", F.lit(False)) & ~F.col("suspicious_connection"))
    s = s.withColumn("r12", F.col("secrets_scanned") & F.col("out") & ~F.col("secrets_exfiltrated"))
    rules = [("r04", "full_repo_snapshot", 0.9), ("r05", "full_repo_snapshot", 0.9), ("r06", "git_bundle_uploaded", 0.95), ("r07", "canary_exfiltrated", 0.95), ("r08", "full_repo_snapshot", 0.9), ("r10", "suspicious_connection", 0.8), ("r12", "secrets_exfiltrated", 0.95)]
    hits = F.array_compact(F.array(*[F.when(F.col(r), F.struct(F.lit(r).alias("rule"), F.lit(t).alias("type"), F.lit(c).alias("confidence"))) for r, t, c in rules]))
    return s.select("session", F.explode(hits).alias("hit")).select("session", "hit.*")


def risk(behaviors: DataFrame, order: str = "seq") -> DataFrame:
    """session, score, level, confidence: weighted behaviours, multiplied for what they form together.

    Types are added up in the order in which a session shows them first, and multiplied one factor after
    the other, so that which way a half goes does not depend on how rows are dealt.
    """
    best = behaviors.groupBy("session", "type").agg(F.max("confidence").alias("confidence"), F.min(order).alias("first"))
    part = lookup(F.col("type"), WEIGHTS, 0) * F.col("confidence")
    parts = F.array_sort(F.collect_list(F.when(part != 0, F.struct("first", part.alias("part")))))  # a row a type that has a weight
    has = lambda *types: F.bool_or(F.col("type").isin(*types))
    every = lambda types: F.count_if(F.col("type").isin(*types)) == len(types)  # noqa: E731  # best has a row a type
    base = best.groupBy("session").agg(
        F.aggregate(parts, F.lit(0.0), lambda total, p: total + p["part"]).alias("raw"),
        F.count("*").alias("kinds"),
        (has("git_bundle_created") & has("code_upload", "git_bundle_uploaded")).alias("bundle"),
        (has("anti_evasion_detected") & has("code_upload", "canary_exfiltrated")).alias("evasion"),
        has("canary_exfiltrated", "fake_secret_read").alias("canary"),
        *[every(types).alias(f"seq{i}") for i, (types, _) in enumerate(SEQUENCES)],
    )
    timing = behaviors.groupBy("session").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 8).alias("avg_confidence"), F.countDistinct("type").alias("distinct"), ((F.max("ts") - F.min("ts")) / SECOND).alias("span"))
    joined = base.join(timing, "session")
    gap = F.col("span") / (F.col("n") - 1)
    times = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(1.0))
    together = reduce(mul, [times(F.col(f"seq{i}"), x) for i, (_, x) in enumerate(SEQUENCES)])
    close = F.when(F.col("n") < 2, 1.0).when(gap < 30, 1.5).when(gap < 120, 1.3).when(gap < 600, 1.1).otherwise(1.0)
    raw = F.col("raw") * times(F.col("bundle"), 2.0) * times(F.col("evasion"), 2.5) * times(F.col("canary"), 3.0) * times(F.col("kinds") >= 3, 1.3) * together * close
    score = F.least(F.lit(100), half_up(raw / 120 * 100)).cast("int")
    sure = F.least(F.lit(0.99), F.col("avg_confidence") * 0.75 + F.least(F.col("n") / 5, F.lit(1.0)) * 0.15 + F.least(F.col("distinct") / 3, F.lit(1.0)) * 0.1 + 0.1)
    level = F.when(F.col("score") >= 80, "CRITICAL").when(F.col("score") >= 50, "HIGH").when(F.col("score") >= 20, "MEDIUM").otherwise("LOW")
    return joined.select("session", score.alias("score"), F.round(sure, 6).alias("confidence")).withColumn("level", level)


def session_dna(events: DataFrame, behaviors: DataFrame) -> DataFrame:
    """session, bytes, hosts, kinds, top_type: one row that sums a session up."""
    a = events.groupBy("session").agg(F.sum("bytes").alias("bytes"), F.countDistinct("host").alias("hosts"))
    b = behaviors.groupBy("session", "type").agg(F.sum(lookup(F.col("type"), WEIGHTS, 0) * F.col("confidence")).alias("w"))
    b = b.groupBy("session").agg(F.count("*").alias("kinds"), F.max_by("type", F.struct(F.round("w", 6), "type")).alias("top_type"))
    return a.join(b, "session", "left")


def mapped(behaviors: DataFrame) -> DataFrame:
    """Adds technique, tactic and stage of each behaviour's type."""
    dim = F.broadcast(behaviors.sparkSession.createDataFrame(TECHNIQUES, "type string, technique string, tactic string, stage string"))  # a fixed table
    names = ("technique", "tactic", "stage")
    return behaviors.join(dim, "type", "left").withColumns({c: F.coalesce(c, F.lit(other)) for c, other in zip(names, NO_TECHNIQUE, strict=True)})


def stages(behaviors: DataFrame) -> DataFrame:
    """session, technique, tactic, stage, first_ts, n: each technique and tactic once per session, with the stage of its first behaviour."""
    return mapped(behaviors).groupBy("session", "technique", "tactic").agg(F.min_by("stage", F.struct("ts", "stage")).alias("stage"), F.min("ts").alias("first_ts"), F.count("*").alias("n"))


def stage_timeline(behaviors: DataFrame) -> DataFrame:
    """session, stage, place, first_ts, n, evidence: each stage at its first sight, in the fixed order, with three of its behaviours."""
    rows = mapped(behaviors).groupBy("session", "stage").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"), F.array_sort(F.collect_set("type")).alias("types"))
    place = lookup(F.col("stage"), {s: i for i, s in enumerate(STAGES)}, len(STAGES))
    return rows.select("session", "stage", place.alias("place"), "first_ts", "n", F.array_join(F.slice("types", 1, 3), ",").alias("evidence"))


def first_chain(behaviors: DataFrame) -> DataFrame:
    """session, chain: the types of a session in the order of their first sight."""
    first = behaviors.groupBy("session", "type").agg(F.min("ts").alias("ts"))
    listed = first.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ts", "type"))).alias("t"))  # a row a type
    return listed.select("session", F.array_join("t.type", ">").alias("chain"))


def sessions(events: DataFrame, gap: int) -> DataFrame:
    """key, visit, start, end, n: runs of events with smaller gaps than `gap`."""
    w = Window.partitionBy("session").orderBy("ts", "seq")
    new = (F.col("ts") - F.lag("ts").over(w) > gap).cast("int")
    rows = events.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("visit", F.sum("new").over(w))
    return rows.groupBy("session", "visit").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))


def first_per_key(events: DataFrame, keys: list[str]) -> DataFrame:
    """The earliest row of each key; an aggregate with partial minima, not a window."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min(F.struct("ts", "seq", *[c for c in rest if c not in ("ts", "seq")])).alias("r")).select(*keys, "r.*")


def observation_confidence(events: DataFrame, bases: dict[str, float], weights: dict[str, float]) -> DataFrame:
    """session, confidence, coverage: rounded means by signal, weighted by signal."""
    per = events.groupBy("session", "kind").agg(half_up(F.avg(F.least(F.lit(100.0), lookup(F.col("kind"), bases, 0.0) + F.when(F.col("bytes") > 0, 5).otherwise(0) + F.when(F.col("host").isNotNull(), 5).otherwise(0)))).alias("c"))
    out = per.groupBy("session").agg(half_up(F.sum(F.col("c") * lookup(F.col("kind"), weights, 0.0))).cast("int").alias("confidence"), F.round(F.count_if(F.col("c") >= 50) / float(len(weights)), 6).alias("coverage"))
    return out


def threshold(events: DataFrame, least: int, critical: list[str]) -> DataFrame:
    """session, n, types, last_ts, trend of sessions with at least so many events."""
    found = events.groupBy("session").agg(F.count("*").alias("n"), F.countDistinct("kind").alias("types"), F.max("ts").alias("last_ts"), F.countDistinct(F.when(F.col("kind").isin(*critical), F.col("kind"))).alias("critical"))
    trend = F.when(F.col("critical") > 2, "ESCALATING").when(F.col("n") >= 2 * least, "ELEVATED").otherwise("MONITOR")
    return found.where(F.col("n") >= least).withColumn("trend", trend).drop("critical")
