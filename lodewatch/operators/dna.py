"""Likeness of builds and what changed between them: hashes, entropy, similarity and integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import half_up, ratio
from ..sources import artifacts

# Weights of the facets, by equality and by likeness; the tolerance of numbers.
EXACT = {"toolchain": 0.2, "environment": 0.1, "artifact": 0.25, "network": 0.1, "graph": 0.2, "behavior": 0.15}
MIXED = {"tools": 0.25, "artifacts": 0.25, "graph": 0.2, "hosts": 0.1, "operations": 0.1, "duration": 0.05, "anomalies": 0.05}
TOLERANCE = 0.15


def numeric_likeness(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """1 for equal numbers, their ratio within the tolerance, beyond it what is left of the ratio."""
    top, low = F.greatest(a, b), F.least(a, b)
    r = low / top
    return F.when((a == b) | (top == 0), 1.0).when(r >= 1 - tolerance, r).otherwise(F.greatest(F.lit(0.0), r - tolerance) / (1 - tolerance))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all of two sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def exact_likeness(pairs: DataFrame) -> Column:
    """The weighted share of facets that are equal; pairs have <facet>_a and <facet>_b."""
    return half_up(F.round(sum((F.when(F.col(f"{f}_a") == F.col(f"{f}_b"), w).otherwise(0.0) for f, w in EXACT.items()), F.lit(0.0)), 9), 3)


def mixed_likeness() -> Column:
    """The weighted likeness of two builds in columns <facet>_a and <facet>_b: sets, a signature, numbers and a count."""
    pieces = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(".{1,8}"), F.lit(0)))
    two = lambda f: (F.col(f"{f}_a"), F.col(f"{f}_b"))
    parts = {
        "tools": jaccard(*two("tools")),
        "artifacts": jaccard(*two("artifacts")),
        "graph": F.when(F.col("graph_a") == F.col("graph_b"), 1.0).otherwise(jaccard(pieces("graph_a"), pieces("graph_b"))),
        "hosts": jaccard(*two("hosts")),
        "operations": numeric_likeness(*two("operations")),
        "duration": numeric_likeness(*two("duration")),
        "anomalies": F.when(F.col("anomalies_a") == F.col("anomalies_b"), 1.0).otherwise(0.5),
    }
    return half_up(F.round(sum((parts[f] * w for f, w in MIXED.items()), F.lit(0.0)), 9), 3)


def hash31(text: Column) -> Column:
    """The 32-bit hash that takes 31 times itself and adds each character."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c)).cast("int")


def byte_entropy(content: Column) -> Column:
    """Shannon entropy of bytes in bits, to two places; 0 for none."""
    return F.when(F.octet_length(content) == 0, 0.0).otherwise(artifacts.byte_entropy(content))


def canonical(*columns: str) -> Column:
    """JSON of the columns in the order of their names, nulls left out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def input_fingerprint(inputs: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, inputs, fingerprint: a hash of the sorted lines of name and hash."""
    line = F.concat_ws(":", "name", "hash")
    return inputs.groupBy(*by).agg(F.array_sort(F.collect_list(line)).alias("l")).select(*by, F.size("l").alias("inputs"), F.sha2(F.array_join("l", "\n").cast("binary"), 256).alias("fingerprint"))


def input_stability(changes: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, stability: the share of inputs that stayed as they were, in per cent."""
    rows = changes.groupBy(*by).agg(F.count_if(F.col("state") == "unchanged").alias("same"), F.count("*").alias("all"))
    return rows.select(*by, half_up(ratio(F.col("same"), F.col("all")) * 100).cast("int").alias("stability"))


def sanitised(text: Column) -> Column:
    """Without control characters, with long secrets behind a mask of their first four."""
    plain = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.regexp_replace(plain, r"\b([A-Za-z0-9_-]{4})[A-Za-z0-9_-]{16,}\b", "$1***")


def masked(line: Column) -> Column:
    """A line with strings and comments taken out, so that only code is left to test."""
    return F.regexp_replace(F.regexp_replace(line, r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`", "\"\""), r"//.*$|/\*.*?\*/|^\s*#.*$", "")


def integrity_chain(rows: DataFrame, by: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """rows with own and previous: a hash of six fields and one of the whole row before; a first row has none before."""
    own = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]).cast("binary"), 256)
    whole = F.sha2(F.to_json(F.struct(*sorted(rows.columns))).cast("binary"), 256)
    return rows.withColumn("own", own).withColumn("previous", F.coalesce(F.lag(whole).over(Window.partitionBy(*by).orderBy(*order)), F.lit("")))


def artifact_findings(entropy: Column, executable: Column, hosts: Column, imports: Column) -> Column:
    """array<string>: packed (over 7.5 bits), packed_code (executable and over 7.8), suspicious_host, dynamic_load."""
    odd = F.exists(hosts, lambda h: h.rlike(r"\.(?:ru|cn|tk|ml|ga)\z"))
    loads = F.exists(imports, lambda i: i.isin("dlopen", "dlsym", "LoadLibraryA", "LoadLibraryW", "GetProcAddress"))
    return F.array_compact(F.array(F.when(entropy > 7.5, F.lit("packed")), F.when(executable & (entropy > 7.8), F.lit("packed_code")), F.when(odd, F.lit("suspicious_host")), F.when(loads, F.lit("dynamic_load"))))


def snapshot_delta(now: DataFrame, then: DataFrame, by: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """by and the change of each count against an earlier snapshot, 0 where there is none."""
    old = then.select(*by, *[F.col(c).alias(f"__{c}") for c in counts])
    return now.join(old, list(by), "left").select(*by, *[(F.col(c) - F.coalesce(f"__{c}", F.lit(0))).alias(f"{c}_delta") for c in counts])


def explain_confidence(n: Column, kinds: Column, high: Column, persistence: Column) -> Column:
    """From 0.1 to 1: more with evidence, with its kinds and with a high finding, less with persistence."""
    raw = 0.5 + F.least(n / 10, F.lit(0.3)) + kinds / 6 * 0.2 + F.when(high, 0.2).otherwise(0.0) - persistence
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.1), raw)), 6)


def pipeline_confidence(behaviors: DataFrame, sensors: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, confidence: mean confidence of behaviours times mean trust of healthy sensors times ten a behaviour, 100 at most."""
    sure = behaviors.groupBy(*by).agg(F.round(F.avg("confidence"), 9).alias("c"), F.count("*").alias("n"))
    trusted = sensors.where("ok").groupBy(*by).agg(F.round(F.avg("trust"), 9).alias("t"))
    rows = sure.join(trusted, list(by), "left")
    return rows.select(*by, F.least(F.lit(100), half_up(F.col("c") * F.coalesce("t", F.lit(0.0)) * F.col("n") * 10)).cast("int").alias("confidence"))


def sensor_coverage(sensors: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, coverage, blind, health: trust times capability over all configured, what failed sensors leave unseen, and the state."""
    rows = sensors.groupBy(*by).agg(
        F.sum(F.when(F.col("ok"), F.col("trust") * F.col("capability") * 100).otherwise(0.0)).alias("sum"), F.count("*").alias("n"), F.count_if("ok").alias("up"), F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("sees")))).alias("blind")
    )
    share = F.col("up") / F.col("n")
    return rows.select(*by, F.round(F.col("sum") / F.col("n"), 4).alias("coverage"), F.array_join("blind", ",").alias("blind"), F.when(share >= 0.8, "healthy").when(share >= 0.5, "degraded").otherwise("critical").alias("health"))
