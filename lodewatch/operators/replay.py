"""Replayed sessions and datasets against what was expected, and against each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio


def truth_levels(csv: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(session, level): a side-car's level over the list's; `session-` before a name is an alias."""
    plain = lambda df, name: df.select(F.regexp_replace("session", "^session-", "").alias("session"), F.col("level").alias(name))
    one = lambda df, name: plain(df, name).groupBy("session").agg(F.max(name).alias(name))
    return one(csv, "listed").join(one(sidecars, "own"), "session", "full_outer").select("session", F.coalesce("own", "listed").alias("level"))


def against_truth(results: DataFrame, truth: DataFrame, default: str = "LOW") -> DataFrame:
    """tp, fp, tn, fn of sessions by level; a session without truth counts as the default, and any other level is positive."""
    joined = results.join(truth.withColumnRenamed("level", "expected"), "session", "left").withColumn("expected", F.coalesce("expected", F.lit(default)))
    got, want = F.col("level") != default, F.col("expected") != default
    return joined.agg(F.count_if(got & want).alias("tp"), F.count_if(got & ~want).alias("fp"), F.count_if(~got & ~want).alias("tn"), F.count_if(~got & want).alias("fn"))


def compared(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """session, score_diff, level_changed, added, removed: replayed sessions that both sides have."""
    b = baseline.select("session", F.col("score").alias("s0"), F.col("level").alias("l0"), F.col("types").alias("t0"))
    joined = current.join(b, "session")
    listed = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return joined.select("session", (F.col("score") - F.col("s0")).alias("score_diff"), (F.col("level") != F.col("l0")).alias("level_changed"), listed("types", "t0").alias("added"), listed("t0", "types").alias("removed"))


def scored(datasets: DataFrame, results: DataFrame) -> DataFrame:
    """id, match, delta, missing, extra, rate, false_alarm of each dataset's result."""
    j = datasets.join(results, "id")
    missing, extra = F.size(F.array_except("expected", "found")), F.size(F.array_except("found", "expected"))
    n = F.size("expected")
    rate = F.when(n > 0, (n - missing) / n).when(F.size("found") == 0, 1.0).otherwise(0.0)
    return j.select("id", "severity", "campaign", (F.col("verdict") == F.col("expected_verdict")).alias("match"), F.when(F.col("expected_score").isNull(), 0).otherwise(F.col("score") - F.col("expected_score")).alias("delta"), missing.alias("missing"), extra.alias("extra"), F.round(rate, 6).alias("rate"), ((extra > 0) & (n == 0)).alias("false_alarm"))


def report(rows: DataFrame) -> DataFrame:
    """kind, name, total, detected: by severity and, where there is one, by campaign."""
    by = lambda c: rows.where(F.col(c).isNotNull()).groupBy(F.lit(c).alias("kind"), F.col(c).alias("name")).agg(F.count("*").alias("total"), F.count_if("match").alias("detected"))
    return by("severity").unionByName(by("campaign"))


def coverage(techniques: DataFrame, covered: DataFrame) -> DataFrame:
    """Each technique with its coverage, not_covered where there is none."""
    return techniques.join(covered, "technique", "left").withColumn("state", F.coalesce("state", F.lit("not_covered")))


def corpus_coverage(profiles: DataFrame, sessions: DataFrame, tools: Sequence[str]) -> DataFrame:
    """profile, state, n: captured, missing, or unavailable where a needed tool is not at hand."""
    have = sessions.groupBy("profile").agg(F.count("*").alias("n"))
    lacks = F.size(F.array_except("requires", F.array(*map(F.lit, tools)))) > 0
    state = F.when(F.col("n") > 0, "captured").when(lacks, "unavailable").otherwise("missing")
    return profiles.join(have, "profile", "left").withColumn("n", F.coalesce("n", F.lit(0))).select("profile", state.alias("state"), "n")


def suite(tests: DataFrame) -> DataFrame:
    """status, n, share of a regression run; tests have expected and actual (null: not run)."""
    status = F.when(F.col("actual").isNull(), "skipped").when(F.col("actual") == F.col("expected"), "passed").otherwise("failed")
    rows = tests.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("status", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row


def feedback(rows: DataFrame, order: Sequence[str], last: int = 20, least: int = 10, fall: float = 0.1) -> DataFrame:
    """accuracy, recent, recent_accuracy, retrain: of all feedback and of the last; train again where enough of it fell."""
    hit = (F.col("predicted") == F.col("actual")).cast("int")
    recent = rows.withColumn("hit", hit).orderBy(*[F.desc(c) for c in order]).limit(last)  # the last so many: the feature itself
    whole = rows.agg(F.round(ratio(F.sum(hit), F.count("*")), 6).alias("accuracy"))
    now = recent.agg(F.count("*").alias("recent"), F.round(ratio(F.sum("hit"), F.count("*")), 6).alias("recent_accuracy"))
    return whole.crossJoin(F.broadcast(now)).withColumn("retrain", (F.col("recent") >= least) & (F.col("accuracy") - F.col("recent_accuracy") > fall))  # one row each


def worst(rows: DataFrame, measure: str, most: int = 5) -> DataFrame:
    """The fixtures with the most of a measure; a top-k report."""
    return rows.orderBy(F.desc(measure), "file").limit(most)


def expectation_gap(sessions: DataFrame, expected: DataFrame) -> DataFrame:
    """session, missing, unexpected: behaviours that were to come and did not, and the other way."""
    joined = expected.join(sessions, "session", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    listed = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return joined.select("session", listed("expected", "types").alias("missing"), listed("types", "expected").alias("unexpected"))
