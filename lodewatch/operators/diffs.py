"""Differences between two states of something: full outer and anti joins on a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot(before: DataFrame, after: DataFrame, key: Sequence[str], compare: Sequence[str], slack: dict[str, float] | None = None) -> DataFrame:
    """key, change (created, modified, deleted), fields: rows that differ, and in which columns.

    slack: differences up to this size do not count for the column.
    """
    slack = slack or {}
    b = before.select(*key, F.struct(*compare).alias("__b"))
    a = after.select(*key, F.struct(*compare).alias("__a"))
    joined = b.join(a, list(key), "full_outer")

    def differs(c: str) -> Column:
        left, right = F.col(f"__b.{c}"), F.col(f"__a.{c}")
        return F.abs(left - right) > slack[c] if c in slack else ~left.eqNullSafe(right)

    fields = F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in compare]))
    change = F.when(F.col("__b").isNull(), "created").when(F.col("__a").isNull(), "deleted").when(F.size(fields) > 0, "modified")
    return joined.select(*key, change.alias("change"), F.when(change == "modified", F.array_join(fields, ",")).otherwise("").alias("fields")).where("change is not null")


def capability_drift(before: DataFrame, after: DataFrame, by: Sequence[str], capability: str, count: str) -> DataFrame:
    """by, capability, change, delta over the union of both sides."""
    keys = [*by, capability]
    b, a = before.select(*keys, F.col(count).alias("__b")), after.select(*keys, F.col(count).alias("__a"))
    change = (
        F.when(F.col("__b").isNull(), "NEW").when(F.col("__a").isNull(), "REMOVED").when(F.col("__a") > F.col("__b"), "INCREASED").when(F.col("__a") < F.col("__b"), "DECREASED").otherwise("SAME")
    )
    return b.join(a, keys, "full_outer").select(*keys, change.alias("change"), (F.coalesce("__a", F.lit(0)) - F.coalesce("__b", F.lit(0))).alias("delta"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def path_changes(before: Column, after: Column) -> Column:
    """struct(added, removed, reordered) of two search paths."""
    common = lambda x, y: F.filter(x, lambda p: F.array_contains(y, p))
    return F.struct(F.array_except(after, before).alias("added"), F.array_except(before, after).alias("removed"), (common(before, after) != common(after, before)).alias("reordered"))
