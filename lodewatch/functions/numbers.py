"""Rounding and bounds as the scores use them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 0) -> Column:
    """floor(x * 10**places + 0.5) / 10**places: halves go up, also below zero."""
    scale = 10.0**places
    return F.floor(x * scale + 0.5) / scale


def bounded(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.when(F.coalesce(b, F.lit(0)) == 0, F.lit(0.0)).otherwise(a / b)
