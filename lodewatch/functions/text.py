"""Text functions; all but entropy stay inside the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def bits(text: bytes | None) -> float | None:
    """Shannon entropy of the characters of a UTF-8 text: one pass of counts over the whole text."""
    if text is None:
        return None
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    counts = np.bincount(points)
    p = counts[counts > 0] / max(points.size, 1)
    return float(-(p * np.log2(p)).sum()) + 0.0


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; no row is exploded or shuffled."""

    @F.pandas_udf("double")
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series([bits(t) for t in texts], dtype="Float64")

    return whole(text.cast("binary"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def short_hash(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)
