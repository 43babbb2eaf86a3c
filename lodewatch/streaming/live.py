"""Streaming forms of the session operators: event time, watermarks, append output.

Inputs are streams of (session, seq, ts timestamp, kind, host, bytes). Late rows beyond the
watermark are dropped, which bounds the state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.hashchain import GENESIS

DELAY = "10 minutes"


def first_seen(events: DataFrame, keys: list[str], delay: str = DELAY) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def not_in_baseline(events: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Events whose key the static baseline does not have."""
    known = baseline.select(*keys).distinct().withColumn("__known", F.lit(True))
    return events.join(known, keys, "left").where("__known is null").drop("__known")


def mass_reads(events: DataFrame, span: str = "5 seconds", least: int = 50, distinct: int = 20, delay: str = "30 seconds") -> DataFrame:
    """session, window, n, hosts of windows with many reads of many hosts, counted exactly as in a batch."""
    windows = events.withWatermark("ts", delay).groupBy("session", F.window("ts", span)).agg(F.count("*").alias("n"), F.size(F.collect_set("host")).alias("hosts"))
    return windows.where((F.col("n") >= least) & (F.col("hosts") >= distinct))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """session, start, end, n, bytes of runs of events without a longer gap."""
    found = events.withWatermark("ts", delay).groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return found.select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "bytes")


def rate(events: DataFrame, span: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """window, n: events in sliding windows of a second, every half second."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", span, "500 milliseconds")).agg(F.count("*").alias("n")).select("window.start", "n")


def chain(events: DataFrame, delay: str = DELAY, idle_ms: int = 86_400_000) -> DataFrame:
    """session, idx, seq, previous_hash, hash: a hash chain that continues from batch to batch.

    The state of a session is its last index and hash. A batch's rows are linked in order of time
    and seq, batches in order of arrival. A session that is silent for `idle_ms` beyond the watermark
    gives up its state; a chain that begins after that is a new one.
    """

    def link(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["session", "idx", "seq", "previous_hash", "hash"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        idx, last = state.get if state.exists else (0, GENESIS)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        out = []
        for r in rows.itertuples():
            now = hashlib.sha256(f"{idx}|{r.seq}|{r.kind}|{last}".encode()).hexdigest()
            out.append((key[0], idx, r.seq, last, now))
            idx, last = idx + 1, now
        state.update((idx, last))
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + idle_ms)
        yield pd.DataFrame(out, columns=columns)

    return events.withWatermark("ts", delay).groupBy("session").applyInPandasWithState(link, "session long, idx long, seq long, previous_hash string, hash string", "idx long, hash string", "append", GroupStateTimeout.EventTimeTimeout)


def alerts(findings: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str):
    """A started query that hands each batch's warning and critical rows to `send`."""
    loud = findings.where(F.col("severity").isin("warning", "critical", "HIGH", "CRITICAL"))
    return loud.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).start()


def dropped_processes(samples: DataFrame, span: str = "10 seconds", delay: str = DELAY) -> DataFrame:
    """start, n: the number of processes of each sample window; held against the window before by `process_drop` in a batch sink."""
    counts = samples.withWatermark("ts", delay).groupBy(F.window("ts", span)).agg(F.size(F.collect_set("pid")).alias("n"))
    return counts.select("window.start", "n")


def between_polls(polls: DataFrame, delay: str = DELAY, gap: str = "30 seconds") -> DataFrame:
    """key, first, last, n: how long a key is seen in poll after poll; a row comes when it is gone for `gap`."""
    seen = polls.withWatermark("ts", delay).groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return seen.select("key", "first", "last", "n")
