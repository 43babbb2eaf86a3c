"""Written tables that cut lineage, in the folder that the cluster names."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}

#: Bytes in memory for a byte of a written table, roughly: numbers and repeated texts are packed that tightly.
UNPACKED = 64
_FACTOR = "spark.sql.sources.fileCompressionFactor"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only on one machine where none is set."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def sized(spark: SparkSession) -> None:
    """Lets Spark judge files by what they are in memory, so that it broadcasts none whose rows the driver could not hold."""
    if float(spark.conf.get(_FACTOR)) < UNPACKED:
        spark.conf.set(_FACTOR, str(float(UNPACKED)))


def settle(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder and read from there; scratch until dropped or until the driver ends."""
    spark = df.sparkSession
    sized(spark)
    path = f"{checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(lambda: drop(list(_written)))
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def shuffling(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Of a function that works in rounds: while it runs, joins shuffle both sides.

    A table that Spark would broadcast is small, but rounds have dozens of joins, and each would send one through the driver.
    """
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")

    @wraps(build)
    def run(first: DataFrame, *args, **kwargs) -> DataFrame:
        conf = first.sparkSession.conf
        was = {limit: conf.get(limit, None) for limit in limits}
        try:
            for limit in limits:
                conf.set(limit, "-1")
            return build(first, *args, **kwargs)
        finally:
            for limit, value in was.items():
                conf.unset(limit) if value is None else conf.set(limit, value)

    return run


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by their keys in all partitions of the session's shuffles.

    Adaptive execution merges partitions by their packed size, so a task of narrow rows may hold very many of
    them; it leaves these as they are.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def drop(paths: list[str]) -> None:
    for path in paths:
        spark = _written.pop(path)
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001  the session ended first; the folder is scratch
            return


def tidied(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Of a function that works in rounds: its result is written, and what its rounds wrote is deleted."""

    @wraps(build)
    def run(*args, **kwargs) -> DataFrame:
        known = set(_written)
        out = settle(build(*args, **kwargs))
        made = [path for path in _written if path not in known]
        drop(made[:-1])  # the last is the result
        return out

    return run
