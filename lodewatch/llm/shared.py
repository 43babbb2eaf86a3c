"""What the operators share: written tables that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, then) -> Column:
    """`then` of a value that is computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A digest of a row's id and text; equal only for rows that repeat both."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("null"))).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only on one machine where none is set."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


_written: dict[str, SparkSession] = {}
#: Whether the shuffle files of a query go once it has ended; a written table needs them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Writes the rows as a table in the shared checkpoint folder and reads it from there.

    That cuts the lineage: what comes later survives lost executors without computing this anew,
    reads only the columns it needs, and is planned with the table's true size. The tables are
    scratch: `drop` removes them, or the end of the driver. The shuffles behind them are removed at once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    scratch(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, path: str) -> None:
    """Notes a folder that goes when the driver ends, if not before."""
    if not _written:
        atexit.register(lambda: drop(written()))
    _written[path] = spark


def written() -> list[str]:
    """The scratch folders, in the order in which they were written."""
    return list(_written)


def drop(paths: list[str]) -> None:
    for path in paths:
        spark = _written.pop(path)
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001  the session ended first; the folder is scratch
            continue
