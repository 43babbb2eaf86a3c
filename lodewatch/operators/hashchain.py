"""Hash chains over the rows of a key: each link hashes the row and the link before it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

GENESIS = "0" * 64


def _link(index, fields, previous):
    return F.sha2(F.concat_ws("|", index.cast("string"), *[f.cast("string") for f in fields], previous).cast("binary"), 256)


def build(rows: DataFrame, by: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Adds idx, previous_hash and hash along each key.

    A chain is sequential by nature: keys run in parallel, and a key's sorted rows stream through
    one task that keeps only the last index and hash, so a key may have any number of rows.
    """
    columns = [by, *order, *[c for c in rows.columns if c not in (by, *order)]]
    # what a link hashes between its index and the hash before; as in concat_ws, nulls are left out
    body = F.concat_ws("|", *[F.col(f).cast("string") for f in fields], F.lit(""))
    ordered = rows.select(*columns, body.alias("__body")).repartition(by).sortWithinPartitions(*columns)
    schema = StructType([*rows.select(*columns).schema, StructField("idx", IntegerType()), StructField("previous_hash", StringType()), StructField("hash", StringType())])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, idx, last = None, 0, GENESIS
        for batch in batches:
            indexes, before, hashes = [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                if k != key and (k == k or key == key):  # one NaN continues another
                    key, idx, last = k, 0, GENESIS
                indexes.append(idx)
                before.append(last)
                last = hashlib.sha256(f"{idx}|{text}{last}".encode()).hexdigest()
                hashes.append(last)
                idx += 1
            links = [pa.array(indexes, pa.int32()), pa.array(before, pa.string()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *links], names=schema.names)

    return ordered.mapInArrow(linked, schema)


def verify(chain: DataFrame, by: str, fields: Sequence[str]) -> DataFrame:
    """by, idx, fault of links that do not hold: content (own hash) or order (hash of the one before).

    Each link is checked by itself from the stored hashes, so a chain is verified in parallel.
    """
    w = Window.partitionBy(by).orderBy("idx")
    rows = chain.withColumn("before", F.lag("hash", 1, GENESIS).over(w))
    content = F.when(_link(F.col("idx"), [F.col(f) for f in fields], F.col("previous_hash")) != F.col("hash"), "content")
    order = F.when(F.col("before") != F.col("previous_hash"), "order")
    return rows.select(by, "idx", F.explode(F.array_compact(F.array(content, order))).alias("fault"))
