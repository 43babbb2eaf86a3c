"""How five filters act together: who removes what in each of the 120 orders, and Shapley counts.

A document fails each filter or not, whatever the order: five bits. Documents are counted by part
and bits where they are, so a part of any size comes down to at most 32 cells with their labels.
All orders follow from the cells. They are visited by adjacent transpositions, each order one swap
away from the one before: a swap changes only the two steps it touches, which are counted anew from
the cells, and each removal is added to its filter's Shapley count along the walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle, table
from .words import Block, Words, blocks, give_back

FILTERS = "ABCDE"
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
MARKS = np.zeros(256, bool)
MARKS[[ord(c) for c in "#$%&*|"]] = True
MASKS = 1 << len(FILTERS)
#: What a cell counts: documents, those of labelled quality, those labelled toxic.
COUNTS = ["docs", "good", "toxic"]
STEP = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def distinct_words(words: Words) -> np.ndarray:
    owner = np.repeat(np.arange(len(words.block)), words.counts())
    order = np.lexsort((words.hashes, owner))
    first = np.ones(len(order), bool)
    first[1:] = (words.hashes[order][1:] != words.hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    return np.bincount(owner[order][first], minlength=len(words.block))


def per_text(block: Block, marks: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(marks))[block.offsets])


def failed(block: Block) -> np.ndarray:
    """Bits 0 to 3 of each text: it fails A, B, C, D."""
    words = block.words(lower=False)
    n, data = words.counts(), block.data
    capitals, chars = per_text(block, (data >= 65) & (data <= 90)), per_text(block, (data & 0xC0) != 0x80)
    fails = [n < FEWEST_WORDS, 100 * distinct_words(words) < DISTINCT_PERCENT * n, 100 * capitals > CAPITAL_PERCENT * chars, per_text(block, MARKS[data]) > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) a row: mask has the filters that look at a text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                same = batch.slice(int(block.rows[0]), len(block)).select(["doc_id", "part", "digest"])
                yield pa.RecordBatch.from_arrays([*same.columns, pa.array(failed(block).astype(np.int32))], names=["doc_id", "part", "digest", "mask"])
        give_back()

    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def masks(documents: DataFrame) -> DataFrame:
    """(doc_id, part, mask) a row, with bit 4 for texts that a smaller doc_id has, too.

    Only digests that stand twice meet the rows again; texts are equal if their SHA-256 is.
    """
    rows = settle(measured(documents))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(firsts, "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(later, 1 << 4).otherwise(0)).alias("mask"))


def cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, counts): 3 counts for each of the 32 masks, docs, good and toxic one after the other."""
    by_id = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(c) for c in ("quality", "toxic")])
    counted = masks(documents).join(by_id, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("docs"), F.sum(F.coalesce("quality", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.array(*COUNTS))))  # at most 32 a part
    none = F.array(*[F.lit(0).cast("long") for _ in COUNTS])
    listed = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: F.coalesce(F.col("cells")[m], none)))
    return counted.groupBy("part").agg(by_mask.alias("cells")).select("part", listed.alias("counts"))


def swaps(n: int) -> Iterator[int]:
    """Places k to swap with k + 1, such that all n! orders are visited once: the largest mobile element moves."""
    order, left = list(range(n)), [True] * n
    while True:
        mobile = -1
        for k, x in enumerate(order):
            near = k - 1 if left[x] else k + 1
            if 0 <= near < n and order[near] < x and x > mobile:
                mobile = x
        if mobile < 0:
            return
        k = order.index(mobile)
        near = k - 1 if left[mobile] else k + 1
        order[k], order[near] = order[near], order[k]
        for x in range(mobile + 1, n):
            left[x] = not left[x]
        yield min(k, near)


def walk(counts: np.ndarray, n: int = len(FILTERS)) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """Orders in the order of the walk; steps[order, place, part, STEP]; shapley[filter, part].

    counts: [part, mask, COUNTS].
    """
    mask = np.arange(1 << n)
    total = counts[:, :, 0].sum(axis=1)

    def at(order: list[int], k: int) -> np.ndarray:
        """[part, STEP] of the filter at place k."""
        own, before = 1 << order[k], sum(1 << f for f in order[:k])
        fails, passed = (mask & own) > 0, (mask & before) == 0
        lost = counts[:, fails & passed].sum(axis=1)
        redundant = counts[:, fails & ~passed, 0].sum(axis=1)
        kept = counts[:, (mask & (before | own)) == 0, 0].sum(axis=1)
        return np.stack([kept, lost[:, 0], redundant, counts[:, own, 0], lost[:, 1], lost[:, 2]], axis=1)

    order = list(range(n))
    now = np.stack([at(order, k) for k in range(n)])
    orders, steps, shapley = [order.copy()], [now.copy()], now[:, :, 1].copy()
    assert (now[-1, :, 0] + now[:, :, 1].sum(axis=0) == total).all()
    for k in swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        now[k], now[k + 1] = at(order, k), at(order, k + 1)
        orders.append(order.copy())
        steps.append(now.copy())
        shapley[order] += now[:, :, 1]
    return orders, np.stack(steps), shapley


def audited(counted: DataFrame) -> DataFrame:
    """All orders and steps of the parts of `cells`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                orders, steps, shapley = walk(np.array(some.column("counts").to_pylist(), np.int64).reshape(len(some), MASKS, len(COUNTS)))
                o, n, p, _ = steps.shape
                names = np.array(["".join(FILTERS[f] for f in order) for order in orders])
                flat = steps.reshape(-1, len(STEP))
                columns = [
                    pa.array(np.array(some.column("part").to_pylist(), object)[np.tile(np.arange(p), o * n)], pa.string()),
                    pa.array(np.repeat(names, n * p)),
                    pa.array(np.tile(np.repeat(np.arange(1, n + 1, dtype=np.int32), p), o)),
                    *[pa.array(np.ascontiguousarray(flat[:, k])) for k in range(len(STEP))],
                    pa.array(shapley[np.array(orders)].reshape(-1)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *STEP, "shapley"])

    return counted.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in [*STEP, "shapley"]))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a part, order and step, zeros included.

    A null text is empty: it fails A and, if a smaller doc_id's text is empty or null, E. A null
    source is the part ''. A row without doc_id fails E for any row with one and has no label;
    repeated rows of one doc_id do not fail E for each other and count each. A document with several
    labels counts as good or toxic if one of them says so. Other columns are ignored, and an empty
    table has no parts.
    """
    return audited(cells(documents, labels))


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """See audit for nulls, repeated rows and empty tables."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The same counts in DuckDB's SQL, every order from the documents' own bits.
SQL = f"""
WITH filters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first FROM texts GROUP BY text
), masked AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < {FEWEST_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
  FROM texts JOIN firsts USING (text)
), marked AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS docs, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM masked LEFT JOIN marked USING (doc_id) GROUP BY part, mask
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM filters a, filters b, filters c, filters d, filters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, k::INT AS step, f, bit, coalesce((SELECT sum(p.bit) FROM filters p WHERE contains(substr(filter_order, 1, k - 1), p.f)), 0)::INT AS before
  FROM orders, range(1, 6) t(k) JOIN filters ON true WHERE f = substr(filter_order, k, 1)
), parts AS (
  SELECT DISTINCT part FROM cells
), counted AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN mask & (before | bit) = 0 THEN docs ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN docs ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN docs ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN docs ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM steps, cells GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""
