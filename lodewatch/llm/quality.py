"""Quality rules whose limits follow the data: quantile sketches for each language and source.

Every text gives a few measures in one vectorised pass. A sketch of each measure is built for
each (lang, source): counts of logarithmic buckets, so a quantile is right to about one per cent
of its value, sketches merge by adding counts, and the same rows give the same limits in any order
and on any run. Sketches merge into those of a language and of everything, which stand in for
groups with too few rows. A limit is the upper quartile plus a multiple of the spread between
quartiles plus a slack, so it moves with each source, and the measures are then joined with the
limits and filtered. A sketch has some hundred buckets and is added up before the shuffle: a source
that holds a third of all rows is summed up where its rows are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import settle, table
from .words import SPACE, Block, Words, blocks, give_back

WINDOW = 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

#: measure: slack added to its limit, so that a source without spread keeps harmless texts.
MEASURES = {"symbol_share": 0.02, "dup_line_share": 0.1, "repeat_share": 0.05, "capital_share": 0.2, "mean_word": 3.0}
SPREADS = 3.0
#: Groups with fewer rows take the limits of their language, then of everything.
LEAST_ROWS = 100

#: Buckets grow by RATIO from UNIT on; below UNIT they are about as wide as UNIT * (RATIO - 1).
UNIT, RATIO = 1e-3, 1.02
#: Groups of (lang, source) whose limits are broadcast at most; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_capitals"]


def repeated_words(words: Words, size: int = WINDOW) -> np.ndarray:
    """For each text, the words that lie in a window which the text holds twice or more."""
    grams, inside = words.grams(size)
    n = len(words.hashes)
    covered = np.zeros(n, bool)
    at = np.flatnonzero(inside)
    if len(at):
        owner = np.repeat(np.arange(len(words.block)), words.counts())[at]
        order = np.lexsort((grams[at], owner))
        same = (grams[at][order][1:] == grams[at][order][:-1]) & (owner[order][1:] == owner[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, at[twice], 1)
        np.add.at(marks, at[twice] + size, -1)
        covered = np.cumsum(marks)[:n] > 0
    return np.diff(np.append(0, np.cumsum(covered))[words.offsets])


def repeated_lines(block: Block, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each text: lines with a word that equal an earlier line, and lines with a word."""
    starts, ends = block.runs(block.data != 10)
    first, last = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    some = last > first
    starts, ends = starts[some], ends[some]
    owner = np.searchsorted(block.offsets, starts, "right") - 1
    hashes = block.range_hashes(starts, ends)
    order = np.lexsort((starts, hashes, owner))
    again = np.zeros(len(starts), bool)
    again[order[1:]] = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    n = len(block)
    return np.bincount(owner[again], minlength=n), np.bincount(owner, minlength=n)


def per_text(block: Block, marks: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(marks))[block.offsets])


def measured(block: Block) -> list[np.ndarray]:
    """COLUMNS and EXTRA of each text."""
    words = block.words(lower=False)
    data = block.data
    lines, of = repeated_lines(block, words)
    return [
        words.counts(),
        per_text(block, ~SPACE[data] & ((data & 0xC0) != 0x80)),
        per_text(block, SYMBOLS[data]),
        lines,
        repeated_words(words),
        of,
        per_text(block, (data >= 65) & (data <= 90)),
    ]


def measures(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts of each whole text and the shares that rules look at."""
    names = [*COLUMNS, *EXTRA]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                same = batch.slice(int(block.rows[0]), len(block)).select(["doc_id", "lang", "source"])
                yield pa.RecordBatch.from_arrays([*same.columns, *(pa.array(x.astype(np.int64)) for x in measured(block))], names=["doc_id", "lang", "source", *names])
        give_back()

    rows = documents.select(F.col("doc_id").cast("long"), "text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    counted = rows.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{x} long" for x in names))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return counted.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "capital_share": share("n_capitals", "word_chars"),
            "mean_word": share("word_chars", "n_words"),
        }
    )


def bucket(value: Column) -> Column:
    return F.floor(F.log1p(value / UNIT) / math.log(RATIO)).cast("int")


def bucket_value(number: Column) -> Column:
    """The middle of a bucket; that of the lowest is 0."""
    return F.when(number <= 0, 0.0).otherwise(F.expm1((number + 0.5) * math.log(RATIO)) * UNIT)


def sketches(rows: DataFrame, measures_: list[str]) -> DataFrame:
    """(lang, source, measure, bucket, n): one row a bucket that occurs."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in measures_])
    return rows.select("lang", "source", F.explode(each).alias("m")).groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def bounds(sketch: DataFrame, keys: list[str], prefix: str, slack: dict[str, float], spreads: float) -> DataFrame:
    """A row a group of keys: <prefix>_n and the limit <prefix>_<measure> of each measure."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    of = Window.partitionBy(*keys, "measure")  # the buckets of one sketch
    placed = merged.withColumns({"up_to": F.sum("n").over(of.orderBy("bucket")), "all": F.sum("n").over(of)})
    quartile = lambda q: bucket_value(F.min(F.when(4 * F.col("up_to") >= q * F.col("all"), F.col("bucket"))))
    by_measure = placed.groupBy(*keys, "measure").agg(quartile(1).alias("low"), quartile(3).alias("high"), F.max("all").alias("n"))
    limit = lambda m: F.max(F.when(F.col("measure") == m, F.col("high") + spreads * (F.col("high") - F.col("low")) + slack[m]))
    return by_measure.groupBy(*keys).agg(F.max("n").alias(f"{prefix}_n"), *[limit(m).alias(f"{prefix}_{m}") for m in slack])


def limits(rows: DataFrame, slack: dict[str, float] = MEASURES, spreads: float = SPREADS, least: int = LEAST_ROWS) -> DataFrame:
    """(lang, source, max_<measure>...): one row per pair, from its own, its language's or all sketches."""
    sketch = settle(sketches(rows, list(slack)))
    own, by_lang, overall = (bounds(sketch, keys, prefix, slack, spreads) for keys, prefix in ((["lang", "source"], "own"), (["lang"], "lang"), ([], "all")))
    joined = own.join(by_lang, "lang").crossJoin(F.broadcast(overall))  # one row
    return joined.select(
        "lang",
        "source",
        *[F.when(F.col("own_n") >= least, F.col(f"own_{m}")).when(F.col("lang_n") >= least, F.col(f"lang_{m}")).otherwise(F.col(f"all_{m}")).alias(f"max_{m}") for m in slack],
    )


def judged(documents: DataFrame, slack: dict[str, float] = MEASURES, spreads: float = SPREADS, least: int = LEAST_ROWS) -> DataFrame:
    """One row per document: its counts, base_failed, kept, and over (the measures beyond their limit).

    A null, empty or wordless text has counts of 0 and fails the base rule. Null languages and
    sources form groups of their own. Repeated rows are judged each; extra columns are ignored.
    The verdict is the same on every run and for any order or partitioning of the rows.
    """
    rows = settle(measures(documents))
    over = F.filter(F.array(*[F.when(F.col(m) > F.col(f"max_{m}"), F.lit(m)) for m in slack]), lambda x: x.isNotNull())
    found_limits = settle(limits(rows, slack, spreads, least))
    found = rows.join(F.broadcast(found_limits) if found_limits.count() <= BROADCAST_GROUPS else found_limits, ["lang", "source"])
    found = found.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")).withColumn("over", over)
    return found.select("doc_id", *COLUMNS, "base_failed", (~F.col("base_failed") & (F.size("over") == 0)).alias("kept"), "over")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
