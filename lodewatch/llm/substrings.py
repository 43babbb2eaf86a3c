"""Removal of passages that stand earlier in the corpus, for windows of a fixed length.

Windows and stretches are compared by two independent 64-bit hashes of their words and not read
again, so the result is exact but for collisions of both: about n * n / 7e38 of n distinct windows.

A window of so many words is removed where the same words start earlier: in a document with a
smaller id, or earlier in the same one. The corpus is its own reference, and that reference
grows with the data, so it is not broadcast; equal windows are brought together instead.

Each window has an anchor, the smallest gram hash in it, so equal windows have equal anchors, and
neighbouring windows mostly share one. A run of windows with one anchor is a stretch. Stretches
meet by anchor. All but the first of equal stretches are repeats as a whole; a stretch whose
anchor stands in no other stretch is new as a whole; only what is left, the first of several
unlike stretches around one anchor, is compared window by window. Repeats inside one batch of
rows are settled there, so a passage that a third of all documents share sends one row a batch
to its anchor, and a window function finds the first of equal rows in one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import settle, table
from .words import Block, Words, blocks, give_back, mix, run_sums, signed

WORDS = 20
GRAM = 5


def window_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts (in words of the block) of all windows inside one text, and their two hashes."""
    grams, inside = words.grams(size)
    at = np.flatnonzero(inside)
    return at, grams[at], mix(run_sums(words.second, size))[at] if len(at) else grams[at]


def stretches(words: Words, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Starts, numbers of windows, anchors and two content hashes of the stretches of a block."""
    _, inside = words.grams(size)
    at = np.flatnonzero(inside)
    if not len(at):
        nothing, no_hash = np.empty(0, np.int64), np.empty(0, np.uint64)
        return nothing, nothing, no_hash, no_hash, no_hash
    grams = mix(run_sums(words.hashes, gram))
    span = size - gram + 1
    lowest = np.lib.stride_tricks.sliding_window_view(grams, span)[at]
    place = at + lowest.argmin(axis=1)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(at)))
    starts = at[first]
    power, inverse = word_powers(len(words.hashes) + 1)
    ends = starts + counts + size - 1

    def content(hashes: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * power[:-1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + counts.astype(np.uint64))

    return starts, counts, grams[place[first]], content(words.hashes), content(words.second)


def word_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xA0761D6478BD642F
    built = []
    for step in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, step, np.uint64)
        steps[:1] = 1
        built.append(np.cumprod(steps, dtype=np.uint64))
    return built[0], built[1]


def firsts(ids: np.ndarray, starts: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether each row stands at the first place (id, start) of its keys; a row repeated there does too."""
    order = np.lexsort((starts, ids, *keys[::-1]))
    lead = np.zeros(len(order), bool)
    if not len(order):
        return lead
    lead[0] = True
    for key in keys:
        lead[1:] |= key[order][1:] != key[order][:-1]
    leader = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
    out = np.zeros(len(order), bool)
    out[order] = (ids[order] == ids[leader]) & (starts[order] == starts[leader])
    return out


STRETCH = "anchor long, content long, second long, doc_id long, start int, windows int, repeat boolean"


def stretch_rows(documents: DataFrame, size: int, gram: int) -> DataFrame:
    """A row per stretch; repeat: an equal one stands earlier in the same batch."""
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("second", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("repeat", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            parts: list[list[np.ndarray]] = []
            for block in blocks(batch.column("text")):
                words = block.words(lower=False, twice=True)
                starts, counts, anchors, content, second = stretches(words, size, gram)
                text = np.searchsorted(words.offsets, starts, "right") - 1
                parts.append([anchors, content, second, ids[block.rows[text]], starts - words.offsets[text], counts])
            if not parts:
                continue
            anchors, content, second, owner, starts, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            repeat = ~firsts(owner, starts, anchors, content, second)
            anchors[repeat], content[repeat] = 0, np.flatnonzero(repeat)  # a repeat is settled; small numbers spread it
            yield pa.RecordBatch.from_arrays([pa.array(signed(anchors)), pa.array(signed(content)), pa.array(signed(second)), pa.array(owner), pa.array(starts.astype(np.int32)), pa.array(counts.astype(np.int32)), pa.array(repeat)], schema=schema)
        give_back()

    return documents.mapInArrow(run, STRETCH)


WINDOW_ROW = "window long, second long, doc_id long, start int, repeat boolean"


def window_rows(documents: DataFrame, size: int) -> DataFrame:
    """A row per window of the stretches listed in `open`; repeat: an equal one stands earlier in the same batch."""
    schema = pa.schema([("window", pa.int64()), ("second", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("repeat", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            lists = batch.column("open")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            edges = np.append(0, np.cumsum(sizes))
            flat = lists.flatten()
            begun, many = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            parts: list[list[np.ndarray]] = []
            for block in blocks(batch.column("text")):
                words = block.words(lower=False, twice=True)
                at, hashes, second = window_hashes(words, size)
                lo, hi = edges[block.rows[0]], edges[block.rows[-1] + 1]
                marks = np.zeros(len(words.hashes) + 1, np.int64)
                first = begun[lo:hi] + np.repeat(words.offsets[:-1], sizes[block.rows])
                np.add.at(marks, first, 1)
                np.add.at(marks, first + many[lo:hi], -1)
                wanted = np.cumsum(marks)[at] > 0
                at, hashes, second = at[wanted], hashes[wanted], second[wanted]
                text = np.searchsorted(words.offsets, at, "right") - 1
                parts.append([hashes, second, ids[block.rows[text]], at - words.offsets[text]])
            if not parts:
                continue
            hashes, second, owner, starts = (np.concatenate(x) for x in zip(*parts, strict=True))
            repeat = ~firsts(owner, starts, hashes, second)
            hashes[repeat], second[repeat] = 0, np.flatnonzero(repeat)  # settled; numbers of their own spread them
            yield pa.RecordBatch.from_arrays([pa.array(signed(hashes)), pa.array(signed(second)), pa.array(owner), pa.array(starts.astype(np.int32)), pa.array(repeat)], schema=schema)
        give_back()

    return documents.select("doc_id", "text", "open").mapInArrow(run, WINDOW_ROW)


def repeats(documents: DataFrame, size: int = WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, start, windows): runs of windows that start earlier elsewhere."""
    documents = documents.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    place = F.struct("doc_id", "start")
    earliest = lambda *keys: F.min(place).over(Window.partitionBy(*keys))
    # One shuffle tells first stretches from later ones. Rows found to be repeats have keys of their
    # own, so an equal stretch has one row a batch at most and groups stay small.
    rows = stretch_rows(documents, size, gram).withColumn("again", F.col("repeat") | (place > earliest("anchor", "content", "second")))
    rows = settle(rows.select(F.when(~F.col("again"), F.col("anchor")).alias("anchor"), "doc_id", "start", "windows", "again"))
    first = rows.where("not again")
    later = rows.where("again").select("doc_id", "start", "windows")
    crowded = first.groupBy("anchor").agg(F.count("*").alias("unlike")).where("unlike > 1").select("anchor")
    unsure = first.join(crowded, "anchor").select("doc_id", F.struct("start", "windows").alias("stretch")).groupBy("doc_id").agg(F.collect_list("stretch").alias("open"))
    rows = window_rows(documents.join(unsure, "doc_id"), size)
    windows = rows.withColumn("again", F.col("repeat") | (place > earliest("window", "second"))).where("again")
    return later.unionByName(windows.select("doc_id", "start", F.lit(1).alias("windows")))


def deduplicated(documents: DataFrame, size: int = WORDS, gram: int = GRAM) -> DataFrame:
    """Adds n_words, n_removed and kept_text (the kept words, joined by one space) to the documents.

    A null text has no words. Texts with fewer words than a window keep all. A row repeated with
    its doc_id counts as one document with it: equal rows all lose what their doc_id loses, and
    where such rows differ, the earlier start of a window decides between them. A null doc_id
    takes no part and keeps all. Columns of the added names are replaced, all others are kept.
    """
    kept = [c for c in documents.columns if c not in ("n_words", "n_removed", "kept_text")]
    found = repeats(documents, size, gram).groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("__runs")).withColumnRenamed("doc_id", "__id")
    found = settle(found)  # a small table; what was shuffled to find it is gone before the texts are
    rows = documents.select(*[F.col(f"`{c}`") for c in kept]).join(found, F.col("doc_id").cast("long") == F.col("__id"), "left").drop("__id")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name in kept), "n_words long, n_removed long, kept_text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("__runs")
            sizes = np.nan_to_num(runs.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            edges = np.append(0, np.cumsum(sizes))
            flat = runs.flatten()
            begun, many = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for block in blocks(batch.column("text")):
                words = block.words(lower=False)
                lo, hi = edges[block.rows[0]], edges[block.rows[-1] + 1]
                n = len(words.hashes)
                first = begun[lo:hi] + np.repeat(words.offsets[:-1], sizes[block.rows])
                marks = np.zeros(n + 1, np.int64)
                np.add.at(marks, np.minimum(first, n), 1)
                np.add.at(marks, np.minimum(first + many[lo:hi] + size - 1, n), -1)
                removed = np.cumsum(marks)[:n] > 0
                same = batch.slice(int(block.rows[0]), len(block)).select(kept)
                gone = np.diff(np.append(0, np.cumsum(removed))[words.offsets])
                yield pa.RecordBatch.from_arrays(
                    [*same.columns, pa.array(words.counts().astype(np.int64)), pa.array(gone.astype(np.int64)), joined_words(block, words, ~removed)], names=[*kept, "n_words", "n_removed", "kept_text"]
                )
        give_back()

    return rows.mapInArrow(run, schema)


def joined_words(block: Block, words: Words, keep: np.ndarray) -> pa.Array:
    """For each text the words to keep, joined by one space."""
    data = np.append(block.data, np.uint8(32))
    starts, sizes = words.starts[keep], words.ends[keep] - words.starts[keep] + 1
    placed = np.append(0, np.cumsum(sizes))
    at = np.repeat(starts - placed[:-1], sizes) + np.arange(placed[-1])
    out = data[at]
    out[placed[1:] - 1] = 32
    per_text = np.append(0, np.cumsum(keep))[words.offsets]
    edges = placed[per_text]
    # the space after the last word of a text does not belong to it
    drop = edges[1:][np.diff(per_text) > 0] - 1
    mask = np.ones(len(out), bool)
    mask[drop] = False
    offsets = edges - np.append(0, np.cumsum(np.diff(per_text) > 0))
    return pa.LargeStringArray.from_buffers(len(block), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(out[mask]))).cast(pa.string())


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
