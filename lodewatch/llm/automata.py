"""Passages of a reference found in documents: broadcast suffix automata of reference shards and matching statistics.

The reference is dealt into shards of a bounded number of words. A task builds the suffix automaton
of a shard over its words and packs it into sorted arrays. A bounded number of automata is broadcast
at a time; documents stream past them, and at each word the longest run of words that ends there and
stands in the shard is known (the matching statistic). Runs of at least so many words, joined where
they overlap, are the maximal spans. Words are compared as such and not by hashes.

A round passes over all documents and takes some shards, so the work is documents times shards: right
for a reference of bounded size (a benchmark, a list of boilerplate), not for a corpus against itself.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle
from .words import give_back

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words of a shard, and packed bytes of the automata that are broadcast at a time.
SHARD_WORDS, BROADCAST_BYTES = 50_000, 128 << 20


class Automaton:
    """The suffix automaton of some texts' words in sorted arrays; no run of words crosses two texts."""

    def __init__(self, texts: list[str]) -> None:
        known: dict[str, int] = {}
        sequence: list[int] = []
        for i, text in enumerate(texts):
            sequence += [known.setdefault(w, len(known)) for w in WORD.findall(text)]
            sequence.append(-1 - i)  # a mark of its own ends each text
        after, link, length, last = [{}], [-1], [0], 0
        for word in sequence:
            new = len(after)
            after.append({})
            length.append(length[last] + 1)
            link.append(0)
            state = last
            while state >= 0 and word not in after[state]:
                after[state][word] = new
                state = link[state]
            if state >= 0:
                to = after[state][word]
                if length[to] == length[state] + 1:
                    link[new] = to
                else:
                    copy = len(after)
                    after.append(dict(after[to]))
                    length.append(length[state] + 1)
                    link.append(link[to])
                    link[to] = link[new] = copy
                    while state >= 0 and after[state].get(word) == to:
                        after[state][word] = copy
                        state = link[state]
            last = new
        pairs = sorted((s << 32 | w, t) for s, edges in enumerate(after) for w, t in edges.items() if w >= 0)
        self.known = known
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.to = np.array([t for _, t in pairs], np.int32)
        self.link, self.length = np.array(link, np.int32), np.array(length, np.int32)

    def opened(self) -> Automaton:
        """The same with plain lists, for single look-ups."""
        self.keys, self.to, self.link, self.length = (x.tolist() if isinstance(x, np.ndarray) else x for x in (self.keys, self.to, self.link, self.length))
        return self

    def statistics(self, words: list[str]) -> list[int]:
        """For each word, the length of the longest run that ends with it and stands in the reference."""
        keys, to, link, length, known = self.keys, self.to, self.link, self.length, self.known
        out, state, size, n = [], 0, 0, len(keys)
        for w in words:
            word = known.get(w, -1)
            if word < 0:
                state = size = 0
            else:
                while True:
                    key = state << 32 | word
                    at = bisect_left(keys, key)
                    if at < n and keys[at] == key:
                        state, size = to[at], size + 1
                        break
                    if state == 0:
                        size = 0
                        break
                    state = link[state]
                    size = length[state]
            out.append(size)
        return out


def maximal(sizes: list[int], least: int) -> list[tuple[int, int]]:
    """(start, words) of the runs of at least `least` words, joined where they overlap."""
    spans: list[list[int]] = []
    for end, size in enumerate(sizes):
        if size >= least:
            start = end - size + 1
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append([start, end])
    return [(a, b - a + 1) for a, b in spans]


def automata(reference: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard, packed, bytes): a packed automaton of each shard of the texts; a longer text is a shard of its own."""
    rows = reference.where("text is not null").select("text", (F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))) + 1).alias("words"))
    total = rows.agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-total // max(shard_words // 2, 1)))  # shards by hash are about half full

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        packed = pickle.dumps(Automaton(sorted(group["text"])))
        return pd.DataFrame({"shard": [key[0]], "packed": [packed], "bytes": [len(packed)]})

    dealt = rows.select("text", F.pmod(F.xxhash64("text"), F.lit(shards)).alias("shard")).distinct()
    return settle(dealt.groupBy("shard").applyInPandas(build, "shard long, packed binary, bytes long"))


def reference_spans(documents: DataFrame, reference: DataFrame, least: int, shard_words: int = SHARD_WORDS, most: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, start, words): the maximal spans, in words, of each document that stand in the reference.

    Spans of different shards may overlap. A null text has none; rows that repeat a doc_id each give
    theirs. Automata are broadcast in rounds of at most `most` bytes (or one automaton).
    """
    packed = automata(reference, shard_words)
    rounds: list[list[int]] = [[]]
    taken = 0
    for r in packed.select("shard", "bytes").orderBy("shard").toLocalIterator():
        if rounds[-1] and taken + r.bytes > most:
            rounds.append([])
            taken = 0
        rounds[-1].append(r.shard)
        taken += r.bytes
    spark = documents.sparkSession
    own = documents.where("text is not null").select("doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("words", pa.int64())])
    found = None
    for shards in rounds:
        held = spark.sparkContext.broadcast([bytes(r.packed) for r in packed.where(F.col("shard").isin(shards)).toLocalIterator()] if shards else [])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            opened = [pickle.loads(x).opened() for x in held.value]  # noqa: S301  made above
            for batch in batches:
                out: list[tuple] = []
                for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                    words = WORD.findall(text)
                    out += [(doc_id, a, n) for one in opened for a, n in maximal(one.statistics(words), least)]
                ids, starts, sizes = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=schema)
            give_back()

        part = settle(own.mapInArrow(run, "doc_id long, start long, words long"))
        found = part if found is None else found.unionByName(part)
    return found.distinct()
