"""Byte-level BPE over Arrow batches with the tokenizers library, and its exact inverse.

A text is cut before each single space that is surely followed by a non-space. The pattern of
byte-level vocabularies never matches across such a place and sees the same on both sides of it,
so the pieces give the ids of the whole text. Equal pieces of a block are encoded once; ids are
gathered for all their places by array operations, byte offsets follow from token lengths and
character offsets from a running count of UTF-8 lead bytes.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table
from .words import Block, blocks, give_back

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Pieces whose ids a worker remembers between blocks.
REMEMBERED = 100_000
#: Pieces that are given to the library at once, and bytes of a block of texts.
TOGETHER, BLOCK = 2048, 1 << 19
#: Ids that are decoded at once.
PART = 1 << 18
#: Bytes after which a space surely ends a run of white space: visible ASCII and the lead bytes
#: of sequences that hold no white space.
SURE = np.zeros(256, bool)
SURE[0x21:0x7F] = True
SURE[0xC3:0xE0] = True
SURE[0xE4:0xF5] = True


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Visible Latin-1 characters stand for themselves; the other bytes, in order, for the
    characters from U+0100 on.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """A vocabulary in a worker: each token's bytes, and for encoding the tokenizer and remembered pieces."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        to_byte = byte_characters()
        tokens = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            tokens[i] = bytes(to_byte[c] for c in token)
        self.path = path
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        self.starts = np.append(0, np.cumsum(self.lengths))[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.remembered: dict[bytes, array] = {}

    @cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True  # their strings are ordinary text
        return found

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block, and each text's offsets in them."""
        data = block.data
        n = len(data)
        if not n:
            return np.empty(0, np.int32), np.zeros(len(block) + 1, np.int64)
        cut = np.zeros(n, bool)
        cut[:-1] = (data[:-1] == 32) & SURE[data[1:]]
        full = block.offsets[1:] > block.offsets[:-1]
        cut[block.offsets[1:][full] - 1] = False  # the next byte is another text's
        cut[block.offsets[:-1][full]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        _, first, which = np.unique(block.range_hashes(starts, ends), return_index=True, return_inverse=True)
        whole = data.tobytes()
        pieces = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        known = self.remembered
        new = [x for x in pieces if x not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = pieces
        for i in range(0, len(new), TOGETHER):  # the library's results are large; few stand at a time
            some = new[i : i + TOGETHER]
            known.update(zip(some, (array("i", x.ids) for x in self.tokenizer.encode_batch_fast([x.decode() for x in some], add_special_tokens=False)), strict=True))
        lists = [known[x] for x in pieces]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.frombuffer(b"".join(lists), np.int32)
        ids, placed = gathered(flat, np.append(0, np.cumsum(sizes))[:-1], sizes, which)
        return ids, placed[np.searchsorted(starts, block.offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all id lists, and each list's offsets in them."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths)):
            raise ValueError("an id is not in the vocabulary")
        data, placed = gathered(self.bytes, self.starts, self.lengths, ids)
        return data, placed[offsets]


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs `which` of flat end to end, and where each begins (and the last ends)."""
    size = sizes[which]
    placed = np.append(0, np.cumsum(size))
    at = np.repeat(starts[which] - placed[:-1], size)
    at += np.arange(placed[-1])
    return flat[at], placed


def character_offsets(block: Block, codec: Codec, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one code point of each token within its text.

    A token that holds part of a character counts as covering all of it.
    """
    ends = np.cumsum(codec.lengths[ids])
    starts = ends - codec.lengths[ids]
    seen = np.cumsum((block.data & 0xC0) != 0x80)
    counts = np.diff(offsets)
    before = np.append(0, seen)[np.repeat(block.offsets[:-1], counts)]
    return seen[starts] - 1 - before, seen[ends - 1] - before


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(df: DataFrame, text: str = "text", path: str = VOCABULARY, ids: str = "ids", offsets: str | None = None, decoded: str | None = None) -> DataFrame:
    """Adds the ids of the text, and if `offsets` is given each token's code points as (start, end), if `decoded` is given the bytes of the ids.

    A null text counts as empty and gives an empty list. Columns of the names to be added are
    replaced; all others are kept. `path` must be readable on the executors.
    """
    kept = [c for c in df.columns if c not in (ids, offsets, decoded)]
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    places = "array<struct<start:int,end:int>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{ids}` array<int>", *([f"`{offsets}` {places}"] if offsets else []), *([f"`{decoded}` binary"] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for block in blocks(batch.column(text), BLOCK):
                found, placed = own.encode(block)
                lists = [pa.ListArray.from_arrays(pa.array(placed, pa.int32()), pa.array(found))]
                if offsets:
                    start, end = character_offsets(block, own, found, placed)
                    pairs = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["start", "end"])
                    lists.append(pa.ListArray.from_arrays(pa.array(placed, pa.int32()), pairs))
                if decoded:
                    lists.append(binary_of(*own.decode(found, placed)))
                same = batch.slice(int(block.rows[0]), len(block))
                yield pa.RecordBatch.from_arrays([*same.columns, *lists], names=[*kept, ids, *([offsets] if offsets else []), *([decoded] if decoded else [])])
        give_back()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", path: str = VOCABULARY, decoded: str = "decoded") -> DataFrame:
    """Adds the bytes of the ids, joined before any is read as text, so characters split over tokens stay whole.

    Null or empty ids give no bytes; an id outside the vocabulary is an error.
    """
    kept = [c for c in df.columns if c != decoded]
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{decoded}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            sizes = np.nan_to_num(batch.column(ids).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            edges = np.append(0, np.cumsum(sizes))
            at = 0
            while at < len(sizes):  # a part of the batch at a time: its longest list, or about PART ids
                stop = max(at + 1, int(np.searchsorted(edges, edges[at] + PART, "right")) - 1)
                part = batch.slice(at, stop - at)
                flat = part.column(ids).flatten().to_numpy(zero_copy_only=False)
                data, placed = own.decode(flat, edges[at : stop + 1] - edges[at])
                yield pa.RecordBatch.from_arrays([*part.columns, binary_of(data, placed)], names=[*kept, decoded])
                at = stop
        give_back()

    return df.mapInArrow(run, schema)


def binary_of(data: np.ndarray, placed: np.ndarray) -> pa.Array:
    """The bytes between each two of the places."""
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(placed) - 1, [None, pa.py_buffer(np.ascontiguousarray(placed)), pa.py_buffer(data)])
    return whole.cast(pa.binary())


def readable(decoded):
    """The text of decoded bytes; bytes that are no UTF-8 become U+FFFD. A Column."""
    return F.make_valid_utf8(F.expr("cast({} as string)".format(decoded)))


def round_trip(df: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) by encoding whole texts and decoding the ids, in one pass."""
    back = encode(df.select("doc_id", "text"), path=path, decoded="decoded").select("doc_id", "ids", "decoded")
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def tokens_of_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document that is left, as ids, with the proof of the round trip.

    Adds ids, n_tokens and round_trip (the decoded bytes are those of the text) to the columns
    of documents. Encoded and decoded in one pass, so that a task needs one Python worker, not two.
    """
    coded = encode(docs, decoded="decoded")
    return coded.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))
