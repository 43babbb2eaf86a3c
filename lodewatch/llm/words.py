"""Vectorised words, hashes and grams of a block of texts.

A block is the UTF-8 bytes of some whole texts, end to end. Words are runs of bytes other
than space and U+0009 to U+000D; those bytes never occur inside a longer UTF-8 sequence, so
bytes and code points give the same words. A null text has no bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts go through numpy in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240607)
BYTE_CODES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: For a second hash that is independent of the first.
SECOND_CODES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
GRAM_STEP = np.uint64(0xD1342543DE82EF95)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse; tables longer than a block's are not kept."""
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, BLOCK_BYTES + 1)
        inverse = np.uint64(pow(int(STEP), -1, 1 << 64))
        built = []
        for base in (STEP, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            built.append(np.cumprod(steps, dtype=np.uint64))
        if size > BLOCK_BYTES + 1:
            return built[0], built[1]
        _powers[:] = built
    return _powers[0], _powers[1]


@dataclass
class Block:
    """rows: places of the texts in the batch; offsets: their byte offsets in data."""

    rows: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.rows)

    def range_hashes(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray | None = None, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
        """A hash of each byte range, equal for equal bytes wherever they stand; ranges are in order, apart.

        They are taken in segments of a block's usual size, so a text of any length needs eight
        bytes a byte only for one segment (or for its longest single range).
        """
        data = self.data if data is None else data
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            stop = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, "right")))
            base = starts[at]
            part = data[base : ends[stop - 1]]
            power, inverse = _powers_to(len(part))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(codes[part] * power[: len(part)], out=sums[1:])
            a, b = starts[at:stop] - base, ends[at:stop] - base
            out[at:stop] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
            at = stop
        return out

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of runs of true bytes, none of them across two texts."""
        n = len(inside)
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
            after[-1] = False
            after[:-1] = inside[1:]
            full = self.offsets[1:] > self.offsets[:-1]
            before[self.offsets[:-1][full]] = False
            after[self.offsets[1:][full] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def words(self, lower: bool, twice: bool = False) -> Words:
        """twice: with a second, independent hash of each word."""
        data = LOWER[self.data] if lower else self.data
        starts, ends = self.runs(~SPACE[data])
        second = self.range_hashes(starts, ends, data, SECOND_CODES) if twice else None
        return Words(self, starts, ends, self.range_hashes(starts, ends, data), np.searchsorted(starts, self.offsets), second)


@dataclass
class Words:
    """offsets: of each text's words in the arrays."""

    block: Block
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray
    second: np.ndarray | None = None

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of so many words, and whether each stays inside one text."""
        n = len(self.hashes)
        if n < size:
            return np.empty(0, np.uint64), np.empty(0, bool)
        sums = run_sums(self.hashes, size)
        owner = np.repeat(np.arange(len(self.block)), self.counts())
        return mix(sums), owner[: n - size + 1] == owner[size - 1 :]


def run_sums(hashes: np.ndarray, size: int) -> np.ndarray:
    """Polynomial sums over runs of so many hashes, by doubling."""
    total, done, width, part, step = None, 0, 1, hashes, int(GRAM_STEP)
    n = len(hashes) - size + 1
    while True:
        scale = np.uint64(step)
        if size & width:
            piece = part[done : done + n]
            total = piece.copy() if total is None else total * scale + piece
            done += width
        if done == size:
            return total
        part = part[:-width] * scale + part[width:]
        step = step * step % (1 << 64)
        width *= 2


def blocks(texts: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole texts, in order; every text is in one of them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        stop = min(stop, n)
        yield Block(np.arange(at, stop), whole[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
        at = stop


def signed(hashes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(hashes).view(np.int64)


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: workers are reused and would keep their peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to return
        return
