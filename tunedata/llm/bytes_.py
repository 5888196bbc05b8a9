"""Vectorised text work inside Arrow batches: words, hashes and slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

# just under a power of two, the size to which tables of powers are rounded up
SLICE_BYTES = (2 << 20) - (64 << 10)
# hashes are summed in steps that stay in cache
STEP = 1 << 16
SPACE = bytes([0x20, *range(0x09, 0x0E)])
_BASE = 0x9E3779B97F4A7C15


def class_table(members: bytes) -> np.ndarray:
    """True at every byte value that is in `members`."""
    found = np.zeros(256, bool)
    found[list(members)] = True
    return found


IS_SPACE = class_table(SPACE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def texts(column: pa.Array) -> list[bytes]:
    """The column's UTF-8 texts; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def parts(*columns: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of groups whose texts or binaries hold `limit` bytes at most; a longer row is alone.

    A batch holds so many rows, whatever their size; what is made from it step by step need not grow with it.
    """
    size = np.ones(len(columns[0]), np.int64)
    for c in columns:
        if any(of(c.type) for of in (pa.types.is_string, pa.types.is_binary, pa.types.is_large_string, pa.types.is_large_binary)):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < ends.size:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + limit, "right")))
        yield at, to - at
        at = to


def cut(text: bytes, limit: int) -> Iterator[bytes]:
    """Pieces of at most `limit` bytes, ending at white space; only a longer word makes a longer piece."""
    at = 0
    while len(text) - at > limit:
        window = np.frombuffer(text, np.uint8, limit, at)
        ends = np.flatnonzero(IS_SPACE[window])
        if ends.size:
            end = at + int(ends[-1]) + 1
        else:
            later = [p for c in SPACE if (p := text.find(c, at + limit)) >= 0]
            end = min(later) + 1 if later else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def line_cut(text: bytes, limit: int) -> Iterator[bytes]:
    """Pieces of whole lines of at most `limit` bytes; only a longer line makes a longer piece."""
    at = 0
    while len(text) - at > limit:
        end = text.rfind(b"\n", at, at + limit) + 1 or text.find(b"\n", at + limit) + 1 or len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def slices(rows: list[bytes], limit: int = SLICE_BYTES, cutter=cut) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of (row numbers, pieces) of about `limit` bytes each; a long text spans several groups."""
    owners, pieces, size = [], [], 0
    for i, text in enumerate(rows):
        for piece in cutter(text, limit) if len(text) > limit else (text,):
            if pieces and size + len(piece) > limit:
                yield owners, pieces
                owners, pieces, size = [], [], 0
            owners.append(i)
            pieces.append(piece)
            size += len(piece) + 1
    if pieces:
        yield owners, pieces


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    for x in both:
        x[0] = 1
        np.cumprod(x, out=x)
    return both


@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _sums(data: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Sum of code times power over the bytes before each place (one more at the end)."""
    sums = np.zeros(data.size + 1, np.uint64)
    for at in range(0, data.size, STEP):
        step = _byte_codes()[data[at : at + STEP]]
        step *= powers[at : at + step.size]
        step[:1] += sums[at]
        np.cumsum(step, out=sums[at + 1 : at + 1 + step.size])
    return sums


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every `width` bytes that follow each other, by the place of the first."""
    up, down = _powers(1 << max(21, int(data.size).bit_length()))
    sums = _sums(data, up)
    return mix((sums[width:] - sums[:-width]) * down[: data.size + 1 - width])


def free() -> None:
    """Give back what this process holds and no longer needs: an idle worker keeps its memory otherwise."""
    _powers.cache_clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def freed(read: Callable) -> Callable:
    """A function over a task's batches that leaves no memory behind when the task ends."""

    @wraps(read)
    def reading(batches):
        try:
            yield from read(batches)
        finally:
            free()

    return reading


def in_parts(step: Callable) -> Callable:
    """A function of columns as one over a task's batches: each is read in `parts`, and no memory is left behind."""

    def read(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            for at, n in parts(*columns):
                yield step(*(c.slice(at, n) for c in columns))

    return freed(read)


def batches_in_parts(batches: Iterator[pa.RecordBatch], sized: str) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in `parts` by column `sized`."""
    for batch in batches:
        for at, n in parts(batch.column(sized)):
            yield batch.slice(at, n)


class Words:
    """The words of some pieces: where each starts and ends, whose it is, and its 64-bit hash."""

    def __init__(self, pieces: list[bytes], breaks: np.ndarray = IS_SPACE, lower: bool = False):
        blob = b"\n".join([*pieces, b""])
        self.blob = LOWER[np.frombuffer(blob, np.uint8)] if lower else np.frombuffer(blob, np.uint8)
        inside = np.zeros(self.blob.size + 1, np.int8)
        inside[1:] = ~breaks[self.blob]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        lengths = np.fromiter((len(p) + 1 for p in pieces), np.int64, len(pieces))
        self.first = np.searchsorted(self.start, np.concatenate([[0], np.cumsum(lengths)]))
        self.count = np.diff(self.first)
        self._sums = None

    def __len__(self) -> int:
        return self.start.size

    def owner(self) -> np.ndarray:
        """Number of the piece each word is in."""
        return np.repeat(np.arange(self.count.size), self.count)

    def hashes(self) -> np.ndarray:
        return self.hashes_of(self.start, self.end)

    def hashes_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of every span of bytes, equal for equal bytes wherever they stand."""
        up, down = _powers(1 << max(21, int(self.blob.size).bit_length()))
        if self._sums is None:
            self._sums = _sums(self.blob, up)
        return mix((self._sums[end] - self._sums[start]) * down[start])

    def distinct(self, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(code of each word, one word number per code)."""
        codes, found = pd.factorize(self.hashes() if hashes is None else hashes)
        example = np.empty(found.size, np.int64)
        example[codes] = np.arange(codes.size)
        return codes, example

    def text(self, which: np.ndarray) -> list[bytes]:
        raw = self.blob.tobytes()
        return [raw[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)]

    def per_piece(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per word over each piece."""
        return np.bincount(self.owner(), values, self.count.size)
