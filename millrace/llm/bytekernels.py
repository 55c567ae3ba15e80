"""NumPy helpers over the raw UTF-8 bytes of an Arrow string column.

All word and line delimiters used here are ASCII, so working on bytes equals working on code points.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
SLICE_BYTES = 1 << 20
#: Keeps the first 0 to 8 bytes of a little-endian block.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans that are hashed at a time: their blocks take memory.
_SPANS = 1 << 16


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, bytes, offsets)`` for runs of whole rows of about ``limit`` bytes; null is empty."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if chunk.null_count:
            chunk = chunk.fill_null("")
        chunk = chunk.cast(pa.large_string())
        n = len(chunk)
        if not n:
            continue
        offsets = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + n + 1]
        data = np.frombuffer(chunk.buffers()[2], np.uint8) if chunk.buffers()[2] else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            own = offsets[at : to + 1]
            yield at, to, data[own[0] : own[-1]], own - own[0]
            at = to


def _give_back() -> None:
    """Returns freed memory to the system: Arrow's pool and the C library keep it for the next task otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def task(run: Callable) -> Callable:
    """A function over a task's batches that leaves no memory behind. Python workers go on to other tasks and stages, whose
    needs would add up."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            large = batch.nbytes > SLICE_BYTES
            yield batch
            del batch
            if large:
                pa.default_memory_pool().release_unused()

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(tidied(batches))
        _give_back()

    return whole


def texts(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """``(first row, texts)`` for runs of whole texts of about ``limit`` letters."""
    run, size, at = [], 0, 0
    for text in column:
        text = text.as_py()
        run.append(text)
        size += len(text or "") + 64
        if size >= limit:
            yield at, run
            at, run, size = at + len(run), [], 0
    if run:
        yield at, run


def mix_again(h: np.ndarray) -> np.ndarray:
    """As ``mix``, by other numbers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class SpanHash:
    """64-bit hashes of any spans of ``data``: equal bytes, equal hash. Every block of eight bytes is mixed with the number of its
    place in the span before the sum is mixed again; mixing is not linear, so that repeats and swaps in a text do not cancel."""

    def __init__(self, data: np.ndarray):
        self._padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self._blocks = np.ndarray((len(data) + 1,), "<u8", self._padded, strides=(1,))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._hashed(start, end, 1)[0]

    def pairs(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each span."""
        return self._hashed(start, end, 2)

    def _hashed(self, start: np.ndarray, end: np.ndarray, many: int) -> tuple[np.ndarray, ...]:
        out = tuple(np.zeros(len(start), np.uint64) for _ in range(many))
        for at in range(0, len(start), _SPANS):
            s = np.asarray(start[at : at + _SPANS], np.int64)
            n = np.asarray(end[at : at + _SPANS], np.int64) - s
            count = (n + 7) >> 3
            first = np.cumsum(count) - count
            place = np.arange(int(count.sum())) - np.repeat(first, count)
            block = self._blocks[np.repeat(s, count) + 8 * place] & _FIRST[np.minimum(np.repeat(n, count) - 8 * place, 8)]
            place = (place + 1).astype(np.uint64) * _GOLDEN
            some = count > 0
            for k, by in enumerate((mix, mix_again)[:many]):
                sums = np.zeros(len(s), np.uint64)
                if len(block):
                    sums[some] = np.add.reduceat(by(block ^ mix(place + np.uint64(k))), first[some])
                out[k][at : at + _SPANS] = by(sums + n.astype(np.uint64) * _GOLDEN)
        return out


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``is_word`` bytes inside each row, and the index of each row's first word."""
    mask = is_word[data]
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    rows = offsets[:-1][offsets[:-1] < len(data)]
    begin[rows] = mask[rows]
    finish = mask.copy()
    finish[:-1] &= ~mask[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    finish[last] = mask[last]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return start, end, np.searchsorted(start, offsets)


def gram_code(k: int) -> np.uint64:
    """The odd number by which the hash of a run's word ``k`` counts."""
    return mix(np.array([k + 1], np.uint64) * _GOLDEN)[0] | np.uint64(1)


def gram_hash(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words, by the run's first word."""
    count = max(0, len(word_hash) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out += word_hash[k : k + count] * gram_code(k)
    return mix(out)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of each row (split at line feeds; an empty row has one empty line), and each line's row."""
    feed = np.flatnonzero(data == 10)
    n = len(offsets) - 1
    row = np.concatenate([np.arange(n), np.searchsorted(offsets, feed, "right") - 1])
    start = np.concatenate([offsets[:-1], feed + 1])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    last = np.flatnonzero(np.append(row[1:] != row[:-1], True))
    end[last] = offsets[row[last] + 1]
    return start, end, row


def stripped(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without white space at both ends; where nothing is left, start equals end."""
    solid = np.append(np.flatnonzero(~SPACE[data]), len(data))
    first, after = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = first < after
    return np.where(some, solid[first], start), np.where(some, solid[np.maximum(after - 1, 0)] + 1, start)
