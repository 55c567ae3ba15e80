"""Byte functions over whole Arrow buffers.

A column of payloads reaches Python as one buffer of bytes and one of offsets. The functions here work on all rows of a batch at
once with NumPy; ``column`` makes a Spark column function of them. Rows are independent, and nothing is shuffled.

A decoder gives each row a code beside its bytes: the place of its error in ``ERRORS``, 0 where there is none.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ERRORS = (None, "Corrupt", "UnexpectedEnd", "OutputLimitExceeded")
CORRUPT, UNEXPECTED_END, OVER_LIMIT = 1, 2, 3
#: Payload that is worked on at a time, in whole rows: helper arrays take many times its bytes.
_AT_ONCE = 2 << 20
_EMPTY = np.zeros(0, np.uint8)
_MARK = 0x90
#: Bytes of Huffman code that are followed at a time, and those before them that are read to fall into step.
_PIECE, _BEFORE = 256, 32


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[k], starts[k] + 1, ...``, ``counts[k]`` numbers for each k."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of ``values`` over each row."""
    sums = _ends(values)
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal bytes, none beyond its row."""
    new = np.ones(len(data), bool)
    new[1:] = data[1:] != data[:-1]
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(data)))


def _cut(start: np.ndarray, length: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs in pieces of ``most`` bytes, the last one holding the rest."""
    pieces = -(-length // most)
    nth = _spread(np.zeros(len(start), np.int64), pieces)
    return np.repeat(start, pieces) + most * nth, np.minimum(np.repeat(length, pieces) - most * nth, most)


def rle(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, length = _cut(*_runs(data, offsets), 255)
    out = np.empty(2 * len(start), np.uint8)
    out[::2], out[1::2] = length, data[start]
    return out, 2 * np.searchsorted(start, offsets)


def unrle(data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size, rows = np.diff(offsets), len(offsets) - 1
    at = _spread(offsets[:-1], size // 2 * 2)[::2]
    count, owner = data[at].astype(np.int64), np.repeat(np.arange(rows), size // 2)
    total = np.bincount(owner, count, rows).astype(np.int64)
    error = np.where(np.bincount(owner[count == 0], minlength=rows) > 0, CORRUPT, np.where(size % 2 == 1, UNEXPECTED_END, 0))
    error[total > most] = OVER_LIMIT
    count[error[owner] > 0] = 0
    return np.repeat(data[at + 1], count), _ends(np.where(error > 0, 0, total)), error


def rle90(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, length = _cut(*_runs(data, offsets), 255)
    byte = data[start]
    literal = np.where(byte == _MARK, 2, 1)
    run = length >= 3
    size = np.where(run, literal + 2, literal * length)
    ends = _ends(size)
    at, out = ends[:-1], np.zeros(int(ends[-1]), np.uint8)  # the zero after a literal 0x90 stands there already
    out[at] = byte
    out[at[run] + literal[run]] = _MARK
    out[at[run] + literal[run] + 1] = length[run]
    two = length == 2
    out[at[two] + literal[two]] = byte[two]
    return out, ends[np.searchsorted(start, offsets)]


def unrle90(data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = len(offsets) - 1
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    # Among marks side by side every second one is what the mark before it counts.
    start, length = _runs(data, offsets)
    marks = data[start] == _MARK
    mark = np.zeros(len(data), bool)
    mark[_spread(start[marks], length[marks])[_spread(np.zeros(marks.sum(), np.int64), length[marks]) % 2 == 0]] = True
    error = np.zeros(rows, np.int64)
    at = np.flatnonzero(mark)
    cut = at + 1 == offsets[owner[at] + 1]
    error[owner[at[cut]]] = UNEXPECTED_END
    at = at[~cut]
    number = data[at + 1].astype(np.int64)
    kind = np.ones(len(data), np.int8)  # 1 a literal, 0 neither, 2 a repeat
    kind[mark] = 0
    kind[at + 1] = 0
    kind[at[number == 0]] = 1
    kind[at[number > 0]] = 2
    first = offsets[:-1][np.diff(offsets) > 0]
    error[owner[first[kind[first] == 2]]] = CORRUPT
    weight = (kind == 1).astype(np.int64)
    weight[at[number > 0]] = number[number > 0] - 1
    total = _per_row(weight, offsets)
    error[total > most] = OVER_LIMIT
    weight[error[owner] > 0] = 0
    last = np.maximum.accumulate(np.where(kind == 1, np.arange(len(data)), 0)) if len(data) else np.zeros(0, np.int64)
    return np.repeat(data[last], weight), _ends(np.where(error > 0, 0, total)), error


def packbits(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, length = _runs(data, offsets)
    cut, n = _cut(start, length, 128)
    run = n >= 3
    # What no run of three or more takes is literal, up to the next run or the row's end.
    literal = np.ones(len(data), bool)
    literal[_spread(cut[run], n[run])] = False
    at = np.flatnonzero(literal)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    new[np.searchsorted(at, offsets[:-1])[np.isin(offsets[:-1], at)]] = True
    plain = at[new]
    plain, m = _cut(plain, np.diff(np.append(np.flatnonzero(new), len(at))), 128)
    start, n, run = np.concatenate([cut[run], plain]), np.concatenate([n[run], m]), np.repeat([True, False], [run.sum(), len(plain)])
    order = np.argsort(start, kind="stable")
    start, n, run = start[order], n[order], run[order]
    ends = _ends(np.where(run, 2, n + 1))
    out = np.empty(int(ends[-1]), np.uint8)
    out[ends[:-1]] = np.where(run, 257 - n, n - 1)
    out[ends[:-1][run] + 1] = data[start[run]]
    out[_spread(ends[:-1][~run] + 1, n[~run])] = data[_spread(start[~run], n[~run])]
    return out, ends[np.searchsorted(start, offsets)]


def unpackbits(data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The controls of all rows are read side by side, one of each row at a time."""
    rows = len(offsets) - 1
    error, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    at, row = offsets[:-1].copy(), np.arange(rows)
    pieces: list[tuple[np.ndarray, ...]] = []
    while True:
        more = at < offsets[row + 1]
        at, row = at[more], row[more]
        if not len(at):
            break
        control = data[at].astype(np.int64)
        take = np.where(control < 128, control + 1, np.where(control == 128, 0, 1))
        short = at + 1 + take > offsets[row + 1]
        error[row[short]] = UNEXPECTED_END
        at, row, control, take = at[~short], row[~short], control[~short], take[~short]
        gives = np.where(control < 128, take, np.where(control == 128, 0, 257 - control))
        total[row] += gives
        over = total[row] > most
        error[row[over]] = OVER_LIMIT
        pieces.append((at[~over] + 1, gives[~over], control[~over] > 128))
        at, row = (at + 1 + take)[~over], row[~over]
    if not pieces:
        return _EMPTY, _ends(np.zeros(rows)), error
    start, gives, run = (np.concatenate(x) for x in zip(*pieces, strict=True))
    order = np.argsort(start, kind="stable")
    start, gives, run = start[order], gives[order], run[order]
    good = error[np.searchsorted(offsets, start, "right") - 1] == 0
    start, gives, run = start[good], gives[good], run[good]
    source = _spread(np.zeros(len(start), np.int64), gives)
    return data[np.repeat(start, gives) + np.where(np.repeat(run, gives), 0, source)], _ends(np.where(error > 0, 0, total)), error


def delta(data: np.ndarray, offsets: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    out = data.copy()
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    later = np.flatnonzero(place >= distance)
    out[later] -= data[later - distance]
    return out, offsets


def undelta(data: np.ndarray, offsets: np.ndarray, most: int, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running sums over the bytes that lie ``distance`` apart: the step doubles until it is longer than every row."""
    size = np.diff(offsets)
    error = np.where(size > most, OVER_LIMIT, 0)
    if distance == 1:
        sums = np.concatenate([np.zeros(1, np.uint8), np.cumsum(data, dtype=np.uint8)])
        out = sums[1:] - np.repeat(sums[offsets[:-1]], size)
    else:
        out, step = data.copy(), distance
        place = np.arange(len(data)) - np.repeat(offsets[:-1], size)
        while step < size.max(initial=0):
            later = np.flatnonzero(place >= step)
            out[later] = out[later] + out[later - step]
            step *= 2
    keep = np.repeat(error == 0, size)
    return out[keep], _ends(np.where(error > 0, 0, size)), error


class HuffmanCode:
    """A canonical prefix code from the code length of each byte, with an end mark after the last code."""

    def __init__(self, lengths: list[int]):
        self.lengths = np.array(lengths, np.int64)
        self.symbols = np.lexsort((np.arange(len(lengths)), self.lengths))
        self.codes, code, width, firsts = np.zeros(len(lengths), np.int64), 0, 0, []
        for s in self.symbols.tolist():
            code <<= lengths[s] - width
            width = lengths[s]
            self.codes[s] = code
            firsts.append(code << (32 - width))
            code += 1
        self._tables(width, code)

    def _tables(self, width: int, code: int) -> None:
        """What each byte does in each state, a state being a node inside the code's tree: the next state, and the symbols that
        end in the byte. The state after the last is the one behind the end mark, which nothing leaves."""
        ends = [(int(self.codes[s]), int(self.lengths[s]), int(s)) for s in self.symbols] + [(code, width, len(self.symbols))]
        step, self.filling = [[0, 0]], [0]
        for bits, size, symbol in ends:
            at = 0
            for k in range(size - 1, 0, -1):
                bit = bits >> k & 1
                if not step[at][bit]:
                    step.append([0, 0])
                    step[at][bit] = len(step) - 1
                at = step[at][bit]
            step[at][bits & 1] = ~symbol
        to, states = np.array(step), len(step)
        at = 0
        for _ in range(7):
            at = max(step[at][1], 0)
            self.filling += [at] if at else []
        state, byte = np.repeat(np.arange(states + 1), 256), np.tile(np.arange(256), states + 1)
        self.given = np.zeros(len(state), np.int64)
        self.gives = np.zeros((len(state), 8), np.uint8)
        for k in range(7, -1, -1):
            there = np.where(state < states, to[np.minimum(state, states - 1), byte >> k & 1], states)
            found = np.flatnonzero((there < 0) & (there != ~len(self.symbols)))
            self.gives[found, self.given[found]] = ~there[found]
            self.given[found] += 1
            state = np.where(there == ~len(self.symbols), states, np.maximum(there, 0))
        self.gives = np.ascontiguousarray(self.gives[:, : self.given.max()])
        self.next, self.dead = state.astype(np.int32), states

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many bits each row takes."""
        return _per_row(self.lengths[data], offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.lengths[data]
        total = _per_row(size, offsets)
        ends = _ends(-(-total // 8))
        before = _ends(size)
        at = before[:-1] + np.repeat(8 * ends[:-1] - before[offsets[:-1]], np.diff(offsets))
        # Each code lies in the word of 32 bits where it begins and in the next one; codes of one word stand side by side.
        word, room = at >> 5, (64 - size - (at & 31)).astype(np.uint64)
        code = self.codes.astype(np.uint64)[data] << room
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words = np.zeros(int(ends[-1]) // 4 + 3, np.uint64)
        if len(first):
            words[word[first]] = np.bitwise_or.reduceat(code >> np.uint64(32), first)
            words[word[first] + 1] |= np.bitwise_or.reduceat(code & np.uint64(0xFFFFFFFF), first)
        out = words.astype(">u4").view(np.uint8)[: int(ends[-1])]
        fill = -total % 8
        out[ends[1:][fill > 0] - 1] += ((1 << fill[fill > 0]) - 1).astype(np.uint8)
        return out, ends

    def _states(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The state before each byte. Rows are cut into pieces that are followed side by side, each from where the bytes before
        it lead to, as codes soon fall into step. Where that was not so, the way is followed byte by byte until it was."""
        size = np.diff(offsets)
        start, length = _cut(offsets[:-1], size, _PIECE)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        later = ~np.isin(start, offsets[:-1])
        state, states = np.zeros(len(start), np.int32), np.zeros(len(data), np.int32)
        for k in range(_BEFORE, 0, -1):
            there = self.next[state[later] * 256 + data[start[later] - k]]
            state[later] = np.where(there == self.dead, 0, there)
        for k in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -k))
            own = start[:n] + k
            states[own] = state[:n]
            state[:n] = self.next[state[:n] * 256 + data[own]]
        cut = np.sort(start[later])
        cut = cut[self.next[states[cut - 1] * 256 + data[cut - 1]] != states[cut]]
        if len(cut):
            known, read, step = memoryview(states), memoryview(data), memoryview(self.next)
            stop = offsets[np.searchsorted(offsets, cut, "right")]
            for at, end in zip(cut.tolist(), stop.tolist(), strict=True):
                state = step[known[at - 1] * 256 + read[at - 1]]
                while at < end and known[at] != state:
                    known[at] = state
                    state = step[state * 256 + read[at]]
                    at += 1
        return states

    def decode(self, data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The end mark inside, eight bits of filling and more, and filling that is not all ones are ``Corrupt``."""
        size = np.diff(offsets)
        move = self._states(data, offsets) * 256 + data
        given = self.given[move]
        count = _per_row(given, offsets)
        last = np.zeros(len(size), np.int64)
        last[size > 0] = self.next[move[offsets[1:][size > 0] - 1]]
        error = np.where(count > most, OVER_LIMIT, np.where(np.isin(last, self.filling), 0, CORRUPT))
        given[np.repeat(error > 0, size)] = 0
        out = self.gives[move][np.arange(self.gives.shape[1]) < given[:, None]]
        return out, _ends(np.where(error > 0, 0, count)), error


def adler32(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    size = np.diff(offsets)
    left = np.repeat(offsets[1:], size) - np.arange(len(data))
    a = 1 + _per_row(data.astype(np.int64), offsets)
    b = size + _per_row(left % 65521 * data, offsets)
    return b % 65521 * 65536 + a % 65521


def counts(data: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """How often each byte occurs in each group: ``groups`` times 256; ``group`` has the group of each byte."""
    return np.bincount(group * 256 + data, minlength=groups * 256).reshape(groups, 256)


def rows_of(payloads: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a binary array; null is empty."""
    if payloads.null_count:
        payloads = payloads.fill_null(b"")
    payloads = payloads.cast(pa.large_binary())
    offsets = np.frombuffer(payloads.buffers()[1], np.int64)[payloads.offset : payloads.offset + len(payloads) + 1] if len(payloads) else np.zeros(1, np.int64)
    data = np.frombuffer(payloads.buffers()[2], np.uint8) if payloads.buffers()[2] else _EMPTY
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def in_turn(data: np.ndarray, offsets: np.ndarray, limit: int = _AT_ONCE):
    """``(first row, last row + 1, bytes, offsets)`` for runs of whole rows of about ``limit`` bytes."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1), at + (1 << 16))
        own = offsets[at : to + 1]
        yield at, to, data[own[0] : own[-1]], own - own[0]
        at = to


def binary(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray) -> pa.Array:
    """A binary array of these buffers, null where not ``valid``."""
    if offsets[-1] > 2**31 - 1:
        raise ValueError("the payloads of one batch come to more than 2 GiB; set a cap or smaller Arrow batches")
    buffers = [pa.array(valid).buffers()[1], pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.binary(), len(valid), buffers)


def lists(rows: Iterable, size: Callable, limit: int = _AT_ONCE) -> Iterator[list]:
    """``rows`` in lists of about ``limit`` bytes by ``size``, so that results are passed on and do not stand beside their batch."""
    some, held = [], 0
    for row in rows:
        some.append(row)
        held += size(row)
        if held >= limit:
            yield some
            some, held = [], 0
    if some:
        yield some


def give_back() -> None:
    """Returns freed memory to the system: Arrow's pool and the C library keep it for the worker's next task otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def mapped(batches: Iterator[pa.Array], one: Callable[[bytes], bytes | None]) -> Iterator[pa.Array]:
    """``one`` of each payload, in arrays of some MB however large the batches are. Null stays null."""
    for payloads in batches:
        values = (x.as_py() for x in payloads)
        for some in lists((None if d is None else one(d) for d in values), lambda d: len(d or b"")):
            yield pa.array(some, pa.binary())
    give_back()


def each(one: Callable[[bytes], bytes | None]) -> Callable[[Column | str], Column]:
    """A column function ``BINARY -> BINARY`` of a function over one payload."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return mapped(batches, one)

    return run


def _encoded(payloads: pa.Array, kernel: Callable) -> pa.Array:
    data, offsets = rows_of(payloads)
    parts = [kernel(d, o) for _, _, d, o in in_turn(data, offsets)]
    size = np.concatenate([np.zeros(0, np.int64), *(np.diff(o) for _, o in parts)])
    return binary(np.concatenate([_EMPTY, *(d for d, _ in parts)]), _ends(size), ~np.asarray(payloads.is_null()))


def _decoded(payloads: pa.Array, kernel: Callable, most: int) -> pa.Array:
    data, offsets = rows_of(payloads)
    parts = [kernel(d, o, most) for _, _, d, o in in_turn(data, offsets)]
    size = np.concatenate([np.zeros(0, np.int64), *(np.diff(o) for _, o, _ in parts)])
    error = np.concatenate([np.zeros(0, np.int64), *(e for *_, e in parts)])
    given = ~np.asarray(payloads.is_null())
    out = binary(np.concatenate([_EMPTY, *(d for d, _, _ in parts)]), _ends(size), given & (error == 0))
    return pa.StructArray.from_arrays([out, pa.array(np.array(ERRORS, object)[error], pa.string())], ["data", "error"])


def encoder(kernel: Callable) -> Callable[[Column | str], Column]:
    """A column function ``BINARY -> BINARY`` of a function over buffers. Null stays null."""

    @F.arrow_udf("binary")
    def run(payloads: pa.Array) -> pa.Array:
        return _encoded(payloads, kernel)

    return run


def decoder(kernel: Callable, most: int | None = None) -> Callable[[Column | str], Column]:
    """A column function ``BINARY -> STRUCT<data, error>``; null gives two nulls. More than ``most`` bytes are
    ``OutputLimitExceeded``."""
    limit = 2**62 if most is None else most

    @F.arrow_udf("data binary, error string")
    def run(payloads: pa.Array) -> pa.Array:
        return _decoded(payloads, kernel, limit)

    return run


def measure(kernel: Callable, kind: pa.DataType, ddl: str) -> Callable[[Column | str], Column]:
    """A column function that gives a value for each payload; null stays null."""

    @F.arrow_udf(ddl)
    def run(payloads: pa.Array) -> pa.Array:
        data, offsets = rows_of(payloads)
        parts = [kernel(d, o) for _, _, d, o in in_turn(data, offsets)]
        if pa.types.is_struct(kind):
            columns = [pa.array(np.concatenate([np.zeros(0), *x]), kind.field(k).type) for k, x in enumerate(zip(*parts, strict=True))] if parts else [pa.array([], f.type) for f in kind]
            return pa.StructArray.from_arrays(columns, fields=list(kind), mask=payloads.is_null())
        return pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), kind, mask=np.asarray(payloads.is_null()))

    return run
