"""Block transforms over payloads: move-to-front, a short step for each row, and Burrows-Wheeler, over all rows of a batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column

from millrace.functions import buffers

BLOCK = 256 << 10
#: Payload whose rotations are ranked at a time, in whole blocks.
_AT_ONCE = 1 << 20


def _mtf(data: bytes) -> bytes:
    table, out = bytearray(range(256)), bytearray()
    for b in data:
        k = table.index(b)
        out.append(k)
        if k:
            del table[k]
            table.insert(0, b)
    return bytes(out)


def _unmtf(data: bytes) -> bytes:
    table, out = bytearray(range(256)), bytearray()
    for k in data:
        b = table.pop(k)
        table.insert(0, b)
        out.append(b)
    return bytes(out)


def _ranked_rotations(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The rotations of all blocks, block by block: the places where they begin, in order, equal ones by their offset. First by
    eight bytes, then those that are not told apart by doubling the compared length."""
    size = np.diff(ends)
    block, first, n = np.repeat(np.arange(len(size)), size), np.repeat(ends[:-1], size), np.repeat(size, size)
    offset = np.arange(len(data)) - first
    key = np.zeros(len(data), np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | data[first + (offset + k) % n]
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(block[order].astype(np.min_scalar_type(len(size))), kind="stable")]
    new = (np.diff(key[order], prepend=key[:1]) != 0) | (np.diff(block[order], prepend=-1) != 0)
    group = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    rank = np.empty(len(data), np.int64)
    rank[order] = group
    open_, width = np.arange(len(data)), 8
    while True:
        # Only groups of several whose blocks are longer than what was compared go on; whole groups lie side by side.
        several = np.bincount(rank[order[open_]], minlength=len(data))[rank[order[open_]]] > 1
        open_ = open_[several & (n[order[open_]] > width)]
        if not len(open_):
            return order
        own = order[open_]
        follows = rank[first[own] + (offset[own] + width) % n[own]]
        by = np.argsort(rank[own] * len(data) + follows, kind="stable")
        own, follows = own[by], follows[by]
        new = (np.diff(rank[own], prepend=-1) != 0) | (np.diff(follows, prepend=-1) != 0)
        order[open_] = own
        rank[own] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        width *= 2


def _bwt(data: np.ndarray, offsets: np.ndarray, block_size: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows together: their blocks stand side by side, and some MB of whole blocks are worked on at a time."""
    blocks = -(-np.diff(offsets) // block_size)
    start, length = buffers._cut(offsets[:-1], np.diff(offsets), block_size)
    ends = np.append(start, len(data))
    out = np.empty(len(data) + 8 * len(start), np.uint8)
    for at, to, own, own_ends in buffers.in_turn(data, ends, _AT_ONCE):
        order, size = _ranked_rotations(own, own_ends), length[at:to]
        first = np.repeat(own_ends[:-1], size)
        primary = np.flatnonzero(order == first) - own_ends[:-1]
        last = np.where(order == first, first + np.repeat(size, size), order) - 1
        head = start[at:to] + 8 * np.arange(at, to)
        out[head[:, None] + np.arange(8)] = np.stack([size, primary], 1).astype("<u4").view(np.uint8)
        out[buffers._spread(head + 8, size)] = own[last]
    return out, offsets + 8 * buffers._ends(blocks)


def _unbwt(data: bytes) -> bytes | None:
    out, at = [], 0
    while at < len(data):
        if len(data) < at + 8:
            return None
        n, primary = (int(x) for x in np.frombuffer(data[at : at + 8], "<u4"))
        last = np.frombuffer(data[at + 8 : at + 8 + n], np.uint8)
        if not n or len(last) < n or primary >= n:
            return None
        # The way through the rotations, its known part doubled in each step.
        jump = np.argsort(last, kind="stable")
        way = jump[np.array([primary])]
        while len(way) < n:
            way = np.concatenate([way, jump[way]])
            jump = jump[jump]
        out.append(last[way[:n]].tobytes())
        at += 8 + n
    return b"".join(out)


def mtf(payload: Column | str) -> Column:
    """Each byte's place in a list that starts as 0 to 255; a byte moves to the front once it was read."""
    return buffers.each(_mtf)(payload)


def unmtf(payload: Column | str) -> Column:
    return buffers.each(_unmtf)(payload)


def bwt(payload: Column | str, block_size: int = BLOCK) -> Column:
    """Blocks of ``length u32, primary index u32, last column``; equal rotations keep their order. Empty stays empty."""
    return buffers.encoder(lambda data, offsets: _bwt(data, offsets, block_size))(payload)


def unbwt(payload: Column | str) -> Column:
    """The inverse; null for a payload that is cut short or whose primary index is outside its block."""
    return buffers.each(_unbwt)(payload)
