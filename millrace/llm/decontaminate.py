"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are windows of consecutive benchmark words (an item with fewer words is one window). Windows of one
length share a shift table indexed by the hash of a block of words: a block that ends no window lets the search
skip ahead; a block that may end one leads to the bucket of windows with that suffix, whose hash is compared and
then, byte by byte, the text itself. Many stretches of text are searched at the same time, one position each.

The tables are arrays. They are made once for each piece of the benchmark, on the driver, and sent to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import bytekernels as bk
from millrace.llm.common import release_table, written

CHUNK_BYTES = 16 << 20
_STRETCH = 480
#: Entries of a shift table for each word of the benchmark; a chance block of the text leads to a bucket once in so many times.
_ENTRIES = 16
#: Word bytes, once A-Z are lowered: all but 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F.
_WORD = np.ones(256, bool)
_WORD[0x00:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False


class _Words:
    """The lowered words of some texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = bk.LOWER[data]
        self.start, self.end, self.first = bk.words(self.data, offsets, _WORD)
        self.hashes = bk.SpanHash(self.data).of(self.start, self.end)


def _same(a: _Words, i: np.ndarray, b: _Words, j: np.ndarray) -> np.ndarray:
    """Whether the words ``i`` of ``a`` and ``j`` of ``b`` have the same bytes."""
    n = a.end[i] - a.start[i]
    same = n == b.end[j] - b.start[j]
    few = np.flatnonzero(same)
    n = n[few]
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    equal = a.data[np.repeat(a.start[i[few]], n) + place] == b.data[np.repeat(b.start[j[few]], n) + place]
    if len(few):
        same[few] = np.logical_and.reduceat(equal, np.cumsum(n) - n)  # no word is empty
    return same


class _Class:
    """The different windows of one length: the shift table, the suffix buckets, and the items of each window."""

    def __init__(self, length: int, texts: _Words, at: np.ndarray, item: np.ndarray):
        self.length, self.block = length, min(3, length)
        whole = bk.gram_hash(texts.hashes, length)[at]
        order = np.lexsort((item, at, whole))
        whole, at, item = whole[order], at[order], item[order]
        # Windows of one hash are told apart by their words; nearly always all are the same.
        new = np.append(True, whole[1:] != whole[:-1])
        leader = np.flatnonzero(new)[np.cumsum(new) - 1]
        alike = lambda a, b: np.logical_and.reduce([_same(texts, at[a] + k, texts, at[b] + k) for k in range(length)])
        for k in np.flatnonzero(~alike(leader, np.arange(len(at)))):
            others = np.array([x for x in range(leader[k], k) if leader[x] == x and x != leader[k]], np.int64)
            known = others[alike(others, np.full(len(others), k))]
            leader[k] = known[0] if len(known) else k
        order = np.lexsort((item, leader))
        leader, item = leader[order], item[order]
        once = np.append(True, (leader[1:] != leader[:-1]) | (item[1:] != item[:-1]))
        own, count = np.unique(leader[once], return_counts=True)
        self.whole, self.at = whole[own], at[own]
        self.items, self.ends = item[once], np.concatenate([[0], np.cumsum(count)])
        blocks = bk.gram_hash(texts.hashes, self.block)
        self.bits = max(12, int(np.ceil(np.log2(_ENTRIES * len(texts.hashes) + 1))))
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.int32 if length > 250 else np.uint8)
        for k in range(length - self.block + 1):
            np.minimum.at(self.shift, self.slot(blocks[self.at + k]), length - self.block - k)

    def slot(self, block_hash: np.ndarray) -> np.ndarray:
        return (block_hash >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, text: _Words, own: _Words) -> tuple[np.ndarray, np.ndarray]:
        """The first word and the window of each occurrence inside one row's words."""
        m, none = self.length, np.zeros(0, np.int64)
        if len(text.hashes) < m:
            return none, none
        shift = self.shift[self.slot(bk.gram_hash(text.hashes, self.block))]  # by the block's first word
        low, high = text.first[:-1] + m - 1, text.first[1:]
        n = np.maximum(0, -(-(high - low) // _STRETCH))
        row = np.repeat(np.arange(len(n)), n)
        at = low[row] + _STRETCH * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        stop = np.minimum(at + _STRETCH, high[row])
        found = [none]
        while len(at):
            step = shift[at - self.block + 1].astype(np.int64)
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            open_ = at < stop
            at, stop = at[open_], stop[open_]
        first = np.sort(np.concatenate(found)) - (m - 1)
        whole = np.zeros(len(first), np.uint64)
        for k in range(m):
            whole += text.hashes[first + k] * bk.gram_code(k)
        whole = bk.mix(whole)
        place = np.searchsorted(self.whole, whole)
        hits = [(none, none)]
        while len(first):
            known = place < len(self.whole)
            known[known] = self.whole[place[known]] == whole[known]
            first, whole, place = first[known], whole[known], place[known]
            same = np.ones(len(first), bool)
            for k in range(m):
                left = np.flatnonzero(same)
                same[left] = _same(text, first[left] + k, own, self.at[place[left]] + k)
            hits.append((first[same], place[same]))
            # Another window may have the same hash.
            first, whole, place = first[~same], whole[~same], place[~same] + 1
        return np.concatenate([a for a, _ in hits]), np.concatenate([b for _, b in hits])


class WindowSearch:
    """All windows of the items, by length."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        raw = [text.encode() for _, text in items]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        self.words = _Words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        item, count = np.array([number[name] for name, _ in items], np.int64), np.diff(self.words.first)
        self.classes = []
        for length in np.unique(np.minimum(count, window)):
            if not length:
                continue
            rows = np.flatnonzero(np.minimum(count, window) == length)
            n = count[rows] - length + 1
            at = np.repeat(self.words.first[rows], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            self.classes.append(_Class(int(length), self.words, at, np.repeat(item[rows], n)))

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]], list[tuple[int, int]]]:
        """The number of words of each row; ``(row, first word, length)`` of the occurrences; ``(row, item)`` of the items found."""
        text = _Words(data, offsets)
        spans, items = [np.zeros((0, 3), np.int64)], [np.zeros((0, 2), np.int64)]
        for made in self.classes:
            first, window = made.search(text, self.words)
            row = np.searchsorted(text.first, first, "right") - 1
            spans.append(np.column_stack([row, first - text.first[row], np.full(len(row), made.length)]))
            # Each pair of a row and a window counts once, however often it occurs.
            pair = np.unique(np.column_stack([row, window]), axis=0)
            count = made.ends[pair[:, 1] + 1] - made.ends[pair[:, 1]]
            own = np.arange(int(count.sum())) + np.repeat(made.ends[pair[:, 1]] - (np.cumsum(count) - count), count)
            items.append(np.column_stack([np.repeat(pair[:, 0], count), made.items[own]]))
        return np.diff(text.first), np.concatenate(spans), np.unique(np.concatenate(items), axis=0)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_benchmark_windows(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 13, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Every column of ``docs`` with ``n_words``, ``n_hit`` (words inside occurrences of benchmark windows),
    ``hit_spans`` (word ranges, end exclusive) and ``item_ids`` (items with occurring windows, as sorted strings).

    Words are the runs outside 0x00-0x2F, 0x3A-0x60, 0x7B-0x7F after lowering A-Z. A null or empty text has no words.
    Items without words or without an id are never found; rows that repeat an id are one item with several texts. Input columns
    named like the new ones are replaced; rows that are equal stay apart. A single text takes about twenty times its bytes.

    The benchmark is dealt into pieces of about ``chunk_bytes`` of text (a single text is never cut). One piece is with the
    executors at a time: each is one pass over the documents without a shuffle, and what a pass found is written before the next.
    """
    new = T._parse_datatype_string("n_words long, n_hit long, hit_spans array<struct<a:int,b:int>>, item_ids array<string>").fields
    docs = docs.drop(*(f.name for f in new))
    spark, text_at, width = docs.sparkSession, docs.columns.index(text_col), len(docs.columns)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(1, -(-size // chunk_bytes))
    out_schema = T.StructType([*docs.schema.fields, *new])
    before = None
    for chunk in range(n_chunks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_chunks)) == chunk)
        held = spark.sparkContext.broadcast(WindowSearch([(r.item, r.text) for r in part.collect()], window))

        @bk.task
        def search(batches: Iterator[pa.RecordBatch], held=held, later=chunk > 0) -> Iterator[pa.RecordBatch]:
            table = held.value
            for batch in batches:
                old_spans = batch.column(width + 2).to_pylist() if later else None
                old_items = batch.column(width + 3).to_pylist() if later else None
                n_words, n_hit, all_spans, all_items = [], [], [], []
                for _, _, data, offsets in bk.slices(batch.column(text_at)):
                    n, spans, found = table.scan(data, offsets)
                    by_row: dict[int, list] = {}
                    for row, first, length in spans.tolist():
                        by_row.setdefault(row, []).append((first, first + length))
                    names: dict[int, set[str]] = {}
                    for row, item in found.tolist():
                        names.setdefault(row, set()).add(table.names[item])
                    for k in range(len(n)):
                        own, named, at = by_row.get(k, []), names.get(k, set()), len(n_words)
                        if later:
                            own, named = own + [(s["a"], s["b"]) for s in old_spans[at]], named.union(old_items[at])
                        own = _merged(own)
                        n_words.append(int(n[k]))
                        n_hit.append(sum(b - a for a, b in own))
                        all_spans.append([{"a": a, "b": b} for a, b in own])
                        all_items.append(sorted(named))
                made = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(all_spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(all_items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], out_schema.names)

        docs = docs.mapInArrow(search, out_schema)
        if chunk + 1 < n_chunks:
            docs = written(docs)
            held.unpersist()
            if before is not None:
                release_table(before)
            before = docs
    return docs


def contaminated(n_words="n_words", n_hit="n_hit"):
    """Whether hit words make up at least a twentieth of the words."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))
