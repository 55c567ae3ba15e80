"""Line dedup: lines found in many documents go, everywhere.

One pass counts, for each distinct line hash, the documents that have the line. The hashes that reach
the threshold are dealt into shards; each shard becomes a minimal perfect hash (levels of collision-free
bits, ranked) that indexes an array of fingerprints and an array of counts. A second pass hashes the lines
of each document again and probes the arrays; documents are never joined with lines or shuffled.

The arrays go to the executors ``broadcast_bytes`` at a time. If they take more, there are several passes over the texts, each
of which probes its shards and notes the numbers of the lines to drop; only these numbers are then joined with their documents.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import bytekernels as bk
from millrace.llm.common import fresh, release_table, written

KEYS_PER_SHARD = 1 << 16
BROADCAST_BYTES = 64 << 20
_GAMMA = 2
_SEEDS = np.random.default_rng(77).integers(1, 2**63, 64, dtype=np.uint64)


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys with a fingerprint and a count for each."""

    def __init__(self, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.levels, left = [], keys
        for seed in _SEEDS:
            if not len(left):
                break
            size = _GAMMA * len(left) + 64
            slot = bk.mix(left ^ seed) % np.uint64(size)
            alone = np.bincount(slot.astype(np.int64), minlength=size) == 1
            self.levels.append((seed, size, np.packbits(alone, bitorder="little"), int(alone.sum())))
            left = left[~alone[slot.astype(np.int64)]]
        else:
            if len(left):
                raise ValueError("keys are not distinct")
        self._rank()
        at = self.index(keys)
        self.prints, self.counts = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint32)
        self.prints[at], self.counts[at] = prints, np.minimum(counts, 2**32 - 1)

    def _rank(self) -> None:
        self._ranked, base = [], 0
        for seed, size, bits, n in self.levels:
            per_byte = np.unpackbits(bits[:, None], axis=1, bitorder="little").sum(1)
            self._ranked.append((seed, size, bits, base + np.concatenate([[0], np.cumsum(per_byte)[:-1]])))
            base += n

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place; for a key that was not indexed, any place or -1."""
        place, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for seed, size, bits, rank in self._ranked:
            if not len(open_):
                break
            slot = (bk.mix(keys[open_] ^ seed) % np.uint64(size)).astype(np.int64)
            byte, bit = slot >> 3, slot & 7
            set_ = (bits[byte] >> bit.astype(np.uint8)) & 1 == 1
            below = np.unpackbits((bits[byte] & ((1 << bit) - 1).astype(np.uint8))[:, None], axis=1).sum(1)
            place[open_[set_]] = rank[byte[set_]] + below[set_]
            open_ = open_[~set_]
        return place

    def count(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The count of each key, 0 where it was not indexed."""
        at = self.index(keys)
        known = at >= 0
        known[known] = self.prints[at[known]] == prints[known]
        return np.where(known, self.counts[at], 0) if len(self.counts) else np.zeros(len(keys), np.uint32)


class Shards:
    """Perfect hashes by shard; a key, read as a signed number, belongs to shard ``key mod n``."""

    def __init__(self, n: int, by_shard: dict[int, PerfectHash]):
        self.n, self.by_shard = n, by_shard

    def count(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        out, shard = np.zeros(len(keys), np.int64), keys.view(np.int64) % self.n
        for s in np.unique(shard):
            if s in self.by_shard:
                own = np.flatnonzero(shard == s)
                out[own] = self.by_shard[s].count(keys[own], prints[own])
        return out


def line_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end, row, whether the key is empty, and two 64-bit hashes of the key, of each line."""
    start, end, row = bk.lines(data, offsets)
    s, e = bk.stripped(data, start, end)
    return start, end, row, s == e, *bk.SpanHash(bk.LOWER[data]).pairs(s, e)


@bk.task
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each distinct line of a run of documents, the number of documents that have it."""
    for batch in batches:
        for _, _, data, offsets in bk.slices(batch.column(0)):
            _, _, row, empty, h, g = line_keys(data, offsets)
            row, h, g = row[~empty], h[~empty], g[~empty]
            order = np.lexsort((row, g, h))
            row, h, g = row[order], h[order], g[order]
            same = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
            first = np.append(True, ~(same & (row[1:] == row[:-1])))[: len(h)]
            group = np.append(True, ~same)[: len(h)]
            n = np.add.reduceat(first.astype(np.int64), np.flatnonzero(group)) if len(h) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[group].view(np.int64)), pa.array(g[group].view(np.int64)), pa.array(n)], ["h", "g", "n"]
            )


def frequent_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10) -> DataFrame:
    """``(h, g, n)``: two hashes of each line key found in at least ``min_docs`` documents, and that number."""
    counts = docs.select(text_col).mapInArrow(_counted, "h long, g long, n long")
    return counts.groupBy("h", "g").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    # Two lines may share h (not g): the first stays under h, the rest are kept beside the arrays.
    pdf = pdf.sort_values(["h", "g"])
    twin = pdf["h"].duplicated().to_numpy()
    h, g, n = (pdf[c].to_numpy() for c in ("h", "g", "n"))
    table = PerfectHash(h[~twin].view(np.uint64), g[~twin].view(np.uint64), n[~twin])
    # A twin's key is its g; the chance that a third line needs this place too is below 2^-120.
    extra = PerfectHash(np.unique(g[twin]).view(np.uint64), np.unique(g[twin]).view(np.uint64), np.ones(len(np.unique(g[twin]))))
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "body": [pickle.dumps((table, extra))]})


class _Table:
    def __init__(self, body: bytes):
        self.table, self.extra = pickle.loads(body)

    def count(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        out = self.table.count(keys, prints)
        if len(self.extra.counts):
            out = np.maximum(out, self.extra.count(prints, prints))
        return out


def build_shards(frequent: DataFrame, n_shards: int) -> DataFrame:
    """One row ``(shard, body)`` for each shard of the perfect hash."""
    shard = F.pmod(F.col("h"), F.lit(n_shards)).cast("int")
    return frequent.withColumn("shard", shard).groupBy("shard").applyInPandas(_packed, "shard int, body binary")


def _kept(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, drop: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    rows = len(offsets) - 1
    n_lines, n_dropped = np.bincount(row, minlength=rows), np.bincount(row[drop], minlength=rows)
    raw, at = data.tobytes(), np.searchsorted(row, np.arange(rows + 1))
    texts = []
    for k in range(rows):
        if n_dropped[k]:
            own = [i for i in range(at[k], at[k + 1]) if not drop[i]]
            texts.append(b"\n".join(raw[start[i] : end[i]] for i in own))
        else:
            texts.append(raw[offsets[k] : offsets[k + 1]])
    return texts, n_lines, n_dropped


def _output(batch: pa.RecordBatch, text_at: int, texts: list[bytes], n_lines: list, n_dropped: list) -> pa.RecordBatch:
    columns = list(batch.columns)
    columns[text_at] = pa.array([t.decode() for t in texts], pa.string())
    sums = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
    new = [pa.array(np.concatenate([*n, np.zeros(0, np.int64)]).astype(np.int64)) for n in (n_lines, n_dropped)]
    return pa.RecordBatch.from_arrays([*columns, *new, sums], [*batch.schema.names, "n_lines", "n_dropped", "kept_sha256"])


def _numbers(line_of: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The number of each line within its row."""
    return line_of - np.searchsorted(row, np.arange(rows))[row[line_of]]


def dedup_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every column of ``docs``, with ``text_col`` holding the kept lines, and ``n_lines`` (before dropping),
    ``n_dropped``, ``kept_sha256``.

    A line's key is the line without white space at both ends and with A-Z lowered. Keys of one code point or
    more found in at least ``min_docs`` documents lose all their lines; empty keys never do. A null or empty
    text counts as one empty line and becomes an empty text. Repeats of a line inside one document count that
    document once; rows that are equal are documents of their own. Input columns named like the new ones are replaced; an
    empty table gives an empty table. A single text is handled in one piece and takes about ten times its bytes.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_sha256")
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("n_lines long, n_dropped long, kept_sha256 string").fields])
    spark, text_at = docs.sparkSession, docs.columns.index(text_col)
    frequent = written(frequent_lines(docs, text_col, min_docs))
    n_shards = max(1, -(-frequent.count() // KEYS_PER_SHARD))
    shards = written(build_shards(frequent, n_shards))
    release_table(frequent)
    size = shards.agg(F.sum(F.length("body"))).first()[0] or 0
    n_passes = min(n_shards, max(1, -(-size // max(1, broadcast_bytes))))
    if n_passes > 1:
        return _by_passes(docs, text_col, shards, n_shards, n_passes, schema)
    held = spark.sparkContext.broadcast([(r.shard, bytes(r.body)) for r in shards.collect()])
    release_table(shards)

    @bk.task
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Shards(n_shards, {s: _Table(body) for s, body in held.value})
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for _, _, data, offsets in bk.slices(batch.column(text_at)):
                start, end, row, empty, h, g = line_keys(data, offsets)
                t, a, b = _kept(data, offsets, start, end, row, (table.count(h, g) > 0) & ~empty)
                texts += t
                n_lines.append(a)
                n_dropped.append(b)
            yield _output(batch, text_at, texts, n_lines, n_dropped)

    return docs.mapInArrow(probe, schema)


def _by_passes(docs: DataFrame, text_col: str, shards: DataFrame, n_shards: int, n_passes: int, schema: T.StructType) -> DataFrame:
    """The way beyond ``broadcast_bytes``. Rows get a written key, and each pass notes the lines that its shards know."""
    text_at, key = docs.columns.index(text_col), fresh(docs, "row_key")
    noted = fresh(docs, "line_numbers")
    keyed = written(docs.withColumn(key, F.monotonically_increasing_id()))
    notes = None
    for k in range(n_passes):
        own = shards.where(F.col("shard") % n_passes == k)
        held = docs.sparkSession.sparkContext.broadcast([(r.shard, bytes(r.body)) for r in own.collect()])

        @bk.task
        def note(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            table = Shards(n_shards, {s: _Table(body) for s, body in held.value})
            for batch in batches:
                for at, to, data, offsets in bk.slices(batch.column(1)):
                    _, _, row, empty, h, g = line_keys(data, offsets)
                    known = np.flatnonzero((table.count(h, g) > 0) & ~empty)
                    count = np.bincount(row[known], minlength=to - at)
                    ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                    numbers = pa.ListArray.from_arrays(pa.array(ends), pa.array(_numbers(known, row, to - at).astype(np.int32)))
                    out = pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), numbers], ["own", "numbers"])
                    yield out.filter(pa.array(count > 0))

        found = written(keyed.select(key, text_col).mapInArrow(note, "own long, numbers array<int>"))
        held.unpersist()
        notes = found if notes is None else notes.union(found)
    release_table(shards)
    gone = notes.groupBy(F.col("own").alias(key)).agg(F.flatten(F.collect_list("numbers")).alias(noted))
    joined = keyed.join(gone, key, "left").select(*docs.columns, noted)

    @bk.task
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(batch.num_columns - 1).to_pylist()
            texts, n_lines, n_dropped = [], [], []
            for at, to, data, offsets in bk.slices(batch.column(text_at)):
                start, end, row = bk.lines(data, offsets)
                drop, first = np.zeros(len(row), bool), np.searchsorted(row, np.arange(to - at))
                for k in range(to - at):
                    drop[first[k] + np.array(gone[at + k] or [], np.int64)] = True
                t, x, y = _kept(data, offsets, start, end, row, drop)
                texts += t
                n_lines.append(x)
                n_dropped.append(y)
            own = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
            yield _output(own, text_at, texts, n_lines, n_dropped)

    return joined.mapInArrow(cut, schema)
