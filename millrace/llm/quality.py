"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

Every part of a token falls into one of ``BUCKETS`` hash buckets. A bucket's index vector is sparse and random; its context
vector is the sum of the index vectors near its occurrences in all documents. A document is the mean of the unit context
vectors of its parts, in a table of fixed size. The network is trained on part of a bounded sample of labelled rows
(``max_labelled``), and the temperature of its probabilities on the rest. Every document is scored in its task, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import bytekernels as bk
from millrace.llm.common import release_table, written
from millrace.llm.features import Numbered, words_and_marks
from millrace.llm.toxicity import labelled_sample

MAX_LABELLED = 10_000
BUCKETS = 1 << 15
WIDTH = 64
NONZERO = 6
WINDOW = 2
HIDDEN = 32
_SLICE = 1_000_000
_POOLED = 60_000


def bucket(part: str) -> int:
    return crc32(part.encode()) % BUCKETS


def index_vectors() -> np.ndarray:
    """The sparse ternary index vector of each bucket; always the same."""
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    for k, place in enumerate(_places()):
        out[np.arange(BUCKETS), place] += 1 if k % 2 else -1
    return out


def _places() -> list[np.ndarray]:
    """For each of the ``NONZERO`` marks, its place in each bucket's index vector; every second one is negative."""
    rng = np.random.default_rng(20_240_611)
    return [rng.integers(0, WIDTH, BUCKETS) for _ in range(NONZERO)]


def _near(buckets: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """The sums of the index vectors near each bucket, ``BUCKETS`` times ``WIDTH`` in one; a negative bucket ends a text."""
    sums = np.zeros(BUCKETS * WIDTH, np.int64)
    for gap in range(1, WINDOW + 1):
        a, b = buckets[gap:], buckets[:-gap]
        # Two buckets are near if no end of a text lies between them.
        same = np.logical_and.reduce([buckets[k : len(buckets) - gap + k] >= 0 for k in range(gap + 1)])
        a, b = a[same] * WIDTH, b[same] * WIDTH
        for k, place in enumerate(places):
            for one, other in ((a, b), (b, a)):
                sums += (1 if k % 2 else -1) * np.bincount(one + place[other // WIDTH], minlength=len(sums))
    return sums


def _pooled(table: np.ndarray, texts: list[str | None], parts: Numbered) -> np.ndarray:
    out = np.zeros((len(texts), WIDTH))
    flat, ends = parts.sequences(texts)
    n = np.diff(ends)
    row = np.repeat(np.arange(len(texts)), n)
    for at in range(0, len(flat), _POOLED):
        r = row[at : at + _POOLED]
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        out[r[first]] += np.add.reduceat(table[flat[at : at + _POOLED]], first, axis=0)
    return out / np.maximum(n, 1)[:, None]


@dataclass
class Model:
    table: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def fit_network(table: np.ndarray, x: np.ndarray, y: np.ndarray, steps: int = 1500, batch: int = 512) -> Model:
    """Trains on four fifths of the rows and sets the temperature on the others."""
    rng = np.random.default_rng(7)
    held = rng.permutation(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    m = Model(
        table, x[~held].mean(0) if len(y) else np.zeros(WIDTH), x[~held].std(0) + 1e-6 if len(y) else np.ones(WIDTH),
        rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), float(np.log(share / (1 - share))),
    )
    if len(np.unique(y)) < 2:
        m.w2 = m.w2 * 0
        return m
    params = [m.w1, m.b1, m.w2, np.array([m.b2])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    z, t = (x[~held] - m.mean) / m.scale, y[~held]
    for k in range(1, steps + 1):
        pick = rng.integers(0, len(t), min(batch, len(t)))
        a = z[pick] @ params[0] + params[1]
        hidden = np.maximum(a, 0)
        g = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -40, 40))) - t[pick]) / len(pick)
        back = np.outer(g, params[2]) * (a > 0)
        grads = [z[pick].T @ back + 1e-4 * params[0], back.sum(0), hidden.T @ g + 1e-4 * params[2], np.array([g.sum()])]
        for p, f, s, d in zip(params, first, second, grads, strict=True):
            f += 0.1 * (d - f)
            s += 0.001 * (d * d - s)
            p -= 0.005 * (f / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
    m.b2 = float(params[3][0])
    if held.any() and len(np.unique(y[held])) == 2:
        logits, goal = m.logit(x[held]), y[held]
        tried = np.geomspace(0.3, 10, 60)
        loss = [np.mean(np.logaddexp(0, -logits / c) * goal + np.logaddexp(0, logits / c) * (1 - goal)) for c in tried]
        m.temperature = float(tried[int(np.argmin(loss))])
    return m


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """A model of the probability that ``label_col`` is 1, from rows of ``labels`` that have it and ``docs`` that have the id."""
    wanted = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = written(texts.join(F.broadcast(labelled_sample(wanted, "id", max_labelled)), "id").select("text", "y"))

    @bk.task
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, parts, sums, seen = _places(), Numbered(words_and_marks, bucket), np.zeros(BUCKETS * WIDTH, np.int64), np.zeros(BUCKETS, bool)
        held, size = [], 0

        def settle() -> None:
            nonlocal size
            every = np.concatenate(held)
            seen[every[every >= 0]] = True
            # Runs overlap by the window, whose own pairs were counted before.
            for at in range(0, len(every), _SLICE):
                sums[:] += _near(every[max(0, at - WINDOW) : at + _SLICE], places)
                if at:
                    sums[:] -= _near(every[max(0, at - WINDOW) : at], places)
            held.clear()
            size = 0

        for batch in batches:
            for _, texts in bk.texts(batch.column(0)):
                flat, ends = parts.sequences(texts)
                held.append(np.insert(flat, ends[1:], -1))
                size += len(held[-1])
                if size >= _SLICE // 2:
                    settle()
        if held:
            settle()
        at = np.flatnonzero(seen)
        for k in range(0, len(at), 4096):
            own = at[k : k + 4096]
            v = pa.FixedSizeListArray.from_arrays(pa.array(sums.reshape(BUCKETS, WIDTH)[own].ravel()), WIDTH).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), v], ["bucket", "v"])

    partial = docs.select(F.col(text_col)).mapInArrow(contexts, "bucket int, v array<long>")
    merged = partial.groupBy("bucket").agg(*(F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(WIDTH))).toPandas()
    table = index_vectors()
    table[merged["bucket"].to_numpy(int)] += merged[[f"v{k}" for k in range(WIDTH)]].to_numpy(np.float32)
    table /= np.linalg.norm(table, axis=1, keepdims=True) + 1e-6

    held = docs.sparkSession.sparkContext.broadcast(table)

    @bk.task
    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Numbered(words_and_marks, bucket)
        for batch in batches:
            for at, texts in bk.texts(batch.column(0)):
                x = _pooled(held.value, texts, parts)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1).slice(at, len(texts))], ["x", "y"])

    rows = sample.mapInArrow(pooled, "x array<double>, y double").toPandas()
    release_table(sample)
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, WIDTH))
    return fit_network(table, x, rows["y"].to_numpy(float))


def score(docs: DataFrame, model: Model, text_col: str = "text", column: str = "score") -> DataFrame:
    """Every column of ``docs`` with ``score``, the calibrated probability of label 1 (0 to 1).

    A null or empty text pools to the zero vector and gets that vector's score. An input column named like the new one is
    replaced; equal rows stay apart. Of a long text, a task holds the buckets of its parts, eight bytes each.
    """
    docs = docs.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    at, held = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    @bk.task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, parts = held.value, Numbered(words_and_marks, bucket)
        for batch in batches:
            for first, texts in bk.texts(batch.column(at)):
                p = m.probability(_pooled(m.table, texts, parts))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns, pa.array(p)], schema.names)

    return docs.mapInArrow(run, schema)
