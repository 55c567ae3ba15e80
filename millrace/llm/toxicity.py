"""Toxicity by a classifier chain.

Labelled categories are predicted one after the other. Each link is a linear (logistic) model over the words, word
beginnings and marks of a text and over the probabilities of the earlier categories. In training, those earlier
probabilities are out-of-fold: each row's comes from a model that has not seen the row.

The chain is fitted on a bounded sample of labelled rows (``max_labelled``): tasks count parts by category, the parts that
tell a category best become features, and the sample's few feature numbers go to the driver. All documents are then scored
in their tasks, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import bytekernels as bk
from millrace.llm.common import release_table, written
from millrace.llm.features import Numbered, flattened, with_beginnings

MAX_LABELLED = 8_000
FEATURES = 1_000
MIN_DOCS = 4
#: Standard deviations by which a part's share among positive rows must stand out.
MIN_Z = 4.5
FOLDS = 4
#: Probability from which a document counts as having the category.
REJECT_FROM = 0.3


def labelled_sample(labels: DataFrame, id_col: str, max_rows: int) -> DataFrame:
    """About ``max_rows`` rows of ``labels`` at most, picked by the hash of their id, so the same on each run."""
    n = labels.count()
    if n <= max_rows:
        return labels
    return labels.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < int(1_000_000 * 0.97 * max_rows / n))


class Linear:
    """Logistic regression over binary features and a few dense columns, by accelerated gradient descent."""

    def __init__(self, n_features: int, n_dense: int):
        self.w, self.d, self.b = np.zeros(n_features), np.zeros(n_dense), 0.0

    def score(self, flat: np.ndarray, ends: np.ndarray, dense: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.w[flat])])
        z = sums[ends[1:]] - sums[ends[:-1]] + dense @ self.d + self.b
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def fit(self, flat: np.ndarray, ends: np.ndarray, dense: np.ndarray, y: np.ndarray, steps: int = 150) -> Linear:
        row, n = np.repeat(np.arange(len(y)), np.diff(ends)), max(1, len(y))
        share = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
        self.b = float(np.log(share / (1 - share)))
        params = [self.w, self.d, np.array([self.b])]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for k in range(1, steps + 1):
            self.b = float(params[2][0])
            g = (self.score(flat, ends, dense) - y) / n
            grads = [np.bincount(flat, g[row], len(self.w)) + 1e-6 * self.w, dense.T @ g + 1e-4 * self.d, np.array([g.sum()])]
            for p, a, q, x in zip(params, m, v, grads, strict=True):
                a += 0.1 * (x - a)
                q += 0.01 * (x * x - q)
                p -= 0.1 * (a / (1 - 0.9**k)) / (np.sqrt(q / (1 - 0.99**k)) + 1e-9)
        self.b = float(params[2][0])
        return self


@dataclass
class Chain:
    categories: list[str]
    names: dict[str, int] = field(default_factory=dict)
    links: list[Linear] = field(default_factory=list)

    def predict(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A column of probabilities for each category, the earlier ones feeding the later."""
        out = np.zeros((len(ends) - 1, 0))
        for link in self.links:
            out = np.column_stack([out, link.score(flat, ends, out)])
        return out


def _rows(flat: np.ndarray, ends: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return flattened([flat[ends[k] : ends[k + 1]] for k in pick])


def fit_chain(categories: Sequence[str], names: dict[str, int], own: np.ndarray, flat: np.ndarray, ends: np.ndarray, labels: np.ndarray) -> Chain:
    """Fits the links in order. ``labels`` has a column for each category, NaN where a row has no label; ``own`` has a row
    for each category that marks its features."""
    chain, n = Chain(list(categories), names), len(ends) - 1
    fold, earlier = np.random.default_rng(5).permutation(n) % FOLDS, np.zeros((n, 0))
    for k in range(len(categories)):
        y, known, used = labels[:, k], ~np.isnan(labels[:, k]), own[k][flat] > 0
        mine, at = flat[used], np.concatenate([[0], np.cumsum(used)])[ends]

        def fitted(pick: np.ndarray, y=y, earlier=earlier, mine=mine, at=at) -> Linear:
            f, e = _rows(mine, at, pick)
            return Linear(len(names), earlier.shape[1]).fit(f, e, earlier[pick], y[pick])

        chain.links.append(fitted(np.flatnonzero(known)))
        if k + 1 < len(categories):
            unseen = np.zeros(n)
            for i in range(FOLDS):
                rest = np.flatnonzero(fold == i)
                f, e = _rows(flat, ends, rest)
                unseen[rest] = fitted(np.flatnonzero(known & (fold != i))).score(f, e, earlier[rest])
            earlier = np.column_stack([earlier, unseen])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Chain:
    """A chain over the label columns ``categories`` (0, 1 or null), in that order. A row whose label is null says nothing about
    that category. Labels without a text and texts without a label are left out; without labels every probability is small."""
    k = len(categories)
    wanted = labelled_sample(labels.select(F.col(id_col).alias("id"), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(categories))).where("id is not null"), "id", max_labelled)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = written(texts.join(F.broadcast(wanted), "id").select("text", *(f"c{i}" for i in range(k))))

    @bk.task
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in bk.texts(batch.column(0)):
                names: dict[str, int] = {}
                parts = Numbered(with_beginnings, lambda p, names=names: names.setdefault(p, len(names)))
                flat, ends = parts.distinct(texts)
                row = at + np.repeat(np.arange(len(texts)), np.diff(ends))
                sums = []
                for i in range(k):
                    y = np.asarray(batch.column(1 + i)).astype(float)[row]
                    sums += [np.bincount(flat, ~np.isnan(y), len(names)), np.bincount(flat, np.nan_to_num(y), len(names))]
                some = np.bincount(flat, minlength=len(names)) > 0  # a beginning has a number before it is shared
                columns = [pa.array(list(names), pa.string()), *map(pa.array, sums)]
                yield pa.RecordBatch.from_arrays(columns, ["part", *(f"{x}{i}" for i in range(k) for x in "np")]).filter(pa.array(some))

    sums = [f"{x}{i}" for i in range(k) for x in "np"]
    counts = sample.mapInArrow(counted, "part string, " + ", ".join(f"{c} double" for c in sums))
    counts = written(counts.groupBy("part").agg(*(F.sum(c).alias(c) for c in sums)).where(F.greatest(F.lit(0), *(F.col(f"n{i}") for i in range(k))) >= MIN_DOCS))
    total = sample.agg(*(f(f"c{i}").alias(f"{x}{i}") for i in range(k) for x, f in (("n", F.count), ("c", lambda c: F.coalesce(F.sum(c), F.lit(0.0)))))).first()
    picked: list[set[str]] = [set() for _ in categories]
    for i in range(k):
        n, ones = total[f"n{i}"], total[f"c{i}"]
        if not 0 < ones < n:
            continue
        here = F.col(f"n{i}")
        share = here / n
        gap = F.col(f"p{i}") / ones - (here - F.col(f"p{i}")) / (n - ones)
        told = F.abs(gap) / F.sqrt(share * (1 - share) + 1e-9) * (ones * (n - ones) / n) ** 0.5
        best = counts.where(here >= MIN_DOCS).select("part", told.alias("told")).where(F.col("told") >= MIN_Z).orderBy(F.desc("told"), "part").limit(FEATURES)
        picked[i].update(r.part for r in best.collect())
    names = {p: i for i, p in enumerate(sorted(set().union(*picked)))}
    own = np.array([[p in mine for p in names] for mine in picked], float).reshape(k, len(names))

    @bk.task
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Numbered(with_beginnings, names.get)
        for batch in batches:
            for at, texts in bk.texts(batch.column(0)):
                flat, ends = parts.distinct(texts)
                found = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([found, *batch.slice(at, len(texts)).columns[1:]], ["found", *batch.schema.names[1:]])

    rows = sample.mapInArrow(numbered, "found array<int>, " + ", ".join(f"c{i} double" for i in range(k))).toPandas()
    for table in (sample, counts):
        release_table(table)
    flat, ends = flattened(list(rows["found"]))
    return fit_chain(categories, names, own, flat, ends, rows[[f"c{i}" for i in range(k)]].to_numpy(float))


def score(docs: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """Every column of ``docs`` with a probability ``p_<category>`` for each category of the chain.

    A null or empty text has no parts and gets the probability of a text without features. Input columns named like the
    new ones are replaced; equal rows stay apart. Of a long text, a task holds the different tokens.
    """
    new = [prefix + c for c in chain.categories]
    docs = docs.drop(*new)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in new)])
    at, held = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(chain)

    @bk.task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        parts = Numbered(with_beginnings, model.names.get)
        for batch in batches:
            for first, texts in bk.texts(batch.column(at)):
                p = model.predict(*parts.distinct(texts))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns, *(pa.array(p[:, i]) for i in range(p.shape[1]))], schema.names)

    return docs.mapInArrow(run, schema)


