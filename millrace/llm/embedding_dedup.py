"""Embedding near-dedup by product quantisation.

Unit vectors are dealt into coarse inverted lists, one for each pair of a centre of their first half and one of their second
half; so a few centres make many lists, and their number grows with the number of vectors while lists keep their size. The
residual to the list's centre is cut into subspaces and each cut is replaced by the nearest of a few codewords. Every vector is
also a query. It probes each list whose borders with its own list are so near that a linked vector may lie beyond them: linked
vectors differ by a small step, and of a step in any direction only the part across the borders counts, with a standard deviation
of the step's length over the square root of the width (``probe_sigmas`` of them are allowed for; with ``sqrt(width)`` of them or
more nothing is left to chance). In a list, distances between the query and the codes are sums of table entries (asymmetric: the
query is not quantised); with the known coding error of each vector they bound the true distance, so no linked vector of a probed
list is lost. What passes is ranked again by the exact cosine, in double precision.

The centres and codewords are fitted on a bounded sample (``max_sample``); every vector is indexed. Equal vectors, told apart by
128 bits, are one numbered node with a weight. In a list, blocks of members meet blocks of queries; only counts and a spanning
forest of the links leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import bytekernels as bk
from millrace.llm.common import connected, release_table, written

MAX_SAMPLE = 20_000
SUBSPACES = 8
CODEWORDS = 64
#: Vectors for each list, on average; members and queries that meet in one task.
LIST = 256
BLOCK = 2048
QUERY_BLOCK = 8192
#: The sizes of the lists are broadcast up to so many bytes, and joined by a shuffle beyond.
BROADCAST_BYTES = 32 << 20


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (centres**2).sum(1) - 2 * x @ centres.T
    at = square.argmin(1)
    return at, np.maximum(square[np.arange(len(x)), at] + (x**2).sum(1), 0)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        at, _ = _nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(centres))])
    return centres


def _within(centres: np.ndarray, x: np.ndarray, across: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(vector, centre, distance)``: the centres whose border with the vector's own is within ``across``."""
    home, _ = _nearest(x, centres)
    square = (centres**2).sum(1) - 2 * x @ centres.T
    between = np.sqrt(np.maximum(((centres[:, None] - centres[None]) ** 2).sum(2), 1e-18))
    border = np.maximum(square - square[np.arange(len(x)), home][:, None], 0) / (2 * between[home])
    border[np.arange(len(x)), home] = 0
    who, which = np.nonzero(border <= across)
    return who, which, border[who, which]


@dataclass
class Index:
    halves: list[np.ndarray]  # the centres of the first and of the second half
    words: list[np.ndarray]  # for each subspace: codewords x its width
    cuts: np.ndarray  # where the subspaces begin (and the last ends)

    @property
    def lists(self) -> int:
        return len(self.halves[0]) * len(self.halves[1])

    def centre(self, list_: np.ndarray) -> np.ndarray:
        first, second = np.divmod(list_, len(self.halves[1]))
        return np.concatenate([self.halves[0][first], self.halves[1][second]], axis=-1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The list, the codes and the coding error of each vector."""
        half = self.halves[0].shape[1]
        home = _nearest(x[:, :half], self.halves[0])[0] * len(self.halves[1]) + _nearest(x[:, half:], self.halves[1])[0]
        rest = x - self.centre(home)
        codes, error = np.zeros((len(x), len(self.words)), np.uint8), np.zeros(len(x))
        for m, w in enumerate(self.words):
            codes[:, m], square = _nearest(rest[:, self.cuts[m] : self.cuts[m + 1]], w)
            error += square
        return home, codes, np.sqrt(error)

    def probes(self, x: np.ndarray, across: float) -> tuple[np.ndarray, np.ndarray]:
        """``(vector, list)`` by vector: the lists that may hold a vector whose step across borders is within ``across``. A step
        beyond the borders of both halves is at least as long as both ways together, which are at right angles."""
        half = self.halves[0].shape[1]
        who, first, a = _within(self.halves[0], x[:, :half], across)
        other, second, b = _within(self.halves[1], x[:, half:], across)
        count = np.bincount(other, minlength=len(x))
        starts, many = np.cumsum(count) - count, count[who]
        at = np.arange(int(many.sum())) + np.repeat(starts[who] - (np.cumsum(many) - many), many)
        near = np.repeat(a, many) ** 2 + b[at] ** 2 <= across**2 + 1e-12
        return np.repeat(who, many)[near], (np.repeat(first, many) * len(self.halves[1]) + second[at])[near]


def fit(x: np.ndarray, lists: int) -> Index:
    rng, half = np.random.default_rng(11), (x.shape[1] + 1) // 2
    many = max(1, round(lists**0.5))
    halves = [kmeans(x[:, :half], many, rng), kmeans(x[:, half:], many if half < x.shape[1] else 1, rng)]
    cuts = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
    index = Index(halves, [], cuts)
    rest = x - index.centre(_nearest(x[:, :half], halves[0])[0] * len(halves[1]) + _nearest(x[:, half:], halves[1])[0])
    index.words = [kmeans(rest[:, a:b], CODEWORDS, rng) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return index


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = np.asarray(column.flatten()).astype(np.float64)
    n = np.asarray(column.value_lengths())
    out = np.zeros((len(column), width))
    if len(flat):
        start = np.cumsum(n) - n
        out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(start, n)] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # first, as squares of very large or small numbers overflow
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links with the smallest node of its component, without the pairs of a node with itself."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _met(held, width: int, cosine: float):
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-7

    def run(table: pa.Table) -> pa.Table:
        index, at = held.value, table.column("list")[0].as_py()
        table = table.combine_chunks()
        member = np.asarray(table.column("member").combine_chunks())
        key, weight = table.column("key").to_numpy(), table.column("weight").to_numpy()
        x = _unit(_matrix(table.column("v").combine_chunks(), width)) if len(key) else np.zeros((0, width))
        m, q = np.flatnonzero(member), np.flatnonzero(~member)
        codes = np.frombuffer(b"".join(c.as_py() for c in table.column("codes").combine_chunks().take(pa.array(m))), np.uint8).reshape(len(m), -1)
        bound = (radius + table.column("error").to_numpy()[m]) ** 2
        counts, links = np.zeros(len(q), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in range(0, len(q) if len(m) else 0, 256):
            own = q[k : k + 256]
            rest = x[own] - index.centre(np.array(at))
            far = np.zeros((len(own), len(m)))
            for s, w in enumerate(index.words):
                part = rest[:, index.cuts[s] : index.cuts[s + 1]]
                lookup = (part**2).sum(1)[:, None] - 2 * part @ w.T + (w**2).sum(1)
                far += lookup[:, codes[:, s]]
            i, j = np.nonzero(far <= bound[None] + 1e-9)
            exact = np.einsum("ij,ij->i", x[own[i]], x[m[j]])
            good = (exact >= cosine) & (key[own[i]] != key[m[j]])
            i, j = i[good], j[good]
            counts[k : k + 256] = np.bincount(i, weight[m[j]], len(own)).astype(np.int64)
            links.append(_forest(key[own[i]], key[m[j]]))
        some = counts > 0
        a, b = _forest(np.concatenate([p[0] for p in links]), np.concatenate([p[1] for p in links]))
        return pa.table({
            "a": np.concatenate([key[q[some]], a]),
            "b": pa.array(np.concatenate([np.zeros(some.sum(), np.int64), b]), mask=np.arange(some.sum() + len(b)) < some.sum()),
            "n": np.concatenate([counts[some], np.zeros(len(a), np.int64)]),
        })

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, max_sample: int = MAX_SAMPLE,
    probe_sigmas: float = 3.0,
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for each row of ``vectors``.

    Two vectors link if found with a cosine of ``cosine`` or more. ``n_links`` counts the other rows linked directly, equal
    vectors among them; ``component_id`` is the smallest id reachable by links, itself included; ``kept`` tells whether the
    two ids are equal. Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Shorter
    vectors are read as if filled up with zeros. Rows that repeat an id keep their rows.
    """
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col(vector_col).cast(kind)
    fine = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(fine, v).alias("v"))
    # Two hashes by different seeds.
    rows = rows.select("id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("key"), F.xxhash64(F.lit(7), "v").alias("key2"))
    spark = vectors.sparkSession
    ids = written(rows.select("id", "key", "key2"))
    nodes = rows.where("key is not null").groupBy("key", "key2").agg(F.first("v").alias("v"), F.count("*").alias("weight"), F.min("id").alias("first_id"))
    nodes = written(nodes.withColumnsRenamed({"key": "own", "key2": "own2"}).withColumn("key", F.monotonically_increasing_id()))
    n, width = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return ids.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    share = min(1.0, 0.97 * max_sample / n)
    sample = nodes.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * share) + 1).select("v").toArrow()
    x = _unit(_matrix(sample.column(0).combine_chunks(), width)) if len(sample) else np.eye(1, width)
    index = fit(x, min(n // LIST, (len(x) // 30) ** 2))
    held = spark.sparkContext.broadcast(index)
    across = float(np.sqrt(2 - 2 * cosine)) * min(1.0, probe_sigmas / width**0.5) + 1e-7

    @bk.task
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                own = batch.slice(at, 2000)
                u = _unit(_matrix(own.column(1), width))
                home, codes, error = held.value.encode(u)
                who, lists = held.value.probes(u, across)
                ends = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(u)))])
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(home.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(lists.astype(np.int32)))],
                    ["key", "v", "weight", "home", "codes", "error", "probes"],
                )

    coded = written(nodes.select("key", "v", "weight").mapInArrow(placed, f"key long, v {kind}, weight long, home int, codes binary, error double, probes array<int>"))
    # Both sides of a list are cut into blocks by its measured size; each block of members meets each block of queries.
    members = coded.groupBy(F.col("home").alias("list")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("member_blocks"))
    asking = coded.select("key", F.explode("probes").alias("list"))
    queries = asking.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks"))
    sizes = written(members.join(queries, "list"))
    if index.lists * 16 <= BROADCAST_BYTES:
        sizes = F.broadcast(sizes)
    block = lambda n, salt: F.pmod(F.xxhash64("key", F.lit(salt)), n).cast("int")
    columns = ["list", "mb", "qb", "member", "key", "weight", "v", "codes", "error"]
    as_members = (
        coded.withColumn("list", F.col("home")).join(sizes, "list").withColumn("mb", block(F.col("member_blocks"), 1))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))).withColumn("member", F.lit(True))
    )
    as_queries = (
        coded.withColumn("list", F.explode("probes")).join(sizes, "list").withColumn("qb", block(F.col("query_blocks"), 2))
        .withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("member_blocks") - 1))).withColumn("member", F.lit(False))
        .withColumn("codes", F.lit(None).cast("binary")).withColumn("error", F.lit(0.0))
    )
    met = as_members.select(*columns).union(as_queries.select(*columns)).groupBy("list", "mb", "qb")
    found = written(met.applyInArrow(_met(held, width, cosine), "a long, b long, n long"))

    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    labels = connected(found.where("b is not null").select("a", "b"))
    named = (
        nodes.select("own", "own2", "key", "weight", "first_id").join(counts, "key", "left")
        .join(labels.select(F.col("node").alias("key"), F.col("component").alias("comp")), "key", "left")
        .select("own", "own2", "first_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("comp", "key").alias("comp"))
    )
    named = written(named)
    names = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    by_key = written(named.join(names, "comp").select("own", "own2", "n_links", "component_id"))
    for table in (nodes, coded, found, named):
        release_table(table)
    out = ids.join(by_key, (F.col("key") == F.col("own")) & (F.col("key2") == F.col("own2")), "left")
    return out.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("id"), F.col("component_id").isNull()).alias("kept"),
    )
