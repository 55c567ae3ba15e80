"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its distinct word shingles. Sizes are cut into bands so that two sets similar enough lie in
one band or in neighbours; each band gives a bound ``k`` on the elements by which such sets differ. The shingle domain
is hashed into first-level partitions, so many that at least one of them holds at most ``k2`` of the differing elements,
and each of those into ``n2`` second-level partitions; the signatures are the contents of every union of ``n2 - k2``
second-level partitions. Similar sets therefore share a signature of their common band.

Only partitions with content give signatures, and of those only the first ones: as many as the bound and one more, since before
the first that a similar pair has in common both can only have differing ones. A set whose partitions with content are too few
takes another hash seed as well; of a similar pair either set with enough of them is sufficient, so only two poor sets need the
next seed.

Sets that share a signature are candidates. Equal sets are one node from the start, told apart by 128 bits and numbered; shorter
keys only look candidates up. In a group of one signature, every set is first verified against the group's smallest one. What
that leaves in different components is compared within the group, in blocks, by short sketches that can only overlook
differences; members with a partner left are compared by their sets. Pairs never leave a task: only links that join components do.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import bytekernels as bk
from millrace.llm.common import connected, release, release_table, written

#: Members of a group, and bytes of their sets, that are a block; groups are compared block by block.
BLOCK = 2048
BLOCK_BYTES = 32 << 20
_SKETCH_MOST = 1 << 13
#: Keys and ids of candidates are broadcast up to this size, measured; beyond it, they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
_SEEDS = 8
#: Signatures that a task holds before it passes them on, and those that are brought together at a time.
_HELD_ROWS = 300_000
_MET_ROWS = 1_000_000
#: Tasks that bring signatures together; each goes through its parts one by one.
_MET_TASKS = 20_000
#: Of the groups that a node is in, the first ones that are told to its partners.
_TOLD = 24
_WORD = ~bk.SPACE


class Bands:
    """Size bands and the partition numbers of each, for a threshold of ``percent`` hundredths. The instance of a band
    holds the pairs whose smaller set lies in it; the larger one lies in it or in the next."""

    def __init__(self, percent: int, largest: int):
        low, self.starts, ends, self.percent = 1, [], [], percent
        while low <= largest or len(ends) < 2:
            self.starts.append(low)
            ends.append(low * 100 // percent)
            low = ends[-1] + 1
        self.starts_at, self.ends = np.array(self.starts), np.array(ends)
        self.k = self.differ(self.ends, self.ends * 100 // percent)
        # Small bounds: one of three parts may differ, which makes signatures longer. Large bounds: whole partitions.
        self.k2 = np.where((self.k > 0) & (self.k < 16), 1, 0)
        need = self.k // (self.k2 + 1) + 1
        # More partitions than needed, as about one in fifty is without content.
        self.n1 = np.where(self.k > 0, need + 2 + np.ceil(need / 50 + 3 * np.sqrt(need / 50)).astype(int), 1)
        self.n2 = np.where(self.k2 > 0, 3, 1)

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """By how many elements similar sets of these sizes differ at most."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts_at, sizes, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted by row and hash, and each row's number of them."""
    low = bk.LOWER[data]
    start, end, first = bk.words(low, offsets, _WORD)
    hashes = bk.SpanHash(low).of(start, end)
    count, rows = np.diff(first), len(offsets) - 1
    owner = np.repeat(np.arange(rows), count)
    grams, owners = [], []
    full = bk.gram_hash(hashes, n)
    if len(full):
        inside = owner[: len(full)] == owner[n - 1 :]
        grams.append(full[inside])
        owners.append(owner[: len(full)][inside])
    for m in range(1, n):
        short = np.flatnonzero(count == m)
        if len(short):
            grams.append(bk.gram_hash(hashes, m)[first[short]])
            owners.append(short)
    if not grams:
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    h, row = np.concatenate(grams), np.concatenate(owners)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
    return h[keep], np.bincount(row[keep], minlength=rows)


def set_keys(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of each set; equal sets, equal keys (0 for empty sets)."""
    at, out = np.concatenate([[0], np.cumsum(sizes)]), []
    for by, salt in ((bk.mix, 0x7F4A7C15), (bk.mix_again, 0x1CE4E5B9)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(by(h ^ np.uint64(salt)))])
        out.append(np.where(sizes > 0, by((sums[at[1:]] - sums[at[:-1]]) ^ sizes.astype(np.uint64)), np.uint64(0)))
    return out[0], out[1]


def sketch(h: np.ndarray, percent: int) -> bytes:
    """One byte for each part of a set cut into a power of two of parts, two to four for each difference allowed. Sets that
    differ by ``d`` elements have sketches that differ in ``d`` bytes at most, and sketches of halved length are had by
    adding up halves."""
    k = 2 * len(h) * (100 - percent) // (100 + percent)
    parts = min(_SKETCH_MOST, 1 << max(4, int(2 * k).bit_length()))
    mixed = bk.mix(h ^ np.uint64(0x94D049BB133111EB))
    sums = np.bincount((mixed & np.uint64(parts - 1)).astype(np.int64), ((mixed >> np.uint64(32)) & np.uint64(255)).astype(float), parts)
    return (sums.astype(np.int64) & 255).astype(np.uint8).tobytes()


def _folded(body: np.ndarray, parts: int) -> np.ndarray:
    while len(body) > parts:
        body = body[: len(body) // 2] + body[len(body) // 2 :]
    return body


def signatures(h: np.ndarray, sizes: np.ndarray, bands: Bands, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of sets as ``(row, signature)``. Bands without room for a difference give none: such sets
    are similar only if equal. ``family`` picks independent partitions."""
    rows, out = [], []
    own = bands.band(sizes)
    for step in (0, -1):
        instance = np.maximum(own + step, 0)
        # As the smaller set the partner may be larger by the threshold, as the larger one it lies in the band before.
        other = sizes * 100 // bands.percent if not step else np.minimum(bands.ends[instance], sizes)
        fits = (own + step >= 0) & (100 * other >= bands.percent * sizes)
        need = bands.differ(sizes, other) // (bands.k2[instance] + 1) + 1
        left = np.flatnonzero((sizes > 0) & fits & (bands.k[instance] > 0))
        for seed in range(_SEEDS):
            if not len(left):
                break
            last = seed == _SEEDS - 1
            chosen = np.zeros(len(sizes), bool)
            chosen[left] = True
            elements = h[np.repeat(chosen, sizes)]
            row = np.repeat(np.arange(len(left)), sizes[left])
            inst = instance[left]
            n1, n2, k2 = bands.n1[inst], bands.n2[inst], bands.k2[inst]
            width = n1 * n2
            base = np.concatenate([[0], np.cumsum(width)])
            salt = np.uint64((family * _SEEDS + seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
            mixed = bk.mix(elements ^ salt)
            slot = base[row] + ((mixed >> np.uint64(33)) % width[row].astype(np.uint64)).astype(np.int64)
            content, filled = np.zeros(base[-1], np.uint64), np.zeros(base[-1], np.int64)
            np.add.at(content, slot, bk.mix(mixed + np.uint64(0x2545F4914F6CDD1D)))
            np.add.at(filled, slot, 1)
            good = np.zeros(len(left), np.int64)
            for a, b in ((0, 1), (1, 3)):  # (k2, n2)
                mine = np.flatnonzero(k2 == a)
                if not len(mine):
                    continue
                first = np.repeat(base[mine], n1[mine]) + b * (np.arange(n1[mine].sum()) - np.repeat(np.cumsum(n1[mine]) - n1[mine], n1[mine]))
                who = np.repeat(mine, n1[mine])
                subsets = list(combinations(range(b), b - a))
                some = [sum(filled[first + j] for j in subset) > 0 for subset in subsets]
                full = np.logical_and.reduce(some)
                # Those before the last one needed; all of a set that does not have so many.
                so_far = np.concatenate([[0], np.cumsum(full)])
                starts = np.cumsum(n1[mine]) - n1[mine]
                early = so_far[:-1] - np.repeat(so_far[starts], n1[mine]) < need[left[who]]
                for c, subset in enumerate(subsets):
                    use = early & (some[c] | last)
                    total = sum((content[first[use] + j] for j in subset), np.zeros(int(use.sum()), np.uint64))
                    place = (first[use] - base[who[use]]).astype(np.uint64) * np.uint64(4) + np.uint64(c)
                    tag = bk.mix((instance[left[who[use]]].astype(np.uint64) << np.uint64(32)) + place + salt)
                    rows.append(left[who[use]])
                    out.append(bk.mix(total + tag))
                good += np.bincount(who[full], minlength=len(left))
            left = left[good < need[left]]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(out)


def _signed_column(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _arrow(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_signed_column(c) if c.dtype == np.uint64 else pa.array(c) for c in columns], names.split())


def _digest(n: int):
    @bk.task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in bk.slices(batch.column(1)):
                h, size = shingle_sets(data, offsets, n)
                key, more = set_keys(h, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), _signed_column(key), _signed_column(more), pa.array(size)], ["id", "key", "key2", "n"])

    return run


def _keyed(n: int):
    """Rows ``(key, key2, text)`` of texts."""

    @bk.task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in bk.slices(batch.column(0)):
                key, more = set_keys(*shingle_sets(data, offsets, n))
                yield pa.RecordBatch.from_arrays([_signed_column(key), _signed_column(more), batch.column(0).slice(at, to - at)], ["key", "key2", "text"])

    return run


def _packed(*columns: np.ndarray) -> pa.Array:
    """Rows of 64-bit numbers as one binary value; of the first column, a signature, the upper 48 bits."""
    parts = [np.ascontiguousarray(c.astype("<u8")).view(np.uint8).reshape(-1, 8) for c in columns]
    return pa.array([np.hstack([parts[0][:, 2:], *parts[1:]]).tobytes()], pa.binary())


def _unpacked(body: bytes, width: int) -> list[np.ndarray]:
    rows = np.frombuffer(body, np.uint8).reshape(-1, 6 + 8 * (width - 1))
    first = np.zeros((len(rows), 8), np.uint8)
    first[:, :6] = rows[:, :6]
    return [first.view("<u8")[:, 0]] + [np.ascontiguousarray(rows[:, 6 + 8 * k : 14 + 8 * k]).view("<u8")[:, 0] for k in range(width - 1)]


def _signed(n: int, percent: int, largest: int, parts: int):
    """Rows ``(part, body)``: signatures and keys, packed, of a run of documents for one part of the signatures. Nodes that
    share a signature within the run are tied to the smallest of them here (signature, key and pivot, packed, in rows of a
    negative part); only that one goes on to meet the others."""
    bands, most = Bands(percent, largest), min(2_000_000, max(_HELD_ROWS, 400 * parts))

    @bk.task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, keys, held = [], [], 0
        for batch in batches:
            for _, _, data, offsets in bk.slices(batch.column(0)):
                h, size = shingle_sets(data, offsets, n)
                row, sig = signatures(h, size, bands)
                sigs.append(sig)
                keys.append(set_keys(h, size)[0][row])
                held += len(sig)
                if held >= most:
                    yield from _dealt(np.concatenate(sigs), np.concatenate(keys), parts)
                    sigs, keys, held = [], [], 0
        if held:
            yield from _dealt(np.concatenate(sigs), np.concatenate(keys), parts)

    return run


def _ties(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different pairs of a signature and a key in order, which are the first of their signature, and the first's key."""
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    once = np.append(True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1]))[: len(sig)]
    sig, key = sig[once], key[once]
    new = np.append(True, sig[1:] != sig[:-1])[: len(sig)]
    return sig, key, new, key[new][np.cumsum(new) - 1]


def _dealt(sig: np.ndarray, key: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    sig, key, new, pivot = _ties(sig, key)
    row = lambda part, body: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), body], ["part", "body"])
    if not new.all():
        yield row(-1 - int(sig[0] % np.uint64(1 << 30)), _packed(sig[~new], key[~new], pivot[~new]))
    sig, key = sig[new], key[new]
    part = (sig % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
    for k in np.flatnonzero(np.diff(ends)):
        own = order[ends[k] : ends[k + 1]]
        yield row(int(k), _packed(sig[own], key[own]))


@bk.task
def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over whole parts, one after the other: rows ``(sig, key, pivot)`` that tie each node to the smallest of its signature; lone
    signatures go. A part has about ``_MET_ROWS`` signatures, each at most once for each run of documents."""

    def tied(bodies: list[bytes]) -> pa.RecordBatch:
        sig, key, new, pivot = _ties(*_unpacked(b"".join(bodies), 2))
        return _arrow("sig key pivot", sig[~new], key[~new], pivot[~new])

    now, bodies = -1, []
    for batch in batches:
        for part, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if part < 0:
                yield _arrow("sig key pivot", *_unpacked(body.as_py(), 3))
                continue
            if part != now and bodies:
                yield tied(bodies)
                bodies = []
            now = part
            bodies.append(body.as_py())
    if bodies:
        yield tied(bodies)


def _allowed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """By how many elements similar sets of these sizes differ at most; -1 where the sizes rule similarity out."""
    fits = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    return np.where(fits, (a + b) * (100 - percent) // (100 + percent), -1)


def _sketched(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that their sketches do not rule out."""
    left = sketches.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = sketches.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))

    @bk.task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b = (np.asarray(batch.column(k)) for k in range(4))
            most, good = _allowed(n_a, n_b, percent), np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                if most[i] >= 0:
                    x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                    parts = min(len(x), len(y))
                    good[i] = np.count_nonzero(_folded(x, parts) != _folded(y, parts)) <= most[i]
            yield _arrow("a b", a[good], b[good])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return joined.mapInArrow(run, "a long, b long")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    place = np.searchsorted(x, y)
    both = int((x[np.minimum(place, len(x) - 1)] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _uncovered(percent: int):
    """The members of a block that have a partner of fitting size in another component whom they do not meet in an earlier
    group (a row for each at most)."""

    def run(table: pa.Table) -> pa.Table:
        comp, n, part = (table.column(c).to_numpy() for c in ("comp", "n", "part"))
        group, low, high = (table.column(c)[0].as_py() for c in ("group", "low", "high"))
        told = table.column("told").combine_chunks()
        earlier, owner = np.asarray(told.flatten()), np.repeat(np.arange(len(comp)), np.asarray(told.value_lengths()))
        earlier, owner = earlier[earlier < group], owner[earlier < group]
        names, place = np.unique(earlier, return_inverse=True)
        open_, mine = np.zeros(len(comp), bool), np.flatnonzero(part == low)
        met = np.zeros((len(mine), len(comp)), bool)
        for first in range(0, len(names), 512):
            own = (place >= first) & (place < first + 512)
            inside = np.zeros((len(comp), 512), np.float32)
            inside[owner[own], place[own] - first] = 1
            for at in range(0, len(mine), 256):
                met[at : at + 256] |= inside[mine[at : at + 256]] @ inside.T > 0
        for at in range(0, len(mine), 256):
            i = mine[at : at + 256]
            pair = (part == high) & (comp != comp[i][:, None]) & (_allowed(n, n[i][:, None], percent) >= 0) & ~met[at : at + 256]
            open_[i] |= pair.any(1)
            open_ |= pair.any(0)
        return table.select(["group", "low", "high", "part", "node", "comp", "n"]).filter(pa.array(open_))

    return run


def _compared(percent: int, exact: bool):
    """Compares one block of a group. First pass: the members for which the sketches leave a partner in another component
    (a row for each at most). Second pass, over those members and with their sets (``exact``): links that join components
    of the block, one for each join."""

    def run(table: pa.Table) -> pa.Table:
        key, comp, n, part = (table.column(c).to_numpy() for c in ("node", "comp", "n", "part"))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        views = lambda c, t: [np.frombuffer(x.as_buffer(), t) for x in table.column(c).combine_chunks()]
        bodies, sets = views("sketch", np.uint8), views("set", np.uint64) if exact else []
        by_parts: dict[int, np.ndarray] = {}
        label, open_, links = np.unique(comp, return_inverse=True)[1], np.zeros(len(key), bool), []
        lengths = np.array([len(x) for x in bodies])
        for i in np.flatnonzero(part == low):
            others = np.flatnonzero((part == high) & (label != label[i]) & ((key < key[i]) | (low != high)))
            most = _allowed(n[others], n[i], percent)
            others, most = others[most >= 0], most[most >= 0]
            # A pair is compared at the shorter of its sketches.
            shorter = np.minimum(lengths[others], lengths[i])
            for parts in np.unique(shorter):
                if parts not in by_parts:
                    by_parts[parts] = np.stack([_folded(x, parts) if len(x) >= parts else np.zeros(parts, np.uint8) for x in bodies])
                own, mine = by_parts[parts], shorter == parts
                passed = others[mine][(own[others[mine]] != own[i]).sum(1) <= most[mine]]
                if not exact:
                    open_[passed] = True
                    open_[i] |= len(passed) > 0
                    continue
                for j in passed:
                    if label[j] != label[i] and _similar(sets[i], sets[j], percent):
                        links.append((max(key[i], key[j]), min(key[i], key[j])))
                        label[label == label[j]] = label[i]
        if exact:
            return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})
        return table.select(["group", "low", "high", "part", "node", "comp"]).filter(pa.array(open_))

    return run


def _few(df: DataFrame, row_bytes: int = 16) -> bool:
    """Whether a table of keys may be broadcast."""
    return df.count() * row_bytes <= BROADCAST_BYTES


def _only(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of the given nodes."""
    nodes = written(nodes.distinct())
    return sets.join(F.broadcast(nodes) if _few(nodes) else nodes, "node", "left_semi")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose sets are similar enough."""
    pairs = written(_sketched(pairs, sets.select("node", "n", "sketch"), percent))
    left = _only(sets, pairs.select(F.col("a").alias("node"))).select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = _only(sets, pairs.select(F.col("b").alias("node"))).select(F.col("node").alias("b"), F.col("set").alias("set_b"))

    @bk.task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            good = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                good[i] = _similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
            yield _arrow("a b", a[good], b[good])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` with their ``comp``; a node without links is its own."""
    named = nodes.join(labels.withColumnRenamed("component", "comp"), "node", "left")
    return named.withColumn("comp", F.coalesce("comp", "node"))


def _left_open(members: DataFrame, wanted: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among members of one signature that lie in different components."""
    known = written(_labelled(wanted.select("key", "node", "n"), labels))
    pivots = known.select(*(F.col(c).alias("pivot" if c == "key" else f"pivot_{c}") for c in known.columns))
    named = members.join(known, "key").join(pivots, "pivot")
    split = named.where("comp <> pivot_comp").select("sig").distinct()
    both = named.select("sig", "node", "n").union(named.select("sig", "pivot_node", "pivot_n"))
    groups = written(both.join(split, "sig", "left_semi").distinct())
    # Sets that share one signature often share many: groups of the same members are compared once,
    same = groups.groupBy("sig").agg(F.count("*").alias("m"), F.sum("n").alias("size"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y"))
    chosen = same.groupBy("m", "size", "x", "y").agg(F.min("sig").alias("sig"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, 8 * F.col("size") / BLOCK_BYTES)).cast("int")
    chosen = written(chosen.select("sig", blocks.alias("blocks"), F.monotonically_increasing_id().alias("group")))
    rows = written(groups.join(chosen, "sig").drop("sig"))
    # and two members in the first group that both are in, as far as they know of each other's.
    told = rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("group")), 1, _TOLD).alias("told"))
    told = told.join(known.select("node", "comp").distinct(), "node")
    blocks = rows.join(told, "node").withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), "blocks").cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("blocks", "other")
    by, member = ("group", "low", "high"), "group long, low int, high int, part int, node long, comp long"
    first = written(blocks.groupBy(*by).applyInArrow(_uncovered(percent), member + ", n long"))
    short = first.join(_only(sets.select("node", "sketch"), first.select("node")), "node")
    few = written(short.groupBy(*by).applyInArrow(_compared(percent, False), member))
    for table in (groups, chosen, rows, known):
        release_table(table)
    long = few.join(_only(sets, few.select("node")), "node")
    return long.groupBy(*by).applyInArrow(_compared(percent, True), "a long, b long").distinct()


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
) -> DataFrame:
    """``(id, n_shingles, component_id)`` for each row of ``docs``.

    Words are the runs without ``[\\x20\\x09-\\x0D]`` after lowering A-Z; a document's set holds its distinct shingles of
    ``shingle`` words, or the whole sequence as one where it has fewer. Two documents link when the intersection makes up
    ``percent`` hundredths of the union or more; ``component_id`` is the smallest id reachable by links, itself included.
    Documents without words or text have an empty set and link with nothing. Equal texts are linked at once and never
    expanded into pairs; rows that repeat an id keep their rows. A text without an id links like any other; a null id is a component's name only where
    no member has an id. ``docs`` is read several times.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    digest = written(source.mapInArrow(_digest(shingle), f"id {id_type}, key long, key2 long, n long"))
    # A node for each different set. Its first row is the one with the smallest id, rows without an id coming last.
    rows = digest.where("n > 0").groupBy("key", "key2", "id").agg(F.count("*").alias("copies"), F.max("n").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "copies"))
    nodes = rows.groupBy("key", "key2").agg(first.alias("first"), F.max("n").alias("n"))
    nodes = written(nodes.select("key", "key2", "n", F.col("first.id").alias("first_id"), F.col("first.copies").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    total, largest = digest.agg(F.sum("n"), F.max("n")).first()
    bands_of = (percent, int(largest or 1))

    # About as many signatures as a pair of sets may differ by, in two bands; dealt into parts that are sorted in memory.
    expected = 4 * (total or 0) * (100 - percent) // (100 + percent)
    parts = max(1, expected // _MET_ROWS + 1)
    signed = source.select("text").mapInArrow(_signed(shingle, *bands_of, 3 * parts), "part int, body binary")
    dealt = signed.repartition(min(parts, _MET_TASKS), "part").sortWithinPartitions("part")
    members = written(dealt.mapInArrow(_met, "sig long, key long, pivot long"))
    release(docs.sparkSession)

    # The sets of the candidates, from the text of their first document.
    tied = members.select("key", "pivot").distinct()
    asked = tied.select("key").union(tied.select("pivot")).distinct()
    wanted = written(nodes.join(asked, "key", "left_semi").select("key", "key2", "node", "n", F.col("first_id").alias("id"), "copies"))
    size = wanted.agg(F.sum(32 + F.coalesce(F.length(F.col("id").cast("string")), F.lit(0)))).first()[0] or 0
    held = F.broadcast if size <= BROADCAST_BYTES else lambda df: df
    picked = source.join(held(wanted.select("id").distinct()), "id", "left_semi").select("text")
    repeated = not wanted.where("id is not null and copies > 1").isEmpty()
    # Texts that stand only in rows without an id are picked by their key, once each.
    unnamed = wanted.where("id is null").select("key", "key2")
    if not unnamed.isEmpty():
        keyed = source.where("id is null").select("text").mapInArrow(_keyed(shingle), "key long, key2 long, text string")
        found = keyed.join(held(unnamed), ["key", "key2"], "left_semi")
        picked = picked.union(found.dropDuplicates(["key", "key2"]).select("text"))

    @bk.task
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in bk.slices(batch.column(0)):
                h, size = shingle_sets(data, offsets, shingle)
                at = np.concatenate([[0], np.cumsum(size)])
                own = [h[at[k] : at[k + 1]] for k in range(len(size))]
                body, short = [x.tobytes() for x in own], [sketch(x, percent) for x in own]
                columns = [*map(_signed_column, set_keys(h, size)), pa.array(size), pa.array(short, pa.binary()), pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "key2", "n", "sketch", "set"])

    # A repeated id may bring other texts: only those asked for stay, and each once.
    sets = picked.mapInArrow(sets_of, "key long, key2 long, n long, sketch binary, set binary")
    sets = sets.join(held(wanted.select("key", "key2", "node")), ["key", "key2"]).select("node", "n", "sketch", "set")
    sets = written(sets.dropDuplicates(["node"]) if repeated else sets)

    by_key = wanted.select("key", "node")
    stars = tied.join(by_key, "key").select("pivot", F.col("node").alias("a")).join(by_key.select(F.col("key").alias("pivot"), F.col("node").alias("b")), "pivot")
    links = written(_verify(stars.where("a <> b").select("a", "b"), sets, percent))
    labels = written(connected(links))
    more = written(_left_open(members, wanted, labels, sets, percent))
    for table in (members, sets, wanted):
        release_table(table)
    if not more.isEmpty():
        labels = written(connected(links.union(more)))

    named = written(_labelled(nodes.select("key", "key2", "node", "first_id"), labels))
    names = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    own = written(named.join(names, "comp").select(F.col("key").alias("own"), F.col("key2").alias("own2"), "component_id"))
    for table in (nodes, named, links, more, labels):
        release_table(table)
    same = (F.col("key") == F.col("own")) & (F.col("key2") == F.col("own2")) & (F.col("n") > 0)
    return digest.join(own, same, "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
