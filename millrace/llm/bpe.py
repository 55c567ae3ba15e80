"""Byte-level BPE encoding and decoding: speculate and verify.

A text is cut at added tokens and by the byte-level pattern into words. For words not seen before, greedy longest match
proposes tokens; all adjacent pairs of the proposals are tested together against a table of compatible pairs, a pair being
compatible if merging its joined bytes gives just that pair. A proposal whose pairs are all compatible is the encoding;
only the other words are merged by rank, exactly. Words of a batch are then replaced by their tokens with array lookups.

The vocabulary file is a parameter; it is read on the driver and sent to the tasks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm import bytekernels as bk

#: The byte-level pre-tokenizer's pattern (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of words (with what Python adds to each) and pairs remembered by a task; the memory starts anew when it is full.
WORD_BYTES = 80 << 20
PAIR_MEMORY = 500_000
_WORD_COST = 240
#: Texts up to this length are cut into words at once, longer ones run by run.
_AT_ONCE = 1 << 20
_RUN = 100_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, reversed."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Token bytes, merge ranks and added tokens of a byte-level BPE file; small enough to send to every task."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            body = file.read()
        spec, self.name = json.loads(body), hashlib.sha256(body).hexdigest()
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {as_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = as_bytes(a), as_bytes(b)
            self.ranks[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])


class Encoder:
    """Encodes and decodes; one for each task, whose memory goes with it."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.bytes_of = {i: b for b, i in v.ids.items()} | {i: s.encode() for s, i in v.added.items()}
        self.byte_id = [v.ids[bytes([b])] for b in range(256)]
        # The greedy match tries no length above the longest token with the same two first bytes.
        self.longest: dict[bytes, int] = {}
        for b in v.ids:
            self.longest[b[:2]] = max(len(b), self.longest.get(b[:2], 1))
        self.pattern = regex.compile(PATTERN)
        names = sorted(v.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(regex.escape(n) for n in names) + ")") if names else None
        lengths = np.array([len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)])
        self._at = np.concatenate([[0], np.cumsum(lengths)])
        self._blob = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(lengths))), np.uint8)
        self._forget()
        self._forget_pairs()

    def _forget(self) -> None:
        added = self.vocabulary.added
        self.number: dict[str, int] = {"\0" + name: k for k, name in enumerate(added)}  # no word holds both a NUL and letters
        self._lengths, self._tokens = np.ones(len(added), np.int64), np.array(list(added.values()), np.uint32)
        self._starts, self._held = np.arange(len(added)), 0

    def _forget_pairs(self) -> None:
        self._pairs, self._fits = np.zeros(0, np.int64), np.zeros(0, bool)

    def merged(self, word: bytes) -> list[int]:
        """The exact encoding: the pair of lowest rank merges first, the leftmost of equals; time n log n."""
        ranks = self.vocabulary.ranks
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], k, r[1]) for k in range(n - 1) if (r := ranks.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, k, new = heapq.heappop(heap)
            nxt = after[k] if ids[k] >= 0 else n
            if nxt >= n or (r := ranks.get((ids[k], ids[nxt]))) is None or r != (rank, new):
                continue
            ids[k], ids[nxt] = new, -1
            after[k] = far = after[nxt]
            if far < n:
                before[far] = k
                if r := ranks.get((new, ids[far])):
                    heapq.heappush(heap, (r[0], k, r[1]))
            if (left := before[k]) >= 0 and (r := ranks.get((ids[left], new))):
                heapq.heappush(heap, (r[0], left, r[1]))
        return [i for i in ids if i >= 0]

    def greedy(self, word: bytes) -> list[int]:
        ids, out, at, n = self.vocabulary.ids, [], 0, len(word)
        if (whole := ids.get(word)) is not None:
            return [whole]
        longest = self.longest
        while at < n:
            to = min(n, at + longest.get(word[at : at + 2], 1))
            while (i := ids.get(word[at:to])) is None:
                to -= 1
            out.append(i)
            at = to
        return out

    def _compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For each packed pair, whether its joined bytes encode to just that pair."""
        asked = np.unique(pairs)
        known = np.zeros(len(asked), bool)
        if len(self._pairs):
            known = self._pairs[np.minimum(np.searchsorted(self._pairs, asked), len(self._pairs) - 1)] == asked
        new = asked[~known]
        if len(new):
            if len(self._pairs) + len(new) > PAIR_MEMORY and len(self._pairs):
                self._forget_pairs()
                new = asked
            fits = np.zeros(len(new), bool)
            for k, p in enumerate(new.tolist()):
                a, b = p >> 32, p & 0xFFFFFFFF
                fits[k] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            both = np.concatenate([self._pairs, new])
            order = np.argsort(both)
            self._pairs, self._fits = both[order], np.concatenate([self._fits, fits])[order]
        return self._fits[np.searchsorted(self._pairs, pairs)]

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        proposed = [self.greedy(b) for b in raw]
        lengths = np.array([len(p) for p in proposed])
        flat = np.fromiter((i for p in proposed for i in p), np.int64, int(lengths.sum()))
        if not len(flat):
            return
        owner = np.repeat(np.arange(len(words)), lengths)
        inside = owner[1:] == owner[:-1]
        pairs = (flat[:-1] << 32 | flat[1:])[inside]
        if len(pairs):
            for k in np.unique(owner[:-1][inside][~self._compatible(pairs)]).tolist():
                proposed[k] = self.merged(raw[k])
        self._held += sum(map(len, words)) + sum(map(len, proposed)) * 4 + _WORD_COST * len(words)
        self.number.update(zip(words, range(len(self._lengths), len(self._lengths) + len(words)), strict=True))
        lengths = np.array([len(p) for p in proposed])
        self._starts = np.concatenate([self._starts, len(self._tokens) + np.cumsum(lengths) - lengths])
        self._lengths = np.concatenate([self._lengths, lengths])
        self._tokens = np.concatenate([self._tokens, np.fromiter((i for p in proposed for i in p), np.uint32, int(lengths.sum()))])

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, in runs of bounded number; an added token stands as itself after a NUL."""
        whole = not self.cut or not any(name in text for name in self.vocabulary.added)
        for k, part in enumerate([text] if whole else self.cut.split(text)):
            if k % 2:
                yield ["\0" + part]
            elif len(part) <= _AT_ONCE:
                yield self.pattern.findall(part)
            else:
                found = (m[0] for m in self.pattern.finditer(part))
                while run := list(islice(found, _RUN)):
                    yield run

    def _tokens_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of some words, and where each word's begin (and the last ends)."""
        if self._held > WORD_BYTES:
            self._forget()
        if new := list(set(words).difference(self.number)):
            self._learn(new)
        number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        count = self._lengths[number]
        ends = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(ends[-1]) + np.repeat(self._starts[number] - ends[:-1], count)
        return self._tokens[at], ends

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids, and where each text's begin (and the last ends)."""
        # Words of short texts are looked up together; when many have come together, what there is becomes tokens.
        tokens, counts, waiting, owner = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64), [], []

        def settle() -> None:
            own, ends = self._tokens_of([w for ws in waiting for w in ws])
            tokens.append(own)
            np.add.at(counts, owner, np.diff(ends[np.concatenate([[0], np.cumsum([len(ws) for ws in waiting])]).astype(np.int64)]))
            waiting.clear()
            owner.clear()

        held = 0
        for k, text in enumerate(texts):
            for run in self.words(text) if text else ():
                waiting.append(run)
                owner.append(k)
                held += len(run)
                if held >= 4 * _RUN:
                    settle()
                    held = 0
        if waiting:
            settle()
        return np.concatenate(tokens), np.concatenate([[0], np.cumsum(counts)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens; bytes that are not UTF-8 become replacement characters."""
        parts = []
        for k in range(0, len(ids), 10 * _RUN):
            own = ids[k : k + 10 * _RUN].astype(np.int64)
            count = self._at[own + 1] - self._at[own]
            ends = np.cumsum(count)
            parts.append(self._blob[np.arange(ends[-1]) + np.repeat(self._at[own] - (ends - count), count)].tobytes())
        return b"".join(parts).decode("utf-8", "replace").encode()


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", decode: bool = False, ids: bool = True) -> DataFrame:
    """Every column of ``docs`` with ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers),
    ``input_ids`` if ``ids``, and ``decoded`` if ``decode``.

    Added tokens that occur in a text become their ids; none are put around it. A null text is read as empty and has no
    tokens. Input columns named like the new ones are replaced; equal rows stay apart. Rows stay where they are: there is no
    shuffle. Beside a batch, a task holds its text of the moment, the tokens of it, and a memory of bounded bytes.
    """
    new = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType())]
    new += [("input_ids", T.ArrayType(T.IntegerType(), False))] * ids + [("decoded", T.StringType())] * decode
    docs = docs.drop(*(n for n, _ in new))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(*x) for x in new)])
    text_at, names = docs.columns.index(text_col), schema.names
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_path))

    @bk.task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value)
        for batch in batches:
            for at, texts in bk.texts(batch.column(text_at)):
                tokens, ends = encoder.encode(texts)
                own = [tokens[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                columns = [pa.array(np.diff(ends).astype(np.int64)), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own], pa.string())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens.view(np.int32))))
                if decode:
                    columns.append(pa.array([encoder.decode(x).decode() for x in own], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns, *columns], names)

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, tokenizer_path: str, ids_col: str = "input_ids") -> DataFrame:
    """Every column of ``tokens`` with ``decoded``, the text of ``ids_col``. Null or empty lists give an empty text."""
    tokens = tokens.drop("decoded")
    schema = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType())])
    at = tokens.columns.index(ids_col)
    held = tokens.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_path))

    @bk.task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value)
        for batch in batches:
            out = [encoder.decode(np.array(x.as_py() or [], np.int64)).decode() for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], schema.names)

    return tokens.mapInArrow(run, schema)
