"""Parts of written tokens that the classifiers read: words, word beginnings, and the marks around them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np

_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_REPEAT = "\0repeat"
#: Bytes of tokens (with what Python adds to each) remembered by a task; the memory starts anew when it is full.
TOKEN_BYTES = 64 << 20
_TOKEN_COST = 240
#: Texts up to this length are cut into tokens at once, longer ones run by run.
_AT_ONCE = 1 << 20
_RUN = 100_000
_TOKEN = re.compile(r"\S+")


def words_and_marks(token: str) -> list[str]:
    """The lower-case words of a token and a name for what else it is made of."""
    plain = token[:-1] if token[-1:] in (".", ",") else token
    if plain.isalpha():  # most tokens
        return ["w:" + plain.lower(), "s:upper"] if len(token) > 1 and token.isupper() else ["w:" + plain.lower()]
    if token == _REPEAT:
        return [token]
    words = _LETTERS.findall(token)
    marks = _DIGITS.sub("0", _LETTERS.sub("a", token))
    out = ["w:" + w.lower() for w in words]
    if marks not in ("a", "a.", "a,"):
        out.append("s:" + marks[:16])
    if words and len(token) > 1 and token.isupper():
        out.append("s:upper")
    return out


def with_beginnings(token: str) -> list[str]:
    """``words_and_marks`` and the beginnings of three to six letters of each word."""
    out = words_and_marks(token)
    for w in out[:]:
        if w[0] == "w":
            out += ["b:" + w[2:k] for k in range(5, min(9, len(w)))]
    return out


def token_runs(text: str | None) -> Iterator[list[str]]:
    """The tokens between white space, in runs of bounded number."""
    if len(text or "") <= _AT_ONCE:
        yield (text or "").split()
        return
    found = (m[0] for m in _TOKEN.finditer(text))
    while run := list(islice(found, _RUN)):
        yield run


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[k], starts[k] + 1, ...``, ``counts[k]`` numbers for each k."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class _Lists:
    """Lists of numbers, one after the other."""

    def __init__(self):
        self.flat, self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, lists: list[tuple[int, ...]]) -> None:
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in lists for i in x), np.int64, int(counts.sum()))])

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of the lists ``which``, and how many each has."""
        counts = self.counts[which]
        return self.flat[_spread(self.starts[which], counts)], counts


class Numbered:
    """Numbers the parts of tokens; a part without a number is left out. A word beginning (``b:``) that several different tokens
    share is a part of its own (``t:``). Texts are handled together: tokens are looked up, all else is arrays."""

    def __init__(self, parts: Callable[[str], list[str]], number: Callable[[str], int | None]):
        self.parts, self.number = parts, number
        self.repeat = self._numbers([_REPEAT])
        self._forget()

    def _forget(self) -> None:
        self.known, self.own, self.shared, self._held = {}, _Lists(), _Lists(), 0

    def _numbers(self, parts: list[str]) -> tuple[int, ...]:
        return tuple(i for p in parts if (i := self.number(p)) is not None)

    def _looked_up(self, tokens: list[str]) -> np.ndarray:
        if self._held > TOKEN_BYTES:
            self._forget()
        if new := list(set(tokens).difference(self.known)):
            parts = [self.parts(t) for t in new]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.own.add([self._numbers(p) for p in parts])
            beginnings = [[x for x in p if x[0] == "b"] for p in parts]
            self.shared.add([self._numbers(["t" + x[1:] for x in dict.fromkeys(b)]) if b else () for b in beginnings])
            self._held += sum(map(len, new)) + _TOKEN_COST * len(new)
        return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))

    def _runs(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For runs of tokens: each token's number, its text, and whether it equals the token before it in its text."""
        tokens: list[str] = []
        segments: list[tuple[int, int, bool]] = []
        before = None

        def settled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            which = self._looked_up(tokens)
            same = np.zeros(len(which), bool)
            same[1:] = which[1:] == which[:-1]
            at = 0
            for _, n, later in segments:
                if not later:
                    same[at] = False
                elif not at:
                    same[0] = tokens[0] == before
                at += n
            return which, np.repeat([k for k, _, _ in segments], [n for _, n, _ in segments]), same

        for k, text in enumerate(texts):
            later = False
            for run in token_runs(text):
                if run:
                    tokens += run
                    segments.append((k, len(run), later))
                    later = True
                if len(tokens) >= _RUN:
                    yield settled()
                    before = tokens[-1]
                    tokens, segments = [], []
        if tokens:
            yield settled()

    def sequences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all parts in reading order, and where each text's begin (and the last ends); a token equal to the one
        before also counts as a repeat."""
        flat, counts = [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
        for which, text, same in self._runs(texts):
            items, n = self.own.of(which)
            more = len(self.repeat) * same
            ends = np.cumsum(n + more)
            out = np.empty(int(ends[-1]), np.int64)
            out[_spread(ends - n - more, n)] = items
            if self.repeat:
                out[ends[same] - 1] = self.repeat[0]
            flat.append(out)
            counts += np.bincount(text, n + more, len(texts)).astype(np.int64)
        return np.concatenate(flat), np.concatenate([[0], np.cumsum(counts)])

    def distinct(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of each text's distinct parts in order, and where they begin (and the last end); the repeat counts from a
        fifth of the tokens on."""
        n, repeats = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        # Pairs of a text and a token, once each; of a text in several runs, the parts of each run.
        own, shared = [np.zeros((2, 0), np.int64)], [np.zeros((3, 0), np.int64)]
        for which, text, same in self._runs(texts):
            n += np.bincount(text, minlength=len(texts))
            repeats += np.bincount(text[same], minlength=len(texts))
            pair = np.unique(text * len(self.known) + which)
            text, which = np.divmod(pair, len(self.known))
            for lists, to, more in ((self.own, own, ()), (self.shared, shared, (which,))):
                items, many = lists.of(which)
                to.append(np.stack([np.repeat(text, many), items, *(np.repeat(x, many) for x in more)]))
        text, item, which = np.concatenate(shared, axis=1)
        text, item = self._twice(text, item, which)
        text, item = (np.concatenate([a, b]) for a, b in zip(np.concatenate(own, axis=1), (text, item), strict=True))
        if self.repeat:
            often = np.flatnonzero((5 * repeats >= n) & (n > 1))
            text, item = np.concatenate([text, often]), np.concatenate([item, np.full(len(often), self.repeat[0])])
        found = np.unique(np.stack([text, item]), axis=1) if len(text) else np.zeros((2, 0), np.int64)
        return found[1], np.searchsorted(found[0], np.arange(len(texts) + 1))

    @staticmethod
    def _twice(text: np.ndarray, item: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of a text and an item that come with more than one token."""
        order = np.lexsort((which, item, text))
        text, item, which = text[order], item[order], which[order]
        again = np.zeros(len(text), bool)
        again[1:] = (text[1:] == text[:-1]) & (item[1:] == item[:-1]) & (which[1:] != which[:-1])
        return text[again], item[again]


def flattened(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """One array of all items and where each list begins (and the last ends)."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return (np.concatenate([np.asarray(x, np.int64) for x in lists]) if lists else np.zeros(0, np.int64)), ends
