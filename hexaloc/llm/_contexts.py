"""Tokens of many texts in given contexts, found by hashes in numpy.

A context (pattern) is the two words before a token and the one after, lowered, with digits as 0.
Every word and token gets a hash modulo 2**64 of its characters and their neighbours; equal normal
forms have equal hashes, so none is missed. Hits are written out from the text, and the caller
compares them as strings, so a clash of hashes gives nothing wrong.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from functools import lru_cache

import numpy as np

DIGIT = re.compile(r"[0-9]")
#: What may fill the slot of a context: a run of word characters and these, ...
JOINTS = "@.%+/:-"
#: ... without these at its ends.
ENDS = ".:/-@%+_"
#: A character beyond Unicode: a word of its own with hash 0, two of them around each text.
EDGE = 0x110000
SPACE, WORD, RUN, CORE = 1, 2, 4, 8
SALT = 0x9E3779B97F4A7C15
#: What sets the three words of a pattern apart.
PLACES = np.array([0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAAAAAAAAAAAAAAAB], np.uint64)


def normal(word: str) -> str:
    return DIGIT.sub("0", word.lower())


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, and hash values as they are and in normal form, of each character."""
    every = "".join(map(chr, range(EDGE)))
    kind = np.zeros(EDGE + 1, np.uint8)
    kind[[m.start() for m in re.finditer(r"\s", every)]] = SPACE
    kind[[m.start() for m in re.finditer(r"\w", every)]] = WORD | RUN | CORE
    kind[[ord(c) for c in JOINTS]] |= RUN
    kind[[ord(c) for c in ENDS]] &= 255 - CORE
    form = np.arange(EDGE + 1)
    for i, c in enumerate(every):
        if c.lower() != c:
            form[i] = ord(c.lower()[0])  # only U+0130 has a second one, which is not counted
    form[[ord(c) for c in "123456789"]] = ord("0")
    form[ord("ς")] = ord("σ")  # which one a capital becomes depends on its neighbours
    x = np.arange(1, EDGE + 2, dtype=np.uint64) * np.uint64(SALT)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x[EDGE] = 0
    return kind, x, x[form]


class _Hashes:
    """Hashes of any parts of a sequence of characters, from prefix sums over its pairs of neighbours."""

    def __init__(self, points: np.ndarray, values: np.ndarray):
        self.own = values.take(points)
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.multiply(self.own[1:], self.own[:-1] ^ np.uint64(SALT), out=self.sums[2:])
        np.cumsum(self.sums, out=self.sums)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.sums[ends] - self.sums[starts + 1] + self.own[starts] * np.uint64(SALT)


def _points(texts: bytes) -> np.ndarray:
    return np.frombuffer(texts, "<u4").astype(np.intp)


def _utf32(text: str) -> bytes:
    return text.encode("utf-32-le", "surrogatepass")


def _each(strings: Collection[str], values: np.ndarray) -> np.ndarray:
    """The strings' hashes; those of empty ones are 0."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    out, some, ends = np.zeros(len(sizes), np.uint64), sizes > 0, np.cumsum(sizes)
    if some.any():
        out[some] = _Hashes(_points(_utf32("".join(strings))), values).of((ends - sizes)[some], ends[some])
    return out


def pattern_hashes(patterns: Collection[str]) -> np.ndarray:
    words = [([*p.split(" ")[:-2], p.split(" ")[-1]]) for p in patterns]
    words = [["", ""][: 3 - len(w)] + w for w in words]
    # normal forms of U+0130 hold a second character, which no other word of several characters holds
    words = [[x.replace("\u0307", "") if len(x) > 1 else x for x in w] for w in words]
    found = _each([x for w in words for x in w], _tables()[2]).reshape(-1, 3)
    return np.unique((found * PLACES).sum(axis=1, dtype=np.uint64))


def instance_hashes(instances: Collection[str]) -> np.ndarray:
    return np.unique(_each(instances, _tables()[1]))


class Members:
    """A set of hashes; most others fail a test of 20 bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.first = hashes, np.zeros(1 << 20, bool)
        self.first[(hashes >> np.uint64(44)).astype(np.intp)] = True

    def where(self, x: np.ndarray) -> np.ndarray:
        """Places of the members in x."""
        if not len(self.hashes):
            return np.zeros(0, np.intp)
        at = np.flatnonzero(self.first.take((x >> np.uint64(44)).astype(np.intp)))
        near = self.hashes.take(np.searchsorted(self.hashes, x[at]), mode="clip")
        return at[near == x[at]]


def _runs(flags: np.ndarray, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of flagged places; places that stand alone are runs of one."""
    before, after = flags.copy(), flags.copy()
    before[1:] &= ~flags[:-1]
    after[:-1] &= ~flags[1:]
    if alone is not None:
        before |= alone
        after |= alone
    return np.flatnonzero(before), np.flatnonzero(after) + 1


def slots(texts: list[str], patterns: Members, instances: Members) -> Iterator[tuple[int, int, int, str]]:
    """(text, start, end, pattern) of the tokens whose pattern is one of patterns or that are one of
    instances, by their hashes, in order."""
    kinds, raw, folded = _tables()
    edge = np.full(2, EDGE, "<u4").tobytes()
    points = _points(edge + b"".join(_utf32(t) + edge for t in texts))
    kind = kinds.take(points)
    word = kind & WORD > 0
    starts, ends = _runs(word, kind & (WORD | SPACE) == 0)
    runs = _runs(kind & RUN > 0)[0]
    left, right = _runs(kind & CORE > 0)
    if not len(left):
        return
    # a token reaches from the first to the last block of core characters in a run
    run = np.searchsorted(runs, left, "right")
    new = run[1:] != run[:-1]
    left, right = left[np.r_[True, new]], right[np.r_[new, True]]
    own, follows = np.searchsorted(starts, left, "right") - 1, np.searchsorted(starts, right - 1, "right")
    hits = []
    if len(patterns.hashes):
        each = _Hashes(points, folded).of(starts, ends)
        hits.append(patterns.where(each[own - 2] * PLACES[0] + each[own - 1] * PLACES[1] + each[follows] * PLACES[2]))
    if len(instances.hashes):
        hits.append(instances.where(_Hashes(points, raw).of(left, right)))
    hit = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.intp)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes + 2) - sizes
    row = np.searchsorted(first, left[hit], "right") - 1
    at = first[row]
    places = (own[hit] - 2, own[hit] - 1, follows[hit])
    words = [x for i in places for x in ((starts[i] - at).tolist(), (ends[i] - at).tolist())]
    for r, s, e, a, b, c, d, f, g in zip(row.tolist(), (left[hit] - at).tolist(), (right[hit] - at).tolist(), *words):
        t = texts[r]
        before = [normal(t[x:y]) for x, y in ((a, b), (c, d)) if x >= 0]
        yield r, s, e, " ".join(before) + " _ " + normal(t[f:g])
