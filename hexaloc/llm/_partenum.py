"""PartEnum signatures for sets of hashes under a Jaccard threshold (Arasu et al., 2006).

Sets are banded by size. In a band of sizes up to r, two sets with a Jaccard index of at
least t differ in at most k = floor(2 r (1 - t) / (1 + t)) elements. The feature domain is
dealt into n1 partitions of n2 cells each by hashes of the elements. Some partition holds at
most k2 differences if n1 > k / (k2 + 1), so n2 - k2 of its cells are equal in both sets; each
such choice of cells, with the elements in it, is a signature. A set also signs in the next
band if a partner may be that large. So similar sets share a signature.

A set of size n differs from its partners in a band in d elements at most, fewer than k unless
it is among the largest. It signs in the first floor(d / (k2 + 1)) + 1 + spare partitions
only; spare is the same for the whole band, and n1 is that number for the largest sets. Of the
first f partitions, f being the smaller number of two similar sets, spare + 1 or more hold no
more than k2 differences.

Signatures without elements say little, and many sets would share them; so would those with
elements that are common in the corpus only. Call both hollow. A partition is thin in a set if
a choice of its cells can be hollow, that is if at most k2 cells have elements that aren't
common. With no more than spare thin partitions a set leaves out its hollow signatures, for a
partition remains that isn't thin; with more it signs them as well. If both sets have more,
they share the hollow ones. No pair is lost either way, and which elements count as common
doesn't matter, as long as all sets are told the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np

from hexaloc.llm._shingles import STEPS, U, mix, scaled


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int
    k: int
    n1: int
    n2: int
    k2: int

    @property
    def spare(self) -> int:
        return self.n1 - self.k // (self.k2 + 1) - 1


@dataclass(frozen=True)
class PartEnum:
    """percent: the threshold. ratio: of a band's largest to its smallest size, where bands are wide."""

    percent: int = 85
    ratio: float = 1.5

    def differences(self, high: int) -> int:
        return 2 * high * (100 - self.percent) // (100 + self.percent)

    def bands_upto(self, size: int) -> list[Band]:
        n = 1
        while (found := _bands(self, n))[-1].high < size:
            n *= 2
        return found

    def bands_of(self, size: int) -> list[Band]:
        """The band of a size, and the next if a similar set may be that large."""
        most = size * 100 // self.percent
        return [b for b in self.bands_upto(most) if b.low <= most and b.high >= size]

    def signatures(self, elements: np.ndarray, common: np.ndarray = np.zeros(0, U)) -> np.ndarray:
        """The signatures of a set, sorted and distinct; elements: its distinct hashes;
        common: hashes that are common in the corpus, sorted."""
        if not len(elements):
            return np.zeros(0, U)
        weights, rare = mix(elements * STEPS[5]), np.ones(len(elements), bool)
        if len(common):
            rare = common[np.minimum(np.searchsorted(common, elements), len(common) - 1)] != elements
        return np.unique(np.concatenate([self._in_band(elements, weights, rare, b) for b in self.bands_of(len(elements))]))

    def signed_partitions(self, size: int, b: Band) -> int:
        """How many of a band's partitions a set of that size signs in."""
        most = min(b.high, size * 100 // self.percent)
        d = (size + most) * (100 - self.percent) // (100 + self.percent)
        return min(b.n1, d // (b.k2 + 1) + 1 + b.spare)

    def _in_band(self, elements: np.ndarray, weights: np.ndarray, rare: np.ndarray, b: Band) -> np.ndarray:
        cells, first = b.n1 * b.n2, self.signed_partitions(len(elements), b)
        where = ((mix(elements + scaled(STEPS[6], b.number + 1)) >> U(32)) * U(cells) >> U(32)).astype(np.int64)
        if first < b.n1:
            cells = first * b.n2
            own = where < cells
            where, weights, rare = where[own], weights[own], rare[own]
        order = np.argsort(where, kind="stable")
        counts = np.bincount(where, minlength=cells)
        ends = np.cumsum(counts)
        running = np.zeros(len(where) + 1, U)
        np.cumsum(weights[order], out=running[1:])
        sums = (running[ends] - running[ends - counts]).reshape(first, b.n2)
        filled = np.bincount(where[rare], minlength=cells).reshape(first, b.n2) > 0
        choices = _choices(b.n2, b.k2)
        signed = sums @ choices if b.k2 else sums
        hollow = ~(filled @ choices.astype(bool)) if b.k2 else ~filled
        names = mix(np.arange(signed.size, dtype=U) + scaled(STEPS[7], b.number + 1)).reshape(signed.shape)
        out = mix(signed + names)
        thin = filled.sum(axis=1) <= b.k2
        return out[~hollow] if thin.sum() <= b.spare else out.ravel()


@lru_cache(64)
def _choices(n2: int, k2: int) -> np.ndarray:
    chosen = list(combinations(range(n2), n2 - k2))
    out = np.zeros((n2, len(chosen)), U)
    for i, c in enumerate(chosen):
        out[list(c), i] = 1
    return out


def thin_partitions(low: int, n1: int, n2: int, k2: int) -> float:
    """How many partitions of a set of low elements are thin, on average."""
    full = 1 - math.exp(-low / (n1 * n2))
    return n1 * sum(math.comb(n2, i) * full**i * (1 - full) ** (n2 - i) for i in range(k2 + 1))


@lru_cache(4096)
def partitions(low: int, k: int, elements: float = 2.5) -> tuple[int, int, int]:
    """n1, n2 and k2 of a band whose smallest sets have low elements and whose pairs differ in k.

    Spare partitions are added until the thin ones of the smallest sets, with two standard
    deviations, don't use them up, but no more than half as many again: each makes the cells
    smaller. Of the choices with enough elements to a signature the one with the fewest
    signatures is taken; where none has, that with the most elements to one, of those with no
    more than four signatures a difference."""
    if k <= 2:
        return 1, 1 if k == 0 else 6, k
    enough, others = [], []
    for k2 in (1, 2, 3):
        least = k // (k2 + 1) + 1
        for n2 in range(k2 + 2, k2 + 5):
            for n1 in range(least, least + least // 2 + 1):
                thin = thin_partitions(low, n1, n2, k2)
                each, signed = low / n1 * (n2 - k2) / n2, n1 * math.comb(n2, k2)
                others.append((signed > 4 * k + 12, -each, signed, (n1, n2, k2)))
                if thin + 2 * math.sqrt(thin) <= n1 - least + 0.5:
                    if each >= elements:
                        enough.append((signed, -each, (n1, n2, k2)))
                    break
    return min(enough)[-1] if enough else min(others)[-1]


@lru_cache(64)
def _bands(method: PartEnum, n: int) -> list[Band]:
    """The first n bands or so."""
    out: list[Band] = []
    low = 1
    while len(out) < n:
        if not out:
            high = next(r for r in range(1, 10_000) if method.differences(r + 1) > 0)
        else:
            step = next(r for r in range(low, 100 * low) if method.differences(r + 1) > method.differences(low))
            high = max(step, int((low - 1) * method.ratio), low * 100 // method.percent + 1)
        k = method.differences(high)
        out.append(Band(len(out), low, high, k, *partitions(low, k)))
        low = high + 1
    return out
