"""Word shingles of whole texts as 64-bit hashes, in numpy.

Words are runs of bytes other than space and U+0009 to U+000D, with A-Z lower-cased. A
word's hash is a polynomial over its bytes modulo 2**64, then mixed; a shingle's hash
combines its words' hashes. Two different shingles share a hash with odds of about 2**-64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25], U)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(1, 257, dtype=U)
LOWER[65:91] += U(32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def scaled(step: np.uint64, by: int) -> np.uint64:
    """step * by modulo 2**64."""
    return U(int(step) * by & (1 << 64) - 1)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, U), np.full(n, BASE_INVERSE, U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words start (one more entry than texts)."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data, offsets = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[lo:hi], offsets - lo
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    space = IS_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before, after = cut[:-1].copy(), cut[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    before[0] = after[-1] = True
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    up, down = _powers(1 << max(18, n.bit_length()))
    total = np.zeros(n + 1, U)
    np.cumsum(LOWER[data] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * STEPS[4])
    return hashes, np.searchsorted(starts, offsets)


def sets_of(texts: pa.Array, width: int = 4, block: int = 1 << 18):
    """For each text, the sorted distinct hashes of its shingles of so many words.

    A text with fewer words has its whole sequence as its one shingle, one without words none."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    at = 0
    while at < len(texts):
        upto, size = at + 1, int(sizes[at])
        while upto < len(texts) and size + sizes[upto] <= block:
            size += int(sizes[upto])
            upto += 1
        words, starts = word_hashes(texts.slice(at, upto - at))
        n = max(0, len(words) - width + 1)
        every = np.zeros(n, U)
        for k in range(width):
            every += words[k : k + n] * STEPS[k]
        every = mix(every)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if b - a >= width:
                own = np.sort(every[a : b - width + 1])
                keep = np.ones(len(own), bool)
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                yield own[keep]
            elif b > a:
                yield mix(np.sum(words[a:b] * STEPS[: b - a], keepdims=True) + scaled(STEPS[7], b - a))
            else:
                yield np.zeros(0, U)
        at = upto
