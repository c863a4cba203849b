"""SentencePiece encoding with seeded merge-dropout, and decoding without loss.

Encoding merges adjacent pieces by the vocabulary's order, from an agenda (a heap of
candidate merges, best piece first, leftmost first). Each candidate that comes up is skipped
with odds of ``dropout``, decided by a keyed hash of the seed, the text, the part's place in it
and the candidate's turn, so the same call gives the same pieces anywhere, and every occurrence
of a part draws its own skips. Odds of 0 give the usual encoding.

No merge crosses a place between two characters that no piece holds side by side, as before a
space mark or between a letter and most marks. The vocabulary tells which; a text is cut
there, and each part is encoded by itself. What a part gives without skips is kept, for a
bounded number of parts. Occurrences with a skip among those candidates are merged anew, each
with its own skips, many at once in numpy: one candidate of each in a step.

Decoding joins the pieces' bytes. Characters that the vocabulary lacks, and the space mark
itself where a text holds it, are written as byte pieces, so every text decodes to itself.

Defined results: null and empty texts have no pieces, and decode to an empty text; equal texts
have equal pieces; repeated rows stay; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hexaloc.llm._shared import slices

MARK = "▁"
#: Stands for no merge; above any order, place and id (in an agenda: order << 32 | place << 24 | id).
NEVER = (1 << 63) - 1
#: Parts with more characters are merged one by one.
WIDEST = 32
#: The pieces of a part, and how many candidate merges came up.
Merged = tuple[list[int], int]


@dataclass(frozen=True)
class Dropout:
    odds: float = 0.1
    seed: int = 41


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, each piece's order among merges, and the first id after the byte pieces <0x00> to <0xFF>."""

    pieces: tuple[str, ...]
    orders: tuple[int, ...]
    first: int

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = tuple(m.id_to_piece(i) for i in range(m.vocab_size()))
        orders = tuple(round(-m.get_score(i)) for i in range(len(pieces)))
        return Vocabulary(pieces, orders, next(i for i in range(len(pieces)) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))))


def pairs_in(pieces: tuple[str, ...], width: int = 0x2600) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character below width that a piece holds (0: none does, 1: other
    characters), and whether a piece holds two characters, by their numbers, side by side."""
    chars = sorted({c for p in pieces for c in p if ord(c) < width})
    number = np.zeros(width + 1, np.int32)
    number[[ord(c) for c in chars]] = np.arange(2, len(chars) + 2)
    number[width] = 1
    joined = np.zeros((len(chars) + 2, len(chars) + 2), bool)
    for p in pieces:
        n = [number[min(ord(c), width)] for c in p]
        joined[n[:-1], n[1:]] = True
    joined[1, 1:] = joined[1:, 1] = True
    return number, joined


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash (the finaliser of splitmix64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def skips(keys: np.ndarray, turns: np.ndarray, limit: int) -> np.ndarray:
    """Whether the candidate of each turn is skipped, by the keyed hash."""
    return mixed(keys + (turns + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32) < limit


def any_skip(keys: np.ndarray, turns: np.ndarray, limit: int) -> np.ndarray:
    """Whether any of each key's first turns is skipped."""
    owner = np.repeat(np.arange(len(turns)), turns)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(turns) - turns, turns)
    return np.bincount(owner[skips(keys[owner], turn, limit)], minlength=len(turns)) > 0


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., for each start so many numbers."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


class Pairs:
    """What two pieces make: a hash table in numpy, from both ids to order << 32 | id."""

    def __init__(self, made: dict[tuple[int, int], int]):
        self.bits = max(8, (4 * len(made)).bit_length())
        self.key, self.value = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER)
        left = np.array([a << 32 | b for a, b in made], np.int64)
        values = np.array(list(made.values()), np.int64)
        at = self._first(left)
        while len(left):
            # of those that want one free place the last gets it; the others try the next
            free = self.key[at] < 0
            self.key[at[free]] = left[free]
            got = self.key[at] == left
            self.value[at[got]] = values[got]
            left, values, at = left[~got], values[~got], at[~got] + 1 & (1 << self.bits) - 1

    def _first(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def candidates(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Each merge as an agenda holds it, or NEVER; negative ids make nothing."""
        key = a.astype(np.int64) << 32 | b
        at = self._first(key)
        held = self.key[at]
        out = np.where((held == key) & (a >= 0) & (b >= 0), self.value[at], NEVER)
        rest = np.flatnonzero((held != key) & (held >= 0) & (a >= 0) & (b >= 0))
        while len(rest):
            at[rest] = at[rest] + 1 & (1 << self.bits) - 1
            held = self.key[at[rest]]
            found = held == key[rest]
            out[rest[found]] = self.value[at[rest[found]]]
            rest = rest[~found & (held >= 0)]
        return out | place << 24  # NEVER stays as it is


class Codec:
    def __init__(self, vocabulary: Vocabulary, dropout: Dropout, cache: int = 60_000):
        pieces, orders, first = vocabulary.pieces, vocabulary.orders, vocabulary.first
        self.ids = {p: i for i, p in enumerate(pieces) if i >= first}
        #: ids of a left and a right piece -> the piece that they make
        self.made: dict[tuple[int, int], int] = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    self.made[a, b] = i
        self.order = orders
        if max(orders) >= 1 << 31 or len(pieces) >= 1 << 24:
            raise ValueError("orders must be below 2 ** 31, ids below 2 ** 24")
        self.pairs = Pairs({k: orders[i] << 32 | i for k, i in self.made.items()})
        self.number, self.joined = pairs_in(pieces[first:])
        at = pieces.index("<0x00>")
        self.byte_ids = list(range(at, at + 256))
        self.bytes_of = [p.replace(MARK, " ").encode() if i >= first else b"" for i, p in enumerate(pieces)]
        for b in range(256):
            self.bytes_of[at + b] = bytes([b])
        self.dropout, self.limit = dropout, int(dropout.odds * (1 << 32))
        self.cache = cache
        self._forget()

    def _forget(self) -> None:
        """Start over with the known parts: "" stands for a space mark of the text's own."""
        own = [self.byte_ids[b] for b in MARK.encode()]
        self.known = {"": 0}
        #: of the known parts: characters (none: merged one by one), pieces, and where each starts; turns
        self.chars, self.flat = np.zeros(0, np.int32), np.array(own, np.int32)
        self.n_chars, self.n_flat, self.turns = np.zeros(1, np.int64), np.array([len(own)]), np.zeros(1, np.int64)

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All pieces, and where each text's start (one more entry than texts)."""
        if len(self.known) >= self.cache:
            self._forget()
        parts: list[str] = []
        ends, keys = [0], []
        for text in texts:
            for i, run in enumerate(text.split(MARK)):
                if i:
                    parts.append("")
                elif text:
                    run = " " + run
                if run:
                    parts += self.parts(run.replace(" ", MARK))
            keys.append(zlib.crc32(text.encode(), self.dropout.seed) << 32)
            ends.append(len(parts))
        size = np.diff(ends)
        places = np.arange(len(parts)) - np.repeat(ends[:-1], size)
        flat, start = self.drawn(parts, mixed(np.repeat(np.array(keys, np.uint64), size) + places.astype(np.uint64)))
        return flat, start[ends]

    def drawn(self, parts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All parts' pieces, each part's under its own skips, and where each part's start."""
        at = list(map(self.known.get, parts))
        if None in at:
            self._learn(list({p: 0 for p, n in zip(parts, at) if n is None}))
            at = list(map(self.known.__getitem__, parts))
        at = np.array(at, np.int64)
        start, size, flat = (np.cumsum(self.n_flat) - self.n_flat)[at], self.n_flat[at], self.flat
        if self.limit:
            rows = np.flatnonzero(any_skip(keys, self.turns[at], self.limit))
            few = self.n_chars[at[rows]] == 0
            one_by_one = []
            for r in rows[few].tolist():
                one_by_one.append(self.merged(parts[r], skips(keys[r : r + 1], np.arange(3 * len(parts[r])), self.limit).tobytes())[0])
            groups = [(rows[few], np.array([x for p in one_by_one for x in p], np.int32), np.array([len(p) for p in one_by_one], np.int64))]
            rows = rows[~few]
            for own in self._alike(self.n_chars[at[rows]]):
                own = rows[own]
                groups.append((own, *self._merge_many(at[own], keys[own])[:2]))
            for own, pieces, n in groups:
                start[own], size[own] = len(flat) + np.cumsum(n) - n, n
                flat = np.concatenate([flat, pieces])
        return flat[ranges(start, size)], np.concatenate([[0], np.cumsum(size)])

    def _alike(self, lengths: np.ndarray, most: int = 30_000) -> Iterator[np.ndarray]:
        """Places of like lengths, so many at once."""
        order = np.argsort(lengths, kind="stable")
        cuts = np.searchsorted(lengths[order], [0, 5, 9, 13, 21, WIDEST + 1])
        for a, b in zip(cuts, cuts[1:]):
            for x in range(a, b, most):
                yield order[x : min(b, x + most)]

    def _learn(self, parts: list[str]) -> None:
        """Add parts to the known ones, with what they give without skips."""
        ids, n = self.ids, len(self.known)
        self.known.update(zip(parts, range(n, n + len(parts))))
        chars = [list(map(ids.get, p)) if len(p) <= WIDEST else [None] for p in parts]
        chars = [[] if None in c else c for c in chars]
        self.n_chars = np.concatenate([self.n_chars, np.array([len(c) for c in chars], np.int64)])
        self.chars = np.concatenate([self.chars, np.array([x for c in chars for x in c], np.int32)])
        pieces, n_pieces, turns = {}, np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        for i, (p, c) in enumerate(zip(parts, chars)):
            if not c:
                found, turns[i] = self.merged(p, b"")
                pieces[i], n_pieces[i] = np.array(found, np.int32), len(found)
        own = np.flatnonzero(self.n_chars[n:])
        groups = [(i, x) for i, x in pieces.items()]
        for some in self._alike(self.n_chars[n:][own]):
            some = own[some]
            found, n_pieces[some], turns[some] = self._merge_many(some + n, None)
            groups.append((some, found))
        flat, start = np.zeros(int(n_pieces.sum()), np.int32), np.cumsum(n_pieces) - n_pieces
        for some, found in groups:
            flat[ranges(np.atleast_1d(start[some]), np.atleast_1d(n_pieces[some]))] = found
        self.flat = np.concatenate([self.flat, flat])
        self.n_flat, self.turns = np.concatenate([self.n_flat, n_pieces]), np.concatenate([self.turns, turns])

    def _merge_many(self, parts: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """merged() for many known parts at once: their pieces, how many each has, and turns.

        A column for each part. In each step every part takes up its best candidate; keys: draw skips."""
        lengths = self.n_chars[parts]
        n, width = len(parts), int(lengths.max())
        syms = np.full((width + 1, n), -1, np.int32)
        column = np.repeat(np.arange(n), lengths)
        place = ranges(np.zeros(n, np.int64), lengths)
        syms[place, column] = self.chars[ranges((np.cumsum(self.n_chars) - self.n_chars)[parts], lengths)]
        # neighbours' places; width stands for none
        right = np.repeat(np.arange(1, width + 2, dtype=np.int64)[:, None], n, 1)
        left = right - 2
        left[0], right[width] = width, width
        agenda = np.full((width + 1, n), NEVER)
        agenda[:-1] = self.pairs.candidates(syms[:-1].ravel(), syms[1:].ravel(), np.repeat(np.arange(width), n)).reshape(width, n)
        out, turns, whose, turn = np.full((width, n), -1, np.int32), np.zeros(n, np.int64), np.arange(n), 0
        while True:
            best = agenda.min(0)
            r = np.flatnonzero(best != NEVER)
            if len(r) < 0.75 * len(best) or not len(r):
                done = np.flatnonzero(best == NEVER)
                out[:, whose[done]] = syms[:-1, done]
                if not len(r):
                    break
                # take keeps the rows contiguous, so that the flat views below are no copies
                syms, right, left, agenda = (np.take(x, r, axis=1) for x in (syms, right, left, agenda))
                whose, best, r = whose[r], best[r], np.arange(len(r))
            turns[whose[r]] = turn = turn + 1
            m, w = best[r], len(whose)
            i, made = m >> 24 & 0xFF, (m & 0xFFFFFF).astype(np.int32)
            if keys is not None:
                drop = skips(keys[whose[r]], np.full(len(r), turn - 1), self.limit)
                agenda[i[drop], r[drop]] = NEVER
                r, i, made = r[~drop], i[~drop], made[~drop]
            s, near, far, best = syms.reshape(-1), right.reshape(-1), left.reshape(-1), agenda.reshape(-1)
            here = i * w + r
            j = near[here] * w + r
            k, h = near[j], far[here]
            s[here], s[j] = made, -2
            near[here], far[k * w + r] = k, i
            best[j] = NEVER
            for a, b, x in ((made, s[k * w + r], i), (s[h * w + r], made, h)):
                best[x * w + r] = self.pairs.candidates(a, b, x)
        kept = out.T >= 0
        return out.T[kept], kept.sum(1), turns

    def parts(self, marked: str) -> list[str]:
        """The text cut wherever no piece holds the two characters side by side."""
        code = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = self.number[np.minimum(code, len(self.number) - 1)]
        cuts = np.flatnonzero(~self.joined[n[:-1], n[1:]]) + 1
        at = [0, *cuts.tolist()]
        return [marked[a:b] for a, b in zip(at, [*at[1:], len(marked)])]

    def merged(self, part: str, skipped: bytes) -> Merged:
        """The pieces of a part and the count of its candidates, by its agenda (order, then place, of
        each candidate); skipped has a byte a turn."""
        ids, made, order, turn = self.ids, self.made.get, self.order, 0
        n = len(part)
        syms = [ids.get(c, -1) for c in part]  # -1: a character without a piece, -2: merged away
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            if (m := made((syms[i], syms[i + 1]))) is not None:
                agenda.append((order[m], i))
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            o, i = pop(agenda)
            if (j := right[i]) >= n or (m := made((syms[i], syms[j]))) is None or order[m] != o:
                continue  # no longer there
            turn += 1
            if turn <= len(skipped) and skipped[turn - 1]:
                continue
            syms[i], syms[j] = m, -2
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (x := made((m, syms[k]))) is not None:
                    push(agenda, (order[x], i))
            h = left[i]
            if h >= 0 and (x := made((syms[h], m))) is not None:
                push(agenda, (order[x], h))
        return self._spelled([p for p in syms if p != -2], part), turn

    def _spelled(self, syms: list[int], part: str) -> list[int]:
        """syms with bytes for the characters without a piece."""
        if min(syms) >= 0:
            return syms
        lacking = iter([c for c in part if c not in self.ids])
        out = []
        for p in syms:
            if p >= 0:
                out.append(p)
            else:
                out += [self.byte_ids[b] for b in next(lacking).encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw[1:].decode() if raw else ""


def encoded(docs: DataFrame, vocabulary: Vocabulary, dropout: Dropout = Dropout(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids, decoded: the pieces of every whole text, and the text that they decode to.

    The vocabulary (a fixed number of pieces) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    docs = docs.select(key, text)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, dropout)
        for b in batches:
            for part in slices(b, 1):
                flat, ends = codec.encode_many([t or "" for t in part.column(1).to_pylist()])
                ids, ends = flat.tolist(), ends.astype(np.int32)
                texts = [codec.decode(ids[a:b]) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, flat), pa.array(texts, pa.string())], ["key", "ids", "decoded"])

    return docs.mapInArrow(run, f"key {kind}, ids array<int>, decoded string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
