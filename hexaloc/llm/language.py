"""Language identification by cross-parsing entropy over suffix automata.

For each language a suffix automaton is built from a bounded sample of labelled text. A text
is parsed against it from left to right into phrases: each is the longest match with
anything in the sample, and the next starts at the character that ended it. The fewer
phrases, weighted by log2 of the sample's length and divided by the text's, the closer the
language; the least wins, ties go to the first name. The score is the winner's share if each
phrase costs log2 of the sample's length in bits.

Texts are lower-cased, characters that aren't letters become one space a run, and letters
outside the alphabet (the sample's most common letters) one symbol. A character that a sample
lacks ends a phrase and heads the next one. Whole texts are parsed, in runs of ``run`` symbols
that phrases don't cross, so that numpy can step through many runs at once.

Defined results: ``und`` and score 0 for null texts and texts without letters; repeated rows
and equal texts get equal results; without any labelled text all are ``und``; key columns may
be null; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BREAK = 1 << 30
SPACE, OTHER = 1, 2


@dataclass(frozen=True)
class Sample:
    """The bounds of what is learned from: documents of each language, by the order of a seeded
    hash of their texts, symbols of each document, symbols of each language, letters."""

    documents: int = 400
    symbols_each: int = 400
    symbols: int = 24_000
    letters: int = 60
    seed: int = 7


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x30000)])


def symbols(text: str, alphabet: np.ndarray) -> np.ndarray:
    """The symbols of a text; alphabet: symbol of each code point, OTHER for unknown letters."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.minimum(code, len(alphabet) - 1)
    found = alphabet[code]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != SPACE) | (found[:-1] != SPACE)
    return found[keep]


def automaton(text: list[int], letters: int) -> np.ndarray:
    """The transitions of a text's suffix automaton, for cross-parsing: a table of next states,
    times the number of symbols; where there is none, that from the root, marked by BREAK."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    root = np.zeros(letters, np.int32)
    for c, s in step[0].items():
        root[c] = s * letters
    table = np.tile(root | BREAK, (len(step), 1))
    for s, row in enumerate(step):
        for c, to in row.items():
            table[s, c] = to * letters
    return table


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    alphabet: np.ndarray
    #: All languages' tables in one; where each starts; bits of a phrase of each.
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray

    def phrases(self, texts: list[np.ndarray], run: int = 2048) -> np.ndarray:
        """Phrases of each text in each language: texts x languages."""
        n_lang = len(self.languages)
        owner, runs = [], []
        for i, t in enumerate(texts):
            for a in range(0, len(t), run):
                owner.append(i)
                runs.append(t[a : a + run])
        out = np.zeros((len(texts), n_lang), np.int64)
        if not runs:
            return out
        lengths = np.array([len(r) for r in runs])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        rows = np.zeros((int(lengths[0]), len(runs)), np.uint8)
        for lane, i in enumerate(order):
            rows[: len(runs[i]), lane] = runs[i]
        active = np.searchsorted(-lengths, -np.arange(1, len(rows) + 1), side="right")
        state = np.repeat(self.roots[:, None], len(runs), 1)
        count = np.ones((n_lang, len(runs)), np.int32)
        for k, n in enumerate(active):
            t = self.table.take(state[:, :n] + rows[k, :n])
            count[:, :n] += t >> 30
            state[:, :n] = t & BREAK - 1
        np.add.at(out, np.array(owner)[order], count.T)
        return out

    def predict(self, texts: list[str | None], block: int = 2_000_000) -> tuple[list[str], list[float]]:
        names: list[str] = []
        scores: list[float] = []
        at = 0
        while at < len(texts):
            found, size = [], 0
            while at + len(found) < len(texts) and (not found or size < block):
                t = symbols(texts[at + len(found)] or "", self.alphabet)
                found.append(t)
                size += len(t)
            costs = self.phrases(found) * self.bits
            for t, cost in zip(found, costs):
                if not len(self.languages) or not (t != SPACE).any():
                    names.append("und")
                    scores.append(0.0)
                    continue
                best = int(np.argmin(cost))
                names.append(self.languages[best])
                scores.append(float(1 / np.sum(np.exp2(cost[best] - cost))))
            at += len(found)
        return names, scores


def learned(rows: list[tuple[str, str]], sample: Sample = Sample()) -> Model:
    """The model of (language, text) pairs, a bounded sample."""
    usual = np.where(_letters(), OTHER, SPACE).astype(np.uint8)
    counts = Counter(c for _, t in rows for c in t.lower() if c.isalpha() and ord(c) < len(usual))
    for i, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: sample.letters]):
        usual[ord(c)] = OTHER + 1 + i
    letters = sample.letters + OTHER + 1
    names, tables, bits = sorted({lang for lang, _ in rows}), [], []
    for name in names:
        text: list[int] = []
        for lang, t in rows:
            if lang == name and len(text) < sample.symbols:
                text += [*symbols(t, usual)[: sample.symbols_each].tolist(), SPACE]
        text = text[: sample.symbols]
        tables.append(automaton(text, letters))
        bits.append(math.log2(max(2, len(text))))
    starts = np.cumsum([0, *(t.size for t in tables)])
    if starts[-1] >= BREAK:
        raise ValueError("the sample is too large for the states' numbers")
    table = np.concatenate([((t & BREAK - 1) + s | t & BREAK).ravel() for t, s in zip(tables, starts)] or [np.zeros(0, np.int32)]).astype(np.int32)
    return Model(tuple(names), usual, table, starts[:-1].astype(np.int32), np.array(bits))


def sampled(docs: DataFrame, sample: Sample = Sample(), text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """A bounded sample of labelled rows: (language, text), in the order of their hashes.

    The hashes are ranked without the texts; repeated texts count once."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null and text <> ''")
    rows = rows.withColumn("h", F.xxhash64(F.lit(sample.seed), "text"))
    ranked = rows.select("lang", "h").distinct().withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= sample.documents)
    # at most so many rows for each language
    chosen = F.broadcast(ranked.select(F.col("lang").alias("l"), F.col("h").alias("k")))
    cut = F.substring("text", 1, 8 * sample.symbols_each)
    found = rows.join(chosen, (F.col("lang") == F.col("l")) & (F.col("h") == F.col("k"))).groupBy("lang", "h").agg(F.min(cut).alias("text"))
    return [(r["lang"], r["text"]) for r in sorted(found.collect(), key=lambda r: (r["lang"], r["h"]))]


def identified(docs: DataFrame, model: Model, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The key columns, lang_pred and score of every row. The model, of bounded size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*keys, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                names, scores = shared.value.predict(part.column(len(keys)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keys, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def third(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3
