"""Personal data: exact patterns, and identifiers found by bootstrapped contexts.

Base spans come from fixed patterns (email, ip, card, phone). They are the seeds. Around each
seed the text's two tokens before and one after make a lexical pattern. The texts are then read
for every token that fills the slot of a pattern with enough seeds, whatever its characters or
length. Spark scores the graph of patterns and instances: a pattern is as good as the instances
that it holds, an instance as good as its patterns together (noisy-or), for a few rounds, seeds
fixed at 1. Instances of patterns with high confidence become spans of kind ``id``.

The texts are read once a step; only narrow, distinct rows (pattern, instance) are moved. The
patterns with enough seeds are broadcast, and spans are found in place. What is broadcast is met
by hashes over whole batches, so a step's work hardly depends on how much that is.

Defined results: a null text is an empty one; equal spans of repeated rows stay with their
rows; rows are told apart even if their keys are equal or null; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexaloc.llm._contexts import DIGIT, Members, instance_hashes, normal, pattern_hashes, slots
from hexaloc.llm._shared import materialize, slices

KINDS = ("email", "ip", "card", "phone", "id")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BEFORE = re.compile(r"\w+|[^\w\s]")


@dataclass(frozen=True)
class Bootstrap:
    rounds: int = 3
    #: A pattern needs so many distinct instances that are seeds, and this confidence.
    min_seeds: int = 5
    min_confidence: float = 0.8
    #: Counts against a pattern, as of an instance that is none.
    doubt: float = 0.5
    #: Confidence from which a pattern lends some to its instances.
    lends: float = 0.5


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping emails, in time linear in the text: from each @, the run before it."""
    end = 0
    at = text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, sorted; kind is a place in KINDS."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGIT.findall(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def seed_contexts(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, pattern) of the seeds, by place."""
    if not spans:
        return
    found = [(m.start(), m.end()) for m in BEFORE.finditer(text)]
    starts, ends = [s for s, _ in found], [e for _, e in found]
    for s, _, e in spans:
        i, j = bisect_right(ends, s), bisect_left(starts, e)
        near = [normal(text[a:b]) for a, b in (*found[max(0, i - 2) : i], *found[j : j + 1])]
        yield s, e, " ".join(near[: min(i, 2)]) + " _ " + (near[-1] if j < len(found) else "")


@dataclass(frozen=True)
class Sought:
    """Patterns and instances to look for, with their hashes."""

    patterns: frozenset[str]
    instances: frozenset[str]
    hashes: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, patterns: Collection[str], instances: Collection[str] = ()) -> Sought:
        return cls(frozenset(patterns), frozenset(instances), (pattern_hashes(patterns), instance_hashes(instances)))

    def read(self, b: pa.RecordBatch, column: int) -> Iterator[tuple[list, list, list]]:
        """The batch's texts, some at a time: each with its base spans, and with (start, end, pattern)
        of the tokens that fill a pattern's slot or are an instance and touch no base span."""
        members = [Members(h) for h in self.hashes]
        for part in slices(b, column, 2000, 1 << 18):
            texts = [t or "" for t in part.column(column).to_pylist()]
            bases = [base_spans(t) for t in texts]
            tokens: list[list[tuple[int, int, str]]] = [[] for _ in texts]
            if self.patterns or self.instances:
                for r, s, e, p in slots(texts, *members):
                    if p in self.patterns or texts[r][s:e] in self.instances:
                        tokens[r].append((s, e, p))
            yield texts, bases, [_clear(b, t) if b and t else t for b, t in zip(bases, tokens)]


def _clear(base: list[tuple[int, int, int]], found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The tokens that touch no base span."""
    starts, reach = [s for s, _, _ in base], [0, *accumulate((e for _, _, e in base), max)]
    return [x for x in found if reach[bisect_left(starts, x[1])] <= x[0]]


def occurrences(docs: DataFrame, text: str, patterns: list[str] | None, instances: list[str] = []) -> DataFrame:
    """pattern, instance, seed: distinct, of every token in one of the patterns or that is one of
    the instances; patterns of None: of the seeds."""
    seeds_only = patterns is None
    wanted = docs.sparkSession.sparkContext.broadcast(Sought.of(patterns or [], instances))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = wanted.value
        for b in batches:
            out = set()
            for texts, bases, tokens in sought.read(b, 0):
                for text, base, own in zip(texts, bases, tokens):
                    out.update((p, text[s:e], False) for s, e, p in own)
                    for s, e, p in seed_contexts(text, base):
                        if seeds_only or p in sought.patterns or text[s:e] in sought.instances:
                            out.add((p, text[s:e], True))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.bool_())], ["pattern", "instance", "seed"])

    rows = docs.select(text).mapInArrow(run, "pattern string, instance string, seed boolean")
    return materialize(rows.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-graph")


def _strings(df: DataFrame) -> list[str]:
    return [r[0] for r in df.toLocalIterator()]


def confident_patterns(docs: DataFrame, how: Bootstrap = Bootstrap(), text: str = "text") -> list[str]:
    """The patterns to trust. A pattern needs min_seeds distinct confident instances (seeds, and
    instances found in trusted patterns so far) to be scored in a round; then every token that
    fills its slot counts, for or against it. Instances found in a round bring all the patterns
    around them to the next."""
    held = occurrences(docs, text, None).select("pattern", "instance")
    graph, patterns, found = None, set(), set()
    for n in range(how.rounds):
        supported = _strings(held.distinct().groupBy("pattern").count().where(F.col("count") >= how.min_seeds).select("pattern"))
        fresh = [p for p in supported if p not in patterns]
        if fresh:
            patterns.update(fresh)
            more = occurrences(docs, text, fresh).withColumn("score", F.col("seed").cast("double"))
            graph = more if graph is None else graph.unionByName(more)
            if n:
                graph = rescored(graph, scored, how)
        if graph is None:
            return []
        scored = graph.groupBy("pattern").agg((F.sum(F.col("score").cast("decimal(20,9)")).cast("double") / (F.count(F.lit(1)) + how.doubt)).alias("confidence"))
        scored = materialize(scored, "pii-patterns")
        trusted = scored.where(F.col("confidence") >= how.min_confidence).select("pattern")
        if n == how.rounds - 1:
            return _strings(trusted)
        graph = rescored(graph, scored, how)
        new = [i for i in _strings(graph.where("not seed").join(trusted, "pattern", "left_semi").select("instance").distinct()) if i not in found]
        if new:
            found.update(new)
            held = materialize(held.unionByName(occurrences(docs, text, [], new).select("pattern", "instance")), "pii-held")
    raise ValueError("rounds must be 1 or more")


def rescored(graph: DataFrame, scored: DataFrame, how: Bootstrap) -> DataFrame:
    """The graph with its instances' new scores. A pattern lends confidence only if most of its
    instances count: a common word fills many slots that are seldom an identifier's."""
    lent = F.when(F.col("confidence") >= how.lends, F.col("confidence")).otherwise(0.0)  # null: not scored yet
    doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - lent)).cast("decimal(20,9)")).cast("double")
    instances = graph.join(scored, "pattern", "left").groupBy("instance").agg((1 - F.exp(doubt)).alias("new"))
    return materialize(graph.join(instances, "instance").select("pattern", "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.col("new")).alias("score")), "pii-graph")


FOUND = "array<struct<start:int,kind:int,end:int>>"


def spans(docs: DataFrame, how: Bootstrap = Bootstrap(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans, found (start, kind, end of all): a row per document."""
    trusted = docs.sparkSession.sparkContext.broadcast(Sought.of(confident_patterns(docs, how, text)))
    docs = docs.select(key, text)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            digest, every, found = [], [], []
            for _, bases, tokens in trusted.value.read(b, 1):
                for base, learned in zip(bases, tokens):
                    for k in range(4):
                        counts[k].append(sum(x[1] == k for x in base))
                    digest.append(hashlib.sha256(written(base).encode()).hexdigest())
                    own = sorted(base + [(s, 4, e) for s, e, _ in learned])
                    every.append(written(own))
                    found.append([dict(zip(("start", "kind", "end"), x)) for x in own])
            cols = [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(every, pa.string()), pa.array(found, pa.list_(place))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"])

    return docs.mapInArrow(run, f"key {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found {FOUND}")


def mask(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping ones, replaced by its kind in brackets."""
    out, at, end = [], 0, 0
    for s, k, e in sorted(found):
        if s >= end:
            out += [text[at:s], f"[{KINDS[k]}]"]
        end = at = max(end, e)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, how: Bootstrap = Bootstrap(), key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with personal data masked in their texts; the length column follows, if there is one.

    All spans are found again in place, so keys, null or repeated ones too, don't matter."""
    trusted = docs.sparkSession.sparkContext.broadcast(Sought.of(confident_patterns(docs, how, text)))
    at, size = docs.columns.index(text), docs.columns.index(length) if length in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks, lengths = [], []
            for texts, bases, tokens in trusted.value.read(b, at):
                for t, base, learned in zip(texts, bases, tokens):
                    found = base + [(s, 4, e) for s, e, _ in learned]
                    masks.append(mask(t, found) if found else None)
                    lengths.append(len(masks[-1]) if found else None)
            cols = list(b.columns)
            cols[at] = pc.coalesce(pa.array(masks, b.column(at).type), b.column(at))
            if size is not None:
                old = cols[size].to_pylist()
                cols[size] = pa.array([o if n is None else n for o, n in zip(old, lengths)], cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return docs.mapInArrow(run, docs.schema)
