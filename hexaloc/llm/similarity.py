"""Exact Jaccard self-join of documents on word shingles, with PartEnum signatures.

A document's set is its distinct shingles; two documents link if their sets' Jaccard index
reaches the threshold. ``components`` gives each document the smallest id that links reach.

1. Every text is shingled; documents with equal sets become one class (its smallest id).
2. Every text signs (see ``_partenum``). Of the documents of a batch (8 MB of texts) with one signature the
   first meets the other batches' in a shuffle; the others, and copies but one, don't cross it
   there, so that a signature that a third of all rows share crosses it once a batch.
   What meets or was put aside makes the buckets.
3. Buckets are solved by stars: pairs of a leader and each other class, tested exactly.
   The leader is the smallest class first, then the one with the most links. Pairs that
   links have joined already need no test. What is left then, classes of a bucket in
   different components, meets again on its rarest elements (see ``_refined``), and each
   pair that may link is tested.

Before the exact test, bits of parity bound each pair's difference from below; sets are read
only for pairs that this leaves. Nothing is capped or sampled.

Defined results: null, empty and blank texts have no set and link with nothing; a row with a
null id keeps its size and has no component; rows that repeat keep their number; other
columns, whatever their names, are not carried; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexaloc.llm._partenum import PartEnum
from hexaloc.llm._shared import broadcast_if_few, filter_by_ids, materialize, release, slices
from hexaloc.llm._shingles import STEPS, U, mix, sets_of

#: Documents whose shingles tell which are common, and sets that tell how rare elements are.
SAMPLE_DOCS, SAMPLE_SETS = 4_000, 4_000


def _key(elements: np.ndarray) -> tuple[int, int]:
    if not len(elements):
        return 0, 0
    return int(mix(elements).sum().astype(np.int64)), int(mix(elements ^ STEPS[0]).sum().astype(np.int64))  # sums wrap


def _measured(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys = [], []
            for elements in sets_of(b.column(1), width):
                n.append(len(elements))
                keys.append(_key(elements))
            k = np.array(keys, np.int64).reshape(-1, 2)
            out = {"doc_id": b.column(0), "n_shingles": pa.array(n, pa.int64()), "k1": pa.array(k[:, 0]), "k2": pa.array(k[:, 1])}
            if b.num_columns > 2:
                out["own"] = b.column(2)
            yield pa.RecordBatch.from_pydict(out)

    return run


def _counts_of_sample(rows: DataFrame, parts: float, key: str, seed: int, elements, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The elements that least or more sets of a hashed sample hold, sorted, and how many do.

    elements: gives the sets of a batch's second column. The counting is Spark's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for e in elements(b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(e.astype(np.int64))], ["e"])

    some = rows.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, parts) * (1 << 30)))
    found = some.mapInArrow(run, "e long").groupBy("e").agg(F.count(F.lit(1)).cast("int").alias("n")).where(F.col("n") >= least).toArrow()
    e, n = found.column(0).to_numpy().astype(U), found.column(1).to_numpy()
    order = np.argsort(e)
    return e[order], n[order]


def _signed(width: int, method: PartEnum, common):
    """Signatures of documents (at, id, sig, lead). In 8 MB of texts the first document with a signature
    goes to it (at); each other one to a place of its own, and tells signature and first document.
    The rows leave in sixteenths of the signatures' range, which bounds what is held beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for all in batches for x in slices(all, 1, 4_000, 8 << 20)):
            seen, sigs, ids = set(), [], []
            for doc, elements in zip(b.column(0).to_pylist(), sets_of(b.column(1), width)):
                key = _key(elements)
                if doc is not None and len(elements) and key not in seen:
                    seen.add(key)
                    sigs.append(method.signatures(elements, common.value))
                    ids.append(doc)
            if not sigs:
                continue
            every = np.concatenate(sigs)
            whose = np.repeat(np.arange(len(ids), dtype=np.int32), [len(s) for s in sigs])
            names, sixteenth = np.array(ids, np.int64), (every >> U(60)).astype(np.int8)
            sigs.clear()
            for n in range(16):
                own = np.flatnonzero(sixteenth == n)
                if not len(own):
                    continue
                sig, doc = every[own].view(np.int64), names[whose[own]]
                order = np.lexsort((doc, sig))
                sig, doc = sig[order], doc[order]
                first = np.ones(len(sig), bool)
                first[1:] = sig[1:] != sig[:-1]
                lead = doc[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
                at = np.where(first, sig, mix(sig.view(U) ^ mix(doc.view(U))).view(np.int64))
                out = [pa.array(at), pa.array(doc), pa.array(sig, mask=first), pa.array(lead, mask=first)]
                yield pa.RecordBatch.from_arrays(out, ["at", "id", "sig", "lead"])

    return run


def parities(elements: np.ndarray) -> np.ndarray:
    """Whether an odd number of elements falls into each of some 2 to 4 cells an element, as bits in longs.

    Sets whose bits differ in d places differ in d elements or more. Half as many cells: the
    exclusive or of the two halves."""
    cells = max(64, 1 << (2 * len(elements) - 1).bit_length())
    at = (mix(elements + STEPS[3]) & U(cells - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=cells) & 1, bitorder="little").view(np.int64)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, sets, bits = [], [], []
            for doc, elements in zip(b.column(0).to_pylist(), sets_of(b.column(1), width)):
                docs.append(doc)
                sets.append(elements.astype(np.int64))
                bits.append(parities(elements))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sets, longs), pa.array(bits, longs)], ["rep", "elements", "bits"])

    return run


class _Tester:
    """Tests pairs (a, b) of classes against their sets, which it keeps in the shared folder."""

    def __init__(self, docs: DataFrame, reps: DataFrame, width: int, percent: int):
        self.percent = percent
        texts = filter_by_ids(docs, "doc_id", reps.withColumnRenamed("rep", "doc_id"), keep=True)
        sets = texts.mapInArrow(_sets(width), "rep long, elements array<long>, bits array<long>")
        self.sets = materialize(sets.withColumn("n", F.size("elements")), "jaccard-sets")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs that their sizes and parities don't rule out, written to the shared folder."""
        side = self.sets.select("rep", "n", "bits")
        near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent
        p = pairs.join(side.toDF("a", "na", "xa"), "a").join(side.toDF("b", "nb", "xb"), "b").where(near)

        def folded(x, half):
            return F.when(F.size(x) > half, F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))).otherwise(x)

        size = F.least(F.size("xa"), F.size("xb"))
        apart = F.aggregate(F.zip_with(folded(F.col("xa"), size), folded(F.col("xb"), size), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, x: s + x)
        # further apart than by one fold: the sizes alone decided
        known = F.greatest(F.size("xa"), F.size("xb")) <= 2 * size
        fits = (100 + self.percent) * apart <= (100 - self.percent) * (F.col("na") + F.col("nb"))
        return materialize(p.where(~known | fits).select("a", "b").distinct(), "jaccard-possible")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link, written to the shared folder.

        The sets of b are moved to a's, so that the many members of a star are moved once."""
        pairs = self.possible(pairs)
        members = self.sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("elements").alias("xb"))
        p = members.join(broadcast_if_few(pairs), "b")
        leaders = filter_by_ids(self.sets, "rep", pairs.select(F.col("a").alias("rep")), keep=True)
        p = p.join(leaders.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("elements").alias("xa")), "a")
        common = F.size(F.array_intersect("xa", "xb"))
        found = materialize(p.where((100 + self.percent) * common >= self.percent * (F.col("na") + F.col("nb"))).select("a", "b"), "jaccard-links")
        release(pairs)
        return found


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that edges (a, b) reach, for every node with an edge.

    Each round takes the least label among neighbours, then the label's own label, and writes
    the labels to the shared folder; it ends when nothing changes."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        known = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        near = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.select("node", "label").join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("jump"))
        after = materialize(step.join(jump, "new").select("node", F.least("new", "jump").alias("label"), F.col("label").alias("old")), "labels")
        done = after.where("label <> old").isEmpty()
        release(labels)
        labels = after
        if done:
            release(both)
            return labels


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, width: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of docs.

    Keys that aren't whole numbers are told apart by 64 bits of hashes."""
    method = PartEnum(percent)
    kind = docs.schema[key].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    number = F.col(key).cast("long") if whole else F.when(F.col(key).isNotNull(), F.xxhash64(key))
    docs = docs.select(number.alias("doc_id"), F.col(text).alias("text"), *([] if whole else [F.col(key).alias("own")]))
    columns = "doc_id long, n_shingles long, k1 long, k2 long" + ("" if whole else f", own {kind.simpleString()}")
    measured = materialize(docs.mapInArrow(_measured(width), columns), "jaccard-docs")
    docs = docs.select("doc_id", "text")
    classes = measured.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    members = measured.join(classes, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).alias("rep"), *([] if whole else ["own"]))
    members = materialize(members, "jaccard-members")
    release(measured)

    buckets = _buckets(docs, members, width, method)
    tester = _Tester(docs, buckets.select("rep"), width, percent)
    tested = materialize(_pairs(buckets), "jaccard-tested")
    links = tester.linked(tested)
    labels = connected(links)

    # the leader with the most links, for buckets that are not one component yet
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("degree"))
    hub = F.max(F.struct(F.coalesce("degree", F.lit(0)), -F.col("rep"))).over(Window.partitionBy("bucket"))
    opened = materialize(_open(buckets, labels), "jaccard-opened")
    release(buckets)
    hubs = opened.join(degree, "rep", "left").select("bucket", "rep", (-hub["col2"]).alias("lead"))
    again = materialize(_pairs(hubs).join(tested, ["a", "b"], "left_anti"), "jaccard-tested")
    more = tester.linked(again)
    release(labels)
    labels = connected(links.union(more))

    rest = materialize(_open(opened, labels).select("rep", "component").distinct(), "jaccard-open")
    release(opened)
    pairs = materialize(_refined(tester.sets, rest, percent).join(tested.union(again), ["a", "b"], "left_anti"), "jaccard-rest")
    found = tester.linked(pairs)
    if not found.isEmpty():
        release(labels)
        labels = connected(links.union(more).union(found))
    release(tester.sets, tested, again, pairs, rest, links, more, found)

    joined = members.join(labels.where("label < node"), F.col("rep") == F.col("node"), "left")
    joined = joined.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id")))
    if whole:
        return joined.select("doc_id", "n_shingles", "component_id")
    least = joined.groupBy("component_id").agg(F.min("own").alias("least"))
    named = joined.join(least.withColumnRenamed("component_id", "c"), F.col("component_id") == F.col("c"), "left")
    return named.select(F.col("own").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))


def _buckets(docs: DataFrame, members: DataFrame, width: int, method: PartEnum) -> DataFrame:
    """bucket, rep, lead (its smallest class): the classes of two or more that share signatures.

    Signatures that the same classes share make one bucket."""
    common = docs.sparkSession.sparkContext.broadcast(_counts_of_sample(docs, SAMPLE_DOCS / max(1, members.count()), "doc_id", 5, lambda texts: _distinct(sets_of(texts, width)), 3)[0])
    signed = docs.mapInArrow(_signed(width, method, common), "at long, id long, sig long, lead long").repartition("at")
    over = Window.partitionBy("at")
    met = signed.withColumns({"lo": F.min("id").over(over), "hi": F.max("id").over(over)}).where("lo < hi or sig is not null")
    rows = met.select(F.coalesce("sig", "at").alias("sig"), F.explode(F.when(F.col("lead").isNull(), F.array("id")).otherwise(F.array("id", "lead"))).alias("id"))

    # an id stands for its class; only those that stand for another, or for two, are looked up
    known = members.where("rep is not null and doc_id is not null").groupBy("doc_id").agg(F.collect_set("rep").alias("reps"))
    others = materialize(known.where((F.size("reps") > 1) | (F.col("reps")[0] != F.col("doc_id"))), "jaccard-copies")
    rows = rows.join(broadcast_if_few(others), F.col("id") == F.col("doc_id"), "left").select("sig", F.explode(F.coalesce("reps", F.array("id"))).alias("rep"))

    over = Window.partitionBy("sig")
    rows = rows.repartition("sig").distinct().withColumns({"lo": F.min("rep").over(over), "hi": F.max("rep").over(over), "all": F.bit_xor(F.xxhash64("rep")).over(over)})
    # two groups of classes under one number would be one bucket with all of both: no pair is lost
    rows = rows.where("lo < hi").select(F.xxhash64("lo", "hi", "all").alias("bucket"), "rep", "lo").groupBy("bucket", "rep").agg(F.min("lo").alias("lead"))
    found = materialize(rows, "jaccard-buckets")
    release(others)
    return found


def _distinct(sets: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The sets without those that came before, among these."""
    seen = set()
    for e in sets:
        key = _key(e)
        if key not in seen:
            seen.add(key)
            yield e


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs a < b of each row's class and its bucket's leader."""
    return rows.where("rep <> lead").select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()


def _refined(sets: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in open buckets and different components that may link.

    Each set's elements are put in one order, rare ones first. Sets of sizes m and n that link
    share t elements or more, so the first m - t + 1 of one and n - t + 1 of the other share one;
    that holds for any order. Of a fixed part of all elements, twice what is put first of a set,
    all sets that hold one are counted; those of one set only come first and meet nothing, so
    they are left out. How rare the others are comes from a bounded sample of the sets. Of
    the component that holds an element most often, no two members are put together."""
    own = sets.select("rep", "elements").join(broadcast_if_few(rest), "rep")
    part, n_sets = min(1 << 16, (2 * (100 - percent) << 16) // 100), rest.count()
    counted = own.select("rep", F.explode("elements").alias("token")).where(F.col("token").bitwiseAND(F.lit(0xFFFF)) < part)
    several = counted.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    held = counted.join(several, "token").groupBy("rep").agg(F.collect_list(F.struct("token", "k")).alias("several"))
    shared = sets.sparkSession.sparkContext.broadcast(
        _counts_of_sample(own.select("rep", "elements"), SAMPLE_SETS / max(1, n_sets), "rep", 6, lambda column: (np.asarray(x.values).astype(U) for x in column), 2)
    )
    scale = max(1, n_sets // SAMPLE_SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for rep, elements, component, several in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3)):
                e = np.asarray(elements.values)
                # 0: of this set only, 1: unknown, else 1 + how many sets hold it
                count = np.ones(len(e), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, e.view(U)), len(known) - 1)
                    count += np.where(known[at] == e.view(U), often[at] * scale, 0)
                count[(e & 0xFFFF) < part] = 0
                if several.is_valid:
                    token, k = (several.values.field(c).to_numpy() for c in ("token", "k"))
                    by = np.argsort(e)
                    count[by[np.searchsorted(e, token, sorter=by)]] = 1 + k
                n = len(e)
                first = n - -(-percent * n // 100) + 1
                order = np.lexsort((e, count))[:first]
                place = np.flatnonzero(count[order])
                order, m = order[place], len(place)
                for c, x in zip(cols, (e[order], np.full(m, rep), np.full(m, component), np.full(m, n), place)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in cols], ["token", "rep", "component", "n", "place"])

    tokens = own.join(held, "rep", "left").select("rep", "elements", "component", "several").mapInArrow(run, "token long, rep long, component long, n long, place long")
    tokens = materialize(tokens, "jaccard-tokens")
    main = tokens.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("token")
    main = main.agg(F.max(F.struct("k", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("components")).where("components > 1").drop("components")
    rows = materialize(tokens.join(main, "token"), "jaccard-shared")
    left, right = (rows.select("token", *(F.col(c).alias(c + x) for c in ("rep", "component", "n", "place", "main"))) for x in "xy")
    t = f"(({percent} * (nx + ny) + {99 + percent}) div {100 + percent})"
    pairs = left.where("componentx <> mainx").join(right, "token").where(f"componentx <> componenty and placex <= nx - {t} and placey <= ny - {t}")
    return materialize(pairs.select(F.least("repx", "repy").alias("a"), F.greatest("repx", "repy").alias("b")).distinct(), "jaccard-rest")


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, rep, component of the buckets that hold more than one component."""
    over = Window.partitionBy("bucket")
    known = buckets.select("bucket", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("bucket", "rep", F.coalesce("label", "rep").alias("component"))
    return known.withColumns({"lo": F.min("component").over(over), "hi": F.max("component").over(over)}).where("lo < hi").drop("lo", "hi")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, width: int = 4) -> DataFrame:
    """The documents without the near copies: of each component the smallest key stays.

    Rows that share a key stay or go together, and rows with a null key stay."""
    gone = materialize(components(docs, key, text, percent, width).where("component_id < doc_id").select(F.col("doc_id").alias(key)).distinct(), "jaccard-gone")
    return filter_by_ids(docs, key, gone, keep=False)
