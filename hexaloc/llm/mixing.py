"""Mixing sources to target weights, by hierarchical budgets.

A budget of tokens runs down a tree (domain, language, source). At each node it is dealt to
the children by weight; a child that hasn't enough (its tokens times max_epochs) takes what
it has, and the shortage goes to its siblings by their weights. Only what a whole subtree
lacks reaches the siblings of its ancestors. All of it is window functions over one row for
each leaf.

Each leaf then takes its documents for whole epochs as often as they fit, and for the rest
the token-prefix of the next epoch's seeded order. The prefix is found without sorting a
leaf: hash ranges are summed, and only the range where the budget ends is sorted. The
result is one threshold for each leaf, so texts are neither moved nor sorted.

Defined results: a null domain, language or source is a node of its own; null texts have no
tokens; a leaf without tokens is not taken; rows that share a key (or are repeated) are
taken or left together; no rows give no rows; columns that start with __ are reserved.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexaloc.llm._shared import SPACE_RUN, SPACES, let, materialize

PATH = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """budget_share: the budget as a part of the corpus's tokens.

    weights: (domain,), (domain, lang) or (domain, lang, source) -> weight among siblings; a
    child that isn't named weighs its tokens to the power of temper."""

    budget_share: float = 1.0
    max_epochs: int = 2
    temper: float = 0.5
    weights: dict[tuple, float] = field(default_factory=dict)
    seed: int = 29
    range_rows: int = 20_000
    #: Leaves that are broadcast (some 60 bytes each) when documents look up theirs.
    broadcast_leaves: int = 100_000


def tokens(text: Column) -> Column:
    """Words of a text, the tokens that budgets count."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return let(trimmed, lambda t: F.when(F.length(t) > 0, F.size(F.split(t, SPACE_RUN))).otherwise(0)).cast("long")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, tokens, budget of each leaf. leaves: PATH, tokens."""
    tree = leaves.withColumn("have", F.col("tokens").cast("double") * mix.max_epochs)
    share = tree.agg(F.sum("tokens")).first()[0] or 0
    for depth in range(1, len(PATH) + 1):
        own, above = PATH[:depth], PATH[: depth - 1]
        nodes = tree.groupBy(*own).agg(F.sum("tokens").alias("tokens"), F.sum("have").alias("have"))
        nodes = nodes.withColumn("weight", _weight(own, mix))
        if above:
            up = given.select(*(F.col(c).alias("__" + c) for c in above), F.col("budget").alias("__budget"))
            same = [nodes[c].eqNullSafe(up["__" + c]) for c in above]
            nodes = nodes.join(up, same, "left").drop(*("__" + c for c in above))
        else:
            nodes = nodes.withColumn("__budget", F.lit(float(share) * mix.budget_share))
        given = materialize(dealt(nodes, above).select(*own, "tokens", "have", "budget"), "mix-budgets")
    return given.select(*PATH, "tokens", "budget")


def _weight(own: tuple[str, ...], mix: Mix) -> Column:
    weight = F.pow(F.col("tokens").cast("double"), F.lit(mix.temper))
    for path, w in mix.weights.items():
        if len(path) == len(own):
            same = F.lit(True)
            for c, v in zip(own, path):
                same = same & F.col(c).eqNullSafe(F.lit(v))
            weight = F.when(same, F.lit(float(w))).otherwise(weight)
    return weight


def dealt(nodes: DataFrame, above: tuple[str, ...]) -> DataFrame:
    """nodes with budget: __budget of the parent dealt to its children (have, weight).

    Children are taken in the order of have / weight. While those before one are full, it is
    full too if it has no more than its share of what is left; the others share the rest."""
    ratio = F.when(F.col("weight") > 0, F.col("have") / F.col("weight")).otherwise(F.lit(float("inf")))
    siblings = Window.partitionBy(*above).orderBy(ratio, *PATH[: len(above) + 1])
    before = siblings.rowsBetween(Window.unboundedPreceding, -1)
    after = siblings.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = Window.partitionBy(*above)
    x = nodes.withColumns({"__before": F.coalesce(F.sum("have").over(before), F.lit(0.0)), "__weights": F.sum("weight").over(after)})
    x = x.withColumn("__level", F.when(F.col("__weights") > 0, (F.col("__budget") - F.col("__before")) / F.col("__weights")).otherwise(0.0))
    x = x.withColumn("__full", (F.col("weight") > 0) & (F.col("have") <= F.col("weight") * F.col("__level")))
    open_level = F.max(F.when(~F.col("__full"), F.struct(-F.col("__before"), F.col("__level").alias("level")))).over(full)["level"]
    x = x.withColumn("__open", F.coalesce(open_level, F.lit(0.0)))
    budget = F.when(F.col("__full"), F.col("have")).otherwise(F.greatest(F.lit(0.0), F.least("have", F.col("weight") * F.col("__open"))))
    return x.withColumn("budget", budget)


def thresholds(rows: DataFrame, mix: Mix) -> DataFrame:
    """PATH, tokens, budget, epochs, last of each leaf. rows: key, PATH, tokens, written already.

    epochs: whole ones; last: the largest hash that the next epoch takes, null for none."""
    leaves = rows.groupBy(*PATH).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    leaves = materialize(leaves, "mix-sums")
    b = budgets(leaves.select(*PATH, "tokens"), mix)
    # tiny shares are lost to rounding of doubles: a budget a hair below whole epochs counts as whole
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens") + 1e-9)).otherwise(0).cast("long")
    b = b.withColumn("epochs", whole).withColumn("rest", F.greatest(F.lit(0), F.floor(F.col("budget") - F.col("epochs") * F.col("tokens") + 1e-6)).cast("long"))
    sized = leaves.select(*(F.col(c).alias("__" + c) for c in PATH), F.ceil(F.col("n") / mix.range_rows).cast("int").alias("ranges"))
    leaf = materialize(b.join(sized, [b[c].eqNullSafe(sized["__" + c]) for c in PATH]).select(*b.columns, "ranges"), "mix-leaf")

    hashed = _with_leaf(rows, leaf.where("rest > 0"), ("epochs", "rest", "ranges"), mix, "inner")
    hashed = hashed.withColumn("h", place(F.col("key"), F.col("epochs"), mix.seed))
    # ranges of hashes, in order: the high 31 bits scaled to the number of ranges
    high = F.shiftright(F.col("h"), 32)
    hashed = hashed.withColumn("range", F.shiftright(high * F.col("ranges"), 31).cast("int"))
    sums = hashed.groupBy(*PATH, "rest", "range").agg(F.sum("tokens").alias("t"))
    upto = Window.partitionBy(*PATH).orderBy("range")
    sums = sums.withColumn("end", F.sum("t").over(upto)).where("end > rest")
    cut = sums.groupBy(*PATH).agg(F.min(F.struct("range", (F.col("rest") - F.col("end") + F.col("t")).alias("left"))).alias("cut"))
    cut = materialize(cut.select(*PATH, F.col("cut.range").alias("cut"), "cut.left"), "mix-cut")

    inside = _with_leaf(hashed, cut, ("cut", "left"), mix, "inner").where("range = cut")
    order = Window.partitionBy(*PATH).orderBy(F.col("h"))
    inside = inside.withColumn("upto", F.sum("tokens").over(order)).where("upto <= left")
    last = inside.groupBy(*PATH).agg(F.max(F.col("h")).alias("last"))
    done = _join_leaf(leaf, cut, ("cut",))
    done = _join_leaf(done, last, ("last",))
    # the whole ranges before the cut are taken; without a cut the rest takes all
    floor = F.when(F.col("cut") > 0, F.expr("(cut * 2147483648L + ranges - 1) div ranges * 4294967296L - 1"))
    last = F.when(F.col("rest") <= 0, F.lit(None)).when(F.col("cut").isNull(), F.lit((1 << 63) - 1)).otherwise(F.coalesce("last", floor))
    return materialize(done.select(*PATH, "tokens", "budget", "epochs", last.cast("long").alias("last")), "mix-thresholds")


def place(key: Column, epoch: Column, seed: int) -> Column:
    """The place of a key in an epoch's seeded order, from 0 to 2**63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, key), 1)


def _join_leaf(rows: DataFrame, leaf: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    side = leaf.select(*(F.col(c).alias("__" + c) for c in PATH), *cols)
    return rows.join(side, [rows[c].eqNullSafe(side["__" + c]) for c in PATH], "left").drop(*("__" + c for c in PATH))


def _with_leaf(rows: DataFrame, leaf: DataFrame, cols: tuple[str, ...], mix: Mix, how: str) -> DataFrame:
    """rows with columns of their leaf; the leaves are broadcast if there are no more than broadcast_leaves."""
    side = leaf.select(*(F.col(c).alias("__" + c) for c in PATH), *cols)
    few = leaf.limit(mix.broadcast_leaves + 1).count() <= mix.broadcast_leaves
    joined = rows.join(F.broadcast(side) if few else side, [rows[c].eqNullSafe(side["__" + c]) for c in PATH], how)
    return joined.drop(*("__" + c for c in PATH))


def copies(rows: DataFrame, leaf: DataFrame, mix: Mix) -> DataFrame:
    """rows (key, PATH and any others) with copies: how often each is taken. leaf: thresholds()."""
    x = _with_leaf(rows, leaf.withColumnRenamed("tokens", "leaf_tokens"), ("leaf_tokens", "budget", "epochs", "last"), mix, "left")
    more = (place(F.col("key"), F.col("epochs"), mix.seed) <= F.col("last")) & (F.col("leaf_tokens") > 0)
    return x.withColumn("copies", F.coalesce("epochs", F.lit(0)) + F.coalesce(more, F.lit(False)).cast("long")).drop("epochs", "last")


def keyed(docs: DataFrame, domain: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    return docs.select(F.col(key).alias("key"), domain.alias("domain"), F.col(lang).alias("lang"), F.col(source).alias("source"), tokens(F.col(text)).alias("tokens"))


def plan(docs: DataFrame, domain: Column, mix: Mix = Mix(), **names) -> DataFrame:
    """key, PATH, tokens, leaf_tokens, budget, copies: a row per document."""
    rows = materialize(keyed(docs, domain, **names), "mix-rows")
    return copies(rows, thresholds(rows, mix), mix)


def mixed(docs: DataFrame, domain: Column, mix: Mix = Mix(), key: str = "doc_id", lang: str = "lang", source: str = "source", **names) -> DataFrame:
    """The chosen documents with their own columns, each as often as it is taken."""
    rows = materialize(keyed(docs, domain, key=key, lang=lang, source=source, **names), "mix-rows")
    own = F.struct(*docs.columns)
    wide = docs.select(own.alias("__row"), F.col(key).alias("key"), domain.alias("domain"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    taken = copies(wide, thresholds(rows, mix), mix)
    each = taken.select("__row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("__k"))
    return each.select("__row.*")
