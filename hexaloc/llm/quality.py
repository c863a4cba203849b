"""Quality rules with host-level verdicts, in DataFrame functions alone.

Each document is measured over its whole text. Documents that break a base rule
fail. All rules, the softer ones included, also count against the document's host:
failures are aggregated by host, each host's rate is shrunk towards the corpus by
a beta prior that is fitted to the hosts themselves, and the verdict on the host
is joined back to its documents.

Defined results: a null or blank text has no words and fails; a null host is a host
of its own; no rows give no rows; columns named like a measure are replaced only in
``judge``'s own output, which holds the key, the host and the measures.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexaloc.llm._shared import SPACES, let, materialize, words

WINDOW = 8


@dataclass(frozen=True)
class HostRules:
    """min_words and max_repeat_pct are the base rules. The others count for the host only."""

    min_words: int = 20
    max_repeat_pct: int = 30
    max_symbol_pct: int = 10
    max_dup_line_pct: int = 30
    #: A host is rejected if its shrunk failure rate, less deviations times its spread, is above this.
    host_rate: float = 0.6
    deviations: float = 2.0


def covered_words(grams: Column, window: int = WINDOW) -> Column:
    """How many words the windows cover that occur twice or more, from the hashes of all windows."""
    order = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    starts = let(
        order,
        lambda s: F.array_sort(
            F.transform(
                F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])),
                lambda x: x["p"],
            )
        ),
    )
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
    return F.aggregate(
        starts,
        first,
        lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )


def with_measures(df: DataFrame, text: str) -> DataFrame:
    """df and its texts' measures (longs), in columns that start with __.

    A column for each step, each read more than once, so that the optimizer keeps it and
    no step is computed twice. The hash of eight words is built by doubling: two words,
    then two pairs, then two fours."""

    def doubled(h: str, by: int) -> Column:
        return F.transform(F.col(h), lambda x, i: F.xxhash64(x, F.get(F.col(h), i + by)))

    w, g = F.col("__w"), F.col("__g")
    symbols = F.when(F.col("__t").rlike(r"[#*$%&|<>]"), F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).otherwise(0)
    return (
        df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
        .withColumn("__w", words(F.col("__t")))
        .withColumn("__lines", F.filter(F.split("__t", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0))
        .withColumns(
            {
                "__n_words": F.size(w).cast("long"),
                "__word_chars": F.length(F.array_join(w, "")).cast("long"),
                "__n_symbols": symbols.cast("long"),
                "__n_lines": F.size("__lines").cast("long"),
                "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
                "__h1": F.transform(w, lambda x: F.xxhash64(x)),
            }
        )
        .withColumn("__h2", doubled("__h1", 1))
        .withColumn("__h4", doubled("__h2", 2))
        .withColumn("__g", F.when(F.size("__h4") > WINDOW, F.slice(doubled("__h4", 4), F.lit(1), F.size("__h4") - (WINDOW - 1))))
        .withColumn("__n_repeat_words", F.when(F.size(F.array_distinct(g)) < F.size(g), covered_words(g)).otherwise(F.lit(0).cast("long")))
        .drop("__t", "__w", "__lines", "__h1", "__h2", "__h4", "__g")
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def base_fault(rules: HostRules) -> Column:
    return (F.col("__n_words") < rules.min_words) | (100 * F.col("__n_repeat_words") > rules.max_repeat_pct * F.col("__n_words"))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", rules: HostRules = HostRules()) -> DataFrame:
    """Key, host, measures, base_failed and failed (any rule) of every row."""
    m = with_measures(docs.select(F.col(key).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("__text")), "__text")
    soft = (100 * F.col("n_symbols") > rules.max_symbol_pct * F.col("word_chars")) | (100 * F.col("n_dup_lines") > rules.max_dup_line_pct * F.col("n_lines"))
    m = m.select("doc_id", "host", *(F.col("__" + x).alias(x) for x in MEASURES), base_fault(rules).alias("base_failed"))
    return m.withColumn("failed", F.col("base_failed") | soft)


def host_verdicts(rows: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """host, n, failures, rate (shrunk), spread, rejected: a row per host.

    The prior's strength comes from the spread of the hosts' rates beyond what chance
    alone gives (method of moments). Only the three sums for it reach the driver."""
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("failures"))
    total = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("n").alias("n"),
        F.sum("failures").alias("failures"),
        F.sum((F.col("failures") * F.col("failures") / F.col("n")).cast("decimal(30,6)")).alias("squares"),
    ).first()
    alpha, beta = beta_prior(total["hosts"], total["n"] or 0, total["failures"] or 0, float(total["squares"] or 0))
    a, b = F.col("failures") + alpha, F.col("n") - F.col("failures") + beta
    rate, spread = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", "n", "failures", rate.alias("rate"), spread.alias("spread"), (rate - rules.deviations * spread > rules.host_rate).alias("rejected"))


def beta_prior(hosts: int, n: int, failures: int, squares: float) -> tuple[float, float]:
    """alpha and beta of the prior. squares: the sum of failures * failures / n over hosts."""
    if not n:
        return 0.5, 0.5
    mean = min(max(failures / n, 0.5 / (n + 1)), 1 - 0.5 / (n + 1))
    between = (squares - failures * failures / n) / n - hosts * mean * (1 - mean) / n
    strength = 10_000.0 if between <= 0 else min(max(mean * (1 - mean) / between - 1, 1.0), 10_000.0)
    return round(mean * strength, 9), round((1 - mean) * strength, 9)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", rules: HostRules = HostRules()) -> DataFrame:
    """doc_id, host, measures, base_failed, failed, host_rate, kept: a row per document.

    The texts are read once: the narrow measures are written to the shared folder, and
    both the hosts' figures and the documents' verdicts come from there."""
    rows = materialize(measured(docs, key, text, host, rules), "quality")
    verdicts = host_verdicts(rows, rules).select(F.col("host").alias("__host"), F.col("rate").alias("host_rate"), "rejected")
    joined = rows.join(verdicts, rows["host"].eqNullSafe(verdicts["__host"]), "left")
    return joined.select(*rows.columns, "host_rate", (~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).alias("kept"))


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", rules: HostRules = HostRules(), host_limit: int = 10_000) -> DataFrame:
    """The documents that pass, with their own columns, whatever their names.

    Two passes over the texts instead of moving them: one for the hosts' figures, one that
    drops rows. Rejected hosts are broadcast if they were counted to be at most host_limit;
    more are joined by a shuffle."""
    rows = materialize(measured(docs, key, text, host, rules).select("host", "failed"), "quality-hosts")
    bad = host_verdicts(rows, rules).where("rejected").select(F.col("host").alias("__host"))
    few = bad.limit(host_limit + 1).count() <= host_limit
    # a generator, since a filter would be pushed below the measures and compute them twice
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("__doc"), docs[text].alias("__text"), docs[host].alias("__of"))
    good = with_measures(packed, "__text").withColumn("__keep", F.explode(F.when(base_fault(rules), F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))))
    good = good.select("__doc", "__of")
    return good.join(F.broadcast(bad) if few else bad, good["__of"].eqNullSafe(bad["__host"]), "left_anti").select("__doc.*")
