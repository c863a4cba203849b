"""Selectors and matchers: sets of globs over identifiers, as filters and as joins.

``is_match`` and ``matches`` differ on purpose. ``is_match`` asks of each component whether some
selector's glob takes it, so a match may draw on several selectors; an absent component counts
as U+FFFE, which only wildcards take. ``matches`` lists the selectors of which all five globs
take the identifier; an absent component is taken by all. Neither implies the other.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexaloc.functions import codec, ids
from hexaloc.functions.globs import Glob, GlobError, compile_glob

ABSENT = "￾"
#: The order in which components are tested: those that tell most come first.
TEST_ORDER = ("path", "context", "scheme", "binding", "fragment")


class SelectorError(ValueError):
    """code: backslash, length, cardinality, prefix or glob."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def decode(text: str) -> str:
    return unquote_to_bytes(text).decode("utf-8", "replace")


def encode(text: str) -> str:
    return "".join(f"%{b:02X}" if b < 32 or b > 126 or b == 58 else chr(b) for b in text.encode())


@dataclass(frozen=True, order=True)
class Selector:
    """A selector. Equality and order are those of its string."""

    text: str = ids.SELECTOR_NEW

    @staticmethod
    def parse(text: str) -> Selector:
        if "\\" in text:
            raise SelectorError(codec.BACKSLASH)
        if len(text.encode()) > codec.MAX_BYTES:
            raise SelectorError(codec.LENGTH)
        parts = text.split(":")
        if len(parts) != ids.PARTS:
            raise SelectorError(codec.CARDINALITY)
        if decode(parts[0]) != ids.SELECTOR_PREFIX:
            raise SelectorError(codec.PREFIX)
        return Selector(text)

    def get(self, name: str) -> str | None:
        return decode(self.text.split(":")[ids.PLACE[name]]) or None

    def with_(self, **components: str) -> Selector:
        parts = self.text.split(":")
        for name, value in components.items():
            if "\\" in value:
                raise SelectorError(codec.BACKSLASH)
            if len(encode(value).encode()) > codec.MAX_VALUE_BYTES:
                raise SelectorError(codec.LENGTH)
            parts[ids.PLACE[name]] = encode(value)
        if len(":".join(parts)) > codec.MAX_BYTES:
            raise SelectorError(codec.LENGTH)
        return Selector(":".join(parts))

    def __str__(self) -> str:
        return self.text


def to_selector(given: Selector | str) -> Selector:
    """Selectors pass as they are, strings are parsed."""
    return given if isinstance(given, Selector) else Selector.parse(given)


def compile_selector(given: Selector | str) -> dict[str, Glob]:
    selector = to_selector(given)
    try:
        return {name: compile_glob(selector.get(name)) for name in ids.COMPONENTS}
    except GlobError as e:
        raise SelectorError("glob") from e


@dataclass
class Builder:
    """M2-M5: collects selectors. One that fails to compile leaves nothing behind."""

    compiled: list[dict[str, Glob]] = field(default_factory=list)

    def add(self, selector: Selector | str) -> Builder:
        self.compiled.append(compile_selector(selector))
        return self

    def build(self) -> Matcher:
        return Matcher(tuple(self.compiled))


@dataclass(frozen=True)
class Matcher:
    """M1, M6-M8: a set of selectors, which are numbered as they were added."""

    compiled: tuple[dict[str, Glob], ...]

    @staticmethod
    def builder() -> Builder:
        return Builder()

    @staticmethod
    def of(*selectors: Selector | str) -> Matcher:
        made = Builder()
        for s in selectors:
            made.add(s)
        return made.build()

    def is_match(self, identifier: Column) -> Column:
        """Whether each component is taken by some selector's glob. Null for what is no identifier."""
        return F.when(ids.id_is_valid(identifier), self.is_match_parsed(ids.components(identifier)))

    def is_match_parsed(self, parsed: Column) -> Column:
        if not self.compiled:
            return F.lit(False)
        result = F.lit(True)
        for name in TEST_ORDER:
            value = F.coalesce(parsed[name], F.lit(ABSENT)) if name in ids.OPTIONAL else parsed[name]
            globs = dict.fromkeys(s[name] for s in self.compiled)
            if not any(g.kind == "all" for g in globs):
                result = result & _any_of(globs, value)
        return result

    def matches(self, identifier: Column) -> Column:
        """The numbers of the selectors that match as a whole, ascending. Null for what is no identifier."""
        return F.when(ids.id_is_valid(identifier), self.matches_parsed(ids.components(identifier)))

    def matches_parsed(self, parsed: Column) -> Column:
        found = []
        for i, s in enumerate(self.compiled):
            test = F.lit(True)
            for name in TEST_ORDER:
                if s[name].kind != "all":
                    one = s[name].predicate(parsed[name])
                    test = test & (F.coalesce(one, F.lit(True)) if name in ids.OPTIONAL else one)
            found.append(F.when(test, F.lit(i)))
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<int>")


def _any_of(globs: Iterable[Glob], value: Column) -> Column:
    """Whether one of the globs takes the value; equal texts become one IN, regexes one alternation."""
    globs = list(globs)
    equal = [g.text for g in globs if g.kind == "equals"]
    tests = [value.isin(equal)] if equal else []
    tests += [g.predicate(value) for g in globs if g.kind in ("prefix", "suffix")]
    for by_bytes in (False, True):
        regexes = [g for g in globs if g.kind == "regex" and g.by_bytes == by_bytes]
        if regexes:
            whole = "|".join(f"(?:{g.regex})" for g in regexes)
            tests.append(Glob("", "regex", "", whole, by_bytes).predicate(value))
    result = tests[0]
    for t in tests[1:]:
        result = result | t
    return result


# selectors that arrive as data


def compile_table(selectors: DataFrame, number: str = "idx", selector: str = "selector") -> DataFrame:
    """number, and for each component its regex, whether that is by bytes, and its text if it is one literal.

    A selector that doesn't compile stops the job with its error code."""

    def run(frames):
        for f in frames:
            rows = []
            for n, s in zip(f[number], f[selector]):
                row = {"__n": n}
                for name, g in compile_selector(s).items():
                    row |= {f"{name}_re": None if g.kind == "all" else g.anchored, f"{name}_by": g.by_bytes, f"{name}_eq": g.text if g.kind == "equals" else None}
                rows.append(row)
            yield pd.DataFrame(rows, columns=columns)

    fields = [f"{name}_{x} {kind}" for name in ids.COMPONENTS for x, kind in (("re", "string"), ("by", "boolean"), ("eq", "string"))]
    columns = ["__n", *(f.split()[0] for f in fields)]
    return selectors.select(F.col(number).cast("int").alias(number), selector).mapInPandas(run, "__n int, " + ", ".join(fields))


def match_pairs(rows: DataFrame, selectors: DataFrame, identifier: str = "id", number: str = "idx", selector: str = "selector") -> DataFrame:
    """M7 as a join: each row with each selector (number) that matches its identifier as a whole.

    Selectors with a literal scheme meet the rows by a hash join on it, the others by a theta
    join. Rows whose identifier is invalid match nothing."""
    table = compile_table(selectors, number, selector)
    parsed = codec.once(rows, "__p", ids.try_id_parse(F.col(identifier))).where("__p is not null")
    p = F.col("__p")
    test = F.lit(True)
    for name in TEST_ORDER:
        re, by = F.col(f"{name}_re"), F.col(f"{name}_by")
        value = p[name]
        hit = F.when(by, F.rlike(F.decode(F.encode(value, "UTF-8"), "ISO-8859-1"), re)).otherwise(F.rlike(value, re))
        free = re.isNull() | value.isNull() if name in ids.OPTIONAL else re.isNull()
        test = test & (free | hit)
    keyed = parsed.join(table.where("scheme_eq is not null"), (p["scheme"] == F.col("scheme_eq")) & test)
    theta = parsed.join(table.where("scheme_eq is null"), test)
    return keyed.unionByName(theta).select(*rows.columns, F.col("__n").alias(number))


def matches_table(rows: DataFrame, selectors: DataFrame, key: str, identifier: str = "id", number: str = "idx", selector: str = "selector") -> DataFrame:
    """key, matches: for each row (key tells rows apart) the ascending numbers of its selectors."""
    found = match_pairs(rows.select(key, identifier), selectors, identifier, number, selector).groupBy(key).agg(F.array_sort(F.collect_set(number)).alias("matches"))
    left = rows.select(key, identifier).join(found.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")), "left")
    none = F.array().cast("array<int>")
    return left.select(key, F.when(ids.id_is_valid(F.col(identifier)), F.coalesce("matches", none)).alias("matches"))


def match_semi(rows: DataFrame, matcher: Matcher, identifier: str = "id") -> DataFrame:
    """Rows that some selector matches as a whole."""
    return rows.where(F.size(matcher.matches(F.col(identifier))) > 0)


def match_anti(rows: DataFrame, matcher: Matcher, identifier: str = "id") -> DataFrame:
    """Rows with a valid identifier that no selector matches as a whole."""
    return rows.where(F.size(matcher.matches(F.col(identifier))) == 0)


def match_explode(rows: DataFrame, matcher: Matcher, identifier: str = "id", number: str = "idx") -> DataFrame:
    """A row for each row and selector that matches it as a whole."""
    return rows.withColumn(number, F.explode(matcher.matches(F.col(identifier))))
