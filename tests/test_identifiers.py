"""Codec, records, identifiers, paths and exact mode on stated vectors."""

import time

import pytest
from pyspark.sql import functions as F

from hexaloc.functions import codec, exact, ids, paths, sql


def values(spark, given, *columns):
    """The columns, functions of the column s, for each given string, in order."""
    rows = spark.createDataFrame(list(enumerate(given)), "i int, s string").orderBy("i")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows.select("i", *(c(F.col("s")).alias(f"c{k}") for k, c in enumerate(columns))).collect()]


def test_codec(spark):
    given = ["", "plain/x y+z", "a:b", "é", "😀:", "\n\t\x7f", "100%", "a%20b", "\\", ":"]
    assert values(spark, given, codec.percent_encode) == ["", "plain/x y+z", "a%3Ab", "%C3%A9", "%F0%9F%98%80%3A", "%0A%09%7F", "100%", "a%20b", "\\", "%3A"]
    assert values(spark, ["100%", "%%41", "%zz", "a+b", "%FF", "%2541", "%C3%A9", "%e9x", ""], codec.percent_decode) == ["100%", "%A", "%zz", "a+b", "�", "%41", "é", "�x", ""]
    clean = [x for x in given if "%2" not in x]
    assert values(spark, clean, lambda s: codec.percent_decode(codec.percent_encode(s))) == clean
    assert values(spark, given, lambda s: codec.percent_decode(codec.percent_encode_strict(s))) == given


def test_codec_alphabet(spark):
    """Every ASCII character and some of each further length, alone and in runs."""
    signs = [chr(i) for i in (*range(128), 0x80, 0xFF, 0x7FF, 0x800, 0x20AC, 0xFFFD, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF)]
    given = [*signs, "".join(signs), "".join(signs[::-1]) * 2, "%3A%zz%", "%25é%", "+ +:%2B", "%%0A\n"]
    each = lambda more: ["".join(c if " " <= c <= "~" and c not in ":" + more else "".join(f"%{b:02X}" for b in c.encode()) for c in s) for s in given]
    sql.register(spark)
    assert values(spark, given, codec.percent_encode) == values(spark, given, lambda s: F.expr("id_encode(s)")) == each("")
    assert values(spark, given, codec.percent_encode_strict) == each("%\\")
    assert values(spark, [None], codec.percent_encode, codec.percent_encode_strict) == [(None, None)]


def test_codec_cost(spark):
    """Seconds to encode texts of short runs, and to set them as a part, against those of one url_encode."""
    texts = spark.range(0, 64, 1, 4).select(F.repeat(F.concat(F.lit("as most words are, plain (a-z); été: 1\n"), F.col("id").cast("string")), F.lit(8_000)).alias("s"))
    s = F.col("s")

    def seconds(*columns):
        each = []
        for _ in range(4):
            at = time.perf_counter()
            texts.select(*(F.octet_length(c) for c in columns)).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - at)
        return min(each)

    base = seconds(F.url_encode(s))
    assert seconds(codec.percent_encode(s)) < 8 * base
    error = codec.set_error(F.lit("a:b"), 1, codec.percent_encode(s))
    assert seconds(error, codec.try_fmt_set(F.lit("a:b"), 1, s)) < 8 * base


def test_records(spark):
    abc = codec.fmt_set(codec.fmt_set(codec.fmt_set(codec.fmt_new(3), 0, F.lit("a")), 1, F.lit("b")), 2, F.lit("c"))
    assert values(spark, ["x"], lambda s: abc, lambda s: codec.fmt_get(abc, 0)) == [("a:b:c", "a")]
    assert values(spark, ["a:b:c", "a:b", "a:b:c:d", "x" * 65536, "::"], lambda s: codec.fmt_error(s, 3)) == [None, "cardinality", "cardinality", "length", None]
    assert values(spark, ["a:%3A:c", "a:b:%41", "100%:x:"], codec.fmt_flags) == [2, 4, 0]
    spans = values(spark, ["é:bc:"], codec.fmt_spans)[0]
    assert [(s["start"], s["end"]) for s in spans] == [(0, 2), (3, 5), (6, 6)]
    assert values(spark, ["a:b:c"], lambda s: codec.try_fmt_set(s, 1, F.repeat(F.lit("x"), F.lit(32_768))), lambda s: F.length(codec.try_fmt_set(s, 1, F.repeat(F.lit("x"), F.lit(32_767))))) == [(None, 32_771)]
    assert values(spark, ["b:c:d"], lambda s: s > "a:b:c", lambda s: s == "b:c:d") == [(True, True)]
    assert '"flags":2' in values(spark, ["a:%41"], codec.fmt_debug)[0]
    with pytest.raises(ValueError):
        codec.fmt_new(65)


def test_nulls_and_what_is_no_identifier(spark):
    """Defined results: null stays null everywhere; what is no identifier gives null, or its error."""
    given = [None, "", "x", "abc:file::docs:x:", "zri:file::docs:x", "zri:file::docs:", "zri:file::docs:x:", "zri:file::docs:a%3Ab:", "zri:file::docs:x\\:"]
    errors = [None, "cardinality", "cardinality", "prefix", "cardinality", "cardinality", None, None, "backslash"]
    assert values(spark, given, paths.path_error) == errors
    assert values(spark, given, paths.try_id_to_path) == [None] * 6 + ["docs/x", "docs/a:b", None]
    assert values(spark, given, lambda s: ids.set_error(s, "path", F.lit("y"))) == errors
    assert values(spark, given, lambda s: ids.try_id_set(s, "path", F.lit("y"))) == [None] * 6 + ["zri:file::docs:y:"] * 2 + [None]
    assert values(spark, given, lambda s: ids.try_id_set(s, "path", F.lit(None).cast("string"))) == [None] * 9
    assert [x is None for x in values(spark, given, ids.id_debug_json)] == [True] * 6 + [False] * 2 + [True]
    null = F.lit(None).cast("string")
    assert values(spark, ["a:b:c"], lambda s: codec.try_fmt_set(s, 1, null), lambda s: codec.fmt_set(s, 1, null), lambda s: codec.try_fmt_set(s, 3, F.lit("x"))) == [(None, None, None)]
    assert values(spark, ["a:b:c", None], lambda s: codec.set_error(s, 9, F.lit("x"))) == ["cardinality", None]
    sql.register(spark)
    by_sql = [f"id_to_path(s)", "id_set_path(s, 'y')", "id_set_path(s, CAST(NULL AS STRING))", "id_error(s)"]
    columns = [paths.try_id_to_path, lambda s: ids.try_id_set(s, "path", F.lit("y")), lambda s: null, ids.id_error]
    for text, column in zip(by_sql, columns):
        assert values(spark, given, lambda s, text=text: F.expr(text)) == values(spark, given, column)
    assert values(spark, given, lambda s: F.expr("id_is_valid(s)")) == [x in (6, 7) for x in range(9)]
    assert values(spark, given, lambda s: F.expr("id_parse(s).path")) == [None] * 6 + ["x", "a:b", None]
    assert values(spark, ["zri:file::docs:x:"], lambda s: F.expr("id_set_path(s, 'é:😀 a\n\nb')")) == ["zri:file::docs:%C3%A9%3A%F0%9F%98%80 a%0A%0Ab:"]
    for bad in ("x", "abc:file::docs:x:"):
        for strict in (paths.id_to_path, lambda s: ids.id_set(s, "path", F.lit("y"))):
            with pytest.raises(Exception, match="cardinality|prefix"):
                values(spark, [bad], strict)


def test_spans(spark):
    s = codec.span(F.lit(0), F.lit(2))
    got = values(
        spark,
        ["x"],
        lambda _: codec.span_shift(s, 2),
        lambda _: codec.span_shift_start(codec.span(F.lit(2), F.lit(4)), -2),
        lambda _: codec.span_shift_end(s, 2),
        lambda _: codec.span_shift(s, -1),
        lambda _: codec.span_shift(s, 65_534),
        lambda _: codec.span_len(s),
        lambda _: codec.span_is_empty(s),
        lambda _: codec.spans_init(2),
    )[0]
    assert [tuple(x) if x else x for x in got[:5]] == [(2, 4), (0, 4), (0, 4), None, None]
    assert got[5:7] == (2, False) and [tuple(x) for x in got[7]] == [(0, 0), (1, 1)]


PARSES = [
    ("zri:file::docs:index.md:", ("file", None, "docs", "index.md", None)),
    ("zri:git:master:docs:index.md:top", ("git", "master", "docs", "index.md", "top")),
    ("zri:file::docs:a%3Ab.md:", ("file", None, "docs", "a:b.md", None)),
    ("zri:file::docs:100%:", ("file", None, "docs", "100%", None)),
    ("zri:file::docs:%%41:", ("file", None, "docs", "%A", None)),
    ("zri:file::docs:%FF:", ("file", None, "docs", "�", None)),
    ("zri:file::docs:a+b:", ("file", None, "docs", "a+b", None)),
    ("z%72i:file::docs:x:", ("file", None, "docs", "x", None)),
    ("zri:file::docs:a%5Cb:", ("file", None, "docs", "a\\b", None)),
    ("zri:file::docs:x", None),
    (None, None),
]


def test_parse(spark):
    got = values(spark, [s for s, _ in PARSES], ids.try_id_parse)
    assert [tuple(x) if x else None for x in got] == [e for _, e in PARSES]
    valid = [s for s, e in PARSES if e]
    again = values(spark, valid, lambda s: ids.try_id_parse(ids.id_canonicalize(s)), lambda s: ids.try_id_parse(ids.id_format(ids.id_parse(s))), ids.try_id_parse)
    assert all(a == b == c for a, b, c in again)
    with pytest.raises(Exception, match="cardinality"):
        values(spark, ["zri:x"], ids.id_parse)


def test_precedence(spark):
    from hexaloc.plans.catalogue import FAULTS

    given = [*FAULTS, ("x" * 65_536, "length"), ("\\" * 65_536, "backslash")]
    assert values(spark, [s for s, _ in given], ids.id_error) == [e for _, e in given]


def test_build(spark):
    new = lambda a, b, c: lambda _: ids.try_id_new(F.lit(a), F.lit(b), F.lit(c))
    got = values(spark, ["x"], new("file", "docs", "a:b"), new("file", "docs", "é"), new("", "", ""), new("a\\", "b", "c"), lambda _: ids.component(ids.id_new(F.lit("file"), F.lit("docs"), F.lit("a%20b")), "path"))[0]
    assert got == ("zri:file::docs:a%3Ab:", "zri:file::docs:%C3%A9:", "zri:::::", None, "a b")
    base = "zri:file::docs:x:"
    for name in ids.COMPONENTS:
        assert values(spark, [base], lambda s, name=name: ids.component(ids.id_set(s, name, F.lit("v:é")), name)) == ["v:é"]
    assert values(spark, [base], lambda s: ids.id_set(s, "scheme", F.lit("")), lambda s: ids.set_error(s, "path", F.lit("a\\")), lambda s: ids.set_error(s, "path", F.repeat(F.lit("x"), F.lit(32_768)))) == [("zri:::docs:x:", "backslash", "length")]


@pytest.mark.parametrize(
    "context,path,expected",
    [("./d", "./a//b/.", "d/a/b"), ("docs", "../a", "parent_dir"), ("docs", "/a", "root_dir"), ("/d", "../a", "root_dir"), ("../d", "/a", "root_dir"), ("docs", "%2E%2E/a", "parent_dir"), ("docs", "index.md", "docs/index.md")],
)
def test_paths(spark, context, path, expected):
    made = ids.id_new(F.lit("file"), F.lit(context), F.lit(path))
    error, got = values(spark, ["x"], lambda _: paths.path_error(made), lambda _: paths.try_id_to_path(made))[0]
    assert (error or got) == expected and (error is None) == (got is not None)


def test_exact(spark):
    def one(value):
        made = exact.try_exact_set(exact.exact_new(6), 4, F.lit(value))
        return lambda _: exact.exact_get(made, 4)

    assert values(spark, ["x"], one("a%20b"), one(":"), one("é"), one(":%41")) == [("a%20b", "%3A", "é", ":A")]


def test_pushdown(spark, tmp_path):
    from hexaloc.sources import tables

    rows = spark.createDataFrame([("zri:file::a:b:",), ("zri:git::a:b:",)], "id string")
    tables.write_by_scheme(rows, str(tmp_path / "t"))
    back = tables.read(spark, str(tmp_path / "t"))
    assert back.where("scheme = 'git'").count() == 1
    plan = back.where(ids.scheme_prefix(F.col("id"), "git"))._jdf.queryExecution().toString()
    assert "StringStartsWith(id,zri:git:)" in plan
