"""The glob grammar, in Python and as predicates, and its errors."""

import pytest

from hexaloc.functions.globs import GlobError, compile_glob

CASES = [
    ("**", "", True), ("*", "a/b", True), ("*.md", "a/b/c.md", True), ("**/*.md", "index.md", True), ("**/*.md", "a/index.md", True), ("**/*.md", "x.mdx", False),
    ("a/**", "a", False), ("a/**", "a/", True), ("a/**", "a/b/c", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("a/**/b", "ab", False),
    ("a**", "abc", True), ("?", "a", True), ("?", "é", False), ("??", "é", True), ("???", "￾", True), ("*", "￾", True),
    ("[ab]", "b", True), ("[!ab]", "b", False), ("[^ab]", "c", True), ("[a-c]x", "bx", True), ("[]a]", "]", True), ("[a-]", "-", True),
    ("{a,b}c", "bc", True), ("{a,{b,c}}", "c", True), ("x{,y}", "x", False), ("x{,y}", "xy", True), ("a,b", "a,b", True),
    ("a.b", "axb", False), ("\\*", "*", True), ("\\*", "a", False), ("a", "a\n", False), ("a+(b)", "a+(b)", True), ("é*", "éx", True),
]


@pytest.mark.parametrize("glob,text,expected", CASES)
def test_python(glob, text, expected):
    assert compile_glob(glob).matches(text) is expected


def test_columns(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES)], "i int, t string")
    case = F.coalesce(*(F.when(F.col("i") == i, compile_glob(g).predicate(F.col("t"))) for i, (g, _, _) in enumerate(CASES)))
    got = {r["i"]: r["x"] for r in rows.select("i", case.alias("x")).collect()}
    assert [got[i] for i in range(len(CASES))] == [e for _, _, e in CASES]


@pytest.mark.parametrize("glob", ["[a", "[a:", "[", "[!", "[z-a]", "{a", "a}", "{a,{b}", "x\\"])
def test_errors(glob):
    with pytest.raises(GlobError):
        compile_glob(glob)


@pytest.mark.parametrize("glob,kind", [("**", "all"), (None, "all"), ("*", "all"), ("a/b", "equals"), ("a*", "prefix"), ("*b", "suffix"), ("**/*.md", "suffix"), ("a/**", "regex"), ("?", "regex")])
def test_reduction(glob, kind):
    assert compile_glob(glob).kind == kind
