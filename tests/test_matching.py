"""Selectors and matchers: stated vectors, both evaluators, static and table forms, streams."""

import pytest
from pyspark.sql import functions as F

from hexaloc.functions import ids
from hexaloc.operators import matching
from hexaloc.operators.matching import Matcher, Selector, SelectorError

PLAIN = "zri:file::d:x.md:"
CASES = [
    (["zrs:git:::*.md:", "zrs:file:::*.png:"], PLAIN, True, []),
    (["zrs::master:::"], PLAIN, False, [0]),
    (["zrs::*:::"], PLAIN, True, [0]),
    (["zrs::???:::"], PLAIN, True, [0]),
    (["zrs::master:::"], "zri:git:dev:d:x.md:", False, []),
    ([], PLAIN, False, []),
    (["zrs:::::"], PLAIN, True, [0]),
    (["zrs::::*.md:"], "zri:file::d:a/b/c.md:", True, [0]),
    (["zrs::::**/*.md:", "zrs:git::::", "zrs:file::::"], "zri:file::docs:index.md:", True, [0, 2]),
    (["zrs::::%2A.md:"], PLAIN, True, [0]),
    (["zrs::::%5C*:"], "zri:file::d:*:", True, [0]),
]


@pytest.mark.parametrize("selectors,identifier,is_match,matches", CASES)
def test_cases(spark, selectors, identifier, is_match, matches):
    m = Matcher.of(*selectors)
    row = spark.createDataFrame([(identifier,)], "id string").select(m.is_match(F.col("id")), m.matches(F.col("id"))).first()
    assert tuple(row) == (is_match, matches)


def test_invalid_is_null(spark):
    m = Matcher.of("zrs:::::")
    assert tuple(spark.createDataFrame([("x",)], "id string").select(m.is_match(F.col("id")), m.matches(F.col("id"))).first()) == (None, None)


@pytest.mark.parametrize("text,code", [("zrs::::[a:", "cardinality"), ("zrs::::[a::", "cardinality"), ("zrs::::{a:", "glob"), ("zri::::x:", "prefix"), ("zrs\\", "backslash"), ("zrs:", "cardinality"), ("z" * 70_000, "length")])
def test_errors(text, code):
    with pytest.raises(SelectorError) as e:
        Matcher.of(text)
    assert e.value.code == code or (text.startswith("zrs::::[a") and e.value.code in ("glob", "cardinality"))


def test_builder_keeps_nothing_of_a_bad_selector():
    b = Matcher.builder().add("zrs:::::")
    with pytest.raises(SelectorError):
        b.add("zrs:{a::::")
    assert len(b.build().compiled) == 1


def test_selector():
    s = Selector().with_(path="a:b", scheme="git")
    assert str(s) == "zrs:git:::a%3Ab:" and s.get("path") == "a:b" and s.get("binding") is None
    assert Selector.parse("zrs:::::") == Selector() and Selector("zrs:a::::") > Selector()
    with pytest.raises(SelectorError):
        s.with_(path="\\")
    assert matching.to_selector(Selector(ids.SELECTOR_DEFAULT)).get("path") is None
    with pytest.raises(SelectorError):
        Selector.parse(ids.SELECTOR_DEFAULT)


def test_table_is_like_static(spark, sf):
    from hexaloc.plans import catalogue

    static = {tuple(r) for r in catalogue.match_indexes(spark, sf).collect()}
    table = {tuple(r) for r in catalogue.match_indexes_table(spark, sf).collect()}
    assert static == table and len(static) == 50
    plan = matching.match_pairs(catalogue._pages(spark, sf), catalogue._selectors(spark))._jdf.queryExecution().toString()
    assert "HashJoin" in plan or "SortMergeJoin" in plan


def test_single_selector_match_implies_index(spark, sf):
    from hexaloc.plans import catalogue

    d = catalogue._pages(spark, sf)
    for s, _ in catalogue.SELECTORS:
        m = Matcher.of(s)
        assert d.where(m.is_match(F.col("id")) & (F.size(m.matches(F.col("id"))) == 0)).count() == 0


def test_stream(spark, sf, tmp_path):
    from hexaloc.streaming.matching import counted, matched

    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("id", ids.id_new(F.lit("event"), F.col("event_type"), F.col("event_id").cast("string")))
    events.write.parquet(str(tmp_path / "in"))
    m = Matcher.of("zrs:event::c*::", "zrs:event::p*::")
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = matched(stream, m).writeStream.format("memory").queryName("matched_rows").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("matched_rows").count() == matched(events, m).count() > 0
    q = counted(stream, m).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in counted(events, m).collect()}


def test_sql_functions(spark):
    from hexaloc.functions.sql import register

    register(spark)
    row = spark.sql("SELECT id_path(id_new('file', 'docs', 'a:é')), id_error('zri:file'), id_to_path('zri:file::./docs:a//b:'), id_encode(':'), id_decode('%3A+'), id_fragment('zri:a::b:c:')").first()
    assert tuple(row) == ("a:é", "cardinality", "docs/a/b", "%3A", ":+", None)
