"""The catalogue of identifier queries and of the SQL that checks them.

Identifiers come from the addresses of ``pages`` and from the sources of ``documents``;
``conversations`` stress the codec. Lists are written as text, so that any engine compares them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hexaloc.functions import codec, exact, ids, paths
from hexaloc.functions.globs import compile_glob
from hexaloc.operators import matching
from hexaloc.operators.matching import Matcher
from hexaloc.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.page_ids(tables.read(spark, f"{sf_dir}/pages.parquet").select("page_id", "url"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.document_ids(tables.read(spark, f"{sf_dir}/documents.parquet"))


def _listed(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), ",")


# SQL building blocks


def _enc(x: str) -> str:
    return (
        rf"array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: CASE WHEN regexp_matches(c, '[\x00-\x1F\x7F:]|[^\x00-\x7F]') "
        rf"THEN regexp_replace(hex(encode(c)), '(..)', '%\1', 'g') ELSE c END), '')"
    )


URLS = r"""u AS (SELECT page_id, url, regexp_extract(url, '^(https?)', 1) AS scheme, regexp_extract(url, '^https?://([^/#]*)', 1) AS context,
  regexp_extract(url, '^https?://[^/#]*/?([^#]*)', 1) AS path, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages),
p AS (SELECT *, 'zri:' || scheme || '::' || context || ':' || """ + _enc("path") + " || ':' || " + _enc("fragment") + r""" AS id FROM u)"""


# codec


@query(f"SELECT conv_id, turn, coalesce({_enc('text')}, '') AS encoded FROM conversations")
def codec_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", codec.percent_encode(F.col("text")).alias("encoded"))


@query(
    "SELECT conv_id, turn, url_decode(replace(replace(replace(text, '%', '%25'), ' ', '%20'), 'é', '%C3%A9')) AS decoded, text AS round_trip FROM conversations"
)
def codec_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    escaped = F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20")), F.lit("é"), F.lit("%C3%A9"))
    c = tables.read(spark, f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", codec.percent_decode(escaped).alias("decoded"), codec.percent_decode(codec.percent_encode(text)).alias("round_trip"))


# records


@query(f"WITH {URLS} SELECT page_id, len(string_split(id, ':')) AS n, string_split(id, ':')[1] AS p0, string_split(id, ':')[4] AS p3, path AS p4, fragment AS p5 FROM p")
def fmt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("id")
    return _pages(spark, sf_dir).select(
        "page_id", F.size(codec.parts(r)).cast("long").alias("n"), *(codec.fmt_get(r, i).alias(f"p{i}") for i in (0, 3, 4, 5))
    )


@query(
    f"""WITH {URLS}, q AS (SELECT page_id, string_split(id, ':') AS a FROM p)
SELECT page_id, strlen(a[1]) + strlen(a[2]) + strlen(a[3]) + 3 AS start3, strlen(a[1]) + strlen(a[2]) + strlen(a[3]) + strlen(a[4]) + 3 AS end3,
  strlen(a[5]) AS len4, a[6] = '' AS empty5, strlen(a[1]) + strlen(a[2]) + strlen(a[3]) + 5 AS shifted FROM q"""
)
def fmt_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _pages(spark, sf_dir).withColumn("s", codec.fmt_spans(F.col("id")))
    s = lambda i: F.get("s", F.lit(i))
    return d.select(
        "page_id",
        s(3)["start"].cast("long").alias("start3"),
        s(3)["end"].cast("long").alias("end3"),
        codec.span_len(s(4)).cast("long").alias("len4"),
        codec.span_is_empty(s(5)).alias("empty5"),
        codec.span_shift(s(3), 2)["start"].cast("long").alias("shifted"),
    )


@query(
    f"""SELECT conv_id, turn, CAST(CASE WHEN regexp_matches(e, '%[0-9A-Fa-f]{{2}}') THEN 2 ELSE 0 END AS BIGINT) AS flags
FROM (SELECT conv_id, turn, {_enc('text')} AS e FROM conversations)"""
)
def fmt_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, f"{sf_dir}/conversations.parquet")
    record = F.concat(F.lit("a:"), codec.percent_encode(F.col("text")), F.lit(":c"))
    return c.select("conv_id", "turn", codec.fmt_flags(record).alias("flags"))


@query(
    f"""WITH e AS (SELECT doc_id, 'zri:file::' || source || ':' || lang || '/' || doc_id || '.md:' AS id, strlen({_enc('text')}) AS n FROM documents)
SELECT doc_id, CASE WHEN n > 32767 OR strlen(id) + n > 65535 THEN 'length' END AS error, CASE WHEN n <= 32767 AND strlen(id) + n <= 65535 THEN strlen(id) + n END AS bytes FROM e"""
)
def fmt_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    error = codec.set_error(F.col("id"), 5, codec.percent_encode(F.col("text")))
    return d.select("doc_id", error.alias("error"), F.octet_length(codec.try_fmt_set(F.col("id"), 5, F.col("text"))).cast("long").alias("bytes"))


# identifiers


@query(f"WITH {URLS} SELECT page_id, id FROM p")
def id_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", "id")


@query(f"WITH {URLS} SELECT page_id, scheme, CAST(NULL AS VARCHAR) AS binding, context, path, nullif(fragment, '') AS fragment FROM p")
def id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", ids.id_parse(F.col("id")).alias("p")).select("page_id", "p.*")


@query("SELECT doc_id, 'file' AS scheme, source AS context, lang || '/' || doc_id || '.md' AS path FROM documents")
def id_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", *(ids.component(F.col("id"), n).alias(n) for n in ids.REQUIRED))


@query("""SELECT doc_id, '{"scheme":"file","context":"' || source || '","path":"' || lang || '/' || doc_id || '.md"}' AS debug FROM documents""")
def id_debug_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", ids.id_debug_json(F.col("id")).alias("debug"))


def _setter(name: str) -> None:
    i = ids.PLACE[name]
    value = _enc("p_brand")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = ids.id_new(F.lit("part"), F.col("p_type"), F.col("p_name"))
        d = tables.read(spark, f"{sf_dir}/part.parquet")
        return d.select("p_partkey", ids.id_set(base, name, F.col("p_brand")).alias("id"))

    slots = ["'zri'", "'part'", "''", _enc("p_type"), _enc("p_name"), "''"]
    slots[i] = value
    QUERIES[f"id_set_{name}"] = run
    ORACLES[f"id_set_{name}"] = f"SELECT p_partkey, {' || chr(58) || '.join(slots)} AS id FROM part"


for _name in ids.COMPONENTS:
    _setter(_name)

#: Strings with the code of the first thing that is wrong with them.
FAULTS = [
    ("zri:file::docs:index.md:", None),
    ("zri:git:master:docs:index.md:top", None),
    ("zri:file::docs:a%3Ab.md:", None),
    ("z%72i:file::docs:x:", None),
    ("zri:file::docs:a%5Cb:", None),
    ("zri:file::docs:a\\b:", "backslash"),
    ("a\\b", "backslash"),
    ("zri:file:docs:x", "cardinality"),
    ("zri:file::docs:a:b:c", "cardinality"),
    ("", "cardinality"),
    ("abc:file::docs:x:", "prefix"),
    ("abc::::x:", "prefix"),
    ("zri:::docs:x:", "scheme"),
    ("zri::::x:", "scheme"),
    ("zri:file:::x:", "context"),
    ("zri:file::docs::", "path"),
]


def _literal(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({_literal(s)}, {_literal(e)})" for s, e in FAULTS) + ", (repeat('x', 65536), 'length')) t(id, error)")
def id_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([(s,) for s, _ in FAULTS], "id string").union(spark.range(1).select(F.repeat(F.lit("x"), F.lit(65_536))))
    return given.select("id", ids.id_error(F.col("id")).alias("error"))


@query("SELECT count(DISTINCT 'zri:file::' || source || ':' || lang || ':') AS n FROM documents")
def id_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, f"{sf_dir}/documents.parquet")
    return d.select(ids.id_new(F.lit("file"), F.col("source"), F.col("lang")).alias("id")).distinct().agg(F.count("id").alias("n"))


@query("SELECT page_id, row_number() OVER (ORDER BY id, page_id) AS place FROM (WITH " + URLS + " SELECT page_id, id FROM p)")
def id_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the place makes the order visible; a plain orderBy("id") needs no window and sorts by ranges
    return _pages(spark, sf_dir).select("page_id", F.row_number().over(Window.orderBy("id", "page_id")).cast("long").alias("place"))


@query(
    "SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON 'zri:file::' || d.source || ':' || d.lang || '/' || d.doc_id || '.md:' "
    "= 'zri:file::' || d.source || ':' || d.lang || '/' || l.doc_id || '.md:' AND d.doc_id = l.doc_id"
)
def id_equi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("id", "doc_id")
    named = _documents(spark, sf_dir).select("doc_id", "id").join(tables.read(spark, f"{sf_dir}/labels.parquet").select("doc_id", "quality"), "doc_id").select("id", "quality")
    return docs.join(named, "id").select("doc_id", "quality")


@query(f"WITH {URLS} SELECT page_id, p.id AS id FROM p")
def id_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.replace(F.col("id"), F.lit("e"), F.lit("%65"))
    return _pages(spark, sf_dir).select("page_id", ids.id_canonicalize(spelled).alias("id"))


@query("SELECT doc_id, source AS set_as, 'a%20' || source AS kept, 'a ' || source AS parsed FROM documents")
def exact_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, f"{sf_dir}/documents.parquet")
    value = F.concat(F.lit("a%20"), F.col("source"))
    made = exact.try_exact_set(exact.exact_new(3), 1, value)
    plain = exact.try_exact_set(exact.exact_new(3), 1, F.col("source"))
    return d.select("doc_id", exact.exact_get(plain, 1).alias("set_as"), exact.exact_get(made, 1).alias("kept"), exact.exact_get(exact.exact_parse(made["value"]), 1).alias("parsed"))


# paths


@query("SELECT doc_id, source || '/' || lang || '/' || doc_id || '.md' AS path FROM documents")
def id_to_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = F.concat(F.lit("./"), F.col("source"))
    path = F.concat(F.lit("./"), "lang", F.lit("//."), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md/."))
    d = tables.read(spark, f"{sf_dir}/documents.parquet")
    return d.select("doc_id", paths.id_to_path(ids.id_new(F.lit("file"), context, path)).alias("path"))


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'parent_dir' ELSE 'root_dir' END AS error,
  CASE WHEN doc_id % 5 = 0 THEN source || '/' || lang END AS path FROM documents"""
)
def path_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.pmod("doc_id", F.lit(5))
    context = F.when(n == 3, F.concat(F.lit("/"), "source")).when(n == 4, F.lit("..")).otherwise(F.col("source"))
    path = F.when(n == 0, F.col("lang")).when(n == 1, F.lit("%2E%2E/a")).when(n == 3, F.lit("../a")).otherwise(F.concat(F.lit("/"), "lang"))
    d = tables.read(spark, f"{sf_dir}/documents.parquet").withColumn("id", ids.id_new(F.lit("file"), context, path))
    return d.select("doc_id", paths.path_error(F.col("id")).alias("error"), paths.try_id_to_path(F.col("id")).alias("path"))


# selectors


@query("SELECT p_partkey, p_type AS scheme, CAST(NULL AS VARCHAR) AS binding, '**/' || p_brand AS path FROM part")
def selector_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, f"{sf_dir}/part.parquet")
    made = F.concat(F.lit("zrs:"), codec.percent_encode(F.col("p_type")), F.lit(":::%2A*/"), F.col("p_brand"), F.lit(":"))
    return d.select("p_partkey", ids.try_selector_parse(made).alias("s")).select("p_partkey", "s.scheme", "s.binding", "s.path")


@query(f"SELECT p_partkey, 'zrs:::' || {_enc('p_name')} || '::' AS selector FROM part")
def selector_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, f"{sf_dir}/part.parquet")
    return d.select("p_partkey", ids.id_set(F.lit(ids.SELECTOR_NEW), "context", F.col("p_name")).alias("selector"))


#: Globs and the same as patterns of RE2, where \C is a byte.
GLOBS = [
    ("**", r".*"), ("*.md", r".*\.md"), ("**/*.md", r"(?:/?|.*/).*\.md"), ("en/**", r"en/.*"), ("a/**/z", r"a(?:/|/.*/)z"), ("?", r"\C"), ("???", r"\C\C\C"),
    ("[a-f]*", r"[a-f].*"), ("[!a-f]*", r"[^a-f].*"), ("{en,fr}/*", r"(?:en|fr)/.*"), ("{a,{b,c}}", r"(?:a|(?:b|c))"), ("x{,y}", r"x(?:y)"), ("a.b", r"a\.b"), ("a**", r"a.*"), ("[]a]", r"[\]a]"),
]
WORDS = ["", "a", "z", "é", "/", "a/z", "a/b/z", "a/b/c/z", "index.md", "docs/index.md", ".md", "en/", "en/x", "fr/y/z", "b", "c", "xy", "x", "a.b", "aab", "a\n", "axz", "]", "￾"]


@query(
    "SELECT g.pattern AS pattern, w.word AS word, regexp_full_match(w.word, '(?s)' || g.re) AS matched FROM (VALUES "
    + ", ".join(f"({_literal(g)}, {_literal(r)})" for g, r in GLOBS)
    + ") g(pattern, re), (VALUES "
    + ", ".join(f"({_literal(w)})" for w in WORDS)
    + ") w(word)"
)
def glob_match_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    tests = [F.struct(F.lit(g).alias("pattern"), compile_glob(g).predicate(F.col("word")).alias("matched")) for g, _ in GLOBS]
    return words.select("word", F.explode(F.array(*tests)).alias("t")).select("t.pattern", "word", "t.matched")


# matching

#: Selectors, and for each component a pattern of RE2 (none: any).
SELECTORS = [
    ("zrs:https::::", {"scheme": "https"}),
    ("zrs:http::*.example.com::", {"scheme": "http", "context": r".*\.example\.com"}),
    ("zrs::::en/*:", {"path": "en/.*"}),
    ("zrs::::{fr,de}/**:top", {"path": "(?:fr|de)/.*", "fragment": "top"}),
    ("zrs:::blog.*::", {"context": r"blog\..*"}),
    ("zrs::master:::", {"binding": "master"}),
    ("zrs::::**/*[0-5]?page=?*:", {"path": r"(?:/?|.*/).*[0-5]\Cpage=\C.*"}),
    ("zrs::::**/8??:", {"path": r"(?:/?|.*/)8\C\C"}),
]
OF_PAGES = Matcher.of(*(s for s, _ in SELECTORS))


def _whole(selector: dict[str, str]) -> str:
    """SQL: the selector takes the identifier as a whole; absent components are taken."""
    tests = ["true"]
    for name, pattern in selector.items():
        if name == "binding":
            continue
        test = f"regexp_full_match({name}, '(?s){pattern}')"
        tests.append(f"({name} = '' OR {test})" if name == "fragment" else test)
    return " AND ".join(tests)


def _crossed(selectors: list[dict[str, str]]) -> str:
    """SQL: each component is taken by some selector."""
    tests = []
    for name in ids.COMPONENTS:
        value = {"binding": "chr(65534)", "fragment": "CASE WHEN fragment = '' THEN chr(65534) ELSE fragment END"}.get(name, name)
        if all(name in s for s in selectors):
            tests.append("(" + " OR ".join(f"regexp_full_match({value}, '(?s){s[name]}')" for s in selectors) + ")")
    return " AND ".join(tests) or "true"


NUMBERS = "list_filter([" + ", ".join(f"CASE WHEN {_whole(s)} THEN {i} END" for i, (_, s) in enumerate(SELECTORS)) + "], lambda x: x IS NOT NULL)"
BY_PATH = ("zrs::::en/*:", "zrs:https:::fr/**:")
CROSS = ("zrs:https::*.example.com::", "zrs:http::*.example.org::")


@query(f"WITH {URLS} SELECT page_id FROM p WHERE {_crossed([{'path': 'en/.*'}, {'path': 'fr/.*', 'scheme': 'https'}])}")
def match_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).where(Matcher.of(*BY_PATH).is_match(F.col("id"))).select("page_id")


@query(
    f"WITH {URLS} SELECT page_id, {_crossed([{'scheme': 'https', 'context': r'.*[.]example[.]com'}, {'scheme': 'http', 'context': r'.*[.]example[.]org'}])} AS crossed, "
    "(scheme = 'https' AND context LIKE '%.example.com') OR (scheme = 'http' AND context LIKE '%.example.org') AS whole FROM p"
)
def match_filter_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Matcher.of(*CROSS)
    return _pages(spark, sf_dir).select("page_id", m.is_match(F.col("id")).alias("crossed"), (F.size(m.matches(F.col("id"))) > 0).alias("whole"))


@query(f"WITH {URLS} SELECT page_id, false AS by_set, true AS by_selector, true AS by_star, fragment = 'top' AS set_fragment, fragment IN ('', 'top') AS selector_fragment FROM p")
def match_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, named = F.col("id"), Matcher.of("zrs::master:::")
    top = Matcher.of("zrs:::::top")
    return _pages(spark, sf_dir).select(
        "page_id",
        named.is_match(i).alias("by_set"),
        (F.size(named.matches(i)) == 1).alias("by_selector"),
        Matcher.of("zrs::*:::").is_match(i).alias("by_star"),
        top.is_match(i).alias("set_fragment"),
        (F.size(top.matches(i)) == 1).alias("selector_fragment"),
    )


@query(f"WITH {URLS} SELECT page_id, array_to_string({NUMBERS}, ',') AS matches FROM p")
def match_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", _listed(OF_PAGES.matches(F.col("id"))).alias("matches"))


def _selectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SELECTORS)], "idx int, selector string")


@query(f"WITH {URLS} SELECT page_id, array_to_string({NUMBERS}, ',') AS matches FROM p")
def match_indexes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.matches_table(_pages(spark, sf_dir), _selectors(spark), "page_id")
    return found.select("page_id", _listed(F.col("matches")).alias("matches"))


@query(
    f"WITH {URLS}, m AS (SELECT page_id, unnest({NUMBERS}) AS idx FROM p), s(idx, selector) AS (VALUES "
    + ", ".join(f"({i}, {_literal(s)})" for i, (s, _) in enumerate(SELECTORS))
    + ") SELECT page_id, CAST(m.idx AS INTEGER) AS idx, selector FROM m JOIN s ON m.idx = s.idx"
)
def match_explode_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.match_explode(_pages(spark, sf_dir).select("page_id", "id"), OF_PAGES)
    return found.join(_selectors(spark), "idx").select("page_id", "idx", "selector")


@query(f"WITH {URLS} SELECT page_id FROM p WHERE {_whole(SELECTORS[3][1])} OR {_whole(SELECTORS[6][1])}")
def match_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_semi(_pages(spark, sf_dir), Matcher.of(SELECTORS[3][0], SELECTORS[6][0])).select("page_id")


@query(f"WITH {URLS} SELECT page_id FROM p WHERE NOT ({_whole(SELECTORS[3][1])} OR {_whole(SELECTORS[6][1])})")
def match_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_anti(_pages(spark, sf_dir), Matcher.of(SELECTORS[3][0], SELECTORS[6][0])).select("page_id")


@query(f"WITH {URLS}, m AS (SELECT unnest({NUMBERS}) AS idx FROM p) SELECT CAST(idx AS INTEGER) AS idx, count(*) AS n FROM m GROUP BY idx")
def match_count_by_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.match_explode(_pages(spark, sf_dir).select("id"), OF_PAGES)
    return found.groupBy("idx").agg(F.count(F.lit(1)).alias("n"))


# identifiers in Spark's own operators


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY CUBE (source, lang)")
def id_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    d = _documents(spark, sf_dir).select(ids.component(i, "context").alias("source"), F.substring_index(ids.component(i, "path"), "/", 1).alias("lang"))
    return d.cube("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {URLS} SELECT count(*) AS n FROM p WHERE scheme = 'https'")
def id_scheme_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).where(ids.scheme_prefix(F.col("id"), "https")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('hour', ts) AS window_start, 0 AS idx, count(*) AS n FROM events WHERE event_type LIKE 'c%' GROUP BY ALL")
def match_count_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hexaloc.streaming.matching import counted

    events = tables.read(spark, f"{sf_dir}/events.parquet")
    events = events.withColumn("id", ids.id_new(F.lit("event"), F.col("event_type"), F.col("event_id").cast("string")))
    return counted(events, Matcher.of("zrs:event::c*::"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose path is English, by scheme."""
    d = _pages(spark, sf_dir)
    d = d.where(Matcher.of("zrs::::en/**:").is_match(F.col("id")))
    return d.groupBy(ids.component(F.col("id"), "scheme").alias("scheme")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {URLS} SELECT scheme, count(*) AS n FROM p WHERE path LIKE 'en/%' GROUP BY scheme")
def match_count_by_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)
