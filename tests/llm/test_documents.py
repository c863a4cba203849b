"""Language, pages, mixing, personal data, media, near copies and pieces: brute force and edge cases."""

import bisect
import math
import random
import re
import time
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hexaloc.llm import _progressive, extraction, language, media, mixing, pieces, pii, queries, similarity
from hexaloc.llm._pages import MAIN, Pages
from hexaloc.llm._partenum import PartEnum
from hexaloc.llm._shingles import sets_of, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string"


# language


def plain_phrases(text, sample, run=2048):
    """Longest-match phrases by search; a symbol that the sample lacks heads the next phrase."""
    n = 0
    for a in range(0, len(text), run):
        part, n, now = text[a : a + run], n + 1, ""
        for c in part:
            if now + c in sample:
                now += c
            else:
                n, now = n + 1, c if c in sample else ""
    return n


def test_phrases():
    r = random.Random(2)
    rows = [("a", "".join(r.choice("abcd ") for _ in range(300))), ("b", "".join(r.choice("cdef ") for _ in range(300)))]
    model = language.learned(rows)
    for _ in range(20):
        text = "".join(r.choice("abcdefgh 1") for _ in range(r.randint(1, 400)))
        own = language.symbols(text, model.alphabet)
        got = model.phrases([own], run=100)[0]
        for k, (_, t) in enumerate(rows):
            sample = "".join(map(chr, [*language.symbols(t, model.alphabet)[:400].tolist(), language.SPACE]))
            assert got[k] == plain_phrases("".join(map(chr, own.tolist())), sample, 100)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    model = language.learned([("en", "the cat"), ("fr", "le chat")])
    names, scores = model.predict([None, "", "12 !", "the", "é", "x" * 50_000])
    assert names[:3] == ["und"] * 3 and scores[:3] == [0.0] * 3 and names[3] == "en" and all(0 <= s <= 1 for s in scores)
    assert language.learned([]).predict(["x"]) == (["und"], [0.0])
    assert language.identified(docs.limit(0), model).count() == 0


# pages


def test_labeller():
    model, made = extraction.trained(), Pages(5)
    cut = [extraction.blocks(made.page()) for _ in range(150)]
    wrong = sum((MAIN in b[0]) != k for f, keep in zip(cut, model.label(cut)) for b, k in zip(f, keep))
    assert wrong <= 0.01 * sum(map(len, cut))


def test_gradients():
    model, r = extraction.Labeller(1), np.random.default_rng(0)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, mask, y = r.normal(size=(4, 2, model.w["xf"].shape[0])), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool), r.integers(0, 2, (4, 2)).astype(float)

    def loss():
        p = model.scores(x, mask)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    for k, g in model.gradients(x, mask, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        model.w[k][at] += 1e-3
        up = loss()
        model.w[k][at] -= 2e-3
        down = loss()
        model.w[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[at]) < 2e-2 * abs(g[at]) + 1e-4, k


@pytest.mark.parametrize(
    "page,expected",
    [
        ("", []),
        ("plain  text", ["plain text"]),
        ("<p>a<b>b</b>c<br>d<!-- x -->e</p>", ["abc de"]),
        ("<p>a<p>b<div>c", ["a", "b", "c"]),
        ("<script>var t='</p>';</script><p>x</p><style>p{}</style>", ["x"]),
        ("<p>&amp;&#233;&nbsp;y &am", ["&é y &am"]),
        ("a < b <p", ["a < b"]),
        ("<script>never closed <p>x", []),
        ("<!-- never closed <p>x", []),
        ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]),
    ],
)
def test_blocks(page, expected):
    assert [b[0] for b in extraction.blocks(page)] == expected


@pytest.mark.parametrize(
    "page,expected",
    [
        ('<svg class="i"/><p>x</p><svg><text>t</text></svg><p>y', ["x", "y"]),
        ("<svg>a<svg/>b<svg>c</svg>d</svg><p>x", ["x"]),
        ("<svg><p>x</p><svg>t</svg><p>y", ["x", "y"]),
        ("<noscript><p>x", ["x"]),
        ("<object data=a><p>x</p><p>y", ["x", "y"]),
        ("<svg-icon></svg-icon><p>x</p><template-x>y</template-x><select-box>z", ["x", "yz"]),
        ("<script-x>a</script-x><p>x", ["a", "x"]),
        ("<select><option>a</select><object>b</object><template><p>c</template><noscript>d</NOSCRIPT ><p>x", ["x"]),
        ("<svg><!-- </svg> -->t</svg><p>x<script>'<svg>'</script ><p>y", ["x", "y"]),
        ("<svg></object></svg ><p>x<textarea><p>y", ["x"]),
    ],
)
def test_blocks_after_unshown_elements(page, expected):
    assert [b[0] for b in extraction.blocks(page)] == expected


def test_extraction(spark):
    whole = "<body><nav><ul><li><a href=1>Home</a></li></ul></nav><article><h1>Title of it</h1><p>Some&amp; words\n here.<p>More of them</article><footer>&copy; x</footer></body>"
    rows = [(1, "u", whole, "k"), (2, "u", None, "k"), (3, "u", "", "k"), (4, "u", whole, "k")]
    got = {r["page_id"]: r["text"] for r in extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got == {1: "Title of it\nSome& words here.\nMore of them", 2: "", 3: "", 4: got[1]}


# mixing


def plain_deal(budget, children):
    """children: name -> (have, weight). Water is poured until all is dealt or all are full."""
    out, open_ = dict.fromkeys(children, 0.0), set(children)
    while open_ and budget > 1e-9:
        total = sum(children[c][1] for c in open_)
        level = min([budget / total] + [(children[c][0] - out[c]) / children[c][1] for c in open_])
        for c in list(open_):
            out[c] += level * children[c][1]
            budget -= level * children[c][1]
            if children[c][0] - out[c] < 1e-9:
                open_.remove(c)
    return out


def test_mixing(spark):
    r = random.Random(4)
    rows = [(i, "w " * r.randint(0, 60), r.choice(["en", "en", "en", "fr", None]), f"src{min(r.randint(0, 7), r.randint(0, 7))}", 1, "k") for i in range(1500)]
    docs = spark.createDataFrame(rows, DOCS)
    mix = mixing.Mix(weights={("web",): 5.0, ("books",): 1.0, ("web", "fr"): 9.0}, range_rows=30)
    domain = queries.domain_of_source()
    got = mixing.plan(docs, domain, mix).collect()
    leaf = defaultdict(int)
    for x in got:
        leaf[x["domain"], x["lang"], x["source"]] += x["tokens"]
    nodes = defaultdict(int)
    for path, n in leaf.items():
        for k in range(4):
            nodes[path[:k]] += n
    weight = lambda p: mix.weights.get(p, nodes[p] ** 0.5)
    given = {(): float(nodes[()])}
    for depth in range(3):
        for p in [p for p in nodes if len(p) == depth]:
            given |= plain_deal(given[p], {q: (2.0 * nodes[q], weight(q)) for q in nodes if len(q) == depth + 1 and q[:-1] == p})
    for x in got:
        assert abs(x["budget"] - given[x["domain"], x["lang"], x["source"]]) < 1e-3
    taken = defaultdict(int)
    for x in got:
        taken[x["domain"], x["lang"], x["source"]] += x["tokens"] * x["copies"]
    for p, n in taken.items():
        assert given[p] + 1e-3 >= n > given[p] - 61, p
    # the last epoch takes a prefix of its seeded order
    some = spark.createDataFrame([(x["key"],) for x in got], "key long")
    places = {e: {q["key"]: q["h"] for q in some.select("key", mixing.place(F.col("key"), F.lit(e).cast("long"), mix.seed).alias("h")).collect()} for e in (0, 1)}
    for p in leaf:
        own = [x for x in got if (x["domain"], x["lang"], x["source"]) == p]
        whole = min(x["copies"] for x in own)
        if whole in places and any(x["copies"] > whole for x in own):
            h = places[whole]
            assert max(h[x["key"]] for x in own if x["copies"] > whole) < min(h[x["key"]] for x in own if x["copies"] == whole)
    out = mixing.mixed(docs, domain, mix)
    assert out.columns == docs.columns and out.count() == sum(x["copies"] for x in got)
    assert mixing.mixed(docs.limit(0), domain, mix).count() == 0
    assert {x["copies"] for x in mixing.plan(docs.withColumn("text", F.lit(None).cast("string")), domain, mix).collect()} == {0}


# personal data


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    f = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    f += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    f += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and pii._luhn(digits(m[0]))]
    f += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(f)


def test_base_spans():
    r = random.Random(1)
    bits = ["a", "@", ".", "1", "2", "9", "0", " ", "-", "+", "(", "b.c", "@x.", "1.2.3", "é", "4111111111111111", "%", "\n"]
    for _ in range(20_000):
        t = "".join(r.choice(bits) for _ in range(r.randint(1, 25)))
        assert plain_spans(t) == pii.base_spans(t), t
    assert pii.base_spans("a" * 500_000 + "@") == [] and pii.base_spans("1" * 200_000) == []


def test_bootstrap(spark):
    names = [f"user{i}@mail.example.com" for i in range(40)]
    rows = [(i, f"Please write to contact mailbox {n} today", None, None, 1, "k") for i, n in enumerate(names)]
    rows += [(100, "Please write to contact mailbox J-4471-XQ9 today", None, None, 1, "k"), (101, "the room 12345678 is shut", None, None, 1, "k"), (102, None, None, None, None, "k"), (102, "", None, None, 0, "k")]
    docs = spark.createDataFrame(rows, DOCS)
    got = pii.spans(docs).collect()
    by = {r["key"]: r for r in got if r["key"] != 102}
    assert len(got) == len(rows) and by[100]["spans"] == "id:32:42" and by[101]["spans"] == "" and by[0]["spans"] == "email:32:54" and by[0]["n_email"] == 1
    assert by[100]["base_sha256"] == sha256(b"").hexdigest() and by[0]["base_sha256"] == sha256(b"email:32:54").hexdigest()
    out = {r["doc_id"]: r for r in pii.masked(docs).collect() if r["doc_id"] != 102}
    assert out[100]["text"] == "Please write to contact mailbox [id] today" and out[0]["text"].endswith("mailbox [email] today") and out[101]["text"] == rows[41][1]
    assert out[100]["n_chars"] == len(out[100]["text"]) and out[101]["n_chars"] == 1 and pii.masked(docs).columns == docs.columns and pii.masked(docs).count() == len(rows)
    assert pii.spans(docs.limit(0)).count() == 0


def test_bootstrap_takes_any_token(spark):
    rows = [(i, f"Please write to contact mailbox user{i}@mail.example.com today") for i in range(40)]
    odd = ["jane.doe", "4711", "Zoë", "k"]
    rows += [(100 + i, f"Please write to contact mailbox {x} today") for i, x in enumerate(odd)] + [(200, "the mailbox is shut today")]
    got = {r["key"]: r["spans"] for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i] == f"id:32:{32 + len(x)}" for i, x in enumerate(odd)) and got[200] == ""


def test_bootstrap_goes_on_from_what_it_found(spark):
    codes = ["".join(chr(97 + (i * k) % 26) for k in (1, 3, 7, 11)) + "q" for i in range(12)]
    rows = [(i, f"Please write to contact mailbox user{i}@mail.example.com today") for i in range(40)]
    rows += [(100 + i, f"Please write to contact mailbox {c} today") for i, c in enumerate(codes)]
    # no seed is ever in this context, only what the first one found
    rows += [(200 + i, f"his member id {c} was checked") for i, c in enumerate([*codes, "newcomer"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["key"]: r["spans"] for r in pii.spans(docs).collect()}
    assert got[212] == "id:14:22" and got[200] == f"id:14:{14 + len(codes[0])}"
    assert {r["key"]: r["spans"] for r in pii.spans(docs, pii.Bootstrap(rounds=1)).collect()}[212] == ""


def test_masking_of_null_and_repeated_keys(spark):
    rows = [(i, f"Please write to contact mailbox user{i}@mail.example.com today", 1) for i in range(40)]
    rows += [(None, "Please write to contact mailbox J-4471-XQ9 today", 1), (7, "Oh. Please write to contact mailbox J-4471-XQ9 today", 1), (7, "contact mailbox K-11-AB77 today", 1)]
    got = [r["text"] for r in pii.masked(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect() if "[id]" in r["text"]]
    assert sorted(got) == ["Oh. Please write to contact mailbox [id] today", "Please write to contact mailbox [id] today", "contact mailbox [id] today"]


def plain_contexts(t):
    """(start, end, pattern) of the tokens that touch no base span, word by word."""
    base, words = plain_spans(t), [(m.start(), m.end()) for m in re.finditer(r"\w+|[^\w\s]", t)]
    form = lambda s, e: re.sub("[0-9]", "0", t[s:e].lower())
    starts, ends = [s for s, _ in words], [e for _, e in words]
    for m in re.finditer(r"[\w@.%+/:-]+", t):
        s, e = m.end() - len(m[0].lstrip(".:/-@%+_")), m.start() + len(m[0].rstrip(".:/-@%+_"))
        if s < e and all(b <= s or a >= e for a, _, b in base):
            i, j = bisect.bisect_right(ends, s), bisect.bisect_left(starts, e)
            yield s, e, " ".join(form(*w) for w in words[max(0, i - 2) : i]) + " _ " + "".join(form(*w) for w in words[j : j + 1])


def read(texts, patterns, instances):
    column = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    return [tokens for part in pii.Sought.of(patterns, instances).read(column, 0) for tokens in part[2]]


def test_tokens_in_contexts_by_hash():
    r = random.Random(4)
    bits = ["a", "B", "Σ", "ς", "σ", "İ", "i", "\u0307", "_", "__", ".", ":", "-", "@", "@x.y", " ", "  ", "\n", "9", "12", "é", "É", "ẞ", "漢", "😀", "K", "\x1c", "a@b.co", "1.2.3.4", "%", "user"]
    texts = [None, ""] + ["".join(r.choice(bits) for _ in range(r.randint(0, 20))) for _ in range(20_000)]
    plain = [list(plain_contexts(t or "")) for t in texts]
    patterns = {p for x in plain for _, _, p in x if r.random() < 0.1}
    instances = {t[s:e] for t, x in zip(texts, plain) for s, e, _ in x if r.random() < 0.02}
    for own, known in ((patterns, instances), (patterns, ()), ((), instances), ((), ())):
        assert read(texts, own, known) == [[x for x in found if x[2] in own or (t or "")[x[0] : x[1]] in known] for t, found in zip(texts, plain)]


def test_search_for_contexts_is_cheap():
    r = random.Random(5)
    names = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 8))) for _ in range(3_000)]
    texts = [" ".join(r.choice(names) for _ in range(500)) + "." for _ in range(200)]
    patterns = {p for t in texts[:5] for _, _, p in plain_contexts(t)}

    def seconds(run):
        run()
        at = time.process_time()
        run()
        return time.process_time() - at

    assert 2 * seconds(lambda: read(texts, patterns, ())) < seconds(lambda: [list(plain_contexts(t)) for t in texts])


def test_pii_query(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op6_pii(spark, sf).collect():
        base = plain_spans(docs[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r["base_sha256"] == sha256(pii.written(base).encode()).hexdigest()
        assert set(filter(None, pii.written(base).split(","))) <= set(r["spans"].split(","))


# media


def test_progressive():
    r = np.random.default_rng(1)
    images = []
    for mw, mh, kind in [(1, 1, 0), (3, 2, 1), (7, 5, 0), (4, 4, 2), (1, 2, 3)]:
        n = mw * mh * 6
        dense, sparse = r.integers(-96, 160, (n, 64)), np.where(r.random((n, 64)) < 0.03, r.integers(-255, 256, (n, 64)), 0)
        images.append((mw, mh, (dense, r.integers(-2, 3, (n, 64)), sparse, np.zeros((n, 64), int))[kind], b"x" * mw))
    files = _progressive.encode(images)
    for image, back, own in zip(images, _progressive.decode(files), files):
        assert back[:2] == image[:2] and back[3] == image[3] and (back[2] == image[2]).all()
        assert _progressive.encode([image]) == [own] and own[:2] == b"\xff\xd8" and own[-2:] == b"\xff\xd9"


def test_progressive_coefficients_of_all_sizes():
    r = np.random.default_rng(3)
    x = np.where(r.random((5 * 3 * 6, 64)) < 0.3, r.integers(-2047, 2048, (5 * 3 * 6, 64)) >> r.integers(0, 11, (5 * 3 * 6, 64)), 0)
    x[:, 0] = r.integers(-500, 500, len(x))
    assert (_progressive.decode(_progressive.encode([(5, 3, x, b"")]))[0][2] == x).all()
    with pytest.raises(ValueError):
        _progressive.encode([(5, 3, np.where(x == x.max(), 2048, x), b"")])


def test_first_scans_with_ends_of_many_blocks():
    """Symbols that this coder doesn't write: ends of several blocks."""
    r, parts, want = random.Random(6), [], np.zeros((3 * 40, 64), int)
    for lane in range(3):
        bits, block, put = "", 0, lambda s: f"{_progressive.AC_CODES[s]:0{_progressive.AC_SIZES[s]}b}"
        while block < 40:
            k = 1
            while r.random() < 0.8 and k < 20:
                run, size = r.randint(0, 3), r.randint(1, 10)
                value = r.randrange(1 << size - 1, 1 << size)
                bits += put(run << 4 | size) + f"{value:0{size}b}"
                want[lane * 40 + block, k + run] = value << 1
                k += run + 1
            n = r.randint(1, min(9, 40 - block))
            e = n.bit_length() - 1
            bits += put(e << 4) + (f"{n - (1 << e):0{e}b}" if e else "")
            block += n
        bits += "1" * (-len(bits) % 8)
        parts.append(int(bits, 2).to_bytes(len(bits) // 8, "big"))
    got = np.zeros(3 * 40 * 64, np.int32)
    _progressive._read_first(_progressive._Lanes(parts), got, np.arange(120), np.array([0, 40, 80]), np.array([40, 80, 120]), 1, 63, 1, _progressive.AC_TABLE)
    assert (got.reshape(-1, 64) == want).all()


def test_media_cost():
    """Seconds to write and read a text's image, against those of zlib on the same bytes."""
    r = random.Random(7)
    names = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))) for _ in range(3_000)]
    text = " ".join(r.choice(names) for _ in range(160_000)).encode()[:800_000]

    def seconds(run):
        each = []
        for _ in range(4):
            at = time.process_time()
            run()
            each.append(time.process_time() - at)
        return min(each)

    assert seconds(lambda: _progressive.decode(_progressive.encode([media.image_of(text)]))) < 7 * seconds(lambda: zlib.compress(text, 9))


def test_inverse_transform():
    r = np.random.default_rng(2)
    c = r.integers(-60, 60, (20, 64))
    block = np.zeros((20, 64))
    block[:, _progressive.ZIGZAG] = c
    u = np.arange(8)
    one = np.cos((2 * u[None, :] + 1) * u[:, None] * math.pi / 16) * np.where(u == 0, math.sqrt(0.5), 1)[:, None] / 2
    exact = np.einsum("nvu,vy,ux->nyx", block.reshape(20, 8, 8), one, one).reshape(20, 64) + 128
    assert np.abs(np.clip(exact, 0, 255) - _progressive.samples(c)).max() <= 1


def test_media(spark):
    texts = ["", None, "a", "é" * 100, "x" * 64, "x" * 65, "\x00\x00", "]]]^^^\\\\" * 40, "word " * 5000, "word " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["key"]: r for r in media.read_back(media.stored(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(r["rgb"]) == r["height"] * r["width"] * 3
    assert got[8]["media_sha256"] == got[9]["media_sha256"] and got[8]["feature"] == got[9]["feature"]
    assert media.stored(docs.limit(0)).count() == 0


# near copies


def plain_components(rows, percent=85, width=4):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = sorted((root(a), root(b)))
                up[rb] = ra
    return {(i, len(sets[i]), root(i)) for i in keys}


def near_copies(seed, n=500):
    """Families of copies with more and more changed words, passages that many share, short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    passage, out = [word() for _ in range(50)], []
    while len(out) < n:
        base = [word() for _ in range(r.choice([1, 2, 3, 4, 5, 8, 12, 20, 40, 90, 150, 320]))] + (passage if r.random() < 0.3 else [])
        for _ in range(r.choice([1, 1, 2, 5, 25])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 9])):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w).upper() if r.random() < 0.1 else "\n".join(w))
    return list(enumerate(out[:n])) + [(n, None), (n + 1, " \t"), (n + 2, "\xa0")]


@pytest.mark.parametrize("seed,percent,width", [(1, 85, 4), (2, 80, 5)])
def test_components(spark, seed, percent, width):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in similarity.components(docs, percent=percent, width=width).collect()}
    assert got == plain_components(rows, percent, width)


def test_components_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "q"), (2, "q")], "doc_id long, text string")
    got = sorted((tuple(r) for r in similarity.components(docs).collect()), key=str)
    assert got == sorted([(None, 2, None), (1, 2, 1), (1, 2, 1), (2, 1, 2), (2, 1, 2)], key=str)
    assert similarity.components(docs.limit(0)).count() == 0


def test_components_of_other_keys(spark):
    rows = [(f"k{i}", t, 1) for i, t in near_copies(4, 150)]
    numbered = {k: n for n, (k, _, _) in enumerate(sorted(rows))}
    docs = spark.createDataFrame([*rows, (None, rows[0][1], 1)], "name string, text string, rep int").repartition(3)
    got = {(numbered[k], n, numbered[c]) for k, n, c in similarity.components(docs, key="name").collect() if k}
    assert got == plain_components([(numbered[k], t) for k, t, _ in rows])


def test_components_of_long_texts_and_clashing_columns(spark):
    r = random.Random(6)
    long = [f"{r.randrange(10**9)}" for _ in range(60_000)]
    near, far = list(long), list(long)
    near[::200], far[::5] = ["x"] * 300, ["y"] * 12_000
    rows = [(3, " ".join(long)), (2, " ".join(near)), (1, " ".join(far)), (4, "a b"), (5, "A  B")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("rep", "n", "label", "sig", "at", "component_id", "__id")})
    assert {r["doc_id"]: r["component_id"] for r in similarity.components(docs).collect()} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4}
    assert sorted(r["doc_id"] for r in similarity.one_of_each(docs).collect()) == [1, 2, 4] and similarity.one_of_each(docs).columns == docs.columns


def similar_sets(r, percent, most=400):
    """Two sets with random sizes, and all hashes that they were drawn from."""
    n = int(r.integers(1, most))
    common = int(r.integers(max(1, n * percent // 100), n + 1))
    x = r.integers(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64)
    return np.unique(x[:n]), np.unique(np.concatenate([x[:common], x[n : n + int(r.integers(0, n - common + 1))]])), x


@pytest.mark.parametrize("percent", [95, 85, 80, 60])
@pytest.mark.parametrize("told", [0.0, 0.3, 0.95])
def test_partenum_loses_no_pair(percent, told):
    r, method = np.random.default_rng(3), PartEnum(percent)
    for _ in range(400):
        a, b, x = similar_sets(r, percent)
        usual = np.sort(x[r.random(len(x)) < told])
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both):
            assert len(np.intersect1d(method.signatures(a, usual), method.signatures(b, usual))) > 0


@pytest.mark.parametrize("percent", range(50, 100, 5))
def test_partenum_has_few_partitions(percent):
    for b in PartEnum(percent).bands_upto(5_000):
        least = b.k // (b.k2 + 1) + 1
        assert least <= b.n1 <= 1.5 * least and b.n1 * math.comb(b.n2, b.k2) <= 4 * b.k + 16 and (b.k2 > 0 or b.k == 0)


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_unlike_sets_seldom_meet(percent):
    r, method, met, n = np.random.default_rng(8), PartEnum(percent), 0, 0
    for size in (20, 40, 64, 80, 100, 130, 200, 400):
        for _ in range(60):
            x = r.integers(0, 2**63, 2 * size, dtype=np.int64).astype(np.uint64)
            a, b = np.unique(x[:size]), np.unique(np.concatenate([x[:2], x[size + 2 :]]))
            met, n = met + (len(np.intersect1d(method.signatures(a), method.signatures(b))) > 0), n + 1
    assert met <= 0.1 * n


def test_parities():
    r = np.random.default_rng(9)
    for _ in range(300):
        a, b, _ = similar_sets(r, 60)
        x, y = sorted((similarity.parities(a), similarity.parities(b)), key=len)
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        apart = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))


def test_shingles():
    texts = pa.array(["A b  c\td e", "a b c d e", None, "", "x", "x y", "y x", "ab c", "a bc"])
    sets = [s.tolist() for s in sets_of(texts)]
    assert sets[0] == sets[1] and [len(s) for s in sets] == [2, 2, 0, 0, 1, 1, 1, 1, 1] and len({tuple(s) for s in sets[4:]}) == 5
    hashes, starts = word_hashes(texts)
    assert starts.tolist() == [0, 5, 10, 10, 10, 11, 13, 15, 17, 19] and len(set(hashes[13:].tolist())) >= 4


# pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(pieces.default_path())


TEXTS = ["", "  Hello  world", " a\nb", "　x", "ﬁ  ", "été", "\t", "à", "a   b    ", "x▁y", "▁▁", " ▁ ", "a" * 300, "日本語 text", "😀" * 3, "x" + " " * 70 + "y", "e.g., (foo)-bar!"]


def test_pieces_without_dropout(vocabulary):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    codec = pieces.Codec(vocabulary, pieces.Dropout(odds=0))
    for t in TEXTS:
        assert codec.decode(codec.encode(t)) == t
        if "▁" not in t:
            assert codec.encode(t) == model.encode(t), t


def each(drawn):
    flat, start = drawn
    return [flat[a:b].tolist() for a, b in zip(start, start[1:])]


def test_pieces_with_dropout(vocabulary):
    codec, other = pieces.Codec(vocabulary, pieces.Dropout(odds=0.3), cache=50), pieces.Codec(vocabulary, pieces.Dropout(odds=0.3))
    seeds = [pieces.Codec(vocabulary, pieces.Dropout(odds=0.3, seed=s)).encode("internationalization of words") for s in range(6)]
    assert len({tuple(s) for s in seeds}) > 1
    texts = [*TEXTS, "internationalization " * 30]
    assert each(codec.encode_many(texts)) == [other.encode(t) for t in texts] and all(codec.decode(codec.encode(t)) == t for t in texts)
    # parts of all lengths at once, with other steps left to go, as one by one
    parts = ["▁internationalization", "▁the", "▁queeauelle", "ab", "▁", "x" * 40, "▁日", "é", "▁antidisestablishmentarianism"] * 200
    keys = pieces.mixed(np.arange(len(parts), dtype=np.uint64))
    drops = [pieces.skips(keys[i : i + 1], np.arange(120), other.limit).tobytes() for i in range(len(parts))]
    assert each(other.drawn(parts, keys)) == [other.merged(p, d)[0] for p, d in zip(parts, drops)]


def test_pieces_of_every_occurrence(vocabulary):
    codec, n = pieces.Codec(vocabulary, pieces.Dropout(odds=0.1)), 4000
    text = " ".join(["the internationalization"] * n)
    ids = codec.encode(text)
    assert codec.decode(ids) == text and ids == codec.encode(text) == pieces.Codec(vocabulary, pieces.Dropout(odds=0.1), cache=50).encode(text)
    shown = defaultdict(int)
    for word in each(codec.drawn(["▁internationalization"] * n, pieces.mixed(np.arange(n, dtype=np.uint64)))):
        shown[tuple(word)] += 1
    plain, turns = codec.merged("▁internationalization", b"")
    # nothing is skipped in 0.9 ** turns of the occurrences; other skips may lead to the same pieces
    assert len(shown) > 20 and 0.9**turns - 0.04 < shown[tuple(plain)] / n < 0.6
    assert len({tuple(x) for x in each(codec.drawn(["▁the"] * n, pieces.mixed(np.arange(n, dtype=np.uint64))))}) > 2
    # a skip drawn by brute force is the skip that is looked up
    keys = pieces.mixed(np.arange(300, dtype=np.uint64))
    for part in ("▁internationalization", "▁queeauelle", "x" * 40):
        drops = [pieces.skips(keys[i : i + 1], np.arange(120), codec.limit).tobytes() for i in range(300)]
        assert each(codec.drawn([part] * 300, keys)) == [codec.merged(part, d)[0] for d in drops]


def test_pieces_query(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op9_sentencepiece(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["n_ids"] == len(r["ids"]) and r["decoded_sha256"] == sha256(docs[r["doc_id"]].encode()).hexdigest()


# pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("__extra", F.lit(1)).withColumn("key", F.lit("k"))
    rows, columns = docs, docs.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = corpus_pipeline.materialize(stage(spark, rows, sf), "test")
        assert n == 4 or rows.columns == columns
        if n == 0:
            good = {r["doc_id"] for r in rows.collect()}
            assert good == {r["doc_id"] for r in queries.op10_quality_rules(spark, sf).where("kept").collect()}
        if n == 1:
            own = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
            assert {r["doc_id"] for r in rows.collect()} == {root for _, _, root in plain_components(own, 80, 5)}
        if n == 2:
            assert all(not pii.base_spans(r["text"]) for r in rows.collect())
    assert {r["doc_id"] for r in rows.collect()} <= good
