"""Main text of web pages, by a recurrent block labeller.

A page is cut into leaf blocks: text between the boundaries of block-level elements. Each
block becomes a vector: its tag path (names, classes and ids of the elements around it,
hashed), its words (hashed), and a few sizes. A bidirectional LSTM in numpy reads a page's
whole sequence of blocks, so each block is judged in the context of the whole page. It is
trained on invented pages, from a fixed seed, on the driver; its weights (some 0.2 MB) are broadcast.

Defined results: a null page is an empty one, whose text is empty; script, style and similar
elements have no blocks, nor have comments; unclosed and stray tags are borne with (an unclosed
script, style, textarea, iframe or comment runs to the page's end, as in HTML); character
references are decoded, runs of white space become a space; blocks without text are left out;
repeated rows stay; other columns are carried only if named.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hexaloc.llm._pages import MAIN, Pages
from hexaloc.llm._shingles import word_hashes

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul label button".split()
)
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: Elements that end when one of the same kind begins beside them.
BESIDE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: What such an element lies in; nothing beyond is ended.
HOLDERS = frozenset("ul ol menu dl table tbody thead tfoot select div section article aside main body".split())
TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(script|style|textarea|iframe)(?=[\s/>])(?:.*?</\1(?=[\s/>])[^>]*(?:>|\Z)|.*\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']++|"[^"<]*"|'[^'<]*'|["'])*+)(?:>|(?=<)|\Z)|<[!?][^>]*(?:>|\Z)""",
    re.S | re.I,
)
#: Elements without blocks that hold markup: left out with all they hold, if they are closed.
UNSHOWN = frozenset("noscript template svg select object".split())
UNSHOWN_TAG = re.compile(rf"<(?:{'|'.join(sorted(UNSHOWN))})(?=[\s/>])", re.I)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
PATH, LEAF, WORDS, SIZES = 256, 32, 32, 6
HIDDEN = 16


def _hash(name: str, width: int) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % width


@lru_cache(20_000)
def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """An element's features: its tag, the words of its names, and the names' words together."""
    out = [f"<{tag}"]
    for value in NAMED.findall(attributes):
        for name in value.strip("\"'").lower().split():
            out.append("." + name)
            out += ["." + w for w in re.split(r"[^a-z0-9]+", name) if w and w != name]
    return tuple(out)


def _unshown(page: str) -> dict[int, int]:
    """Where each closed element of such a kind starts and ends; an svg that closes itself holds nothing."""
    out: dict[int, int] = {}
    if UNSHOWN_TAG.search(page):
        begun: dict[str, list[int]] = {t: [] for t in UNSHOWN}
        for m in TAG.finditer(page):
            tag = (m[3] or "").lower()
            if tag not in UNSHOWN:
                continue
            if not m[2]:
                if tag != "svg" or not m[0].endswith("/>"):
                    begun[tag].append(m.start())
            elif begun[tag]:
                out[begun[tag].pop()] = m.end()
    return out


def blocks(page: str) -> list[tuple[str, tuple[tuple[str, ...], ...], int]]:
    """(text, tag path, characters in links) of a page's blocks, in order."""
    out: list = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked, in_link, at = 0, 0, 0
    unshown = _unshown(page)

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append((whole, tuple(n for _, n in stack), min(linked, len(whole))))
            text.clear()
        linked = 0

    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            text.append(page[at : m.start()])
            linked += in_link * (m.start() - at)
        at = unshown.get(m.start(), m.end())
        tag = m[3]
        if tag is None or at > m.end():
            continue
        tag = tag.lower()
        if tag not in BLOCK:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                in_link = 0 if m[2] else 1
            continue
        flush()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    in_link = 0
                    break
            continue
        if stack and stack[-1][0] == "p" or stack and tag[0] == "h" == stack[-1][0][0] and stack[-1][0][1:].isdigit() and tag[1:].isdigit():
            stack.pop()
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in BESIDE.get(tag, ()):
                del stack[i:]
                break
            if stack[i][0] in HOLDERS:
                break
        if tag == "body" and stack and stack[-1][0] == "head":
            stack.pop()
        if tag not in VOID and len(stack) < 200:
            stack.append((tag, _names(tag, m[4])))
    if at < len(page):
        text.append(page[at:])
        linked += in_link * (len(page) - at)
    flush()
    return out


@lru_cache(50_000)
def _path_vector(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    out = np.zeros(PATH + LEAF, np.float32)
    for element in path:
        for name in element:
            out[_hash(name, PATH)] = 1
    if path:
        out[PATH + _hash(path[-1][0], LEAF)] = 1
    return out


def vectors(found: list) -> np.ndarray:
    """The vectors of blocks."""
    n = len(found)
    out = np.zeros((n, PATH + LEAF + WORDS + SIZES), np.float32)
    if not n:
        return out
    out[:, : PATH + LEAF] = [_path_vector(p) for _, p, _ in found]
    hashes, starts = word_hashes(pa.array([t.replace(MAIN, "") for t, _, _ in found], pa.large_string()))
    count = np.diff(starts)
    owner = np.repeat(np.arange(n), count)
    bag = np.bincount(owner * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    out[:, PATH + LEAF : -SIZES] = np.minimum(2, bag / np.sqrt(np.maximum(1, count))[:, None])
    size = np.array([len(t) for t, _, _ in found])
    links = np.array([k for _, _, k in found])
    out[:, -SIZES:] = np.stack([np.log1p(size) / 5, np.log1p(count) / 4, links / np.maximum(1, size), size < 25, count > 30, np.ones(n)], 1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over a page's blocks, and a logistic output."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        size = PATH + LEAF + WORDS + SIZES
        self.w = {}
        for d in ("f", "b"):
            self.w["x" + d] = r.normal(0, 0.1, (size, 4 * HIDDEN)).astype(np.float32)
            self.w["h" + d] = r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.w["c" + d] = np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)
        self.w["o"] = r.normal(0, 0.2, 2 * HIDDEN + size).astype(np.float32)
        self.w["p"] = np.zeros(1, np.float32)

    def run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states of one direction. x: steps x pages x vector; mask: steps x pages."""
        w, u = self.w["x" + d], self.w["h" + d]
        steps, n, size = x.shape
        ahead = (x.reshape(-1, size) @ w + self.w["c" + d]).reshape(steps, n, -1)
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, kept = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = ahead[t] + h @ u
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            kept.append((t, h, c, i, f, o, g, new))
            c = np.where(m, new, c)
            h = np.where(m, o * np.tanh(new), h)
            out[t] = h
        return out, kept

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.run(x, mask, "f")[0], self.run(x, mask, "b")[0], x], 2)
        return _sigmoid(both @ self.w["o"] + self.w["p"][0])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        ran = {d: self.run(x, mask, d) for d in "fb"}
        both = np.concatenate([ran["f"][0], ran["b"][0], x], 2)
        error = (_sigmoid(both @ self.w["o"] + self.w["p"][0]) - y) * mask / mask.sum()
        out = {"o": np.einsum("tn,tnk->k", error, both), "p": error.sum(keepdims=True).reshape(1)}
        for k, d in enumerate("fb"):
            up = error[:, :, None] * self.w["o"][k * HIDDEN : (k + 1) * HIDDEN]
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            u, du = self.w["h" + d], np.zeros_like(self.w["h" + d])
            dh, dc = np.zeros(up.shape[1:], np.float32), np.zeros(up.shape[1:], np.float32)
            for t, h, c, i, f, o, g, new in reversed(ran[d][1]):
                m = mask[t][:, None]
                dh = dh + up[t]
                tan = np.tanh(new)
                own = m * (dh * o * (1 - tan * tan) + dc)
                z = np.concatenate([own * g * i * (1 - i), own * c * f * (1 - f), m * dh * tan * o * (1 - o), own * i * (1 - g * g)], 1)
                dz[t] = z
                du += h.T @ z
                dh = np.where(m, 0, dh) + z @ u.T
                dc = np.where(m, own * f, dc)
            out["x" + d] = x.reshape(-1, x.shape[2]).T @ dz.reshape(-1, 4 * HIDDEN)
            out["h" + d], out["c" + d] = du, dz.sum((0, 1))
        return out

    def label(self, pages: list[list], cells: int = 60_000) -> list[np.ndarray]:
        """Whether each block of each page is main. Pages of like lengths go together."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            upto = at + 1
            while upto < len(order) and (upto + 1 - at) * len(pages[order[upto]]) <= cells // 10:
                upto += 1
            group = order[at:upto]
            x, mask = padded([vectors(pages[i]) for i in group])
            found = self.scores(x, mask) > 0.5
            for k, i in enumerate(group):
                out[i] = found[: len(pages[i]), k]
            at = upto
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = True
    return x, mask


@lru_cache(2)
def trained(pages: int = 1200, epochs: int = 5, seed: int = 11) -> Labeller:
    """The labeller, trained from a fixed seed on so many invented pages."""
    made = Pages(seed)
    cut = [f for f in (blocks(made.page()) for _ in range(pages)) if f]
    xs, ys = [vectors(f) for f in cut], [np.array([MAIN in t for t, _, _ in f], np.float32) for f in cut]
    model, r = Labeller(), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = np.argsort([len(x) + r.random() * 6 for x in xs])
        groups = [order[i : i + 24] for i in range(0, len(order), 24)]
        for g in (groups[i] for i in r.permutation(len(groups))):
            x, mask = padded([xs[i] for i in g])
            y = np.zeros(mask.shape, np.float32)
            for k, i in enumerate(g):
                y[: len(ys[i]), k] = ys[i]
            step += 1
            rate = 0.02 * (1 - epoch / epochs)
            for k, d in model.gradients(x, mask, y).items():
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                model.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def extracted(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), page: str = "html", model: Labeller | None = None) -> DataFrame:
    """The key columns and text: the main blocks of every whole page, one a line."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    pages = pages.select(*keys, page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                cut = [blocks(t or "") for t in part.column(len(keys)).to_pylist()]
                kept = ["\n".join(x[0] for x, k in zip(f, keep) if k) for f, keep in zip(cut, shared.value.label(cut))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(kept, pa.string())], [*keys, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields[:-1])
    return pages.mapInArrow(run, f"{kinds}, text string")
