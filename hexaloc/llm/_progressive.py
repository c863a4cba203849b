"""Progressive JPEG in numpy, many images at once.

Images are 4:2:0 with sides that are multiples of 16, restart intervals in every scan, and a
quantiser of ones. The coder turns coefficient arrays into scans (spectral selection and
successive approximation); the decoder reads any such file back, stepping through all restart
intervals of all images at once, a symbol at a step, and accumulates the scans.
"""

from __future__ import annotations

import re
import struct
from functools import cached_property, lru_cache

import numpy as np

#: Fixed values of the format: the zigzag order of an 8 x 8 block's places.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
#: (components, first and last coefficient, high and low bit) of each scan.
SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1),
    *(((c,), 1, 5, 0, 1) for c in range(3)),
    *(((c,), 6, 63, 0, 1) for c in range(3)),
    ((0, 1, 2), 0, 0, 1, 0),
    *(((c,), 1, 63, 1, 0) for c in range(3)),
)
#: Restart interval in data units: whole MCUs of the scans of all components, blocks of the others.
MCUS, BLOCKS = 32, 32
#: Code lengths: the usual symbols are short. No code is all ones.
DC_LENGTHS = {s: 4 for s in range(12)}
AC_LENGTHS = {s: 4 for s in range(8)} | {r << 4 | s: 9 for r in range(16) for s in range(11) if r or s > 7}


def canonical(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table segment's counts and values, and each symbol's code and code length."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, sizes, code, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s], sizes[s] = code, last
        code += 1
    counts = bytes(sum(x == n for x in lengths.values()) for n in range(1, 17))
    return counts + bytes(order), codes, sizes


DC_TABLE, DC_CODES, DC_SIZES = canonical(DC_LENGTHS)
AC_TABLE, AC_CODES, AC_SIZES = canonical(AC_LENGTHS)


@lru_cache(16)
def lookup(table: bytes) -> np.ndarray:
    """For each 16 bits: symbol << 8 | length of the code that they start with."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for size in range(1, 17):
        for _ in range(table[size - 1]):
            out[code << 16 - size : code + 1 << 16 - size] = table[at] << 8 | size
            code, at = code + 1, at + 1
        code <<= 1
    return out


def order_of(mw: int, mh: int) -> list[np.ndarray]:
    """Blocks of each component in raster order, as places in MCU order."""
    return _order(mw, mh) if mw * mh > 64 else _small_order(mw, mh)


def _order(mw: int, mh: int) -> list[np.ndarray]:
    at = np.arange(mw * mh * 6).reshape(mh, mw, 6)
    luma = at[:, :, :4].reshape(mh, mw, 2, 2).transpose(0, 2, 1, 3)
    return [luma.ravel(), at[:, :, 4].ravel(), at[:, :, 5].ravel()]


_small_order = lru_cache(256)(_order)


def _magnitude(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of |x|, and the extra bits that tell x among those of its size."""
    size = np.frexp(np.abs(x).astype(np.float32))[1].astype(np.int64)
    return size, np.where(x < 0, x + (1 << size) - 1, x)


@lru_cache(1)
def _coefficient_codes() -> tuple[np.ndarray, np.ndarray]:
    """Code with extra bits, and its length, of a run of zeros below 16 and a coefficient: run << 11 | 1024 + x."""
    x = np.arange(-1024, 1024)
    bits, extra = _magnitude(x)
    symbol = np.arange(16)[:, None] << 4 | np.minimum(bits, 10)
    return (AC_CODES[symbol] << bits | extra).ravel(), (AC_SIZES[symbol] + bits).ravel()


def _packed(code: np.ndarray, size: np.ndarray, each: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """A scan's bytes in each file. Tokens have 1 to 32 bits; each: tokens of an interval, counts:
    intervals of a file. Intervals are padded by ones, stuffed, and kept apart by restart markers."""
    upto = np.cumsum(size)
    till = upto[np.cumsum(each) - 1]
    bits = np.diff(till, prepend=0)
    octets = bits + 7 >> 3
    first = np.cumsum(octets) - octets
    start = upto - size + np.repeat(first * 8 - (till - bits), each)
    # a token lies within 64 bits from a multiple of 32, and no two share a bit, so words are sums
    word = start >> 5
    shifted = code.astype(np.uint64) << (64 - (start & 31) - size).astype(np.uint64)
    heads = np.r_[0, np.flatnonzero(word[1:] != word[:-1]) + 1]
    sums, at = np.add.reduceat(shifted, heads), word[heads]
    total = int(octets.sum())
    words = np.zeros((total >> 2) + 2, np.uint64)
    words[at] = sums >> np.uint64(32)
    words[at + 1] += sums & np.uint64(0xFFFFFFFF)
    data = words.astype(">u4").view(np.uint8)[:total]
    data[first + octets - 1] |= ((1 << (-bits & 7)) - 1).astype(np.uint8)
    ff = np.flatnonzero(data == 255)
    own = np.cumsum(counts) - counts
    number = np.arange(len(each)) - np.repeat(own, counts)
    marked = number > 0
    places = np.concatenate([ff + 1, np.repeat(first[marked], 2)])
    markers = np.full((int(marked.sum()), 2), 255, np.uint8)
    markers[:, 1] = 0xD0 + (number[marked] - 1 & 7)
    whole = np.insert(data, places, np.concatenate([np.zeros(len(ff), np.uint8), markers.ravel()])).tobytes()
    starts = first[own] + np.searchsorted(ff, first[own]) + 2 * (own - np.arange(len(own)))
    edges = [*starts.tolist(), len(whole)]
    return [whole[a:b] for a, b in zip(edges, edges[1:])]


def _first_pass(values: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """A band's first scan; values: blocks x band, at its point transform; begin: intervals' first blocks."""
    blocks, width = values.shape
    flat = values.ravel()
    place = np.flatnonzero(flat)
    value = flat[place].astype(np.int64)
    if len(value) and max(value.max(), -value.min()) > 1023:
        raise ValueError("coefficients have 10 bits at most")
    row = place // width
    col = place - row * width
    run = np.diff(place, prepend=0) - 1
    head = np.ones(len(row), bool)
    head[1:] = row[1:] != row[:-1]
    run[head] = col[head]
    last = np.full(blocks, -1)
    last[row] = col
    ends = last < width - 1
    ends_before = np.cumsum(ends) - ends
    each = (run >> 4) + 1
    upto = np.cumsum(each)
    in_row = np.diff(np.r_[0, upto][np.searchsorted(row, np.arange(blocks + 1))])
    total = int(upto[-1] if len(upto) else 0) + int(ends.sum())
    code, size = np.full(total, AC_CODES[0xF0]), np.full(total, AC_SIZES[0xF0])
    at = upto - 1 + ends_before[row]
    codes, sizes = _coefficient_codes()
    symbol = ((run & 15) << 11) + 1024 + value
    code[at], size[at] = codes[symbol], sizes[symbol]
    end_at = (np.cumsum(in_row) + ends_before)[ends]
    code[end_at], size[end_at] = AC_CODES[0], AC_SIZES[0]
    return _packed(code, size, np.add.reduceat(in_row + ends, begin), counts)


def _refinement(values: np.ndarray, low: int, begin: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """A band's scan of the bit low. Blocks with zeros among their history are coded one by one."""
    size = np.abs(values)
    history = size >> low + 1 > 0
    bit = (size >> low & 1).astype(np.uint8)
    full = history.all(axis=1)
    odd = np.flatnonzero(~(full | (size >> low == 0).all(axis=1)))
    refined = [_refined(values[i], history[i], bit[i], low) for i in odd]
    # the end of block, then a correction bit for each coefficient that is known: tokens of up to 32 bits
    width, end = values.shape[1], int(AC_SIZES[0])
    cuts = [0, *range(32 - end, width, 32), width]
    each = np.where(full, len(cuts) - 1, 1)
    each[odd] = [len(c) for c, _ in refined]
    first = np.cumsum(each) - each
    code, length = np.full(int(each.sum()), AC_CODES[0]), np.full(int(each.sum()), end)
    packed = np.zeros((int(full.sum()), 8), np.uint8)
    known = np.packbits(bit[full], axis=1)
    packed[:, : known.shape[1]] = known
    bits = packed.view(">u8").ravel().astype(np.uint64)
    for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = (bits << np.uint64(a) >> np.uint64(64 - (b - a))).astype(np.int64)
        code[first[full] + j] = part if j else AC_CODES[0] << b | part
        length[first[full] + j] = b - a if j else end + b
    for i, (codes, sizes) in zip(odd, refined):
        code[first[i] : first[i] + each[i]], length[first[i] : first[i] + each[i]] = codes, sizes
    return _packed(code, length, np.add.reduceat(each, begin), counts)


def _refined(values, history, bit, low) -> tuple[list[int], list[int]]:
    code, size, waiting, run = [], [], [], 0
    new = [k for k in range(len(values)) if not history[k] and bit[k]]
    last = new[-1] if new else -1

    def put(symbol: int) -> None:
        code.append(int(AC_CODES[symbol]))
        size.append(int(AC_SIZES[symbol]))

    def flush() -> None:
        code.extend(waiting)
        size.extend([1] * len(waiting))
        waiting.clear()

    for k in range(len(values)):
        if history[k]:
            waiting.append(int(bit[k]))
        elif not bit[k]:
            run += 1
            if run == 16 and k < last:
                put(0xF0)
                flush()
                run = 0
        else:
            put(run << 4 | 1)
            code.append(int(values[k] > 0))
            size.append(1)
            flush()
            run = 0
    if run or waiting:
        put(0)
        flush()
    return code, size


def encode(images: list[tuple[int, int, np.ndarray, bytes]]) -> list[bytes]:
    """Files of images (MCUs across, MCUs down, coefficients, comment).

    coefficients: int array, blocks in MCU order x 64 in zigzag order."""
    coefficients = np.concatenate([c for _, _, c, _ in images])
    heads, base, orders, units = [], 0, [[], [], []], [[], [], []]
    mcus = []
    for mw, mh, _, comment in images:
        parts = [b"\xff\xd8", b"\xff\xfe" + struct.pack(">H", len(comment) + 2) + comment, b"\xff\xdb\0\x43\0" + b"\x01" * 64]
        parts.append(b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, mh * 16, mw * 16, 3) + b"\x01\x22\0\x02\x11\0\x03\x11\0")
        parts += [b"\xff\xc4" + struct.pack(">HB", len(t) + 3, i) + t for i, t in ((0, DC_TABLE), (16, AC_TABLE))]
        heads.append(parts)
        for c, o in enumerate(order_of(mw, mh)):
            orders[c].append(o + base)
            units[c].append(len(o))
        mcus.append(mw * mh)
        base += mw * mh * 6
    order = [np.concatenate(o) for o in orders]
    for comps, lo, hi, high, low in SCRIPT:
        c = comps[0]
        of_scan, step = (np.array(mcus), MCUS) if len(comps) > 1 else (np.array(units[c]), BLOCKS)
        counts = -(-of_scan // step)
        before = np.cumsum(of_scan) - of_scan - step * (np.cumsum(counts) - counts)
        begin = np.repeat(before, counts) + step * np.arange(int(counts.sum()))
        if len(comps) > 1:
            dc = coefficients[:, 0].astype(np.int64)
            each = 6 * np.diff(begin, append=len(dc) // 6)
            if high:
                data = _packed(dc >> low & 1, np.ones(len(dc), np.int64), each, counts)
            else:
                data = _packed(*_dc_first(dc >> low, begin), each, counts)
        else:
            values = coefficients[order[c], lo : hi + 1]
            data = _refinement(values, low, begin, counts) if high else _first_pass(np.sign(values) * (np.abs(values) >> low), begin, counts)
        head = b"\xff\xdd\0\x04" + struct.pack(">H", step) + b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(comps), len(comps))
        head += b"".join(bytes([x + 1, 0]) for x in comps) + bytes([lo, hi, high << 4 | low])
        for parts, own in zip(heads, data):
            parts += [head, own]
    return [b"".join([*p, b"\xff\xd9"]) for p in heads]


def _dc_first(dc: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blocks = dc.reshape(-1, 6)
    diff = np.empty_like(blocks)
    before = np.zeros((len(blocks), 3), np.int64)
    before[1:] = blocks[:-1, 3:6]
    before[begin] = 0
    diff[:, 0] = blocks[:, 0] - before[:, 0]
    diff[:, 1:4] = blocks[:, 1:4] - blocks[:, 0:3]
    diff[:, 4:] = blocks[:, 4:] - before[:, 1:]
    bits, extra = _magnitude(diff.ravel())
    return DC_CODES[bits] << bits | extra, DC_SIZES[bits] + bits


#: The end of a scan's data: a marker that is neither stuffing nor a restart.
SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7]")
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def parse(data: bytes) -> dict:
    """Sides in MCUs, comment, tables and scans of a file; each scan with its intervals' bytes, unstuffed."""
    out, tables, step, at = {"scans": [], "comment": b""}, {}, 0, 2
    while True:
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xFE:
            out["comment"] = body
        elif kind == 0xC2:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or n != 3 or height % 16 or width % 16 or [body[7], body[10], body[13]] != [0x22, 0x11, 0x11]:
                raise ValueError("not a 4:2:0 image with sides that are multiples of 16")
            out |= {"mw": width // 16, "mh": height // 16, "names": (body[6], body[9], body[12])}
        elif kind == 0xC4:
            tables[body[0]] = body[1:]
        elif kind == 0xDD:
            step = struct.unpack(">H", body)[0]
        elif kind == 0xDA:
            end = SCAN_END.search(data, at).start()
            own = data[at:end]
            parts = [own] if b"\xff" not in own else [p.replace(b"\xff\0", b"\xff") for p in RESTART.split(own)]
            out["scans"].append((_scan(out["names"], body, step, tables.get(0, b""), tables.get(16, b"")), parts))
            at = end
            if data[at + 1] == 0xD9:
                return out


@lru_cache(256)
def _scan(names: tuple[int, ...], body: bytes, step: int, dc: bytes, ac: bytes) -> tuple:
    """What a scan's header says: components, band, bits, interval and tables."""
    n = body[0]
    lo, hi, bits = body[1 + 2 * n :][:3]
    return tuple(names.index(body[1 + 2 * i]) for i in range(n)), lo, hi, bits >> 4, bits & 15, step, dc, ac


class _Lanes:
    """Bit readers, one for each interval, that step together."""

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(p) for p in parts])
        data = np.frombuffer(b"".join(parts) + b"\xff" * 12, np.uint8)
        self.bytes = data
        near = data.astype(np.int32)
        #: 24 bits from each byte on
        self.near = near[:-2] << 16 | near[1:-1] << 8 | near[2:]
        self.pos = (np.cumsum(sizes) - sizes) * 8

    @cached_property
    def window(self) -> np.ndarray:
        """40 bits from each byte on."""
        return self.near[:-2].astype(np.int64) << 16 | self.bytes[3:-1].astype(np.int64) << 8 | self.bytes[4:]


def decode(files: list[bytes]) -> list[tuple[int, int, np.ndarray, bytes]]:
    """MCUs across and down, coefficients (as encode takes them) and comment of each file."""
    parsed = [parse(f) for f in files]
    like: dict[tuple, list[int]] = {}
    for i, p in enumerate(parsed):
        like.setdefault(tuple(s for s, _ in p["scans"]), []).append(i)
    out: list = [None] * len(files)
    for script, members in like.items():
        group = [parsed[i] for i in members]
        orders, base, bases = [[], [], []], 0, []
        for p in group:
            for c, o in enumerate(order_of(p["mw"], p["mh"])):
                orders[c].append(o + base)
            bases.append(base)
            base += p["mw"] * p["mh"] * 6
        bases.append(base)
        order = [np.concatenate(o) for o in orders]
        flat = np.zeros(base * 64, np.int32)
        at = 0
        while at < len(script):
            comps, lo, hi, high, low, step, dc, ac = script[at]
            # scans of other components with the same band and bits are read along with this one
            upto = at + 1
            while len(comps) == 1 and upto < len(script) and script[upto][1:] == script[at][1:] and script[upto][0] not in [x[0] for x in script[at:upto]]:
                upto += 1
            units, parts = [], []
            for k in range(at, upto):
                own = script[k][0]
                units += [p["mw"] * p["mh"] * (6 if len(own) > 1 else 4 if own == (0,) else 1) for p in group]
                parts += [x for p in group for x in p["scans"][k][1]]
            step *= 6 if len(comps) > 1 else 1
            lanes, first = _Lanes(parts), np.cumsum(units) - units
            starts = np.concatenate([np.arange(0, u, step) + a for u, a in zip(units, first)])
            ends = np.minimum(starts + step, np.repeat(first + units, [-(-u // step) for u in units]))
            places = np.concatenate([order[script[k][0][0]] for k in range(at, upto)])
            if len(comps) > 1:
                if comps != (0, 1, 2):
                    raise ValueError("a scan of some components only")
                _read_dc(lanes, flat, starts, ends, high, low, dc)
            elif high:
                _read_refinement(lanes, flat, places, starts, ends, lo, hi, low, ac)
            else:
                _read_first(lanes, flat, places, starts, ends, lo, hi, low, ac)
            at = upto
        blocks = flat.reshape(-1, 64)
        for i, p, a, b in zip(members, group, bases, bases[1:]):
            out[i] = (p["mw"], p["mh"], blocks[a:b], p["comment"])
    return out


def _read_dc(lanes: _Lanes, flat, starts, ends, high, low, table) -> None:
    if high:
        each = ends - starts
        place = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        at = np.repeat(lanes.pos, each) + place
        bit = lanes.bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
        flat[(np.repeat(starts, each) + place) * 64] |= bit.astype(np.int32) << low
        return
    codes = lookup(table)
    block, end, pos = starts.copy(), ends, lanes.pos.copy()
    before = np.zeros((3, len(starts)), np.int64)
    for j in range(int((ends - starts).max())):
        live = block < end
        if not live.all():
            block, end, pos, before = block[live], end[live], pos[live], before[:, live]
        c = max(0, j % 6 - 3)
        w, off = lanes.window[pos >> 3], pos & 7
        e = codes[w >> 24 - off & 0xFFFF]
        n, s = e & 255, e >> 8
        x = w >> 40 - off - n - s & (1 << s) - 1
        before[c] += np.where((s > 0) & (x < 1 << np.maximum(s - 1, 0)), x - (1 << s) + 1, x)
        flat[block * 64] = before[c] << low
        pos, block = pos + n + s, block + 1


@lru_cache(16)
def coefficients_at(table: bytes) -> np.ndarray:
    """For each 16 bits that start with a coefficient, 16 zeros or the end of one block, packed in 32
    bits: bits read, run of zeros << 5, END if one, the coefficient (or 0) << 16; others: OTHER."""
    every, e = np.arange(1 << 16), lookup(table)
    n, s, r = e & 255, e >> 8 & 15, e >> 12
    known = (n > 0) & (n + s <= 16)
    x = every >> np.where(known, 16 - n - s, 0) & (1 << s) - 1
    value = np.where(s == 0, 0, np.where(x < 1 << np.maximum(s - 1, 0), x - (1 << s) + 1, x))
    simple = known & ((s > 0) | (r == 15) | (r == 0))
    end = (s == 0) & (r == 0)
    return np.where(simple, n + s | r << 5 | np.where(end, END, 0) | value << 16, OTHER).astype(np.int32)


OTHER, END = 1 << 9, 1 << 10


def _read_first(lanes: _Lanes, flat, order, starts, ends, lo, hi, low, table) -> None:
    codes = coefficients_at(table)
    block, end, pos = starts.copy(), ends, lanes.pos.copy()
    base = order * 64 + lo
    place = base[block]
    limit = place + (hi - lo)
    while len(block):
        e = codes.take(lanes.near.take(pos >> 3) >> 8 - (pos & 7) & 0xFFFF)
        other = e & OTHER
        if other.any():
            rows = np.flatnonzero(other)
            _read_others(lanes, flat, block, place, limit, pos, rows, low, table)
            e[rows] = 0
            step = np.ones(len(e), np.int64)
            step[rows] = 0
        else:
            rows, step = None, 1
        place += e >> 5 & 15
        if rows is None:
            flat[place] = e >> 16 << low
        else:
            flat[place[step > 0]] = (e >> 16 << low)[step > 0]
        # the end of a block is a step beyond it
        place += ((e & END) >> 4) + step
        pos += e & 31
        full = np.flatnonzero(place > limit)
        if len(full):
            after = block[full] + 1
            block[full] = after
            if (after >= end[full]).any():
                live = block < end
                block, end, pos, place, limit = block[live], end[live], pos[live], place[live], limit[live]
                full = np.flatnonzero(place > limit)
            start = base[block[full]]
            place[full], limit[full] = start, start + (hi - lo)


def _read_others(lanes: _Lanes, flat, block, place, limit, pos, rows, low, table) -> None:
    """The next symbol of some lanes, any that may be: long coefficients, ends of several blocks."""
    at = pos[rows]
    w, off = lanes.window[at >> 3], at & 7
    e = lookup(table)[w >> 24 - off & 0xFFFF]
    n, s, r = e & 255, e >> 8 & 15, e >> 12
    over = s == 0
    x = w >> 40 - off - n - s & (1 << s) - 1
    some = rows[~over]
    place[some] += r[~over]
    flat[place[some]] = (np.where(x < 1 << np.maximum(s - 1, 0), x - (1 << s) + 1, x) << low)[~over]
    place[some] += 1
    # an end of blocks: 1 << r of them, and as many more as r extra bits say
    runs = (1 << r) + (w >> 40 - off - n - r & (1 << r) - 1)
    place[rows[over]] = limit[rows[over]] + 1
    block[rows[over]] += (runs - 1)[over]
    pos[rows] += n + np.where(over, r, s)


def _read_refinement(lanes: _Lanes, flat, order, starts, ends, lo, hi, low, table) -> None:
    codes = lookup(table)
    blocks = flat.reshape(-1, 64)
    known = blocks[order, lo : hi + 1] != 0
    counts = known.sum(axis=1)
    bit_at = np.full(len(order), -1)  # where the correction bits of a block begin, for plain blocks
    block, end, pos = starts.copy(), ends, lanes.pos.copy()
    while len(block):
        e = codes[lanes.near[pos >> 3] >> 8 - (pos & 7) & 0xFFFF]
        plain = e >> 8 == 0
        bit_at[block[plain]] = (pos + (e & 255))[plain]
        pos = pos + np.where(plain, (e & 255) + counts[block], 0)
        after = block + 1
        for i in np.flatnonzero(~plain):
            pos[i], after[i] = _read_refined(lanes, blocks, order, int(block[i]), int(pos[i]), lo, hi, low, codes)
        block = after
        live = block < end
        if not live.all():
            block, end, pos = block[live], end[live], pos[live]
    whole = np.flatnonzero((bit_at >= 0) & (counts == hi - lo + 1))
    if len(whole):
        at = bit_at[whole]
        near = lanes.bytes[(at >> 3)[:, None] + np.arange(9)]
        shift = (at & 7).astype(np.uint64)
        bits = near[:, :8].copy().view(">u8").ravel().astype(np.uint64) << shift | near[:, 8] >> np.uint64(8) - shift
        bit = np.unpackbits(bits.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, : hi - lo + 1].astype(np.int32) << low
        rows = order[whole]
        own = blocks[rows, lo : hi + 1]
        blocks[rows, lo : hi + 1] = own + np.where(own > 0, bit, -bit)
        bit_at[whole] = -1
    row, col = np.nonzero(known & (bit_at >= 0)[:, None])
    each = np.bincount(row, minlength=len(order))
    at = bit_at[row] + np.arange(len(row)) - (np.cumsum(each) - each)[row]
    bit = (lanes.bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(np.int32)
    place = order[row] * 64 + lo + col
    flat[place] += np.sign(flat[place]) * (bit << low)


def _read_refined(lanes: _Lanes, blocks, order, block, pos, lo, hi, low, codes) -> tuple[int, int]:
    """One block's refinement, symbol by symbol: the place after it, and the next block to read."""

    def take(n: int) -> int:
        nonlocal pos
        got = 0
        for _ in range(n):
            got = got << 1 | int(lanes.bytes[pos >> 3]) >> 7 - (pos & 7) & 1
            pos += 1
        return got

    def correct(own, k: int) -> None:
        if take(1):
            own[k] += (1 if own[k] > 0 else -1) << low

    own, k, left = blocks[order[block]], lo, 0
    while k <= hi:
        e = int(codes[int(lanes.near[pos >> 3]) >> 8 - (pos & 7) & 0xFFFF])
        pos += e & 255
        r, s = e >> 12, e >> 8 & 15
        if not s and r < 15:
            left = (1 << r) + take(r)
            break
        value = (1 if take(1) else -1) << low if s else 0
        while k <= hi:
            if own[k]:
                correct(own, k)
            elif r:
                r -= 1
            else:
                own[k] = value
                k += 1
                break
            k += 1
    for i in range(left):
        own = blocks[order[block + i]]
        for j in range(k if not i else lo, hi + 1):
            if own[j]:
                correct(own, j)
    return pos, block + max(1, left)


@lru_cache(1)
def _waves() -> np.ndarray:
    """The inverse transform as a matrix of integers (zigzag coefficient x sample), times 4096."""
    u = np.arange(8)
    one = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1)[:, None] / 2
    return np.rint(np.einsum("vy,ux->vuyx", one, one).reshape(64, 64)[ZIGZAG] * 4096)


def samples(coefficients: np.ndarray) -> np.ndarray:
    """8-bit samples of each block. Sums of integers below 2**53 are exact in any order."""
    out = coefficients.astype(np.float64) @ _waves()
    out += 2048 + (128 << 12)
    out *= 1 / 4096
    return np.minimum(np.maximum(out, 0, out=out), 255, out=out).astype(np.uint8)


def rgb(mw: int, mh: int, blocks: np.ndarray) -> np.ndarray:
    """The full-resolution tensor (height, width, 3) of an image's samples, blocks in MCU order."""
    grid = blocks.reshape(mh, mw, 6, 8, 8)
    y = grid[:, :, :4].reshape(mh, mw, 2, 2, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(mh * 8, 2, mw * 8, 2).astype(np.int16)
    cb, cr = (grid[:, :, c].transpose(0, 2, 1, 3).reshape(mh * 8, mw * 8).astype(np.int32) - 128 for c in (4, 5))
    out = np.empty((mh * 8, 2, mw * 8, 2, 3), np.uint8)
    # the colour matrix in 16 bits of fraction, at the chroma's resolution
    for i, x in enumerate((91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb)):
        out[..., i] = np.minimum(np.maximum(y + (x + 32768 >> 16).astype(np.int16)[:, None, :, None], 0), 255)
    return out.reshape(mh * 16, mw * 16, 3)
