"""Progressive JPEG in numpy: coefficients to bytes and back, and pixels from coefficients.

The decoder handles Huffman-coded progressive (and, scan by scan, interleaved or single-component) files
with any sampling factors, spectral bands, successive approximation, end-of-band runs and restart
intervals. All restart intervals of all files that share a scan's settings are decoded side by side:
each numpy step takes one symbol of every interval, so files with short intervals decode fast, and a
file without any decodes correctly, if slowly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _zigzag() -> np.ndarray:
    """Row-major places of the coefficients in zigzag order."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([y * 8 + x for y, x in cells])


ZIGZAG = _zigzag()
_DCT = np.array([[(0.5 if u else 0.5 / np.sqrt(2)) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], dtype=np.float32)


# -- Huffman tables ---------------------------------------------------------------------------------
def canonical(lengths: dict[int, int]) -> tuple[bytes, bytes]:
    """Counts by length and symbols of a table with the given code lengths."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(lengths[s] == n for s in order) for n in range(1, 17)), bytes(order)


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a table."""
    out, code, at = [], 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out.append((symbols[at], code, n))
            code, at = code + 1, at + 1
        code <<= 1
    return out


_tables: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits, the length and the symbol of the code that they begin with."""
    if table not in _tables:
        size, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for s, code, n in _codes(table[:16], table[16:]):
            size[code << (16 - n) : (code + 1) << (16 - n)], symbol[code << (16 - n) : (code + 1) << (16 - n)] = n, s
        _tables[table] = size, symbol
    return _tables[table]


# -- writing ----------------------------------------------------------------------------------------
#: The writer's own tables: short codes for magnitudes without a run of zeros, long ones for the rest.
_DC = canonical({s: 4 for s in range(12)})
_AC = canonical({(r << 4) | s: 4 if r == 0 and s < 10 else 10 for r in range(16) for s in range(11) if s or r in (0, 15) or r < 15})
_AC_CODE, _AC_LEN = np.zeros(256, np.int64), np.zeros(256, np.int64)
_DC_CODE, _DC_LEN = np.zeros(256, np.int64), np.zeros(256, np.int64)
for _s, _c, _n in _codes(*_AC):
    _AC_CODE[_s], _AC_LEN[_s] = _c, _n
for _s, _c, _n in _codes(*_DC):
    _DC_CODE[_s], _DC_LEN[_s] = _c, _n
#: Scans of the writer: components, first and last coefficient, previous and present bit.
SCANS = [((0, 1, 2), 0, 0, 0, 1)] + [((c,), a, b, 0, 1) for a, b in ((1, 5), (6, 63)) for c in range(3)] + [((0, 1, 2), 0, 0, 1, 0)] + [((c,), 1, 63, 1, 0) for c in range(3)]
MAX_ROWS = 8191


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _head(columns: int, rows: int) -> bytes:
    frame = bytes([8]) + (rows * 8).to_bytes(2, "big") + (columns * 8).to_bytes(2, "big") + bytes([3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"".join((
        b"\xff\xd8", _segment(0xDB, bytes([0] + [1] * 64)), _segment(0xC2, frame), _segment(0xC4, b"\x00" + b"".join(_DC)), _segment(0xC4, b"\x10" + b"".join(_AC)), _segment(0xDD, b"\x00\x01"),
    ))


def _scan_head(scan: tuple) -> bytes:
    parts, ss, se, ah, al = scan
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes([c + 1, 0]) for c in parts) + bytes([ss, se, (ah << 4) | al]))


def _pack(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each row (a restart interval), padded with ones to bytes: all bytes and the rows' offsets."""
    bits = lengths.sum(1)
    pad = -bits % 8
    values = np.concatenate([values, ((1 << pad) - 1)[:, None]], axis=1)
    lengths = np.concatenate([lengths, pad[:, None]], axis=1)
    offs = np.concatenate([[0], np.cumsum((bits + pad) >> 3)])
    flat = lengths.ravel()
    at = np.cumsum(flat) - flat  # rows end at bytes, so bits are dense
    word, room = at >> 6, 64 - (at & 63) - flat
    v = values.ravel().astype(np.uint64)
    over = room < 0
    first = np.where(over, v >> np.abs(np.minimum(room, 0)).astype(np.uint64), v << np.maximum(room, 0).astype(np.uint64))
    out = np.zeros((int(offs[-1]) >> 3) + 2, dtype=np.uint64)
    begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[begin]] = np.add.reduceat(first, begin)
    out[word[over] + 1] += v[over] << (64 + room[over]).astype(np.uint64)
    return out.byteswap().view(np.uint8)[: offs[-1]], offs


def _entropy(data: np.ndarray, offs: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuffed bytes with restart markers before the intervals whose number in their file isn't 0."""
    extra = np.zeros(len(data) + 1, dtype=np.int64)
    extra[1:] += data == 0xFF
    extra[offs[:-1]] += 2 * (number > 0)
    place = np.arange(len(data) + 1) + np.cumsum(extra)
    out = np.zeros(int(place[-1]), dtype=np.uint8)
    out[place[:-1]] = data
    again = number > 0
    mark = place[offs[:-1]][again]
    out[mark - 2], out[mark - 1] = 0xFF, 0xD0 + ((number[again] - 1) & 7)
    starts = place[offs[:-1]] - 2 * again
    return out, np.append(starts, place[-1])


def write(coefficients: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Files of the given numbers of units. ``coefficients``: units x 3 x 64 in zigzag order; each block
    is free of values in -1..1 or zero altogether. A unit is one block of each component."""
    shape = [(w := max(1, -(-int(n) // MAX_ROWS)), -(-int(n) // w)) for n in counts]
    total = np.array([w * h for w, h in shape])
    if (total != counts).any():  # fill up the last row
        grown = np.zeros((total.sum(), 3, 64), dtype=coefficients.dtype)
        begin = np.cumsum(total) - total
        grown[np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(len(coefficients))] = coefficients
        coefficients = grown
    number = np.arange(len(coefficients)) - np.repeat(np.cumsum(total) - total, total)
    bounds = np.concatenate([[0], np.cumsum(total)])
    used = (coefficients != 0).any(2)
    bodies: list[list[bytes]] = []
    for parts, ss, se, ah, al in SCANS:
        part = coefficients[:, parts, ss : se + 1].astype(np.int64)
        n = len(part)
        if ah:
            values = (np.abs(part) >> al & 1).reshape(n, -1)
            lengths = np.ones_like(values)
            if ss:  # end of band at once, then a correction bit for each coefficient
                values[~used[:, parts[0]]], lengths[~used[:, parts[0]]] = 0, 0
                values = np.concatenate([np.full((n, 1), _AC_CODE[0]), values], axis=1)
                lengths = np.concatenate([np.full((n, 1), _AC_LEN[0]), lengths], axis=1)
            else:
                values = (part >> al & 1).reshape(n, -1)
        else:
            v = (np.where(part < 0, -(-part >> al), part >> al) if ss else part >> al).reshape(n, -1)
            size = np.where(v == 0, 0, np.frexp(np.abs(v).astype(np.float64))[1]).astype(np.int64)
            code, length = (_AC_CODE, _AC_LEN) if ss else (_DC_CODE, _DC_LEN)
            extra = np.where(v < 0, v - 1, v) & ((1 << size) - 1)
            values, lengths = (code[size] << size) | extra, length[size] + size
            if ss:
                empty = ~used[:, parts[0]]
                lengths[empty] = 0
                values[empty] = 0
                values[empty, 0], lengths[empty, 0] = _AC_CODE[0], _AC_LEN[0]
        data, starts = _entropy(*_pack(values, lengths), number)
        raw = data.tobytes()
        cuts = starts[bounds].tolist()
        bodies.append([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])])
    heads = [_scan_head(s) for s in SCANS]
    known: dict[tuple[int, int], bytes] = {}
    out = []
    for k, s in enumerate(shape):
        if s not in known:
            known[s] = _head(*s)
        out.append(b"".join([known[s], *(x for h, b in zip(heads, bodies) for x in (h, b[k])), b"\xff\xd9"]))
    return out


# -- reading ----------------------------------------------------------------------------------------
@dataclass
class _Part:
    """A component: sampling, its quantisation table, blocks shown and stored in a row, first block."""

    h: int
    v: int
    quant: int
    across: int = 0
    down: int = 0
    stride: int = 0
    base: int = 0


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    parts: dict[int, _Part] = field(default_factory=dict)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    units: tuple[int, int] = (0, 0)
    blocks: int = 0
    scans: list[tuple] = field(default_factory=list)


def _parse(raw: bytes, base: int, marks: np.ndarray) -> Picture:
    """Headers of one file. ``marks``: places of the markers in its bytes, but for restarts."""
    p, at, tables, restart = Picture(), 2, {}, 0
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    while True:
        code, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        if code == 0xD9:
            return p
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if code == 0xDB:
            while body:
                wide, to = body[0] >> 4, body[0] & 15
                n = 64 * (1 + wide)
                p.quant[to] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif code == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif code == 0xDD:
            restart = int.from_bytes(body, "big")
        elif code == 0xC2:
            p.height, p.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            for k in range(body[5]):
                i, hv, q = body[6 + 3 * k : 9 + 3 * k]
                p.parts[i] = _Part(hv >> 4, hv & 15, q)
            top = max(x.h for x in p.parts.values()), max(x.v for x in p.parts.values())
            p.units = -(-p.width // (8 * top[0])), -(-p.height // (8 * top[1]))
            for x in p.parts.values():
                x.across, x.down = -(-(-(-p.width * x.h // top[0])) // 8), -(-(-(-p.height * x.v // top[1])) // 8)
                x.stride, x.base = p.units[0] * x.h, base + p.blocks
                p.blocks += p.units[0] * p.units[1] * x.h * x.v
        elif 0xC0 <= code <= 0xCF and code != 0xCC:
            raise ValueError(f"no progressive Huffman-coded file: frame {code:#x}")
        elif code == 0xDA:
            n = body[0]
            parts = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(n)]
            ss, se, a = body[1 + 2 * n : 4 + 2 * n]
            end = int(marks[np.searchsorted(marks, at)])
            setting = (len(parts), ss, se, a >> 4, a & 15, tuple(tables.get(t >> 4, b"") if ss == 0 else tables.get(16 | (t & 15), b"") for _, t in parts))
            p.scans.append((setting, [i for i, _ in parts], at, end, restart))
            at = end


class _Bits:
    """Unstuffed entropy-coded intervals, read at bit positions."""

    def __init__(self, data: np.ndarray, jobs: list[tuple], restarts: np.ndarray):
        cuts = [(a, b, *np.searchsorted(restarts, [a, b])) for _, _, a, b, _ in jobs]
        self.intervals = np.array([1 + hi - lo for _, _, lo, hi in cuts])
        raw = np.concatenate([data[a:b] for a, b, _, _ in cuts])
        keep = np.ones(len(raw), dtype=bool)
        keep[1:] = (raw[1:] != 0) | (raw[:-1] != 0xFF)
        shift = np.cumsum([0] + [b - a for a, b, _, _ in cuts])
        inner = np.concatenate([restarts[lo:hi] - a + s for (a, _, lo, hi), s in zip(cuts, shift)])
        keep[inner] = keep[inner + 1] = False
        start = np.sort(np.concatenate([shift[:-1], inner + 2]))
        self.start = (np.concatenate([[0], np.cumsum(keep)])[start]) * 8
        data = np.concatenate([raw[keep], np.zeros(8, np.uint8)]).astype(np.int64)
        self.window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]

    def peek(self, p: np.ndarray, n) -> np.ndarray:
        """The n (at most 16) bits at each position."""
        return (self.window[np.minimum(p >> 3, len(self.window) - 1)] >> (32 - n - (p & 7))) & ((1 << n) - 1)


def _extend(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << np.maximum(s - 1, 0)), v - (1 << s) + 1, v) * (s > 0)


def _scan(setting: tuple, jobs: list[tuple], coefficients: np.ndarray, data: np.ndarray, restarts: np.ndarray) -> None:
    """Decode one scan of several pictures. ``jobs``: (picture, component ids, first byte, end, restart
    interval); ``restarts``: places of all restart markers."""
    n, ss, se, ah, al, tables = setting
    bits = _Bits(data, jobs, restarts)
    many = bits.intervals
    total = np.array([p.parts[ids[0]].across * p.parts[ids[0]].down if n == 1 else p.units[0] * p.units[1] for p, ids, *_ in jobs])
    every = np.array([j[4] for j in jobs])
    owner = np.repeat(np.arange(len(jobs)), many)
    unit = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * every[owner]
    count = np.where(every > 0, np.minimum(every, total), total)[owner]
    count = np.minimum(count, total[owner] - unit)
    p = bits.start.copy()
    column = lambda f: np.array([[f(j[0], i) for i in j[1]] for j in jobs])[owner]
    base, stride = column(lambda q, i: q.parts[i].base), column(lambda q, i: q.parts[i].stride)
    across = column(lambda q, i: q.parts[i].across if n == 1 else q.units[0])
    factors = [(q.parts[i].h, q.parts[i].v) for q, ids, *_ in jobs[:1] for i in ids]
    if ss == 0:
        last = np.zeros((len(p), n), dtype=np.int64)
        for step in range(int(count.max(initial=0))):
            on = np.flatnonzero(count > step)
            at = unit[on] + step
            for c, (h, v) in enumerate(factors):
                y, x = at // across[on, c], at % across[on, c]
                for k in range(h * v if n > 1 else 1):
                    block = base[on, c] + (y * stride[on, c] + x if n == 1 else (y * v + k // h) * stride[on, c] + x * h + k % h)
                    if ah:
                        coefficients[block, 0] |= (bits.peek(p[on], 1) << al).astype(coefficients.dtype)
                        p[on] += 1
                        continue
                    size, symbol = (t[bits.peek(p[on], 16)] for t in _lookup(tables[c]))
                    last[on, c] += _extend(bits.peek(p[on] + size, symbol), symbol)
                    coefficients[block, 0] = last[on, c] << al
                    p[on] += size + symbol
        return
    size_of, symbol_of = _lookup(tables[0])
    base, stride, across = base[:, 0], stride[:, 0], across[:, 0]
    run, done = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    k, block = np.full(len(p), ss), base + unit // across * stride + unit % across
    zeros, value, inside = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), np.zeros(len(p), bool)
    on = np.flatnonzero(count > 0)
    while len(on):
        # intervals within an end-of-band run: the rest of the block at once
        rest = on[run[on] > 0]
        if len(rest):
            if ah:
                band = coefficients[block[rest]][:, ss : se + 1]
                fix = (band != 0) & (np.arange(ss, se + 1)[None, :] >= k[rest][:, None])
                order = np.cumsum(fix, axis=1)
                row, place = np.nonzero(fix)
                bit = bits.peek(p[rest][row] + order[row, place] - 1, 1)
                old = band[row, place]
                coefficients[block[rest][row], place + ss] = np.where((bit == 1) & (np.abs(old) >> al & 1 == 0), old + (np.sign(old) << al), old)
                p[rest] += order[:, -1]
            k[rest] = se + 1
            run[rest] -= 1
        live = on[k[on] <= se] if len(rest) else on
        if ah and len(live):  # one coefficient passed or one symbol read
            busy = live[inside[live]]
            if len(busy):
                old = coefficients[block[busy], k[busy]]
                hit = old != 0
                b = busy[hit]
                bit, old = bits.peek(p[b], 1), old[hit]
                coefficients[block[b], k[b]] = np.where((bit == 1) & (np.abs(old) >> al & 1 == 0), old + (np.sign(old) << al), old)
                p[b] += 1
                b = busy[~hit]
                last = b[zeros[b] == 0]
                coefficients[block[last], k[last]] = value[last] << al
                inside[last] = False
                zeros[b] -= 1
                k[busy] += 1
            fresh = live[~inside[live]] if not len(busy) else np.setdiff1d(live, busy, assume_unique=True)
            if len(fresh):
                code = bits.peek(p[fresh], 16)
                p[fresh] += size_of[code]
                symbol = symbol_of[code]
                r, s = symbol >> 4, symbol & 15
                stop = (s == 0) & (r < 15)
                f = fresh[stop]
                run[f] = (1 << r[stop]) + bits.peek(p[f], r[stop])
                p[f] += r[stop]
                f = fresh[~stop]
                sign = bits.peek(p[f], 1)
                new = s[~stop] > 0
                value[f], zeros[f], inside[f] = np.where(new, 2 * sign - 1, 0), r[~stop], True
                p[f] += new
        elif len(live):
            code = bits.peek(p[live], 16)
            symbol = symbol_of[code]
            p[live] += size_of[code]
            r, s = symbol >> 4, symbol & 15
            put = s > 0
            if put.all():
                f, fr, fs = live, r, s
            else:
                stop = ~put & (r < 15)
                f = live[stop]
                run[f] = (1 << r[stop]) - 1 + bits.peek(p[f], r[stop])
                p[f] += r[stop]
                k[f] = se + 1
                k[live[~put & (r == 15)]] += 16
                f, fr, fs = live[put], r[put], s[put]
            k[f] += fr
            coefficients[block[f], k[f]] = _extend(bits.peek(p[f], fs), fs) << al
            p[f] += fs
            k[f] += 1
        over = on[k[on] > se]
        if len(over):
            done[over] += 1
            k[over] = ss
            at = unit[over] + done[over]
            block[over] = base[over] + at // across[over] * stride[over] + at % across[over]
            inside[over] = False
            on = on[done[on] < count[on]]


def read(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[Picture]]:
    """Coefficients (blocks x 64, zigzag order) of the files in a byte array, and the pictures."""
    mark = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] != 0) & (data[1:] != 0xFF))
    restart = (data[mark + 1] & 0xF8) == 0xD0
    restarts, mark = mark[restart], mark[~restart]
    pictures, base = [], 0
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        lo, hi = np.searchsorted(mark, [a, b])
        pictures.append(_parse(data[a:b].tobytes(), base, mark[lo:hi] - a))
        base += pictures[-1].blocks
    coefficients = np.zeros((base, 64), dtype=np.int32)
    for number in range(max((len(p.scans) for p in pictures), default=0)):
        groups: dict[tuple, list[tuple]] = {}
        for k, p in enumerate(pictures):
            if number < len(p.scans):
                setting, ids, at, end, every = p.scans[number]
                factors = tuple((p.parts[i].h, p.parts[i].v) for i in ids)
                groups.setdefault((setting, factors), []).append((p, ids, int(offs[k]) + at, int(offs[k]) + end, every))
        for (setting, _), jobs in groups.items():
            _scan(setting, jobs, coefficients, data, restarts)
    return coefficients, pictures


def samples(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Blocks x 8 x 8 samples of 0..255: dequantised, inverse transform, level shift. Plain element-wise
    arithmetic in a fixed order, so that equal blocks give equal samples wherever they stand."""
    x = np.zeros((len(coefficients), 64), dtype=np.float32)
    x[:, ZIGZAG] = coefficients * quant
    x = np.ascontiguousarray(x.reshape(-1, 8, 8).transpose(1, 2, 0))  # v, u, block
    rows = [sum(_DCT[v, y] * x[v] for v in range(8)) for y in range(8)]  # y: u, block
    out = np.empty((len(coefficients), 8, 8), dtype=np.uint8)
    for y in range(8):
        for c in range(8):
            s = sum(_DCT[u, c] * rows[y][u] for u in range(8))
            out[:, y, c] = np.clip(np.rint(s) + 128, 0, 255)
    return out


def rgb(planes: list[np.ndarray]) -> np.ndarray:
    """RGB (last axis) of full-resolution Y, Cb and Cr samples, or of Y alone."""
    y = planes[0].astype(np.float32)
    if len(planes) < 3:
        return np.stack([planes[0]] * 3, axis=-1)
    cb, cr = planes[1].astype(np.float32) - 128, planes[2].astype(np.float32) - 128
    return np.clip(np.rint(np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], axis=-1)), 0, 255).astype(np.uint8)


def tensor(p: Picture, coefficients: np.ndarray, base: int = 0) -> np.ndarray:
    """height x width x 3 tensor of a picture; chroma is repeated up to full resolution. ``base``: the
    first of the given blocks."""
    top = max(x.h for x in p.parts.values()), max(x.v for x in p.parts.values())
    planes = []
    for x in p.parts.values():
        n = p.units[0] * p.units[1] * x.h * x.v
        s = samples(coefficients[x.base - base : x.base - base + n], p.quant[x.quant])
        plane = s.reshape(-1, x.stride, 8, 8).transpose(0, 2, 1, 3).reshape(-1, x.stride * 8)
        planes.append(plane.repeat(top[1] // x.v, 0).repeat(top[0] // x.h, 1)[: p.height, : p.width])
    return rgb(planes)
