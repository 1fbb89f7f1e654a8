"""Progressive JPEG in numpy: many images at a time.

The decoder accumulates spectral-selection and successive-approximation scans into coefficient arrays. Entropy coding
is sequential within a restart interval only, so every restart interval of every image of a batch is a lane, and all
lanes take one Huffman symbol per step. Scans of one kind (band, bit positions, tables) share their steps, whatever
their image or component. After the last scan the coefficients are transformed back, chroma is upsampled, and the pixels
become RGB, all in integers or exactly represented floats: the same bytes always give the same values.

The encoder stores arbitrary bytes: 64 bytes are the quantised coefficients of one block, in zigzag order, as signed
8-bit numbers under a quantisation table of ones. Coefficients are JPEG's own units, so nothing is lost to rounding.
Images are YCbCr 4:2:0; six blocks make a unit of 16 x 16 pixels. The payload's length stands in a comment.
"""

from __future__ import annotations

import functools
import re
import struct
from dataclasses import dataclass, field

import numpy as np

U = np.uint64

# Fixed values of the JPEG format
SOI, EOI, SOF2, DHT, DQT, DRI, SOS, COM = 0xD8, 0xD9, 0xC2, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE


def zigzag() -> np.ndarray:
    """Natural index (8 * row + column) of each zigzag position."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()

# Huffman tables


def _canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A DHT body and symbol -> (code, length), from symbol -> length."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(lengths[s] == n for s in order) for n in range(1, 17)]
    codes, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    return bytes(counts) + bytes(order), codes


_RUNS = [(r << 4) | s for r in range(16) for s in range(1, 11)] + [r << 4 for r in range(16)]
#: Most bytes of text fall into two sizes once their lowest bit is left to the refinement.
DC_BODY, DC = _canonical({s: 4 for s in range(12)})
AC_BODY, AC = _canonical({s: {0x06: 1, 0x05: 2}.get(s, 10) for s in _RUNS})
REFINE_BODY, REFINE = _canonical({s: 1 if s == 0 else 7 for s in [(r << 4) | 1 for r in range(16)] + [r << 4 for r in range(16)]})


@functools.lru_cache(64)
def _lookup(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length by the next 16 bits; length 0 where there is no such code."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            low = code << (16 - n)
            symbol[low : low + (1 << (16 - n))], length[low : low + (1 << (16 - n))] = body[at], n
            at, code = at + 1, code + 1
        code <<= 1
    return symbol, length


@functools.lru_cache(64)
def _lookup_ac(body: bytes) -> np.ndarray:
    """Run, value and bits by the next 16 bits where code and value fit into them: ((value + 2048) << 16) | (run << 8) |
    bits; 0 elsewhere."""
    symbol, length = _lookup(body)
    size, run = symbol & 15, symbol >> 4
    bits = length + size
    ok = (length > 0) & (size > 0) & (bits <= 16)
    raw = (np.arange(1 << 16) >> np.maximum(16 - bits, 0)) & ((1 << size) - 1)
    value = np.where(raw < (1 << np.maximum(size - 1, 0)), raw - (1 << size) + 1, raw)
    return np.where(ok, ((value + 2048) << 16) | (run << 8) | bits, 0).astype(np.int32)


# Encoder

SCANS = [("dc", 0, 0, 0, 1), ("ac", 1, 20, 0, 1), ("ac", 21, 63, 0, 1), ("dc", 0, 0, 1, 0), ("ac", 1, 63, 1, 0)]


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def _pack(value: np.ndarray, length: np.ndarray, at: np.ndarray, n_bytes: int) -> np.ndarray:
    """Bytes with each value's lowest bits written at its bit position; positions don't overlap."""
    out = np.zeros(n_bytes)
    room = length + (at & 7)
    word = value << (U(64) - room.astype(U))
    byte = at >> 3
    for j in range(int(room.max(initial=0) + 7) // 8):
        part = (word >> U(56 - 8 * j)) & U(255)
        if j > 1:
            pick = np.flatnonzero(room > 8 * j)
            out += np.bincount(byte[pick] + j, part[pick], n_bytes)[:n_bytes]
        else:
            out += np.bincount(byte + j, part, n_bytes + 1)[:n_bytes]
    return out.astype(np.uint8)


def _intervals(bits: np.ndarray, packed, last: np.ndarray, scan: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded data of intervals of so many bits, with padding, stuffing and restart markers, and where each scan
    ends in it. packed(start bit of each interval, bytes) gives the bytes; last marks the last interval of a scan, scan
    the number of an interval in its scan."""
    size = (bits + 7) >> 3
    end = np.cumsum(size)
    data = packed((end - size) * 8, int(end[-1]) + 8)[: end[-1]]
    some = size > 0
    data[end[some] - 1] |= ((1 << (-bits[some] & 7)) - 1).astype(np.uint8)
    full = data == 0xFF
    shift = np.cumsum(full) - full
    interval = np.repeat(np.arange(len(size)), size)
    marks = np.cumsum(~last)
    before = marks - ~last
    at = np.arange(len(data)) + shift + 2 * before[interval]
    stuffed = np.r_[0, np.cumsum(full)][end]
    out = np.zeros(int(end[-1] + stuffed[-1] + 2 * marks[-1]), np.uint8)
    out[at] = data
    where = (end + stuffed + 2 * before)[~last]
    out[where], out[where + 1] = 0xFF, 0xD0 + (scan[~last] & 7)
    return out.tobytes(), (end + stuffed + 2 * before)[last]


def _sizes(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _magnitude(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v).astype(U)


@functools.cache
def _ac_codes() -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, U), np.zeros(256, np.int64)
    for s, (c, n) in AC.items():
        code[s], length[s] = c, n
    return code, length


def _ac_first(coef: np.ndarray, lo: int, hi: int, al: int):
    code, length = _ac_codes()
    band = coef[:, lo : hi + 1].astype(np.int64)
    band = np.sign(band) * (np.abs(band) >> al)
    n, width = band.shape
    flat = np.flatnonzero(band)
    block, k = flat // width, flat % width
    v = band.ravel()[flat]
    previous = np.r_[-1, k[:-1]]
    previous[np.r_[True, block[1:] != block[:-1]]] = -1
    run = k - previous - 1
    size = _sizes(v)
    symbol = ((run & 15) << 4) | size
    value = (code[symbol] << size.astype(U)) | _magnitude(v, size)
    bits = length[symbol] + size
    for z in range(1, 4):  # a ZRL for each full 16 zeros before
        more = np.flatnonzero(run >= 16 * z)
        value[more] |= code[0xF0] << bits[more].astype(U)
        bits[more] += length[0xF0]
    count = np.bincount(block, minlength=n)
    last = np.full(n, -1)
    last[block] = k
    eob = last < width - 1
    upto = np.r_[0, np.cumsum(bits)]
    first = np.r_[0, np.cumsum(count)]
    own = upto[first[1:]] - upto[first[:-1]]
    total = own + eob * length[0]

    def packed(start, n_bytes):
        at = start[block] + upto[:-1] - upto[first[block]]
        e = np.flatnonzero(eob)
        return _pack(np.r_[value, np.full(len(e), code[0])], np.r_[bits, np.full(len(e), length[0])], np.r_[at, start[e] + own[e]], n_bytes)

    return total, packed


def _refine_plain(coef: np.ndarray, lo: int, hi: int) -> tuple[list[int], list[int]]:
    """The (value, length) items of one block's refinement, one by one; for blocks in which coefficients turn nonzero."""
    values, lengths = [], []
    band = [int(x) for x in coef[lo : hi + 1]]
    new = [i for i, x in enumerate(band) if abs(x) == 1]
    put = lambda v, n: (values.append(v), lengths.append(n))
    at, held = 0, []
    zeros = 0
    for i, x in enumerate(band):
        if abs(x) > 1:
            held.append(abs(x) & 1)
            continue
        if x:
            put(*REFINE[(zeros << 4) | 1])
            put(int(x > 0), 1)
            for b in held:
                put(b, 1)
            held, zeros, at = [], 0, i + 1
        elif zeros == 15 and i < max(new):
            put(*REFINE[0xF0])
            for b in held:
                put(b, 1)
            held, zeros, at = [], 0, i + 1
        else:
            zeros += 1
    if at < len(band):
        put(*REFINE[0])
        for b in held:
            put(b, 1)
    return values, lengths


def _ac_refine(coef: np.ndarray, lo: int, hi: int):
    band = np.abs(coef[:, lo : hi + 1])
    n, width = band.shape
    fresh = (band == 1).any(axis=1)
    known = (band > 1) & ~fresh[:, None]
    flat = np.flatnonzero(known)
    block = flat // width
    count = np.bincount(block, minlength=n)
    total = count + REFINE[0][1]
    rank = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
    plain = {int(b): _refine_plain(coef[b], lo, hi) for b in np.flatnonzero(fresh)}
    for b, (_, lengths) in plain.items():
        total[b] = sum(lengths)

    def packed(start, n_bytes):
        bits = np.zeros(n_bytes * 8, np.uint8)  # the code of an end of block is a zero bit
        bits[start[block] + REFINE[0][1] + rank] = (band.ravel()[flat] & 1).astype(np.uint8)
        for b, (values, lengths) in plain.items():
            text = "".join(f"{v:0{m}b}" for v, m in zip(values, lengths, strict=True))
            bits[start[b] : start[b] + len(text)] = np.frombuffer(text.encode(), np.uint8) - 48
        return np.packbits(bits)

    return total, packed


def _dc_first(coef: np.ndarray, components: int):
    """coef: (units, 6 blocks); the last blocks of a unit are Cb and Cr. Each unit is an interval."""
    v = coef.astype(np.int64) >> 1
    diff = v.copy()
    diff[:, 1:4] -= v[:, :3]
    size = _sizes(diff)
    code, length = np.array([DC[s][0] for s in range(12)], U), DC[0][1]
    value = (code[size] << size.astype(U)) | _magnitude(diff, size)
    bits = size + length
    upto = np.cumsum(bits, axis=1)

    def packed(start, n_bytes):
        return _pack(value.ravel(), bits.ravel(), (start[:, None] + upto - bits).ravel(), n_bytes)

    return upto[:, -1], packed


def _dc_refine(coef: np.ndarray):
    def packed(start, n_bytes):
        out = np.zeros(n_bytes, np.uint8)
        out[start >> 3] = np.packbits((coef & 1).astype(np.uint8), axis=1)[:, 0]
        return out

    return np.full(len(coef), coef.shape[1]), packed


def _grid(blocks: int) -> tuple[int, int]:
    """Units across and down for so many blocks."""
    units = -(-blocks // 6)
    across = int(np.ceil(np.sqrt(units)))
    return across, -(-units // across)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload; lengths are positive multiples of 64."""
    grids = [_grid(len(p) // 64) for p in payloads]
    units = np.array([a * d for a, d in grids])
    data = b"".join(p + bytes(384 * int(u) - len(p)) for p, u in zip(payloads, units, strict=True))
    coef = np.frombuffer(data, np.int8).reshape(-1, 6, 64).astype(np.int16)
    first = np.r_[0, np.cumsum(units)]
    luma = np.concatenate([_raster(a, d) + 4 * f for (a, d), f in zip(grids, first[:-1], strict=True)])
    planes = [coef[:, :4].reshape(-1, 64)[luma], coef[:, 4], coef[:, 5]]

    def scan(per_unit: int, made) -> list[bytes]:
        n = units * per_unit
        ends = np.cumsum(n)
        last = np.zeros(ends[-1], bool)
        last[ends - 1] = True
        total, packed = made
        data, at = _intervals(total, packed, last, np.arange(ends[-1]) - np.repeat(ends - n, n))
        at = np.r_[0, at].tolist()
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    bodies = []
    for kind, lo, hi, ah, al in SCANS:
        if kind == "dc":
            header = bytes([3, 1, 0, 2, 0, 3, 0, lo, hi, ah << 4 | al])
            bodies.append((header, scan(1, _dc_refine(coef[:, :, 0]) if ah else _dc_first(coef[:, :, 0], 3))))
            continue
        for c, plane in enumerate(planes):
            header = bytes([1, c + 1, 1 if ah else 0, lo, hi, ah << 4 | al])
            bodies.append((header, scan(1 if c else 4, _ac_refine(plane, lo, hi) if ah else _ac_first(plane, lo, hi, al))))
    common = _segment(DQT, bytes([0]) + bytes([1]) * 64)
    tables = _segment(DHT, b"\x00" + DC_BODY) + _segment(DHT, b"\x10" + AC_BODY) + _segment(DHT, b"\x11" + REFINE_BODY) + _segment(DRI, b"\x00\x01")
    out = []
    for i, (p, (a, d)) in enumerate(zip(payloads, grids, strict=True)):
        frame = _segment(SOF2, struct.pack(">BHHB", 8, 16 * d, 16 * a, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        parts = [bytes([0xFF, SOI]), _segment(COM, b"payload %d" % len(p)), common, frame, tables]
        for header, scans in bodies:
            parts += [_segment(SOS, header), scans[i]]
        out.append(b"".join([*parts, bytes([0xFF, EOI])]))
    return out


@functools.lru_cache(4096)
def _raster(across: int, down: int) -> np.ndarray:
    """For the luma blocks of an image row by row: their number in the order of units."""
    y, x = np.divmod(np.arange(4 * across * down), 2 * across)
    return ((y // 2) * across + x // 2) * 4 + (y % 2) * 2 + x % 2


# Decoder


@dataclass
class _Scan:
    image: int
    components: tuple[int, ...]
    kind: tuple  # lo, hi, ah, al, tables of the components, restart interval
    data: memoryview


@dataclass
class Image:
    height: int = 0
    width: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, quantiser
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""
    base: list[int] = field(default_factory=list)  # a component's first block in the batch
    across: list[int] = field(default_factory=list)  # blocks in a row of a component, padded to whole units
    units: tuple[int, int] = (0, 0)  # across and down


_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")


def _parse(data: bytes, image: int) -> tuple[Image, list[_Scan]]:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    out, scans, tables, restart, at = Image(), [], {}, 0, 2
    view = memoryview(data)
    while data[at + 1] != EOI:
        marker = data[at + 1]
        n = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == DQT:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int64)
                out.quantisers[body[0] & 15], body = values, body[1 + 64 * (1 + wide) :]
        elif marker == DHT:
            while body:
                size = 17 + sum(body[1:17])
                tables[body[0]], body = body[1:size], body[size:]
        elif marker == DRI:
            restart = struct.unpack(">H", body)[0]
        elif marker == COM:
            out.comment = body
        elif marker == SOF2:
            _, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            out.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC0 <= marker <= 0xCF and marker not in (DHT, 0xC8, 0xCC):
            raise ValueError("not a progressive JPEG with Huffman coding")
        elif marker == SOS:
            n = body[0]
            ids = [c[0] for c in out.components]
            which = tuple(ids.index(body[1 + 2 * i]) for i in range(n))
            lo, hi, a = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
            used = tuple(tables.get((body[2 + 2 * i] >> 4) if hi == 0 else 16 | (body[2 + 2 * i] & 15), b"") for i in range(n))
            stop = _MARKER.search(data, at).start()
            shape = tuple(out.components[c][1:3] for c in which) if n > 1 else ()
            scans.append(_Scan(image, which, (lo, hi, a >> 4, a & 15, used, restart, shape), view[at:stop]))
            at = stop
    return out, scans


class _Bits:
    """Entropy-coded data without stuffing and markers, readable at any bit."""

    def __init__(self, parts: list[memoryview]):
        raw = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(p) for p in parts])
        begin = np.cumsum(size) - size
        full = np.flatnonzero(raw == 0xFF)
        follows = raw[np.minimum(full + 1, len(raw) - 1)]
        mark = full[(follows & 0xF8) == 0xD0]
        keep = np.ones(len(raw), bool)
        keep[full[follows == 0] + 1] = False
        keep[mark] = keep[mark + 1] = False
        starts = np.sort(np.r_[begin, mark + 2])
        self.part = np.searchsorted(begin, starts, side="right") - 1  # the scan of each interval
        kept = np.r_[0, np.cumsum(keep)]
        self.starts = kept[starts] * 8
        clean = np.concatenate([raw[keep], np.full(16, 255, np.uint8)])
        self.clean = clean
        self.words = np.ndarray((len(clean) - 7,), ">u8", clean, strides=(1,))
        self.limit = (len(clean) - 9) * 8

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The 57 bits or more from a bit position, leftmost in 64."""
        at = np.minimum(at, self.limit)
        return self.words[at >> 3].astype(U) << (at & 7).astype(U)


def _take(word: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits after the first skip bits."""
    return np.where(n > 0, (word << skip.astype(U)) >> (U(64) - np.maximum(n, 1).astype(U)), U(0)).astype(np.int64)


def _extend(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (raw < (1 << np.maximum(size - 1, 0))), raw - (1 << size) + 1, raw)


def _decode_ac_first(bits: _Bits, at: np.ndarray, wait: np.ndarray, coef: np.ndarray, block: np.ndarray, kind: tuple) -> None:
    """One block of each lane; at and wait (blocks left of an end-of-band run) move on."""
    lo, hi, _, al, tables, *_ = kind
    symbol, length = _lookup(tables[0])
    quick = _lookup_ac(tables[0])
    flat = coef.reshape(-1)
    idle = wait > 0
    wait[idle] -= 1
    lane = np.flatnonzero(~idle)
    pos, base, k = at[lane], block[lane] * 64, np.full(len(lane), lo)
    while len(lane):
        word = bits.peek(pos)
        index = (word >> U(48)).astype(np.int64)
        hit = quick[index]
        if hit.all():
            k += (hit >> 8) & 255
            flat[base + k] = ((hit >> 16) - 2048) << al
            pos += hit & 255
            k += 1
            over = k > hi
        else:
            s, n = symbol[index], length[index]
            if (n == 0).any():
                raise ValueError("broken Huffman code")
            run, size = s >> 4, s & 15
            value = _extend(_take(word, n, size), size)
            ends = (size == 0) & (run < 15)
            k += np.where(ends, 0, run)
            put = np.flatnonzero(size > 0)
            flat[base[put] + k[put]] = value[put] << al
            extra = np.where(ends, run, size)
            rest = np.flatnonzero(ends)
            wait[lane[rest]] = (1 << run[rest]) - 1 + _take(word[rest], n[rest], run[rest])
            pos += n + extra
            k += 1
            over = ends | (k > hi)
        if over.any():
            at[lane[over]] = pos[over]
            stay = ~over
            lane, pos, base, k = lane[stay], pos[stay], base[stay], k[stay]


def _decode_ac_refine(bits: _Bits, at: np.ndarray, wait: np.ndarray, coef: np.ndarray, block: np.ndarray, kind: tuple) -> None:
    lo, hi, _, al, tables, *_ = kind
    symbol, length = _lookup(tables[0])
    width = hi - lo + 1
    band = coef[block, lo : hi + 1]
    known = band != 0
    m = known.sum(axis=1)
    where = np.full(len(block), -1)  # bit of a block's first correction, if they stand together
    idle = wait > 0
    where[idle] = at[idle]
    wait[idle] -= 1
    lane = np.flatnonzero(~idle)
    word = bits.peek(at[lane])
    index = (word >> U(48)).astype(np.int64)
    s, n = symbol[index], length[index]
    run, ends = s >> 4, ((s & 15) == 0) & ((s >> 4) < 15)
    e = lane[ends]
    where[e] = at[e] + n[ends] + run[ends]
    wait[e] = (1 << run[ends]) - 1 + _take(word[ends], n[ends], run[ends])
    at_once = where >= 0
    at[at_once] = where[at_once] + m[at_once]
    rank = np.cumsum(known, axis=1) - 1
    bit = where[:, None] + rank
    for j in np.flatnonzero(~at_once):  # coefficients turn nonzero here: rare, one block at a time
        p, k, old = int(at[j]), 0, known[j]
        while k < width:
            w = int(bits.peek(np.array([p]))[0])
            code = w >> 48
            s, n = int(symbol[code]), int(length[code])
            if not n:
                raise ValueError("broken Huffman code")
            r, size = s >> 4, s & 15
            p += n
            value = 0
            if size:
                value = (1 << al) if (w >> (63 - n)) & 1 else -(1 << al)
                p += 1
            elif r < 15:
                wait[j] = (1 << r) - 1 + (((w << n) & ((1 << 64) - 1)) >> (64 - r) if r else 0)
                p += r
                r = width
            while k < width:
                if old[k]:
                    bit[j, k] = p
                    p += 1
                else:
                    if r == 0:
                        if value:
                            band[j, k] = value
                        k += 1
                        break
                    r -= 1
                k += 1
        at[j] = p
    places = np.minimum(bit[known], len(bits.clean) * 8 - 1)
    on = (bits.clean[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1
    step = on.astype(np.int16) << al
    band[known] += np.where(band[known] > 0, step, -step)
    coef[block, lo : hi + 1] = band


@functools.lru_cache(4096)
def _interleaved(units: tuple[int, int], shape: tuple, base: tuple, across: tuple) -> np.ndarray:
    """The blocks of a scan of several components in coding order, a row a unit."""
    y, x = np.divmod(np.arange(units[0] * units[1]), units[0])
    return np.stack([b + (y * v + dy) * a + x * h + dx for (h, v), b, a in zip(shape, base, across, strict=True) for dy in range(v) for dx in range(h)], axis=1)


def _plane(im: Image, c: int) -> tuple[int, int, int, int]:
    """A component's first block, blocks in a stored row, and blocks across and down that a scan of its own codes."""
    _, h, v, _ = im.components[c]
    most_h, most_v = max(x[1] for x in im.components), max(x[2] for x in im.components)
    return im.base[c], im.across[c], -(-(-(-im.width * h // most_h)) // 8), -(-(-(-im.height * v // most_v)) // 8)


def _decode(scans: list[_Scan], images: list[Image], coef: np.ndarray) -> None:
    """Scans of one kind, together."""
    kind = scans[0].kind
    lo, hi, ah, al, tables, restart, shape = kind
    bits = _Bits([s.data for s in scans])
    if shape:
        per = [_interleaved(im.units, shape, tuple(im.base[c] - im.base[0] for c in x.components), tuple(im.across[c] for c in x.components)) + im.base[0] for x in scans for im in [images[x.image]]]
        blocks, count = np.concatenate(per), np.array([len(p) for p in per])
    else:
        base, across, wide, high = np.array([_plane(images[x.image], x.components[0]) for x in scans]).T
        count = wide * high
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        y, x = np.divmod(place, np.repeat(wide, count))
        blocks = (np.repeat(base, count) + y * np.repeat(across, count) + x)[:, None]
    own = np.arange(len(bits.part)) - np.searchsorted(bits.part, bits.part)  # number of the interval in its scan
    step = restart or int(count.max())
    first = (np.cumsum(count) - count)[bits.part] + own * step
    stop = np.minimum(first + step, np.cumsum(count)[bits.part])
    at, wait = bits.starts.copy(), np.zeros(len(first), np.int64)
    of = [i for i, (h, v) in enumerate(shape) for _ in range(h * v)] if shape else [0]
    previous = np.zeros((len(first), len(set(of))), np.int64)
    for turn in range(step):
        live = np.flatnonzero(first + turn < stop)
        if not len(live):
            break
        unit = blocks[first[live] + turn]
        if lo:
            part, held = at[live], wait[live]
            (_decode_ac_refine if ah else _decode_ac_first)(bits, part, held, coef, unit[:, 0], kind)
            at[live], wait[live] = part, held
            continue
        for j, c in enumerate(of):
            word = bits.peek(at[live])
            if ah:
                coef[unit[:, j], 0] |= ((word >> U(63)).astype(np.int16)) << al
                at[live] += 1
                continue
            symbol, length = _lookup(tables[c])
            index = (word >> U(48)).astype(np.int64)
            size, n = symbol[index], length[index]
            previous[live, c] += _extend(_take(word, n, size), size)
            coef[unit[:, j], 0] = previous[live, c] << al
            at[live] += n + size


def coefficients(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """The images' headers and all coefficients, a row of 64 in zigzag order for each block of each component."""
    images, scans, n = [], [], 0
    for i, f in enumerate(files):
        image, own = _parse(f, i)
        h, v = max(c[1] for c in image.components), max(c[2] for c in image.components)
        image.units = -(-image.width // (8 * h)), -(-image.height // (8 * v))
        for c in image.components:
            image.base.append(n)
            image.across.append(image.units[0] * c[1])
            n += image.units[0] * c[1] * image.units[1] * c[2]
        images.append(image)
        scans.append(own)
    coef = np.zeros((n, 64), np.int16)
    for turn in range(max(map(len, scans), default=0)):  # scans of an image come in order; equal kinds go together
        kinds: dict = {}
        for own in scans:
            if turn < len(own):
                kinds.setdefault(own[turn].kind, []).append(own[turn])
        for group in kinds.values():
            _decode(group, images, coef)
    return images, coef


@functools.cache
def _basis() -> np.ndarray:
    """The inverse transform's matrix, times 2**11, in whole numbers."""
    k, x = np.meshgrid(np.arange(8), np.arange(8))
    m = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    return np.rint(m * 2048)


def pixels(coef: np.ndarray) -> np.ndarray:
    """Blocks of 8 x 8 samples from dequantised coefficients. All sums are whole numbers below 2**53, so exact in any
    order."""
    natural = np.empty((len(coef), 64))
    natural[:, ZIGZAG] = coef
    b = _basis()
    rows = (natural.reshape(-1, 8) @ b.T).reshape(-1, 8, 8)
    both = np.matmul(b, rows)
    return np.clip(np.floor(both * 2.0**-22 + 128.5), 0, 255).astype(np.uint8)


def tiles(image_blocks: np.ndarray) -> np.ndarray:
    """RGB tiles (units, 16, 16, 3) from samples (units, 6 blocks, 8, 8) of 4:2:0 images."""
    n = len(image_blocks)
    y = image_blocks[:, :4].reshape(n, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(n, 16, 16).astype(np.int32) << 16
    cb, cr = (np.repeat(np.repeat(image_blocks[:, c].astype(np.int32) - 128, 2, axis=1), 2, axis=2) for c in (4, 5))
    out = np.empty((n, 16, 16, 3), np.uint8)
    half = 1 << 15
    for i, v in enumerate((y + 91881 * cr + half, y - 22554 * cb - 46802 * cr + half, y + 116130 * cb + half)):
        out[..., i] = np.clip(v >> 16, 0, 255)
    return out


def is_420(image: Image) -> bool:
    return [c[1:3] for c in image.components] == [(2, 2), (1, 1), (1, 1)]


def units_of(image: Image) -> np.ndarray:
    """Rows (units, 6) of block numbers of a 4:2:0 image."""
    across, down = image.units
    n = across * down
    luma = np.empty(4 * n, np.int64)
    luma[_raster(across, down)] = image.base[0] + np.arange(4 * n)
    return np.concatenate([luma.reshape(n, 4), image.base[1] + np.arange(n)[:, None], image.base[2] + np.arange(n)[:, None]], axis=1)


def canvas(image: Image, coef: np.ndarray) -> np.ndarray:
    """RGB of any image of one component (grey) or three (YCbCr), whatever their sampling, padded to whole units: each plane is
    put together from its blocks and repeated to full resolution."""
    if len(image.components) not in (1, 3):
        raise ValueError(f"{len(image.components)} components are neither grey nor YCbCr")
    most_h, most_v = max(c[1] for c in image.components), max(c[2] for c in image.components)
    y, x = np.arange(8 * most_v * image.units[1]), np.arange(8 * most_h * image.units[0])
    planes = []
    for (_, h, v, q), base in zip(image.components, image.base, strict=True):
        across, down = image.units[0] * h, image.units[1] * v
        blocks = pixels(coef[base : base + across * down] * image.quantisers[q])
        plane = blocks.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * down, 8 * across)
        planes.append(plane[(y * v // most_v)[:, None], x * h // most_h].astype(np.int32))
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[..., None], 3, axis=2)
    luma, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
    half = 1 << 15
    return np.stack([np.clip(v >> 16, 0, 255) for v in (luma + 91881 * cr + half, luma - 22554 * cb - 46802 * cr + half, luma + 116130 * cb + half)], axis=2).astype(np.uint8)


def tensor(image: Image, own: np.ndarray) -> np.ndarray:
    """The full-resolution (height, width, 3) tensor from an image's tiles or canvas."""
    across, down = image.units
    whole = own.reshape(down, across, 16, 16, 3).transpose(0, 2, 1, 3, 4).reshape(16 * down, 16 * across, 3) if own.ndim == 4 else own
    return whole[: image.height, : image.width]


def decode(files: list[bytes]) -> list[tuple[Image, bytes, np.ndarray]]:
    """For each file: its header, the payload that encode() stored (empty for other files), and its RGB: tiles, if it is 4:2:0, or
    a canvas."""
    images, coef = coefficients(files)
    plain = [im for im in images if is_420(im)]
    units = [units_of(im) for im in plain]
    order = np.concatenate(units) if units else np.empty((0, 6), np.int64)
    blocks = coef[order.ravel()]
    samples = np.empty((len(blocks), 8, 8), np.uint8)
    scaled = any((q != 1).any() for im in plain for q in im.quantisers.values())
    scale = np.concatenate([np.repeat([[im.quantisers[c[3]] for c in im.components]], len(u), axis=0) for im, u in zip(plain, units, strict=True)])[:, [0, 0, 0, 0, 1, 2]].reshape(-1, 64) if scaled else None
    for i in range(0, len(blocks), 6 << 10):
        part = blocks[i : i + (6 << 10)]
        samples[i : i + len(part)] = pixels(part if scale is None else part * scale[i : i + len(part)])
    rgb = tiles(samples.reshape(-1, 6, 8, 8))
    out, at, left = [], 0, iter(units)
    for im in images:
        if not is_420(im):
            out.append((im, b"", canvas(im, coef)))
            continue
        n = len(next(left))
        stored = re.fullmatch(rb"payload (\d+)", im.comment)
        out.append((im, blocks[6 * at : 6 * (at + n)].astype(np.int8).tobytes()[: int(stored[1]) if stored else 0], rgb[at : at + n]))
        at += n
    return out
