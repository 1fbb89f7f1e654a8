"""The JPEG codec: round trips, a scalar decoder, and features."""

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import jpeg, media
from tessera.llm.queries import QUERIES


def scalar_coefficients(data):
    """A plain decoder, bit by bit, for the files of the encoder."""
    images, scans = jpeg._parse(data, 0)
    across, down = images.width // 16, images.height // 16
    planes = [np.zeros((2 * down * 2 * across, 64), int), np.zeros((down * across, 64), int), np.zeros((down * across, 64), int)]

    def codes(body):
        out, code, at = {}, 0, 16
        for n in range(1, 17):
            for _ in range(body[n - 1]):
                out[(n, code)] = body[at]
                code, at = code + 1, at + 1
            code <<= 1
        return out

    for s in scans:
        lo, hi, ah, al, tables, restart, shape = s.kind
        raw, parts, i = bytes(s.data), [bytearray()], 0
        while i < len(raw):
            if raw[i] == 0xFF and raw[i + 1] == 0:
                parts[-1].append(0xFF)
                i += 2
            elif raw[i] == 0xFF:
                parts.append(bytearray())
                i += 2
            else:
                parts[-1].append(raw[i])
                i += 1
        books = [codes(t) for t in tables if t]
        for u, part in enumerate(parts):
            bits = iter("".join(f"{b:08b}" for b in part))
            read = lambda n: int("".join(next(bits) for _ in range(n)) or "0", 2)

            def symbol(book):
                code = n = 0
                while True:
                    code, n = code << 1 | read(1), n + 1
                    if (n, code) in book:
                        return book[(n, code)]

            def number(size):
                v = read(size)
                return v if not size or v >> (size - 1) else v - (1 << size) + 1

            if shape:
                y, x = divmod(u, across)
                where = [(0, (2 * y + a) * 2 * across + 2 * x + b) for a in (0, 1) for b in (0, 1)] + [(1, u), (2, u)]
                previous = [0, 0, 0]
                for c, b in where:
                    if ah:
                        planes[c][b, 0] |= read(1) << al
                    else:
                        previous[c] += number(symbol(books[min(c, len(books) - 1)]))
                        planes[c][b, 0] = previous[c] << al
                continue
            block, k = planes[s.components[0]][u], lo
            while k <= hi:
                v = symbol(books[0])
                r, size = v >> 4, v & 15
                if not ah:
                    if not size and r < 15:
                        break
                    k += r
                    if size:
                        block[k] = number(size) * (1 << al)
                    k += 1
                    continue
                value = (1 if read(1) else -1) << al if size else 0
                r = 99 if not size and r < 15 else r
                while k <= hi:
                    if block[k]:
                        if read(1):
                            block[k] += (1 if block[k] > 0 else -1) << al
                    elif r == 0:
                        block[k] = value
                        k += 1
                        break
                    else:
                        r -= 1
                    k += 1
    return np.concatenate(planes)


SAMPLES = [bytes(64), bytes(range(64)), b"\x01" * 128, b"\x01\x00" * 64, b"\xff" * 64, bytes([128]) * 640, b"hello world " * 64, bytes([1] + [0] * 40 + [1] + [0] * 20 + [3, 1]), bytes([0] * 60 + [200, 1, 0, 0])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=1500), min_size=1, max_size=6))
def test_round_trip(texts):
    payloads = [media.payload(t) for t in texts]
    assert [p for _, p, _ in jpeg.decode(jpeg.encode(payloads))] == payloads


def test_scalar_decoder():
    rng = np.random.default_rng(3)
    sparse = [(rng.integers(0, 4, 64 * 9) * (rng.random(64 * 9) < 0.2)).astype(np.uint8).tobytes() for _ in range(4)]
    for p in SAMPLES + sparse:
        data = jpeg.encode([p])[0]
        assert (jpeg.coefficients([data])[1] == scalar_coefficients(data)).all()


def test_batches_do_not_matter():
    together = jpeg.encode(SAMPLES)
    assert together == [jpeg.encode([p])[0] for p in SAMPLES]
    for (image, _, tiles), f in zip(jpeg.decode(together), together, strict=True):
        assert media.feature(image, tiles) == media.feature(*[x for i, x in enumerate(jpeg.decode([f])[0]) if i != 1])


def test_pixels():
    """Against the defining sum of the inverse transform."""
    rng = np.random.default_rng(1)
    coef = rng.integers(-60, 60, (5, 64))
    got = jpeg.pixels(coef)
    for b in range(5):
        natural = np.zeros(64)
        natural[jpeg.ZIGZAG] = coef[b]
        f = natural.reshape(8, 8)
        for y in range(8):
            for x in range(8):
                total = sum(f[v, u] * (0.5**0.5 if v == 0 else 1) * (0.5**0.5 if u == 0 else 1) * np.cos((2 * y + 1) * v * np.pi / 16) * np.cos((2 * x + 1) * u * np.pi / 16) for v in range(8) for u in range(8)) / 4
                assert abs(int(got[b, y, x]) - min(255, max(0, total + 128))) <= 1


def test_zigzag():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64))


@pytest.mark.parametrize("which", ["hard", "small"])
def test_query(spark, hard_dir, sf, which):
    d = hard_dir if which == "hard" else sf
    texts = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op1_media"](spark, d).collect()
    want = []
    for r in texts:
        raw = (r["text"] or "").encode()
        p = media.payload(raw)
        f = jpeg.encode([p])[0]
        image, _, tiles = jpeg.decode([f])[0]
        want.append((r["doc_id"], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(f), hashlib.sha256(f).hexdigest(), media.feature(image, tiles)))
    assert Counter(map(tuple, got)) == Counter(want)


def test_tensors(spark, hard):
    rows = media.tensors(media.store(hard.select("text"))).limit(5).collect()
    for r in rows:
        t = r["tensor"]
        assert len(t["data"]) == t["height"] * t["width"] * 3 == t["height"] * t["width"] * t["channels"]


def plain_rgb(data):
    """RGB by the book: the scalar decoder's coefficients, the cosine sum, chroma repeated, the float matrix of JFIF."""
    image, _ = jpeg._parse(data, 0)
    across, down = image.width // 16, image.height // 16
    coef, planes, at = scalar_coefficients(data), [], 0
    k = np.arange(8)
    basis = np.where(k == 0, 0.125**0.5, 0.5)[:, None] * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    for h in (2, 1, 1):
        n = across * h * down * h
        plane = np.zeros((8 * down * h, 8 * across * h))
        for i in range(n):
            natural = np.zeros(64)
            natural[jpeg.ZIGZAG] = coef[at + i]
            y, x = divmod(i, across * h)
            plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = basis.T @ natural.reshape(8, 8) @ basis + 128
        planes.append(np.clip(np.kron(plane, np.ones((2 // h, 2 // h))), 0, 255))
        at += n
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2), 0, 255)


def test_colours(spark):
    """Tensors and features against the book, colour and chroma included."""
    texts = ["hello colourful world " * 30, "\u00e9\u00fc" * 200, "", "x" * 64 * 24]
    rows = media.tensors(media.store(spark.createDataFrame(list(enumerate(texts)), "i long, text string"))).collect()
    for r in rows:
        want = plain_rgb(r["media"])
        got = np.frombuffer(r["tensor"]["data"], np.uint8).reshape(r["tensor"]["height"], r["tensor"]["width"], 3)
        assert got.shape == want.shape and np.abs(got.astype(float) - want).max() <= 2.5
        image, _, tiles = jpeg.decode([r["media"]])[0]
        size, numbers = media.feature(image, tiles).split(";")
        mean = [float(x) for x in numbers.split(",")]
        assert size == f"{want.shape[1]}x{want.shape[0]}" and np.abs(np.array(mean[:3]) - want.mean(axis=(0, 1))).max() < 1 and np.abs(np.array(mean[3:]) - want.std(axis=(0, 1))).max() < 1.5


def flat(levels, sampling):
    """A progressive JPEG of flat blocks: levels[c] are a component's DC values, block by block, under a quantiser of 8."""
    seg = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    width, height = 8 * most_h * 2, 8 * most_v
    out = b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([8] * 64)) + seg(0xC2, struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling)))
    out += seg(0xC4, bytes([0, 0, 0, 0, 12] + [0] * 12 + list(range(12))))
    for c, values in enumerate(levels):
        bits, last = "", 0
        for v in values:
            d, last = v - last, v
            size = abs(d).bit_length()
            bits += f"{size:04b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "")
        raw = int(bits + "1" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")
        out += seg(0xDA, bytes([1, c + 1, 0, 0, 0, 0])) + raw.replace(b"\xff", b"\xff\x00")
    return out + b"\xff\xd9", width, height


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 1), (1, 1), (1, 1)]], ids=["grey", "444", "422"])
def test_other_samplings(sampling):
    """Grey, full and halved chroma, beside files of the encoder in one batch."""
    levels = [[5 * (c + 1) + 7 * i for i in range(2 * max(h for h, _ in sampling) // max(h for h, _ in sampling) * h)] for c, (h, _) in enumerate(sampling)]
    data, width, height = flat(levels, sampling)
    own = jpeg.encode([b"beside" + bytes(58)])[0]
    (image, payload, rgb), (_, kept, _) = jpeg.decode([data, own])
    assert kept == b"beside" + bytes(58) and payload == b""
    got = jpeg.tensor(image, rgb)
    assert got.shape == (height, width, 3)
    y = np.repeat([v + 128 for v in levels[0]], width // len(levels[0]))
    cb, cr = ([0.0] * width, [0.0] * width) if len(levels) == 1 else (np.repeat(levels[c], width // len(levels[c])) for c in (1, 2))
    want = np.stack([y + 1.402 * np.array(cr), y - 0.344136 * np.array(cb) - 0.714136 * np.array(cr), y + 1.772 * np.array(cb)], axis=1)
    assert np.abs(got.astype(float) - np.clip(want, 0, 255)[None]).max() <= 1.5
