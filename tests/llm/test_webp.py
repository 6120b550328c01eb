"""The general path of the WebP decoder, on streams built here by the format's definition."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.llm import media, webp
from tests.conftest import SF

RNG = np.random.default_rng(11)


def image(w, argb, top):
    """An entropy-coded image (rows of a, r, g, b) with eight-bit codes."""
    w.put(0, 2 if top else 1)
    for n in (280, 256, 256, 256):
        webp.write_code(w, [8] * 256 + [0] * (n - 256))
    webp.write_code(w, [1] + [0] * 39)
    codes = webp.codes_of([8] * 256)
    for a, r, g, b in np.asarray(argb).reshape(-1, 4).tolist():
        for v in (g, r, b, a):
            w.put(*codes[v])


def decoded(w):
    """Alone, pixel by pixel, and among others, a pixel of each at a step."""
    file = webp._riff(w.bytes())
    px = webp.decode(file)
    others = webp.encode_many([RNG.integers(0, 256, size=(n, 16, 4), dtype=np.uint8) for n in range(1, 9)])
    assert (webp.decode_many([*others, file, file])[-2:] == px).all()
    return px[..., [3, 0, 1, 2]].astype(int)


def predicted(px, y, x, mode):
    if y == 0:
        return px[0, x - 1] if x else np.array([255, 0, 0, 0])
    if x == 0:
        return px[y - 1, 0]
    left, t, tl = px[y, x - 1], px[y - 1, x], px[y - 1, x - 1]
    tr = px[y - 1, x + 1] if x + 1 < px.shape[1] else px[y, 0]
    if mode == 11:
        return left if np.abs(t - tl).sum() < np.abs(left - tl).sum() else t
    half = (left + t) // 2
    return [
        np.array([255, 0, 0, 0]), left, t, tr, tl, ((left + tr) // 2 + t) // 2, (left + tl) // 2, half, (tl + t) // 2, (t + tr) // 2,
        ((left + tl) // 2 + (t + tr) // 2) // 2, None, np.clip(left + t - tl, 0, 255), np.clip(half + np.trunc((half - tl) / 2).astype(int), 0, 255),
    ][mode]


def test_predictor():
    px = RNG.integers(0, 256, size=(9, 27, 4))
    modes = np.arange(21).reshape(3, 7) % 14
    w = webp._head(27, 9)
    w.put(1, 1), w.put(0, 2), w.put(0, 3)
    image(w, np.stack([modes * 0, modes * 0, modes, modes * 0], axis=-1), False)
    w.put(0, 1)
    image(w, [[(px[y, x] - predicted(px, y, x, modes[y // 4, x // 4])) & 255 for x in range(27)] for y in range(9)], True)
    assert (decoded(w) == px).all()


def test_cross_colour():
    px, by = RNG.integers(0, 256, size=(9, 27, 4)), RNG.integers(0, 256, size=(3, 7, 4))
    f = np.repeat(np.repeat(by, 4, axis=0), 4, axis=1)[:9, :27].astype(np.int8).astype(int)
    r, g, b = (px[..., k].astype(np.int8).astype(int) for k in (1, 2, 3))
    coded = px.copy()
    coded[..., 1] = (r - ((f[..., 3] * g) >> 5)) & 255
    coded[..., 3] = (b - ((f[..., 2] * g) >> 5) - ((f[..., 1] * r) >> 5)) & 255
    w = webp._head(27, 9)
    w.put(1, 1), w.put(1, 2), w.put(0, 3)
    image(w, by, False)
    w.put(0, 1)
    image(w, coded, True)
    assert (decoded(w) == px).all()


@pytest.mark.parametrize(("colours", "bits"), [(2, 3), (4, 2), (9, 1), (40, 0)])
def test_palette(colours, bits):
    palette, index = RNG.integers(0, 256, size=(colours, 4)), RNG.integers(0, colours, size=(5, 27))
    per = 1 << bits
    wide = np.pad(index, ((0, 0), (0, -27 % per))).reshape(5, -1, per)
    green = (wide << (np.arange(per) * (8 // per))).sum(axis=2)
    w = webp._head(27, 5)
    w.put(1, 1), w.put(3, 2), w.put(colours - 1, 8)
    image(w, np.diff(palette, axis=0, prepend=0) & 255, False)
    w.put(0, 1)
    image(w, np.stack([green * 0, green * 0, green, green * 0], axis=-1), True)
    assert (decoded(w) == palette[index]).all()


def direct(argb, width, cache_bits, groups, meta, ops, w):
    """Writes operations (literal, ("copy", length, code) or ("cache", place)) with codes of equal lengths, by the group of the pixel's tile."""
    w.put(1, 1), w.put(cache_bits, 4)
    w.put(1, 1), w.put(0, 3)
    image(w, np.stack([meta * 0, meta * 0, meta, meta * 0], axis=-1), False)
    # each group has codes of its own: the second has the samples in other lengths
    size = 280 + (1 << cache_bits)
    codes = []
    for g in range(groups):
        lengths = [[9] * (2 * size - 512) + [8] * (512 - size) if g else [8] * (512 - size) + [9] * (2 * size - 512), *[[8] * 256] * 3, [5] * 24 + [6] * 16]
        assert sum(2.0**-n for n in lengths[0]) == 1.0 == sum(2.0**-n for n in lengths[4])
        for n in lengths:
            webp.write_code(w, n)
        codes.append([webp.codes_of(n) for n in lengths])
    at = 0
    for op in ops:
        c = codes[meta[(at // width) // 4, (at % width) // 4]]
        if op[0] == "copy":
            for v, code, base in ((op[1], c[0], 256), (op[2], c[4], 0)):
                (s,), (extra,), (k,) = webp._symbols(np.array([v]))
                w.put(*code[base + int(s)]), w.put(int(extra), int(k))
            at += op[1]
        elif op[0] == "cache":
            w.put(*c[0][280 + op[1]])
            at += 1
        else:
            a, r, g, b = op
            for k, v in enumerate((g, r, b, a)):
                w.put(*c[k][v])
            at += 1


def test_cache_back_references_and_meta_codes():
    width, height, bits = 20, 9, 3
    meta = np.arange(15).reshape(3, 5) % 2
    place = lambda p: (0x1E35A7BD * (p[0] << 24 | p[1] << 16 | p[2] << 8 | p[3]) & 0xFFFFFFFF) >> (32 - bits)
    near = {1: (0, 1), 2: (1, 0), 4: (-1, 1), 8: (-1, 2), 10: (-2, 1), 120: (8, 7)}
    px, ops, cache = [], [], {}

    def add(p):
        px.append(p)
        cache[place(p)] = p

    while len(px) < width * height:
        kind, left = RNG.integers(0, 5), width * height - len(px)
        if kind == 0 and cache:
            k = list(cache)[RNG.integers(0, len(cache))]
            ops.append(("cache", k))
            add(cache[k])
        elif kind == 1 and len(px) > 3:
            code = int(RNG.choice([*near, 121, 123]))
            x, y = near.get(code, (code - 120, 0))
            d = max(1, x + y * width)
            if d <= len(px):
                n = int(min(left, RNG.integers(1, 30)))
                ops.append(("copy", n, code))
                for _ in range(n):
                    add(px[-d])
        else:
            p = tuple(int(v) for v in RNG.integers(0, 256, size=4))
            ops.append(p)
            add(p)
    w = webp._head(width, height)
    w.put(0, 1)
    direct(px, width, bits, 2, meta, ops, w)
    assert (decoded(w).reshape(-1, 4) == np.array(px)).all()


PAYLOADS = [b"", b"abcd" * 400, bytes(range(256)) * 5 + b"wxyz1234" * 50, RNG.integers(0, 256, size=5000, dtype=np.uint8).tobytes(), RNG.integers(97, 101, size=9000, dtype=np.uint8).tobytes(), b"line of text\n" * 3000, b"\0" * 640, b"\0\0\0\1" * 700 + b"\0\0\0\2" * 30]


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_payloads_come_back(most, monkeypatch):
    monkeypatch.setattr(webp, "GROUP_PIXELS", most)
    payloads = [webp.padded(p) for p in PAYLOADS * 2]
    stored = webp.store_many(payloads)
    got = [b"".join(x.tobytes() for x in found) for found in webp.images_many(stored)]
    assert got == payloads and stored[: len(PAYLOADS)] == stored[len(PAYLOADS) :]
    assert len(webp.files_of(stored[3])) == 1 and len(webp.files_of(stored[5])) == 5


def test_cut_files_raise():
    (stored,) = webp.store_many([webp.padded(bytes(range(256)) * 9)])
    for n in (3, 11, 19, 60, len(stored) - 1):
        with pytest.raises(ValueError):
            webp.images_many([stored[:n]])
    short = stored[20:-300]  # a whole file around a stream that ends early
    for files in ([webp._riff(short)], [webp._riff(short)] * 9):
        with pytest.raises(ValueError):
            webp.decode_many(files)
    with pytest.raises(ValueError):
        webp.decode(b"RIFF\4\0\0\0WEBP")


def test_code_lengths_are_limited_and_optimal():
    counts = [1, 1]
    while len(counts) < 30:
        counts.append(counts[-1] + counts[-2])
    for limit in (7, 12, 15):
        n = webp.code_lengths(counts, limit)
        assert max(n) <= limit and sum(2.0**-k for k in n) == 1.0
    rows = np.array([RNG.integers(0, n, size=40) * (RNG.random(40) < p) for n in (1, 2, 9, 10_000) for p in (0, 0.03, 0.1, 0.5, 1)] + [counts + [0] * 10])
    for row, many in zip(rows.tolist(), webp.many_code_lengths(rows, 7).tolist(), strict=True):
        alone = webp.code_lengths(row, 7)
        assert sum(c * n for c, n in zip(row, many, strict=True)) == sum(c * n for c, n in zip(row, alone, strict=True)) and max(many) <= 7
        assert [n > 0 for n in many] == [c > 0 for c in row]
    assert sum(c * k for c, k in zip([5, 9, 12, 13, 16, 45], webp.code_lengths([5, 9, 12, 13, 16, 45]), strict=True)) == 224


def test_query_uses_the_format(spark):
    rows = media.op7_webp_media(spark, SF).collect()
    assert sum(r.media_bytes for r in rows) < 0.8 * sum(r.payload_bytes for r in rows)
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        payload = webp.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    stored = [bytes(r.media) for r in media.to_media(spark.read.parquet(f"{SF}/documents.parquet")).collect()]
    steps, kinds = [], Counter()
    for f in (f for m in stored for f in webp.files_of(m)):
        s = webp.opened(webp._lossless(f))
        steps.append([x[0] for x in s.steps])
        kinds["cache"] += s.image.cache_bits > 0
        kinds["back"] += bool(len(webp._matches(np.concatenate([webp.decode(f).reshape(-1, 4).astype(np.int64) @ (1, 256, 65536, 1 << 24)]), np.zeros(s.width * s.height, dtype=np.int64))[0]))
    assert all(x in ([2], [3]) for x in steps) and [2] in steps and kinds["cache"] == len(steps) and kinds["back"] > 0.5 * len(steps)


def test_media_edge_cases(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "no id"), (4, "word, " * 9000), (5, "日本語")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash")).withColumn("n_bytes", F.lit(0))
    got = media.digests(media.to_media(df)).toPandas()
    assert len(got) == 6 and got.loc[got["doc_id"].isin([1, 2]), "payload_sha256"].nunique() == 1
    assert media.digests(media.to_media(df.limit(0))).count() == 0
    pixels = media.to_pixels(media.to_media(df)).where("doc_id = 4").collect()
    assert len(pixels) > 1 and b"".join(bytes(r.pixels) for r in pixels) == webp.padded(rows[4][1].encode())
