"""Lossless WebP (VP8L): a decoder of the whole format and an encoder for byte payloads.

The decoder reads prefix codes (simple and normal), meta prefix images, back-references, the colour cache, and undoes
the predictor, cross-colour, subtract-green and palette transforms. Pixels are (height, width, 4) arrays of
uint8 in the order red, green, blue, alpha. Images of at most STEP_PIXELS pixels are decoded together, a pixel of each at a
step, so that a step is a few array operations for all of them; larger ones and small groups are decoded pixel by pixel.

The encoder writes a payload as 8-bit samples, four to a pixel, 16 pixels to a row. An image with few colours gets a palette,
any other has green subtracted; both get a colour cache, back-references and code lengths fitted to the samples' counts.

Payloads over MOST_ROWS rows become several files in a row; each file's header tells its length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

ROW_BYTES, MOST_ROWS = 64, 128
#: Images that are decoded together: of at most so many pixels each, at least so many images, about so many pixels in all.
STEP_PIXELS, STEP_IMAGES, GROUP_PIXELS = 16_384, 8, 1 << 20
#: Fixed values of the format.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
SIGNATURE, CACHE_MULTIPLIER = 0x2F, 0x1E35A7BD
MOST_COLOURS = 256
#: What the encoder writes: bits of the colour cache, the longest code, the shortest back-reference.
CACHE_BITS, LONGEST_CODE, LEAST_MATCH = 6, 12, 3
GREEN, RED, BLUE, ALPHA, DISTANCE = range(5)


def _reversed_bits(n: int) -> np.ndarray:
    """The numbers below 2 ** n with their n bits in reverse."""
    out = np.zeros(1, dtype=np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


_REVERSED = [_reversed_bits(n) for n in range(17)]
_REVERSED_LISTS = [x.tolist() for x in _REVERSED]


class BitReader:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bits(self, n: int) -> int:
        if n == 0:
            return 0
        start, shift = self.at >> 3, self.at & 7
        self.at += n
        return (int.from_bytes(self.data[start : start + 8], "little") >> shift) & ((1 << n) - 1)


class PrefixCode:
    """A canonical code as a lookup table by the next `width` bits: 16 times the symbol plus its length."""

    def __init__(self, lengths: list[int] | np.ndarray):
        lengths = np.asarray(lengths)
        used = np.flatnonzero(lengths)
        if len(used) < 2:
            self.width, self.table = 0, np.array([16 * int(used[0]) if len(used) else 0])
        else:
            own = lengths[used]
            self.width = int(own.max())
            order = np.argsort(own, kind="stable")
            table = np.repeat(16 * used[order] + own[order], 1 << (self.width - own[order]))
            if len(table) != 1 << self.width:
                raise ValueError("WebP: a prefix code is not complete")
            self.table = table[_REVERSED[self.width]]
        self.mask, self._list = (1 << self.width) - 1, None

    def read(self, r: BitReader) -> int:
        if self._list is None:
            self._list = self.table.tolist()
        start = r.at >> 3
        e = self._list[(int.from_bytes(r.data[start : start + 4], "little") >> (r.at & 7)) & self.mask]
        r.at += e & 15
        return e >> 4


def _small_table(lengths: list[int]) -> list[int]:
    """PrefixCode's table for few symbols."""
    codes = codes_of(lengths)
    width = max((n for _, n in codes.values()), default=0)
    table = [0] * (1 << width)
    for s, (bits, n) in codes.items():
        table[bits :: 1 << n] = [16 * s + n] * (1 << (width - n))
    if len(codes) > 1 and sum(1 << (width - n) for _, n in codes.values()) != 1 << width:
        raise ValueError("WebP: a prefix code is not complete")
    return table


def read_code(r: BitReader, size: int) -> PrefixCode:
    if r.bits(1):  # one or two symbols
        two = r.bits(1)
        lengths = [0] * max(size, 256)
        lengths[r.bits(8 if r.bits(1) else 1)] = 1
        if two:
            lengths[r.bits(8)] = 1
        return PrefixCode(lengths)
    first = [0] * 19
    for k in range(4 + r.bits(4)):
        first[CODE_ORDER[k]] = r.bits(3)
    table = _small_table(first)
    left = size
    if r.bits(1):
        left = 2 + r.bits(2 + 2 * r.bits(3))
    lengths, last = [], 8
    mask, data, at, held, n = len(table) - 1, r.data, r.at, 0, 0
    while len(lengths) < size and left > 0:
        left -= 1
        if n < 14:  # a symbol and its extra bits
            held, n = int.from_bytes(data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7), 64 - (at & 7)
        e = table[held & mask]
        s, k = e >> 4, e & 15
        held >>= k
        if s < 16:
            lengths.append(s)
            last = s or last
        else:
            base, more = ((3, 2), (3, 3), (11, 7))[s - 16]
            lengths += [last if s == 16 else 0] * (base + (held & ((1 << more) - 1)))
            held >>= more
            k += more
        at += k
        n -= k
    r.at = at
    if len(lengths) > size:
        raise ValueError("WebP: code lengths run over")
    return PrefixCode(lengths)


def _number(symbol: int, r: BitReader) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.bits(extra) + 1


_NUMBER_BASE = np.array([s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + 1 for s in range(40)])
_NUMBER_EXTRA = np.array([0 if s < 4 else (s - 2) >> 1 for s in range(40)])


def _near(width: int) -> np.ndarray:
    """The pixel distances of the short distance codes in an image of this width; code 0 is none."""
    return np.array([1, *[max(1, x + y * width) for x, y in NEAR]])


@dataclass
class Entropy:
    """An entropy-coded image: all but its pixels, and where their bits start."""

    width: int
    height: int
    cache_bits: int
    codes: list[list[PrefixCode]]
    meta: np.ndarray | None
    meta_bits: int

    @property
    def n(self) -> int:
        return self.width * self.height


def _entropy(r: BitReader, width: int, height: int, top: bool) -> Entropy:
    cache_bits = r.bits(4) if r.bits(1) else 0
    groups, meta, meta_bits = 1, None, 0
    if top and r.bits(1):
        meta_bits = r.bits(3) + 2
        w = (width + (1 << meta_bits) - 1) >> meta_bits
        meta = ((_samples(r, w, (height + (1 << meta_bits) - 1) >> meta_bits) >> 8) & 0xFFFF).astype(np.int64).reshape(-1, w)
        groups = int(meta.max()) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    return Entropy(width, height, cache_bits, [[read_code(r, n) for n in sizes] for _ in range(groups)], meta, meta_bits)


def _samples(r: BitReader, width: int, height: int) -> np.ndarray:
    """ARGB values, as uint32, of an image that is part of a header."""
    return _one(r, _entropy(r, width, height, False))


def _one(r: BitReader, e: Entropy) -> np.ndarray:
    """The pixels of one image, in order."""
    n, width, cache_bits, near = e.n, e.width, e.cache_bits, _near(e.width).tolist()
    out = np.zeros(n, dtype=np.uint32)
    cache, shift, at, end = [0] * (1 << cache_bits), 32 - cache_bits, 0, 8 * len(r.data)
    while at < n:
        if r.at > end:
            raise ValueError("WebP: the pixels end early")
        c = e.codes[0] if e.meta is None else e.codes[int(e.meta[(at // width) >> e.meta_bits, (at % width) >> e.meta_bits])]
        s = c[GREEN].read(r)
        if s < 256:
            red, blue, alpha = c[RED].read(r), c[BLUE].read(r), c[ALPHA].read(r)
            argb = alpha << 24 | red << 16 | s << 8 | blue
            out[at] = argb
            at += 1
            if cache_bits:
                cache[(CACHE_MULTIPLIER * argb & 0xFFFFFFFF) >> shift] = argb
        elif s < 280:
            length = _number(s - 256, r)
            d = _number(c[DISTANCE].read(r), r)
            d = d - 120 if d > 120 else near[d]
            if d > at or length > n - at:
                raise ValueError("WebP: a back-reference leaves the image")
            while length > 0:
                step = min(d, length)
                out[at : at + step] = out[at - d : at - d + step]
                if cache_bits:
                    for v in out[at : at + step].tolist():
                        cache[(CACHE_MULTIPLIER * v & 0xFFFFFFFF) >> shift] = v
                at, length = at + step, length - step
        else:
            argb = cache[s - 280]
            out[at] = argb
            at += 1
    return out


def _together(readers: list[BitReader], images: list[Entropy]) -> list[np.ndarray]:
    """The pixels of many images, one of each at a step. Images that are not over yet come first in all arrays."""
    order = np.argsort([-e.n for e in images], kind="stable")
    images, readers = [images[k] for k in order], [readers[k] for k in order]
    n = np.array([e.n for e in images])
    steps = int(n[0])
    parts, starts, at = [], [], 0
    for r in readers:
        starts.append(8 * at)
        parts.append(r.data)
        at += len(r.data)
    start = np.array(starts)
    end = start + np.array([8 * len(r.data) for r in readers])
    data = b"".join([*parts, b"\0" * (8 * steps + 64)])  # no code takes more than 64 bits a pixel
    view = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    pos = start + np.array([r.at for r in readers])
    # one table of all codes; base and mask of each code of each group
    codes = [c for e in images for g in e.codes for c in g]
    table = np.concatenate([c.table for c in codes])
    base = np.concatenate([[0], np.cumsum([len(c.table) for c in codes])[:-1]]).reshape(-1, 5).T.copy()
    mask = np.array([c.mask for c in codes], dtype=np.uint64).reshape(-1, 5).T.copy()
    group = np.concatenate([[0], np.cumsum([len(e.codes) for e in images])[:-1]])
    with_meta = [k for k, e in enumerate(images) if e.meta is not None]
    bases, masks = base[:, group], mask[:, group]
    near = {w: _near(w) for w in {e.width for e in images}}
    near = np.stack([near[e.width] for e in images])
    shift = np.array([32 - e.cache_bits for e in images], dtype=np.uint64)
    place = np.concatenate([[0], np.cumsum([1 << e.cache_bits for e in images])[:-1]])
    cache = np.zeros(sum(1 << e.cache_bits for e in images), dtype=np.uint32)
    left, away = np.zeros(len(n), dtype=np.int64), np.ones(len(n), dtype=np.int64)
    out = np.zeros((steps, len(n)), dtype=np.uint32)
    live = np.searchsorted(-n, -np.arange(steps), side="left")
    seven, low = np.int64(7), np.uint64(0xFFFFFFFF)

    def window(bits: np.ndarray) -> np.ndarray:
        return view[bits >> 3] >> (bits & seven).astype(np.uint64)

    def read(code: int, which: np.ndarray, w: np.ndarray) -> np.ndarray:
        return table.take(bases[code].take(which) + (w & masks[code].take(which)).astype(np.int64))

    for t, k in enumerate(live.tolist()):
        for i in with_meta:
            if i < k:
                e = images[i]
                g = group[i] + e.meta[(t // e.width) >> e.meta_bits, (t % e.width) >> e.meta_bits]
                bases[:, i], masks[:, i] = base[:, g], mask[:, g]
        row = out[t, :k]
        new = np.flatnonzero(left[:k] == 0)
        if len(new):
            p = pos.take(new)
            w = window(p)
            e = read(GREEN, new, w)
            s, used = e >> 4, e & 15
            lit = np.flatnonzero(s < 256)
            if len(lit):
                which, w, bits = new.take(lit), w.take(lit), used.take(lit)
                w >>= bits.astype(np.uint64)
                red = read(RED, which, w)
                bits += red & 15
                w = window(p.take(lit) + bits)
                blue = read(BLUE, which, w)
                w >>= (blue & 15).astype(np.uint64)
                alpha = read(ALPHA, which, w)
                row[which] = (alpha >> 4) << 24 | (red >> 4) << 16 | s.take(lit) << 8 | blue >> 4
                used[lit] = bits + (blue & 15) + (alpha & 15)
            if len(lit) < len(new):
                kept = np.flatnonzero(s >= 280)
                which = new.take(kept)
                row[which] = cache.take(place.take(which) + s.take(kept) - 280)
                back = np.flatnonzero((s >= 256) & (s < 280))
                if len(back):
                    which, b = new.take(back), p.take(back) + used.take(back)
                    values = []
                    for symbol in (s.take(back) - 256, None):
                        if symbol is None:
                            e = read(DISTANCE, which, window(b))
                            symbol = e >> 4
                            b += e & 15
                        extra = _NUMBER_EXTRA[symbol]
                        values.append(_NUMBER_BASE[symbol] + (window(b) & ((np.uint64(1) << extra.astype(np.uint64)) - np.uint64(1))).astype(np.int64))
                        b += extra
                    length, d = values
                    d = np.where(d > 120, d - 120, near[which, np.minimum(d, 120)])
                    if (d > t).any() or (length > n[which] - t).any():
                        raise ValueError("WebP: a back-reference leaves the image")
                    left[which], away[which] = length, d
                    used[back] = b - p.take(back)
            pos[new] = p + used
        copied = np.flatnonzero(left[:k])
        if len(copied):
            row[copied] = out[t - away.take(copied), copied]
            left[copied] -= 1
        cache[place[:k] + (((row.astype(np.uint64) * np.uint64(CACHE_MULTIPLIER)) & low) >> shift[:k]).astype(np.int64)] = row
    if (pos > end).any():
        raise ValueError("WebP: the pixels end early")
    for r, p, s in zip(readers, pos.tolist(), start.tolist(), strict=True):
        r.at = p - s
    found: list = [None] * len(n)
    for k, at in enumerate(order.tolist()):
        found[at] = out[: images[k].n, k].copy()
    return found


def _channels(argb: np.ndarray, height: int, width: int) -> np.ndarray:
    """(height, width, 4) in the order alpha, red, green, blue, as int64."""
    return np.stack([(argb >> s) & 0xFF for s in (24, 16, 8, 0)], axis=-1).astype(np.int64).reshape(height, width, 4)


def _predict(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What a mode of the predictor expects from the four neighbours, each of four samples."""
    average = lambda a, b: (a + b) >> 1
    if mode == 0:
        return np.array([255, 0, 0, 0])
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return average(average(left, right), top)
    if mode in (6, 7):
        return average(left, corner if mode == 6 else top)
    if mode in (8, 9):
        return average(top, corner if mode == 8 else right)
    if mode == 10:
        return average(average(left, corner), average(top, right))
    if mode == 11:
        guess = left + top - corner
        return left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mid = average(left, top)
    d = mid - corner
    return np.clip(mid + np.where(d < 0, -(-d // 2), d // 2), 0, 255)


def undo_predictor(px: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    height, width, _ = px.shape
    out = px.copy()
    out[0, 0] = (out[0, 0] + (255, 0, 0, 0)) & 255
    out[0, 1:] = np.cumsum(np.concatenate([out[0, :1], px[0, 1:]]), axis=0)[1:] & 255
    for y in range(1, height):
        out[y, 0] = (px[y, 0] + out[y - 1, 0]) & 255
        row = modes[y >> bits]
        for x in range(1, width):
            right = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
            out[y, x] = (px[y, x] + _predict(int(row[x >> bits]), out[y, x - 1], out[y - 1, x], out[y - 1, x - 1], right)) & 255
    return out


def undo_cross_colour(px: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    height, width, _ = px.shape
    signed = lambda v: ((v & 255) ^ 128) - 128
    f = signed(factors)[(np.arange(height) >> bits)[:, None], (np.arange(width) >> bits)[None, :]]
    to_red, to_blue, red_to_blue = f[..., 3], f[..., 2], f[..., 1]
    out, green = px.copy(), signed(px[..., 2])
    out[..., 1] = (px[..., 1] + ((to_red * green) >> 5)) & 255
    out[..., 3] = (px[..., 3] + ((to_blue * green) >> 5) + ((red_to_blue * signed(out[..., 1])) >> 5)) & 255
    return out


def undo_palette(px: np.ndarray, palette: np.ndarray, bits: int, width: int) -> np.ndarray:
    per = 8 >> bits
    index = px[..., 2]
    if bits:
        index = ((index[..., None] >> (np.arange(1 << bits) * per)) & ((1 << per) - 1)).reshape(px.shape[0], -1)[:, :width]
    full = np.zeros((256, 4), dtype=np.int64)
    full[: len(palette)] = palette
    return full[index]


@dataclass
class Stream:
    """A VP8L stream up to its pixels: the reader, the size, the transforms in order and the coded image."""

    reader: BitReader
    width: int
    height: int
    steps: list[tuple]
    image: Entropy


def opened(data: bytes) -> Stream:
    """A VP8L bit stream, read as far as its pixels."""
    r = BitReader(data)
    if r.bits(8) != SIGNATURE:
        raise ValueError("WebP: no lossless signature")
    width, height, _alpha, version = r.bits(14) + 1, r.bits(14) + 1, r.bits(1), r.bits(3)
    if version:
        raise ValueError("WebP: unknown version")
    steps, w = [], width
    while r.bits(1):
        kind = r.bits(2)
        if kind in (0, 1):
            bits = r.bits(3) + 2
            bw, bh = (w + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
            steps.append((kind, bits, _channels(_samples(r, bw, bh), bh, bw), w))
        elif kind == 2:
            steps.append((kind, 0, None, w))
        else:
            n = r.bits(8) + 1
            palette = np.cumsum(_channels(_samples(r, n, 1), 1, n)[0], axis=0) & 255
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, bits, palette, w))
            w = (w + (1 << bits) - 1) >> bits
        if r.at > 8 * len(data):
            raise ValueError("WebP: the data end early")
    return Stream(r, width, height, steps, _entropy(r, w, height, True))


def _undone(s: Stream, argb: np.ndarray) -> np.ndarray:
    """Pixels from the decoded values, the transforms undone."""
    if s.reader.at > 8 * len(s.reader.data):
        raise ValueError("WebP: the data end early")
    px = argb.astype("<u4").view(np.uint8).reshape(s.height, s.image.width, 4)[..., [3, 2, 1, 0]]
    if [x[0] for x in s.steps] == [2]:  # the common case, in bytes
        px[..., 1] += px[..., 2]
        px[..., 3] += px[..., 2]
        return px[..., [1, 2, 3, 0]]
    px = px.astype(np.int64)
    for kind, bits, extra, wide in reversed(s.steps):
        if kind == 0:
            px = undo_predictor(px, extra[..., 2] & 15, bits)
        elif kind == 1:
            px = undo_cross_colour(px, extra, bits)
        elif kind == 2:
            px[..., 1] = (px[..., 1] + px[..., 2]) & 255
            px[..., 3] = (px[..., 3] + px[..., 2]) & 255
        else:
            px = undo_palette(px, extra, bits, wide)
    return px[..., [1, 2, 3, 0]].astype(np.uint8)


def _lossless(data: bytes) -> bytes:
    """The VP8L stream of a WebP file; other chunks are skipped."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("WebP: no RIFF header")
    at, end = 12, 8 + struct.unpack("<I", data[4:8])[0]
    while at + 8 <= min(end, len(data)):
        name, n = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"VP8L":
            if at + 8 + n > len(data):
                raise ValueError("WebP: the file ends early")
            return data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("WebP: no lossless image")


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """Pixels of WebP files. The streams of a group are held together, about GROUP_PIXELS pixels."""
    out: list[np.ndarray] = []
    held: list[Stream] = []

    def pixels() -> list[np.ndarray]:
        small = [k for k, s in enumerate(held) if s.image.n <= STEP_PIXELS]
        found: list = [None] * len(held)
        if len(small) >= STEP_IMAGES:
            for k, v in zip(small, _together([held[k].reader for k in small], [held[k].image for k in small]), strict=True):
                found[k] = v
        return [_undone(s, _one(s.reader, s.image) if v is None else v) for s, v in zip(held, found, strict=True)]

    size = 0
    for data in files:
        held.append(opened(_lossless(data)))
        size += held[-1].image.n
        if size >= GROUP_PIXELS:
            out += pixels()
            held, size = [], 0
    return out + pixels()


def decode(data: bytes) -> np.ndarray:
    """Pixels of a WebP file."""
    return decode_many([data])[0]


# ---- encoder ----
class BitWriter:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def bytes(self) -> bytes:
        """All bits, with zeros up to a whole byte."""
        return self.value.to_bytes((self.n + 7) >> 3, "little")


def code_lengths(counts: list[int], limit: int = 15) -> list[int]:
    """Lengths of an optimal prefix code; if one passes the limit, counts are flattened until none does."""
    used = [s for s, c in enumerate(counts) if c]
    lengths = [0] * len(counts)
    n = len(used)
    if n < 2:
        for s in used:
            lengths[s] = 1
        return lengths
    least = 1
    while True:
        leaves = sorted((max(counts[s], least), s) for s in used)
        weights, inner = [x for x, _ in leaves], []
        above, i, j = [0] * (2 * n - 1), 0, 0
        for new in range(n, 2 * n - 1):  # joins the two lightest; joined ones come in order of weight
            total = 0
            for _ in (0, 1):
                if i < n and (j == len(inner) or weights[i] <= inner[j]):
                    total += weights[i]
                    above[i] = new
                    i += 1
                else:
                    total += inner[j]
                    above[n + j] = new
                    j += 1
            inner.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth[:n]) <= limit:
            break
        least *= 2
    for k, (_, s) in enumerate(leaves):
        lengths[s] = depth[k]
    return lengths


def many_code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """code_lengths() of every row, a join of each at a step; rows that pass the limit are done alone."""
    lengths = np.zeros(counts.shape, dtype=np.int64)
    k = (counts > 0).sum(axis=1)
    lengths[k == 1] = counts[k == 1] > 0
    rows = np.flatnonzero(k > 1)
    if not len(rows):
        return lengths
    rows = rows[np.argsort(-k[rows], kind="stable")]  # those with most symbols, and so most joins, come first
    k, most = k[rows], int(k[rows[0]])
    none = np.int64(1) << 60
    weight = np.where(counts[rows] > 0, counts[rows], none)
    order = np.argsort(weight, axis=1, kind="stable")[:, :most]
    weight = np.hstack([np.take_along_axis(weight, order, axis=1), np.full((len(rows), 1), none)]).ravel()
    inner, wide, deep = np.full(len(rows) * most, none), most + 1, most
    leaf_above, inner_above = np.zeros(len(weight), dtype=np.int64), np.zeros(len(inner), dtype=np.int64)
    live = np.searchsorted(-k, -np.arange(most), side="left")  # rows with more than so many symbols
    i, j = np.arange(len(rows)) * wide, np.arange(len(rows)) * deep
    for step in range(most - 1):
        n = int(live[step + 1])
        total = 0
        for _ in (0, 1):
            a, b = weight.take(i[:n]), inner.take(j[:n])
            leaf = a <= b
            total = total + np.where(leaf, a, b)
            leaf_above[i[:n][leaf]] = step
            inner_above[j[:n][~leaf]] = step
            i[:n] += leaf
            j[:n] += ~leaf
        inner[np.arange(n) * deep + step] = total
    depth, first = np.zeros(len(inner), dtype=np.int64), np.arange(len(rows)) * deep
    for step in range(most - 3, -1, -1):
        at = first[: int(live[step + 2])] + step  # joins that are not a row's last
        depth[at] = depth[first[: len(at)] + inner_above[at]] + 1
    above = leaf_above.reshape(len(rows), wide)[:, :most]
    found = np.where(np.arange(most) < k[:, None], np.take_along_axis(depth.reshape(len(rows), deep), above, axis=1) + 1, 0)
    own = np.zeros((len(rows), counts.shape[1]), dtype=np.int64)
    np.put_along_axis(own, order, found, axis=1)
    lengths[rows] = own
    for r in np.flatnonzero(lengths.max(axis=1) > limit).tolist():
        lengths[r] = code_lengths(counts[r].tolist(), limit)
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits, least significant first, and their number of each symbol (columns) of canonical codes (rows)."""
    out, n_bits = np.zeros(lengths.shape, dtype=np.uint64), lengths.astype(np.int64)
    code = np.zeros(len(lengths), dtype=np.int64)
    for n in range(1, int(lengths.max(initial=0)) + 1):
        own = lengths == n
        rows, symbols = np.nonzero(own)
        rank = np.cumsum(own, axis=1)[rows, symbols] - 1
        out[rows, symbols] = _REVERSED[n][(code[rows] + rank) & ((1 << n) - 1)]
        code = (code + own.sum(axis=1)) << 1
    n_bits[(lengths > 0).sum(axis=1) == 1] = 0  # a code of one symbol takes no bits
    return out, n_bits


def codes_of(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Bits, least significant first, and length of each symbol of one canonical code."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) < 2:
        return {s: (0, 0) for _, s in used}
    if sum(2.0**-n for n, _ in used) > 1:
        raise ValueError("WebP: a prefix code is not complete")
    code = last = 0
    out = {}
    for n, s in used:
        code <<= n - last
        out[s] = (_REVERSED_LISTS[n][code], n)
        code, last = code + 1, n
    return out


#: Bits that belong to images: the image of each value, the value, and how many bits it has.
Section = tuple[np.ndarray, np.ndarray, np.ndarray]


def _code_sections(lengths: np.ndarray) -> list[Section]:
    """The bits that tell the decoder each row's code: first how lengths are coded, or one or two symbols, then the lengths."""
    some = lengths > 0
    count, low, high = some.sum(axis=1), some.argmax(axis=1), lengths.shape[1] - 1 - some[:, ::-1].argmax(axis=1)
    simple = (count <= 2) & (high < 256)
    value = (5 | (np.maximum(count, 1) - 1) << 1 | low << 3 | np.where(count == 2, high, 0) << 11).astype(np.uint64)
    used = np.where(count == 2, 19, 11)
    rows = np.flatnonzero(~simple)
    if not len(rows):
        return [(np.arange(len(lengths)), value, used)]
    size = lengths.shape[1]
    flat = lengths[rows].ravel()
    at = np.arange(0, len(flat), size)
    new = np.concatenate([[True], np.diff(flat) != 0])
    new[at] = True
    start = np.flatnonzero(new)
    v, n, row = flat[start], np.diff(np.append(start, len(flat))), start // size
    # the last length but 0 before each run, 8 at first
    before = np.concatenate([[-1], np.maximum.accumulate(np.where(v > 0, np.arange(len(v)), -1))[:-1]])
    last = np.where((before >= 0) & (row[before] == row), v[before], 8)
    zero = v == 0
    lead = ~zero & (v != last)
    most = np.where(zero, 138, 6)
    rest = (n - lead) % most
    part = rest >= 3
    times = np.stack([lead, (n - lead) // most, part, np.where(part, 0, rest)], axis=1).ravel()
    some_zeros = np.where(rest <= 10, 17, 18)
    pick = lambda a, b, c, d: np.repeat(np.stack(np.broadcast_arrays(a, b, c, d), axis=1).ravel(), times)
    symbol = pick(v, np.where(zero, 18, 16), np.where(zero, some_zeros, 16), v)
    extra = pick(0, np.where(zero, 127, 3), np.where(zero & (rest > 10), rest - 11, rest - 3), 0)
    more = pick(0, np.where(zero, 7, 2), np.where(zero, np.where(rest <= 10, 3, 7), 2), 0)
    owner = np.repeat(np.repeat(row, 4), times)
    counts = np.bincount(owner * 19 + symbol, minlength=19 * len(rows)).reshape(-1, 19)
    own = many_code_lengths(counts, 7)
    bits, n_bits = canonical(own)
    ordered = own[:, CODE_ORDER]
    kept = np.maximum(4, 19 - (ordered[:, ::-1] > 0).argmax(axis=1))
    value[rows] = ((kept - 4) << 1 | (ordered << (5 + 3 * np.arange(19))).sum(axis=1)).astype(np.uint64)
    used[rows] = 5 + 3 * kept + 1
    first = n_bits[owner, symbol]
    return [(np.arange(len(lengths)), value, used), (rows[owner], bits[owner, symbol] | extra.astype(np.uint64) << first.astype(np.uint64), first + more)]


def write_code(w: BitWriter, lengths: list[int]) -> None:
    for _, value, used in _code_sections(np.array([lengths])):
        for v, n in zip(value.tolist(), used.tolist(), strict=True):
            w.put(v, n)


def _symbols(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols, extra bits and their numbers of lengths or distances."""
    v = np.maximum(values - 1, 1)
    top = np.frexp(v.astype(np.float64))[1] - 1
    far = values > 4
    more = np.where(far, top - 1, 0)
    return np.where(far, 2 * top + ((v >> np.maximum(top - 1, 0)) & 1), values - 1), np.where(far, v & ((1 << more) - 1), 0), more


def _head(width: int, height: int) -> BitWriter:
    w = BitWriter()
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    return w


def _riff(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def put_literals(w: BitWriter, argb: list[int]) -> None:
    """A small image of literals, as headers hold them: no colour cache, fitted codes."""
    w.put(0, 1)
    samples = [[v >> s & 255 for s in (8, 16, 0, 24)] for v in argb]
    codes = []
    for k, size in enumerate((280, 256, 256, 256)):
        counts = [0] * size
        for x in samples:
            counts[x[k]] += 1
        lengths = code_lengths(counts)
        write_code(w, lengths)
        codes.append(codes_of(lengths))
    write_code(w, [1] + [0] * 39)
    for x in samples:
        for code, v in zip(codes, x, strict=True):
            w.put(*code[v])


def _palettes(argb: np.ndarray, owner: np.ndarray, sizes: np.ndarray, widths: np.ndarray) -> tuple[list[BitWriter], np.ndarray, np.ndarray, np.ndarray]:
    """Headers with their transforms, the values to be coded, the image each is of, and the widths of the coded images.

    An image with at most MOST_COLOURS colours, and a quarter as many as pixels at most, gets a palette.
    """
    keys, kind = np.unique(owner << 32 | argb, return_inverse=True)
    colours = np.bincount(keys >> 32, minlength=len(sizes))
    small = colours <= np.minimum(MOST_COLOURS, sizes // 4)
    first = np.concatenate([[0], np.cumsum(colours)[:-1]])
    green = (argb >> 8) & 255
    values = argb & 0xFF00FF00 | ((argb & 0x00FF00FF) + 0x01000100 - (green << 16 | green)) & 0x00FF00FF
    start = np.concatenate([[0], np.cumsum(sizes)])
    heads, wide = [], widths.copy()
    parts, at = [], 0  # runs of values between images with a palette
    for i in range(len(sizes)):
        w = _head(int(widths[i]), int(sizes[i] // widths[i]))
        w.put(1, 1)
        if small[i]:
            own = keys[first[i] : first[i] + colours[i]] & 0xFFFFFFFF
            bits = 3 if len(own) <= 2 else 2 if len(own) <= 4 else 1 if len(own) <= 16 else 0
            w.put(3, 2)
            w.put(len(own) - 1, 8)
            px = np.diff(own.astype("<u4").view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), dtype=np.uint8))
            put_literals(w, np.ascontiguousarray(px).view("<u4").ravel().tolist())
            index = (kind[start[i] : start[i + 1]] - first[i]).reshape(-1, widths[i])
            per = 1 << bits
            index = np.pad(index, ((0, 0), (0, -int(widths[i]) % per))).reshape(len(index), -1, per)
            packed = (index << (np.arange(per) * (8 // per))).sum(axis=2)
            wide[i] = packed.shape[1]
            parts += [values[at : start[i]], 0xFF000000 | packed.ravel() << 8]
            at = start[i + 1]
        else:
            w.put(2, 2)
        w.put(0, 1)
        heads.append(w)
    parts.append(values[at:])
    counts = sizes // widths * wide
    return heads, np.concatenate(parts), np.repeat(np.arange(len(sizes)), counts), wide


def _matches(v: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of runs of pixels that occurred before in their image; they do not overlap."""
    none = np.zeros(0, dtype=np.int64)
    last = LEAST_MATCH - 1
    at = np.flatnonzero(owner[last:] == owner[:-last]) if len(v) > last else none
    h = owner[at].astype(np.uint64)
    for j in range(LEAST_MATCH):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (h >> np.uint64(32)) ^ v[at + j].astype(np.uint64)
    h *= np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    here, before = at[order[same + 1]], at[order[same]]
    equal = owner[here] == owner[before]
    for j in range(LEAST_MATCH):
        equal &= v[here + j] == v[before + j]
    away = np.zeros(len(v), dtype=np.int64)
    away[here[equal]] = here[equal] - before[equal]
    here = np.flatnonzero(away)
    if not len(here):
        return none, none, none
    d = away[here]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(here) != 1) | (np.diff(d) != 0)]))
    first, d = here[new], d[new]
    stop = here[np.append(new[1:], len(here)) - 1] + LEAST_MATCH
    first = np.maximum(first, np.concatenate([[0], np.maximum.accumulate(stop)[:-1]]))
    keep = stop - first >= LEAST_MATCH
    return first[keep], (stop - first)[keep], d[keep]


def _cached(v: np.ndarray, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which pixels are in their place of the colour cache when they come."""
    order = np.argsort(owner << CACHE_BITS | place, kind="stable")
    before = np.zeros(len(v), dtype=np.int64)
    same = (owner[order[1:]] == owner[order[:-1]]) & (place[order[1:]] == place[order[:-1]])
    before[order[1:]] = np.where(same, v[order[:-1]], 0)
    return before == v


def encode_many(images: list[np.ndarray]) -> list[bytes]:
    """WebP files of pixel arrays, each of (height, width, 4) and of 4096 pixels a row and 16384 pixels at most."""
    sizes, widths = np.array([x.shape[0] * x.shape[1] for x in images]), np.array([x.shape[1] for x in images])
    raw = np.concatenate([x.reshape(-1, 4) for x in images]).astype(np.int64)
    argb = raw[:, 3] << 24 | raw[:, 0] << 16 | raw[:, 1] << 8 | raw[:, 2]
    heads, v, owner, wide = _palettes(argb, np.repeat(np.arange(len(sizes)), sizes), sizes, widths)
    n = len(images)
    place = ((v.astype(np.uint64) * np.uint64(CACHE_MULTIPLIER)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE_BITS)
    place = place.astype(np.int64)
    first, length, away = _matches(v, owner)
    inside = np.zeros(len(v) + 1, dtype=np.int64)
    inside[first] += 1
    np.subtract.at(inside, first + length, 1)
    op = np.cumsum(inside[:-1]) == 0
    op[first] = True
    # every operation: a back-reference, a cached pixel or a literal
    at = np.flatnonzero(op)
    own, match = owner[at], np.zeros(len(v), dtype=bool)
    match[first] = True
    match = match[at]
    hit = _cached(v, owner, place)[at] & ~match
    lit = ~match & ~hit
    near = {w: {d: k for k, d in reversed(list(enumerate(_near(w).tolist()))) if k} for w in set(wide.tolist())}
    codes = [near[w].get(d, d + 120) for w, d in zip(wide[owner[first]].tolist(), away.tolist(), strict=True)]
    l_symbol, l_extra, l_bits = _symbols(length)
    d_symbol, d_extra, d_bits = _symbols(np.array(codes, dtype=np.int64))
    green = (v[at] >> 8) & 255
    green[hit] = 280 + place[at][hit]
    green[match] = 256 + l_symbol
    symbols = {GREEN: (own, green, 280 + (1 << CACHE_BITS))} | {k: (own[lit], (v[at][lit] >> s) & 255, 256) for k, s in ((RED, 16), (BLUE, 0), (ALPHA, 24))}
    symbols[DISTANCE] = (own[match], d_symbol, 40)
    bits, n_bits, sections = {}, {}, []
    for w in heads:
        w.put(1, 1), w.put(CACHE_BITS, 4), w.put(0, 1)  # a colour cache, no meta prefix
    for k, (of, s, size) in symbols.items():
        counts = np.bincount(of * size + s, minlength=n * size).reshape(n, size)
        lengths = many_code_lengths(counts, LONGEST_CODE)
        sections += _code_sections(lengths)
        b, m = canonical(lengths)
        bits[k], n_bits[k] = b[of, s], m[of, s]
    value, used = bits[GREEN], n_bits[GREEN]
    for which, more in ((match, [(l_extra, l_bits), (bits[DISTANCE], n_bits[DISTANCE]), (d_extra, d_bits)]), (lit, [(bits[k], n_bits[k]) for k in (RED, BLUE, ALPHA)])):
        x, m = value[which], used[which]
        for b, k in more:
            x |= b.astype(np.uint64) << m.astype(np.uint64)
            m = m + k
        value[which], used[which] = x, m
    return _packed(heads, [*sections, (own, value, used)])


def _packed(heads: list[BitWriter], sections: list[Section]) -> list[bytes]:
    """Files of headers and, after them, each image's bits of every section; a value has less than 64 bits."""
    n = len(heads)
    n_head = np.array([w.n for w in heads])
    n_bits = [np.bincount(own, weights=used, minlength=n).astype(np.int64) for own, _, used in sections]
    start = np.concatenate([[0], np.cumsum((n_head + sum(n_bits) + 7) >> 3)])
    words = np.zeros((int(start[-1]) >> 3) + 2, dtype=np.uint64)
    at = 8 * start[:-1] + n_head
    for (own, value, used), m in zip(sections, n_bits, strict=True):
        bit = np.cumsum(used) - used - (np.cumsum(m) - m)[own] + at[own]
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        new = np.flatnonzero(np.concatenate([[True], np.diff(word) != 0]))
        words[word[new]] |= np.bitwise_or.reduceat(value << shift, new)
        over = np.where(shift > 0, value >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        words[word[new] + 1] |= np.bitwise_or.reduceat(over, new)
        at += m
    data = words.view(np.uint8)
    for w, a in zip(heads, start.tolist(), strict=False):
        own_bytes = np.frombuffer(w.bytes(), dtype=np.uint8)
        data[a : a + len(own_bytes)] |= own_bytes
    return [_riff(data[a:b].tobytes()) for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


# ---- payloads ----
def padded(data: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of a row."""
    return data + b"\0" * (max(1, -(-len(data) // ROW_BYTES)) * ROW_BYTES - len(data))


def _grouped(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about `most` together."""
    start = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most or i == len(sizes) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def store_many(payloads: list[bytes]) -> list[bytes]:
    """For each payload of whole rows its WebP files, one after another."""
    rows = [np.frombuffer(p, dtype=np.uint8).reshape(-1, ROW_BYTES // 4, 4) for p in payloads]
    images = [(k, x[i : i + MOST_ROWS]) for k, x in enumerate(rows) for i in range(0, len(x), MOST_ROWS)]
    out: list[list[bytes]] = [[] for _ in payloads]
    for a, b in _grouped([x.size // 4 for _, x in images], GROUP_PIXELS):
        for (k, _), file in zip(images[a:b], encode_many([x for _, x in images[a:b]]), strict=True):
            out[k].append(file)
    return [b"".join(x) for x in out]


def files_of(media: bytes) -> list[bytes]:
    """The files of a media value."""
    out, at = [], 0
    while at < len(media):
        if len(media) - at < 12:
            raise ValueError("WebP: the file ends early")
        n = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        out.append(media[at : at + n])
        at += n
    return out


def images_many(media: list[bytes]) -> list[list[np.ndarray]]:
    """For each media value the pixel arrays of its files."""
    files = [files_of(m) for m in media]
    found = iter(decode_many([f for x in files for f in x]))
    return [[next(found) for _ in x] for x in files]
