"""Lossless WebP: a complete decoder of the published format and an encoder.

The decoder reads prefix codes (simple and coded lengths), groups of codes by
an entropy image, back-references with the distance map, the colour cache, and
inverts the predictor, cross-colour, subtract-green and palette transforms.
The encoder can use each of these.  ``encode_bytes`` and ``decode_bytes`` work
on a block of byte rows at once: images whose only varying channel is green are
decoded in lock step over all images, one symbol of each a step.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
ALPHABETS = (256 + 24, 256, 256, 256, 40)
CACHE_FACTOR = 0x1E35A7BD
# The 120 short distances as (dx, dy), nearest first.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1),
    (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4),
    (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6),
    (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5),
    (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class BadImage(ValueError):
    """The bytes are not a lossless WebP image."""


# --------------------------------------------------------------------------
# prefix codes


def code_lengths(counts, limit: int) -> list[int]:
    """Huffman lengths of at most ``limit`` bits; unused symbols have 0."""
    counts = [int(c) for c in counts]
    used = [i for i, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(used) == 1:
        out[used[0]] = 1
        return out
    least = 1
    while used:
        heap = [(max(counts[i], least), i, None) for i in used]
        heapq.heapify(heap)
        serial = len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], serial, (a, b)))
            serial += 1
        walk, deepest = [(heap[0], 0)], 0
        while walk:
            (_, i, parts), depth = walk.pop()
            if parts is None:
                out[i] = depth
                deepest = max(deepest, depth)
            else:
                walk += [(parts[0], depth + 1), (parts[1], depth + 1)]
        if deepest <= limit:
            break
        least = 2 * least + sum(counts) // 4096  # flatter counts, shorter codes
    return out


def _reverse_table(bits: int) -> np.ndarray:
    x, out = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
    for _ in range(bits):
        out, x = (out << 1) | (x & 1), x >> 1
    return out


_REVERSE = [_reverse_table(b) for b in range(16)]


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, first bit lowest."""
    lengths = np.asarray(lengths, np.int64)
    out = np.zeros(len(lengths), np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    most = int(lengths.max(initial=0))
    at = np.concatenate([[0], np.cumsum(1 << (most - lengths[order]))])[:-1]
    out[order] = _REVERSE[most][at] & ((1 << lengths[order]) - 1)
    return out


class Prefix:
    """Lookup by the next ``bits`` bits; an entry is symbol << 4 | length."""

    def __init__(self, lengths):
        lengths = np.asarray(lengths, np.int64)
        used = np.flatnonzero(lengths)
        if len(used) == 0:
            raise BadImage("a prefix code without symbols")
        if len(used) == 1:
            self.bits, self.table = 0, np.array([used[0] << 4], np.int32)
            self.most = int(used[0])
            return
        most = int(lengths.max())
        order = used[np.argsort(lengths[used], kind="stable")]
        if (1 << (most - lengths[order])).sum() != 1 << most:
            raise BadImage("a prefix code that is not complete")
        flat = np.repeat((order << 4 | lengths[order]).astype(np.int32), 1 << (most - lengths[order]))
        self.bits, self.table = most, flat[_REVERSE[most]]
        self.most = int(used[-1])


class Reader:
    def __init__(self, data: bytes):
        self.all, self.at, self.end = int.from_bytes(data, "little"), 0, 8 * len(data)
        self.data = data

    def read(self, n: int) -> int:
        lo = self.at >> 3
        window = int.from_bytes(self.data[lo : lo + 5], "little")
        out = (window >> (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise BadImage("the data end early")
        return out

    def symbol(self, code: Prefix) -> int:
        lo = self.at >> 3
        window = int.from_bytes(self.data[lo : lo + 4], "little") >> (self.at & 7)
        entry = int(code.table[window & ((1 << code.bits) - 1)])
        self.at += entry & 15
        if self.at > self.end:
            raise BadImage("the data end early")
        return entry >> 4


def read_prefix(r: Reader, alphabet: int) -> Prefix:
    lengths = np.zeros(alphabet, np.int64)
    if r.read(1):  # simple: one or two symbols
        two = r.read(1)
        first = r.read(8 if r.read(1) else 1)
        chosen = [first] + ([r.read(8)] if two else [])
        if max(chosen) >= alphabet:
            raise BadImage("a symbol outside the alphabet")
        lengths[chosen] = 1
        return Prefix(lengths)
    own = np.zeros(19, np.int64)
    for i in LENGTH_ORDER[: 4 + r.read(4)]:
        own[i] = r.read(3)
    code = Prefix(own)
    most = alphabet
    if r.read(1):
        most = 2 + r.read(2 + 2 * r.read(3))
    i, last = 0, 8
    while i < alphabet and most:
        most -= 1
        s = r.symbol(code)
        if s < 16:
            lengths[i] = s
            last = s or last
            i += 1
            continue
        extra, base = ((2, 3), (3, 3), (7, 11))[s - 16]
        n = base + r.read(extra)
        if i + n > alphabet:
            raise BadImage("code lengths past the alphabet")
        lengths[i : i + n] = last if s == 16 else 0
        i += n
    return Prefix(lengths)


# --------------------------------------------------------------------------
# decoding


def _value(r: Reader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.read(extra) + 1


def _cached(pixel: int, bits: int) -> int:
    return ((CACHE_FACTOR * pixel) & 0xFFFFFFFF) >> (32 - bits)


def read_pixels(r: Reader, width: int, height: int, top: bool) -> np.ndarray:
    """The pixels of one image (of the picture or of a transform), row order."""
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise BadImage("a colour cache of too many bits")
    block, groups, which = 0, 1, None
    if top and r.read(1):
        block = r.read(3) + 2
        wide = (width + (1 << block) - 1) >> block
        tall = (height + (1 << block) - 1) >> block
        which = ((read_pixels(r, wide, tall, False) >> 8) & 0xFFFF).tolist()
        groups = max(which) + 1
    codes = []
    for _ in range(groups):
        sizes = (ALPHABETS[0] + ((1 << cache_bits) if cache_bits else 0), *ALPHABETS[1:])
        codes.append([read_prefix(r, n) for n in sizes])
    out, total = [], width * height
    cache = [0] * (1 << cache_bits) if cache_bits else None
    while len(out) < total:
        own = codes[0]
        if which is not None:
            y, x = divmod(len(out), width)
            own = codes[which[(y >> block) * wide + (x >> block)]]
        s = r.symbol(own[0])
        if s < 256:
            red, blue, alpha = (r.symbol(c) for c in own[1:4])
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            n = _value(r, s - 256)
            code = _value(r, r.symbol(own[4]))
            if code > 120:
                back = code - 120
            else:
                dx, dy = NEAR[code - 1]
                back = max(1, dx + dy * width)
            if back > len(out) or len(out) + n > total:
                raise BadImage("a back-reference outside the image")
            for _ in range(n):
                out.append(out[-back])
                if cache:
                    cache[_cached(out[-1], cache_bits)] = out[-1]
            continue
        else:
            out.append(cache[s - 280])
        if cache:
            cache[_cached(out[-1], cache_bits)] = out[-1]
    return np.array(out, np.uint32)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(n, 4) of blue, green, red, alpha as ints."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(-1, 4).astype(np.int64)


def _pixels(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels & 255, np.uint8).view("<u4").ravel()


def _half(a, b):
    return [(x + y) >> 1 for x, y in zip(a, b)]


def _clip(x):
    return 0 if x < 0 else 255 if x > 255 else x


def predicted(mode: int, left, top, tl, tr):
    """The prediction of a pixel from its decoded neighbours."""
    if mode == 0:
        return (0, 0, 0, 255)
    if mode in (1, 2, 3, 4):
        return (left, top, tr, tl)[mode - 1]
    if mode == 5:
        return _half(_half(left, tr), top)
    if mode in (6, 7, 8, 9, 10):
        pairs = {6: (left, tl), 7: (left, top), 8: (tl, top), 9: (top, tr)}
        if mode == 10:
            return _half(_half(left, tl), _half(top, tr))
        return _half(*pairs[mode])
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, tl))
        to_top = sum(abs(a - c) for a, c in zip(left, tl))
        return left if to_left < to_top else top
    if mode == 12:
        return [_clip(a + t - c) for a, t, c in zip(left, top, tl)]
    if mode == 13:
        mid = _half(left, top)
        return [_clip(m + int((m - c) / 2)) for m, c in zip(mid, tl)]
    raise BadImage("an unknown predictor")


def predictor(values: np.ndarray, modes: list[int], bits: int, width: int, invert: bool):
    """Residuals to pixels, or with ``invert`` false pixels to residuals."""
    height = len(values) // width
    wide = (width + (1 << bits) - 1) >> bits
    source = values.tolist()
    full = [None] * len(source) if invert else source
    out = [None] * len(source)
    for i, own in enumerate(source):
        y, x = divmod(i, width)
        if i == 0:
            guess = (0, 0, 0, 255)
        elif y == 0:
            guess = full[i - 1]
        elif x == 0:
            guess = full[i - width]
        else:
            guess = predicted(
                modes[(y >> bits) * wide + (x >> bits)],
                full[i - 1],
                full[i - width],
                full[i - width - 1],
                full[i - width + 1],
            )
        if invert:
            full[i] = out[i] = [(a + b) & 255 for a, b in zip(own, guess)]
        else:
            out[i] = [(a - b) & 255 for a, b in zip(own, guess)]
    assert height * width == len(out)
    return np.array(out, np.int64).reshape(-1, 4)


def _signed(x):
    return ((x & 255) ^ 128) - 128


def cross_colour(values, factors, bits, width, sign):
    """Adds (sign 1, decoding) or takes away what red and blue share with
    green and red.  ``factors``: (green to red, green to blue, red to blue)."""
    n = len(values)
    y, x = np.divmod(np.arange(n), width)
    wide = (width + (1 << bits) - 1) >> bits
    f = _signed(factors[(y >> bits) * wide + (x >> bits)])
    out = values.copy()
    green, red = _signed(values[:, 1]), values[:, 2]
    out[:, 2] = (red + sign * (f[:, 0] * green >> 5)) & 255
    base = _signed(out[:, 2] if sign > 0 else red)
    out[:, 0] = (values[:, 0] + sign * ((f[:, 1] * green >> 5) + (f[:, 2] * base >> 5))) & 255
    return out


def _chunk(data: bytes) -> bytes:
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise BadImage("no WebP container")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise BadImage("no lossless image in the container")


def _header(r: Reader) -> tuple[int, int]:
    if r.read(8) != 0x2F:
        raise BadImage("no lossless signature")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise BadImage("an unknown version")
    return width, height


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) array of red, green, blue, alpha."""
    r = Reader(_chunk(data))
    width, height = _header(r)
    now, seen, todo = width, set(), []
    while r.read(1):
        kind = r.read(2)
        if kind in seen:
            raise BadImage("a transform twice")
        seen.add(kind)
        if kind in (0, 1):
            bits = r.read(3) + 2
            wide, tall = (now + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
            side = _channels(read_pixels(r, wide, tall, False))
            todo.append((kind, bits, side, now))
        elif kind == 2:
            todo.append((kind, 0, None, now))
        else:
            n = r.read(8) + 1
            table = np.cumsum(_channels(read_pixels(r, n, 1, False)), axis=0) & 255
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            todo.append((kind, pack, table, now))
            now = (now + (1 << pack) - 1) >> pack
    values = _channels(read_pixels(r, now, height, True))
    for kind, bits, side, wide in reversed(todo):
        if kind == 0:
            values = predictor(values, (side[:, 1] & 15).tolist(), bits, wide, True)
        elif kind == 1:
            values = cross_colour(values, side[:, :3], bits, wide, 1)
        elif kind == 2:
            values[:, [0, 2]] = (values[:, [0, 2]] + values[:, 1:2]) & 255
        else:
            each, step = 1 << bits, 8 >> bits
            packed = values[:, 1].reshape(height, -1)
            index = (packed[:, :, None] >> (step * np.arange(each))) & ((1 << step) - 1)
            index = index.reshape(height, -1)[:, :wide].ravel()
            table = np.vstack([side, np.zeros((256 - len(side), 4), np.int64)])
            values = table[index]
    return values.reshape(height, width, 4)[:, :, [2, 1, 0, 3]].astype(np.uint8)


# --------------------------------------------------------------------------
# encoding


class Writer:
    """Bits, lowest first; whole bytes leave the number that still grows."""

    def __init__(self):
        self.done, self.open, self.at = bytearray(), 0, 0

    def put(self, value: int, n: int) -> None:
        self.open |= int(value) << (self.at - 8 * len(self.done))
        self.at += n
        if self.at - 8 * len(self.done) >= 1024:
            whole = self.at // 8 - len(self.done)
            self.done += (self.open & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.open >>= 8 * whole

    @property
    def value(self) -> int:
        return int.from_bytes(self.bytes(), "little")

    def bytes(self) -> bytes:
        return bytes(self.done) + self.open.to_bytes((self.at + 7) // 8 - len(self.done), "little")


def put_prefix(w: Writer, lengths) -> None:
    """Lengths of up to 15 bits under a code of four bits for each length."""
    used = [i for i, n in enumerate(lengths) if n]
    if len(used) <= 1:
        only = used[0] if used else 0
        if only < 256:
            w.put(1 | (only > 1) << 2, 3)
            w.put(only, 8 if only > 1 else 1)
            return
    w.put(0, 1)
    w.put(15, 4)
    for i in LENGTH_ORDER:
        w.put(4 if i < 16 else 0, 3)
    last = max(used) + 1
    if len(used) == 1:  # a lone symbol past 255: a second one completes it
        lengths = list(lengths)
        lengths[0] = lengths[used[0]] = 1
    last = max(last, 2)
    n = max(2, (last - 2).bit_length())
    n += n & 1
    w.put(1, 1)
    w.put((n - 2) // 2, 3)
    w.put(last - 2, n)
    flip = (0, 8, 4, 12, 2, 10, 6, 14, 1, 9, 5, 13, 3, 11, 7, 15)  # four bits reversed
    for x in lengths[:last]:
        w.put(flip[x], 4)


def _split(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number of a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    high = value.bit_length() - 1
    extra = high - 1
    return 2 * high + ((value >> (high - 1)) & 1), value & ((1 << extra) - 1), extra


#: Places of earlier pixels that the encoder remembers.
WINDOW = 1 << 16


def put_pixels(w: Writer, pixels: np.ndarray, width: int, top: bool, cache_bits=0, repeats=False):
    """One image under one group of codes."""
    items, i, values = [], 0, pixels.tolist()
    cache = [None] * (1 << cache_bits) if cache_bits else None
    last: dict[tuple, int] = {}
    near = {max(1, dx + dy * width): k + 1 for k, (dx, dy) in reversed(list(enumerate(NEAR)))}
    while i < len(values):
        n = 0
        if repeats and i + 3 <= len(values):
            j = last.get(tuple(values[i : i + 3]), -1)
            if j >= 0:
                while n < 4096 and i + n < len(values) and values[j + n] == values[i + n]:
                    n += 1
        if n >= 3:
            items.append((_split(n), _split(near.get(i - j, i - j + 120))))
        elif cache and cache[_cached(values[i], cache_bits)] == values[i]:
            items.append(280 + _cached(values[i], cache_bits))
            n = 1
        else:
            items.append(None)
            n = 1
        for k in range(i, i + n):
            if items[-1] is None and k == i:
                items[-1] = -1 - values[k]
            if cache:
                cache[_cached(values[k], cache_bits)] = values[k]
            if repeats:
                if len(last) >= WINDOW:  # bounded, however long the image is
                    last.clear()
                last[tuple(values[k : k + 3])] = k
        i += n
    sizes = (ALPHABETS[0] + ((1 << cache_bits) if cache_bits else 0), *ALPHABETS[1:])
    counts = [[0] * n for n in sizes]
    plain = []
    for x in items:
        if isinstance(x, tuple):
            counts[0][256 + x[0][0]] += 1
            counts[4][x[1][0]] += 1
            plain.append(x)
        elif x >= 280:
            counts[0][x] += 1
            plain.append(x)
        else:
            p = -1 - x
            parts = (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24)
            for k in range(4):
                counts[k][parts[k]] += 1
            plain.append(parts)
    w.put(1 | cache_bits << 1, 5) if cache_bits else w.put(0, 1)
    if top:
        w.put(0, 1)
    tables = []
    for c in counts:
        lengths = code_lengths(c, 15)
        put_prefix(w, lengths)
        used = sum(map(bool, lengths))
        if used == 1 and max(i for i, n in enumerate(lengths) if n) > 255:
            lengths[0] = 1
            used = 2
        tables.append((codes_of(lengths).tolist(), lengths if used > 1 else [0] * len(lengths)))

    def put(k, s):
        w.put(tables[k][0][s], tables[k][1][s])

    for x in plain:
        if isinstance(x, int):
            put(0, x)
        elif len(x) == 2:
            put(0, 256 + x[0][0])
            w.put(x[0][1], x[0][2])
            put(4, x[1][0])
            w.put(x[1][1], x[1][2])
        else:
            for k in range(4):
                put(k, x[k])


def _start(width: int, height: int) -> Writer:
    if not (1 <= width <= 16384 and 1 <= height <= 16384):
        raise BadImage("a side outside 1 to 16384")
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    return w


def _wrap(body: bytes) -> bytes:
    pad = len(body) & 1
    size = 12 + len(body) + pad
    return (
        b"RIFF" + size.to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little")
        + body + b"\0" * pad
    )


def encode(
    image: np.ndarray,
    modes: list[int] | None = None,
    mode_bits: int = 2,
    colour: tuple[int, int, int] | None = None,
    subtract_green: bool = False,
    palette: bool = False,
    cache_bits: int = 0,
    repeats: bool = True,
) -> bytes:
    """Encode a (height, width, 4) image of red, green, blue, alpha with the
    transforms asked for: predictor ``modes`` of blocks, one cross-colour
    factor triple, subtract green, palette (at most 256 colours)."""
    height, width = image.shape[:2]
    w = _start(width, height)
    values = image.reshape(-1, 4)[:, [2, 1, 0, 3]].astype(np.int64)
    now = width
    if palette:
        flat = _pixels(values)
        table, index = np.unique(flat, return_inverse=True)
        if len(table) > 256:
            raise BadImage("more than 256 colours")
        w.put(1 | 3 << 1 | (len(table) - 1) << 3, 11)
        steps = np.diff(_channels(table), axis=0, prepend=np.zeros((1, 4), np.int64))
        put_pixels(w, _pixels(steps), len(table), False)
        n = len(table)
        pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        each, step = 1 << pack, 8 >> pack
        now = (width + each - 1) >> pack
        grid = np.zeros((height, now * each), np.int64)
        grid[:, :width] = index.reshape(height, width)
        packed = (grid.reshape(height, now, each) << (step * np.arange(each))).sum(2).ravel()
        values = np.zeros((len(packed), 4), np.int64)
        values[:, 1], values[:, 3] = packed, 255
    if subtract_green:
        w.put(1 | 2 << 1, 3)
        values[:, [0, 2]] = (values[:, [0, 2]] - values[:, 1:2]) & 255
    if modes is not None:
        side_w = (now + (1 << mode_bits) - 1) >> mode_bits
        side_h = (height + (1 << mode_bits) - 1) >> mode_bits
        chosen = [modes[i % len(modes)] for i in range(side_w * side_h)]
        w.put(1 | 0 << 1 | (mode_bits - 2) << 3, 6)
        side = np.zeros((len(chosen), 4), np.int64)
        side[:, 1], side[:, 3] = chosen, 255
        put_pixels(w, _pixels(side), side_w, False)
        values = predictor(values, chosen, mode_bits, now, False)
    if colour is not None:
        side_w, side_h = (now + 3) >> 2, (height + 3) >> 2
        w.put(1 | 1 << 1, 6)
        side = np.zeros((side_w * side_h, 4), np.int64)
        side[:, :3], side[:, 3] = colour, 255
        put_pixels(w, _pixels(side), side_w, False)
        values = cross_colour(values, side[:, :3], 2, now, -1)
    w.put(0, 1)
    put_pixels(w, _pixels(values), now, True, cache_bits, repeats)
    return _wrap(w.bytes())


# --------------------------------------------------------------------------
# blocks of byte rows

#: Longest code of the block encoder: small lookup tables in lock step.
SHORT = 11
#: Images still in lock step below which each is finished on its own.
FEW = 12


def shape_of(n: int) -> tuple[int, int]:
    """Width and height for n bytes: 64 wide unless that is too tall."""
    width = 64 * max(1, -(-n // (64 * 16384)))
    return width, -(-n // width)


def _profiles() -> np.ndarray:
    """Lengths of a few complete codes over all bytes, by rule: words of small
    letters, the same with two-byte letters, capitals, figures and marks, and
    any bytes alike."""
    often = b" etaoinshrdlucmfwypvbgkjqxz"
    plain = np.ones(256)
    plain[list(often)] = [4000 / (1 + 0.35 * k) for k in range(len(often))]
    plain[list(b".,\n")] = 300
    plain[65:91] = 30
    plain[48:58] = 20
    plain[0] = 60
    wide = plain.copy()
    wide[0xC3] = 1500
    wide[0x9F:0xC0] = 60
    wide[[0xA9, 0xA8, 0xB3, 0xBC, 0xB6]] = 300
    upper = plain.copy()
    upper[65:91] = plain[97:123]
    upper[97:123] = 30
    upper[33] = 1500
    signs = plain.copy()
    signs[48:58] = 800
    signs[33:48] = np.maximum(signs[33:48], 400)
    signs[58:65] = signs[91:97] = signs[123:127] = 300
    return np.array([code_lengths(np.ceil(x), SHORT) for x in (plain, wide, upper, signs, np.ones(256))])


def _pairs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each two bytes in a row, the first one lowest."""
    code = codes_of(lengths).astype(np.uint64)
    size = lengths.astype(np.uint64)
    both = code[None, :] | code[:, None] << size[None, :]
    return both.ravel(), (size[None, :] + size[:, None]).ravel()


PROFILES = _profiles()
_PAIRS = [_pairs(x) for x in PROFILES]
PAIR_CODE = np.concatenate([c for c, _ in _PAIRS])
PAIR_SIZE = np.concatenate([n for _, n in _PAIRS])


def _profile_head(lengths: np.ndarray) -> tuple[int, int]:
    w = Writer()
    w.put(0, 3)  # no transform, cache or entropy image
    put_prefix(w, lengths.tolist())
    for only in (0, 0, 255, 0):
        w.put(1 | (only > 1) << 2, 3)
        w.put(only, 8 if only > 1 else 1)
    return w.value, w.at


HEADS = [_profile_head(x) for x in PROFILES]


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits of each row's symbols under a code of their own."""
    total = counts.sum(1, keepdims=True)
    return (counts * np.log2(np.maximum(total, 1) / np.maximum(counts, 1))).sum(1)


#: Bits that code tables of an image of its own take, about.
TABLES = 700


def _tools(run: bytes, plain: float, values: int, own: float, steps: float) -> dict[str, dict]:
    """The encoder's tools that an estimate finds worth trying for one run, whose
    bits are ``plain`` as literals, ``own`` and ``steps`` under a code of its own
    for values and for steps between neighbours: a palette for few values, the
    predictor where steps need fewer bits than values, and repeats with or
    without the colour cache where a dictionary coder finds them."""
    found = {}
    if values <= 16 and len(run) * max(1, (values - 1).bit_length()) + 300 < 0.9 * plain:
        found["palette+repeats"] = {"palette": True, "repeats": True}
    if steps + TABLES < 0.8 * min(plain, own + TABLES):
        found["predictor+repeats"] = {"modes": [1], "mode_bits": 9, "repeats": True}
    if 8 * len(zlib.compress(run, 1)) < 0.45 * plain:
        found["repeats"] = {"repeats": True}
        if 16 < values <= 32:
            found["cache+repeats"] = {"cache_bits": 6, "repeats": True}
    return found


def encode_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[str]]:
    """Each run of bytes (a positive multiple of 64 of them) as the green
    channel of an opaque image, and the tools that made it; rows past the end
    are zero.  Literals under that profile's code which makes the image smallest,
    for all runs at once; where an estimate promises more, the other tools are
    tried and the smallest image stays.  As there is one channel, the
    cross-colour transform has nothing to save and is not tried."""
    n = len(offsets) - 1
    shapes = [shape_of(int(b - a)) for a, b in zip(offsets[:-1], offsets[1:])]
    sizes = np.array([w * h for w, h in shapes])
    if (sizes != np.diff(offsets)).any():
        start = np.cumsum([0, *sizes])
        full = np.zeros(int(start[-1]), np.uint8)
        for i in range(n):
            own = data[offsets[i] : offsets[i + 1]]
            full[start[i] : start[i] + len(own)] = own
        data, offsets = full, start
    counts = np.array([np.bincount(data[a:b], minlength=256) for a, b in zip(offsets[:-1], offsets[1:])])
    cost = counts @ PROFILES.T
    best = cost.argmin(1)
    head_bits = np.array([40 + HEADS[k][1] for k in best])
    bits = head_bits + cost[np.arange(n), best]
    base = np.cumsum([0, *((bits + 7) // 8)])  # first byte of each image
    pairs = np.frombuffer(np.ascontiguousarray(data).tobytes(), "<u2").astype(np.int64)
    pairs += np.repeat(best * 65536, np.diff(offsets) // 2)
    size = PAIR_SIZE[pairs]
    at = np.cumsum(size) - size
    first = offsets[:-1] // 2
    shift = (8 * base[:-1] + head_bits).astype(np.uint64) - at[first]
    at += np.repeat(shift, np.diff(offsets) // 2)
    word = (at >> np.uint64(5)).astype(np.int64)
    value = PAIR_CODE[pairs] << (at & np.uint64(31))
    cut = np.flatnonzero(np.diff(word, prepend=-1))
    total = np.add.reduceat(value, cut)  # disjoint bits
    packed = np.zeros(int(base[-1]) // 4 + 3, np.uint32)
    packed[word[cut]] += (total & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    packed[word[cut] + 1] += (total >> np.uint64(32)).astype(np.uint32)
    body = packed.astype("<u4").view(np.uint8)
    out = []
    for i, (width, height) in enumerate(shapes):
        w = _start(width, height)
        value, length = HEADS[best[i]]
        w.put(value, length)
        head = np.frombuffer(w.bytes(), np.uint8)
        body[base[i] : base[i] + len(head)] |= head
        out.append(_wrap(body[base[i] : base[i + 1]].tobytes()))
    # Steps between neighbours, as the predictor of the left pixel leaves them.
    steps = np.diff(data, prepend=data[:1] if len(data) else None).astype(np.int64)
    steps += np.repeat(np.arange(n), np.diff(offsets)) * 256
    steps = np.bincount(steps, minlength=n * 256).reshape(n, 256)
    names = ["literals"] * n
    estimates = zip((counts > 0).sum(1).tolist(), _entropy(counts).tolist(), _entropy(steps).tolist())
    for i, ((width, height), estimate) in enumerate(zip(shapes, estimates, strict=True)):
        run = data[offsets[i] : offsets[i + 1]]
        for name, options in _tools(run.tobytes(), float(bits[i]), *estimate).items():
            image = np.zeros((height, width, 4), np.uint8)
            image[:, :, 1], image[:, :, 3] = run.reshape(height, width), 255
            stored = encode(image, **options)
            if len(stored) < len(out[i]):
                out[i], names[i] = stored, name
    return out, names


class _Known:
    """Heads of code tables met before, compared bit by bit."""

    def __init__(self):
        self.heads: list[tuple[int, int, list[Prefix]]] = []

    def codes(self, r: Reader, chunk: bytes) -> list[Prefix]:
        ahead = int.from_bytes(chunk[r.at >> 3 : (r.at >> 3) + 256], "little") >> (r.at & 7)
        for value, n, codes in self.heads:
            if ahead & ((1 << n) - 1) == value and r.at + n <= r.end:
                r.at += n
                return codes
        start = r.at
        codes = [read_prefix(r, n) for n in ALPHABETS]
        n = r.at - start
        if n < 1900 and len(self.heads) < 32:
            self.heads.append((ahead & ((1 << n) - 1), n, codes))
        return codes


def decode_bytes(stored: list[bytes]) -> list[bytes]:
    """The green channel of each image, in row order.  Images without
    transforms, cache or entropy image whose other channels are constant and
    whose green code is short go in lock step; any other is decoded whole."""
    out: list = [None] * len(stored)
    lanes = []
    known = _Known()
    for i, data in enumerate(stored):
        chunk = _chunk(data)
        r = Reader(chunk)
        width, height = _header(r)
        if r.read(3) == 0:
            green, *rest = known.codes(r, chunk)
            if green.most < 256 and green.bits <= SHORT and all(c.bits == 0 for c in rest):
                lanes.append((width * height, i, chunk, r.at, green))
                continue
        out[i] = decode(data)[:, :, 1].tobytes()
    if not lanes:
        return out
    lanes.sort(key=lambda x: -x[0])
    total = np.array([x[0] for x in lanes])
    base = np.cumsum([0, *(len(x[2]) + 4 for x in lanes)])
    stream = np.frombuffer(b"".join(x[2] + b"\0\0\0\0" for x in lanes), np.uint8).astype(np.uint32)
    window = stream[:-3] | stream[1:-2] << 8 | stream[2:-1] << 16
    bits = np.array([x[4].bits for x in lanes])
    mask = ((1 << bits) - 1).astype(np.uint32)
    codes = {id(x[4]): x[4] for x in lanes}
    table = np.concatenate([c.table for c in codes.values()])
    place = dict(zip(codes, np.cumsum([0, *(len(c.table) for c in codes.values())])))
    first = np.array([place[id(x[4])] for x in lanes])
    at = 8 * base[:-1] + np.array([x[3] for x in lanes])
    start = np.cumsum([0, *total])[:-1]
    flat = np.zeros(int(total.sum()), np.uint8)
    # Lanes are in order of length, so those not done are the first ones.
    left = np.searchsorted(-total, -np.arange(int(total[0]) + 1), side="left")
    step = 0
    while step < total[0] and left[step] > FEW:
        n = left[step]
        stop = step
        while stop < total[0] and left[stop] == n:
            stop += 1
        p, m, f, s = at[:n].copy(), mask[:n], first[:n].astype(np.uint32), start[:n] + step  # a copy
        for _ in range(step, stop):
            entry = table[f + ((window[p >> 3] >> (p & 7).astype(np.uint32)) & m)]
            flat[s] = entry >> 4
            p += entry & 15
            s += 1
        at[:n] = p
        step = stop
    for k in range(left[step] if step < total[0] else 0):
        code, own = lanes[k][4], lanes[k][2]
        entries, cut, p = code.table.tolist(), (1 << code.bits) - 1, int(at[k] - 8 * base[k])
        text = bytearray()
        put, lo, hold, have = text.append, p >> 3, 0, 0
        hold = int.from_bytes(own[lo : lo + 512], "little") >> (p & 7)
        have = 8 * 512 - (p & 7)
        lo += 512
        for _ in range(int(total[k]) - step):
            if have < 16:
                hold |= int.from_bytes(own[lo : lo + 512], "little") << have
                have += 8 * 512
                lo += 512
            entry = entries[hold & cut]
            put(entry >> 4)
            hold >>= entry & 15
            have -= entry & 15
        flat[start[k] + step : start[k] + total[k]] = np.frombuffer(bytes(text), np.uint8)
    for k, (n, i, *_) in enumerate(lanes):
        out[i] = flat[start[k] : start[k] + n].tobytes()
    return out
