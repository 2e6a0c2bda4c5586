"""Lossless WebP: a decoder of the whole format, and an encoder for payloads.

Decoding.  ``decode_stream`` decodes one VP8L bit stream in plain Python, with everything the
format has: several prefix code groups, back-references, colour cache, and the predictor,
cross-colour, subtract-green and palette transforms.  ``decode_streams`` decodes many at once
in numpy: every stream is a lane, and each step reads one token of every lane; copies and cache
hits then get their pixels all at once.  Streams with several code groups, with codes of over
``DEEP`` bits, or that read cache slots before they are set, go the first way.

Encoding.  A payload's bytes are the samples of an image of ``WIDTH`` pixels, blue, green, red
and alpha in turn, in strips of up to ``ROWS`` rows.  One strip makes a simple file; several make
an extended file with one frame a strip, which tile the canvas.  Equal runs of pixels become
back-references, recent pixels colour cache codes, the rest literals, all in prefix codes of
up to ``DEEPEST`` bits.  Strips of few colours take the palette.  Text gains
little from the other transforms; a checksum of the strip picks none (5 of 8), predictor,
cross-colour, or subtract-green with predictor, so that what is stored holds all of them.

Edge cases: a null text is the empty one, whose payload is 64 zero bytes.  Equal texts give
equal files.  A payload may have up to 2^24 rows (1 GiB).  Damaged files raise ValueError.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH, ROWS = 16, 128
UNIT = 4 * WIDTH
CACHE_BITS = 6
DEEPEST, DEEP = 10, 11
#: Pixels that are encoded at once, about.
BATCH = 1_000_000
#: Pixels, and payloads at most, that are decoded at once: more lanes share the steps' cost.
LANES, FILES = 2_000_000, 4096
#: Steps between two looks for lanes that have ended.
SWEEP = 16
#: Copies of fewer pixels than this are not worth it.
SHORTEST = 3
#: Tiles of transforms are 2^TILE pixels wide and high.
TILE = 4

# Fixed values of the format.
#: In this order come the lengths of the code that codes code lengths.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Distance codes from 1 on: columns to the left, rows up.
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS, GREEN, PALETTE = 0, 1, 2, 3
LENGTHS, LITERALS = 24, 256
ALPHABETS = (LITERALS + LENGTHS, 256, 256, 256, 40)


# ---------------------------------------------------------------- reading streams


class Bits:
    """Reads bits from the lowest of the first byte on."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data + b"\0" * 8, 0
        self.end = 8 * len(data)

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise ValueError("the stream is cut short")
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 5], "little") >> (at & 7)) & ((1 << n) - 1)


class Code:
    """A prefix code: symbols in order of their codes, and their lengths; a lone symbol has length 0."""

    def __init__(self, symbols: list[int], lengths: list[int]) -> None:
        if len(symbols) == 1:
            lengths = [0]
        elif sum(1 << (15 - n) for n in lengths) != 1 << 15:
            raise ValueError("a prefix code isn't complete")
        pairs = sorted(zip(lengths, symbols, strict=True))
        self.symbols, self.lengths = [s for _, s in pairs], [n for n, _ in pairs]
        self.depth = self.lengths[-1]
        self.table: list[int] | None = None

    def decode(self, bits: Bits) -> int:
        if self.table is None:
            self.table = table(self.symbols, self.lengths, self.depth).tolist()
        at = bits.at
        got = self.table[(int.from_bytes(bits.data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7)) & ((1 << self.depth) - 1)]
        bits.at = at + (got & 15)
        return got >> 4


def _reversal(depth: int) -> np.ndarray:
    out = np.zeros(1, np.int64)
    for _ in range(depth):
        out = np.concatenate((out * 2, out * 2 + 1))
    return out


#: For each depth, the numbers below 2^depth with their bits in reverse order.
REVERSALS = [_reversal(depth) for depth in range(16)]


def table(symbols: list[int], lengths: list[int], depth: int) -> np.ndarray:
    """symbol << 4 | length for every value of the next ``depth`` bits; symbols are in order of their codes."""
    entry = np.array(symbols, np.int32) << 4 | np.array(lengths, np.int32)
    return np.repeat(entry, 1 << (depth - (entry & 15)))[REVERSALS[depth]]


def tables(lengths: np.ndarray, lone: np.ndarray, depth: int) -> np.ndarray:
    """A row a code, as table() has it; lone: the symbol of a code that has but one, else -1."""
    lane, symbol = np.nonzero(lengths * (lone < 0)[:, None])
    single = np.flatnonzero(lone >= 0)
    n = np.concatenate((lengths[lane, symbol], np.zeros(len(single), lengths.dtype))).astype(np.int64)
    lane, symbol = np.concatenate((lane, single)), np.concatenate((symbol, lone[single]))
    order = np.argsort((lane * 16 + n).astype(np.uint16 if len(lengths) <= 4096 else np.int64), kind="stable")  # symbols are in order already
    full = np.repeat((symbol << 4 | n)[order].astype(np.int32), 1 << (depth - n[order]))  # by codes from their first bit on
    return full.reshape(len(lengths), 1 << depth)[:, REVERSALS[depth]]


def read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)]
        if two:
            symbols.append(bits.read(8))
            if symbols[0] == symbols[1]:
                raise ValueError("a prefix code isn't complete")
        return Code(symbols, [1] * len(symbols))
    own = [0] * 19
    for i in range(4 + bits.read(4)):
        own[LENGTH_ORDER[i]] = bits.read(3)
    used = [i for i, n in enumerate(own) if n]
    if not used:
        raise ValueError("a prefix code is empty")
    code = Code(used, [own[i] for i in used])
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    known, mask, data = table(code.symbols, code.lengths, code.depth).tolist(), (1 << code.depth) - 1, bits.data
    symbols, lengths, i, last, at = [], [], 0, 8, bits.at
    while i < size and most:
        most -= 1
        window = int.from_bytes(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)
        got = known[window & mask]
        n = got & 15
        window >>= n
        at += n
        got >>= 4
        if got < 16:
            if got:
                symbols.append(i)
                lengths.append(got)
                last = got
            i += 1
        elif got == 16:
            for _ in range(3 + (window & 3)):
                symbols.append(i)
                lengths.append(last)
                i += 1
            at += 2
        elif got == 17:
            i += 3 + (window & 7)
            at += 3
        else:
            i += 11 + (window & 127)
            at += 7
    bits.at = at
    if at > bits.end or i > size or not symbols:
        raise ValueError("a prefix code is damaged")
    return Code(symbols, lengths)


def read_group(bits: Bits, cache: int) -> list[Code]:
    return [read_code(bits, n + (cache if k == 0 else 0)) for k, n in enumerate(ALPHABETS)]


def spread(bits: Bits, code: int) -> int:
    """A length or distance from its prefix and further bits."""
    if code < 4:
        return code + 1
    more = (code - 2) >> 1
    return ((2 + (code & 1)) << more) + bits.read(more) + 1


def distances(width: int) -> np.ndarray:
    """Distances of the codes from 1 to 120 (index 0 is unused) in an image of this width."""
    return np.array([0] + [max(1, x + y * width) for x, y in NEIGHBOURS], np.int64)


def tiles(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def read_image(bits: Bits, width: int, height: int, main: bool = False) -> list[int]:
    """Pixels of an entropy-coded image, one by one."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11 or (bits.at > bits.end):
        raise ValueError("the colour cache is too large")
    meta, meta_bits, groups = None, 0, 1
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta = [p >> 8 & 0xFFFF for p in read_image(bits, tiles(width, meta_bits), tiles(height, meta_bits))]
        groups = max(meta) + 1
    cache = [0] * (1 << cache_bits) if cache_bits else []
    codes = [read_group(bits, len(cache)) for _ in range(groups)]
    near, out, total, shift = distances(width).tolist(), [], width * height, 32 - cache_bits
    across = tiles(width, meta_bits)
    while len(out) < total:
        i = len(out)
        green, red, blue, alpha, far = codes[meta[(i // width >> meta_bits) * across + (i % width >> meta_bits)] if meta else 0]
        s = green.decode(bits)
        if s < LITERALS:
            r = red.decode(bits)
            b = blue.decode(bits)
            out.append(alpha.decode(bits) << 24 | r << 16 | s << 8 | b)
        elif s < LITERALS + LENGTHS:
            n = spread(bits, s - LITERALS)
            d = spread(bits, far.decode(bits))
            d = near[d] if d <= 120 else d - 120
            if d > i or n > total - i:
                raise ValueError("a back-reference leaves the image")
            for _ in range(n):
                out.append(out[-d])
        else:
            out.append(cache[s - LITERALS - LENGTHS])
        if cache:
            for p in out[i:]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
        if bits.at > bits.end:
            raise ValueError("the stream is cut short")
    return out


class Head:
    """What comes before a stream's pixels: size and transforms."""

    def __init__(self, data: bytes) -> None:
        self.bits = bits = Bits(data)
        if bits.read(8) != 0x2F:
            raise ValueError("not a lossless stream")
        self.width, self.height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        if bits.read(3):
            raise ValueError("an unknown version")
        self.coded = self.width  # pixels of a row as coded
        self.transforms: list[tuple] = []
        while bits.read(1):
            kind = bits.read(2)
            if kind in [t[0] for t in self.transforms]:
                raise ValueError("a transform comes twice")
            if kind in (PREDICTOR, CROSS):
                size = bits.read(3) + 2
                self.transforms.append((kind, self.coded, size, read_image(bits, tiles(self.coded, size), tiles(self.height, size))))
            elif kind == GREEN:
                self.transforms.append((kind, self.coded))
            else:
                n = bits.read(8) + 1
                palette = np.array(read_image(bits, n, 1), "<u4").view(np.uint8).reshape(n, 4).astype(np.int64).cumsum(axis=0).astype(np.uint8)
                pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                self.transforms.append((kind, self.coded, pack, palette.view("<u4").ravel()))
                self.coded = tiles(self.coded, pack)


# ---------------------------------------------------------------- inverse transforms


def _predictions(mode: int, left, top, right, corner):
    """The prediction of a mode from four neighbours; int16 samples in the last axis."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 0 or mode > 13:
        out = np.zeros_like(left)
        out[..., 3] = 255
        return out
    if mode == 11:
        by_left = abs(top - corner).sum(axis=-1, keepdims=True)
        return np.where(by_left < abs(left - corner).sum(axis=-1, keepdims=True), left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        a = mean(left, top)
        gap = a - corner
        return np.clip(a + np.where(gap < 0, -(-gap >> 1), gap >> 1), 0, 255)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner,
        5: lambda: mean(mean(left, right), top), 6: lambda: mean(left, corner), 7: lambda: mean(left, top), 8: lambda: mean(corner, top), 9: lambda: mean(top, right),
        10: lambda: mean(mean(left, corner), mean(top, right)),
    }[mode]()


def modes_of(transform: tuple, width: int, height: int) -> np.ndarray:
    """Each pixel's predictor mode; the first row and column have fixed ones."""
    _, _, size, image = transform
    grid = np.array(image, np.int64).reshape(tiles(height, size), -1) >> 8 & 15
    out = grid[np.arange(height)[:, None] >> size, np.arange(width)[None, :] >> size]
    out[0, :], out[:, 0], out[0, 0] = 1, 2, 0
    return out


def undo_predictors(images: list[np.ndarray], transforms: list[tuple]) -> None:
    """Adds predictions in place, pixel by pixel, to images of one width together; samples are (rows, width, 4) uint8."""
    width = images[0].shape[1]
    order = sorted(range(len(images)), key=lambda i: -len(images[i]))
    heights = np.array([len(images[i]) for i in order])
    most = int(heights[0])
    work = np.zeros((len(order), most, width, 4), np.int16)
    modes = np.zeros((len(order), most, width), np.int8)
    for row, i in enumerate(order):
        work[row, : heights[row]] = images[i]
        modes[row, : heights[row]] = modes_of(transforms[i], width, len(images[i]))
    flat, modes = work.reshape(len(order), most * width, 4), modes.reshape(len(order), most * width)
    zero = np.zeros((len(order), 4), np.int16)
    for y in range(most):
        live = int((heights > y).sum())
        for x in range(width):
            at = y * width + x
            left = flat[:live, at - 1] if at else zero
            top, corner = (flat[:live, at - width], flat[:live, at - width - 1] if at > width else zero) if y else (zero, zero)
            right = flat[:live, at - width + 1] if y else zero
            own = modes[:live, at]
            kinds = np.unique(own)
            if len(kinds) == 1:
                add = _predictions(int(kinds[0]), left, top, right, corner)
                flat[:live, at] = (flat[:live, at] + add[:live]) & 255
            else:
                for m in kinds:
                    i = np.flatnonzero(own == m)
                    flat[i, at] = (flat[i, at] + _predictions(int(m), left[i], top[i], right[i], corner[i])) & 255
    for row, i in enumerate(order):
        images[i][:] = work[row, : heights[row]].astype(np.uint8)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int32)


def _elements(transform: tuple, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """green to red, green to blue, red to blue of each pixel."""
    _, _, size, image = transform
    grid = np.array(image, np.int64).reshape(tiles(height, size), -1)
    grid = grid[np.arange(height)[:, None] >> size, np.arange(width)[None, :] >> size]
    return tuple(_signed(grid >> s & 255) for s in (0, 8, 16))


def cross_colour(image: np.ndarray, transform: tuple, sign: int) -> np.ndarray:
    """Adds (sign 1: decoding) or takes off (-1: encoding) what other channels tell of red and blue."""
    by_red, by_green, by_both = _elements(transform, image.shape[1], image.shape[0])
    blue, green, red = (image[..., i].astype(np.int32) for i in (0, 1, 2))
    new_red = red + sign * (by_red * _signed(green) >> 5)
    real_red = new_red if sign > 0 else red
    new_blue = blue + sign * ((by_green * _signed(green) >> 5) + (by_both * _signed(real_red & 255) >> 5))
    out = image.copy()
    out[..., 0], out[..., 2] = new_blue & 255, new_red & 255
    return out


def unpack(image: np.ndarray, transform: tuple) -> np.ndarray:
    """Colours of indices that may be packed into the green channel."""
    _, width, pack, palette = transform
    x, step = np.arange(width), 8 >> pack
    index = image[:, x >> pack, 1].astype(np.int64) >> ((x & ((1 << pack) - 1)) * step) & ((1 << step) - 1)
    known = np.append(palette, 0)
    return np.ascontiguousarray(known[np.minimum(index, len(palette))], "<u4").view(np.uint8).reshape(len(image), width, 4)


def undo(heads: list[Head], images: list[np.ndarray]) -> list[np.ndarray]:
    """Inverts all transforms, the last first; images are (rows, width, 4) samples: blue, green, red, alpha."""
    out = list(images)
    for back in range(4):
        together: dict[int, list[int]] = {}
        for i, h in enumerate(heads):
            if back >= len(h.transforms):
                continue
            t = h.transforms[-1 - back]
            if t[0] == PREDICTOR:
                together.setdefault(t[1], []).append(i)
            elif t[0] == CROSS:
                out[i] = cross_colour(out[i], t, 1)
            elif t[0] == GREEN:
                out[i] = out[i].copy()
                out[i][..., 0] += out[i][..., 1]
                out[i][..., 2] += out[i][..., 1]
            else:
                out[i] = unpack(out[i], t)
        for own in together.values():
            some = [out[i].copy() for i in own]
            undo_predictors(some, [heads[i].transforms[-1 - back] for i in own])
            for i, image in zip(own, some, strict=True):
                out[i] = image
    return out


def samples(pixels, height: int, width: int) -> np.ndarray:
    return np.asarray(pixels, "<u4").view(np.uint8).reshape(height, width, 4)


def decode_stream(data: bytes) -> np.ndarray:
    """(rows, width, 4) samples: blue, green, red, alpha."""
    head = Head(data)
    return undo([head], [samples(read_image(head.bits, head.coded, head.height, main=True), head.height, head.coded)])[0]


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """decode_stream() of each."""
    heads = [Head(data) for data in streams]
    starts, lanes, caches = [h.bits.at for h in heads], [], []
    for i, h in enumerate(heads):
        cache_bits = h.bits.read(4) if h.bits.read(1) else 0
        if not h.bits.read(1):
            lanes.append(i)
            caches.append(cache_bits)
    try:
        groups = read_groups([heads[i].bits for i in lanes], [1 << b if b else 0 for b in caches])
        deep = np.max([lengths.max(axis=1, initial=0) for lengths, _ in groups], axis=0) if lanes else np.zeros(0)
        flat = np.flatnonzero(deep <= DEEP)
        held = np.cumsum([heads[lanes[i]].coded * heads[lanes[i]].height for i in flat]) // LANES
        done = {}
        for part in np.split(flat, np.flatnonzero(np.diff(held)) + 1):
            own = [lanes[i] for i in part]
            got = _lockstep([heads[i] for i in own], [caches[i] for i in part], [(a[part], b[part]) for a, b in groups])
            done |= {i: pixels for i, pixels in zip(own, got, strict=True) if pixels is not None}
    except IndexError as e:
        raise ValueError("a stream is cut short") from e
    out = []
    for i, h in enumerate(heads):
        if i not in done:
            h.bits.at = starts[i]
            done[i] = read_image(h.bits, h.coded, h.height, main=True)
        out.append(samples(done[i], h.height, h.coded))
    return undo(heads, out)


#: By symbol of a code of code lengths: further bits, and the least number of lengths it stands for.
_RUN_BITS = np.array([0] * 16 + [2, 3, 7], np.int64)
_RUN_LEAST = np.array([1] * 16 + [3, 3, 11], np.int64)


def read_groups(lanes: list[Bits], caches: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """read_group() of all lanes: for each channel the lengths (a row a lane), and lone symbols (else -1)."""
    n, out = len(lanes), []
    data = b"".join(b.data for b in lanes)
    base = np.concatenate(([0], np.cumsum([len(b.data) for b in lanes]))) * 8
    window = np.ndarray(max(len(data) - 7, 0), "<u8", data, strides=(1,))
    seen: dict[tuple, int] = {}
    known: list[np.ndarray] = []
    for k, alphabet in enumerate(ALPHABETS):
        size = np.array([alphabet + (c if k == 0 else 0) for c in caches], np.int64)
        lengths, lone = np.zeros((n, int(size.max(initial=0))), np.int64), np.full(n, -1)
        rows, which, most = [], [], []
        for i, bits in enumerate(lanes):
            ahead = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 9], "little") >> (bits.at & 7)
            if ahead & 3 == 1:  # a lone symbol
                wide = 8 if ahead & 4 else 1
                lone[i] = ahead >> 3 & ((1 << wide) - 1)
                bits.at += 3 + wide
                if bits.at > bits.end:
                    raise ValueError("the stream is cut short")
                if lone[i] >= size[i]:
                    raise ValueError("a prefix code is damaged")
                continue
            if ahead & 1:
                code = read_code(bits, int(size[i]))
                if max(code.symbols) >= size[i]:
                    raise ValueError("a prefix code is damaged")
                lengths[i, code.symbols] = code.lengths
                continue
            count = 4 + (ahead >> 1 & 15)
            word = ahead >> 5 & ((1 << 3 * count) - 1)
            bits.at += 5 + 3 * count
            if (count, word) not in seen:  # streams of one writer often share this code
                used = {LENGTH_ORDER[j]: word >> 3 * j & 7 for j in range(count) if word >> 3 * j & 7}
                if not used:
                    raise ValueError("a prefix code is empty")
                code = Code(list(used), list(used.values()))
                seen[count, word] = len(known)
                known.append(table(code.symbols, code.lengths, 7))
            rows.append(i)
            which.append(seen[count, word])
            most.append(2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else int(size[i]))
        if rows:
            row, books = np.array(rows), np.concatenate(known)
            book, left, limit = np.array(which) << 7, np.array(most), size[row]
            pos = base[row] + np.array([lanes[i].at for i in rows])
            at, last = np.zeros(len(row), np.int64), np.full(len(row), 8)
            live = np.arange(len(row))
            while len(live):
                p = pos[live]
                v = window[p >> 3] >> (p & 7).astype(np.uint64)
                got = books[book[live] + (v & np.uint64(127)).astype(np.int64)]
                symbol, used = got >> 4, got & 15
                v = (v >> used.astype(np.uint64)).astype(np.int64)
                plain, again = symbol < 16, symbol == 16
                more = _RUN_BITS[symbol]
                step = _RUN_LEAST[symbol] + (v & ((1 << more) - 1))
                pos[live] = p + used + more
                if (at[live] + step > limit[live]).any():
                    raise ValueError("a prefix code is damaged")
                i = live[plain]
                lengths[row[i], at[i]] = symbol[plain]
                i = live[plain & (symbol > 0)]
                last[i] = symbol[plain & (symbol > 0)]
                if again.any():
                    i = np.repeat(live[again], step[again])
                    spot = at[i] + np.arange(len(i)) - np.repeat(np.cumsum(step[again]) - step[again], step[again])
                    lengths[row[i], spot] = last[i]
                at[live] += step
                left[live] -= 1
                live = live[(at[live] < limit[live]) & (left[live] > 0)]
            for i, p in zip(rows, (pos - base[row]).tolist(), strict=True):
                lanes[i].at = p
                if p > lanes[i].end:
                    raise ValueError("the stream is cut short")
            used = (lengths[row] > 0).sum(axis=1)
            full = np.where(lengths[row] > 0, 1 << 15 >> lengths[row], 0).sum(axis=1)
            if (used == 0).any() or ((used > 1) & (full != 1 << 15)).any():
                raise ValueError("a prefix code isn't complete")
            single = row[used == 1]
            lone[single] = lengths[single].argmax(axis=1)
            lengths[single] = 0
        out.append((lengths, lone))
    return out


#: A length or distance by its prefix: least value, and number of further bits.
_LEAST = np.array([c + 1 if c < 4 else ((2 + (c & 1)) << ((c - 2) >> 1)) + 1 for c in range(40)], np.int64)
_FURTHER = np.array([0 if c < 4 else (c - 2) >> 1 for c in range(40)], np.int64)


def _tokens(heads: list[Head], count: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], tuple[np.ndarray, ...]]:
    """All lanes' tokens, one of every lane a step, as what they say doesn't depend on pixels.

    First lane, pixel and the four channels' symbols; then lane, pixel, length and distance code of back-references.
    """
    data = b"".join(h.bits.data for h in heads) + b"\0" * 32 * SWEEP
    starts = np.concatenate(([0], np.cumsum([len(h.bits.data) for h in heads])[:-1])) * 8
    pos = starts + np.array([h.bits.at for h in heads])
    ends = starts + np.array([h.bits.end for h in heads])
    window = np.ndarray(len(data) - 7, "<i8", data, strides=(1,))  # of its 64 bits, a token takes up to 7 + 50
    luts, masks, rows = [], [], []
    for lengths, single in groups:
        depth = max(int(lengths.max(initial=0)), 1)
        luts.append(tables(lengths, single, depth).astype(np.uint16).ravel())
        masks.append((1 << depth) - 1)
        rows.append(np.arange(len(heads), dtype=np.int64) << depth)
    lane, at, total = np.arange(len(heads), dtype=np.int32), np.zeros(len(heads), np.int32), count.astype(np.int32)
    steps, refs, i = [], [], 0
    while True:
        if i % SWEEP == 0:  # lanes that end in between read on, and what they read is dropped below
            live = np.flatnonzero(at < total)
            if (pos[live] > ends[live]).any():
                raise ValueError("a stream is cut short")
            if not len(live):
                break
            pos, ends, lane, at, total = pos[live], ends[live], lane[live], at[live], total[live]
            rows = [r[live] for r in rows]
        i += 1
        v = window[pos >> 3] >> (pos & 7)
        green = luts[0][rows[0] + (v & masks[0])]
        used = (green & 15).astype(np.int64)
        v >>= used
        w = v
        symbols = []
        for k in (1, 2, 3):
            got = luts[k][rows[k] + (w & masks[k])]
            n = got & 15
            if k < 3:
                w = w >> n
            used += n
            symbols.append(got)
        other = np.flatnonzero(green >= LITERALS << 4)
        after = at + np.int32(1)
        if len(other):
            got = green[other]
            used[other] = got & 15
            is_ref = got < LITERALS + LENGTHS << 4
            ref = other[is_ref]
            if len(ref):
                x, code = v[ref], (got[is_ref] >> 4) - LITERALS
                more = _FURTHER[code]
                n = _LEAST[code] + (x & ((1 << more) - 1))
                x >>= more
                got = luts[4][rows[4][ref] + (x & masks[4])]
                code = got >> 4
                x >>= got & 15
                further = _FURTHER[code]
                used[ref] += more + further + (got & 15)
                after[ref] += (n - 1).astype(np.int32)
                refs.append((lane[ref], at[ref], n, _LEAST[code] + (x & ((1 << further) - 1))))
        pos = pos + used
        steps.append((lane, at, green, *symbols, pos > ends))
        at = after
    lane, at, *symbols, beyond = (np.concatenate(c) for c in zip(*steps, strict=True))
    own = np.flatnonzero(at < count[lane])
    if beyond[own].any():
        raise ValueError("a stream is cut short")
    lane, at, *symbols = (c[own] for c in (lane, at, *symbols))
    kept = tuple(np.concatenate(c) for c in zip(*refs, strict=True)) if refs else (np.zeros(0, np.int64),) * 4
    inside = kept[1] < count[kept[0]]
    return [lane, at, *symbols], tuple(c[inside] for c in kept)


def _followed(source: np.ndarray, at: np.ndarray) -> None:
    """Has the places ``at`` point to where their sources come from in the end; others point to themselves."""
    while len(at):
        near = source[at]
        far = source[near]
        source[at] = far
        at = at[far != near]


def _lockstep(heads: list[Head], cache_bits: list[int], groups: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray | None]:
    """The coded pixels of all lanes; None: a lane that reads cache slots before they are set.

    Every pixel that isn't a literal has a source before it.  A copy's is known.  A hit's is the last
    pixel of its slot; a hit has the slot it names, a literal that of its hash, a copy its source's.
    """
    if not heads:
        return []
    count = np.array([h.coded * h.height for h in heads])
    base = np.concatenate(([0], np.cumsum(count)))
    (lane, at, green, *symbols), (r_lane, r_at, r_n, r_gap) = _tokens(heads, count, groups)
    at = base[lane] + at
    out, source = np.zeros(int(base[-1]), np.uint32), np.arange(base[-1], dtype=np.int32)
    is_hit = green >= LITERALS + LENGTHS << 4
    plain, hit = np.flatnonzero(green < LITERALS << 4), np.flatnonzero(is_hit)
    argb = (green[plain] >> 4).astype(np.uint32) << np.uint32(8)
    for got, shift in zip(symbols, (16, 0, 24), strict=True):
        argb |= (got[plain] >> 4).astype(np.uint32) << np.uint32(shift)
    out[at[plain]] = argb
    copies = np.zeros(0, np.int64)
    if len(r_n):
        widths, shape = np.unique([h.coded for h in heads], return_inverse=True)
        near = np.stack([distances(int(w)) for w in widths])
        gap = np.where(r_gap <= 120, near[shape[r_lane], np.minimum(r_gap, 120)], r_gap - 120)
        if (gap > r_at).any() or (r_n > count[r_lane] - r_at).any():
            raise ValueError("a back-reference leaves the image")
        copies = np.repeat(base[r_lane] + r_at - (np.cumsum(r_n) - r_n), r_n) + np.arange(int(r_n.sum()))
        source[copies] = copies - np.repeat(gap, r_n)
        _followed(source, copies)
    bad: set[int] = set()
    hits = at[hit]
    if len(hits):
        bits = np.maximum(cache_bits, 1).astype(np.uint32)
        slot = (out * np.uint32(CACHE_FACTOR) >> np.repeat(np.uint32(32) - bits, count)).astype(np.uint16)
        slot[hits] = (green[hit] >> 4) - (LITERALS + LENGTHS)
        slot[copies] = slot[source[copies]]
        from_cache = np.zeros(len(out), bool)
        from_cache[hits] = True
        top = int(bits.max())
        for lo in range(0, len(heads), 1 << 16 - top):  # as many lanes as 16 bits can tell apart
            hi = min(lo + (1 << 16 - top), len(heads))
            a, z = base[lo], base[hi]
            key = np.repeat(np.arange(hi - lo, dtype=np.uint16) << np.uint16(top), count[lo:hi]) | slot[a:z]
            order = np.argsort(key, kind="stable")
            asks = from_cache[a:z][order]
            last = np.maximum.accumulate(np.where(asks, 0, np.arange(len(order))))
            asks = np.flatnonzero(asks)
            mine, theirs = order[asks], order[last[asks]]
            unset = (key[mine] != key[theirs]) | from_cache[a + theirs]
            source[a + mine] = np.where(unset, mine, theirs) + a
            bad |= set((np.searchsorted(base, a + mine[unset], "right") - 1).tolist())
        _followed(source, np.concatenate((hits, copies)))
    for i in (copies, hits):
        out[i] = out[source[i]]
    return [None if i in bad else out[base[i] : base[i + 1]] for i in range(len(heads))]


# ---------------------------------------------------------------- containers


def chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def _u24(n: int) -> bytes:
    return struct.pack("<I", n)[:3]


def wrap(streams: list[bytes], heights: list[int]) -> bytes:
    """A file of one stream, or of several as frames one below the other."""
    if len(streams) == 1:
        body = chunk(b"VP8L", streams[0])
    else:
        body = chunk(b"VP8X", struct.pack("<I", 0x12) + _u24(WIDTH - 1) + _u24(sum(heights) - 1)) + chunk(b"ANIM", b"\0" * 6)
        y, parts = 0, []
        for s, h in zip(streams, heights, strict=True):
            parts.append(chunk(b"ANMF", _u24(0) + _u24(y // 2) + _u24(WIDTH - 1) + _u24(h - 1) + _u24(0) + b"\2" + chunk(b"VP8L", s)))
            y += h
        body += b"".join(parts)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def chunks_of(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > len(data):
            raise ValueError("a chunk is cut short")
        yield name, data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


def frames_of(data: bytes) -> tuple[int, int, list[tuple[int, int, bytes]]]:
    """Canvas width and height (0: that of the one frame), and (x, y, stream) of every frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    width = height = 0
    frames = []
    for name, part in chunks_of(data[12 : 8 + struct.unpack_from("<I", data, 4)[0]]):
        if name == b"VP8L":
            frames.append((0, 0, part))
        elif name == b"VP8X":
            width, height = int.from_bytes(part[4:7], "little") + 1, int.from_bytes(part[7:10], "little") + 1
        elif name == b"ANMF":
            x, y = 2 * int.from_bytes(part[:3], "little"), 2 * int.from_bytes(part[3:6], "little")
            frames += [(x, y, own) for kind, own in chunks_of(part[16:]) if kind == b"VP8L"]
    if not frames:
        raise ValueError("no lossless image in the file")
    return width, height, frames


def decode_files(files: list[bytes]) -> list[np.ndarray]:
    """Each file's canvas as (rows, width, 4) samples: blue, green, red, alpha."""
    parsed = [frames_of(f) for f in files]
    images = iter(decode_streams([s for _, _, frames in parsed for _, _, s in frames]))
    out = []
    for width, height, frames in parsed:
        own = [next(images) for _ in frames]
        if len(own) == 1 and not width:
            out.append(own[0])
            continue
        canvas = np.zeros((height, width, 4), np.uint8)
        for (x, y, _), image in zip(frames, own, strict=True):
            canvas[y : y + image.shape[0], x : x + image.shape[1]] = image
        out.append(canvas)
    return out


def decode_file(data: bytes) -> np.ndarray:
    return decode_files([data])[0]


# ---------------------------------------------------------------- writing streams


class Accumulator:
    """Bits of a stream's head, the first the lowest."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def even_lengths(n: int) -> list[int]:
    """Lengths of a complete code for n symbols that are as even as can be."""
    depth = (n - 1).bit_length()
    short = (1 << depth) - n
    return [depth - 1] * short + [depth] * (n - short)


#: The code of code lengths that is always written: symbols of 3 bits, and of 4 bits.
_LENGTH_CODE = {17: 3, 18: 3, 6: 3} | dict.fromkeys((0, 1, 2, 3, 4, 5, 7, 8, 9, 10), 4)


def _length_codes() -> tuple[np.ndarray, np.ndarray]:
    values, sizes, at = np.zeros(19, np.int64), np.zeros(19, np.int64), 0
    for n, s in sorted((n, s) for s, n in _LENGTH_CODE.items()):
        values[s], sizes[s] = int(f"{at >> (4 - n):0{n}b}"[::-1], 2), n
        at += 1 << (4 - n)
    return values, sizes


_LENGTH_VALUES, _LENGTH_SIZES = _length_codes()
#: A normal code up to its lengths: kind, count of lengths, the lengths' own lengths, no largest symbol.
_NORMAL = sum(v << at for v, at in [(15, 1), *((_LENGTH_CODE.get(s, 0), 5 + 3 * i) for i, s in enumerate(LENGTH_ORDER))])
_NORMAL_BITS = 5 + 3 * 19 + 1


def put_small(acc: Accumulator, pixels: list[int]) -> None:
    """An entropy-coded image without cache, in codes of even lengths: for palettes and transforms."""
    acc.put(0, 1)
    channels = [[p >> s & 255 for p in pixels] for s in (8, 16, 0, 24)]
    books = []
    for values in channels:
        used = sorted(set(values))
        if len(used) == 1:
            acc.put(1 | 1 << 2 | used[0] << 3, 11)
            books.append({used[0]: (0, 0)})
            continue
        lengths = dict(zip(used, even_lengths(len(used)), strict=True))
        acc.put(_NORMAL, _NORMAL_BITS)
        size = ALPHABETS[len(books)]
        at = 0
        for s in [*used, size]:
            while at < s:
                run = min(s - at, 138)
                symbol, more, extra = (18, 7, run - 11) if run >= 11 else (17, 3, run - 3) if run >= 3 else (0, 0, 0)
                acc.put(int(_LENGTH_VALUES[symbol]) | extra << int(_LENGTH_SIZES[symbol]), int(_LENGTH_SIZES[symbol]) + more)
                at += run if symbol else 1
            if s < size:
                acc.put(int(_LENGTH_VALUES[lengths[s]]), int(_LENGTH_SIZES[lengths[s]]))
                at += 1
        book, at, depth = {}, 0, max(lengths.values())
        for n, s in sorted((n, s) for s, n in lengths.items()):
            book[s] = (int(f"{at >> (depth - n):0{n}b}"[::-1], 2), n)
            at += 1 << (depth - n)
        books.append(book)
    acc.put(1, 4)  # distances: symbol 0 alone
    for i in range(len(pixels)):
        for values, book in zip(channels, books, strict=True):
            acc.put(*book[values[i]])


def _argb(image: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(image).view("<u4").reshape(image.shape[:-1])


def predicted(image: np.ndarray, modes: np.ndarray) -> np.ndarray:
    """What is left of an image when its predictions are taken off."""
    h, w, _ = image.shape
    flat = image.reshape(-1, 4).astype(np.int16)
    pad = np.concatenate((np.zeros((w + 1, 4), np.int16), flat, np.zeros((1, 4), np.int16)))
    n = h * w
    left, top, corner, right = pad[w : w + n], pad[1 : 1 + n], pad[:n], pad[2 : 2 + n]
    own, out = modes.ravel(), np.empty((n, 4), np.uint8)
    for m in np.unique(own):
        i = np.flatnonzero(own == m)
        out[i] = (flat[i] - _predictions(int(m), left[i], top[i], right[i], corner[i])) & 255
    return out.reshape(h, w, 4)


def transformed(pixels: np.ndarray) -> tuple[Accumulator, np.ndarray]:
    """A strip's head with its transforms, and its coded pixels."""
    image, acc = samples(pixels, len(pixels) // WIDTH, WIDTH), Accumulator()
    h = len(image)
    for v, n in ((0x2F, 8), (WIDTH - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
        acc.put(v, n)
    check = zlib.crc32(pixels.tobytes())
    few = max(16, min(256, len(pixels) // 8))
    # most strips have more colours in their first pixels already
    if len(set(pixels[: 2 * few].tolist())) <= few and len(colours := np.unique(pixels)) <= few:
        acc.put(1 | PALETTE << 1 | len(colours) - 1 << 3, 11)
        steps = np.diff(np.concatenate(([0], colours)).astype("<u4").view(np.uint8).reshape(-1, 4).astype(np.int16), axis=0) & 255
        put_small(acc, _argb(steps.astype(np.uint8)).tolist())
        pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        index = np.searchsorted(colours, pixels).reshape(h, tiles(WIDTH, pack), 1 << pack)
        green = (index << (np.arange(1 << pack) * (8 >> pack))).sum(axis=2)
        return acc, (0xFF000000 | green.ravel() << 8).astype(np.uint32)
    down = tiles(h, TILE)
    kind = check & 7
    if kind == 2:
        acc.put(1 | GREEN << 1, 3)
        image = image.copy()
        image[..., 0] -= image[..., 1]
        image[..., 2] -= image[..., 1]
    if kind in (0, 2):
        tile = [0xFF000000 | (5 * i + (check >> 8 & 1)) % 14 << 8 for i in range(down)]
        acc.put(1 | PREDICTOR << 1 | TILE - 2 << 3, 6)
        put_small(acc, tile)
        image = predicted(image, modes_of((PREDICTOR, WIDTH, TILE, tile), WIDTH, h))
    elif kind == 1:
        tile = [0xFF000000 | (check >> 8) * (2 * i + 1) & 0xFFFFFF for i in range(down)]
        acc.put(1 | CROSS << 1 | TILE - 2 << 3, 6)
        put_small(acc, tile)
        image = cross_colour(image, (CROSS, WIDTH, TILE, tile), -1)
    return acc, _argb(image).ravel()


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """A row a code: lengths of complete prefix codes of up to DEEPEST bits; 0 where unused or alone."""
    used = counts > 0
    many = used.sum(axis=1) > 1
    total = counts.sum(axis=1, keepdims=True)
    c = np.where(used, np.maximum(counts, total / 600), 0)
    full = c.sum(axis=1, keepdims=True)
    out = np.where(used, np.ceil(np.log2(np.maximum(full, 1e-9) / np.where(used, c, 1)) - 1e-9), 0).astype(np.int64)
    out = np.where(used, np.clip(out, 1, DEEPEST), 0)
    out[~many] = 0
    slack = np.where(many, (1 << DEEPEST) - np.where(out > 0, 1 << (DEEPEST - out), 0).sum(axis=1), 0)
    order, lane = np.argsort(-c, axis=1, kind="stable"), np.arange(len(counts))
    most = int(used.sum(axis=1).max(initial=0))
    while slack.any():  # what is free goes to the most frequent that it suffices for
        for r in range(most):
            live = np.flatnonzero(slack)
            if not len(live):
                break
            s = order[live, r]
            n = out[live, s]
            ok = (n > 1) & (1 << np.maximum(DEEPEST - n, 0) <= slack[live])
            out[live[ok], s[ok]] -= 1
            slack[live[ok]] -= 1 << (DEEPEST - n[ok])
    return out


_REVERSED = REVERSALS[DEEPEST]


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes of lengths, with their first bit lowest."""
    lane, symbol = np.nonzero(lengths)
    n = lengths[lane, symbol]
    order = np.argsort((lane * 16 + n).astype(np.uint16 if len(lengths) <= 4096 else np.int64), kind="stable")  # symbols are in order already
    unit = 1 << (DEEPEST - n[order])
    place = (np.cumsum(unit) - unit) & ((1 << DEEPEST) - 1)  # every code fills its 2^DEEPEST
    out = np.zeros(lengths.shape, np.int64)
    out[lane[order], symbol[order]] = _REVERSED[place]
    return out


def prefixed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, further bits and their number of lengths or distances (1 and more)."""
    v = x - 1
    high = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    more = np.maximum(high - 1, 0)
    code = np.where(v < 4, v, 2 * high + (v >> more & 1))
    return code, np.where(v < 4, 0, v & ((1 << more) - 1)), np.where(v < 4, 0, more)


def _code_tokens(k: int, counts: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """(lane, order, value, bits) of what announces the codes of channel k."""
    used = (counts > 0).sum(axis=1)
    out = []
    none, one, many = (np.flatnonzero(m) for m in (used == 0, used == 1, used > 1))
    at = k << 20
    out.append((none, np.full(len(none), at), np.full(len(none), 1), np.full(len(none), 4)))
    out.append((one, np.full(len(one), at), 5 | counts[one].argmax(axis=1) << 3, np.full(len(one), 11)))
    for shift in (0, 32):
        out.append((many, np.full(len(many), at + shift // 32), np.full(len(many), _NORMAL >> shift & 0xFFFFFFFF), np.full(len(many), min(32, _NORMAL_BITS - shift))))
    own = np.concatenate((lengths[many], np.full((len(many), 1), 99)), axis=1)
    width = own.shape[1]
    flat = own.ravel()
    spot = np.flatnonzero((flat > 0) & (flat < 99))
    out.append((many[spot // width], at + 2 + spot % width, _LENGTH_VALUES[flat[spot]], _LENGTH_SIZES[flat[spot]]))
    zero = np.concatenate(([False], flat == 0, [False])).astype(np.int8)
    edge = np.flatnonzero(np.diff(zero))
    start, run = edge[::2], edge[1::2] - edge[::2]
    while len(start):
        step = np.where(run >= 11, np.minimum(run, 138), np.where(run >= 3, run, 1))
        s = np.where(run >= 11, 18, np.where(run >= 3, 17, 0))
        more = np.where(s == 18, 7, np.where(s == 17, 3, 0))
        extra = np.where(s == 18, step - 11, np.where(s == 17, step - 3, 0))
        out.append((many[start // width], at + 2 + start % width, _LENGTH_VALUES[s] | extra << _LENGTH_SIZES[s], _LENGTH_SIZES[s] + more))
        start, run = start + step, run - step
        start, run = start[run > 0], run[run > 0]
    return out


def encode_streams(strips: list[np.ndarray]) -> list[bytes]:
    """VP8L streams of strips: pixels, blue in the lowest bits, in rows of WIDTH; at most 1024 strips."""
    heads, coded = zip(*(transformed(s) for s in strips), strict=True)
    n = len(strips)
    size = np.array([len(c) for c in coded])
    px = np.concatenate(coded).astype(np.uint32)
    lane = np.repeat(np.arange(n), size)
    width = np.repeat(np.array([len(c) * WIDTH // len(s) for c, s in zip(coded, strips, strict=True)]), size)
    slot = (px * np.uint32(CACHE_FACTOR) >> np.uint32(32 - CACHE_BITS)).astype(np.int64)
    key = (lane << CACHE_BITS | slot).astype(np.uint16)
    order = np.argsort(key, kind="stable")
    same = (key[order[1:]] == key[order[:-1]]) & (px[order[1:]] == px[order[:-1]])
    back = np.zeros(len(px), np.int64)  # how far back the last pixel of the slot is, if it is equal
    back[order[1:]] = np.where(same, order[1:] - order[:-1], 0)
    cut = np.flatnonzero(np.concatenate(([True], (back[1:] != back[:-1]) | (lane[1:] != lane[:-1]) | (back[1:] == 0))))
    run = np.diff(np.append(cut, len(px)))
    copy = (back[cut] > 0) & (run >= SHORTEST)
    kind = np.where(back > 0, 1, 0).astype(np.int8)  # 0 literal, 1 cache, 2 copy, 3 within a copy
    kind[np.repeat(copy, run)] = 3
    kind[cut[copy]] = 2
    lengths_at = np.zeros(len(px), np.int64)
    lengths_at[cut] = run
    emit = np.flatnonzero(kind < 3)
    kind, who, p = kind[emit], lane[emit], px[emit]
    lit, hit, ref = (np.flatnonzero(kind == k) for k in range(3))
    channels = [(p[lit] >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (8, 16, 0, 24)]
    gap, w = back[emit[ref]], width[emit[ref]]
    plain = gap + 120
    for v in np.unique(w):  # neighbours have codes of their own
        near = distances(int(v))
        known = np.zeros(int(near.max()) + 1, np.int64)
        known[near[:0:-1]] = np.arange(120, 0, -1)
        i = np.flatnonzero((w == v) & (gap < len(known)))
        plain[i] = np.where(known[gap[i]] > 0, known[gap[i]], plain[i])
    l_code, l_more, l_bits = prefixed(lengths_at[emit[ref]])
    d_code, d_more, d_bits = prefixed(plain)
    green = np.empty(len(emit), np.int64)
    green[lit], green[hit], green[ref] = channels[0], LITERALS + LENGTHS + slot[emit[hit]], LITERALS + l_code
    symbols = [(who, green), *((who[lit], c) for c in channels[1:]), (who[ref], d_code)]
    sizes = [a + (1 << CACHE_BITS if k == 0 else 0) for k, a in enumerate(ALPHABETS)]
    spots = [a * m + s for (a, s), m in zip(symbols, sizes, strict=True)]
    counts = [np.bincount(at, minlength=n * m).reshape(n, m) for at, m in zip(spots, sizes, strict=True)]
    lens = [code_lengths(c) for c in counts]
    found = [(canonical(x) << 4 | x).ravel()[at] for x, at in zip(lens, spots, strict=True)]
    codes, bits = [x >> 4 for x in found], [x & 15 for x in found]
    # the body: two values for each symbol with what belongs to it
    v1, n1 = codes[0], bits[0]
    v2, n2 = np.zeros(len(emit), np.int64), np.zeros(len(emit), np.int64)
    v1[lit] |= codes[1] << n1[lit]
    n1[lit] += bits[1]
    v2[lit] = codes[2] | codes[3] << bits[2]
    n2[lit] = bits[2] + bits[3]
    v1[ref] |= l_more << n1[ref]
    n1[ref] += l_bits
    v2[ref] = codes[4] | d_more << bits[4]
    n2[ref] = bits[4] + d_bits
    # the head: transforms, cache, one group of codes
    parts = []
    for i, acc in enumerate(heads):
        acc.put(1 << 1 | CACHE_BITS << 2, 7)  # no further transform; a cache; no meta codes
        for j in range(0, acc.n, 32):
            parts.append((i, j // 32 - (1 << 20), acc.value >> j & 0xFFFFFFFF, min(32, acc.n - j)))
    tokens = [tuple(np.array(c, np.int64) for c in zip(*parts, strict=True))]
    for k in range(5):
        tokens += _code_tokens(k, counts[k], lens[k])
    h_lane, h_seq, h_value, h_bits = (np.concatenate([t[i] for t in tokens]) for i in range(4))
    order = np.lexsort((h_seq, h_lane))
    h_lane, h_value, h_bits = h_lane[order], h_value[order], h_bits[order]
    head_bits = np.bincount(h_lane, h_bits, n).astype(np.int64)
    both = n1 + n2
    body_bits = np.bincount(who, both, n).astype(np.int64)
    length = head_bits + body_bits + 7 >> 3
    start = np.concatenate(([0], np.cumsum(length + 7 >> 2)))  # in words, one to spare
    ahead = lambda bits, group, total: np.cumsum(bits) - bits - (np.cumsum(total) - total)[group]
    h_at = start[h_lane] * 32 + ahead(h_bits, h_lane, head_bits)
    b_at = start[who] * 32 + head_bits[who] + ahead(both, who, body_bits)
    at, value = np.concatenate((h_at, b_at, b_at + n1)), np.concatenate((h_value, v1, v2)).astype(np.uint64)
    shifted = value << (at & 31).astype(np.uint64)
    word, total = at >> 5, int(start[-1]) + 2
    low = np.bincount(word, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), total)
    low[1:] += np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), total)[:-1]
    data = low.astype(np.uint64).astype("<u4").tobytes()
    return [data[4 * s : 4 * s + m] for s, m in zip(start[:-1].tolist(), length.tolist(), strict=True)]


# ---------------------------------------------------------------- payloads


def payload_of(text: str | None) -> bytes:
    """A text in UTF-8, filled with bytes 0 up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def encode_files(payloads: list[bytes]) -> list[bytes]:
    """WebP files of payloads, whose sizes are positive multiples of UNIT."""
    strips, owner = [], []
    for i, p in enumerate(payloads):
        px = np.frombuffer(p, "<u4")
        for lo in range(0, len(px), WIDTH * ROWS):
            strips.append(px[lo : lo + WIDTH * ROWS])
            owner.append(i)
    streams: list[bytes] = []
    lo = held = 0
    for i, s in enumerate(strips):
        held += len(s)
        if held >= BATCH or i + 1 - lo >= 1024 or i + 1 == len(strips):
            streams += encode_streams(strips[lo : i + 1])
            lo, held = i + 1, 0
    own: dict[int, tuple[list, list]] = {}
    for i, stream, strip in zip(owner, streams, strips, strict=True):
        parts = own.setdefault(i, ([], []))
        parts[0].append(stream)
        parts[1].append(len(strip) // WIDTH)
    return [wrap(*own[i]) for i in range(len(payloads))]


def features(image: np.ndarray) -> str:
    """Size, mean sample of each channel in thousandths, and the number of rows unlike the row above."""
    means = image.reshape(-1, 4).sum(axis=0, dtype=np.int64) * 1000 // (image.shape[0] * image.shape[1])
    changes = int((image[1:] != image[:-1]).any(axis=(1, 2)).sum())
    return f"{image.shape[1]}x{image.shape[0]};b={means[0]};g={means[1]};r={means[2]};a={means[3]};rows={changes}"


def batches_of(payloads: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of payloads of about LANES pixels together."""
    lo = size = 0
    for i, n in enumerate(payloads):
        size += n // 4
        if size >= LANES or i + 1 - lo >= FILES:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(payloads):
        yield lo, len(payloads)


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (a WebP file) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in batches_of([len(t or "") for t in texts]):
                own = texts[lo:hi]
                files = encode_files([payload_of(t) for t in own])
                cols = [b.column("doc_id")[lo:hi], pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in own], pa.int64()), pa.array(files, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def pixels(media: DataFrame, column: str = "media") -> DataFrame:
    """The other columns, then width, height, pixels (binary: blue, green, red, alpha of each); a null file gives nulls."""
    kept = [c for c in media.columns if c not in (column, "width", "height", "pixels")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column(column).to_pylist()
            images = iter(decode_files([f for f in files if f is not None]))
            rows = [(x.shape[1], x.shape[0], x.tobytes()) if f is not None and (x := next(images)) is not None else (None,) * 3 for f in files]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary()), strict=True))], names=[*kept, "width", "height", "pixels"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in media.select(kept).schema)
    return media.select(*kept, column).mapInArrow(run, f"{fields}width int, height int, pixels binary")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Everything but n_bytes and media_* comes from the pixels that the stored file decodes to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in batches_of([len(t or "") for t in texts]):
                own = texts[lo:hi]
                files = encode_files([payload_of(t) for t in own])
                rows = []
                for text, file, image in zip(own, files, decode_files(files), strict=True):
                    data = image.tobytes()
                    rows.append((len((text or "").encode("utf-8", "surrogatepass")), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), features(image)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], *cols], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
