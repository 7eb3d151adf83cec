"""Media columns of lossless WebP: decoding to pixel arrays, and an encoder that makes such columns.

The decoder reads the whole lossless format: the RIFF container, simple and normal prefix codes,
meta prefix images, LZ77 back-references with the two-dimensional distance map, the colour cache, and
the predictor, cross-colour, subtract-green and palette (with pixel bundling) transforms, inverted in
the reverse of the order in which they were read. Pixels are ARGB integers, row by row.

The encoder writes literals, back-references and cache hits with Huffman prefix codes, under any list
of the four transforms; it is there for round trips and to make media columns of other data.

Edge cases of the column operator :func:`decode_images`: a null value gives null width, height and
pixels and a null error; bytes that aren't a lossless WebP image, or break off, give null pixels and say why in
``error``; one bad row never fails the others. An image of more than ``max_pixels`` pixels, which a few bytes can claim, is such a row:
its array wouldn't fit a column's batch. One colour takes as little time as its array does. An image within another RIFF chunk order is found.
Repeated rows are each decoded. Empty tables give no rows. Other columns are kept, whatever they are
called; a column named as one of the four new ones is replaced.
"""

from __future__ import annotations

import heapq
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
_HASH = 0x1E35A7BD


def _distance_map() -> list[tuple[int, int]]:
    """The 120 near places (x back, y up) in the order of the format: by squared distance, then the larger y, then x >= 0 first; and (8, y) last of their kind."""
    text = (
        "0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0 1,4 -1,4 4,1 -4,1 3,3 -3,3 "
        "2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2 4,4 -4,4 3,5 -3,5 5,3 -5,3 0,6 6,0 1,6 -1,6 6,1 -6,1 "
        "2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3 0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1 4,6 -4,6 6,4 -6,4 2,7 -2,7 7,2 -7,2 3,7 -3,7 "
        "7,3 -7,3 5,6 -5,6 6,5 -6,5 8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7"
    )
    return [(int(x), int(y)) for x, y in (p.split(",") for p in text.split())]


NEAR = _distance_map()


class Bits:
    """Reads bits, the least significant of each byte first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def fill(self, n: int) -> None:
        while self.n < n:
            chunk = self.data[self.at : self.at + 8]
            if not chunk:
                raise ValueError("the data break off")
            self.held |= int.from_bytes(chunk, "little") << self.n
            self.n += 8 * len(chunk)
            self.at += len(chunk)

    def read(self, n: int) -> int:
        if self.n < n:
            self.fill(n)
        x = self.held & ((1 << n) - 1)
        self.held >>= n
        self.n -= n
        return x


class PrefixCode:
    """A canonical prefix code; codes of one symbol take no bits."""

    def __init__(self, lengths: list[int]) -> None:
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.only = used[0][1] if len(used) == 1 else None
        self.table: dict[int, int] = {}
        self.most = 0
        if not used:
            self.only = 0
            return
        if self.only is not None:
            return
        code, before, space = 0, 0, 0
        for n, s in sorted(used):
            code <<= n - before
            before = n
            # A leading 1 tells codes of different lengths apart.
            self.table[(1 << n) | code] = s
            code += 1
            space += 1 << (15 - n)
        self.most = before
        if space != 1 << 15:
            raise ValueError("a prefix code is incomplete or overfull")

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        code, table = 1, self.table
        for _ in range(self.most):
            if not bits.n:
                bits.fill(1)
            code = (code << 1) | (bits.held & 1)
            bits.held >>= 1
            bits.n -= 1
            if code in table:
                return table[code]
        raise ValueError("no such prefix code")


def read_code(bits: Bits, symbols: int) -> PrefixCode:
    lengths = [0] * symbols
    if bits.read(1):
        n, wide = bits.read(1) + 1, bits.read(1)
        found = [bits.read(8 if wide else 1)] + ([bits.read(8)] if n == 2 else [])
        if max(found) >= symbols:
            raise ValueError("a symbol is out of range")
        for s in found:
            lengths[s] = 1
        return PrefixCode(lengths)
    of_lengths = [0] * 19
    for i in range(4 + bits.read(4)):
        of_lengths[_LENGTH_ORDER[i]] = bits.read(3)
    code = PrefixCode(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else symbols
    at, before = 0, 8
    while at < symbols and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
            continue
        value, times = (before, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
        if at + times > symbols:
            raise ValueError("code lengths run over")
        lengths[at : at + times] = [value] * times
        at += times
    return PrefixCode(lengths)


def _extra(bits: Bits, code: int) -> int:
    """The value of a length or distance prefix."""
    if code < 4:
        return code + 1
    n = (code - 2) >> 1
    return ((2 + (code & 1)) << n) + bits.read(n) + 1


def read_image(bits: Bits, width: int, height: int, main: bool) -> array:
    """Entropy-coded pixels; only the main image can have a meta prefix image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    meta, shift, groups = None, 0, 1
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = -(-width >> shift)
        across = (width + (1 << shift) - 1) >> shift
        meta = [(p >> 8) & 0xFFFF for p in read_image(bits, across, (height + (1 << shift) - 1) >> shift, False)]
        groups = max(meta) + 1
    total = width * height
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    cache = [0] * (1 << cache_bits) if cache_bits else None
    down = 32 - cache_bits
    if groups == 1 and all(c.only is not None for c in codes[0][:4]) and codes[0][0].only < 256:
        # No bit is read for a pixel: all have one colour.
        s, r, b, a = (c.only for c in codes[0][:4])
        return array("I", [(a << 24) | (r << 16) | (s << 8) | b]) * total
    out = array("I")
    green, red, blue, alpha, distance = codes[0]
    while len(out) < total:
        at = len(out)
        if meta is not None:
            green, red, blue, alpha, distance = codes[meta[((at // width) >> shift) * across + ((at % width) >> shift)]]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            p = (a << 24) | (r << 16) | (s << 8) | b
        elif s < 280:
            n = _extra(bits, s - 256)
            d = _extra(bits, distance.read(bits))
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(n):
                p = out[-d]
                out.append(p)
                if cache is not None:
                    cache[((_HASH * p) & 0xFFFFFFFF) >> down] = p
            continue
        else:
            p = cache[s - 280]
        out.append(p)
        if cache is not None:
            cache[((_HASH * p) & 0xFFFFFFFF) >> down] = p
    return out


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, (p >> 16) & 255, (p >> 8) & 255, p & 255


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _add(a: int, b: int) -> int:
    return (((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00) | (((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF)


def _minus(a: int, b: int) -> int:
    return ((0x100FF0000 + (a & 0xFF00FF00) - (b & 0xFF00FF00)) & 0xFF00FF00) | ((0xFF00FF00 + (a & 0x00FF00FF) - (b & 0x00FF00FF)) & 0x00FF00FF)


def _joined(channels: list[int]) -> int:
    p = 0
    for c in channels:
        p = (p << 8) | (0 if c < 0 else 255 if c > 255 else c)
    return p


def _select(left: int, top: int, corner: int) -> int:
    to_left = to_top = 0
    for l, t, c in zip(_channels(left), _channels(top), _channels(corner)):  # noqa: E741
        to_left += abs(t - c)
        to_top += abs(l - c)
    return left if to_left < to_top else top


def _full(left: int, top: int, corner: int) -> int:
    return _joined([l + t - c for l, t, c in zip(_channels(left), _channels(top), _channels(corner))])  # noqa: E741


def _half(a: int, corner: int) -> int:
    return _joined([x + int((x - c) / 2) for x, c in zip(_channels(a), _channels(corner))])


def predicted(mode: int, left: int, top: int, corner: int, right: int) -> int:
    """The prediction from the pixels to the left, above, above to the left and above to the right."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 6:
        return _average(left, corner)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(corner, top)
    if mode == 9:
        return _average(top, right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return _full(left, top, corner)
    if mode == 13:
        return _half(_average(left, top), corner)
    return 0xFF000000


def _prediction(pixels: list[int], at: int, width: int, modes: list[int], bits: int) -> int:
    x, y = at % width, at // width
    if not at:
        return 0xFF000000
    if not y:
        return pixels[at - 1]
    if not x:
        return pixels[at - width]
    mode = (modes[(y >> bits) * ((width + (1 << bits) - 1) >> bits) + (x >> bits)] >> 8) & 15
    return predicted(mode, pixels[at - 1], pixels[at - width], pixels[at - width - 1], pixels[at - width + 1])


def _signed(x: int) -> int:
    return x - 256 if x > 127 else x


def cross_color(p: int, element: int, back: int) -> int:
    """Adds (back = 1) or takes off (-1) what a pixel's red and blue share with green and red."""
    a, r, g, b = _channels(p)
    _, red_blue, green_blue, green_red = _channels(element)
    share = (_signed(green_red) * _signed(g)) >> 5
    original = (r + share) & 255 if back > 0 else r
    b += back * ((_signed(green_blue) * _signed(g)) >> 5) + back * ((_signed(red_blue) * _signed(original)) >> 5)
    return (a << 24) | (((r + back * share) & 255) << 16) | (g << 8) | (b & 255)


def _packing(colors: int) -> int:
    return 3 if colors <= 2 else 2 if colors <= 4 else 1 if colors <= 16 else 0


def _blocks(pixels: list[int], width: int, bits: int, elements: list[int], back: int) -> array:
    across = (width + (1 << bits) - 1) >> bits
    return array("I", (cross_color(p, elements[((i // width) >> bits) * across + ((i % width) >> bits)], back) for i, p in enumerate(pixels)))


def payload(data: bytes) -> bytes:
    """The lossless bitstream within the container."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP container")
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if kind == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the container")


#: Pixels that are enough for a run of rows to go on.
PIXELS = 1 << 20
#: Pixels beyond which an image is refused.
MAX_PIXELS = 1 << 26


def decode(data: bytes, max_pixels: int = MAX_PIXELS) -> tuple[int, int, list[int]]:
    """(width, height, ARGB pixels) of a lossless WebP file."""
    width, height, pixels = decoded(data, max_pixels)
    return width, height, list(pixels)


def decoded(data: bytes, max_pixels: int = MAX_PIXELS) -> tuple[int, int, array]:
    """As :func:`decode`, with the pixels in four bytes each."""
    stream = payload(data)
    if stream[:1] != b"\x2f":
        raise ValueError("no lossless signature")
    bits = Bits(stream[1:])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    if width * height > max_pixels:
        raise ValueError(f"{width} x {height} pixels are more than {max_pixels}")
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    transforms, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(kind == t[0] for t in transforms):
            raise ValueError("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOR):
            size = bits.read(3) + 2
            side = (1 << size) - 1
            transforms.append((kind, across, size, read_image(bits, (across + side) >> size, (height + side) >> size, False)))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, across, 0, []))
        else:
            n = bits.read(8) + 1
            table = read_image(bits, n, 1, False)
            for i in range(1, n):
                table[i] = _add(table[i], table[i - 1])
            transforms.append((kind, across, _packing(n), table))
            across = (across + (1 << _packing(n)) - 1) >> _packing(n)
    pixels = read_image(bits, across, height, True)
    for kind, across, size, extra in reversed(transforms):
        if kind == PREDICTOR:
            for i in range(len(pixels)):
                pixels[i] = _add(pixels[i], _prediction(pixels, i, across, extra, size))
        elif kind == CROSS_COLOR:
            pixels = _blocks(pixels, across, size, extra, 1)
        elif kind == SUBTRACT_GREEN:
            pixels = array("I", ((p & 0xFF00FF00) | (((p & 0xFF00FF) + ((p >> 8) & 255) * 0x10001) & 0xFF00FF) for p in pixels))
        else:
            per, depth = 1 << size, 8 >> size
            packed = (across + per - 1) >> size
            table = [*extra, *[0] * (256 - len(extra))]
            pixels = array("I", (table[(pixels[y * packed + (x >> size)] >> (8 + depth * (x & (per - 1)))) & ((1 << depth) - 1)] for y in range(height) for x in range(across)))
    return width, height, pixels


class _Out:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, x: int, n: int) -> None:
        self.value |= x << self.n
        self.n += n

    def code(self, entry: tuple[int, int]) -> None:
        """A prefix code goes out from its highest bit."""
        code, n = entry
        for k in range(n - 1, -1, -1):
            self.put((code >> k) & 1, 1)


def _lengths(counts: list[int], most: int) -> list[int]:
    """Huffman code lengths of at most ``most`` bits; rare symbols are counted up until they fit."""
    floor = 0
    while True:
        heap = [(max(c, floor), i, (i,)) for i, c in enumerate(counts) if c]
        out = [0] * len(counts)
        if len(heap) == 1:
            out[heap[0][1]] = 1
            return out
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                out[s] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
        if max(out, default=0) <= most:
            return out
        floor = max(1, floor * 2)


def _codes(lengths: list[int]) -> list[tuple[int, int]]:
    out, code, before = [(0, 0)] * len(lengths), 0, 0
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) < 2:
        return out
    for n, s in used:
        code <<= n - before
        before = n
        out[s] = (code, n)
        code += 1
    return out


def _put_code(out: _Out, counts: list[int]) -> list[tuple[int, int]]:
    used = [s for s, c in enumerate(counts) if c]
    if len(used) <= 1 and (not used or used[0] < 256):
        s = used[0] if used else 0
        out.put(1, 1)
        out.put(0, 1)
        out.put(s > 1, 1)
        out.put(s, 8 if s > 1 else 1)
        return [(0, 0)] * len(counts)
    lengths = _lengths(counts, 15)
    if len(used) == 2 and max(used) < 256:
        out.put(1, 1)
        out.put(1, 1)
        out.put(1, 1)
        out.put(used[0], 8)
        out.put(used[1], 8)
        return _codes(lengths)
    if len(used) == 1:
        lengths[0] = 1
    runs, i = [], 0
    while i < len(lengths):
        j = i
        while j < len(lengths) and lengths[j] == lengths[i]:
            j += 1
        n = j - i
        if not lengths[i]:
            while n >= 3:
                k = min(n, 138)
                runs.append((18, k - 11, 7) if k >= 11 else (17, k - 3, 3))
                n -= k
        else:
            runs.append((lengths[i], 0, 0))
            n -= 1
            while n >= 3:
                k = min(n, 6)
                runs.append((16, k - 3, 2))
                n -= k
        runs += [(lengths[i], 0, 0)] * n
        i = j
    counted = [0] * 19
    for s, *_ in runs:
        counted[s] += 1
    of_lengths = _lengths(counted, 7)
    codes = _codes(of_lengths)
    out.put(0, 1)
    last = max(k for k, s in enumerate(_LENGTH_ORDER) if of_lengths[s])
    n = max(4, last + 1)
    out.put(n - 4, 4)
    for s in _LENGTH_ORDER[:n]:
        out.put(of_lengths[s], 3)
    out.put(0, 1)
    for s, extra, width in runs:
        out.code(codes[s])
        out.put(extra, width)
    return _codes(lengths)


def _prefix(value: int) -> tuple[int, int, int]:
    """(code, extra bits, their number) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 2
    return 2 * n + 2 + ((v >> n) & 1), v & ((1 << n) - 1), n


def _put_image(out: _Out, pixels: list[int], width: int, main: bool, cache_bits: int = 0) -> None:
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}
    cache: dict[int, int] = {}
    down = 32 - cache_bits
    seen: dict[tuple[int, ...], int] = {}
    symbols: list[tuple] = []
    i = 0
    while i < len(pixels):
        n, d = 0, 0
        at = seen.get(tuple(pixels[i : i + 3])) if i + 3 <= len(pixels) else None
        if at is not None:
            d = i - at
            while i + n < len(pixels) and n < 4096 and pixels[at + n] == pixels[i + n]:
                n += 1
        slot = ((_HASH * pixels[i]) & 0xFFFFFFFF) >> down if cache_bits else 0
        if n >= 3:
            symbols.append((256, n, near.get(d, d + 120)))
        elif cache_bits and cache.get(slot) == pixels[i]:
            symbols.append((280, slot))
            n = 1
        else:
            symbols.append((0, pixels[i]))
            n = 1
        for k in range(i, i + n):
            if cache_bits:
                cache[((_HASH * pixels[k]) & 0xFFFFFFFF) >> down] = pixels[k]
            seen[tuple(pixels[k : k + 3])] = k
        i += n
    counts = [[0] * n for n in (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)]
    for s in symbols:
        if s[0] == 256:
            counts[0][256 + _prefix(s[1])[0]] += 1
            counts[4][_prefix(s[2])[0]] += 1
        elif s[0] == 280:
            counts[0][280 + s[1]] += 1
        else:
            a, r, g, b = _channels(s[1])
            for which, c in ((0, g), (1, r), (2, b), (3, a)):
                counts[which][c] += 1
    codes = [_put_code(out, c) for c in counts]
    for s in symbols:
        if s[0] == 256:
            for which, base, value in ((0, 256, s[1]), (4, 0, s[2])):
                code, extra, n = _prefix(value)
                out.code(codes[which][base + code])
                out.put(extra, n)
        elif s[0] == 280:
            out.code(codes[0][280 + s[1]])
        else:
            a, r, g, b = _channels(s[1])
            for which, c in ((0, g), (1, r), (2, b), (3, a)):
                out.code(codes[which][c])


def encode(width: int, height: int, pixels: list[int], transforms: tuple[int, ...] = (), cache_bits: int = 0, block_bits: int = 2) -> bytes:
    """A lossless WebP file of ARGB pixels. PALETTE needs at most 256 colours."""
    out = _Out()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    across = width
    pixels = list(pixels)
    side = (1 << block_bits) - 1
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        wide, high = (across + side) >> block_bits, (height + side) >> block_bits
        if kind == PREDICTOR:
            modes = [0xFF000000 | (((i * 5 + 11) % 14) << 8) for i in range(wide * high)]
            out.put(block_bits - 2, 3)
            _put_image(out, modes, wide, False)
            pixels = [_minus(p, _prediction(pixels, i, across, modes, block_bits)) for i, p in enumerate(pixels)]
        elif kind == CROSS_COLOR:
            elements = [0xFF000000 | ((i * 37 + 9) % 256 << 16) | ((i * 91 + 200) % 256 << 8) | ((i * 53 + 30) % 256) for i in range(wide * high)]
            out.put(block_bits - 2, 3)
            _put_image(out, elements, wide, False)
            pixels = _blocks(pixels, across, block_bits, elements, -1)
        elif kind == SUBTRACT_GREEN:
            pixels = [_joined([p >> 24, (((p >> 16) & 255) - ((p >> 8) & 255)) & 255, (p >> 8) & 255, ((p & 255) - ((p >> 8) & 255)) & 255]) for p in pixels]
        else:
            table = sorted(set(pixels))
            if len(table) > 256:
                raise ValueError("too many colours for a palette")
            out.put(len(table) - 1, 8)
            _put_image(out, [table[0], *(_minus(b, a) for a, b in zip(table, table[1:]))], len(table), False)
            size = _packing(len(table))
            per, depth, index = 1 << size, 8 >> size, {c: i for i, c in enumerate(table)}
            packed = (across + per - 1) >> size
            rows = []
            for y in range(height):
                for b in range(packed):
                    own = pixels[y * across + b * per : min(y * across + (b + 1) * per, (y + 1) * across)]
                    rows.append(0xFF000000 | (sum(index[c] << (depth * k) for k, c in enumerate(own)) << 8))
            pixels, across = rows, packed
    out.put(0, 1)
    _put_image(out, pixels, across, True, cache_bits)
    stream = b"\x2f" + out.value.to_bytes((out.n + 7) // 8, "little")
    body = b"WEBP" + b"VP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def decode_images(df: DataFrame, column: str = "image", max_pixels: int = MAX_PIXELS) -> DataFrame:
    """``df`` with width, height, pixels (ARGB as signed 32 bits, row by row) and error for its binary column."""
    new = {"width": T.IntegerType(), "height": T.IntegerType(), "pixels": T.ArrayType(T.IntegerType()), "error": T.StringType()}
    kept = [f for f in df.schema if f.name not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, n = 0, batch.num_rows
            widths, heights, errors, pixels, ends = [], [], [], array("I"), [0]
            for at, data in enumerate(batch.column(column).to_pylist(), 1):
                width = height = error = None
                try:
                    if data is not None:
                        width, height, own = decoded(bytes(data), max_pixels)
                        pixels.extend(own)
                except (ValueError, IndexError, OverflowError, struct.error) as e:
                    width, height, error = None, None, str(e) or type(e).__name__
                widths.append(width)
                heights.append(height)
                errors.append(error)
                ends.append(len(pixels))
                # Rows go on in runs, so that large images don't gather.
                if at < n and len(pixels) < PIXELS:
                    continue
                flat = pa.array(np.frombuffer(pixels, np.int32) if pixels else [], pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array([w is None for w in widths]))
                part = batch.slice(first, at - first)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(widths, pa.int32()), pa.array(heights, pa.int32()), lists, pa.array(errors, pa.string())], names=[*(f.name for f in kept), *new])
                first, widths, heights, errors, pixels, ends = at, [], [], [], array("I"), [0]

    return df.mapInArrow(run, T.StructType([*kept, *(T.StructField(k, t) for k, t in new.items())]))


#: What :func:`gray_images` puts over an image, by turns.
RECIPES = ((), (PREDICTOR,), (CROSS_COLOR,), (SUBTRACT_GREEN, PREDICTOR), (PALETTE,), (PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN), (PALETTE, PREDICTOR))


def gray_images(vectors: DataFrame, across: int = 8) -> DataFrame:
    """(vec_id, image): each embedding as an image of gray levels, ``across`` to a row: floor((value + 1) * 127.5) held to 0 to 255.

    A null or empty vector has a null image; a row's missing end is black. Null values are level 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = []
            for k, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not vector:
                    images.append(None)
                    continue
                levels = [0 if v is None or v != v else int(min(max((v + 1) * 127.5, 0), 255) // 1) for v in vector]
                levels += [0] * (-len(levels) % across)
                pixels = [0xFF000000 | q * 0x010101 for q in levels]
                images.append(encode(across, len(levels) // across, pixels, RECIPES[(k or 0) % len(RECIPES)], (k or 0) % 5))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], names=["vec_id", "image"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, image binary")


def gray_sql(vectors: str = "embeddings", across: int = 8) -> str:
    """DuckDB SQL for what decoding :func:`gray_images` gives: the gray levels as signed ARGB pixels."""
    level = "CASE WHEN v IS NULL OR isnan(v) THEN 0 ELSE floor(least(greatest((v::DOUBLE + 1) * 127.5, 0), 255))::BIGINT END"
    return f"""
WITH filled AS (
  SELECT vec_id, CASE WHEN len(embedding) > 0 THEN embedding END AS e, (-len(embedding) % {across} + {across}) % {across} AS missing
  FROM {vectors}),
images AS (
  SELECT vec_id, list_concat(list_transform(e, lambda v: ({level} * 65793 - 16777216)::INTEGER), list_transform(range(missing), lambda i: (-16777216)::INTEGER)) AS pixels, e IS NULL AS none
  FROM filled)
SELECT vec_id, CASE WHEN NOT none THEN {across} END AS width, CASE WHEN NOT none THEN (len(pixels) // {across})::INTEGER END AS height,
       CASE WHEN NOT none THEN pixels END AS pixels, NULL::VARCHAR AS error
FROM images"""
