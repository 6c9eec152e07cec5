"""WebP's lossless form: all four transforms, prefix code groups, back references, colour cache; a plain lossless encoder.

Lossy files (VP8) and animations are refused.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

# The order in which lengths of the code for code lengths are written.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Places near a pixel (columns to the left, rows above) that short distances stand for, the nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
BLACK = 0xFF000000


class WebpError(ValueError):
    pass


class _Bits:
    """Bits from the lowest of each byte on; after the end, zeros."""

    __slots__ = ("at", "data", "held", "n")

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def more(self) -> None:
        if self.at > len(self.data) + 8:
            raise WebpError("the data ends early")
        self.held |= int.from_bytes(self.data[self.at : self.at + 6].ljust(6, b"\0"), "little") << self.n
        self.at += 6
        self.n += 48

    def take(self, k: int) -> int:
        if self.n < k:
            self.more()
        out = self.held & ((1 << k) - 1)
        self.held >>= k
        self.n -= k
        return out

    def symbol(self, code) -> int:
        table, deep, single = code
        if single is not None:
            return single
        if self.n < 16:
            self.more()
        found = table[self.held & ((1 << deep) - 1)]
        self.held >>= found >> 16
        self.n -= found >> 16
        return found & 0xFFFF


def _code(lengths: list[int]):
    """(table by the next bits, how many, None) or (None, 0, the only symbol)."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return None, 0, used[0]
    if not used or sum(1 << (15 - n) for n in lengths if n) != 1 << 15:
        raise WebpError("a code that isn't complete")
    deep = max(lengths)
    table, code = [0] * (1 << deep), 0
    for n in range(1, deep + 1):
        for s in used:
            if lengths[s] == n:
                at = int(format(code, f"0{n}b")[::-1], 2)
                table[at :: 1 << n] = [n << 16 | s] * (1 << (deep - n))
                code += 1
        code <<= 1
    return table, deep, None


def _read_code(bits: _Bits, size: int):
    lengths = [0] * size
    if bits.take(1):
        n, wide = bits.take(1) + 1, bits.take(1)
        symbols = [bits.take(8 if wide else 1)] + [bits.take(8) for _ in range(n - 1)]
        if max(symbols) >= size:
            raise WebpError("a symbol outside its code")
        if len(set(symbols)) == 1:
            return None, 0, symbols[0]
        for s in symbols:
            lengths[s] = 1
        return _code(lengths)
    first = [0] * 19
    for k in range(4 + bits.take(4)):
        first[LENGTH_ORDER[k]] = bits.take(3)
    inner = _code(first)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        s = bits.symbol(inner)
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
            continue
        n, v = (3 + bits.take(2), before) if s == 16 else (3 + bits.take(3), 0) if s == 17 else (11 + bits.take(7), 0)
        if at + n > size:
            raise WebpError("too many code lengths")
        lengths[at : at + n] = [v] * n
        at += n
    return _code(lengths)


def _length(bits: _Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.take(extra) + 1


def _pixels(bits: _Bits, width: int, height: int, outer: bool) -> list[int]:
    """An entropy-coded image: numbers 0xAARRGGBB."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    cache = [0] * (1 << cache_bits) if cache_bits else []
    group_bits, groups, across = 0, None, 0
    if outer and bits.take(1):
        group_bits = bits.take(3) + 2
        across = -(-width >> group_bits)
        groups = [p >> 8 & 0xFFFF for p in _pixels(bits, across, -(-height >> group_bits), False)]
    codes = [[_read_code(bits, n) for n in (280 + len(cache), 256, 256, 256, 40)] for _ in range(max(groups) + 1 if groups else 1)]
    out: list[int] = []
    total, own = width * height, codes[0]
    cached = 0  # pixels that are in the cache already

    while len(out) < total:
        at = len(out)
        if groups:
            own = codes[groups[(at // width >> group_bits) * across + (at % width >> group_bits)]]
        s = bits.symbol(own[0])
        if s < 256:
            red, blue, alpha = bits.symbol(own[1]), bits.symbol(own[2]), bits.symbol(own[3])
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            n = _length(bits, s - 256)
            far = _length(bits, bits.symbol(own[4]))
            if far > 120:
                far -= 120
            else:
                x, y = NEAR[far - 1]
                far = max(1, x + y * width)
            if far > at or n > total - at:
                raise WebpError("a reference outside the picture")
            for k in range(at - far, at - far + n):
                out.append(out[k])
        else:
            for p in out[cached:]:
                cache[(p * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            cached = at
            out.append(cache[s - 280])
    return out


def _mean(a: int, b: int) -> int:
    return (a & b) + (((a ^ b) & 0xFEFEFEFE) >> 1)


def _parts(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _whole(values) -> int:
    a, r, g, b = (min(255, max(0, v)) for v in values)
    return a << 24 | r << 16 | g << 8 | b


def _nearer(left: int, top: int, corner: int) -> int:
    to_left = to_top = 0
    for x, y, c in zip(_parts(left), _parts(top), _parts(corner), strict=True):
        to_left += abs(y - c)
        to_top += abs(x - c)
    return left if to_left < to_top else top


def _half(a: int, b: int) -> int:
    """a and half of its difference to b, the half cut towards zero."""
    return a + int((a - b) / 2)


#: What a pixel is foretold to be of left, top, top right and top left.
FORETOLD = (
    lambda l, t, r, c: BLACK,  # noqa: E741
    lambda l, t, r, c: l,  # noqa: E741
    lambda l, t, r, c: t,  # noqa: E741
    lambda l, t, r, c: r,  # noqa: E741
    lambda l, t, r, c: c,  # noqa: E741
    lambda l, t, r, c: _mean(_mean(l, r), t),  # noqa: E741
    lambda l, t, r, c: _mean(l, c),  # noqa: E741
    lambda l, t, r, c: _mean(l, t),  # noqa: E741
    lambda l, t, r, c: _mean(c, t),  # noqa: E741
    lambda l, t, r, c: _mean(t, r),  # noqa: E741
    lambda l, t, r, c: _mean(_mean(l, c), _mean(t, r)),  # noqa: E741
    lambda l, t, r, c: _nearer(l, t, c),  # noqa: E741
    lambda l, t, r, c: _whole(x + y - z for x, y, z in zip(_parts(l), _parts(t), _parts(c), strict=True)),  # noqa: E741
    lambda l, t, r, c: _whole(_half(x, z) for x, z in zip(_parts(_mean(l, t)), _parts(c), strict=True)),  # noqa: E741
    lambda l, t, r, c: BLACK,  # noqa: E741
    lambda l, t, r, c: BLACK,  # noqa: E741
)


def _sum(a: int, b: int) -> int:
    """Channel by channel, modulo 256."""
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _foretell(out: list[int], width: int, modes: list[int], size: int, across: int) -> list[int]:
    for i, rest in enumerate(out):
        y, x = divmod(i, width)
        if not i:
            told = BLACK
        elif not y:
            told = out[i - 1]
        elif not x:
            told = out[i - width]
        else:
            told = FORETOLD[modes[(y >> size) * across + (x >> size)] >> 8 & 15](out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1])
        out[i] = _sum(rest, told)
    return out


def _recolour(pixels: list[int], width: int, height: int, factors: list[int], size: int, across: int) -> list[int]:
    p = np.array(pixels, np.int64).reshape(height, width)
    yy, xx = np.mgrid[:height, :width]
    f = np.array(factors, np.int64)[(yy >> size) * across + (xx >> size)]
    signed = lambda v: (v & 255 ^ 128) - 128
    red, green, blue = p >> 16 & 255, p >> 8 & 255, p & 255
    red = red + (signed(f) * signed(green) >> 5) & 255
    blue = blue + (signed(f >> 8) * signed(green) >> 5) + (signed(f >> 16) * signed(red) >> 5) & 255
    return (p & 0xFF00FF00 | red << 16 | blue).reshape(-1).tolist()


def decode_lossless(data: bytes) -> np.ndarray:
    """A VP8L chunk's body as height x width x 4 bytes."""
    if len(data) < 5 or data[0] != 0x2F:
        raise WebpError("no lossless picture")
    bits = _Bits(data[1:])
    full = width = bits.take(14) + 1
    height, alpha = bits.take(14) + 1, bits.take(1)
    if bits.take(3):
        raise WebpError("an unknown version")
    steps: list[tuple] = []
    while bits.take(1):
        kind = bits.take(2)
        if kind in [s[0] for s in steps]:
            raise WebpError("a transform twice")
        if kind < 2:
            size = bits.take(3) + 2
            across = -(-width >> size)
            steps.append((kind, _pixels(bits, across, -(-height >> size), False), size, across, width))
        elif kind == 2:
            steps.append((2,))
        else:
            n, table, before = bits.take(8) + 1, [], 0
            for p in _pixels(bits, n, 1, False):
                before = _sum(before, p)
                table.append(before)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((3, table, pack, width))
            width = -(-width >> pack)
    pixels = _pixels(bits, width, height, True)
    for kind, *rest in reversed(steps):
        if kind == 0:
            pixels = _foretell(pixels, rest[3], rest[0], rest[1], rest[2])
        elif kind == 1:
            pixels = _recolour(pixels, rest[3], height, *rest[:3])
        elif kind == 2:
            p = np.array(pixels, np.int64)
            green = p >> 8 & 255
            pixels = (p & 0xFF00FF00 | (p >> 16) + green << 16 & 0xFF0000 | p + green & 255).tolist()
        else:
            table, pack, wide = rest
            index = np.array(pixels, np.int64).reshape(height, -1) >> 8 & 255
            each, depth = 1 << pack, 8 >> pack
            index = (index[..., None] >> (np.arange(each) * depth) & (1 << depth) - 1).reshape(height, -1)[:, :wide]
            pixels = np.array(table + [0] * (256 - len(table)), np.int64)[index].reshape(-1).tolist()
    p = np.array(pixels, np.int64).reshape(height, full)
    return np.stack([p >> 16 & 255, p >> 8 & 255, p & 255, p >> 24 if alpha else np.full_like(p, 255)], -1).astype(np.uint8)


def chunks(data: bytes) -> dict[bytes, bytes]:
    """The first chunk of each name."""
    out: dict[bytes, bytes] = {}
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        out.setdefault(name, data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    return out


def decode_webp(data: bytes) -> list[np.ndarray]:
    found = chunks(data)
    if b"VP8L" not in found:
        raise WebpError("a lossy or animated file")
    return [decode_lossless(found[b"VP8L"])]


class _Writer:
    def __init__(self):
        self.held, self.n = 0, 0

    def put(self, value: int, k: int) -> None:
        self.held |= value << self.n
        self.n += k


def _lengths(counts: list[int], most: int = 15) -> list[int]:
    """Lengths of a complete code; rare symbols count more until no code is too long."""
    used = [s for s, n in enumerate(counts) if n]
    floor = 1
    while True:
        heap = [(max(counts[s], floor), s, (s,)) for s in used]
        heapq.heapify(heap)
        out = [0] * len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                out[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(out) <= most:
            return out
        floor *= 2


def _write_code(w: _Writer, counts: list[int]) -> dict[int, tuple[int, int]]:
    """(bits as written, how many) of each symbol."""
    used = [s for s, n in enumerate(counts) if n] or [0]
    if len(used) == 1 and used[0] < 256:
        w.put(0b101 if used[0] > 1 else 0b001, 3)  # a simple code of one symbol
        w.put(used[0], 8 if used[0] > 1 else 1)
        return {used[0]: (0, 0)}
    lengths = _lengths(counts)
    w.put(0, 1)
    w.put(15, 4)  # the code of code lengths: sixteen lengths of four bits, no repeats
    for s in LENGTH_ORDER:
        w.put(4 if s < 16 else 0, 3)
    w.put(0, 1)
    for n in lengths:
        w.put(int(format(n, "04b")[::-1], 2), 4)
    out, code = {}, 0
    for n in range(1, 16):
        for s in used:
            if lengths[s] == n:
                out[s] = int(format(code, f"0{n}b")[::-1], 2), n
                code += 1
        code <<= 1
    return out


def encode_webp(frames) -> bytes:
    """Lossless: green taken from red and blue, one group of codes, repeats of the pixel before as references."""
    a = np.asarray(frames[0]).astype(np.int64)
    h, w = a.shape[:2]
    green = a[..., 1]
    planes = {"g": green, "r": a[..., 0] - green & 255, "b": a[..., 2] - green & 255, "a": a[..., 3]}
    flat = np.stack([planes[c].reshape(-1) for c in "grba"], 1)
    starts = np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]).any(1)))
    runs = np.diff(np.append(starts, len(flat)))
    symbols: list[tuple] = []  # (green, red, blue, alpha) or (prefix, extra bits, their value)
    for at, n in zip(starts.tolist(), runs.tolist(), strict=True):
        symbols.append(tuple(flat[at].tolist()))
        n -= 1
        while n:
            part = min(n, 4096)
            n -= part
            v = part - 1
            if v < 4:
                symbols.append((256 + v, 0, 0))
            else:
                extra = v.bit_length() - 2
                symbols.append((256 + 2 * (extra + 1) + (v >> extra & 1), extra, v & (1 << extra) - 1))
    counts = [[0] * n for n in (280, 256, 256, 256, 40)]
    for s in symbols:
        counts[0][s[0]] += 1
        if len(s) == 4:
            for k in (1, 2, 3):
                counts[k][s[k]] += 1
    # the pixel before is the second of the short distances
    counts[4][1] = 1
    out = _Writer()
    for value, k in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3), (1, 1), (2, 2), (0, 1), (0, 1), (0, 1)):
        out.put(value, k)
    codes = [_write_code(out, c) for c in counts]
    parts = [out.held.to_bytes(out.n // 8 + 1, "little")[: out.n // 8]]
    held, n = out.held >> (out.n // 8 * 8), out.n % 8
    for s in symbols:
        fields = [codes[0][s[0]], *(codes[k][s[k]] for k in (1, 2, 3))] if len(s) == 4 else [codes[0][s[0]], (s[2], s[1]), codes[4][1]]
        for value, k in fields:
            held |= value << n
            n += k
        if n >= 4096:
            parts.append((held & (1 << n // 8 * 8) - 1).to_bytes(n // 8, "little"))
            held, n = held >> (n // 8 * 8), n % 8
    body = b"".join([*parts, held.to_bytes(n // 8 + 1, "little")])
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", len(chunk) + 4) + b"WEBP" + chunk
