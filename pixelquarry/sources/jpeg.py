"""JPEG: baseline, extended and progressive Huffman files of 8 bits, at full size or an eighth, a quarter or a half of it; a baseline encoder.

The inverse transform is one matrix product over all blocks of a component. For a
smaller size only the lowest n x n coefficients of a block are transformed, with
an n-point transform, so a small target costs neither the pixels nor their colours.
Chroma is enlarged by repetition. Lossless, arithmetic and 12-bit files are refused.
"""

from __future__ import annotations

import struct
from array import array

import numpy as np

# The order of coefficients in a file.
ZIGZAG = (
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
)
# The standard's example tables of luminance and chrominance steps, row by row.
STEPS = (
    (16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
     18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99),
    (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
     99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99),
)


#: Sums of products come in any order; values this near below a half count as a half.
TIE = 1e-9


class JpegError(ValueError):
    pass


def cosines(n: int) -> np.ndarray:
    """The orthonormal cosine transform of n points: rows are frequencies."""
    k, x = np.mgrid[:n, :n]
    return np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n)) * np.cos((2 * x + 1) * k * np.pi / (2 * n))


class _Component:
    def __init__(self, number: int, h: int, v: int, steps: int):
        self.number, self.h, self.v, self.steps = number, h, v, steps


class _Bits:
    """Bits of one stretch of entropy-coded data; after its end, zeros."""

    __slots__ = ("at", "data", "held", "n")

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def more(self) -> None:
        part = self.data[self.at : self.at + 6]
        self.at += 6
        self.held = (self.held & ((1 << self.n) - 1)) << 48 | int.from_bytes(part.ljust(6, b"\0"), "big")
        self.n += 48

    def take(self, k: int) -> int:
        if not k:
            return 0
        if self.n < k:
            self.more()
        self.n -= k
        return self.held >> self.n & ((1 << k) - 1)

    def symbol(self, table: list[int]) -> int:
        if self.n < 16:
            self.more()
        code = table[self.held >> (self.n - 16) & 0xFFFF]
        if not code:
            raise JpegError("a code that isn't in its table")
        self.n -= code >> 8
        return code & 0xFF

    def number(self, size: int) -> int:
        """A signed number of so many bits."""
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For any 16 bits: length << 8 | symbol of the code that they begin with, 0 for none."""
    out, at, k = [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            span = 1 << (16 - length)
            if at + span > 65536 or k >= len(symbols):
                raise JpegError("a damaged code table")
            out[at : at + span] = [length << 8 | symbols[k]] * span
            at, k = at + span, k + 1
    return out


class Decoder:
    def __init__(self, data: bytes):
        self.data, self.steps, self.tables, self.interval = data, {}, {}, 0
        self.components: list[_Component] = []
        self.adobe: int | None = None
        self.progressive, self.jfif = False, False
        self._read()

    def _read(self) -> None:
        data, at = self.data, 2
        while at + 4 <= len(data):
            if data[at] != 0xFF or data[at + 1] in (0xFF, 0):
                at += 1
                continue
            marker = data[at + 1]
            if marker == 0xD9:
                break
            if marker == 0x01 or 0xD0 <= marker <= 0xD8:
                at += 2
                continue
            n = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == 0xDB:
                self._steps(body)
            elif marker == 0xC4:
                self._codes(body)
            elif marker in (0xC0, 0xC1, 0xC2):
                self._frame(body, marker == 0xC2)
            elif 0xC3 <= marker <= 0xCF and marker != 0xC8:
                raise JpegError("a lossless, hierarchical or arithmetic file")
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body[:2])[0]
            elif marker == 0xE0 and body[:4] == b"JFIF":
                self.jfif = True
            elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.adobe = body[11]
            elif marker == 0xDA:
                at = self._scan(body, at)
        if not self.components:
            raise JpegError("no frame")

    def _steps(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, k = body[at] >> 4, body[at] & 15
            table = np.zeros(64, np.int64)
            table[list(ZIGZAG)] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1)
            self.steps[k] = table
            at += 1 + 64 * (1 + wide)

    def _codes(self, body: bytes) -> None:
        at = 0
        while at + 17 <= len(body):
            counts = body[at + 1 : at + 17]
            self.tables[body[at]] = _lookup(counts, body[at + 17 : at + 17 + sum(counts)])
            at += 17 + sum(counts)

    def _frame(self, body: bytes, progressive: bool) -> None:
        depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if depth != 8 or not self.width or not self.height or n not in (1, 3, 4) or self.components:
            raise JpegError(f"{depth} bits, {self.width} x {self.height}, {n} components")
        self.progressive = progressive
        self.components = [_Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * n, 3)]
        if any(not 1 <= x <= 4 for c in self.components for x in (c.h, c.v)):
            raise JpegError("a sampling factor")
        self.h, self.v = max(c.h for c in self.components), max(c.v for c in self.components)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.components:
            c.wide, c.high = self.across * c.h, self.down * c.v  # blocks held
            c.cols, c.rows = -(-(-(-self.width * c.h // self.h)) // 8), -(-(-(-self.height * c.v // self.v)) // 8)  # blocks with pixels
            c.values = array("h", bytes(2 * 64 * c.wide * c.high))

    def _stretches(self, at: int) -> tuple[list[bytes], int]:
        """Entropy-coded data from here on, cut at restart marks, without stuffed zeros; where the next segment begins."""
        data, out, start = self.data, [], at
        while True:
            k = data.find(b"\xff", at)
            if k < 0 or k + 1 >= len(data):
                out.append(data[start:].replace(b"\xff\x00", b"\xff"))
                return out, len(data)
            mark = data[k + 1]
            if mark == 0:
                at = k + 2
            elif 0xD0 <= mark <= 0xD7:
                out.append(data[start:k].replace(b"\xff\x00", b"\xff"))
                at = start = k + 2
            elif mark == 0xFF:
                at = k + 1
            else:
                out.append(data[start:k].replace(b"\xff\x00", b"\xff"))
                return out, k

    def _scan(self, body: bytes, at: int) -> int:
        by = {c.number: c for c in self.components}
        own = []
        for k in range(body[0]):
            c = by[body[1 + 2 * k]]
            own.append((c, self.tables.get(body[2 + 2 * k] >> 4), self.tables.get(0x10 | body[2 + 2 * k] & 15)))
        first, last, low = body[1 + 2 * body[0]], body[2 + 2 * body[0]], body[3 + 2 * body[0]]
        high, low = low >> 4, low & 15
        if not self.progressive:
            block = self._whole
        elif first == 0:
            block = self._dc_refined if high else self._dc
        else:
            block = self._ac_refined if high else self._ac
        stretches, end = self._stretches(at)
        if len(own) > 1:
            units = [[(c, dc, ac, 64 * ((my * c.v + y) * c.wide + mx * c.h + x)) for c, dc, ac in own for y in range(c.v) for x in range(c.h)] for my in range(self.down) for mx in range(self.across)]
        else:
            c, dc, ac = own[0]
            units = [[(c, dc, ac, 64 * (y * c.wide + x))] for y in range(c.rows) for x in range(c.cols)]
        step = self.interval or len(units)
        for k, part in zip(range(0, len(units), step), stretches, strict=False):
            bits, self.run = _Bits(part), 0
            for c, _, _ in own:
                c.before = 0
            for unit in units[k : k + step]:
                for c, dc, ac, place in unit:
                    block(bits, c, dc, ac, place, first, last, low)
        return end

    @staticmethod
    def _whole(bits, c, dc, ac, place, *_):
        values = c.values
        c.before += bits.number(bits.symbol(dc))
        values[place] = c.before
        k = 1
        while k < 64:
            s = bits.symbol(ac)
            if s & 15:
                k += s >> 4
                if k > 63:
                    break
                values[place + ZIGZAG[k]] = bits.number(s & 15)
                k += 1
            elif s == 0xF0:
                k += 16
            else:
                break

    @staticmethod
    def _dc(bits, c, dc, ac, place, first, last, low):
        c.before += bits.number(bits.symbol(dc))
        c.values[place] = c.before << low

    @staticmethod
    def _dc_refined(bits, c, dc, ac, place, first, last, low):
        if bits.take(1):
            c.values[place] |= 1 << low

    def _ac(self, bits, c, dc, ac, place, first, last, low):
        if self.run:
            self.run -= 1
            return
        k = first
        while k <= last:
            s = bits.symbol(ac)
            r, size = s >> 4, s & 15
            if size:
                k += r
                if k > 63:
                    break
                c.values[place + ZIGZAG[k]] = bits.number(size) << low
                k += 1
            elif r == 15:
                k += 16
            else:
                self.run = (1 << r) - 1 + bits.take(r)
                break

    def _ac_refined(self, bits, c, dc, ac, place, first, last, low):
        values, bit, k = c.values, 1 << low, first

        def better(at):
            if bits.take(1) and not values[at] & bit if values[at] > 0 else bits.take(1) and not -values[at] & bit:
                values[at] += bit if values[at] > 0 else -bit

        if not self.run:
            while k <= last:
                s = bits.symbol(ac)
                r, new = s >> 4, 0
                if s & 15:
                    new = bit if bits.take(1) else -bit
                elif r < 15:
                    self.run = (1 << r) + bits.take(r)
                    break
                while k <= last:
                    at = place + ZIGZAG[k]
                    if values[at]:
                        better(at)
                    elif r == 0:
                        if new:
                            values[at] = new
                        k += 1
                        break
                    else:
                        r -= 1
                    k += 1
        if self.run:
            while k <= last:
                at = place + ZIGZAG[k]
                if values[at]:
                    better(at)
                k += 1
            self.run -= 1

    def planes(self, points: int = 8) -> np.ndarray:
        """height x width x components, as unrounded samples; with fewer points than 8, so many eighths of the size."""
        matrix, out = cosines(points), []
        h, w = -(-self.height * points // 8), -(-self.width * points // 8)
        for c in self.components:
            if c.steps not in self.steps:
                raise JpegError("a table of steps is missing")
            blocks = np.frombuffer(c.values, np.int16).reshape(-1, 64) * self.steps[c.steps]
            blocks = blocks.reshape(c.high, c.wide, 8, 8)[..., :points, :points] * (points / 8)
            samples = matrix.T @ blocks @ matrix
            plane = samples.transpose(0, 2, 1, 3).reshape(c.high * points, c.wide * points) + 128
            plane = np.clip(np.floor(plane + 0.5 + TIE), 0, 255)
            ys, xs = np.arange(h) * c.v // self.v, np.arange(w) * c.h // self.h
            out.append(plane[ys[:, None], xs])
        return np.stack(out, -1)

    def rgb(self, points: int = 8) -> np.ndarray:
        p = self.planes(points)
        n = p.shape[2]
        if n == 1:
            return np.repeat(p, 3, 2).astype(np.uint8)
        ycc = self.adobe != 0 if n == 3 else self.adobe == 2
        if n == 3 and self.adobe is None and not self.jfif and bytes(c.number for c in self.components) == b"RGB":
            ycc = False
        if ycc:
            y, b, r = p[..., 0], p[..., 1] - 128, p[..., 2] - 128
            p[..., :3] = np.clip(np.floor(np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], -1) + 0.5 + TIE), 0, 255)
        if n == 4:
            ink = p if self.adobe is not None else 255 - p  # Adobe's files hold the inks' complements
            if ycc:
                ink = np.concatenate([p[..., :3], p[..., 3:]], -1)
            p = np.floor(ink[..., :3] * ink[..., 3:] / 255 + 0.5)
        return p[..., :3].astype(np.uint8)


def points_for(width: int, height: int, target: tuple[int, int] | None) -> int:
    """The fewest points a block (1, 2, 4 or 8) with which neither side gets smaller than in the target."""
    return next((n for n in (1, 2, 4) if target and -(-width * n // 8) >= target[0] and -(-height * n // 8) >= target[1]), 8)


def decode_jpeg(data: bytes, target: tuple[int, int] | None = None) -> list[np.ndarray]:
    """One frame, RGBA. With a target size, the smallest of an eighth, a quarter, a half and the whole that isn't smaller."""
    found = Decoder(data)
    rgb = found.rgb(points_for(found.width, found.height, target))
    return [np.concatenate([rgb, np.full((*rgb.shape[:2], 1), 255, np.uint8)], 2)]


def steps_for(quality: int) -> list[np.ndarray]:
    """The example tables scaled: at 50 as they are, at 100 all ones."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in STEPS]


def _codes_for(counts: np.ndarray) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """A code of at most 16 bits for these symbols' counts: how many of each length, the symbols by length, and (code, length) of each; no code is all ones."""
    import heapq

    used = [int(s) for s in np.flatnonzero(counts)]
    heap = [(int(counts[s]), s, (s,)) for s in used] + [(0, 256, (256,))]  # the last symbol takes the code of all ones
    depth = dict.fromkeys([*used, 256], 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    lengths = [0] * 64
    for d in depth.values():
        lengths[d] += 1
    for d in range(63, 16, -1):  # longer codes: two siblings go up, one of them as the sibling of a shorter code's
        while lengths[d]:
            k = d - 2
            while not lengths[k]:
                k -= 1
            lengths[d] -= 2
            lengths[d - 1] += 1
            lengths[k + 1] += 2
            lengths[k] -= 1
    lengths[max(d for d in range(17) if lengths[d])] -= 1
    order = sorted(used, key=lambda s: (depth[s], s))
    codes, code, at = {}, 0, 0
    for d in range(1, 17):
        for _ in range(lengths[d]):
            codes[order[at]] = code, d
            code, at = code + 1, at + 1
        code <<= 1
    return bytes(lengths[1:17]), bytes(order), codes


def _symbols(blocks: np.ndarray, before: int = 0):
    """Of quantised blocks in zigzag order: ((dc size, bits), [(run and size, bits), ...]) for each."""
    sizes = np.ceil(np.log2(np.abs(blocks) + 1)).astype(int)
    for values, size in zip(blocks.tolist(), sizes.tolist(), strict=True):
        d = values[0] - before
        before = values[0]
        n = abs(d).bit_length()
        ac, run = [], 0
        for v, s in zip(values[1:], size[1:], strict=True):
            if not v:
                run += 1
                continue
            while run > 15:
                ac.append((0xF0, 0, 0))
                run -= 16
            ac.append((run << 4 | s, v if v > 0 else v + (1 << s) - 1, s))
            run = 0
        if run:
            ac.append((0, 0, 0))
        yield (n, d if d >= 0 else d + (1 << n) - 1, n), ac


def encode_jpeg(frames, quality: int = 75, subsampled: bool = True, gray: bool = False) -> bytes:
    """Baseline, with codes made for the picture; alpha is left out."""
    rgb = np.asarray(frames[0])[..., :3].astype(np.float64)
    h, w = rgb.shape[:2]
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [y] if gray else [y, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    factor = 2 if subsampled and not gray else 1
    unit, matrix, tables = 8 * factor, cosines(8), steps_for(quality)
    high, wide = -(-h // unit), -(-w // unit)
    coded = []
    for k, p in enumerate(planes):
        p = np.pad(p, ((0, high * unit - h), (0, wide * unit - w)), "edge")
        if k and factor == 2:
            p = p.reshape(high * 8, 2, wide * 8, 2).mean((1, 3))
        blocks = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3) - 128
        values = np.floor(matrix @ blocks @ matrix.T / tables[min(k, 1)].reshape(8, 8) + 0.5 + TIE).astype(int).reshape(*blocks.shape[:2], 64)[..., list(ZIGZAG)]
        n = factor if not k else 1  # blocks of a unit come together
        values = values.reshape(high, n, wide, n, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
        coded.append((list(_symbols(values)), n * n))
    counts = np.zeros((2, 2, 256), np.int64)  # luminance or chrominance; first or further coefficients; symbol
    for k, (blocks, _) in enumerate(coded):
        for dc, ac in blocks:
            counts[min(k, 1), 0, dc[0]] += 1
            for s in ac:
                counts[min(k, 1), 1, s[0]] += 1
    codes = [[_codes_for(c) for c in kind] for kind in counts[: 1 if gray else 2]]

    def segment(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    out = [b"\xff\xd8", segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")]
    out += [segment(0xDB, bytes([k, *tables[k][list(ZIGZAG)].tolist()])) for k in range(len(codes))]
    out.append(segment(0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([k + 1, 17 * (factor if not k else 1), min(k, 1)]) for k in range(len(planes)))))
    out += [segment(0xC4, bytes([16 * j + k]) + codes[k][j][0] + codes[k][j][1]) for k in range(len(codes)) for j in (0, 1)]
    out.append(segment(0xDA, bytes([len(planes)]) + b"".join(bytes([k + 1, 17 * min(k, 1)]) for k in range(len(planes))) + b"\0\x3f\0"))
    held, n, body = 0, 0, bytearray()
    for i in range(high * wide):
        for k, (blocks, each) in enumerate(coded):
            first, further = codes[min(k, 1)][0][2], codes[min(k, 1)][1][2]
            for dc, ac in blocks[i * each : (i + 1) * each]:
                for table, symbols in ((first, (dc,)), (further, ac)):
                    for s, bits, size in symbols:
                        code, length = table[s]
                        held, n = (held << length | code) << size | bits, n + length + size
                if n >= 1024:
                    body += (held >> (n & 7)).to_bytes(n >> 3, "big")
                    held, n = held & ((1 << (n & 7)) - 1), n & 7
    pad = -n % 8
    body += ((held << pad) | ((1 << pad) - 1)).to_bytes((n + pad) >> 3, "big")
    return b"".join([*out, bytes(body).replace(b"\xff", b"\xff\x00"), b"\xff\xd9"])
