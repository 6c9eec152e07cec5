"""Image files to frames and back, with numpy and zlib. Each decoder gives a list of height x width x 4 uint8 arrays (frames).

A file that can't be decoded raises CodecError; the data source turns that into
an error column. JPEG and WebP (its lossless form) are in modules of their own;
EXR is decoded where it is not compressed or zipped.
"""

from __future__ import annotations

import math
import re
import struct
import zlib

import numpy as np

from .jpeg import decode_jpeg, encode_jpeg
from .webp import decode_webp, encode_webp


class CodecError(ValueError):
    pass


def rgba(a: np.ndarray) -> np.ndarray:
    """Gray, gray and alpha, or RGB to RGBA."""
    a = np.asarray(a, np.uint8)
    if a.ndim == 2:
        a = a[..., None]
    n = a.shape[2]
    if n == 4:
        return a
    colour = np.repeat(a[..., :1], 3, 2) if n < 3 else a[..., :3]
    alpha = a[..., 1:2] if n == 2 else np.full((*a.shape[:2], 1), 255, np.uint8)
    return np.concatenate([colour, alpha], 2)


def _bits(data: bytes, width: int, height: int, depth: int, stride: int) -> np.ndarray:
    """Samples of 1, 2, 4 or 8 bits, rows of stride bytes."""
    rows = np.frombuffer(data, np.uint8, stride * height).reshape(height, stride)
    if depth == 8:
        return rows[:, :width]
    b = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
    return (b * (1 << np.arange(depth - 1, -1, -1))).sum(2)[:, :width].astype(np.uint8)


# --- detection ----------------------------------------------------------------------------------------------------

#: (format, offset, magic bytes in hexadecimal); the first that fits wins. Formats with looser rules follow in detect().
MAGIC = (
    ("png", 0, "89504E470D0A1A0A"),
    ("gif", 0, "474946383761"),
    ("gif", 0, "474946383961"),
    ("jpeg", 0, "FFD8FF"),
    ("bmp", 0, "424D"),
    ("bmp", 0, "4241"),
    ("webp", 8, "57454250"),
    ("ani", 8, "41434F4E"),
    ("exr", 0, "762F3101"),
    ("qoi", 0, "716F6966"),
    ("tiff", 0, "49492A00"),
    ("tiff", 0, "4D4D002A"),
    ("tiff", 0, "49492B00"),
    ("tiff", 0, "4D4D002B"),
    ("ico", 0, "00000100"),
    ("cur", 0, "00000200"),
)


def detect(data: bytes) -> str | None:
    head = data[:64]
    for name, at, magic in MAGIC:
        m = bytes.fromhex(magic)
        if head[at : at + len(m)] == m and (at == 0 or head[:4] == b"RIFF") and (name not in ("ico", "cur") or head[4:6].strip(b"\0")):
            return name  # an icon holds at least one image, else it may be a TGA
    if re.match(rb"P[1-6][\s#]", head):
        return "pbm"
    if len(data) >= 18 and data[1] in (0, 1) and data[2] in (1, 2, 3, 9, 10, 11) and data[16] in (8, 15, 16, 24, 32) and struct.unpack_from("<HH", data, 12) > (0, 0) and (data[1] == 0 or data[7] in (15, 16, 24, 32)):
        return "tga"
    return None


# --- netpbm -------------------------------------------------------------------------------------------------------


def _pbm_header(data: bytes):
    kind, at, fields = int(data[1:2]), 2, []
    while len(fields) < (2 if kind in (1, 4) else 3):
        m = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\d+)").match(data, at)
        if not m:
            raise CodecError("a damaged header")
        fields.append(int(m[1]))
        at = m.end()
    return kind, fields[0], fields[1], fields[2] if len(fields) > 2 else 1, at


def decode_pbm(data: bytes):
    kind, w, h, top, at = _pbm_header(data)
    n = 3 if kind in (3, 6) else 1
    if not 1 <= top <= 65535:
        raise CodecError("a maximum outside 1 to 65535")
    if kind == 1:
        v = np.array([int(c) for c in re.sub(rb"#[^\n]*", b"", data[at:]).decode() if c in "01"][: w * h])
        return [rgba((1 - v.reshape(h, w)) * 255)]
    if kind in (2, 3):
        v = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: w * h * n], np.int64)
    elif kind == 4:
        return [rgba((1 - _bits(data[at + 1 :], w, h, 1, (w + 7) // 8)) * 255)]
    else:
        v = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * n, at + 1).astype(np.int64)
    return [rgba(np.floor(v.reshape(h, w, n) * 255 / top + 0.5))]


def encode_pbm(frames, plain=False, color="rgb"):
    a = frames[0]
    h, w = a.shape[:2]
    gray = np.floor(a[..., :3] @ np.array([0.2126, 0.7152, 0.0722]) + 0.5).astype(np.uint8)
    v = {"rgb": a[..., :3], "gray": gray, "bw": (gray < 128).astype(np.uint8)}[color]
    kind = {"rgb": 6, "gray": 5, "bw": 4}[color] - (3 if plain else 0)
    head = f"P{kind}\n{w} {h}\n" + ("" if color == "bw" else "255\n")
    if plain:
        return (head + "\n".join(" ".join(map(str, row)) for row in v.reshape(h, -1)) + "\n").encode()
    return head.encode() + (np.packbits(v, axis=1).tobytes() if color == "bw" else np.ascontiguousarray(v).tobytes())


# --- QOI ----------------------------------------------------------------------------------------------------------


def decode_qoi(data: bytes):
    w, h = struct.unpack_from(">II", data, 4)
    n, out, seen = w * h, bytearray(), [(0, 0, 0, 0)] * 64
    r, g, b, a = 0, 0, 0, 255
    at = 14
    while len(out) < 4 * n:
        if at >= len(data):
            raise CodecError("data end too early")
        op, run = data[at], 1
        at += 1
        if op == 0xFE:
            r, g, b = data[at : at + 3]
            at += 3
        elif op == 0xFF:
            r, g, b, a = data[at : at + 4]
            at += 4
        elif op < 0x40:
            r, g, b, a = seen[op]
        elif op < 0x80:
            r, g, b = (r + (op >> 4 & 3) - 2) & 255, (g + (op >> 2 & 3) - 2) & 255, (b + (op & 3) - 2) & 255
        elif op < 0xC0:
            dg, x = (op & 63) - 32, data[at]
            at += 1
            r, g, b = (r + dg + (x >> 4) - 8) & 255, (g + dg) & 255, (b + dg + (x & 15) - 8) & 255
        else:
            run = (op & 63) + 1
        seen[(3 * r + 5 * g + 7 * b + 11 * a) % 64] = (r, g, b, a)
        out += bytes((r, g, b, a)) * run
    return [np.frombuffer(bytes(out[: 4 * n]), np.uint8).reshape(h, w, 4)]


def encode_qoi(frames, channels=4):
    a = frames[0]
    h, w = a.shape[:2]
    out, seen, last, run = bytearray(b"qoif" + struct.pack(">IIBB", w, h, channels, 0)), [None] * 64, (0, 0, 0, 255), 0
    px = [tuple(p) for p in a.reshape(-1, 4).tolist()]
    for i, p in enumerate(px):
        if channels == 3:
            p = (*p[:3], 255)
        if p == last:
            run += 1
            if run == 62 or i == len(px) - 1:
                out.append(0xC0 | run - 1)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        k = (3 * p[0] + 5 * p[1] + 7 * p[2] + 11 * p[3]) % 64
        if seen[k] == p:
            out.append(k)
        else:
            seen[k] = p
            if p[3] != last[3]:
                out += bytes((0xFF, *p))
            else:
                dr, dg, db = ((x - y + 128) % 256 - 128 for x, y in zip(p[:3], last[:3]))
                if -2 <= dr < 2 and -2 <= dg < 2 and -2 <= db < 2:
                    out.append(0x40 | dr + 2 << 4 | dg + 2 << 2 | db + 2)
                elif -32 <= dg < 32 and -8 <= dr - dg < 8 and -8 <= db - dg < 8:
                    out += bytes((0x80 | dg + 32, dr - dg + 8 << 4 | db - dg + 8))
                else:
                    out += bytes((0xFE, *p[:3]))
        last = p
    return bytes(out) + b"\0" * 7 + b"\1"


# --- BMP ----------------------------------------------------------------------------------------------------------


def _mask(v: np.ndarray, mask: int) -> np.ndarray:
    if not mask:
        return np.zeros_like(v)
    low = (mask & -mask).bit_length() - 1
    return np.floor(((v & mask) >> low) * 255 / (mask >> low) + 0.5)


def _bmp_rle(data, w, h, nibbles):
    out, x, y, at = np.zeros((h, w), np.uint8), 0, 0, 0
    while at + 1 < len(data) and y < h:
        n, v = data[at], data[at + 1]
        at += 2
        if n:
            px = [v >> 4, v & 15] * (n // 2 + 1) if nibbles else [v] * n
            for p in px[:n]:
                if x < w:
                    out[y, x] = p
                x += 1
        elif v == 0:
            x, y = 0, y + 1
        elif v == 1:
            break
        elif v == 2:
            x, y, at = x + data[at], y + data[at + 1], at + 2
        else:
            size = (v + 1) // 2 if nibbles else v
            raw = data[at : at + size]
            px = [p for c in raw for p in (c >> 4, c & 15)] if nibbles else list(raw)
            for p in px[:v]:
                if x < w:
                    out[y, x] = p
                x += 1
            at += size + (size & 1)
    return out


def _dib(data: bytes, at: int, pixels_at: int | None = None, icon=False):
    """A device-independent bitmap from its header on."""
    size = struct.unpack_from("<I", data, at)[0]
    if size == 12:
        w, h, _, bpp = struct.unpack_from("<HHHH", data, at + 4)
        compression = used = 0
    else:
        w, h, _, bpp, compression, _, _, _, used = struct.unpack_from("<iiHHIIiiI", data, at + 4)[:9]
    down, h = h < 0, abs(h)
    if icon:
        h //= 2
    masks, table_at = None, at + size
    if compression in (3, 6):
        masks = struct.unpack_from("<IIII" if size >= 56 or compression == 6 else "<III", data, at + 40)
        table_at += 0 if size >= 52 else 4 * len(masks)
    palette = None
    if bpp <= 8:
        entry, n = (3, 1 << bpp) if size == 12 else (4, used or 1 << bpp)
        palette = np.zeros((256, 4), np.uint8)
        raw = np.frombuffer(data, np.uint8, n * entry, table_at).reshape(n, entry)
        palette[:n, :3], palette[:, 3] = raw[:, 2::-1], 255
        table_at += n * entry
    at = pixels_at if pixels_at is not None else table_at
    stride = (w * bpp + 31) // 32 * 4
    if compression in (1, 2):
        out = palette[_bmp_rle(data[at:], w, h, compression == 2)]
    elif bpp <= 8:
        out = palette[_bits(data[at:], w, h, bpp, stride)]
    elif bpp == 24:
        rows = np.frombuffer(data, np.uint8, stride * h, at).reshape(h, stride)[:, : 3 * w].reshape(h, w, 3)
        out = rgba(rows[..., ::-1])
    elif bpp in (16, 32):
        v = np.frombuffer(data, "<u2" if bpp == 16 else "<u4", stride * h // (bpp // 8), at).reshape(h, -1)[:, :w].astype(np.int64)
        r, g, b, *alpha = masks or ((0x7C00, 0x3E0, 0x1F) if bpp == 16 else (0xFF0000, 0xFF00, 0xFF, 0xFF000000))
        out = np.stack([_mask(v, r), _mask(v, g), _mask(v, b), _mask(v, alpha[0]) if alpha and alpha[0] else np.full(v.shape, 255)], -1).astype(np.uint8)
        if bpp == 32 and not masks and not out[..., 3].any():
            out[..., 3] = 255
    else:
        raise CodecError(f"{bpp} bits a pixel")
    out = out if down else out[::-1]
    if icon and bpp < 32:
        mask = _bits(data[at + stride * h :], w, h, 1, (w + 31) // 32 * 4)[::-1]
        out = out.copy()
        out[..., 3] = np.where(mask, 0, 255)
    return np.ascontiguousarray(out)


def decode_bmp(data: bytes):
    return [_dib(data, 14, struct.unpack_from("<I", data, 10)[0])]


def encode_bmp(frames, bits=32):
    a = frames[0]
    h, w = a.shape[:2]
    n = bits // 8
    stride = (w * bits + 31) // 32 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : n * w] = (a[::-1][..., [2, 1, 0, 3][:n]]).reshape(h, n * w)
    masks = struct.pack("<IIII", 0xFF0000, 0xFF00, 0xFF, 0xFF000000) if bits == 32 else b""
    head = struct.pack("<IiiHHIIiiII", 56 if masks else 40, w, h, 1, bits, 3 if masks else 0, rows.size, 3780, 3780, 0, 0) + masks
    return b"BM" + struct.pack("<IHHI", 14 + len(head) + rows.size, 0, 0, 14 + len(head)) + head + rows.tobytes()


# --- TGA ----------------------------------------------------------------------------------------------------------


def decode_tga(data: bytes):
    ident, has_map, kind = data[:3]
    first, n_map, map_bits = struct.unpack_from("<HHB", data, 3)
    w, h, bits, flags = struct.unpack_from("<HHBB", data, 12)
    at = 18 + ident

    def colours(raw, bits):
        if bits in (15, 16):
            v = raw.view("<u2").astype(np.int64)
            return np.stack([_mask(v, 0x7C00), _mask(v, 0x3E0), _mask(v, 0x1F), np.full(len(v), 255)], -1).astype(np.uint8)
        v = raw.reshape(-1, bits // 8)
        return rgba(v[:, None, [2, 1, 0, 3][: bits // 8]] if bits > 8 else v[:, None])[:, 0]

    palette = None
    if has_map:
        size = n_map * ((map_bits + 7) // 8)
        palette = colours(np.frombuffer(data, np.uint8, size, at).copy(), map_bits)
        at += size
    n = (bits + 7) // 8
    if kind >= 9:
        out = bytearray()
        while len(out) < w * h * n:
            c = data[at]
            k = (c & 127) + 1
            if c & 128:
                out += data[at + 1 : at + 1 + n] * k
                at += 1 + n
            else:
                out += data[at + 1 : at + 1 + n * k]
                at += 1 + n * k
        raw = np.frombuffer(bytes(out[: w * h * n]), np.uint8)
    else:
        raw = np.frombuffer(data, np.uint8, w * h * n, at)
    px = palette[raw.view(np.uint8 if n == 1 else "<u2").astype(int) - first] if kind in (1, 9) else colours(raw.copy(), bits)
    px = px.reshape(h, w, 4)
    if bits == 32 and not flags & 15 and not px[..., 3].any():
        px = px.copy()
        px[..., 3] = 255
    px = px if flags & 32 else px[::-1]
    return [np.ascontiguousarray(px[:, ::-1] if flags & 16 else px)]


def encode_tga(frames, bits=32, rle=False):
    a = frames[0]
    h, w = a.shape[:2]
    n = bits // 8
    raw = np.ascontiguousarray(a[..., [2, 1, 0, 3][:n]])
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 10 if rle else 2, 0, 0, 0, 0, 0, w, h, bits, 32 | (8 if n == 4 else 0))
    if not rle:
        return head + raw.tobytes()
    out = bytearray()
    for row in raw:
        at = 0
        change = np.append(np.flatnonzero((row[1:] != row[:-1]).any(1)) + 1, w)
        for end in change.tolist():
            while at < end:
                k = min(128, end - at)
                out += bytes((127 + k,)) + row[at].tobytes()
                at += k
    return head + bytes(out)


# --- PNG ----------------------------------------------------------------------------------------------------------

_ADAM7 = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def _unfilter(data: bytes, h: int, stride: int, n: int, at: int):
    out = np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(h):
        kind, row = data[at], np.frombuffer(data, np.uint8, stride, at + 1)
        at += 1 + stride
        if kind == 0:
            cur = row
        elif kind == 1:
            cur = np.cumsum(np.pad(row, (0, -stride % n)).reshape(-1, n), 0, dtype=np.uint8).reshape(-1)[:stride]
        elif kind == 2:
            cur = row + above
        elif kind in (3, 4):
            left, up, src = [0] * n, above.tolist(), row.tolist()
            line = [0] * n + [0] * stride
            up = [0] * n + up
            for x in range(n, stride + n):
                a, b = line[x - n], up[x]
                if kind == 3:
                    p = (a + b) // 2
                else:
                    c = up[x - n]
                    e = a + b - c
                    da, db, dc = abs(e - a), abs(e - b), abs(e - c)
                    p = a if da <= db and da <= dc else b if db <= dc else c
                line[x] = (src[x - n] + p) & 255
            cur = np.array(line[n:], np.uint8)
            del left
        else:
            raise CodecError("an unknown filter")
        out[y] = above = cur
    return out, at


def decode_png(data: bytes):
    at, idat, palette, clear, head = 8, [], None, None, None
    frames, control = [], None
    default = {"w": 0, "h": 0}

    def pixels(raw, w, h):
        depth, color, _, _, interlace = head
        n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
        out = np.zeros((h, w, n), np.uint16)
        at = 0
        for y0, x0, dy, dx in _ADAM7 if interlace else ((0, 0, 1, 1),):
            ph, pw = -(-(h - y0) // dy), -(-(w - x0) // dx)
            if ph <= 0 or pw <= 0:
                continue
            stride = (pw * n * depth + 7) // 8
            rows, at = _unfilter(raw, ph, stride, max(1, n * depth // 8), at)
            if depth == 16:
                part = rows.reshape(-1).view(">u2").reshape(ph, pw, n)
            else:
                part = _bits(rows.tobytes(), pw * n, ph, depth, stride).reshape(ph, pw, n)
            out[y0::dy, x0::dx] = part
        if color == 3:
            px = palette[np.minimum(out[..., 0], len(palette) - 1)]
            return px
        full = rgba(np.floor(out * (255 / ((1 << depth) - 1)) + 0.5)).copy()
        if clear is not None and color in (0, 2):
            key = np.frombuffer(clear, ">u2")[:n]
            full[(out == key).all(-1), 3] = 0
        return full

    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            default["w"], default["h"] = struct.unpack_from(">II", body)
            head = struct.unpack_from(">BBBBB", body, 8)
        elif kind == b"PLTE":
            palette = np.full((size // 3, 4), 255, np.uint8)
            palette[:, :3] = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
            if palette is not None:
                palette[: len(body), 3] = np.frombuffer(body, np.uint8)[: len(palette)]
        elif kind == b"fcTL":
            if control and idat:
                frames.append((control, b"".join(idat)))
                idat = []
            control = struct.unpack(">IIIIIHHBB", body)
        elif kind == b"IDAT":
            idat.append(body)
        elif kind == b"fdAT":
            idat.append(body[4:])
        elif kind == b"IEND":
            break
    if head is None or not idat:
        raise CodecError("no image data")
    frames.append((control, b"".join(idat)))
    canvas, out = np.zeros((default["h"], default["w"], 4), np.uint8), []
    for control, raw in frames:
        if control is None:
            return [pixels(zlib.decompress(raw), default["w"], default["h"])]
        _, w, h, x, y, _, _, dispose, blend = control
        part, before = pixels(zlib.decompress(raw), w, h), canvas.copy()
        region = canvas[y : y + h, x : x + w]
        region[...] = np.where(part[..., 3:] > 0, part, region) if blend and (part[..., 3] != 255).any() else part
        out.append(canvas.copy())
        if dispose == 1:
            canvas[y : y + h, x : x + w] = 0
        elif dispose == 2:
            canvas = before
    return out


def _png_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _filtered(a: np.ndarray, n: int, kind: str = "adaptive") -> bytes:
    """Rows with None, Sub or Up filters, whichever has the smallest sum of differences."""
    rows = a.reshape(a.shape[0], -1)
    up = rows.copy()
    up[1:] -= rows[:-1]
    sub = rows.copy()
    sub[:, n:] -= rows[:, :-n]
    picks = [rows, sub, up] if kind == "adaptive" else [{"none": rows, "sub": sub, "up": up}[kind]] * 3
    cost = np.stack([np.abs(p.astype(np.int8).astype(int)).sum(1) for p in picks])
    best = cost.argmin(0) if kind == "adaptive" else np.full(len(rows), {"none": 0, "sub": 1, "up": 2}[kind])
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0] = best
    for k, p in enumerate(picks):
        out[best == k, 1:] = p[best == k]
    return out.tobytes()


def encode_png(frames, level=6, color="rgba", filter="adaptive"):  # noqa: A002
    h, w = frames[0].shape[:2]
    pick = {"rgba": [0, 1, 2, 3], "rgb": [0, 1, 2], "gray": [0]}[color]
    out = b"\x89PNG\r\n\x1a\n" + _png_chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {"rgba": 6, "rgb": 2, "gray": 0}[color], 0, 0, 0))
    if len(frames) > 1:
        out += _png_chunk(b"acTL", struct.pack(">II", len(frames), 0))
    number = 0
    for k, a in enumerate(frames):
        data = zlib.compress(_filtered(np.ascontiguousarray(a[..., pick]), len(pick), filter), level)
        if len(frames) > 1:
            out += _png_chunk(b"fcTL", struct.pack(">IIIIIHHBB", number, w, h, 0, 0, 1, 10, 0, 0))
            number += 1
        if k == 0:
            out += _png_chunk(b"IDAT", data)
        else:
            out += _png_chunk(b"fdAT", struct.pack(">I", number) + data)
            number += 1
    return out + _png_chunk(b"IEND", b"")


# --- LZW and GIF --------------------------------------------------------------------------------------------------


def lzw_decode(data: bytes, bits: int, early: bool = False, high_first: bool = False) -> bytes:
    """GIF's order of bits (low first), or TIFF's (high first, codes grow one early)."""
    clear, end = 1 << bits, (1 << bits) + 1
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, width, last, out = base[:], bits + 1, b"", bytearray()
    held = n = 0
    for byte in data:
        if high_first:
            held = held << 8 | byte
        else:
            held |= byte << n
        n += 8
        while n >= width:
            if high_first:
                code = held >> (n - width) & (1 << width) - 1
                held &= (1 << (n - width)) - 1
            else:
                code = held & (1 << width) - 1
                held >>= width
            n -= width
            if code == clear:
                table, width, last = base[:], bits + 1, b""
                continue
            if code == end:
                return bytes(out)
            if code < len(table):
                entry = table[code]
            elif last:
                entry = last + last[:1]
            else:
                raise CodecError("a damaged code")
            out += entry
            if last and len(table) < 4096:
                table.append(last + entry[:1])
            last = entry
            if len(table) + (1 if early else 0) >= 1 << width and width < 12:
                width += 1
    return bytes(out)


def lzw_encode(data: bytes, bits: int, early: bool = False, high_first: bool = False) -> bytes:
    clear, end = 1 << bits, (1 << bits) + 1
    table, width, out = {bytes([i]): i for i in range(clear)}, bits + 1, bytearray()
    held = n = 0

    def put(code):
        nonlocal held, n
        if high_first:
            held = held << width | code
            n += width
            while n >= 8:
                out.append(held >> (n - 8) & 255)
                n -= 8
                held &= (1 << n) - 1
        else:
            held |= code << n
            n += width
            while n >= 8:
                out.append(held & 255)
                held >>= 8
                n -= 8

    put(clear)
    count, cur = end + 1, b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if cur + c in table:
            cur += c
            continue
        put(table[cur])
        table[cur + c] = count
        count += 1
        if count + (1 if early else 0) > 1 << width and width < 12:
            width += 1
        if count >= 4094:
            put(clear)
            table, width, count = {bytes([k]): k for k in range(clear)}, bits + 1, end + 1
        cur = c
    if cur:
        put(table[cur])
        count += 1
        if count + (1 if early else 0) > 1 << width and width < 12:
            width += 1
    put(end)
    if n:
        out.append((held << 8 - n if high_first else held) & 255)
    return bytes(out)


def decode_gif(data: bytes, max_frames: int | None = None):
    w, h, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13
    table = None
    if flags & 128:
        n = 2 << (flags & 7)
        table = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas, out, clear, dispose = np.zeros((h, w, 4), np.uint8), [], None, 0

    def blocks(at):
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B and (max_frames is None or len(out) < max_frames):
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = blocks(at + 2)
            if label == 0xF9:
                dispose, clear = body[0] >> 2 & 7, body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise CodecError("a damaged block")
        x, y, fw, fh, f = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = table
        if f & 128:
            n = 2 << (f & 7)
            colours = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        bits = data[at]
        body, at = blocks(at + 1)
        idx = np.frombuffer(lzw_decode(body, bits).ljust(fw * fh, b"\0")[: fw * fh], np.uint8).reshape(fh, fw)
        if f & 64:
            order = [r for s, d in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(s, fh, d)]
            turned = np.empty_like(idx)
            turned[order] = idx
            idx = turned
        part = rgba(colours[np.minimum(idx, len(colours) - 1)]).copy()
        before = canvas.copy()
        region = canvas[y : y + fh, x : x + fw]
        region[...] = np.where((idx == clear)[..., None], region, part)[: region.shape[0], : region.shape[1]] if clear is not None else part[: region.shape[0], : region.shape[1]]
        out.append(canvas.copy())
        if dispose == 2:
            canvas[y : y + fh, x : x + fw] = 0
        elif dispose == 3:
            canvas = before
        clear, dispose = None, 0
    if not out:
        raise CodecError("no frame")
    return out


def encode_gif(frames, delay=10):
    """Frames of at most 255 colours each, local tables; pixels that aren't opaque are clear."""
    h, w = frames[0].shape[:2]
    out = bytearray(b"GIF89a" + struct.pack("<HHBBB", w, h, 0x70, 0, 0))
    if len(frames) > 1:
        out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"
    for a in frames:
        flat = a.reshape(-1, 4).copy()
        hole = flat[:, 3] < 128
        flat[hole] = 0
        colours, idx = np.unique(flat[:, :3][~hole], axis=0, return_inverse=True)
        if len(colours) > 255:
            raise CodecError("more than 255 colours: quantize first")
        bits = max(2, int(len(colours)).bit_length())
        table = np.zeros((1 << bits, 3), np.uint8)
        table[: len(colours)] = colours
        full = np.full(len(flat), len(colours), np.uint8)
        full[~hole] = idx
        out += b"\x21\xf9\x04" + struct.pack("<BHB", 0x08 | (1 if hole.any() else 0), delay, len(colours) if hole.any() else 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 128 | bits - 1) + table.tobytes() + bytes((bits,))
        body = lzw_encode(full.tobytes(), bits)
        for k in range(0, len(body), 255):
            out += bytes((len(body[k : k + 255]),)) + body[k : k + 255]
        out.append(0)
    return bytes(out) + b"\x3b"


# --- TIFF ---------------------------------------------------------------------------------------------------------


def packbits_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while at + run < len(data) and run < 128 and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[at]))
            at += run
        else:
            end = at + 1
            while end < len(data) and end - at < 128 and (end + 1 >= len(data) or data[end] != data[end + 1]):
                end += 1
            out += bytes((end - at - 1,)) + data[at:end]
            at = end
    return bytes(out)


_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


def read_ifd(data: bytes, at: int, order: str, big: bool = False) -> tuple[dict, int]:
    """({tag: (type, values)}, where the next directory begins)"""
    n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
    at += 8 if big else 2
    out = {}
    for _ in range(n):
        tag, kind = struct.unpack_from(order + "HH", data, at)
        count = struct.unpack_from(order + ("Q" if big else "I"), data, at + 4)[0]
        size = _SIZES.get(kind, 1) * count
        where = at + (12 if big else 8)
        if size > (8 if big else 4):
            where = struct.unpack_from(order + ("Q" if big else "I"), data, where)[0]
        raw = data[where : where + size]
        if len(raw) == size:
            if kind in (2, 7):
                v = raw
            elif kind in (5, 10):
                p = struct.unpack(order + ("I" if kind == 5 else "i") * 2 * count, raw)
                v = list(zip(p[::2], p[1::2]))
            else:
                v = list(struct.unpack(f"{order}{count}{_CODES.get(kind, 'B')}", raw))
            out[tag] = (kind, v)
        at += 20 if big else 12
    return out, struct.unpack_from(order + ("Q" if big else "I"), data, at)[0] if at + 4 <= len(data) else 0


def decode_tiff(data: bytes, max_frames: int | None = None):
    order = "<" if data[:2] == b"II" else ">"
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    out = []
    while at and (max_frames is None or len(out) < max_frames):
        tags, at = read_ifd(data, at, order, big)
        get = lambda t, d=None: tags[t][1] if t in tags else d
        w, h = get(256)[0], get(257)[0]
        depth, n, kind, photo = get(258, [1])[0], get(277, [1])[0], get(259, [1])[0], get(262, [1])[0]
        rows, predictor, planar = get(278, [h])[0], get(317, [1])[0], get(284, [1])[0]
        if 322 in tags:
            raise CodecError("tiles")
        parts = []
        for start, size in zip(get(273), get(279)):
            raw = data[start : start + size]
            if kind == 5:
                raw = lzw_decode(raw, 8, True, True)
            elif kind in (8, 32946):
                raw = zlib.decompress(raw)
            elif kind == 32773:
                raw = packbits_decode(raw)
            elif kind != 1:
                raise CodecError(f"compression {kind}")
            parts.append(raw)
        per = n if planar == 1 else 1
        stride = (w * per * depth + 7) // 8
        strips = -(-h // rows)
        planes = []
        for p in range(1 if planar == 1 else n):
            raw = b"".join(parts[p * strips : (p + 1) * strips])[: stride * h]
            if depth <= 8:
                v = _bits(raw, w * per, h, depth, stride).reshape(h, w, per).astype(np.int64)
            elif depth == 16:
                v = np.frombuffer(raw, order + "u2").reshape(h, w, per).astype(np.int64)
            elif depth == 32:
                f = get(339, [1])[0] == 3
                v = np.frombuffer(raw, order + ("f4" if f else "u4")).reshape(h, w, per)
                v = np.clip(v * 255.0 if f else v / 16843009.0, 0, 255)
            else:
                raise CodecError(f"{depth} bits a sample")
            if predictor == 2:
                v = np.cumsum(v, 1) % (1 << depth)
            planes.append(v)
        v = np.concatenate(planes, -1) if len(planes) > 1 else planes[0]
        if photo == 3:
            table = np.array(get(320)).reshape(3, -1).T // 257
            px = rgba(table[v[..., 0]])
        else:
            v = np.floor(v * (255 / ((1 << depth) - 1)) + 0.5) if depth < 32 else np.floor(v + 0.5)
            if photo == 0:
                v = 255 - v
            if photo == 5:
                v = np.stack([np.floor((255 - v[..., k]) * (255 - v[..., 3]) / 255 + 0.5) for k in range(3)], -1)
            if photo == 6:
                y, cb, cr = v[..., 0], v[..., 1] - 128.0, v[..., 2] - 128.0
                v = np.clip(np.floor(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1) + 0.5), 0, 255)
            px = rgba(v[..., :4] if v.shape[2] >= 4 else v)
        out.append(np.ascontiguousarray(px))
    return out


def encode_tiff(frames, compression="deflate", color="rgba", predictor=False):
    code = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}[compression]
    pick = {"rgba": [0, 1, 2, 3], "rgb": [0, 1, 2], "gray": [0]}[color]
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for a in frames:
        h, w = a.shape[:2]
        v = np.ascontiguousarray(a[..., pick])
        if predictor:
            d = v.copy()
            d[:, 1:] -= v[:, :-1]
            v = d
        raw = v.tobytes()
        body = {1: lambda b: b, 5: lambda b: lzw_encode(b, 8, True, True), 8: lambda b: zlib.compress(b, 6), 32773: lambda b: b"".join(packbits_encode(b[k : k + w * len(pick)]) for k in range(0, len(b), w * len(pick)))}[code](raw)
        start = len(out)
        out += body + b"\0" * (len(body) & 1)
        bits_at = len(out)
        out += struct.pack(f"<{len(pick)}H", *[8] * len(pick))
        entries = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, len(pick), 8 if len(pick) == 1 else bits_at if len(pick) > 2 else 8 | 8 << 16), (259, 3, 1, code), (262, 3, 1, 1 if len(pick) == 1 else 2), (273, 4, 1, start), (277, 3, 1, len(pick)), (278, 4, 1, h), (279, 4, 1, len(body)), (317, 3, 1, 2 if predictor else 1)]
        if len(pick) == 4:
            entries.append((338, 3, 1, 2))
        at = len(out)
        struct.pack_into("<I", out, link, at)
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


# --- icons, cursors, animated cursors -----------------------------------------------------------------------------


def decode_icon(data: bytes):
    n, out = struct.unpack_from("<H", data, 4)[0], []
    for k in range(n):
        size, at = struct.unpack_from("<II", data, 6 + 16 * k + 8)
        body = data[at : at + size]
        out.append(decode_png(body)[0] if body[:4] == b"\x89PNG" else _dib(body, 0, None, True))
    return out


def encode_icon(frames, cursor=False, hotspot=(0, 0)):
    bodies = [encode_png([a]) for a in frames]
    at = 6 + 16 * len(frames)
    out = struct.pack("<HHH", 0, 2 if cursor else 1, len(frames))
    for a, body in zip(frames, bodies):
        h, w = a.shape[:2]
        out += struct.pack("<BBBBHHII", w % 256, h % 256, 0, 0, hotspot[0] if cursor else 1, hotspot[1] if cursor else 32, len(body), at)
        at += len(body)
    return out + b"".join(bodies)


def decode_ani(data: bytes):
    """Frames in the order of the sequence chunk, if there is one."""
    frames, sequence, at = [], None, 12
    stack = [(at, len(data))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if kind == b"LIST":
                stack.append((at + 8 + size + (size & 1), end))
                at, end = at + 12, at + 8 + size
                continue
            if kind == b"icon":
                frames.append(decode_icon(data[at + 8 : at + 8 + size])[0])
            elif kind == b"seq ":
                sequence = struct.unpack_from(f"<{size // 4}I", data, at + 8)
            at += 8 + size + (size & 1)
    return [frames[k] for k in sequence] if sequence else frames


def encode_ani(frames, rate=6):
    icons = [encode_icon([a], True) for a in frames]
    chunk = lambda kind, body: kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    body = chunk(b"anih", struct.pack("<9I", 36, len(frames), len(frames), 0, 0, 0, 0, rate, 1)) + chunk(b"LIST", b"fram" + b"".join(chunk(b"icon", i) for i in icons))
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"ACON" + body


# --- EXR ----------------------------------------------------------------------------------------------------------


def _exr_header(data: bytes):
    at, out = 8, {}
    while data[at]:
        name_end = data.index(0, at)
        kind_end = data.index(0, name_end + 1)
        size = struct.unpack_from("<I", data, kind_end + 1)[0]
        out[data[at:name_end].decode()] = data[kind_end + 5 : kind_end + 5 + size]
        at = kind_end + 5 + size
    return out, at + 1


def decode_exr(data: bytes):
    head, at = _exr_header(data)
    kind = head["compression"][0]
    if kind not in (0, 2, 3):
        raise CodecError(f"compression {kind}")
    x0, y0, x1, y1 = struct.unpack("<iiii", head["dataWindow"])
    w, h = x1 - x0 + 1, y1 - y0 + 1
    channels, k, body = [], 0, head["channels"]
    while body[k]:
        end = body.index(0, k)
        channels.append((body[k:end].decode(), struct.unpack_from("<i", body, end + 1)[0]))
        k = end + 17
    lines = {0: 1, 2: 1, 3: 16}[kind]
    out = {name: np.zeros((h, w), np.float32) for name, _ in channels}
    for start in struct.unpack_from(f"<{-(-h // lines)}Q", data, at):
        y, size = struct.unpack_from("<iI", data, start)
        raw, n = data[start + 8 : start + 8 + size], min(lines, h - (y - y0))
        full = sum({0: 4, 1: 2, 2: 4}[t] for _, t in channels) * w * n
        if kind and size < full:
            d = np.frombuffer(zlib.decompress(raw), np.uint8).astype(np.int64)
            d[1:] -= 128
            d = (np.cumsum(d) & 255).astype(np.uint8)
            half = (len(d) + 1) // 2
            merged = np.empty(len(d), np.uint8)
            merged[::2], merged[1::2] = d[:half], d[half:]
            raw = merged.tobytes()
        p = 0
        for row in range(n):
            for name, t in channels:
                dtype = {0: "<u4", 1: "<f2", 2: "<f4"}[t]
                out[name][y - y0 + row] = np.frombuffer(raw, dtype, w, p)
                p += w * np.dtype(dtype).itemsize
    get = lambda c, d: out.get(c, d)
    gray = out.get("Y", np.zeros((h, w), np.float32))
    v = np.stack([get("R", gray), get("G", gray), get("B", gray), get("A", np.ones((h, w), np.float32))], -1)
    v[..., :3] = np.where(v[..., :3] <= 0.0031308, v[..., :3] * 12.92, 1.055 * np.maximum(v[..., :3], 1e-9) ** (1 / 2.4) - 0.055)
    return [np.floor(np.clip(v, 0, 1) * 255 + 0.5).astype(np.uint8)]


# --- headers ------------------------------------------------------------------------------------------------------


def identify(data: bytes) -> dict:
    """Format, size, bits a pixel and frames from the headers alone."""
    kind = detect(data)
    out = {"format": kind, "width": None, "height": None, "bits": None, "frames": 1}
    if kind == "png":
        w, h, depth, color = struct.unpack_from(">IIBB", data, 16)
        frames = re.search(rb"acTL", data[:4096])
        out |= {"width": w, "height": h, "bits": depth * {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color], "frames": struct.unpack_from(">I", data, frames.end())[0] if frames else 1}
    elif kind == "gif":
        w, h, flags = struct.unpack_from("<HHB", data, 6)
        out |= {"width": w, "height": h, "bits": (flags & 7) + 1, "frames": None}
    elif kind == "bmp":
        size = struct.unpack_from("<I", data, 14)[0]
        w, h = struct.unpack_from("<HH" if size == 12 else "<ii", data, 18)
        out |= {"width": w, "height": abs(h), "bits": struct.unpack_from("<H", data, 24 if size == 12 else 28)[0]}
    elif kind == "qoi":
        w, h, n = struct.unpack_from(">IIB", data, 4)
        out |= {"width": w, "height": h, "bits": 8 * n}
    elif kind == "pbm":
        k, w, h, top, _ = _pbm_header(data)
        out |= {"width": w, "height": h, "bits": 1 if k in (1, 4) else (16 if top > 255 else 8) * (3 if k in (3, 6) else 1)}
    elif kind == "tga":
        w, h, bits = struct.unpack_from("<HHB", data, 12)
        out |= {"width": w, "height": h, "bits": bits}
    elif kind == "tiff":
        order = "<" if data[:2] == b"II" else ">"
        big, n, at = struct.unpack_from(order + "H", data, 2)[0] == 43, 0, 0
        at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
        while at:
            tags, at = read_ifd(data, at, order, big)
            if not n:
                out |= {"width": tags[256][1][0], "height": tags[257][1][0], "bits": sum(tags[258][1]) if 258 in tags else 1}
            n += 1
        out["frames"] = n
    elif kind in ("ico", "cur"):
        w, h = data[6] or 256, data[7] or 256
        out |= {"width": w, "height": h, "bits": struct.unpack_from("<H", data, 12)[0] if kind == "ico" else 32, "frames": struct.unpack_from("<H", data, 4)[0]}
    elif kind == "jpeg":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            m = data[at + 1]
            if 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
                depth, h, w, n = struct.unpack_from(">BHHB", data, at + 4)
                out |= {"width": w, "height": h, "bits": depth * n}
                break
            at += 2 + (struct.unpack_from(">H", data, at + 2)[0] if m not in (0x01, *range(0xD0, 0xDA)) else 0)
    elif kind == "webp":
        sub = data[12:16]
        if sub == b"VP8X":
            out |= {"width": 1 + int.from_bytes(data[24:27], "little"), "height": 1 + int.from_bytes(data[27:30], "little"), "bits": 32 if data[20] & 16 else 24}
        elif sub == b"VP8L":
            v = int.from_bytes(data[21:25], "little")
            out |= {"width": (v & 0x3FFF) + 1, "height": (v >> 14 & 0x3FFF) + 1, "bits": 32}
        elif sub == b"VP8 ":
            w, h = struct.unpack_from("<HH", data, 26)
            out |= {"width": w & 0x3FFF, "height": h & 0x3FFF, "bits": 24}
    elif kind == "exr":
        head, _ = _exr_header(data)
        x0, y0, x1, y1 = struct.unpack("<iiii", head["dataWindow"])
        out |= {"width": x1 - x0 + 1, "height": y1 - y0 + 1, "bits": None}
    elif kind == "ani":
        out["frames"] = struct.unpack_from("<I", data, data.index(b"anih") + 12)[0]
    return out


DECODERS = {"png": decode_png, "jpeg": decode_jpeg, "webp": decode_webp, "gif": decode_gif, "bmp": decode_bmp, "pbm": decode_pbm, "tga": decode_tga, "qoi": decode_qoi, "tiff": decode_tiff, "ico": decode_icon, "cur": decode_icon, "ani": decode_ani, "exr": decode_exr}
ENCODERS = {"png": encode_png, "jpeg": encode_jpeg, "webp": encode_webp, "gif": encode_gif, "bmp": encode_bmp, "pbm": encode_pbm, "tga": encode_tga, "qoi": encode_qoi, "tiff": encode_tiff, "ico": encode_icon, "cur": lambda f, **k: encode_icon(f, True, **k), "ani": encode_ani}


def decode(data: bytes | None, max_frames: int | None = None, target: tuple[int, int] | None = None) -> list[np.ndarray]:
    """The frames; those of a JPEG no larger than they have to be for the target size."""
    if data is None:
        raise CodecError("no content")
    kind = detect(data)
    if kind not in DECODERS:
        raise CodecError(f"no decoder for {kind or 'this file'}")
    try:
        return (decode_jpeg(data, target) if kind == "jpeg" and DECODERS[kind] is decode_jpeg else DECODERS[kind](data))[:max_frames]
    except CodecError:
        raise
    except (struct.error, zlib.error, ValueError, IndexError, KeyError, TypeError) as e:
        raise CodecError(f"{kind}: {e}") from e


def register(name: str, decoder=None, encoder=None, magic: str | None = None) -> None:
    """Add or replace a format in this process."""
    global MAGIC
    if decoder:
        DECODERS[name] = decoder
    if encoder:
        ENCODERS[name] = encoder
    if magic:
        MAGIC = ((name, 0, magic), *MAGIC)


def scaled_size(width: int, height: int, target: tuple[int, int]) -> tuple[int, int]:
    """A size that fits into the target with its aspect kept."""
    k = min(target[0] / width, target[1] / height)
    return max(1, math.floor(width * k + 0.5)), max(1, math.floor(height * k + 0.5))
