"""Metadata profiles: EXIF, IPTC, XMP, ICC and CICP, found in files and parsed to rows."""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from ..frames import one_pass
from .codecs import _CODES, _SIZES, detect, read_ifd

EXIF_POINTERS = {0x8769: "exif", 0x8825: "gps", 0xA005: "interop"}
ORIENTATION = 0x0112


def segments(data: bytes) -> dict[str, bytes]:
    """Raw profiles of a JPEG, PNG, TIFF or WebP file: exif (from its TIFF header on), xmp, icc, iptc, cicp."""
    out: dict[str, bytes] = {}
    kind = detect(data)
    if kind == "jpeg":
        at, icc = 2, {}
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            if data[at + 1] == 0xE1 and body.startswith(b"Exif\0\0"):
                out["exif"] = body[6:]
            elif data[at + 1] == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
                out["xmp"] = body[29:]
            elif data[at + 1] == 0xE2 and body.startswith(b"ICC_PROFILE\0"):
                icc[body[12]] = body[14:]
            elif data[at + 1] == 0xED and b"8BIM\x04\x04" in body:
                k = body.index(b"8BIM\x04\x04") + 6
                k += 1 + body[k] + (1 - body[k] % 2) if body[k] else 2
                out["iptc"] = body[k + 4 : k + 4 + struct.unpack_from(">I", body, k)[0]]
            at += 2 + size
        if icc:
            out["icc"] = b"".join(icc[k] for k in sorted(icc))
    elif kind == "png":
        at = 8
        while at + 8 <= len(data):
            size, name = struct.unpack_from(">I4s", data, at)
            body = data[at + 8 : at + 8 + size]
            at += 12 + size
            if name == b"eXIf":
                out["exif"] = body
            elif name == b"iCCP":
                out["icc"] = zlib.decompress(body[body.index(0) + 2 :])
            elif name == b"cICP":
                out["cicp"] = body
            elif name == b"iTXt" and body.startswith(b"XML:com.adobe.xmp\0"):
                out["xmp"] = body.split(b"\0", 5)[-1]
    elif kind == "tiff":
        out["exif"] = data
        order = "<" if data[:2] == b"II" else ">"
        tags, _ = read_ifd(data, struct.unpack_from(order + "I", data, 4)[0], order)
        for tag, name in ((700, "xmp"), (33723, "iptc"), (34675, "icc")):
            if tag in tags:
                v = tags[tag][1]
                out[name] = v if isinstance(v, bytes) else bytes(v)
    elif kind == "webp":
        at = 12
        while at + 8 <= len(data):
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name in (b"EXIF", b"XMP ", b"ICCP"):
                body = data[at + 8 : at + 8 + size]
                out[{b"EXIF": "exif", b"XMP ": "xmp", b"ICCP": "icc"}[name]] = body.removeprefix(b"Exif\0\0")
            at += 8 + size + (size & 1)
    return out


def exif_tags(exif: bytes) -> list[tuple[str, int, int, object]]:
    """(directory, tag, type, value); single values alone, several in a list, rationals as pairs, texts without their zero."""
    order = "<" if exif[:2] == b"II" else ">"
    out, todo, seen = [], [("image", struct.unpack_from(order + "I", exif, 4)[0])], set()
    while todo:
        name, at = todo.pop(0)
        if not at or at in seen or at >= len(exif):
            continue
        seen.add(at)
        tags, following = read_ifd(exif, at, order)
        for tag, (kind, v) in sorted(tags.items()):
            if tag in EXIF_POINTERS:
                todo.append((EXIF_POINTERS[tag], v[0]))
            if kind == 2:
                v = v.split(b"\0")[0].decode("utf-8", "replace")
            elif kind != 7 and len(v) == 1:
                v = v[0]
            out.append((name, tag, kind, v))
        if name == "image" and following:
            todo.append(("thumbnail", following))
    return out


def exif_bytes(tags: list[tuple[str, int, int, object]]) -> bytes:
    """A little-endian TIFF structure of tags (directories image, exif and gps)."""
    groups = {n: [t for t in tags if t[0] == n and t[1] not in EXIF_POINTERS] for n in ("image", "exif", "gps")}
    out = bytearray(b"II*\0\x08\0\0\0")

    def raw(kind, v):
        if kind == 2:
            return v.encode() + b"\0"
        if kind == 7:
            return bytes(v)
        v = v if isinstance(v, list) else [v]
        if kind in (5, 10):
            return b"".join(struct.pack("<II" if kind == 5 else "<ii", *p) for p in v)
        return struct.pack(f"<{len(v)}{_CODES[kind]}", *v)

    pointers = [(tag, name) for tag, name in EXIF_POINTERS.items() if groups.get(name)]
    patches = {}
    for name in ("image", "exif", "gps"):
        if name != "image" and not groups[name]:
            continue
        entries = [(t, k, v) for _, t, k, v in groups[name]] + ([(t, 4, 0) for t, _ in pointers] if name == "image" else [])
        if name in patches:
            struct.pack_into("<I", out, patches[name], len(out))
        at = len(out)
        out += struct.pack("<H", len(entries)) + bytes(12 * len(entries) + 4)
        for n, (tag, kind, v) in enumerate(sorted(entries)):
            body, where = raw(kind, v), at + 2 + 12 * n
            count = len(body) // _SIZES[kind]
            struct.pack_into("<HHI", out, where, tag, kind, count)
            if len(body) <= 4:
                out[where + 8 : where + 8 + len(body)] = body
            else:
                struct.pack_into("<I", out, where + 8, len(out))
                out += body + b"\0" * (len(body) & 1)
            if tag in EXIF_POINTERS and name == "image":
                patches[EXIF_POINTERS[tag]] = where + 8
    return bytes(out)


PIXEL_SIZE = (0xA002, 0xA003)


def orientation(data: bytes | None) -> int:
    """The EXIF orientation of a file, 1 where it has none or it can't be read."""
    try:
        found = segments(data).get("exif") if data else None
        tags = {(d, t): v for d, t, _, v in exif_tags(found)} if found else {}
    except (struct.error, IndexError, KeyError, ValueError, zlib.error):
        return 1
    v = tags.get(("image", ORIENTATION), 1)
    return v if v in range(1, 9) else 1


def synchronised(exif: bytes, width: int, height: int) -> bytes:
    """EXIF of an image that stands upright and has this size: orientation 1, and the size where it is noted; the thumbnail isn't kept."""
    kept = []
    for d, t, k, v in exif_tags(exif):
        if d in ("image", "exif", "gps"):
            kept.append((d, t, k, 1 if (d, t) == ("image", ORIENTATION) else dict(zip(PIXEL_SIZE, (width, height))).get(t, v) if d == "exif" else v))
    return exif_bytes(kept)


def with_exif(data: bytes, exif: bytes) -> bytes:
    """A PNG or JPEG file with this EXIF and no other."""
    kind = detect(data)
    if kind == "png":
        out, at = [data[:8]], 8
        while at + 12 <= len(data):
            size, name = struct.unpack_from(">I4s", data, at)
            if name != b"eXIf":
                out.append(data[at : at + 12 + size])
            if name == b"IHDR":
                out.append(struct.pack(">I", len(exif)) + b"eXIf" + exif + struct.pack(">I", zlib.crc32(b"eXIf" + exif)))
            at += 12 + size
        return b"".join(out)
    if kind == "jpeg":
        out, at = [data[:2], struct.pack(">HH", 0xFFE1, len(exif) + 8) + b"Exif\0\0" + exif], 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            size = struct.unpack_from(">H", data, at + 2)[0]
            if data[at + 1 : at + 2] + data[at + 4 : at + 10] != b"\xe1Exif\0\0":
                out.append(data[at : at + 2 + size])
            at += 2 + size
        return b"".join([*out, data[at:]])
    raise ValueError(f"no place for EXIF in {kind or 'this file'}")


def iptc_values(data: bytes) -> list[tuple[int, int, bytes]]:
    """(record, number, value)"""
    out, at = [], 0
    while at + 5 <= len(data) and data[at] == 0x1C:
        record, number, size = data[at + 1], data[at + 2], struct.unpack_from(">H", data, at + 3)[0]
        at += 5
        if size & 0x8000:
            n = size & 0x7FFF
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        out.append((record, number, data[at : at + size]))
        at += size
    return out


def iptc_bytes(values) -> bytes:
    return b"".join(b"\x1c" + bytes((r, n)) + struct.pack(">H", len(v)) + v for r, n, v in values)


def icc_header(data: bytes) -> dict:
    """Size, version, class, colour space, connection space, tags, and the profile's MD5 id (flags, intent and id zeroed)."""
    n = struct.unpack_from(">I", data, 128)[0]
    blank = bytearray(data)
    blank[44:48], blank[64:68], blank[84:100] = bytes(4), bytes(4), bytes(16)
    text = lambda a: data[a : a + 4].decode("latin-1").strip()
    return {
        "size": struct.unpack_from(">I", data)[0],
        "version": f"{data[8]}.{data[9] >> 4}.{data[9] & 15}",
        "profile_class": text(12),
        "color_space": text(16),
        "pcs": text(20),
        "id": hashlib.md5(bytes(blank)).hexdigest(),
        "tags": [(text(132 + 12 * k), *struct.unpack_from(">II", data, 136 + 12 * k)) for k in range(n)],
        "valid": data[36:40] == b"acsp" and len(data) >= 128,
    }


def cicp(data: bytes) -> dict:
    return dict(zip(("primaries", "transfer", "matrix", "full_range"), data[:4]))


def exif_rows(files: DataFrame) -> DataFrame:
    """(image_id, directory, tag, type, value) of a DataFrame with image_id and content; files without EXIF give no rows."""
    names = ["image_id", "directory", "tag", "type", "value"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def run(batches):
        for b in batches:
            rows = []
            for i, data in zip(b["image_id"].to_pylist(), b["content"].to_pylist(), strict=True):
                found = segments(data).get("exif")
                rows += [(i, d, t, k, v.hex() if isinstance(v, bytes) else str(v)) for d, t, k, v in exif_tags(found)] if found else []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return one_pass(files, ("image_id", "content"), run, "image_id long, directory string, tag int, type int, value string")
