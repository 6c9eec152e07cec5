"""Packed pixel formats: how a format's bits become scaled red, green, blue and alpha, and back."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Sums of products come in any order; values this near below a half count as a half.
TIE = 1e-9


@dataclass(frozen=True)
class Format:
    """dtype of a component or of the whole packed pixel; order of components in memory; bits of each where packed, lowest first; alpha: none, unassociated, associated; scale of a component."""

    dtype: str
    order: str
    bits: tuple[int, ...] = ()
    alpha: str = "none"
    scale: float | None = None

    @property
    def bits_per_pixel(self) -> int:
        return sum(self.bits) if self.bits else 8 * np.dtype(self.dtype).itemsize * len(self.order)


def _family(name, dtype, order, scale=None):
    return {name: Format(dtype, order, alpha="unassociated", scale=scale), f"{name}P": Format(dtype, order, alpha="associated", scale=scale)}


FORMATS = {
    "A8": Format("u1", "a", alpha="unassociated"),
    **_family("Abgr32", "u1", "abgr"),
    **_family("Argb32", "u1", "argb"),
    "Bgr24": Format("u1", "bgr"),
    "Bgr565": Format("u2", "bgr", (5, 6, 5)),
    **_family("Bgra32", "u1", "bgra"),
    "Bgra4444": Format("u2", "bgra", (4, 4, 4, 4), "unassociated"),
    "Bgra5551": Format("u2", "bgra", (5, 5, 5, 1), "unassociated"),
    "Byte4": Format("u1", "rgba", alpha="unassociated"),
    "HalfSingle": Format("f2", "r", scale=1.0),
    "HalfVector2": Format("f2", "rg", scale=1.0),
    **_family("HalfVector4", "f2", "rgba", 1.0),
    "L16": Format("u2", "l"),
    "L8": Format("u1", "l"),
    "La16": Format("u1", "la", alpha="unassociated"),
    "La32": Format("u2", "la", alpha="unassociated"),
    "NormalizedByte2": Format("i1", "rg", scale=127.0),
    **_family("NormalizedByte4", "i1", "rgba", 127.0),
    "NormalizedShort2": Format("i2", "rg", scale=32767.0),
    "NormalizedShort4": Format("i2", "rgba", alpha="unassociated", scale=32767.0),
    "Rg32": Format("u2", "rg"),
    "Rgb24": Format("u1", "rgb"),
    "Rgb48": Format("u2", "rgb"),
    "Rgb96": Format("u4", "rgb"),
    "Rgba1010102": Format("u4", "rgba", (10, 10, 10, 2), "unassociated"),
    "Rgba128": Format("u4", "rgba", alpha="unassociated"),
    **_family("Rgba32", "u1", "rgba"),
    "Rgba64": Format("u2", "rgba", alpha="unassociated"),
    **_family("RgbaHalf", "f2", "rgba", 1.0),
    "RgbaVector": Format("f4", "rgba", alpha="unassociated", scale=1.0),
    "Short2": Format("i2", "rg", scale=32767.0),
    "Short4": Format("i2", "rgba", alpha="unassociated", scale=32767.0),
}


def unpack(data: bytes, name: str) -> np.ndarray:
    """n x 4 scaled, unassociated; what a format doesn't have is 0, alpha 1. Signed formats go from -1..1 to 0..1."""
    f = FORMATS[name]
    if f.bits:
        v, parts, at = np.frombuffer(data, "<" + f.dtype).astype(np.int64), [], 0
        for n in f.bits:
            parts.append((v >> at & (1 << n) - 1) / ((1 << n) - 1))
            at += n
        c = np.stack(parts, -1)
    else:
        raw = np.frombuffer(data, "<" + f.dtype).reshape(-1, len(f.order))
        kind = f.dtype[0]
        c = raw.astype(np.float64) / (f.scale or float(np.iinfo(f.dtype).max if kind == "u" else 1))
        if kind == "i":
            c = (np.maximum(c, -1) + 1) / 2
    out = np.zeros((len(c), 4))
    out[:, 3] = 1
    for k, ch in enumerate(f.order):
        if ch == "l":
            out[:, :3] = c[:, k : k + 1]
        else:
            out[:, "rgba".index(ch)] = c[:, k]
    if f.alpha == "associated":
        a = out[:, 3:]
        out[:, :3] = np.where(a > 0, out[:, :3] / np.where(a > 0, a, 1), out[:, :3])
    return out


def pack(v: np.ndarray, name: str) -> bytes:
    """Scaled, unassociated n x 4 to a format's bytes."""
    f = FORMATS[name]
    v = np.clip(np.asarray(v, float), 0, 1).copy()
    if f.alpha == "associated":
        v[:, :3] *= v[:, 3:]
    cols = [v[:, :3] @ np.array([0.2126, 0.7152, 0.0722]) if ch == "l" else v[:, "rgba".index(ch)] for ch in f.order]
    if f.bits:
        out, at = np.zeros(len(v), np.int64), 0
        for c, n in zip(cols, f.bits):
            out |= np.floor(c * ((1 << n) - 1) + 0.5 + TIE).astype(np.int64) << at
            at += n
        return out.astype("<" + f.dtype).tobytes()
    c = np.stack(cols, -1)
    kind = f.dtype[0]
    if kind == "f":
        return (c * f.scale).astype("<" + f.dtype).tobytes()
    if kind == "i":
        return np.rint((c * 2 - 1) * f.scale).astype("<" + f.dtype).tobytes()
    return np.floor(c * np.iinfo(f.dtype).max + 0.5 + TIE).astype("<" + f.dtype).tobytes()


def convert(data: bytes, source: str, target: str) -> bytes:
    return pack(unpack(data, source), target)
