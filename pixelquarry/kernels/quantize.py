"""Palettes of a frame (Wu, hexadecatree, fixed), nearest colours and error diffusion."""

from __future__ import annotations

import numpy as np

from .base import to_bytes, window_of

# Fixed values: (divisor, offset of the current pixel in the first row, rows of weights) of the error diffusions.
DIFFUSIONS = {
    "atkinson": (8, 1, ((0, 0, 1, 1), (1, 1, 1, 0), (0, 1, 0, 0))),
    "burks": (32, 2, ((0, 0, 0, 8, 4), (2, 4, 8, 4, 2))),
    "floyd_steinberg": (16, 1, ((0, 0, 7), (3, 5, 1))),
    "jarvis_judice_ninke": (48, 2, ((0, 0, 0, 7, 5), (3, 5, 7, 5, 3), (1, 3, 5, 3, 1))),
    "sierra2": (16, 2, ((0, 0, 0, 4, 3), (1, 2, 3, 2, 1))),
    "sierra3": (32, 2, ((0, 0, 0, 5, 3), (2, 4, 5, 4, 2), (0, 2, 3, 2, 0))),
    "sierra_lite": (4, 1, ((0, 0, 2), (1, 1, 0))),
    "stevenson_arce": (200, 3, ((0, 0, 0, 0, 0, 32, 0), (12, 0, 26, 0, 30, 0, 16), (0, 12, 0, 26, 0, 12, 0), (5, 0, 12, 0, 12, 0, 5))),
    "stucki": (42, 2, ((0, 0, 0, 8, 4), (2, 4, 8, 4, 2), (1, 2, 4, 2, 1))),
}


def nearest(colours: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Of each colour the palette's nearest one by squared distance over four channels, the first of equals."""
    code, back = np.unique(np.asarray(colours, np.int64).reshape(-1, 4) @ _PLACES, return_inverse=True)
    uniq = (code[:, None] // _PLACES % 256).astype(np.float64)
    toward, own = _distances(palette)
    out = np.empty(len(uniq), np.int64)
    for k in range(0, len(uniq), 4096):
        out[k : k + 4096] = (uniq[k : k + 4096] @ toward + own).argmin(1)
    return out[back].reshape(colours.shape[:-1])


_PLACES = np.array([1 << 24, 1 << 16, 1 << 8, 1])


def _distances(palette: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What makes of a colour its squared distances to a palette (or many), less the colour's own square: a product and a sum. All numbers are whole, so they are exact as floats."""
    p = np.asarray(palette, np.float64)
    return -2 * np.swapaxes(p, -1, -2), (p * p).sum(-1)


def wu_palette(pixels: np.ndarray, colors: int = 256, threshold: int = 0) -> np.ndarray:
    """Wu's variance-minimising boxes over cells of five bits a channel.

    Only cells that occur are held, each with its pixels' count, sums and sum of squares; a box is a list of cells, and all cuts
    along one axis come of one cumulated histogram of it. All sums are whole numbers, so they are exact.
    """
    px = pixels.reshape(-1, 4).astype(np.int64)
    px = np.where(px[:, 3:] < threshold, 0, px)
    if not len(px):
        return np.zeros((0, 4), np.uint8)
    code, cell = np.unique((px >> 3) @ np.array([1 << 15, 1 << 10, 1 << 5, 1]), return_inverse=True)
    at = np.stack([code >> k & 31 for k in (15, 10, 5, 0)])
    moments = np.stack([np.bincount(cell, w, len(code)) for w in (np.ones(len(px)), *px.T, (px * px).sum(1))])

    def spread(box):
        v = moments[:, box].sum(1)
        return v[5] - (v[1:5] ** 2).sum() / v[0]

    def split(box):
        whole, best, chosen = moments[:, box].sum(1), 0.0, None
        for axis in range(4):  # of equal gains the earlier channel, and the lower cut
            place = at[axis, box]
            below = np.stack([np.bincount(place, m[box], 32) for m in moments]).cumsum(1)[:, :-1]
            above = whole[:, None] - below
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (below[1:5] ** 2).sum(0) / below[0] + (above[1:5] ** 2).sum(0) / above[0]
            gain = np.where((below[0] > 0) & (above[0] > 0), gain, 0.0)
            k = int(gain.argmax())
            if gain[k] > best:
                best, chosen = gain[k], place <= k
        return None if chosen is None else (box[chosen], box[~chosen])

    boxes = [np.arange(len(code))]
    spreads = [spread(boxes[0])]
    while len(boxes) < colors:
        k = int(np.argmax(spreads))
        if spreads[k] <= 0:
            break
        parts = split(boxes[k])
        if parts is None:
            spreads[k] = 0.0
            continue
        boxes[k], spreads[k] = parts[0], spread(parts[0])
        boxes.append(parts[1])
        spreads.append(spread(parts[1]))
    means = np.stack([moments[1:5, b].sum(1) / moments[0, b].sum() for b in boxes])
    return np.floor(means + 0.5).astype(np.uint8)


class _Node:
    __slots__ = ("children", "count", "leaf", "sums")

    def __init__(self, leaf):
        self.children, self.leaf, self.count, self.sums = {}, leaf, 0, np.zeros(4, np.int64)


def tree_palette(pixels: np.ndarray, colors: int = 256, threshold: int = 0) -> np.ndarray:
    """A tree with sixteen ways at each level (a bit of each channel; for opaque colours of middling brightness, of three), merged from the deepest level up.

    Distinct colours enter in the order in which they first occur in the frame.
    """
    px = pixels.reshape(-1, 4).astype(np.int64)
    px = np.where(px[:, 3:] < threshold, 0, px)
    code = px[:, 0] | px[:, 1] << 8 | px[:, 2] << 16 | px[:, 3] << 24
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    depth = max(1, min(8, int(np.ceil(np.log2(max(2, colors))))))
    root, levels, leaves = _Node(False), [[] for _ in range(depth)], 0

    def reduce():
        nonlocal leaves
        at = depth - 1
        while at > 0 and not levels[at]:
            at -= 1
        node = levels[at].pop()
        for c in node.children.values():
            node.count += c.count
            node.sums += c.sums
            leaves -= 1
        node.children, node.leaf = {}, True
        leaves += 1

    for k in np.argsort(first, kind="stable"):
        r, g, b, a = c = px[first[k]]
        bright = (54 * r + 183 * g + 19 * b) >> 8  # fixed values: weights of the channels, and the bounds of middling brightness
        three = a == 255 and 85 <= bright <= 171
        node = root
        for level in range(depth):
            if node.leaf:
                break
            bit = 7 - level
            way = int((r >> bit & 1) << 2 | (g >> bit & 1) << 1 | (b >> bit & 1))
            way |= 0 if three else int((a >> bit & 1) << 3)
            if way not in node.children:
                leaf = level == depth - 1
                if not node.children:
                    levels[level].append(node)
                node.children[way] = _Node(leaf)
                leaves += leaf
            node = node.children[way]
        node.count += counts[k]
        node.sums += c * counts[k]
        while leaves > colors:
            reduce()
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.leaf and n.count:
            out.append(np.floor(n.sums / n.count + 0.5))
        stack.extend(n.children[w] for w in sorted(n.children, reverse=True))
    return np.array(out, np.uint8)


def palette_for(v, method="wu", colors=256, palette=None, threshold=64):
    if palette is not None:
        return np.asarray(palette, np.uint8)
    return {"wu": wu_palette, "tree": tree_palette}[method](to_bytes(v), colors, threshold)


def diffuse_bytes(frames: np.ndarray, palettes: np.ndarray, kernel: str, scale: float = 1.0, rect=None) -> np.ndarray:
    """Error diffusion of many frames (count, height, width, 4) of bytes at once, each with its palette (count, colours, 4).

    What a palette's colour misses is handed on to pixels that follow in the window; not to clear ones. Each addition is stored
    as a byte again, rounded and held in range, as pixels of the frame are. So additions to one pixel have to keep the order of the
    scan. Pixels (y, t - s * y) of one t are done at a time, with s so large that no pixel gets anything from a row before the row
    above it is done with it, and that no two pixels of one t reach the same one.
    """
    divisor, offset, rows = DIFFUSIONS[kernel]
    taps = [(dy, dx - offset, np.float32(w) / np.float32(divisor)) for dy, row in enumerate(rows) for dx, w in enumerate(row) if w]
    stride = offset + max(dx for _, dx, _ in taps) + 1
    left, top, right, bottom = rect
    out, unit = frames.copy(), np.float32(255)
    toward, own = _distances(palettes)
    each = np.arange(len(frames))[:, None]
    wide, high = right - left, bottom - top
    for t in range(wide + stride * (high - 1) if wide > 0 and high > 0 else 0):
        ys = np.arange(max(0, -(-(t - wide + 1) // stride)), min(high - 1, t // stride) + 1)
        y, x = ys + top, t - stride * ys + left
        px = out[:, y, x]
        chosen = palettes[each, (px.astype(np.float64) @ toward + own[:, None]).argmin(2)]
        error = (px / unit - chosen / unit) * np.float32(scale)
        out[:, y, x] = chosen
        for dy, dx, weight in taps:
            inside = (y + dy < bottom) & (x + dx >= left) & (x + dx < right)
            if inside.any():
                ty, tx = y[inside] + dy, x[inside] + dx
                there = out[:, ty, tx]
                moved = np.floor(np.clip((there / unit + error[:, inside] * weight) * unit + np.float32(0.5), 0, 255)).astype(np.uint8)
                given = (there[..., 3:] > 0) & (px[:, inside] != chosen[:, inside]).any(2, keepdims=True)
                out[:, ty, tx] = np.where(given, moved, there)
    return out


def _stacked(frames, palettes, kernel, scale, rect):
    """diffuse_bytes() of frames of one size; shorter palettes are filled up with their first colour, which is then never chosen for it."""
    n = max(len(p) for p in palettes)
    full = np.stack([np.concatenate([p, np.repeat(p[:1], n - len(p), 0)]) for p in palettes])
    return diffuse_bytes(frames, full, kernel, scale, window_of(frames[0], rect)) / 255.0


def diffuse_many(frames, palette, kernel="floyd_steinberg", scale=1.0, rect=None):
    work = to_bytes(frames)
    return _stacked(work, [np.asarray(palette, np.uint8)] * len(work), kernel, scale, rect)


def diffuse(v, palette, kernel="floyd_steinberg", scale=1.0, rect=None):
    """Error diffusion onto a palette."""
    return diffuse_many(v[None], palette, kernel, scale, rect)[0]


def quantize_many(frames, method="wu", colors=256, dither: str | None = "floyd_steinberg", palette=None, scale=1.0, rect=None, threshold=64):
    work = to_bytes(frames)
    palettes = [palette_for(v, method, colors, palette, threshold) for v in frames]
    if dither:
        return _stacked(work, palettes, dither, scale, rect)
    left, top, right, bottom = window_of(frames[0], rect)
    out = work.copy()
    for v, pal in zip(out, palettes, strict=True):
        v[top:bottom, left:right] = pal[nearest(v[top:bottom, left:right], pal)]
    return out / 255.0


def quantize(v, method="wu", colors=256, dither: str | None = "floyd_steinberg", palette=None, scale=1.0, rect=None, threshold=64):
    """Palette, then nearest colours, with diffusion if a kernel is named."""
    return quantize_many(v[None], method, colors, dither, palette, scale, rect, threshold)[0]


def binary_dither_many(frames, kernel="floyd_steinberg", upper=(255, 255, 255, 255), lower=(0, 0, 0, 255), rect=None):
    return diffuse_many(frames, [upper, lower], kernel, 1.0, rect)


def binary_dither(v, kernel="floyd_steinberg", upper=(255, 255, 255, 255), lower=(0, 0, 0, 255), rect=None):
    return binary_dither_many(v[None], kernel, upper, lower, rect)[0]


# Frames of one size may be given together.
for _one, _many in ((diffuse, diffuse_many), (quantize, quantize_many), (binary_dither, binary_dither_many)):
    _one.many = _many
