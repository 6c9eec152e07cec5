"""Re-keying of pixels: crop, flip, rotate, pad, pixelate, nearest neighbour; and the arithmetic of sizes."""

from __future__ import annotations

import numpy as np

from ..functions.expr import KEYS, inside, operator


def _sized(source) -> str:
    return f"(SELECT {KEYS}, r, g, b, a, max(x) OVER (PARTITION BY image_id, frame_no) + 1 AS w, max(y) OVER (PARTITION BY image_id, frame_no) + 1 AS h FROM {source}) AS sized"


@operator
def crop(source, rect):
    """Only the rectangle (x, y, width, height), from its own corner on; a filter that Catalyst pushes to the scan."""
    return f"SELECT image_id, frame_no, y - {rect[1]} AS y, x - {rect[0]} AS x, r, g, b, a FROM {source} WHERE {inside(rect)}"


@operator
def swizzle(source, x: str, y: str):
    """Pixels moved to the places that two expressions over x, y, w and h give."""
    return f"SELECT image_id, frame_no, CAST({y} AS INT) AS y, CAST({x} AS INT) AS x, r, g, b, a FROM {_sized(source)}"


@operator
def flip(source, mode: str):
    return swizzle.sql(source, *(("w - 1 - x", "y") if mode == "horizontal" else ("x", "h - 1 - y")))


@operator
def rotate_right_angle(source, degrees: int):
    """Clockwise by 0, 90, 180 or 270 degrees."""
    return swizzle.sql(source, *{0: ("x", "y"), 90: ("h - 1 - y", "x"), 180: ("w - 1 - x", "h - 1 - y"), 270: ("y", "w - 1 - x")}[degrees % 360])


@operator
def rotate_flip(source, degrees: int, mode: str | None = None):
    turned = rotate_right_angle.sql(source, degrees)
    return flip.sql(f"({turned}) AS turned", mode) if mode else turned


#: EXIF orientation -> (degrees, flip).
ORIENTATIONS = {1: (0, None), 2: (0, "horizontal"), 3: (180, None), 4: (0, "vertical"), 5: (90, "horizontal"), 6: (90, None), 7: (90, "vertical"), 8: (270, None)}


@operator
def auto_orient(source, orientation: int):
    return rotate_flip.sql(source, *ORIENTATIONS.get(orientation, (0, None)))


@operator
def pixelate(source, size: int = 4):
    """Blocks take the colour of the pixel at half their size (or at the image's last one), not their mean."""
    at = lambda c, n: f"least(CAST(floor({c} / {size}e0) AS INT) * {size} + {size // 2}, {n} - 1)"
    return f"SELECT p.image_id, p.frame_no, p.y, p.x, q.r, q.g, q.b, q.a FROM (SELECT {KEYS}, {at('x', 'w')} AS sx, {at('y', 'h')} AS sy FROM {_sized(source)}) AS p JOIN {source} AS q ON q.image_id = p.image_id AND q.frame_no = p.frame_no AND q.x = p.sx AND q.y = p.sy"


def grid(width: int, height: int) -> str:
    """All places (y, x) of a size, in SQL of either dialect."""
    digits = " UNION ALL ".join(f"SELECT {k} AS d" for k in range(16))
    number = lambda n: f"(SELECT CAST(p.d * 256 + q.d * 16 + s.d AS INT) AS v FROM ({digits}) AS p CROSS JOIN ({digits}) AS q CROSS JOIN ({digits}) AS s WHERE p.d * 256 + q.d * 16 + s.d < {n})"
    return f"(SELECT gy.v AS y, gx.v AS x FROM {number(height)} AS gy CROSS JOIN {number(width)} AS gx) AS places"


@operator
def resize_nearest(source, width: int, height: int):
    """Every pixel of the new size takes the source pixel under its corner; an equality join on the source's place."""
    sizes = f"SELECT image_id, frame_no, max(x) + 1 AS w, max(y) + 1 AS h FROM {source} GROUP BY image_id, frame_no"
    wanted = f"SELECT s.image_id, s.frame_no, places.y, places.x, CAST(floor(places.y * (s.h * 1e0 / {height})) AS INT) AS sy, CAST(floor(places.x * (s.w * 1e0 / {width})) AS INT) AS sx FROM ({sizes}) AS s CROSS JOIN {grid(width, height)}"
    return f"SELECT d.image_id, d.frame_no, d.y, d.x, q.r, q.g, q.b, q.a FROM ({wanted}) AS d JOIN {source} AS q ON q.image_id = d.image_id AND q.frame_no = d.frame_no AND q.x = d.sx AND q.y = d.sy"


@operator
def pad(source, width: int, height: int, color=(0, 0, 0, 0)):
    """Grown to at least a size, the image in the middle; never smaller."""
    sizes = f"SELECT image_id, frame_no, max(x) + 1 AS w, max(y) + 1 AS h FROM {source} GROUP BY image_id, frame_no"
    wanted = f"SELECT s.image_id, s.frame_no, places.y, places.x, places.y - CAST(floor(({height} - s.h) / 2e0) AS INT) AS sy, places.x - CAST(floor(({width} - s.w) / 2e0) AS INT) AS sx FROM (SELECT * FROM ({sizes}) AS z WHERE w <= {width} AND h <= {height}) AS s CROSS JOIN {grid(width, height)}"
    cols = ", ".join(f"coalesce(q.{c}, {v}) AS {c}" for c, v in zip("rgba", color))
    return f"SELECT d.image_id, d.frame_no, d.y, d.x, {cols} FROM ({wanted}) AS d LEFT JOIN {source} AS q ON q.image_id = d.image_id AND q.frame_no = d.frame_no AND q.x = d.sx AND q.y = d.sy"


@operator
def blank(source, width: int, height: int, color=(0, 0, 0, 0)):
    """New images of one colour, for each image_id of a relation."""
    cols = ", ".join(f"{v} AS {c}" for c, v in zip("rgba", color))
    return f"SELECT i.image_id, 0 AS frame_no, places.y, places.x, {cols} FROM (SELECT DISTINCT image_id FROM {source}) AS i CROSS JOIN {grid(width, height)}"


@operator
def bounding_box(source, condition: str):
    """(image_id, frame_no, x0, y0, x1, y1) of the pixels for which a condition holds; x1 and y1 lie outside."""
    return f"SELECT image_id, frame_no, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM {source} WHERE {condition} GROUP BY image_id, frame_no"


@operator
def crop_to_box(source, box):
    """Each image cropped to its row of a relation of boxes; images without one stay whole."""
    return f"SELECT p.image_id, p.frame_no, p.y - coalesce(q.y0, 0) AS y, p.x - coalesce(q.x0, 0) AS x, p.r, p.g, p.b, p.a FROM {source} AS p LEFT JOIN ({box}) AS q ON q.image_id = p.image_id AND q.frame_no = p.frame_no WHERE q.x0 IS NULL OR (p.x >= q.x0 AND p.x < q.x1 AND p.y >= q.y0 AND p.y < q.y1)"


@operator
def memory_size(source, bits: int = 32):
    """Bytes of each image's pixels, all frames."""
    return f"SELECT image_id, CAST(sum(w * h * {bits} / 8) AS BIGINT) AS n_bytes FROM (SELECT image_id, frame_no, CAST(max(x) + 1 AS BIGINT) AS w, CAST(max(y) + 1 AS BIGINT) AS h FROM {source} GROUP BY image_id, frame_no) AS sizes GROUP BY image_id"


# --- sizes ---------------------------------------------------------------------------------------------------------

#: Anchor -> where the free space goes (0 before, 0.5 on both sides, 1 after the image's start).
ANCHORS = {"center": (0.5, 0.5), "top": (0.5, 0), "bottom": (0.5, 1), "left": (0, 0.5), "right": (1, 0.5), "top_left": (0, 0), "top_right": (1, 0), "bottom_left": (0, 1), "bottom_right": (1, 1)}


#: Mode -> whether the scaled source covers the target (or else lies in it), and how its free side is rounded.
FITS = {"crop": (True, np.ceil), "pad": (False, np.rint), "box_pad": (False, np.rint), "max": (False, np.rint)}


def _length(v) -> int:
    return max(1, int(v))


def _offset(free, anchor: float) -> int:
    """Where something begins that leaves so much free."""
    return int(np.rint(free * np.float32(anchor)))


def _kept_axis(source, target) -> int:
    """For "min": the axis (0 or 1) that gets its target length, the one that shrinks by less; of equal ones the longer target's other axis."""
    less = source - target
    return int(less[0] > less[1]) if less[0] != less[1] else int(target[1] <= target[0])


def resize_geometry(source: tuple[int, int], target: tuple[int, int], mode: str = "stretch", anchor: str = "center", center: tuple[float, float] | None = None, rect=None):
    """((width, height) of the canvas, (x, y, width, height) into which the source is drawn). A zero in target keeps the aspect.

    Lengths are 32-bit floats, halves are rounded to even, as in the fixed semantics of these modes.
    """
    s = np.array(source, np.float32)
    given = np.array(target, np.float32)
    if not given.any():
        raise ValueError("width or height is needed")
    if not given.all():
        have = int(given[0] == 0)
        given[1 - have] = _length(np.rint(s[1 - have] * (given[have] / s[have])))
    size = [int(v) for v in given]
    if mode == "manual":
        return tuple(size), tuple(rect)
    if mode == "stretch":
        return tuple(size), (0, 0, *size)
    scale, at, drawn = given / s, [0, 0], list(size)
    if mode == "min":
        if (given > s).any():  # it doesn't grow
            return tuple(source), (0, 0, *source)
        kept = _kept_axis(s, given)
        drawn[1 - kept] = _length(np.rint(s[1 - kept] * scale[kept]))
        return tuple(drawn), (0, 0, *drawn)
    if mode == "box_pad" and (s < given).all():  # not scaled, only placed
        return tuple(size), (*(int((g - l) * a) for g, l, a in zip(size, source, ANCHORS[anchor], strict=True)), *source)
    covers, whole = FITS[mode]
    # one axis gets its target length, the other one is free
    if covers:
        tight = int(scale[0] <= scale[1])
    else:
        tight = int(scale[1] < scale[0]) if mode != "max" else int(scale[0] >= scale[1])
    free = 1 - tight
    length = s[free] * scale[tight]
    drawn[free] = _length(whole(length))
    if mode == "max":
        return tuple(drawn), (0, 0, *drawn)
    left = given[free] - length
    if covers and center is not None:  # the point comes to the middle as far as the source still covers the target
        at[free] = int(min(0, max(np.rint(left), np.rint(given[free] / np.float32(2) - length * np.float32(center[free])))))
    else:
        at[free] = _offset(left, ANCHORS[anchor][free])
    return tuple(size), (*at, *drawn)
