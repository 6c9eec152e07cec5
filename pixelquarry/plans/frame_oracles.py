"""DuckDB twins of frame kernels, written from what the kernels are defined to give; they share no helper with them. 32x32 frames."""

from __future__ import annotations

SIDE = 32
# Divisor and (rows below, columns right of the pixel, weight) of the error diffusions.
SPREADS = {
    "atkinson": (8, ((0, 1, 1), (0, 2, 1), (1, -1, 1), (1, 0, 1), (1, 1, 1), (2, 0, 1))),
    "burks": (32, ((0, 1, 8), (0, 2, 4), (1, -2, 2), (1, -1, 4), (1, 0, 8), (1, 1, 4), (1, 2, 2))),
    "floyd_steinberg": (16, ((0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1))),
    "jarvis_judice_ninke": (48, ((0, 1, 7), (0, 2, 5), (1, -2, 3), (1, -1, 5), (1, 0, 7), (1, 1, 5), (1, 2, 3), (2, -2, 1), (2, -1, 3), (2, 0, 5), (2, 1, 3), (2, 2, 1))),
    "sierra2": (16, ((0, 1, 4), (0, 2, 3), (1, -2, 1), (1, -1, 2), (1, 0, 3), (1, 1, 2), (1, 2, 1))),
    "sierra3": (32, ((0, 1, 5), (0, 2, 3), (1, -2, 2), (1, -1, 4), (1, 0, 5), (1, 1, 4), (1, 2, 2), (2, -1, 2), (2, 0, 3), (2, 1, 2))),
    "sierra_lite": (4, ((0, 1, 2), (1, -1, 1), (1, 0, 1))),
    "stevenson_arce": (200, ((0, 2, 32), (1, -3, 12), (1, -1, 26), (1, 1, 30), (1, 3, 16), (2, -2, 12), (2, 0, 26), (2, 2, 12), (3, -3, 5), (3, -1, 12), (3, 1, 12), (3, 3, 5))),
    "stucki": (42, ((0, 1, 8), (0, 2, 4), (1, -2, 2), (1, -1, 4), (1, 0, 8), (1, 1, 4), (1, 2, 2), (2, -2, 1), (2, -1, 2), (2, 0, 4), (2, 1, 2), (2, 2, 1))),
}


def diffusion(source: str, palette, kernel: str) -> str:
    """Pixel by pixel in the order of the scan; each step's frame is the one before with the pixel's colour chosen and its error added to those that follow, as bytes."""
    divisor, taps = SPREADS[kernel]
    weight = " ".join(f"WHEN {dy * SIDE + dx} THEN {w}" for dy, dx, w in taps)
    far = max(dy * SIDE + dx for dy, dx, _ in taps)
    near = f"CASE WHEN i - k - 1 BETWEEN 1 AND {far} AND abs((i - 1) % {SIDE} - k % {SIDE}) <= 3 THEN CAST(CASE i - k - 1 {weight} ELSE 0 END AS FLOAT) / CAST({divisor} AS FLOAT) ELSE 0 END"
    apart = lambda p: " + ".join(f"({c}[k + 1] - {v}) * ({c}[k + 1] - {v})" for c, v in zip("rgba", p, strict=True))
    chosen = f"list_position([{', '.join(apart(p) for p in palette)}], least({', '.join([*(apart(p) for p in palette), '1e9'])}))"
    colour = {c: f"[{', '.join(str(p[j]) for p in palette)}][chosen]" for j, c in enumerate("rgba")}
    error = ", ".join(f"CAST({c}[k + 1] AS FLOAT) / CAST(255 AS FLOAT) - CAST({colour[c]} AS FLOAT) / CAST(255 AS FLOAT) AS e{c}" for c in "rgba")
    moved = lambda c: f"CAST(floor(least(255, greatest(0, (CAST({c}[i] AS FLOAT) / CAST(255 AS FLOAT) + e{c} * w[i]) * CAST(255 AS FLOAT) + CAST(0.5 AS FLOAT)))) AS INT)"
    step = ", ".join(f"list_transform(range(1, {SIDE * SIDE + 1}), lambda i: CASE WHEN i = k + 1 THEN {colour[c]} WHEN w[i] > 0 AND a[i] > 0 AND (er <> 0 OR eg <> 0 OR eb <> 0 OR ea <> 0) THEN {moved(c)} ELSE {c}[i] END) AS {c}" for c in "rgba")
    lists = ", ".join(f"list(CAST({c} AS INT) ORDER BY y, x) AS {c}" for c in "rgba")
    return f"""SELECT * FROM (WITH RECURSIVE run AS (
  SELECT image_id, frame_no, 0 AS k, {lists} FROM {source} AS px GROUP BY image_id, frame_no
  UNION ALL
  SELECT image_id, frame_no, k + 1 AS k, {step}
  FROM (SELECT *, {error}, list_transform(range(1, {SIDE * SIDE + 1}), lambda i: {near}) AS w FROM (SELECT *, {chosen} AS chosen FROM run WHERE k < {SIDE * SIDE}) AS met) AS met
) SELECT image_id, frame_no, CAST(floor((i - 1) / {SIDE}) AS INT) AS y, CAST((i - 1) % {SIDE} AS INT) AS x, r[i] AS r, g[i] AS g, b[i] AS b, a[i] AS a
FROM (SELECT *, unnest(range(1, {SIDE * SIDE + 1})) AS i FROM run WHERE k = {SIDE * SIDE}) AS done) AS whole"""


_CUBIC = "(CASE WHEN abs({t}) <= 1 THEN 1.5e0 * abs({t}) * {t} * {t} - 2.5e0 * {t} * {t} + 1 WHEN abs({t}) < 2 THEN -0.5e0 * abs({t}) * {t} * {t} + 2.5e0 * {t} * {t} - 4 * abs({t}) + 2 ELSE 0 END)"


def _byte(v: str) -> str:
    return f"CAST(floor(least(1, greatest(0, {v})) * 255 + 0.500000001e0) AS INT)"


def warped(source: str, size: tuple[int, int], x: str, y: str) -> str:
    """Every pixel (px, py) of the target, its middle taken as (u, v), looks at the place (x, y) of the source and weighs the 4x4 pixels around by the cubic of -0.5; colours weigh by their alpha."""
    w, h = size
    grid = f"SELECT f.image_id, f.frame_no, g.py, g.px, ({x}) - 0.5e0 AS sx, ({y}) - 0.5e0 AS sy FROM (SELECT DISTINCT image_id, frame_no FROM {source} AS s) AS f CROSS JOIN (SELECT py, px, px + 0.5e0 AS u, py + 0.5e0 AS v FROM range({h}) AS a(py) CROSS JOIN range({w}) AS b(px)) AS g"
    weight = f"{_CUBIC.format(t='(p.x - t.sx)')} * {_CUBIC.format(t='(p.y - t.sy)')}"
    sums = ", ".join([*(f"coalesce(sum({weight} * (p.{c} / 255e0) * (p.a / 255e0)), 0) AS {c}" for c in "rgb"), f"coalesce(sum({weight} * (p.a / 255e0)), 0) AS a"])
    met = f"SELECT t.image_id, t.frame_no, t.py AS y, t.px AS x, {sums} FROM ({grid}) AS t LEFT JOIN {source} AS p ON p.image_id = t.image_id AND p.frame_no = t.frame_no AND abs(p.x - t.sx) < 2 AND abs(p.y - t.sy) < 2 GROUP BY t.image_id, t.frame_no, t.py, t.px"
    held = ", ".join(f"least(1, greatest(0, {c})) AS {c}" for c in "rgba")
    plain = ", ".join([*(f"{_byte(f'CASE WHEN a > 0 THEN {c} / a ELSE {c} END')} AS {c}" for c in "rgb"), f"{_byte('a')} AS a"])
    return f"SELECT image_id, frame_no, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {plain} FROM (SELECT image_id, frame_no, y, x, {held} FROM ({met}) AS met) AS held"


def rotated(source: str, degrees: float) -> str:
    """About the middle; the canvas holds the turned frame, up to whole pixels."""
    import math

    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    side = SIDE * (abs(c) + abs(s))
    turn = f"cos(radians({degrees}e0))", f"sin(radians({degrees}e0))"
    u, v = f"(u - {side / 2!r})", f"(v - {side / 2!r})"
    return warped(source, (math.ceil(side - 1e-6),) * 2, f"{turn[0]} * {u} + {turn[1]} * {v} + {SIDE / 2}", f"{turn[0]} * {v} - {turn[1]} * {u} + {SIDE / 2}")


def skewed(source: str, degrees_x: float, degrees_y: float) -> str:
    """x grows by y times a tangent and y by x times one, about the middle."""
    import math

    a, b = math.tan(math.radians(degrees_x)), math.tan(math.radians(degrees_y))
    w, h = SIDE * (1 + a), SIDE * (1 + b)
    u, v, whole = f"(u - {w / 2!r})", f"(v - {h / 2!r})", 1 - a * b
    return warped(source, (math.ceil(w - 1e-6), math.ceil(h - 1e-6)), f"({u} - {a!r} * {v}) / {whole!r} + {SIDE / 2}", f"({v} - {b!r} * {u}) / {whole!r} + {SIDE / 2}")


def _room(points) -> tuple[int, int]:
    """The canvas for these corners: from the origin on, or from the least coordinate if that is negative."""
    import math

    out = []
    for values in zip(*points, strict=True):
        low, high = min(values), max(values)
        out.append(math.ceil((high - low if low < 0 else max(high, high - low)) - 1e-6))
    return out[0], out[1]


def scaled_turned_moved(source: str, sx: float, sy: float, degrees: float, dx: float, dy: float) -> str:
    """Scaled from the origin, turned about the frame's middle onto the middle of the turned frame's room, moved."""
    import math

    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    room = SIDE * (c + s) / 2
    there = lambda x, y: (c * (sx * x - 16) - s * (sy * y - 16) + room + dx, s * (sx * x - 16) + c * (sy * y - 16) + room + dy)
    u, v = f"(u - {room + dx!r})", f"(v - {room + dy!r})"
    size = _room([there(x, y) for x in (0, SIDE) for y in (0, SIDE)])
    return warped(source, size, f"({c!r} * {u} + {s!r} * {v} + 16) / {sx!r}", f"({c!r} * {v} - {s!r} * {u} + 16) / {sy!r}")


def right_side_shrunk(source: str, fraction: float) -> str:
    """The right side keeps its middle and gets a fraction of its length; straight lines stay straight."""
    k = (1 - fraction) / (SIDE * fraction)
    x = f"(u / ({1 / fraction!r} - u * {k!r}))"
    return warped(source, (SIDE, SIDE), x, f"v * (1 + {k!r} * {x}) - {x} * {SIDE / 2 * k!r}")


def onto_quad(source: str, corners) -> str:
    """The frame's corners (from the upper left one clockwise) come to four points: the projective map of a square in closed form, inverted by its adjugate."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = corners
    ax, bx, cx = x1 - x2, x3 - x2, x0 - x1 + x2 - x3
    ay, by, cy = y1 - y2, y3 - y2, y0 - y1 + y2 - y3
    det = ax * by - bx * ay
    g, h = (cx * by - bx * cy) / det, (ax * cy - cx * ay) / det
    a, b, c = x1 - x0 + g * x1, x3 - x0 + h * x3, x0
    d, e, f = y1 - y0 + g * y1, y3 - y0 + h * y3, y0
    rows = ((e - f * h, c * h - b, b * f - c * e), (f * g - d, a - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d))
    top_x, top_y, under = (f"({p!r} * u + {q!r} * v + {r!r})" for p, q, r in rows)
    return warped(source, _room(corners), f"{SIDE} * {top_x} / {under}", f"{SIDE} * {top_y} / {under}")


def jpeg_round_trip(source: str, quality: int, gray: bool = False) -> str:
    """8x8 blocks of luminance and chroma, their cosine transforms in whole steps, and back. Without subsampling, so a frame's blocks lie apart."""
    from ..sources.jpeg import STEPS

    scale = f"CASE WHEN {quality} < 50 THEN 5000 // {quality} ELSE 200 - 2 * {quality} END"
    steps = " UNION ALL ".join(f"SELECT {k} AS t, i, greatest(1, least(255, ({list(table)}[i + 1] * ({scale}) + 50) // 100)) AS step FROM range(64) AS r(i)" for k, table in enumerate(STEPS))
    parts = ["0.299e0 * r + 0.587e0 * g + 0.114e0 * b - 128"] + ([] if gray else ["-0.168736e0 * r - 0.331264e0 * g + 0.5e0 * b", "0.5e0 * r - 0.418688e0 * g - 0.081312e0 * b"])
    planes = " UNION ALL ".join(f"SELECT image_id, frame_no, {k} AS c, y // 8 AS yb, x // 8 AS xb, y % 8 AS y, x % 8 AS x, {v} AS v FROM {source} AS s" for k, v in enumerate(parts))
    block = "image_id, frame_no, c, yb, xb"
    one = lambda rows, by, to, other, cos: f"SELECT {block}, {other}, k.{to} AS {to}, sum(v * k.w) AS v FROM ({rows}) AS s JOIN ({cos}) AS k ON k.{by} = s.{by} GROUP BY {block}, {other}, k.{to}"
    wave = lambda k, at: f"SELECT f.f AS {k}, p.p AS {at}, CASE WHEN f.f = 0 THEN sqrt(0.125e0) ELSE 0.5e0 END * cos((2 * p.p + 1) * f.f * pi() / 16) AS w FROM range(8) AS f(f) CROSS JOIN range(8) AS p(p)"
    there = one(one(planes, "x", "u", "y", wave("u", "x")), "y", "q", "u", wave("q", "y"))
    coarse = f"SELECT {block}, q, u, floor(v / step + 0.500000001e0) * step AS v FROM ({there}) AS s JOIN ({steps}) AS t ON t.t = least(c, 1) AND t.i = q * 8 + u"
    back = one(one(coarse, "u", "x", "q", wave("u", "x")), "q", "y", "x", wave("q", "y"))
    samples = f"SELECT image_id, frame_no, c, yb * 8 + y AS y, xb * 8 + x AS x, greatest(0, least(255, floor(v + 128.500000001e0))) AS v FROM ({back}) AS s"
    wide = f"SELECT image_id, frame_no, y, x, max(v) FILTER (c = 0) AS l, coalesce(max(v) FILTER (c = 1), 128) - 128 AS cb, coalesce(max(v) FILTER (c = 2), 128) - 128 AS cr FROM ({samples}) AS s GROUP BY image_id, frame_no, y, x"
    colour = lambda v: f"CAST(greatest(0, least(255, floor({v} + 0.500000001e0))) AS INT)"
    return f"SELECT image_id, frame_no, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {colour('l + 1.402e0 * cr')} AS r, {colour('l - 0.344136e0 * cb - 0.714136e0 * cr')} AS g, {colour('l + 1.772e0 * cb')} AS b, 255 AS a FROM ({wide}) AS w"


def resized(source: str, size: tuple[int, int], rect: tuple[int, int, int, int]) -> str:
    """The frame scaled into a rectangle of the canvas by the cubic of -0.5, weights made to add up to one along each axis; what the rectangle leaves free is clear."""
    (w, h), (left, top, wide, high) = size, rect

    def axis(n: int) -> str:
        scale = max(1.0, SIDE / n)
        t = f"((p.p - ((o.o + 0.5e0) * {SIDE / n!r} - 0.5e0)) / {scale!r})"
        near = f"SELECT o.o, p.p, {_CUBIC.format(t=t)} AS k FROM range({n}) AS o(o) CROSS JOIN range({SIDE}) AS p(p) WHERE abs{t} <= 2.00000001e0"
        return f"SELECT o, p, k / sum(k) OVER (PARTITION BY o) AS k FROM ({near}) AS near"

    weighed = ", ".join([*(f"sum(ky.k * kx.k * (s.{c} / 255e0) * (s.a / 255e0)) AS {c}" for c in "rgb"), "sum(ky.k * kx.k * (s.a / 255e0)) AS a"])
    met = f"SELECT s.image_id, s.frame_no, ky.o AS y, kx.o AS x, {weighed} FROM {source} AS s JOIN ({axis(high)}) AS ky ON ky.p = s.y JOIN ({axis(wide)}) AS kx ON kx.p = s.x GROUP BY s.image_id, s.frame_no, ky.o, kx.o"
    held = ", ".join(f"least(1, greatest(0, {c})) AS {c}" for c in "rgba")
    plain = ", ".join([*(f"{_byte(f'CASE WHEN a > 0 THEN {c} / a ELSE {c} END')} AS {c}" for c in "rgb"), f"{_byte('a')} AS a"])
    done = f"SELECT image_id, frame_no, y + {top} AS y, x + {left} AS x, {plain} FROM (SELECT image_id, frame_no, y, x, {held} FROM ({met}) AS met) AS held"
    grid = f"SELECT f.image_id, f.frame_no, a.y, b.x FROM (SELECT DISTINCT image_id, frame_no FROM {source} AS f0) AS f CROSS JOIN range({h}) AS a(y) CROSS JOIN range({w}) AS b(x)"
    return f"SELECT g.image_id, g.frame_no, CAST(g.y AS INT) AS y, CAST(g.x AS INT) AS x, {', '.join(f'coalesce(d.{c}, 0) AS {c}' for c in 'rgba')} FROM ({grid}) AS g LEFT JOIN ({done}) AS d ON d.image_id = g.image_id AND d.frame_no = g.frame_no AND d.y = g.y AND d.x = g.x"


def resized_in_light(source: str, w: int, h: int) -> str:
    """The whole frame scaled by the cubic of -0.5, with colours made linear before and compressed after."""
    linear = lambda c: f"CASE WHEN {c} / 255e0 <= 0.04045e0 THEN {c} / 255e0 / 12.92e0 ELSE pow(({c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) END * 255e0"
    light = f"(SELECT image_id, frame_no, y, x, {', '.join(f'{linear(c)} AS {c}' for c in 'rgb')}, a FROM {source} AS src)"
    text = resized(light, (w, h), (0, 0, w, h))
    for c in "rgb":  # the colours that are packed to bytes are the linear ones: compress them first
        plain = f"CASE WHEN a > 0 THEN {c} / a ELSE {c} END"
        held = f"least(1, greatest(0, {plain}))"
        text = text.replace(_byte(plain), _byte(f"CASE WHEN {held} <= 0.0031308e0 THEN {held} * 12.92e0 ELSE 1.055e0 * pow({held}, 1 / 2.4e0) - 0.055e0 END"))
    return text


def painted(source: str, levels: int, brush: int) -> str:
    """Around each pixel, the quadrant up and left of it as far as half the brush, edges repeated: the mean colour of the brightness that is commonest first, scanning it row by row."""
    r = brush // 2
    grid = f"SELECT d.d AS dy, e.d AS dx, d.d * {r + 1} + e.d AS n FROM range({r + 1}) AS d(d) CROSS JOIN range({r + 1}) AS e(d)"
    inside = lambda v: f"greatest(0, least({SIDE - 1}, {v}))"
    met = f"SELECT p.image_id, p.frame_no, p.y, p.x, g.n, s.r, s.g, s.b, CAST(round_even((s.r / 255e0 + s.g / 255e0 + s.b / 255e0) / 3 * {levels - 1}, 0) AS INT) AS bin FROM {source} AS p CROSS JOIN ({grid}) AS g JOIN {source} AS s ON s.image_id = p.image_id AND s.frame_no = p.frame_no AND s.y = {inside(f'p.y + g.dy - {r}')} AND s.x = {inside(f'p.x + g.dx - {r}')}"
    bins = f"SELECT image_id, frame_no, y, x, bin, count(*) AS k, max(n) AS last_n, avg(r / 255e0) AS r, avg(g / 255e0) AS g, avg(b / 255e0) AS b FROM ({met}) AS met GROUP BY image_id, frame_no, y, x, bin"
    best = f"SELECT *, row_number() OVER (PARTITION BY image_id, frame_no, y, x ORDER BY k DESC, last_n) AS place FROM ({bins}) AS bins"
    return f"SELECT b.image_id, b.frame_no, b.y, b.x, {', '.join(f'{_byte(f'b.{c}')} AS {c}' for c in 'rgb')}, p.a FROM ({best}) AS b JOIN {source} AS p ON p.image_id = b.image_id AND p.frame_no = b.frame_no AND p.y = b.y AND p.x = b.x WHERE b.place = 1"


def halved(source: str) -> str:
    """Means of 2x2 pixels, colours weighed by their alpha."""
    sums = ", ".join([*(f"sum(({c} / 255e0) * (a / 255e0)) / 4 AS {c}" for c in "rgb"), "sum(a / 255e0) / 4 AS a"])
    met = f"SELECT image_id, 0 AS frame_no, CAST(floor(y / 2e0) AS INT) AS y, CAST(floor(x / 2e0) AS INT) AS x, {sums} FROM {source} AS s GROUP BY image_id, floor(y / 2e0), floor(x / 2e0)"
    return f"SELECT image_id, frame_no, y, x, {', '.join(f'{_byte(f'CASE WHEN a > 0 THEN {c} / a ELSE {c} END')} AS {c}' for c in 'rgb')}, {_byte('a')} AS a FROM ({met}) AS met"


def cropped_to(source: str, edges: str, least: int) -> str:
    """Each image cropped to the box of the edges that are as bright; its last row and column are left out, but for the only one. Images without such edges stay whole."""
    box = f"SELECT image_id, frame_no, min(x) AS x0, min(y) AS y0, greatest(1, max(x) - min(x)) AS w, greatest(1, max(y) - min(y)) AS h FROM ({edges}) AS e WHERE floor(0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b + 0.5e0) >= {least} GROUP BY image_id, frame_no"
    return f"SELECT p.image_id, p.frame_no, p.y - coalesce(q.y0, 0) AS y, p.x - coalesce(q.x0, 0) AS x, p.r, p.g, p.b, p.a FROM {source} AS p LEFT JOIN ({box}) AS q ON q.image_id = p.image_id AND q.frame_no = p.frame_no WHERE q.w IS NULL OR (p.x >= q.x0 AND p.x < q.x0 + q.w AND p.y >= q.y0 AND p.y < q.y0 + q.h)"
