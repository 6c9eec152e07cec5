"""Blending: 18 colour modes by 13 ways to compose alpha, as expressions; overlays; drawing one image on another as a join."""

from __future__ import annotations

from ..functions import matrices as M
from ..functions.expr import KEYS, clamp, inside, num, operator, pack, scaled
from .color import filter_matrix


def _each(f):
    """A mode that treats each channel by itself."""
    return lambda b, s: [f(x, y) for x, y in zip(b, s)]


def _overlay(b, s):
    return f"least(1e0, CASE WHEN {b} <= 0.5e0 THEN 2e0 * {b} * {s} ELSE 1e0 - 2e0 * (1e0 - {s}) * (1e0 - {b}) END)"


def _soft(b, s):
    d = f"CASE WHEN {b} <= 0.25e0 THEN ((16e0 * {b} - 12e0) * {b} + 4e0) * {b} ELSE sqrt({b}) END"
    return f"CASE WHEN {s} <= 0.5e0 THEN {b} - (1e0 - 2e0 * {s}) * {b} * (1e0 - {b}) ELSE {b} + (2e0 * {s} - 1e0) * (({d}) - {b}) END"


def _lum(c):
    return f"(0.3e0 * {c[0]} + 0.59e0 * {c[1]} + 0.11e0 * {c[2]})"


def _low(c):
    return f"least({', '.join(c)})"


def _high(c):
    return f"greatest({', '.join(c)})"


def _set_saturation(c, sat):
    span = f"({_high(c)} - {_low(c)})"
    return [f"(CASE WHEN {span} = 0e0 THEN 0e0 ELSE ({x} - {_low(c)}) * ({sat} / {span}) END)" for x in c]


def _set_luminosity(c, lum):
    moved = [f"({x} + ({lum} - {_lum(c)}))" for x in c]
    low, high = _low(moved), _high(moved)
    # only one of the bounds can be passed where luminosity is within 0 and 1 on each side; the lower one is mended first
    up = [f"(CASE WHEN {low} < 0e0 THEN {lum} + ({x} - {lum}) * ({lum} / ({lum} - {low})) ELSE {x} END)" for x in moved]
    high = f"(CASE WHEN {low} < 0e0 THEN {lum} + ({high} - {lum}) * ({lum} / ({lum} - {low})) ELSE {high} END)"
    return [f"(CASE WHEN {high} > 1e0 THEN {lum} + ({x} - {lum}) * ((1e0 - {lum}) / ({high} - {lum})) ELSE {x} END)" for x in up]


def _sat(c):
    return f"({_high(c)} - {_low(c)})"


#: B(backdrop, source) of three channels each.
COLOR_MODES = {
    "normal": lambda b, s: list(s),
    "multiply": _each(lambda b, s: f"{b} * {s}"),
    "add": _each(lambda b, s: f"least(1e0, {b} + {s})"),
    "subtract": _each(lambda b, s: f"greatest(0e0, {b} - {s})"),
    "screen": _each(lambda b, s: f"1e0 - (1e0 - {b}) * (1e0 - {s})"),
    "darken": _each(lambda b, s: f"least({b}, {s})"),
    "lighten": _each(lambda b, s: f"greatest({b}, {s})"),
    "overlay": _each(_overlay),
    "hard_light": _each(lambda b, s: _overlay(s, b)),
    "color_dodge": _each(lambda b, s: f"CASE WHEN {b} = 0e0 THEN 0e0 WHEN {s} = 1e0 THEN 1e0 ELSE least(1e0, {b} / (1e0 - {s})) END"),
    "color_burn": _each(lambda b, s: f"CASE WHEN {b} = 1e0 THEN 1e0 WHEN {s} = 0e0 THEN 0e0 ELSE 1e0 - least(1e0, (1e0 - {b}) / {s}) END"),
    "soft_light": _each(_soft),
    "difference": _each(lambda b, s: f"abs({b} - {s})"),
    "exclusion": _each(lambda b, s: f"{b} + {s} - 2e0 * {b} * {s}"),
    "hue": lambda b, s: _set_luminosity(_set_saturation(s, _sat(b)), _lum(b)),
    "saturation": lambda b, s: _set_luminosity(_set_saturation(b, _sat(s)), _lum(b)),
    "color": lambda b, s: _set_luminosity(s, _lum(b)),
    "luminosity": lambda b, s: _set_luminosity(b, _lum(s)),
}
ALPHA_MODES = ("src_over", "src", "src_atop", "src_in", "src_out", "dest", "dest_atop", "dest_over", "dest_in", "dest_out", "clear", "xor", "plus")


def composed(back: list[str], over: list[str], color: str = "normal", alpha: str = "src_over", opacity: str = "1e0") -> list[str]:
    """Expressions for red, green, blue, alpha; back and over are scaled channels, opacity scales over's alpha only."""
    d, da, s, sa = back[:3], back[3], over[:3], f"({over[3]} * {opacity})"
    both = f"({da} * {sa})"
    mode = color if callable(color) else COLOR_MODES[color]

    def un(c, a):
        return [f"(CASE WHEN {a} = 0e0 THEN 0e0 ELSE ({x}) / {a} END)" for x in c]

    if alpha in ("src_over", "dest_over"):
        # the one that lies below is d here
        (d, da, s, sa) = (d, da, s, sa) if alpha == "src_over" else (s, sa, d, da)
        a = f"({da} - {both} + {sa})"
        return [*un([f"{x} * ({da} - {both}) + {y} * ({sa} - {both}) + ({z}) * {both}" for x, y, z in zip(d, s, mode(d, s))], a), a]
    if alpha in ("src_atop", "dest_atop"):
        (d, da, s, sa) = (d, da, s, sa) if alpha == "src_atop" else (s, sa, d, da)
        return [*un([f"{x} * ({da} - {both}) + ({z}) * {both}" for x, z in zip(d, mode(d, s))], da), da]
    if alpha == "src_in":
        return [*s, both]
    if alpha == "dest_in":
        return [*d, both]
    if alpha == "src_out":
        return [*s, f"((1e0 - {da}) * {sa})"]
    if alpha == "dest_out":
        return [*d, f"((1e0 - {sa}) * {da})"]
    if alpha == "src":
        return [*s, sa]
    if alpha == "dest":
        return [*d, da]
    if alpha == "clear":
        return ["0e0"] * 4
    if alpha == "xor":
        a = f"({sa} * (1e0 - {da}) + {da} * (1e0 - {sa}))"
        return [*un([f"{y} * {sa} * (1e0 - {da}) + {x} * {da} * (1e0 - {sa})" for x, y in zip(d, s)], a), a]
    if alpha == "plus":
        a = f"least(1e0, {sa} + {da})"
        return [*un([f"least(1e0, {x} * {da} + {y} * ({sa} - {both}) + ({z}) * {both})" for x, y, z in zip(d, s, mode(d, s))], a), a]
    raise ValueError(alpha)


def _colour(c) -> list[str]:
    return [num(v / 255) for v in c]


def _bytes(parts: list[str], keep: str | None = None) -> str:
    """Packed columns; keep is a condition where the old pixel stays."""
    return ", ".join((f"CASE WHEN {keep} THEN {pack(p)} ELSE {c} END" if keep else pack(p)) + f" AS {c}" for p, c in zip(parts, "rgba"))


@operator
def background_color(source, color, rect=None, mode="normal", alpha="src_over", opacity: float = 1.0):
    """The pixel over a colour: the colour is the backdrop."""
    parts = composed(_colour(color), [scaled(c) for c in "rgba"], mode, alpha, num(opacity))
    return f"SELECT {KEYS}, {_bytes(parts, rect and inside(rect))} FROM {source}"


def _overlaid(source, color, amount: str, mode, alpha, rect):
    parts = composed([scaled(c) for c in "rgba"], _colour(color), mode, alpha, "amount")
    sized = f"SELECT {KEYS}, r, g, b, a, max(x) OVER (PARTITION BY image_id, frame_no) + 1 AS w, max(y) OVER (PARTITION BY image_id, frame_no) + 1 AS h FROM {source}"
    left, top, w, h = ("0", "0", "w", "h") if rect is None else map(str, rect)
    cx, cy = f"({left} + floor({w} / 2e0))", f"({top} + floor({h} / 2e0))"
    far = f"sqrt((x - {cx}) * (x - {cx}) + (y - {cy}) * (y - {cy}))"
    return f"SELECT {KEYS}, {_bytes(parts, rect and inside(rect))} FROM (SELECT {KEYS}, r, g, b, a, {amount.format(far=far, w=w, h=h)} AS amount FROM ({sized}) AS sized) AS amounts"


@operator
def glow(source, color=(0, 0, 0, 255), radius: float | None = None, rect=None, mode="normal", alpha="src_over", opacity: float = 1.0):
    """A colour that fades from the middle of each image (or of rect)."""
    most = "({w} * 0.5e0)" if radius is None else f"least({num(radius)}, {{w}} * 0.5e0)"
    return _overlaid(source, color, clamp(f"{num(opacity)} * (1e0 - 0.95e0 * ({{far}} / {most}))"), mode, alpha, rect)


@operator
def vignette(source, color=(0, 0, 0, 255), radius_x: float | None = None, radius_y: float | None = None, rect=None, mode="normal", alpha="src_over", opacity: float = 1.0):
    """A colour that grows to the corners."""
    rx = "({w} * 0.5e0)" if radius_x is None else num(radius_x)
    ry = "({h} * 0.5e0)" if radius_y is None else num(radius_y)
    return _overlaid(source, color, clamp(f"{num(opacity)} * (0.9e0 * ({{far}} / sqrt({rx} * {rx} + {ry} * {ry})))"), mode, alpha, rect)


@operator
def lomograph(source, rect=None):
    return vignette.sql(f"({filter_matrix.sql(source, M.lomograph(), rect)}) AS filtered", (0, 10, 0, 255), rect=rect)


@operator
def polaroid(source, rect=None, width: int | None = None):
    """The glow's radius is a quarter of the image's (or rect's) width, which has to be given."""
    first = vignette.sql(f"({filter_matrix.sql(source, M.polaroid(), rect)}) AS filtered", (102, 34, 0, 255), rect=rect)
    return glow.sql(f"({first}) AS vignetted", (255, 153, 102, 128), (rect[2] if rect else width) / 4, rect)


def _staged(mode: str, b: list[str], s: list[str]) -> tuple[list[dict[str, str]], list[str]]:
    """A mode as columns step by step, so that no expression is written out many times: (steps, names of the result)."""
    if mode not in ("hue", "saturation", "color", "luminosity"):
        return [], COLOR_MODES[mode](b, s)
    start, lum = {"hue": (_set_saturation(s, _sat(b)), b), "saturation": (_set_saturation(b, _sat(s)), b), "color": (s, b), "luminosity": (b, s)}[mode]
    c, m, u = (["c_r", "c_g", "c_b"], ["m_r", "m_g", "m_b"], ["u_r", "u_g", "u_b"])
    steps = [
        dict(zip(c, start)) | {"lm": _lum(lum)},
        {name: f"{x} + (lm - {_lum(c)})" for name, x in zip(m, c)},
        {"lo": _low(m), "hi": _high(m)},
        {name: f"CASE WHEN lo < 0e0 THEN lm + ({x} - lm) * (lm / (lm - lo)) ELSE {x} END" for name, x in zip([*u, "hi2"], [*m, "hi"])},
        {f"v_{k}": f"CASE WHEN hi2 > 1e0 THEN lm + ({x} - lm) * ((1e0 - lm) / (hi2 - lm)) ELSE {x} END" for k, x in zip("rgb", u)},
    ]
    return steps, ["v_r", "v_g", "v_b"]


@operator
def draw_image(source, over, x: int = 0, y: int = 0, mode="normal", alpha="src_over", opacity: float = 1.0):
    """Draw ``over`` (a relation y, x, r, g, b, a) on all images at a place; an equality join on the pixel's place."""
    back, front = [f"b{c}" for c in "rgba"], [f"f{c}" for c in "rgba"]
    scaled_cols = ", ".join(f"{scaled(f'p.{c}')} AS b{c}, {scaled(f'o.{c}')} AS f{c}" for c in "rgba")
    query = f"SELECT p.image_id, p.frame_no, p.y, p.x, p.r, p.g, p.b, p.a, {scaled_cols} FROM {source} AS p LEFT JOIN {over} AS o ON p.x - {x} = o.x AND p.y - {y} = o.y"
    (under, upper) = (front, back) if alpha in ("dest_over", "dest_atop") else (back, front)
    steps, made = _staged(mode, under[:3], upper[:3])
    for k, step in enumerate(steps):
        query = f"SELECT *, {', '.join(f'{v} AS {n}' for n, v in step.items())} FROM ({query}) AS step{k}"
    parts = composed(back, front, lambda b, s: made, alpha, num(opacity))
    cols = ", ".join(f"CASE WHEN fa IS NULL THEN {c} ELSE {pack(v)} END AS {c}" for v, c in zip(parts, "rgba"))
    return f"SELECT {KEYS}, {cols} FROM ({query}) AS blended"


def draw(px, over, x: int = 0, y: int = 0, mode="normal", alpha="src_over", opacity: float = 1.0, frames: int = 1, repeat: int = 0):
    """draw_image for DataFrames. ``over`` has frame_no 0..frames-1; they are used in turn, ``repeat`` rounds (0: for ever)."""
    from pyspark.sql import functions as F

    turn = F.col("frame_no") % F.lit(frames)
    shown = px.withColumn("__turn", turn if repeat <= 0 else F.when(F.col("frame_no") < repeat * frames, turn))
    o = over.select(F.col("frame_no").alias("__turn"), (F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"), *(F.col(c).alias(f"o_{c}") for c in "rgba"))
    joined = shown.join(o, ["__turn", "y", "x"], "left")
    parts = composed([scaled(c) for c in "rgba"], [scaled(f"o_{c}") for c in "rgba"], mode, alpha, num(opacity))
    return joined.selectExpr("image_id", "frame_no", "y", "x", *(f"CASE WHEN o_a IS NULL THEN {c} ELSE {pack(v)} END AS {c}" for v, c in zip(parts, "rgba")))
