"""Colour spaces as expressions on columns, by way of CIE XYZ; every function maps three or four expressions to as many.

White points default to D50 on both sides, as profile connection does; another
one is reached by von Kries adaptation. Companding is exact, not by tables.
"""

from __future__ import annotations

import numpy as np

from .expr import num

# White points (2 degrees), XYZ.
ILLUMINANTS = {
    "A": (1.09850, 1.0, 0.35585),
    "B": (0.99072, 1.0, 0.85223),
    "C": (0.98074, 1.0, 1.18232),
    "D50": (0.96422, 1.0, 0.82521),
    "D50_ICC": (0.9642, 1.0, 0.8249),
    "D55": (0.95682, 1.0, 0.92149),
    "D65": (0.95047, 1.0, 1.08883),
    "D75": (0.94972, 1.0, 1.22638),
    "E": (1.0, 1.0, 1.0),
    "F2": (0.99186, 1.0, 0.67393),
    "F7": (0.95041, 1.0, 1.08747),
    "F11": (1.00962, 1.0, 0.64350),
}
# Cone response matrices for adaptation.
ADAPTATIONS = {
    "von_kries_hpe_adjusted": ((0.40024, 0.7076, -0.08081), (-0.2263, 1.16532, 0.0457), (0, 0, 0.91822)),
    "von_kries_hpe": ((0.3897, 0.6890, -0.0787), (-0.2298, 1.1834, 0.0464), (0, 0, 1)),
    "xyz_scaling": ((1, 0, 0), (0, 1, 0), (0, 0, 1)),
    "bradford": ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296)),
    "bradford_sharp": ((1.2694, -0.0988, -0.1706), (-0.8364, 1.8006, 0.0357), (0.0297, -0.0315, 1.0018)),
    "cmccat2000": ((0.7982, 0.3389, -0.1371), (-0.5918, 1.5512, 0.0406), (0.0008, 0.239, 0.9753)),
    "cat02": ((0.7328, 0.4296, -0.1624), (-0.7036, 1.6975, 0.0061), (0.0030, 0.0136, 0.9834)),
}
# Chromaticities of red, green and blue, white point, companding.
WORKING_SPACES = {
    "srgb": ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06), "D65", "srgb"),
    "srgb_simplified": ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06), "D65", 2.2),
    "rec709": ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06), "D65", "rec709"),
    "rec2020": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046), "D65", "rec2020"),
    "eci_rgb_v2": ((0.67, 0.33), (0.21, 0.71), (0.14, 0.08), "D50", "l"),
    "adobe_rgb_1998": ((0.64, 0.33), (0.21, 0.71), (0.15, 0.06), "D65", 2.2),
    "apple_srgb": ((0.625, 0.34), (0.28, 0.595), (0.155, 0.07), "D65", 1.8),
    "best_rgb": ((0.7347, 0.2653), (0.2150, 0.7750), (0.13, 0.035), "D50", 2.2),
    "beta_rgb": ((0.6888, 0.3112), (0.1986, 0.7551), (0.1265, 0.0352), "D50", 2.2),
    "bruce_rgb": ((0.64, 0.33), (0.28, 0.65), (0.15, 0.06), "D65", 2.2),
    "cie_rgb": ((0.735, 0.265), (0.274, 0.717), (0.167, 0.009), "E", 2.2),
    "color_match_rgb": ((0.63, 0.34), (0.295, 0.605), (0.15, 0.075), "D50", 1.8),
    "don_rgb_4": ((0.696, 0.3), (0.215, 0.765), (0.13, 0.035), "D50", 2.2),
    "ekta_space_ps5": ((0.695, 0.305), (0.26, 0.7), (0.11, 0.005), "D50", 2.2),
    "ntsc_rgb": ((0.67, 0.33), (0.21, 0.71), (0.14, 0.08), "C", 2.2),
    "pal_secam_rgb": ((0.64, 0.33), (0.29, 0.6), (0.15, 0.06), "D65", 2.2),
    "pro_photo_rgb": ((0.7347, 0.2653), (0.1596, 0.8404), (0.0366, 0.0001), "D50", 1.8),
    "smptec_rgb": ((0.63, 0.34), (0.31, 0.595), (0.155, 0.07), "D65", 2.2),
    "wide_gamut_rgb": ((0.735, 0.265), (0.115, 0.826), (0.157, 0.018), "D50", 2.2),
}
# Weights of red and blue in luma.
YCBCR_WEIGHTS = {"bt601": (0.299, 0.114), "bt709": (0.2126, 0.0722), "bt2020": (0.2627, 0.0593)}
EPSILON, KAPPA = 216 / 24389, 24389 / 27


def dot(m, v: list[str]) -> list[str]:
    return ["(" + (" + ".join(f"{num(k)} * {x}" for k, x in zip(row, v) if k) or "0e0") + ")" for row in np.asarray(m, float)]


def adaptation(source: str, target: str, method: str = "bradford") -> np.ndarray:
    m = np.array(ADAPTATIONS[method], float)
    s, t = m @ np.array(ILLUMINANTS[source]), m @ np.array(ILLUMINANTS[target])
    return np.linalg.inv(m) @ np.diag(t / s) @ m


def adapt(xyz: list[str], source: str, target: str, method: str = "bradford") -> list[str]:
    return xyz if source == target else dot(adaptation(source, target, method), xyz)


def rgb_matrix(space: str) -> np.ndarray:
    """Linear red, green, blue to XYZ."""
    *primaries, white, _ = WORKING_SPACES[space]
    m = np.array([[x / y, 1.0, (1 - x - y) / y] for x, y in primaries]).T
    return m * np.linalg.solve(m, np.array(ILLUMINANTS[white]))


def _signed_power(c: str, p: float) -> str:
    return f"power(greatest(0e0, {c}), {num(p)})"


def expand(c: str, kind) -> str:
    """Companded to linear."""
    if kind == "srgb":
        return f"(CASE WHEN {c} <= 0.04045e0 THEN {c} / 12.92e0 ELSE {_signed_power(f'(({c} + 0.055e0) / 1.055e0)', 2.4)} END)"
    if kind == "rec709":
        return f"(CASE WHEN {c} < 0.081e0 THEN {c} / 4.5e0 ELSE {_signed_power(f'(({c} + 0.099e0) / 1.099e0)', 1 / 0.45)} END)"
    if kind == "rec2020":
        return f"(CASE WHEN {c} < 0.08145e0 THEN {c} / 4.5e0 ELSE {_signed_power(f'(({c} + 0.0993e0) / 1.0993e0)', 1 / 0.45)} END)"
    if kind == "l":
        return f"(CASE WHEN {c} <= 0.08e0 THEN 100e0 * {c} / {num(KAPPA)} ELSE {_signed_power(f'(({c} + 0.16e0) / 1.16e0)', 3)} END)"
    return _signed_power(c, kind)


def compress(c: str, kind) -> str:
    """Linear to companded."""
    if kind == "srgb":
        return f"(CASE WHEN {c} <= 0.0031308e0 THEN 12.92e0 * {c} ELSE 1.055e0 * {_signed_power(c, 1 / 2.4)} - 0.055e0 END)"
    if kind == "rec709":
        return f"(CASE WHEN {c} < 0.018e0 THEN 4.5e0 * {c} ELSE 1.099e0 * {_signed_power(c, 0.45)} - 0.099e0 END)"
    if kind == "rec2020":
        return f"(CASE WHEN {c} < 0.0181e0 THEN 4.5e0 * {c} ELSE 1.0993e0 * {_signed_power(c, 0.45)} - 0.0993e0 END)"
    if kind == "l":
        return f"(CASE WHEN {c} <= {num(EPSILON)} THEN {c} * {num(KAPPA)} / 100e0 ELSE 1.16e0 * {_signed_power(c, 1 / 3)} - 0.16e0 END)"
    return _signed_power(c, 1 / kind)


def rgb_to_xyz(rgb, space="srgb", white="D50", method="bradford"):
    kind, own = WORKING_SPACES[space][4], WORKING_SPACES[space][3]
    return adapt(dot(rgb_matrix(space), [expand(c, kind) for c in rgb]), own, white, method)


def xyz_to_rgb(xyz, space="srgb", white="D50", method="bradford"):
    kind, own = WORKING_SPACES[space][4], WORKING_SPACES[space][3]
    return [compress(c, kind) for c in dot(np.linalg.inv(rgb_matrix(space)), adapt(xyz, white, own, method))]


def xyz_to_lab(xyz, white="D50"):
    f = [f"(CASE WHEN {c} / {num(w)} > {num(EPSILON)} THEN power({c} / {num(w)}, {num(1 / 3)}) ELSE ({num(KAPPA)} * ({c} / {num(w)}) + 16e0) / 116e0 END)" for c, w in zip(xyz, ILLUMINANTS[white])]
    return [f"(116e0 * {f[1]} - 16e0)", f"(500e0 * ({f[0]} - {f[1]}))", f"(200e0 * ({f[1]} - {f[2]}))"]


def lab_to_xyz(lab, white="D50"):
    L, a, b = lab
    fy = f"(({L} + 16e0) / 116e0)"
    fx, fz = f"({a} / 500e0 + {fy})", f"({fy} - {b} / 200e0)"
    back = lambda f: f"(CASE WHEN {f} * {f} * {f} > {num(EPSILON)} THEN {f} * {f} * {f} ELSE (116e0 * {f} - 16e0) / {num(KAPPA)} END)"
    y = f"(CASE WHEN {L} > {num(KAPPA * EPSILON)} THEN {fy} * {fy} * {fy} ELSE {L} / {num(KAPPA)} END)"
    return [f"({v} * {num(w)})" for v, w in zip((back(fx), y, back(fz)), ILLUMINANTS[white])]


def polar(v):
    """Lab to Lch, Luv to Lchuv: hue from 0 to 360."""
    L, a, b = v
    h = f"degrees(atan2({b}, {a}))"
    return [L, f"sqrt({a} * {a} + {b} * {b})", f"(CASE WHEN {h} < 0e0 THEN {h} + 360e0 ELSE {h} END)"]


def from_polar(v):
    L, c, h = v
    return [L, f"({c} * cos(radians({h})))", f"({c} * sin(radians({h})))"]


def _uv_white(white):
    x, y, z = ILLUMINANTS[white]
    return 4 * x / (x + 15 * y + 3 * z), 9 * y / (x + 15 * y + 3 * z)


def xyz_to_luv(xyz, white="D50"):
    x, y, z = xyz
    u0, v0 = _uv_white(white)
    yr = f"({y} / {num(ILLUMINANTS[white][1])})"
    d = f"({x} + 15e0 * {y} + 3e0 * {z})"
    L = f"(CASE WHEN {yr} > {num(EPSILON)} THEN 116e0 * power({yr}, {num(1 / 3)}) - 16e0 ELSE {num(KAPPA)} * {yr} END)"
    part = lambda k, c, w: f"(CASE WHEN {d} = 0e0 THEN 0e0 ELSE 13e0 * {L} * ({k} * {c} / {d} - {num(w)}) END)"
    return [L, part("4e0", x, u0), part("9e0", y, v0)]


def luv_to_xyz(luv, white="D50"):
    L, u, v = luv
    u0, v0 = _uv_white(white)
    y = f"(CASE WHEN {L} > {num(KAPPA * EPSILON)} THEN power(({L} + 16e0) / 116e0, 3e0) ELSE {L} / {num(KAPPA)} END)"
    up, vp = f"({u} / (13e0 * {L}) + {num(u0)})", f"({v} / (13e0 * {L}) + {num(v0)})"
    zero = lambda e: f"(CASE WHEN {L} = 0e0 THEN 0e0 ELSE {e} END)"
    return [zero(f"{y} * 9e0 * {up} / (4e0 * {vp})"), y, zero(f"{y} * (12e0 - 3e0 * {up} - 20e0 * {vp}) / (4e0 * {vp})")]


def xyz_to_xyy(xyz):
    x, y, z = xyz
    total = f"({x} + {y} + {z})"
    return [f"(CASE WHEN {total} = 0e0 THEN 0e0 ELSE {c} / {total} END)" for c in (x, y)] + [y]


def xyy_to_xyz(xyy):
    x, y, Y = xyy
    return [f"(CASE WHEN {y} = 0e0 THEN 0e0 ELSE {x} * {Y} / {y} END)", Y, f"(CASE WHEN {y} = 0e0 THEN 0e0 ELSE (1e0 - {x} - {y}) * {Y} / {y} END)"]


def _hunter(white):
    x, y, z = ILLUMINANTS[white]
    if white == "C":
        return 175.0, 70.0
    return 100 * (175 / 198.04) * (x + y), 100 * (70 / 218.11) * (y + z)


def xyz_to_hunter_lab(xyz, white="D50"):
    x, y, z = xyz
    xn, yn, zn = ILLUMINANTS[white]
    ka, kb = _hunter(white)
    root = f"sqrt({y} / {num(yn)})"
    safe = lambda e: f"(CASE WHEN {y} <= 0e0 THEN 0e0 ELSE {e} END)"
    return [f"(100e0 * {root})", safe(f"{num(ka)} * (({x} / {num(xn)} - {y} / {num(yn)}) / {root})"), safe(f"{num(kb)} * (({y} / {num(yn)} - {z} / {num(zn)}) / {root})")]


def hunter_lab_to_xyz(v, white="D50"):
    L, a, b = v
    xn, yn, zn = ILLUMINANTS[white]
    ka, kb = _hunter(white)
    p = f"(({L} / 100e0) * ({L} / 100e0))"
    return [f"(({a} / {num(ka)} * sqrt({p}) + {p}) * {num(xn)})", f"({p} * {num(yn)})", f"(({b} / {num(kb)} * sqrt({p}) - {p}) * {num(-zn)})"]


def xyz_to_lms(xyz, method="bradford"):
    return dot(ADAPTATIONS[method], xyz)


def lms_to_xyz(lms, method="bradford"):
    return dot(np.linalg.inv(np.array(ADAPTATIONS[method], float)), lms)


def _hue(r, g, b):
    high, span = f"greatest({r}, {g}, {b})", f"(greatest({r}, {g}, {b}) - least({r}, {g}, {b}))"
    return f"(CASE WHEN {span} = 0e0 THEN 0e0 WHEN {r} = {high} THEN 60e0 * (({g} - {b}) / {span}) + CASE WHEN {g} < {b} THEN 360e0 ELSE 0e0 END WHEN {g} = {high} THEN 60e0 * (2e0 + ({b} - {r}) / {span}) ELSE 60e0 * (4e0 + ({r} - {g}) / {span}) END)"


def rgb_to_hsv(rgb):
    high, low = f"greatest({', '.join(rgb)})", f"least({', '.join(rgb)})"
    return [_hue(*rgb), f"(CASE WHEN {high} = 0e0 THEN 0e0 ELSE ({high} - {low}) / {high} END)", high]


def rgb_to_hsl(rgb):
    high, low = f"greatest({', '.join(rgb)})", f"least({', '.join(rgb)})"
    light = f"(({high} + {low}) * 0.5e0)"
    return [_hue(*rgb), f"(CASE WHEN {high} = {low} THEN 0e0 WHEN {light} <= 0.5e0 THEN ({high} - {low}) / ({high} + {low}) ELSE ({high} - {low}) / (2e0 - {high} - {low}) END)", light]


def hsv_to_rgb(hsv):
    h, s, v = hsv
    part = lambda n: f"({v} - {v} * {s} * greatest(0e0, least(1e0, least(({n} + {h} / 60e0) - 6e0 * floor(({n} + {h} / 60e0) / 6e0), 4e0 - (({n} + {h} / 60e0) - 6e0 * floor(({n} + {h} / 60e0) / 6e0))))))"
    return [part("5e0"), part("3e0"), part("1e0")]


def hsl_to_rgb(hsl):
    h, s, v = hsl
    k = lambda n: f"(({n} + {h} / 30e0) - 12e0 * floor(({n} + {h} / 30e0) / 12e0))"
    part = lambda n: f"({v} - {s} * least({v}, 1e0 - {v}) * greatest(-1e0, least({k(n)} - 3e0, 9e0 - {k(n)}, 1e0)))"
    return [part("0e0"), part("8e0"), part("4e0")]


def rgb_to_cmyk(rgb):
    k = f"(1e0 - greatest({', '.join(rgb)}))"
    return [f"(CASE WHEN {k} >= 1e0 THEN 0e0 ELSE (1e0 - {c} - {k}) / (1e0 - {k}) END)" for c in rgb] + [k]


def cmyk_to_rgb(cmyk):
    return [f"((1e0 - {c}) * (1e0 - {cmyk[3]}))" for c in cmyk[:3]]


def ycbcr_matrix(name="bt601"):
    r, b = YCBCR_WEIGHTS[name]
    g = 1 - r - b
    return np.array([[r, g, b], [-r / (2 * (1 - b)), -g / (2 * (1 - b)), 0.5], [0.5, -g / (2 * (1 - r)), -b / (2 * (1 - r))]])


def rgb_to_ycbcr(rgb, name="bt601"):
    y, cb, cr = dot(ycbcr_matrix(name), rgb)
    return [y, f"({cb} + 0.5e0)", f"({cr} + 0.5e0)"]


def ycbcr_to_rgb(v, name="bt601"):
    return dot(np.linalg.inv(ycbcr_matrix(name)), [v[0], f"({v[1]} - 0.5e0)", f"({v[2]} - 0.5e0)"])


def rgb_to_ycck(rgb, name="bt601"):
    k = f"(1e0 - greatest({', '.join(rgb)}))"
    return [*rgb_to_ycbcr([f"(CASE WHEN {k} >= 1e0 THEN 0e0 ELSE {c} / (1e0 - {k}) END)" for c in rgb], name), k]


def ycck_to_rgb(v, name="bt601"):
    return [f"({c} * (1e0 - {v[3]}))" for c in ycbcr_to_rgb(v[:3], name)]


def rgb_to_y(rgb, name="bt601"):
    return dot(ycbcr_matrix(name)[:1], rgb)
