"""Queries that convert the raster's colours: name -> (DataFrame -> DataFrame, relation -> SQL)."""

from __future__ import annotations

from ..functions import color_spaces as S

RGB = ["(r / 255e0)", "(g / 255e0)", "(b / 255e0)"]


def _q(parts):
    def text(source):
        return f"SELECT image_id, frame_no, y, x, {', '.join(f'CAST(round(({p}) * 1e6) / 1e6 AS DOUBLE) AS v{k}' for k, p in enumerate(parts, 1))} FROM {source}"

    return (lambda px: px.sparkSession.sql(text("{px}"), px=px)), text


def _staged(first, second):
    """A conversion and another one over its columns, so that the first isn't written out again and again."""

    def text(source):
        inner = ", ".join(f"{p} AS u{k}" for k, p in enumerate(first, 1))
        outer = ", ".join(f"CAST(round(({p}) * 1e6) / 1e6 AS DOUBLE) AS v{k}" for k, p in enumerate(second([f"u{k}" for k in range(1, len(first) + 1)]), 1))
        return f"SELECT image_id, frame_no, y, x, {outer} FROM (SELECT image_id, frame_no, y, x, {inner} FROM {source}) AS first_step"

    return (lambda px: px.sparkSession.sql(text("{px}"), px=px)), text


XYZ = S.rgb_to_xyz(RGB)
COLORS = {
    "rgb_to_xyz": _q(XYZ),
    **{f"rgb_to_xyz_{w}": _q(S.rgb_to_xyz(RGB, w)) for w in S.WORKING_SPACES if w != "srgb"},
    "rgb_to_lab": _staged(XYZ, S.xyz_to_lab),
    "rgb_to_lch": _staged(XYZ, lambda u: S.polar(S.xyz_to_lab(u))),
    "rgb_to_luv": _staged(XYZ, S.xyz_to_luv),
    "rgb_to_lchuv": _staged(XYZ, lambda u: S.polar(S.xyz_to_luv(u))),
    "rgb_to_xyy": _staged(XYZ, S.xyz_to_xyy),
    "rgb_to_hunter_lab": _staged(XYZ, S.xyz_to_hunter_lab),
    "rgb_to_lms": _staged(XYZ, S.xyz_to_lms),
    "rgb_to_hsv": _q(S.rgb_to_hsv(RGB)),
    "rgb_to_hsl": _q(S.rgb_to_hsl(RGB)),
    "rgb_to_cmyk": _q(S.rgb_to_cmyk(RGB)),
    **{f"rgb_to_ycbcr_{m}": _q(S.rgb_to_ycbcr(RGB, m)) for m in S.YCBCR_WEIGHTS},
    "rgb_to_ycck": _q(S.rgb_to_ycck(RGB)),
    "rgb_to_y": _q(S.rgb_to_y(RGB)),
    "hsv_to_rgb": _staged(S.rgb_to_hsv(RGB), S.hsv_to_rgb),
    "hsl_to_rgb": _staged(S.rgb_to_hsl(RGB), S.hsl_to_rgb),
    "cmyk_to_rgb": _staged(S.rgb_to_cmyk(RGB), S.cmyk_to_rgb),
    "ycbcr_to_rgb": _staged(S.rgb_to_ycbcr(RGB), S.ycbcr_to_rgb),
    "ycck_to_rgb": _staged(S.rgb_to_ycck(RGB), S.ycck_to_rgb),
    "lab_to_xyz": _staged(["(r / 2.55e0)", "(g - 128e0)", "(b - 128e0)"], S.lab_to_xyz),
    "lch_to_lab": _staged(["(r / 2.55e0)", "(g * 0.5e0)", "(b * 1.4e0)"], S.from_polar),
    "luv_to_xyz": _staged(["(r / 2.55e0)", "(g - 128e0)", "(b - 128e0)"], S.luv_to_xyz),
    "hunter_lab_to_xyz": _staged(["(r / 2.55e0)", "(g - 128e0)", "(b - 128e0)"], S.hunter_lab_to_xyz),
    "xyy_to_xyz": _staged(RGB, S.xyy_to_xyz),
    "lms_to_xyz": _staged(RGB, S.lms_to_xyz),
    "xyz_to_rgb": _staged(XYZ, S.xyz_to_rgb),
    **{f"adapt_{m}": _q(S.adapt(RGB, "D65", "A", m)) for m in S.ADAPTATIONS},
    **{f"adapt_to_{w.lower()}": _q(S.adapt(RGB, "D50", w)) for w in S.ILLUMINANTS if w != "D50"},
}
