"""Queries over exploded pixels: name -> (DataFrame -> DataFrame, relation -> SQL)."""

from __future__ import annotations

from ..functions import matrices as M
from ..operators import blend, color, geometry, histogram, threshold


def _q(op, *args, **kw):
    return (lambda px: op(px, *args, **kw)), (lambda source: op.sql(source, *args, **kw))


RECT = (4, 6, 20, 17)
PX = {
    "brightness": _q(color.brightness, 1.4),
    "contrast": _q(color.contrast, 0.7),
    "grayscale_bt709": _q(color.grayscale),
    "grayscale_bt709_half": _q(color.grayscale, 0.5),
    "grayscale_bt601": _q(color.grayscale_bt601, 0.75),
    "hue": _q(color.hue, 75.0),
    "invert": _q(color.invert),
    "opacity": _q(color.opacity, 0.4),
    "saturate": _q(color.saturate, 1.7),
    "lightness": _q(color.lightness, 1.2),
    "sepia": _q(color.sepia),
    "black_white": _q(color.black_white),
    "kodachrome": _q(color.kodachrome),
    "filter_matrix_rect": _q(color.filter_matrix, M.multiply(M.saturate(0.3), M.contrast(1.2)), RECT),
    **{f"color_blindness_{k}": _q(color.color_blindness, k) for k in M.COLOR_BLINDNESS},
    "opaque": _q(color.opaque, RECT),
    "clear_transparent": _q(color.clear_transparent, 100),
    "luminance_8": _q(color.luminance, 8),
    "luminance_16": _q(color.luminance, 16),
    "premultiply": _q(color.premultiply),
    "unpremultiply": _q(color.unpremultiply),
    "lomograph": _q(blend.lomograph),
    "polaroid": _q(blend.polaroid, width=32),
    "background_color": _q(blend.background_color, (200, 30, 90, 255)),
    "background_color_multiply": _q(blend.background_color, (200, 30, 90, 180), RECT, "multiply", "src_over", 0.8),
    "glow": _q(blend.glow, (250, 240, 10, 255), 12.0),
    "vignette": _q(blend.vignette),
    "vignette_rect": _q(blend.vignette, (10, 60, 200, 220), 9.0, 7.0, RECT),
    "binary_threshold": _q(threshold.binary_threshold, 0.5),
    "binary_threshold_saturation": _q(threshold.binary_threshold, 0.4, mode="saturation"),
    "binary_threshold_chroma": _q(threshold.binary_threshold, 0.3, (250, 10, 10, 255), (0, 0, 90, 128), "max_chroma", RECT),
    "integral_image": _q(threshold.integral_image),
    "integral_image_rect": _q(threshold.integral_image, RECT),
    "adaptive_threshold": _q(threshold.adaptive_threshold),
    "luminance_histogram": _q(histogram.luminance_histogram),
    "channel_histogram": _q(histogram.channel_histogram),
    "equalize": _q(histogram.equalize),
    "equalize_clipped": _q(histogram.equalize, 256, 6),
    "auto_level": _q(histogram.auto_level),
    "auto_level_separate": _q(histogram.auto_level_separate),
    "tile_equalize": _q(histogram.tile_equalize, 4),
    "image_statistics": _q(histogram.statistics),
    "crop": _q(geometry.crop, RECT),
    "flip_horizontal": _q(geometry.flip, "horizontal"),
    "flip_vertical": _q(geometry.flip, "vertical"),
    **{f"rotate_{d}": _q(geometry.rotate_right_angle, d) for d in (90, 180, 270)},
    "rotate_flip": _q(geometry.rotate_flip, 90, "vertical"),
    **{f"auto_orient_{k}": _q(geometry.auto_orient, k) for k in (2, 5, 7, 8)},
    "swizzle": _q(geometry.swizzle, "y", "x"),
    "pixelate": _q(geometry.pixelate, 5),
    "resize_nearest_down": _q(geometry.resize_nearest, 13, 11),
    "resize_nearest_up": _q(geometry.resize_nearest, 50, 41),
    "pad": _q(geometry.pad, 40, 37, (9, 8, 7, 255)),
    "blank": _q(geometry.blank, 6, 5, (1, 2, 3, 4)),
    "bounding_box": _q(geometry.bounding_box, "r > 200 AND g > 150"),
    "memory_size": _q(geometry.memory_size),
}


def _equalized(source):
    gray = color.grayscale.sql(source)
    return histogram.statistics.sql(f"({histogram.equalize.sql(f'({gray}) AS gray')}) AS equalized")


PX["equalized_statistics"] = ((lambda px: px.sparkSession.sql(_equalized("{px}"), px=px)), _equalized)


def _drawn(mode, alpha, opacity):
    def text(source):
        over = f"(SELECT y, x, g AS r, b AS g, r AS b, 295 - a AS a FROM {source} WHERE x < 20 AND y < 24 AND image_id = 0)"
        return blend.draw_image.sql(source, over, 5, -3, mode, alpha, opacity)

    return (lambda px: px.sparkSession.sql(text("{px}"), px=px)), text


for _mode in blend.COLOR_MODES:
    PX[f"draw_{_mode}"] = _drawn(_mode, "src_over", 0.8)
for _alpha in blend.ALPHA_MODES:
    if _alpha != "src_over":
        PX[f"draw_normal_{_alpha}"] = _drawn("normal" if _alpha in ("src", "dest") else "multiply", _alpha, 0.9)
