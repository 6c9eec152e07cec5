"""Queries of frame kernels and neighbourhood joins on the events raster: name -> (DataFrame -> DataFrame, relation -> SQL or None)."""

from __future__ import annotations

from ..frames import Chain, assemble, explode, process_pixels
from ..kernels import bokeh as B
from ..kernels import clahe as H
from ..kernels import convolve as C
from ..kernels import quantize as Q
from ..kernels import resample as R
from ..operators import neighbourhood as N
from ..operators import palette as P
from ..operators.geometry import resize_geometry
from . import frame_oracles as O


def _kernel(f, *args, **kw):
    return lambda px: process_pixels(px, f, *args, **kw)


def _sql(op, *args, **kw):
    return lambda source: op.sql(source, *args, **kw)


def _q(op, *args, **kw):
    return (lambda px: op(px, *args, **kw)), _sql(op, *args, **kw)


def _fitted(v, target, mode, anchor):
    size, rect = resize_geometry((v.shape[1], v.shape[0]), target, mode, anchor)
    return R.resize(v, *size, target_rect=rect)


def _resized(target, mode, anchor="center"):
    return _kernel(_fitted, target, mode, anchor)


LOPSIDED = ((0.1, -0.2, 0.3), (0.05, 0.5, 0.15), (0.0, 0.2, -0.1))
COLOURS = [(0, 0, 0, 255), (255, 255, 255, 255), (200, 40, 40, 255), (40, 200, 40, 200), (40, 40, 200, 128), (120, 120, 120, 255), (230, 220, 60, 255)]
FRAMES = {
    "convolve_px": _q(N.convolve, LOPSIDED),
    "convolve": (_kernel(C.convolve, LOPSIDED), _sql(N.convolve, LOPSIDED)),
    "convolve_keep_alpha": (_kernel(C.convolve, LOPSIDED, True), _sql(N.convolve, LOPSIDED, True)),
    **{f"convolve_{m}": (_kernel(C.convolve, LOPSIDED, False, None, m, m), _sql(N.convolve, LOPSIDED, False, m, m)) for m in ("wrap", "mirror", "bounce")},
    "box_blur": (_kernel(C.box_blur, 3), _sql(N.separable, C.box_kernel(3))),
    "box_blur_px": _q(N.separable, C.box_kernel(1)),
    "gaussian_blur": (_kernel(C.gaussian_blur, 1.3), _sql(N.separable, C.gaussian_kernel(1.3))),
    "gaussian_sharpen": (_kernel(C.gaussian_sharpen, 0.8), _sql(N.separable, C.sharpen_kernel(0.8))),
    **{f"edges_{k}": (_kernel(C.detect_edges, k), _sql(N.edges_two_way, *v)) for k, v in C.TWO_WAY.items()},
    **{f"edges_{k}": (_kernel(C.detect_edges, k), _sql(N.edges_one_way, v)) for k, v in C.ONE_WAY.items()},
    **{f"edges_{k}": (_kernel(C.detect_edges, k), _sql(N.edges_compass, C.compass(v))) for k, v in C.COMPASS.items()},
    "edges_sobel_px": _q(N.edges_two_way, C.SOBEL_X, C.SOBEL_Y, False),
    **{f"resize_{s}": (_kernel(R.resize, 13, 19, s), _sql(N.resize, R.axis_weights(32, 13, s), R.axis_weights(32, 19, s))) for s in R.SAMPLERS if s != "nearest"},
    "resize_up": (_kernel(R.resize, 50, 45, "lanczos3"), _sql(N.resize, R.axis_weights(32, 50, "lanczos3"), R.axis_weights(32, 45, "lanczos3"))),
    "resize_px": _q(N.resize, R.axis_weights(32, 16, "triangle"), R.axis_weights(32, 16, "triangle")),
    "resize_crop": (_resized((20, 13), "crop", "bottom"), lambda s: O.resized(s, (20, 13), (0, -7, 20, 20))),
    "resize_crop_top": (_resized((13, 20), "crop", "top"), lambda s: O.resized(s, (13, 20), (-4, 0, 20, 20))),
    "resize_pad": (_resized((20, 13), "pad", "left"), lambda s: O.resized(s, (20, 13), (0, 0, 13, 13))),
    "resize_pad_bottom_right": (_resized((20, 13), "pad", "bottom_right"), lambda s: O.resized(s, (20, 13), (7, 0, 13, 13))),
    "resize_box_pad": (_resized((40, 37), "box_pad", "bottom"), lambda s: O.resized(s, (40, 37), (4, 5, 32, 32))),
    "resize_max": (_resized((20, 13), "max"), lambda s: O.resized(s, (13, 13), (0, 0, 13, 13))),
    "resize_min": (_resized((20, 13), "min"), lambda s: O.resized(s, (20, 20), (0, 0, 20, 20))),
    "resize_compand": (_kernel(R.resize, 20, 20, "bicubic", True), lambda s: O.resized_in_light(s, 20, 20)),
    "quantize_palette": _q(P.quantize, COLOURS),
    "quantize_websafe": _q(P.quantize, P.websafe()),
    **{f"ordered_dither_{n}": _q(P.ordered_dither, COLOURS, n) for n in (2, 3, 4, 8, 16)},
    "oil_paint": (_kernel(C.oil_paint, 10, 7), lambda s: O.painted(s, 10, 7)),
    "entropy_crop": (_kernel(C.entropy_crop, 0.9), lambda s: O.cropped_to(s, N.edges_two_way.sql(s, C.SOBEL_X, C.SOBEL_Y, False), 230)),
    "rotate_30": (_kernel(R.rotate, 30.0), lambda s: O.rotated(s, 30.0)),
    "skew": (_kernel(R.skew, 12.0, 7.0), lambda s: O.skewed(s, 12.0, 7.0)),
    "transform_affine": (_kernel(R.transform_by, R.Builder().scale(1.2, 0.8).rotate(15.0).translate(2, 3)), lambda s: O.scaled_turned_moved(s, 1.2, 0.8, 15.0, 2, 3)),
    "transform_taper": (_kernel(R.transform_by, R.Builder().taper("right", "both", 0.6)), lambda s: O.right_side_shrunk(s, 0.6)),
    "transform_quad": (_kernel(R.transform_by, R.Builder().quad([(2, 3), (30, 1), (28, 31), (0, 26)])), lambda s: O.onto_quad(s, [(2, 3), (30, 1), (28, 31), (0, 26)])),
    "chain_blur_edges": ((lambda px: explode(Chain().then(C.gaussian_blur, 1.0).then(C.detect_edges, "sobel").apply(assemble(px)))), lambda s: N.edges_two_way.sql(f"({N.separable.sql(s, C.gaussian_kernel(1.0))})", C.SOBEL_X, C.SOBEL_Y)),
}


def _median_sql(radius, keep):
    n = (2 * radius + 1) ** 2

    def text(source):
        offsets = N.taps([[1.0] * (2 * radius + 1)] * (2 * radius + 1))
        met = N._met(source, offsets, ", ".join(f"list_sort(list(q.{c}))[{((n + 1) >> 1) + 1}] AS {c}" for c in "rgba"))
        return f"SELECT image_id, frame_no, y, x, r, g, b, a FROM ({met})" if not keep else f"SELECT m.image_id, m.frame_no, m.y, m.x, m.r, m.g, m.b, o.a FROM ({met}) AS m JOIN {source} AS o ON o.image_id = m.image_id AND o.frame_no = m.frame_no AND o.y = m.y AND o.x = m.x"

    return text


FRAMES["median_blur"] = _kernel(C.median_blur, 1), _median_sql(1, False)
FRAMES["median_blur_keep_alpha"] = _kernel(C.median_blur, 2, True), _median_sql(2, True)

FRAMES["bokeh_blur"] = _kernel(B.bokeh_blur, 4, 2), None
FRAMES["clahe"] = _kernel(H.clahe, 256, 20, 4), None
FRAMES["clahe_sliding"] = _kernel(H.clahe_sliding, 256, None, 4), None
for _name in Q.DIFFUSIONS:
    FRAMES[f"diffuse_{_name}"] = _kernel(Q.diffuse, COLOURS, _name), (lambda s, k=_name: O.diffusion(s, COLOURS, k))
FRAMES["binary_dither"] = _kernel(Q.binary_dither), lambda s: O.diffusion(s, [(255, 255, 255, 255), (0, 0, 0, 255)], "floyd_steinberg")
FRAMES["quantize_wu"] = _kernel(Q.quantize, "wu", 32, None), None
FRAMES["quantize_tree"] = _kernel(Q.quantize, "tree", 32, None), None
