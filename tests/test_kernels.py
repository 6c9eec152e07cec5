"""Literal fixtures and plain models of kernels."""

import numpy as np
import pytest
from pixelquarry.frames import Chain, batch_of
from pixelquarry.kernels import quantize as Q
from pixelquarry.kernels import resample as R
from pixelquarry.operators.geometry import resize_geometry


def plain_diffusion(frame, palette, kernel):
    """Pixel by pixel; every addition is stored as a byte."""
    divisor, offset, rows = Q.DIFFUSIONS[kernel]
    out, one, pal = frame.copy(), np.float32(255), np.array(palette, np.int64)
    h, w = frame.shape[:2]
    for y in range(h):
        for x in range(w):
            old = out[y, x].copy()
            new = pal[((pal - old.astype(int)) ** 2).sum(1).argmin()].astype(np.uint8)
            out[y, x] = new
            error = old / one - new / one
            for dy, row in enumerate(rows):
                for dx, weight in enumerate(row):
                    ty, tx = y + dy, x + dx - offset
                    if weight and (old != new).any() and 0 <= tx < w and ty < h and out[ty, tx, 3]:
                        moved = out[ty, tx] / one + error * (np.float32(weight) / np.float32(divisor))
                        out[ty, tx] = np.floor(np.clip(moved * one + np.float32(0.5), 0, 255))
    return out


@pytest.mark.parametrize("kernel", sorted(Q.DIFFUSIONS))
def test_diffusion_matches_a_plain_scan(kernel):
    r = np.random.default_rng(7)
    frames = r.integers(0, 256, (4, 11, 19, 4)).astype(np.uint8)
    frames[..., 3][frames[..., 3] < 70] = 0
    palette = [(0, 0, 0, 255), (255, 255, 255, 255), (200, 30, 60, 255), (0, 0, 0, 0)]
    got = Q.diffuse_many(frames / 255.0, palette, kernel)
    assert (np.rint(got * 255) == np.stack([plain_diffusion(f, palette, kernel) for f in frames])).all()
    one = Q.diffuse(frames[0] / 255.0, palette, kernel, rect=(3, 2, 9, 6))
    assert (np.rint(one * 255)[2:8, 3:12] == plain_diffusion(frames[0, 2:8, 3:12], palette, kernel)).all()
    assert (np.rint(one * 255)[:2] == frames[0, :2]).all() and (np.rint(one * 255)[:, 12:] == frames[0, :, 12:]).all()


@pytest.mark.parametrize(
    ("source", "target", "mode", "anchor", "want"),
    [
        ((105, 77), (90, 70), "crop", "right", ((90, 70), (-5, 0, 96, 70))),
        ((105, 77), (90, 70), "crop", "left", ((90, 70), (0, 0, 96, 70))),
        ((105, 77), (90, 70), "crop", "center", ((90, 70), (-3, 0, 96, 70))),
        ((77, 105), (70, 90), "crop", "bottom", ((70, 90), (0, -5, 70, 96))),
        ((77, 105), (70, 90), "crop", "top_right", ((70, 90), (0, 0, 70, 96))),
        ((100, 50), (60, 60), "pad", "center", ((60, 60), (0, 15, 60, 30))),
        ((100, 50), (60, 60), "pad", "bottom", ((60, 60), (0, 30, 60, 30))),
        ((50, 100), (60, 60), "pad", "right", ((60, 60), (30, 0, 30, 60))),
        ((20, 11), (40, 40), "box_pad", "center", ((40, 40), (10, 14, 20, 11))),
        ((20, 11), (40, 40), "box_pad", "bottom_right", ((40, 40), (20, 29, 20, 11))),
        ((40, 10), (40, 40), "box_pad", "center", ((40, 40), (0, 15, 40, 10))),
        ((100, 50), (60, 60), "max", "center", ((60, 30), (0, 0, 60, 30))),
        ((100, 50), (60, 20), "min", "center", ((40, 20), (0, 0, 40, 20))),
        ((100, 90), (60, 20), "min", "center", ((60, 54), (0, 0, 60, 54))),
        ((100, 50), (120, 20), "min", "center", ((100, 50), (0, 0, 100, 50))),
        ((100, 50), (40, 0), "stretch", "center", ((40, 20), (0, 0, 40, 20))),
    ],
)
def test_resize_geometry(source, target, mode, anchor, want):
    assert resize_geometry(source, target, mode, anchor) == want


def test_crop_about_a_point():
    assert resize_geometry((100, 50), (40, 40), "crop", center=(0.5, 0.5)) == ((40, 40), (-20, 0, 80, 40))
    assert resize_geometry((100, 50), (40, 40), "crop", center=(0.0, 0.5)) == ((40, 40), (0, 0, 80, 40))
    assert resize_geometry((100, 50), (40, 40), "crop", center=(1.0, 0.5)) == ((40, 40), (-40, 0, 80, 40))


@pytest.mark.parametrize(
    ("side", "corner", "want"),
    [
        ("left", "both", [(0, 5), (40, 0), (40, 20), (0, 15)]),
        ("left", "left_or_top", [(0, 10), (40, 0), (40, 20), (0, 20)]),
        ("top", "right_or_bottom", [(0, 0), (20, 0), (40, 20), (0, 20)]),
        ("right", "right_or_bottom", [(0, 0), (40, 0), (40, 10), (0, 20)]),
        ("bottom", "left_or_top", [(0, 0), (40, 0), (40, 20), (20, 20)]),
    ],
)
def test_taper_moves_corners(side, corner, want):
    p = np.array([(0, 0, 1), (40, 0, 1), (40, 20, 1), (0, 20, 1)]) @ R.taper(40, 20, side, corner, 0.5)
    assert np.allclose(p[:, :2] / p[:, 2:], want)


def test_wu_boxes():
    flat = np.array([[(8, 8, 8, 255)] * 6 + [(200, 8, 8, 255)] * 3 + [(8, 200, 8, 255)] * 2], np.uint8)
    assert sorted(map(tuple, Q.wu_palette(flat, 3).tolist())) == [(8, 8, 8, 255), (8, 200, 8, 255), (200, 8, 8, 255)]
    assert Q.wu_palette(flat, 1).tolist() == [[60, 43, 8, 255]]
    assert len(Q.wu_palette(flat, 16)) == 3 and len(Q.wu_palette(np.zeros((0, 4), np.uint8))) == 0


def test_frames_of_several_sizes_in_one_batch(spark):
    r = np.random.default_rng(1)
    frames = [(i, 0, r.integers(0, 256, (h, w, 4)).astype(np.uint8)) for i, (h, w) in enumerate([(4, 6), (5, 5), (4, 6), (1, 1)])]
    table = spark.createDataFrame(batch_of(frames).to_pandas())
    got = {x["image_id"]: x for x in Chain().then(Q.binary_dither).apply(table).collect()}
    for i, _, f in frames:
        want = plain_diffusion(f, [(255, 255, 255, 255), (0, 0, 0, 255)], "floyd_steinberg")
        assert bytes(got[i]["pixels"]) == want.tobytes()
