"""Lossless WebP: a known file, files made bit by bit with every transform, round trips and damaged files."""

import base64

import numpy as np
import pytest
from pixelquarry.sources import codecs, webp

#: A widely used one-pixel file: clear black.
KNOWN = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")


def test_a_known_file():
    assert codecs.decode(KNOWN)[0].tolist() == [[[0, 0, 0, 0]]] and codecs.identify(KNOWN)["width"] == 1


@pytest.mark.parametrize("seed", range(5))
def test_round_trips(seed):
    r = np.random.default_rng(seed)
    for a in (r.integers(0, 256, (r.integers(1, 40), r.integers(1, 40), 4)), np.full((50, 90, 4), seed * 50), r.integers(0, 2, (31, 30, 4)) * 255, np.repeat(r.integers(0, 256, (6, 7, 4)), 9, 1)):
        assert (codecs.decode(codecs.ENCODERS["webp"]([a.astype(np.uint8)]))[0] == a).all()


def single(w, *symbols):
    """Five codes of one symbol each (green, red, blue, alpha, distance)."""
    for s in symbols:
        w.put(0b101, 3)
        w.put(s, 8)


def pixels(w, *values):
    """An inner picture of one colour."""
    w.put(0, 1)  # no colour cache
    single(w, *values, 0)


def picture(width, height, build):
    w = webp._Writer()
    for v, k in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(v, k)
    build(w)
    return webp.decode_lossless(w.held.to_bytes(w.n // 8 + 8, "little"))


@pytest.mark.parametrize(("mode", "want"), [(0, [[5, 10, 15], [15, 5, 5]]), (1, [[5, 10, 15], [10, 15, 20]]), (2, [[5, 10, 15], [10, 15, 20]]), (7, [[5, 10, 15], [10, 15, 20]]), (11, [[5, 10, 15], [10, 15, 20]]), (12, [[5, 10, 15], [10, 20, 25]])])
def test_foretold_pixels(mode, want):
    """Every pixel differs by 5 in green from what is foretold; the first row is foretold by its left pixel, the first column by the one above."""

    def build(w):
        w.put(1, 1)
        w.put(0, 2)
        w.put(0, 3)
        pixels(w, mode, 0, 0, 0)
        w.put(0, 1)
        w.put(0, 2)  # no colour cache, no groups
        single(w, 5, 0, 0, 0, 0)

    got = picture(3, 2, build)[..., 1]
    expected = np.zeros((2, 3), int)
    for y in range(2):
        for x in range(3):
            left, top, corner = expected[y, x - 1] if x else 0, expected[y - 1, x] if y else 0, expected[y - 1, x - 1] if x and y else 0
            told = 0 if not x and not y else left if not y else top if not x else {0: 0, 1: left, 2: top, 7: (left + top) // 2, 11: left if abs(top - corner) < abs(left - corner) else top, 12: left + top - corner}[mode]
            expected[y, x] = told + 5
    assert (got == expected).all() and expected.tolist()[0] == want[0]


def test_recoloured_pixels():
    def build(w):
        w.put(1, 1)
        w.put(1, 2)
        w.put(0, 3)
        pixels(w, 64, 32, 256 - 16, 255)  # green to blue 64, red to blue 32, green to red -16
        w.put(0, 1)
        w.put(0, 2)
        single(w, 100, 30, 7, 255, 0)

    red = (30 + (-16 * 100 >> 5)) & 255
    blue = (7 + (64 * 100 >> 5) + (32 * ((red ^ 128) - 128) >> 5)) & 255
    assert picture(1, 1, build).tolist() == [[[red, 100, blue, 255]]]


def test_colour_tables_are_packed():
    def build(w):
        w.put(1, 1)
        w.put(3, 2)
        w.put(1, 8)  # two colours
        pixels(w, 10, 20, 30, 255)  # the second one is the first added to itself
        w.put(0, 1)
        w.put(0, 2)
        single(w, 0b10110, 0, 0, 0, 0)  # eight pixels a number, from the lowest bit on

    a, b = [20, 10, 30, 255], [40, 20, 60, 254]
    assert picture(5, 1, build).tolist() == [[a, b, b, a, b]]


def test_damaged_files_give_errors():
    good = webp.encode_webp([np.random.default_rng(0).integers(0, 256, (20, 20, 4)).astype(np.uint8)])
    for data in (good[:40], good[:20], b"RIFF\x04\0\0\0WEBP", good[:12] + b"VP8 " + good[16:]):
        with pytest.raises(codecs.CodecError):
            codecs.decode(data)
