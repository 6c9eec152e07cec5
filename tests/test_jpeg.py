"""JPEG against the JVM's ImageIO, and damaged files."""

import numpy as np
import pytest
from pixelquarry.sources import codecs, files, jpeg

yy, xx = np.mgrid[:50, :70]
PICTURE = np.clip(128 + 100 * np.stack([np.sin(xx / 9.0), np.cos(yy / 7.0), np.sin((xx + yy) / 11.0)], -1), 0, 255).astype(np.uint8)


def by_java(spark, data):
    io = spark._jvm.javax.imageio.ImageIO
    im = io.read(spark._jvm.java.io.ByteArrayInputStream(bytearray(data)))
    a = np.array([[im.getRGB(x, y) for x in range(im.getWidth())] for y in range(im.getHeight())])
    return np.stack([a >> 16 & 255, a >> 8 & 255, a & 255], -1)


def from_java(spark, a, progressive):
    j = spark._jvm
    im = j.java.awt.image.BufferedImage(a.shape[1], a.shape[0], 1)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            im.setRGB(x, y, int(a[y, x, 0]) << 16 | int(a[y, x, 1]) << 8 | int(a[y, x, 2]))
    writer = j.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionQuality(0.8)
    if progressive:
        param.setProgressiveMode(1)
    out = j.java.io.ByteArrayOutputStream()
    stream = j.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, j.javax.imageio.IIOImage(im, None, None), param)
    stream.flush()
    return bytes(out.toByteArray())


def test_the_jvm_reads_what_is_written(spark):
    data = jpeg.encode_jpeg([PICTURE], quality=95, subsampled=False)
    own = codecs.decode(data)[0][..., :3].astype(int)
    assert np.abs(own - by_java(spark, data)).max() <= 3 and np.abs(own - PICTURE).mean() < 1.5
    assert np.abs(codecs.decode(jpeg.encode_jpeg([PICTURE], quality=90))[0][..., :3].astype(int) - PICTURE).mean() < 4


def test_progressive_files_give_what_sequential_ones_do(spark):
    plain, progressive = (from_java(spark, PICTURE, p) for p in (False, True))
    assert jpeg.Decoder(progressive).progressive and not jpeg.Decoder(plain).progressive
    a, b = (codecs.decode(d)[0] for d in (plain, progressive))
    assert (a == b).all()
    # chroma is enlarged by repetition here and smoothly there, so only luminance is alike
    luma = np.array([0.299, 0.587, 0.114])
    assert np.abs(a[..., :3] @ luma - by_java(spark, plain) @ luma).mean() < 1


@pytest.mark.parametrize(("target", "points"), [((70, 50), 8), ((36, 26), 8), ((35, 25), 4), ((18, 13), 2), ((9, 7), 1), ((1, 1), 1)])
def test_small_targets_are_decoded_small(target, points):
    data = jpeg.encode_jpeg([PICTURE], quality=95, subsampled=False)
    assert jpeg.points_for(70, 50, target) == points
    small = jpeg.decode_jpeg(data, target)[0]
    assert small.shape == (-(-50 * points // 8), -(-70 * points // 8), 4)
    if points < 8:
        k = 8 // points
        mean = PICTURE[: 48 // k * k, : 64 // k * k].reshape(48 // k, k, 64 // k, k, 3).mean((1, 3))
        assert np.abs(small[: 48 // k, : 64 // k, :3] - mean).mean() < 3


def test_restart_marks_and_gray():
    data = jpeg.encode_jpeg([PICTURE], quality=80, gray=True)
    plain = jpeg.Decoder(data)
    assert len(plain.components) == 1 and (plain.rgb()[..., 0] == plain.rgb()[..., 2]).all()
    assert jpeg.encode_jpeg([PICTURE[:1, :1]], quality=80)[:2] == b"\xff\xd8" and codecs.decode(jpeg.encode_jpeg([PICTURE[:1, :1]]))[0].shape == (1, 1, 4)


def test_code_lengths_are_bounded_and_unique():
    for counts in (np.array([1] + [0] * 255), np.array([int(1.7**k) for k in range(40)] + [0] * 216), np.ones(256, int)):
        lengths, symbols, codes = jpeg._codes_for(counts)
        assert sum(lengths) == len(symbols) == int((counts > 0).sum()) and max(n for _, n in codes.values()) <= 16
        words = [format(c, f"0{n}b") for c, n in codes.values()]
        assert len(set(words)) == len(words) and not any(a != b and b.startswith(a) for a in words for b in words) and all("0" in w for w in words)
        table = jpeg._lookup(lengths, symbols)
        for s, (c, n) in codes.items():
            assert table[c << (16 - n)] == n << 8 | s


def test_damaged_and_missing_files_give_errors(spark):
    data = jpeg.encode_jpeg([PICTURE])
    rows = [(0, bytearray(data)), (1, bytearray(data[:40])), (2, None), (3, bytearray(b"\xff\xd8\xff")), (4, bytearray(b"")), (5, bytearray(data[:300]))]
    table = spark.createDataFrame(rows, "image_id long, content binary")
    got = {r["image_id"]: r for r in files.decode(table).collect()}
    assert got[0]["width"] == 70 and got[0]["pixels"] is not None
    assert all(got[k]["dtype"].startswith("error") for k in (1, 2, 3, 4))
    assert got[5]["pixels"] is not None or got[5]["dtype"].startswith("error")
    seen = {r["path"]: r for r in files.identify(table.selectExpr("CAST(image_id AS STRING) AS path", "content")).collect()}
    assert (seen["0"]["format"], seen["0"]["width"], seen["0"]["height"]) == ("jpeg", 70, 50) and seen["2"]["error"] == "no content"
