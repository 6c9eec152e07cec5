"""Literal fixtures, and differences between the two layouts, of the raster engine."""

import numpy as np
import pytest
from pixelquarry import frames
from pixelquarry.functions import color_spaces as S
from pixelquarry.functions import pixel_formats as P
from pixelquarry.kernels import base, bokeh, convolve, quantize, resample
from pixelquarry.operators import blend, color, geometry, histogram, palette
from pixelquarry.sources import codecs, files, metadata

GRAY_IN = """52 55 61 59 70 61 76 61 62 59 55 104 94 85 59 71 63 65 66 113 144 104 63 72 64 70 70 126 154 109 71 69
67 73 68 106 122 88 68 68 68 79 60 79 77 66 58 75 69 85 64 58 55 61 65 83 70 87 69 68 65 73 78 90"""
GRAY_OUT = """0 12 53 32 146 53 174 53 57 32 12 227 219 202 32 154 65 85 93 239 251 227 65 158 73 146 146 247 255 235 154 130
97 166 117 231 243 210 117 117 117 190 36 190 178 93 20 170 130 202 73 20 12 53 85 194 146 206 130 117 85 166 182 215"""


def px_of(spark, arrays):
    rows = [(i, 0, y, x, *map(int, a[y, x])) for i, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id long, frame_no int, y int, x int, r int, g int, b int, a int")


def noise(seed, h=9, w=7):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 4)).astype(np.uint8)


def test_equalization_fixture(spark):
    gray = np.array(GRAY_IN.split(), np.uint8).reshape(8, 8)
    out = histogram.equalize(px_of(spark, [np.dstack([gray] * 3 + [np.full_like(gray, 255)])])).orderBy("y", "x").toPandas()
    assert out.r.tolist() == list(map(int, GRAY_OUT.split()))


@pytest.mark.parametrize(("n", "want"), [(2, [[0, 2], [3, 1]]), (3, [[0, 5, 2], [7, 4, 8], [3, 6, 1]]), (4, [[0, 8, 2, 10], [12, 4, 14, 6], [3, 11, 1, 9], [15, 7, 13, 5]])])
def test_ordered_matrices(n, want):
    assert palette.bayer(n).tolist() == want


@pytest.mark.parametrize(("mode", "want"), [("repeat", "00012 00123 01234 12345 23456 34566 45666"), ("bounce", "21012 10123 01234 12345 23456 34565 45654"), ("mirror", "10012 00123 01234 12345 23456 34566 45665"), ("wrap", "56012 60123 01234 12345 23456 34560 45601")])
def test_borders(mode, want):
    assert " ".join("".join(map(str, base.border_index(np.arange(p - 2, p + 3), 0, 6, mode))) for p in range(7)) == want


@pytest.mark.parametrize(("mode", "a", "b", "c"), [("multiply", 1, 0.6, None), ("add", 1, 1, 0.24324325), ("subtract", 0, 1, 0.2027027), ("screen", 1, 1, 0.2383784), ("darken", 1, 0.6, 0.2189189), ("lighten", 1, 1, 0.227027), ("overlay", 1, 1, 0.2124324), ("hard_light", 1, 0.6, 0.2124324), ("normal", 1, 0.6, None)])
def test_blend_fixtures(spark, mode, a, b, c):
    for (back, over, amount), want in zip((((1, 1, 1, 1), (1, 1, 1, 1), 1), ((1, 1, 1, 1), (0, 0, 0, 0.8), 0.5), ((0.2, 0.2, 0.2, 0.3), (0.3, 0.3, 0.3, 0.2), 0.5)), (a, b, c)):
        if want is not None:
            v = blend.composed([f"{x}e0" for x in back], [f"{x}e0" for x in over], mode, "src_over", f"{amount}e0")[0]
            assert spark.sql(f"SELECT {v} AS v").first()["v"] == pytest.approx(want, abs=1e-6)


def _value(spark, parts):
    return list(spark.sql("SELECT " + ", ".join(f"CAST({p} AS DOUBLE) AS v{k}" for k, p in enumerate(parts))).first())


def test_color_fixtures(spark):
    e = lambda v: [f"({x}e0)" for x in v]
    for got, want, eps in (
        (S.ycbcr_to_rgb(e((1, 0.5, 0.5))), (1, 1, 1), 1e-3),
        (S.hsv_to_rgb(e((120, 1, 1))), (0, 1, 0), 1e-6),
        (S.hsl_to_rgb(e((240, 1, 0.5))), (0, 0, 1), 1e-6),
        (S.cmyk_to_rgb(e((0, 0.84, 0.037, 0.365))), (0.635, 0.1016, 0.6115), 1e-3),
        (S.lab_to_xyz(e((45.6398, 39.8753, 35.2091)), "D65"), (0.216938, 0.150041, 0.048850), 1e-5),
        (S.from_polar(e((54.2917, 106.8391, 40.8526))), (54.2917, 80.8125, 69.8851), 1e-3),
        (S.xyz_to_xyy(e((0.436075, 0.222504, 0.013932))), (0.648427, 0.330856, 0.222504), 1e-5),
        (S.lms_to_xyz(e((0.941428535, 1.040417467, 1.089532651))), (0.95047, 1, 1.08883), 1e-4),
        (S.xyz_to_hunter_lab(e((0.360555, 0.936901, 0.1001514))), (96.79365, -100.951096, 49.35507), 1e-3),
        (S.xyz_to_rgb(e((0.297676, 0.267854, 0.045504))), (0.720315, 0.509999, 0.168112), 1e-3),
    ):
        assert _value(spark, got) == pytest.approx(want, abs=eps)


@pytest.mark.parametrize(("mode", "source", "target", "size", "rect"), [("min", (200, 100), (400, 200), (200, 100), (0, 0, 200, 100)), ("max", (5072, 6761), (0, 450), (338, 450), (0, 0, 338, 450)), ("crop", (100, 100), (25, 50), (25, 50), (-12, 0, 50, 50)), ("box_pad", (100, 100), (120, 110), (120, 110), (10, 5, 100, 100))])
def test_resize_geometry(mode, source, target, size, rect):
    assert geometry.resize_geometry(source, target, mode) == (size, rect)


def test_layouts_round_trip_and_agree(spark):
    arrays = [noise(1), noise(2, 4, 11)]
    px = px_of(spark, arrays)
    packed = frames.assemble(px)
    for r in packed.collect():
        assert np.array_equal(np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], 4), arrays[r["image_id"]])
    key = ["image_id", "y", "x"]
    assert frames.explode(packed).toPandas().sort_values(key, ignore_index=True).astype(int).equals(px.toPandas().sort_values(key, ignore_index=True).astype(int))
    turned = frames.explode(frames.process(packed, resample.rotate, 90.0)).toPandas().sort_values(key, ignore_index=True).astype(int)
    assert turned.equals(geometry.rotate_right_angle(px, 90).toPandas().sort_values(key, ignore_index=True).astype(int))


def test_filters_compose_lazily(spark):
    px = px_of(spark, [noise(3)])
    twice = color.invert(color.invert(px)).orderBy("y", "x").toPandas()
    assert twice.equals(px.orderBy("y", "x").toPandas())
    assert "Exchange" not in color.sepia(color.brightness(px, 1.2))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("mode", base.BORDERS)
def test_a_flat_colour_stays_under_blur(mode):
    v = np.full((9, 9, 4), 0.4)
    assert (base.to_bytes(convolve.gaussian_blur(v, 1.5, None, mode, mode)) == 102).all()
    assert (base.to_bytes(convolve.box_blur(v, 2, None, mode, mode)) == 102).all()


def test_separability():
    g = convolve.gaussian_kernel(1.0)
    assert convolve.separated(np.outer(g, g)) is not None and convolve.separated(convolve.LAPLACIAN_OF_GAUSSIAN) is None


def test_bokeh_keeps_light():
    lines = bokeh.kernels(5, 2)
    assert sum(p * np.outer(k, k).sum().real + q * np.outer(k, k).sum().imag for k, p, q in lines) == pytest.approx(1)


@pytest.mark.parametrize("sampler", [s for s in resample.SAMPLERS if s != "nearest"])
def test_weights_sum_to_one(sampler):
    for a, b in ((15, 10), (10, 15), (49, 5), (5, 25)):
        assert resample.axis_weights(a, b, sampler).sum(1) == pytest.approx(1)


def test_transform_identity_and_quad():
    v = noise(5) / 255
    assert resample.transform(v, np.eye(3)) is v
    m = resample.quad(10, 8, [(1, 2), (9, 0), (10, 8), (0, 7)])
    assert resample._corners(m, 10, 8) == pytest.approx(np.array([(1, 2), (9, 0), (10, 8), (0, 7)]))


def test_palettes():
    v = noise(6, 20, 20) / 255
    assert len(quantize.wu_palette(base.to_bytes(v), 16)) <= 16 and len(quantize.tree_palette(base.to_bytes(v), 16)) <= 16
    few = np.array([(0, 0, 0, 255), (255, 0, 0, 255)], np.uint8)
    flat = few[np.random.default_rng(1).integers(0, 2, (6, 6))]
    assert (base.to_bytes(quantize.quantize(flat / 255, "wu", 8, None)) == flat).all()
    assert (base.to_bytes(quantize.diffuse(flat / 255, few)) == flat).all()
    got = quantize.nearest(base.to_bytes(v), few)
    want = ((base.to_bytes(v).astype(int)[..., None, :] - few.astype(int)) ** 2).sum(-1).argmin(-1)
    assert (got == want).all()


@pytest.mark.parametrize("name", P.FORMATS)
def test_pixel_formats(name):
    f = P.FORMATS[name]
    v = P.unpack(P.pack(np.random.default_rng(1).uniform(0, 1, (50, 4)), name), name)
    assert P.pack(v, name) == P.pack(P.unpack(P.pack(v, name), name), name)
    assert len(P.pack(v, name)) * 8 == 50 * f.bits_per_pixel


LOSSLESS = [("qoi", {}), ("png", {}), ("png", {"filter": "sub"}), ("png", {"filter": "up"}), ("bmp", {}), ("tga", {}), ("tga", {"rle": True}), ("tiff", {}), ("tiff", {"compression": "lzw"}), ("tiff", {"compression": "packbits", "predictor": True}), ("tiff", {"compression": "none"}), ("ico", {}), ("cur", {}), ("ani", {})]


@pytest.mark.parametrize(("fmt", "options"), LOSSLESS)
def test_codecs_round_trip(fmt, options):
    smooth = np.repeat(np.repeat(noise(7, 4, 5), 5, 0), 4, 1)
    for a in (noise(8, 13, 17), smooth):
        data = codecs.ENCODERS[fmt]([a], **options)
        assert codecs.detect(data) == fmt and (codecs.decode(data)[0] == a).all()
        i = codecs.identify(data)
        assert fmt == "ani" or (i["width"], i["height"]) == a.shape[1::-1]
        with pytest.raises(codecs.CodecError):
            codecs.decode(data[: len(data) // 3])


def test_codecs_without_alpha_and_animations():
    a = noise(9)
    a[..., 3] = 255
    for fmt, options in (("pbm", {}), ("pbm", {"plain": True}), ("bmp", {"bits": 24}), ("tga", {"bits": 24}), ("png", {"color": "rgb"}), ("tiff", {"color": "rgb"}), ("gif", {})):
        assert (codecs.decode(codecs.ENCODERS[fmt]([a], **options))[0] == a).all()
    both = [a, a[::-1].copy()]
    for fmt in ("gif", "png"):
        assert [(x == y).all() for x, y in zip(codecs.decode(codecs.ENCODERS[fmt](both)), both, strict=True)] == [True, True]


def test_files(spark, tmp_path):
    arrays = [noise(10), noise(11, 5, 6)]
    packed = frames.assemble(px_of(spark, arrays))
    for fmt in ("png", "qoi"):
        files.save(files.encode(packed, fmt), f"{tmp_path}/out", fmt).collect()
    (tmp_path / "out" / "broken.png").write_bytes(codecs.encode_png([arrays[0]])[:50])
    (tmp_path / "out" / "text.txt").write_text("no image")
    found = spark.read.format("binaryFile").load(f"{tmp_path}/out")
    named = {r["path"].rsplit("/")[-1]: r["f"] for r in found.select("path", files.detect_format(found["content"]).alias("f")).collect()}
    assert named == {"0.png": "png", "1.png": "png", "0.qoi": "qoi", "1.qoi": "qoi", "broken.png": "png", "text.txt": None}
    sizes = {r["path"].rsplit("/")[-1]: (r["width"], r["height"]) for r in files.identify(found).collect()}
    assert sizes["1.qoi"] == (6, 5)
    got = {r["path"].rsplit("/")[-1]: r for r in files.read(spark, f"{tmp_path}/out", maxFrames=1).collect()}
    assert got["broken.png"]["error"] and got["text.txt"]["error"] and got["0.png"]["pixels"] == arrays[0].tobytes()
    small = files.read(spark, f"{tmp_path}/out", targetSize="3x3").filter("path LIKE '%1.png'").first()
    assert (small["width"], small["height"]) == (3, 3)


def test_stream(spark, tmp_path):
    from pixelquarry import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(codecs.encode_png([noise(12)]))
    chain = frames.Chain().then(convolve.detect_edges, "sobel")
    q = streaming.processed(streaming.read_stream(spark, f"{tmp_path}/in"), chain).writeStream.format("memory").queryName("edges").option("checkpointLocation", f"{tmp_path}/check").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("edges").count() == 1


def test_exif_round_trip():
    tags = [("image", 0x010F, 2, "maker"), ("image", 0x0112, 3, 6), ("image", 0x011A, 5, (72, 1)), ("exif", 0x9000, 7, b"0230"), ("exif", 0x829A, 5, (1, 250)), ("gps", 1, 2, "N")]
    back = [t for t in metadata.exif_tags(metadata.exif_bytes(tags)) if t[1] not in metadata.EXIF_POINTERS]
    assert sorted(back, key=str) == sorted(tags, key=str)
    values = [(2, 5, b"title"), (2, 25, b"word")]
    assert metadata.iptc_values(metadata.iptc_bytes(values)) == values
