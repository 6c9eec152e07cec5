"""Queries of codecs and file operators on the events raster: encoded, then sniffed, identified or decoded again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frames import assemble, clone_as, explode
from ..operators import palette as P
from ..sources import files, metadata
from . import frame_oracles as O

ALL = "image_id, frame_no, y, x, r, g, b, a"


def _round_trip(fmt, **options):
    return lambda px: explode(files.decode(files.encode(assemble(px), fmt, **options)))


def _same(source):
    return f"SELECT {ALL} FROM {source}"


def _detected(px):
    packed, out = assemble(px), None
    for fmt in ("png", "qoi", "bmp", "tga", "tiff", "ico", "cur", "ani", "pbm"):
        found = files.encode(packed, fmt).select("image_id", F.lit(fmt).alias("written"), files.detect_format(F.col("content")).alias("detected"))
        out = found if out is None else out.unionByName(found)
    return out


def _detected_sql(source):
    names = " UNION ALL ".join(f"SELECT '{f}' AS written" for f in ("png", "qoi", "bmp", "tga", "tiff", "ico", "cur", "ani", "pbm"))
    return f"SELECT i.image_id, n.written, n.written AS detected FROM (SELECT DISTINCT image_id FROM {source}) AS i CROSS JOIN ({names}) AS n"


def _identified(fmt, bits):
    def run(px):
        encoded = files.encode(assemble(px), fmt).withColumn("path", F.col("image_id").cast("string"))
        return files.identify(encoded).select("path", "format", "width", "height", "bits")

    def text(source):
        return f"SELECT CAST(image_id AS VARCHAR) AS path, '{fmt}' AS format, max(x) + 1 AS width, max(y) + 1 AS height, {bits} AS bits FROM {source} GROUP BY image_id"

    return run, text


def _oriented(fmt, **options):
    """Every image gets an EXIF orientation by its number, is put upright, and what the file says then is read with its pixels."""

    def run(px):
        turn = (F.pmod("image_id", F.lit(8)) + 1).cast("int")
        tags = F.array(F.struct(F.lit("image"), F.lit(0x0112), F.lit(3), turn), F.struct(F.lit("exif"), F.lit(0xA002), F.lit(4), F.lit(7)))
        upright = files.auto_orient(files.set_exif(files.encode(assemble(px), fmt, **options), tags), fmt, **options)
        said = metadata.exif_rows(upright).groupBy("image_id").agg(F.max(F.when(F.col("tag") == 0x0112, F.col("value"))).alias("orientation"), F.max(F.when(F.col("tag") == 0xA002, F.col("value"))).alias("pixel_width"))
        return explode(files.decode(upright)).join(said, "image_id")

    def text(source):
        turn = "((image_id % 8 + 8) % 8 + 1)"
        x = f"CASE {turn} WHEN 2 THEN 31 - x WHEN 3 THEN 31 - x WHEN 5 THEN y WHEN 6 THEN 31 - y WHEN 7 THEN 31 - y WHEN 8 THEN y ELSE x END"
        y = f"CASE {turn} WHEN 3 THEN 31 - y WHEN 4 THEN 31 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 31 - x WHEN 8 THEN 31 - x ELSE y END"
        return f"SELECT image_id, frame_no, {y} AS y, {x} AS x, r, g, b, a, '1' AS orientation, '32' AS pixel_width FROM {source} AS s"

    return run, text


def _cloned(name, columns):
    """To a pixel format and back; columns: what is left of r, g, b and a, in SQL."""

    def text(source):
        return f"SELECT image_id, frame_no, y, x, {', '.join(f'CAST({v} AS INT) AS {c}' for c, v in zip('rgba', columns, strict=True))} FROM {source} AS s"

    return (lambda px: explode(clone_as(clone_as(assemble(px), name), "Rgba32"))), text


def _coarse(c, bits):
    top = (1 << bits) - 1
    return f"floor(floor({c} / 255e0 * {top} + 0.5e0) / {top}e0 * 255 + 0.5e0)"


_GRAY = "floor((0.2126e0 * (r / 255e0) + 0.7152e0 * (g / 255e0) + 0.0722e0 * (b / 255e0)) * 255 + 0.500000001e0)"
def _animated(fmt, palette=None):
    """Three images at a time become the frames of one file."""

    def run(px):
        px = P.quantize(px, palette).drop("idx") if palette else px
        px = px.withColumns({"frame_no": F.pmod("image_id", F.lit(3)).cast("int"), "image_id": F.floor(F.col("image_id") / 3)})
        return explode(files.decode(files.encode(assemble(px), fmt)))

    def text(source):
        inner = f"({P.quantize.sql(source, palette)}) AS q" if palette else f"{source} AS q"
        return f"SELECT CAST(floor(image_id / 3e0) AS BIGINT) AS image_id, CAST(((image_id % 3) + 3) % 3 AS INT) AS frame_no, y, x, r, g, b, a FROM {inner}"

    return run, text


SOURCES = {
    "round_trip_apng": _animated("png"),
    "round_trip_gif": _animated("gif", P.websafe()),
    "auto_orient_exif": _oriented("png"),
    "clone_as_bgr565": _cloned("Bgr565", [_coarse("r", 5), _coarse("g", 6), _coarse("b", 5), "255"]),
    "clone_as_bgra5551": _cloned("Bgra5551", [*(_coarse(c, 5) for c in "rgb"), _coarse("a", 1)]),
    "clone_as_bgra4444": _cloned("Bgra4444", [_coarse(c, 4) for c in "rgba"]),
    "clone_as_rgba1010102": _cloned("Rgba1010102", [*(_coarse(c, 10) for c in "rgb"), _coarse("a", 2)]),
    "clone_as_bgra32": _cloned("Bgra32", list("rgba")),
    "clone_as_rgb24": _cloned("Rgb24", ["r", "g", "b", "255"]),
    "clone_as_rgba64": _cloned("Rgba64", list("rgba")),
    "clone_as_la16": _cloned("La16", [_GRAY] * 3 + ["a"]),
    "clone_as_a8": _cloned("A8", ["0", "0", "0", "a"]),
    **{f"round_trip_{f}": (_round_trip(f), _same) for f in ("png", "qoi", "bmp", "tga", "tiff", "ico", "cur", "ani", "webp")},
    "round_trip_tga_rle": (_round_trip("tga", rle=True), _same),
    **{f"round_trip_tiff_{c}": (_round_trip("tiff", compression=c), _same) for c in ("none", "lzw", "packbits")},
    "round_trip_tiff_predictor": (_round_trip("tiff", predictor=True), _same),
    "round_trip_pbm": (_round_trip("pbm"), lambda s: f"SELECT image_id, frame_no, y, x, r, g, b, 255 AS a FROM {s}"),
    "round_trip_pbm_plain": (_round_trip("pbm", plain=True), lambda s: f"SELECT image_id, frame_no, y, x, r, g, b, 255 AS a FROM {s}"),
    "round_trip_pbm_gray": (_round_trip("pbm", color="gray"), lambda s: f"SELECT image_id, frame_no, y, x, l AS r, l AS g, l AS b, 255 AS a FROM (SELECT *, CAST(floor(0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b + 0.5e0) AS INT) AS l FROM {s}) AS gray"),
    **{f"round_trip_jpeg_{q}": (_round_trip("jpeg", quality=q, subsampled=False), (lambda s, q=q: O.jpeg_round_trip(s, q))) for q in (30, 75, 95)},
    "round_trip_jpeg_gray": (_round_trip("jpeg", quality=90, gray=True), lambda s: O.jpeg_round_trip(s, 90, True)),
    "identify_jpeg": _identified("jpeg", 24),
    "identify_webp": _identified("webp", 32),
    "detect_format": (_detected, _detected_sql),
    "identify_png": _identified("png", 32),
    "identify_qoi": _identified("qoi", 32),
    "identify_tiff": _identified("tiff", 32),
    "frames_round_trip": ((lambda px: explode(assemble(px))), _same),
    "first_frames_target_size": ((lambda px: explode(files.decode(files.encode(assemble(px), "qoi"), 1, (16, 16)))), O.halved),
}
