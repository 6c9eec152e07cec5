"""EXIF orientation applied and reset; pixel formats as a DataFrame operator."""

import numpy as np
import pytest
from pixelquarry.frames import batch_of, clone_as
from pixelquarry.sources import codecs, files, metadata

CORNERS = np.array([[[1, 0, 0, 255], [2, 0, 0, 255], [3, 0, 0, 255]], [[4, 0, 0, 255], [5, 0, 0, 255], [6, 0, 0, 255]]], np.uint8)


@pytest.mark.parametrize(("turn", "want"), [(1, "123/456"), (2, "321/654"), (3, "654/321"), (4, "456/123"), (5, "14/25/36"), (6, "41/52/63"), (7, "63/52/41"), (8, "36/25/14")])
def test_upright(turn, want):
    got = files.UPRIGHT[turn](CORNERS)[..., 0]
    assert "/".join("".join(map(str, row)) for row in got.tolist()) == want


@pytest.mark.parametrize("fmt", ["png", "jpeg"])
def test_exif_is_kept_and_reset(spark, fmt):
    exif = metadata.exif_bytes([("image", 0x0112, 3, 6), ("image", 0x010F, 2, "Maker"), ("exif", 0xA002, 4, 3), ("exif", 0xA003, 4, 2)])
    data = metadata.with_exif(codecs.ENCODERS[fmt]([CORNERS]), exif)
    assert metadata.orientation(data) == 6 and codecs.identify(data)["width"] == 3
    rows = [(1, bytearray(data)), (2, bytearray(codecs.ENCODERS[fmt]([CORNERS]))), (3, bytearray(b"no image")), (4, None)]
    got = {r["image_id"]: r["content"] for r in files.auto_orient(spark.createDataFrame(rows, "image_id long, content binary"), fmt).collect()}
    turned = bytes(got[1])
    assert metadata.orientation(turned) == 1 and codecs.decode(turned)[0].shape == (3, 2, 4)
    tags = {(d, t): v for d, t, _, v in metadata.exif_tags(metadata.segments(turned)["exif"])}
    assert tags["image", 0x010F] == "Maker" and (tags["exif", 0xA002], tags["exif", 0xA003]) == (2, 3)
    assert codecs.decode(bytes(got[2]))[0].shape == (2, 3, 4) and "exif" not in metadata.segments(bytes(got[2]))
    assert bytes(got[3]) == b"no image" and got[4] is None
    again = metadata.with_exif(turned, exif)
    assert metadata.orientation(again) == 6 and len(again) < len(turned) + 40


def test_orientation_of_odd_files():
    assert metadata.orientation(None) == metadata.orientation(b"") == metadata.orientation(b"\xff\xd8\xff\xe1\x00") == 1


def test_clone_as(spark):
    frames = spark.createDataFrame(batch_of([(7, 0, CORNERS)]).to_pandas())
    row = clone_as(frames, "Bgr24").first()
    assert (row["format"], bytes(row["pixels"])[:6]) == ("Bgr24", bytes([0, 0, 1, 0, 0, 2]))
    assert bytes(clone_as(clone_as(frames, "Argb32"), "Rgba32").first()["pixels"]) == CORNERS.tobytes()
