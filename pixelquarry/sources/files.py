"""Image files as Spark sources and sinks.

``detect_format`` is an expression over a binary column. ``identify`` reads
headers only. The data source "raster" decodes files to frames; options:
maxFrames, targetSize (WxH), skipMetadata is implied. ``encode`` gives a binary
column back, ``save`` writes files.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..frames import DDL, batch_of, one_pass
from ..kernels import resample
from ..kernels.base import to_bytes
from . import codecs, metadata

SUFFIXES = {"png": "png", "jpeg": "jpg", "webp": "webp", "gif": "gif", "bmp": "bmp", "pbm": "ppm", "tga": "tga", "qoi": "qoi", "tiff": "tiff", "ico": "ico", "cur": "cur", "ani": "ani"}
MIME = {"png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "pbm": "image/x-portable-pixmap", "tga": "image/x-tga", "qoi": "image/qoi", "tiff": "image/tiff", "ico": "image/x-icon", "cur": "image/x-icon", "ani": "application/x-navi-animation", "jpeg": "image/jpeg", "webp": "image/webp", "exr": "image/x-exr"}


def detect_format(content: Column) -> Column:
    """The format's name by the first bytes, or null; the first rule that fits wins."""
    out = F.lit(None).cast("string")
    at = lambda k, n=1: F.hex(F.substring(content, k + 1, n))
    number = lambda k, n=1: F.conv(at(k, n), 16, 10).cast("int")
    tga = (F.length(content) >= 18) & number(1).isin(0, 1) & number(2).isin(1, 2, 3, 9, 10, 11) & number(16).isin(8, 15, 16, 24, 32) & ((number(1) == 0) | number(7).isin(15, 16, 24, 32))
    out = F.when(tga, "tga").otherwise(out)
    out = F.when(at(0, 3).rlike("^503[1-6](20|09|0A|0D|23)"), "pbm").otherwise(out)
    for name, where, magic in reversed(codecs.MAGIC):
        fits = at(where, len(magic) // 2) == magic
        if where:
            fits &= at(0, 4) == "52494646"
        if name in ("ico", "cur"):
            fits &= at(4, 2) != "0000"
        out = F.when(fits, name).otherwise(out)
    return out


def identify(files: DataFrame) -> DataFrame:
    """(path, format, width, height, bits, frames, error) of a frame with path and content; no pixel is decoded."""
    names = ["path", "format", "width", "height", "bits", "frames", "error"]
    types = [pa.string(), pa.string(), *[pa.int32()] * 4, pa.string()]

    def run(batches):
        for b in batches:
            rows = []
            for path, data in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                try:
                    i = dict.fromkeys(names) | (codecs.identify(data) if data is not None else {"error": "no content"})
                except (ValueError, IndexError, KeyError, TypeError, struct.error) as e:
                    i = dict.fromkeys(names) | {"error": f"{type(e).__name__}: {e}"}
                rows.append((path, *(i[n] for n in names[1:])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)

    return one_pass(files, ("path", "content"), run, "path string, format string, width int, height int, bits int, frames int, error string")


def _least(data: bytes | None, target: tuple[int, int]) -> tuple[int, int] | None:
    """The size to which a JPEG is scaled, so that its decoder can leave out what is finer; None for others."""
    if not data or codecs.detect(data) != "jpeg":
        return None
    size = codecs.identify(data)
    return codecs.scaled_size(size["width"], size["height"], target) if size.get("width") and size.get("height") else None


def _sized(a: np.ndarray, target: tuple[int, int] | None) -> np.ndarray:
    return to_bytes(resample.resize(a / 255.0, *codecs.scaled_size(a.shape[1], a.shape[0], target), "box")) if target else a


#: EXIF orientation -> the upright frame.
UPRIGHT = {
    1: lambda a: a,
    2: lambda a: a[:, ::-1],
    3: lambda a: a[::-1, ::-1],
    4: lambda a: a[::-1],
    5: lambda a: a.transpose(1, 0, 2),
    6: lambda a: np.rot90(a, -1),
    7: lambda a: a[::-1, ::-1].transpose(1, 0, 2),
    8: lambda a: np.rot90(a),
}


def auto_orient(files: DataFrame, fmt: str, **options) -> DataFrame:
    """(image_id, content): each file's frames put upright by its EXIF orientation and encoded again; EXIF is kept, with the orientation reset and the size as it is now. A file that can't be decoded keeps its content."""

    def run(batches):
        for b in batches:
            out = []
            for data in b["content"].to_pylist():
                try:
                    turned = [np.ascontiguousarray(UPRIGHT[metadata.orientation(data)](a)) for a in codecs.decode(data)]
                except codecs.CodecError:
                    out.append(data)
                    continue
                exif = metadata.segments(data).get("exif")
                done = codecs.ENCODERS[fmt](turned, **options)
                out.append(metadata.with_exif(done, metadata.synchronised(exif, turned[0].shape[1], turned[0].shape[0])) if exif and fmt in ("png", "jpeg") else done)
            yield pa.RecordBatch.from_arrays([b["image_id"], pa.array(out, pa.binary())], ["image_id", "content"])

    return one_pass(files, ("image_id", "content"), run, "image_id long, content binary")


def set_exif(files: DataFrame, tags: Column) -> DataFrame:
    """(image_id, content): each PNG or JPEG with EXIF of these tags, an array of (directory, tag, type, value) with whole numbers as values."""

    def run(batches):
        for b in batches:
            done = [metadata.with_exif(data, metadata.exif_bytes([(t["directory"], t["tag"], t["type"], t["value"]) for t in found])) for data, found in zip(b["content"].to_pylist(), b["tags"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["image_id"], pa.array(done, pa.binary())], ["image_id", "content"])

    kind = "array<struct<directory:string,tag:int,type:int,value:int>>"
    return one_pass(files.select("image_id", "content", tags.cast(kind).alias("tags")), ("image_id", "content", "tags"), run, "image_id long, content binary")


def decode(files: DataFrame, max_frames: int | None = None, target: tuple[int, int] | None = None) -> DataFrame:
    """Frames of a DataFrame with image_id and content. What can't be decoded gives a row without pixels whose dtype says why."""

    def run(batches):
        for b in batches:
            for i, data in zip(b["image_id"].to_pylist(), b["content"].to_pylist(), strict=True):
                try:
                    rows = [(i, k, _sized(a, target)) for k, a in enumerate(codecs.decode(data, max_frames, target and _least(data, target)))]
                    yield batch_of(rows)
                except codecs.CodecError as e:
                    yield pa.RecordBatch.from_pylist([{"image_id": i, "frame_no": 0, "width": 0, "height": 0, "channels": 0, "dtype": f"error: {e}", "alpha": None, "pixels": None}], batch_of([]).schema)

    return one_pass(files, ("image_id", "content"), run, DDL)


def encode(frames: DataFrame, fmt: str, **options) -> DataFrame:
    """(image_id, content): the frames of each image in one file, in order."""

    def run(batches):
        for b in batches:
            rows = {"image_id": b["image_id"].to_pylist(), "content": []}
            for image in b["frames"].to_pylist():
                arrays = [np.frombuffer(f["pixels"], np.uint8).reshape(f["height"], f["width"], f["channels"]) for f in image]
                rows["content"].append(codecs.ENCODERS[fmt](arrays, **options))
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("image_id", pa.int64()), ("content", pa.binary())]))

    grouped = frames.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("frame_no", "width", "height", "channels", "pixels"))).alias("frames"))
    return one_pass(grouped, ("image_id", "frames"), run, "image_id long, content binary")


def to_base64(content: Column, fmt: str) -> Column:
    """A data URI."""
    return F.concat(F.lit(f"data:{MIME[fmt]};base64,"), F.base64(content))


def from_base64(uri: str) -> bytes:
    return base64.b64decode(uri.split(",", 1)[1])


class _File(InputPartition):
    def __init__(self, paths):
        self.paths = paths


class _RasterReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.options["path"])
        files = sorted((f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file), key=lambda f: f.path)
        parts, held, size = [], [], 0
        for f in files:  # files of about 32 MB together make a partition
            held.append(f.path)
            size += f.size
            if size >= 32 << 20:
                parts.append(_File(held))
                held, size = [], 0
        return parts + [_File(held)] if held or not parts else parts

    def read(self, partition):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.options["path"])
        most = int(self.options["maxframes"]) if "maxframes" in self.options else None
        target = tuple(map(int, self.options["targetsize"].split("x"))) if "targetsize" in self.options else None
        for path in partition.paths:
            with store.open_input_file(path) as handle:
                data = handle.read()
            try:
                for k, a in enumerate(codecs.decode(data, most, target and _least(data, target))):
                    a = _sized(a, target)
                    yield (path, k, a.shape[1], a.shape[0], a.tobytes(), None)
            except codecs.CodecError as e:
                yield (path, 0, None, None, None, str(e))


class Raster(DataSource):
    """spark.read.format("raster").option("maxFrames", 1).load(directory)"""

    @classmethod
    def name(cls):
        return "raster"

    def schema(self):
        return "path string, frame_no int, width int, height int, pixels binary, error string"

    def reader(self, schema):
        return _RasterReader({k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(Raster)
    return spark.read.format("raster").options(**options).load(path if "://" in path else f"file://{path}")


def save(encoded: DataFrame, path: str, fmt: str) -> DataFrame:
    """Write each content below path; (image_id, file) of what was written. Files are moved to their names when whole."""

    def run(batches):
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        store.create_dir(root)
        for b in batches:
            names = []
            for i, data in zip(b["image_id"].to_pylist(), b["content"].to_pylist(), strict=True):
                temp, name = f"{root}/.{uuid.uuid4().hex}", f"{root}/{i}.{SUFFIXES[fmt]}"
                with store.open_output_stream(temp) as out:
                    out.write(data)
                store.move(temp, name)
                names.append(name)
            yield pa.RecordBatch.from_pydict({"image_id": b["image_id"], "file": names})

    return one_pass(encoded, ("image_id", "content"), run, "image_id long, file string")
