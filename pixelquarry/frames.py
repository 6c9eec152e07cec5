"""Packed frames: one row a frame. Kernels over whole frames run in one mapInArrow, however many are chained."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import pixel_formats
from .kernels.base import quantized, to_bytes, to_float

DDL = "image_id long, frame_no int, width int, height int, channels int, dtype string, alpha string, pixels binary"
_ARROW = pa.schema([("image_id", pa.int64()), ("frame_no", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("dtype", pa.string()), ("alpha", pa.string()), ("pixels", pa.binary())])
_PIXELS = pa.schema([("image_id", pa.int64()), ("frame_no", pa.int32()), ("y", pa.int32()), ("x", pa.int32()), *((c, pa.int32()) for c in "rgba")])
#: Bytes of an Arrow batch that a step takes at once: kernels hold them as float64, several times.
BATCH_BYTES = 1 << 20
#: Frames that a kernel of many is given together, beyond BATCH_BYTES and up to four times as much: with few it takes longer for each.
TOGETHER = 32
#: Pixels in one Arrow batch that leaves a task.
BATCH_PIXELS = 1 << 16
_FRAME = ("image_id", "frame_no", "width", "height", "pixels")


def one_pass(source: DataFrame, columns: tuple[str, ...], step: Callable, ddl: str) -> DataFrame:
    """These columns through mapInArrow. Where source is such a step itself and isn't cached, both run as one: each has a Python worker for each task otherwise, side by side, and workers stay on the executor."""
    before = source.__dict__.get("_pass")
    if before is None or source.is_cached or not set(columns) <= set(source.columns):
        root, run = source.select(*columns), lambda batches: step(_slices(batches))
    else:
        root, first = before
        run = lambda batches: step(_slices(first(batches)))
    out = root.mapInArrow(run, ddl)
    out._pass = root, run
    return out


def _slices(batches):
    """Batches in parts of about BATCH_BYTES, without a copy."""
    for b in batches:
        parts = max(1, -(-b.nbytes // BATCH_BYTES))
        n = max(1, -(-b.num_rows // parts))
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)


def batch_of(rows) -> pa.RecordBatch:
    """rows: (image_id, frame_no, uint8 array of height x width x 4)"""
    cols = [[r[0] for r in rows], [r[1] for r in rows], [r[2].shape[1] for r in rows], [r[2].shape[0] for r in rows], [r[2].shape[2] for r in rows], ["uint8"] * len(rows), ["unassociated"] * len(rows), [np.ascontiguousarray(r[2]).tobytes() for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def assemble(px: DataFrame) -> DataFrame:
    """Exploded pixels to packed frames. Pixels are packed to one integer and collected in row-major order; a frame has to fit into one row."""
    packed = px.select("image_id", F.col("frame_no").cast("int").alias("frame_no"), "y", "x", F.expr("shiftleft(CAST(a AS INT), 24) | shiftleft(CAST(b AS INT), 16) | shiftleft(CAST(g AS INT), 8) | CAST(r AS INT)").alias("v"))
    rows = packed.groupBy("image_id", "frame_no").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"]).alias("v"))

    def pack(batches):
        for b in batches:
            yield batch_of([(i, f, v.values.to_numpy().astype("<i4").view(np.uint8).reshape(h, w, 4)) for i, f, w, h, v in zip(*(b[c].to_pylist() for c in _FRAME[:4]), b["v"])])

    return one_pass(rows, (*_FRAME[:4], "v"), pack, DDL)


def explode(frames: DataFrame) -> DataFrame:
    """Packed frames to pixels."""

    def run(batches):
        for b in batches:
            for i, f, w, h, p in zip(*(b[c].to_pylist() for c in _FRAME)):
                whole = np.frombuffer(p, np.uint8).reshape(-1, 4)
                for at in range(0, w * h, BATCH_PIXELS):
                    a = whole[at : at + BATCH_PIXELS]
                    n = len(a)
                    yy, xx = np.divmod(np.arange(at, at + n, dtype=np.int32), w)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int64)), pa.array(np.full(n, f, np.int32)), pa.array(yy.astype(np.int32)), pa.array(xx.astype(np.int32)), *(pa.array(a[:, k].astype(np.int32)) for k in range(4))], schema=_PIXELS)

    return one_pass(frames, _FRAME, run, "image_id long, frame_no int, y int, x int, r int, g int, b int, a int")


class Chain:
    """Kernels put one after another; apply() runs them all in one pass over the frames, with bytes between them as each step rounds."""

    def __init__(self, *steps: tuple[Callable, tuple, dict]):
        self.steps = steps

    def then(self, kernel: Callable, *args, **kw) -> Chain:
        return Chain(*self.steps, (kernel, args, kw))

    def apply(self, frames: DataFrame) -> DataFrame:
        steps = self.steps
        together = TOGETHER if any(hasattr(kernel, "many") for kernel, _, _ in steps) else 1

        def done(held):
            """Rows (image_id, frame_no, width, height, pixels), which kernels get together where they take many and the sizes are equal."""
            values = [to_float(p, w, h) for _, _, w, h, p in held]
            for k, (kernel, args, kw) in enumerate(steps):
                values = [quantized(v) for v in values] if k else values
                many = getattr(kernel, "many", None)
                if many is None:
                    values = [kernel(v, *args, **kw) for v in values]
                    continue
                for shape in {v.shape for v in values}:
                    own = [i for i, v in enumerate(values) if v.shape == shape]
                    for i, v in zip(own, many(np.stack([values[i] for i in own]), *args, **kw), strict=True):
                        values[i] = v
            return batch_of([(i, f, to_bytes(v)) for (i, f, *_), v in zip(held, values, strict=True)])

        def run(batches):
            held, size = [], 0
            for b in batches:
                for row in zip(*(b[c].to_pylist() for c in _FRAME), strict=True):
                    held.append(row)
                    size += len(row[4])
                    if size >= (BATCH_BYTES if len(held) >= together else 4 * BATCH_BYTES):
                        yield done(held)
                        held, size = [], 0
            if held:
                yield done(held)

        return one_pass(frames, _FRAME, run, DDL)


def process(frames: DataFrame, kernel: Callable, *args, **kw) -> DataFrame:
    return Chain().then(kernel, *args, **kw).apply(frames)


def process_pixels(px: DataFrame, kernel: Callable, *args, **kw) -> DataFrame:
    """A kernel over exploded pixels."""
    return explode(process(assemble(px), kernel, *args, **kw))


_PACKED = pa.schema([("image_id", pa.int64()), ("frame_no", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("format", pa.string()), ("pixels", pa.binary())])


def clone_as(frames: DataFrame, name: str) -> DataFrame:
    """(image_id, frame_no, width, height, format, pixels): frames in another pixel format; of frames or of what this gives."""
    has_format = "format" in frames.columns

    def run(batches):
        for b in batches:
            held = b["format"].to_pylist() if has_format else ["Rgba32"] * b.num_rows
            pixels = [p if f == name else pixel_formats.convert(p, f, name) for p, f in zip(b["pixels"].to_pylist(), held, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in _PACKED.names[:4]), pa.array([name] * b.num_rows, pa.string()), pa.array(pixels, pa.binary())], schema=_PACKED)

    return one_pass(frames, (*_PACKED.names[:4], *["format"] * has_format, "pixels"), run, "image_id long, frame_no int, width int, height int, format string, pixels binary")
