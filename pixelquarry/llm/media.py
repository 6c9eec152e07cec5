"""Media columns: payloads in archive directories, read by a Spark data source that plans byte ranges.

An archive is a file of members, each a header and a body, one after another:
MEMBER (8 bytes), lengths of name and body, crc32 of the body, name, body. The
data source ``member_archive`` knows only sizes of files when it plans, so
planning costs no read of an archive: a partition is a byte range, and a task
handles the members whose header begins in it, finding the first by MEMBER and
the header's own checksum. Bodies go to Arrow in batches of bounded size. Each
member is fetched by its offset, with tries of its own; one that stays damaged
gives a row with a null body and the error, and doesn't stop its neighbours.

``payloads`` turns a text into bytes of a positive multiple of 64, which
``encode_samples`` stores as an 8-bit grey PNG, 64 samples wide.

Defined results: a null text is empty (64 zero bytes); repeated rows and equal
ids are all kept; a null doc_id stays null; an empty table gives no archive and
no row; further columns are ignored. Equal texts give equal media bytes.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import materialize, shared_dir, table
from .store import TRIES, WAIT_S, Upload, opened, read_range

QUERY = "op8_media_archive"
ORACLE_SQL = None  # the stored form and its features aren't SQL's
MEMBER = b"\x89MEMBER\n"
_HEAD = struct.Struct("<8sIQII")  # mark, length of name, length of body, crc32 of body, crc32 of the fields before
SAMPLES = 64
#: Bytes of a planned range and of one Arrow batch; archives are closed beyond ARCHIVE_BYTES.
RANGE_BYTES, BATCH_BYTES, ARCHIVE_BYTES = 32 << 20, 8 << 20, 128 << 20
_PNG = b"\x89PNG\r\n\x1a\n"


def head(name: bytes, body: bytes) -> bytes:
    fields = _HEAD.pack(MEMBER, len(name), len(body), zlib.crc32(body), 0)[:-4]
    return fields + zlib.crc32(fields).to_bytes(4, "little")


def parse_head(data: bytes) -> tuple[int, int, int] | None:
    """(length of name, of body, crc32), or None where no header is."""
    if len(data) < _HEAD.size or not data.startswith(MEMBER):
        return None
    _, name, body, crc, own = _HEAD.unpack_from(data)
    return (name, body, crc) if own == zlib.crc32(data[: _HEAD.size - 4]) else None


def payload(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 with zero bytes up to a positive multiple of 64, bytes without them)"""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % SAMPLES or (0 if raw else SAMPLES)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_samples(data: bytes) -> bytes:
    """An 8-bit grey PNG, 64 samples wide, no filters."""
    rows = len(data) // SAMPLES
    lines = np.zeros((rows, SAMPLES + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(data, np.uint8).reshape(rows, SAMPLES)
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", SAMPLES, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_samples(media: bytes) -> bytes:
    if not media.startswith(_PNG):
        raise ValueError("not a PNG")
    at, data, rows = len(_PNG), [], 0
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a damaged chunk")
        if kind == b"IHDR":
            rows = struct.unpack_from(">I", body, 4)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(rows, SAMPLES + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered line")
    return lines[:, 1:].tobytes()


def features(data: bytes) -> str:
    """Mean, deviation and a 16-bin histogram of the samples, and the mean step between neighbours."""
    a = np.frombuffer(data, np.uint8)
    bins = np.bincount(a >> 4, minlength=16)
    step = np.abs(np.diff(a.astype(np.int16))).mean() if len(a) > 1 else 0.0
    return f"mean={a.mean():.4f};std={a.std():.4f};step={step:.4f};hist={','.join(map(str, bins))}"


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.uri = options["path"]
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self):
        store, path = opened(self.uri)
        files = sorted((f for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.is_file and f.base_name.endswith(".mar") and not f.base_name.startswith(".")), key=lambda f: f.path)
        return [Range(f.path, k, min(f.size, k + self.range_bytes)) for f in files for k in range(0, f.size, self.range_bytes)] or [Range("", 0, 0)]

    def _first(self, handle, start: int, end: int) -> int:
        """Where the first header from start on begins, or end."""
        at, tail = start, b""
        handle.seek(start)
        while at - len(tail) < end:
            data = tail + handle.read(1 << 16)
            base = at - len(tail)
            k = data.find(MEMBER)
            while k >= 0 and base + k < end:
                if len(data) - k < _HEAD.size:
                    data += handle.read(_HEAD.size)
                if parse_head(data[k : k + _HEAD.size]):
                    return base + k
                k = data.find(MEMBER, k + 1)
            if len(data) == len(tail):
                break
            handle.seek(base + len(data))
            at, tail = base + len(data), data[-(len(MEMBER) - 1) :]
        return end

    def _member(self, store, path: str, at: int):
        """(name, body, error, where the next begins); tries of its own for this offset."""
        error, after = "", None
        for k in range(TRIES):
            try:
                with store.open_input_file(path) as handle:
                    found = parse_head(read_range(handle, at, _HEAD.size))
                    if found is None:
                        raise OSError("no header")
                    n, size, crc = found
                    after = at + _HEAD.size + n + size
                    data = read_range(handle, at + _HEAD.size, n + size)
                if zlib.crc32(data[n:]) != crc:
                    raise OSError("the body's checksum differs")
                return data[:n].decode(), data[n:], None, after
            except OSError as e:
                error = str(e)
                time.sleep(WAIT_S * 2**k if k < TRIES - 1 else 0)
        return None, None, error, after

    def read(self, partition):
        if not partition.path:
            return
        store, _ = opened(self.uri)
        rows: list[tuple] = []
        held = 0
        with store.open_input_file(partition.path) as handle:
            at = 0 if partition.start == 0 else self._first(handle, partition.start, partition.end)
            while at < partition.end:
                try:  # the usual way: on with the open file
                    data = read_range(handle, at, _HEAD.size)
                    n, size, crc = parse_head(data) or (0, -1, 0)
                    data = read_range(handle, at + _HEAD.size, n + size) if size >= 0 else b""
                    good = size >= 0 and zlib.crc32(data[n:]) == crc
                except OSError:
                    good = False
                if good:
                    row, after = (data[:n].decode(), at, data[n:], None), at + _HEAD.size + n + size
                else:
                    name, body, error, after = self._member(store, partition.path, at)
                    row = (name, at, body, error)
                rows.append((partition.path, *row))
                held += len(row[2] or b"")
                at = after if after is not None else self._first(handle, at + 1, partition.end)
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["archive", "name", "at", "body", "error"])


class MemberArchive(DataSource):
    """spark.read.format("member_archive").load(directory)"""

    @classmethod
    def name(cls):
        return "member_archive"

    def schema(self):
        return "archive string, name string, at long, body binary, error string"

    def reader(self, schema):
        return ArchiveReader(self.options)


def write_archives(docs: DataFrame, path: str) -> DataFrame:
    """Store every text's samples below path; the manifest (archive, members, bytes) is returned, already written."""

    def write(batches):
        part, no, out, members = TaskContext.get().partitionId(), 0, None, 0
        done: dict[str, list] = {"archive": [], "members": [], "bytes": []}

        def close():
            out.close()
            for key, v in zip(done, (out.final, members, out.at), strict=True):
                done[key].append(v)

        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                out = out or Upload(path, f"part-{part:06d}-{no:04d}.mar")
                data, n = payload(text)
                name, body = f"{'' if doc_id is None else doc_id}/{n}.png".encode(), encode_samples(data)
                out.write(head(name, body) + name + body)
                members += 1
                if out.at >= ARCHIVE_BYTES:
                    close()
                    out, members, no = None, 0, no + 1
        if out:
            close()
        yield pa.RecordBatch.from_pydict(done, pa.schema([("archive", pa.string()), ("members", pa.int64()), ("bytes", pa.int64())]))

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, "archive string, members long, bytes long"), "archive-manifest")


def media_columns(spark: SparkSession, path: str) -> DataFrame:
    """Members of the archives below path with what their samples give."""

    def compute(batches):
        for b in batches:
            rows = []
            for name, body, error in zip(b["name"].to_pylist(), b["body"].to_pylist(), b["error"].to_pylist(), strict=True):
                if body is None:
                    raise OSError(f"member {name}: {error}")
                doc_id, n = name[: -len(".png")].split("/")
                data = decode_samples(body)
                rows.append((int(doc_id) if doc_id else None, int(n), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-SAMPLES:]), len(body), hashlib.sha256(body).hexdigest(), features(data)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    spark.dataSource.register(MemberArchive)
    source = spark.read.format("member_archive").load(path).select("name", "body", "error")
    return source.mapInArrow(compute, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "media")
    write_archives(table(spark, sf_dir, "documents"), path)
    return media_columns(spark, path)
