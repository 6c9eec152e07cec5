"""Token-ID output: blocks of ids turned into byte or bit planes, each plane compressed with zstandard.

A file is: MAGIC, the blocks' compressed planes one after another, a footer, the
footer's length (8 bytes, little-endian), MAGIC. The footer is an Arrow stream of
one row with the kind of plane, the block index (where each block begins, its
first id's number, its ids, its planes' lengths, its crc32) and the documents
(doc_id, n_tokens) in the order of their ids. A reader can fetch any block alone.

Documents are dealt out by ranges of doc_id and sorted inside each, so files in
order of their part and roll number hold them in ascending doc_id. A task begins a
new file at FILE_IDS ids or FILE_DOCS documents, so that files, their footers and
what one task reads back are bounded. It writes a file under a name of its attempt
and moves it; only files in the manifest are read.

Defined results: a null text is empty and has the end id alone; rows with equal
doc_id are ordered by text and all kept; a null doc_id comes first; an empty
table gives no file and no row; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, shared_dir, sliced, table
from .store import Upload, opened, read_range, retried
from .tokens import END_ID, encode_all

QUERY = "op7_bitplane_ids"
ORACLE_SQL = None  # token ids need the tokenizer
MAGIC = b"IDPLANE1"
BLOCK_IDS, LEVEL = 1 << 16, 3
#: A file is closed after the document with which it reaches one of these.
FILE_IDS, FILE_DOCS = 1 << 26, 1 << 20
_FOOTER = pa.schema([("planes", pa.string()), ("at", pa.list_(pa.int64())), ("first", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.list_(pa.int64()))), ("crc", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64()))])


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """Planes of a block of unsigned 32-bit ids, lowest first; planes above the highest that is used are left out."""
    by_byte = np.ascontiguousarray(ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)
    if planes == "byte":
        return [p.tobytes() for p in by_byte[: max(1, (int(ids.max(initial=0)).bit_length() + 7) // 8)]]
    bits = [np.packbits((by_byte[b // 8] >> (b % 8)) & 1) for b in range(max(1, int(ids.max(initial=0)).bit_length()))]
    return [b.tobytes() for b in bits]


def from_planes(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    by_byte = np.zeros((4, n), np.uint8)
    for k, p in enumerate(parts):
        if planes == "byte":
            by_byte[k] = np.frombuffer(p, np.uint8)
        else:
            by_byte[k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << np.uint8(k % 8)
    return np.ascontiguousarray(by_byte.T).view("<u4").reshape(-1)


class PlaneFile:
    """Writes one file; add() documents in order, then close()."""

    def __init__(self, uri: str, name: str, planes: str = "byte", block_ids: int = BLOCK_IDS):
        self.up, self.planes, self.block_ids = Upload(uri, name), planes, block_ids
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)
        self.rows: dict[str, list] = {f.name: [] for f in _FOOTER}
        self.waiting, self.n_waiting, self.n_written = [], 0, 0
        self.up.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.rows["doc_id"].append(doc_id)
        self.rows["n_tokens"].append(len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= self.block_ids:
            data = np.frombuffer(b"".join(self.waiting), "<u4")
            whole = len(data) // self.block_ids * self.block_ids
            for k in range(0, whole, self.block_ids):
                self._block(data[k : k + self.block_ids])
            self.waiting, self.n_waiting = [data[whole:].tobytes()], len(data) - whole

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.zstd.compress(p) for p in to_planes(ids, self.planes)]
        for key, value in (("at", self.up.write(b"".join(packed))), ("first", self.n_written), ("ids", len(ids)), ("lengths", [len(p) for p in packed]), ("crc", zlib.crc32(ids))):
            self.rows[key].append(value)
        self.n_written += len(ids)

    def close(self) -> tuple[int, int, int]:
        """(documents, ids, bytes)"""
        if self.n_waiting:
            self._block(np.frombuffer(b"".join(self.waiting), "<u4"))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _FOOTER) as out:
            out.write_table(pa.Table.from_pylist([self.rows | {"planes": self.planes}], _FOOTER))
        footer = zstandard.compress(sink.getvalue().to_pybytes(), LEVEL)
        self.up.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.up.close()
        return len(self.rows["doc_id"]), self.n_written, self.up.at


class PlaneReader:
    """Reads one file: footer first, then any block."""

    def __init__(self, uri: str):
        self.fs, path = opened(uri)
        self.handle = retried(self.fs.open_input_file, path)
        size = self.handle.size()
        tail = retried(read_range, self.handle, size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} isn't a file of id planes")
        n = int.from_bytes(tail[:8], "little")
        raw = zstandard.decompress(retried(read_range, self.handle, size - 16 - n, n))
        self.rows = pa.ipc.open_stream(raw).read_all().to_pylist()[0]

    def block(self, k: int) -> np.ndarray:
        r, zstd = self.rows, zstandard.ZstdDecompressor()
        data, parts = retried(read_range, self.handle, r["at"][k], sum(r["lengths"][k])), []
        for n in r["lengths"][k]:
            parts.append(zstd.decompress(data[:n]))
            data = data[n:]
        ids = from_planes(parts, r["ids"][k], r["planes"])
        if zlib.crc32(ids) != r["crc"][k]:
            raise ValueError(f"block {k} is damaged")
        return ids

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids), block by block."""
        held, k = np.empty(0, "<u4"), 0
        for doc_id, n in zip(self.rows["doc_id"], self.rows["n_tokens"], strict=True):
            parts, got = [held], len(held)
            while got < n:
                parts.append(self.block(k))
                got, k = got + len(parts[-1]), k + 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, held[:n]
            held = held[n:]


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, planes: str = "byte") -> DataFrame:
    """Write all documents' ids below path; returns the manifest, one row for each file, already written."""

    schema = pa.schema([("part", pa.int64()), ("roll", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])

    def write(batches):
        part, roll, out = TaskContext.get().partitionId(), 0, None

        def done():
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (part, roll, f"{path}/{name()}", *out.close()), strict=True))], schema)

        def name():
            return f"part-{part:06d}-{roll:06d}.idp"

        for b in sliced(batches, owner="tokens"):
            for doc_id, ids in zip(b["doc_id"].to_pylist(), encode_all(b["text"].to_pylist(), tokenizer, end_id), strict=True):
                out = out or PlaneFile(path, name(), planes)
                out.add(doc_id, ids)
                if out.n_written + out.n_waiting >= FILE_IDS or len(out.rows["doc_id"]) >= FILE_DOCS:
                    yield done()
                    out, roll = None, roll + 1
        if out:
            yield done()

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ranged.mapInArrow(write, "part long, roll long, file string, n_docs long, n_ids long, n_bytes long"), "ids-manifest")


def read_ids(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; with digest, ids_crc32 stands in place of ids."""

    def read(batches):
        for b in batches:
            for file, start in zip(b["file"].to_pylist(), b["start"].to_pylist(), strict=True):
                rows: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], last: []}
                held = 0
                for doc_id, ids in PlaneReader(file).documents():
                    for key, v in (("doc_id", doc_id), ("start", start), ("n_tokens", len(ids)), (last, zlib.crc32(ids) if digest else ids.astype(np.int64))):
                        rows[key].append(v)
                    start, held = start + len(ids), held + len(ids)
                    if held >= 1 << 20:
                        yield pa.RecordBatch.from_pydict(rows, schema)
                        rows, held = {k: [] for k in rows}, 0
                if held:
                    yield pa.RecordBatch.from_pydict(rows, schema)

    last = "ids_crc32" if digest else "ids"
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (last, pa.int64() if digest else pa.list_(pa.int64()))])
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file", before.alias("start"))  # one row a file: a window over all of them is small
    return files.repartition(max(1, manifest.count())).mapInArrow(read, f"doc_id long, start long, n_tokens long, {last} {'long' if digest else 'array<long>'}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(write_ids(table(spark, sf_dir, "documents"), shared_dir(spark, "ids")), digest=True)
