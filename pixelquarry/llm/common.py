"""What the operators share: the folder all executors see, and words and shingles of whole texts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
_MULT = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir; a local one only where that is unset and Spark runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pixelquarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path  # for discard()
    return out


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs, stored, with a column of that name of numbers that are distinct and stay the same."""
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def row_keys(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column of that name of numbers that are distinct and stay the same: doc_id where it is whole, never null and distinct; else docs are numbered and stored."""
    whole = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole and docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    return numbered(docs, name)


#: Bits of the bitmaps that marked() makes, in chunks; more ids than that cost passes for nothing, not rows.
MARKS, MARK_CHUNK = 1 << 24, 1 << 20


def marked(ids: DataFrame, hashed: bool = False) -> Broadcast:
    """A bitmap of MARKS bits, set at the hashes (xxhash64) of all rows of ids, or at its numbers if they are hashes themselves; 2 MB at any number of them."""
    names = ["chunk", "bits"]

    def mark(batches):
        bits, used = np.zeros(MARKS, bool), False
        for b in batches:
            used = used or b.num_rows > 0
            bits[b["mark"].to_numpy() & (MARKS - 1)] = True
        for k in range(MARKS // MARK_CHUNK if used else 0):
            part = bits[k * MARK_CHUNK : (k + 1) * MARK_CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(np.packbits(part, bitorder="little").tobytes(), 1)], pa.binary())], names)

    def either(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b["chunk"].to_pylist(), b["bits"].to_pylist(), strict=True):
                bits = np.frombuffer(zlib.decompress(c), np.uint8)
                held[k] = held[k] | bits if k in held else bits
        for k, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names)

    out = np.zeros(MARKS // 8, np.uint8)
    ddl = "chunk int, bits binary"
    mark_of = F.col(ids.columns[0]) if hashed else F.xxhash64(*ids.columns)
    for r in ids.select(mark_of.alias("mark")).mapInArrow(mark, ddl).repartition(MARKS // MARK_CHUNK, "chunk").mapInArrow(either, ddl).collect():  # MARKS bits at most
        out[r["chunk"] * (MARK_CHUNK // 8) : (r["chunk"] + 1) * (MARK_CHUNK // 8)] = np.frombuffer(r["bits"], np.uint8)
    return ids.sparkSession.sparkContext.broadcast(out)


def hits(marks: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = marks & (MARKS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def picked(batches, bits: Broadcast):
    """The rows of record batches whose hash in __mark is in the bitmap, and a few more; without that column."""
    for b in batches:
        yield b.filter(pa.array(hits(b["__mark"].to_numpy(), bits.value))).select([c for c in b.schema.names if c != "__mark"])


def parted(docs: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in ids, rows whose key isn't), by a bitmap of ids, which has one column; docs aren't shuffled."""
    bits, name = marked(ids), fresh(docs, "__hit")[0]

    @F.pandas_udf("boolean")
    def hit(marks):
        import pandas as pd

        return pd.Series(hits(marks.to_numpy(), bits.value))

    asked = docs.withColumn(name, hit(F.xxhash64(key)))
    return asked.filter(F.col(name)).drop(name), asked.filter(~F.col(name)).drop(name)


def without_rows(docs: DataFrame, gone: DataFrame, key: str = "__row") -> DataFrame:
    """docs without the rows whose key is in gone (one column). Only rows that the bitmap of gone picks are shuffled."""
    maybe, kept = parted(docs, key, gone)
    return kept.unionByName(maybe.join(gone.select(F.col(gone.columns[0]).alias(key)), key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns)))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, with so many underscores added that docs has no such column."""
    held, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out


def discard(*dfs: DataFrame) -> None:
    """Delete what materialize() stored for them. Only for tables from which nothing is read any more, all that came of them being stored itself.

    Shuffle files of finished jobs go as well, as soon as the driver's garbage is collected.
    """
    for df in dfs:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    tidy(dfs[0].sparkSession)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of uint64, so that low bits and order are even."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive word hashes, in order."""
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * _MULT + hashes[k : k + len(out)]
    return mix(out + np.uint64(n))


# Hashing the words of a whole text at once: a sum of random numbers by byte, times powers of an odd number by place.
_BY_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
_BY_BYTE[65:91] = _BY_BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, n or more of them."""
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", int(_MULT)), ("down", pow(int(_MULT), -1, 1 << 64))):
            _POWERS[name] = np.cumprod(np.append(np.uint64(1), np.full(size - 1, base, np.uint64)))
    return _POWERS["up"], _POWERS["down"]


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words in order, A-Z lower-cased, split at the six ASCII white-space characters; none for a null text."""
    if not text:
        return np.empty(0, np.uint64)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[b], [True]))))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BY_BYTE[b] * up[: len(b)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; with fewer words, of the whole sequence; none without words."""
    h = word_hashes(text)
    return np.unique(rolled(h, min(n, len(h)))) if len(h) else h


#: By owner, what lets go of the tables that this Python worker keeps from task to task.
KEPT: dict[str, Callable[[], None]] = {}


def trim(owner: str | None = None) -> None:
    """Let go of what other owners keep, and give freed memory back to the machine, where the C library can; workers serve one stage after another."""
    for name, forget in KEPT.items():
        if name != owner:
            forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def sliced(batches, rows: int = 512, owner: str | None = None):
    """Record batches of at most so many rows, so that what is made of one stays small; owner's tables stay."""
    trim(owner)
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    trim(owner)


def tidy(spark: SparkSession) -> None:
    """Let go of shuffle files of finished jobs to which no DataFrame refers any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
