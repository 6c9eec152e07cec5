"""Best-fit packing by patterns: non-negative least squares over short patterns of lengths, then best fit for what is left.

All that the plan needs of the corpus is its histogram of piece lengths, which
has as many bins as a sequence has tokens, at any size of the corpus:

1. Enumerate every pattern of one, two or three lengths that fills a sequence.
2. Fit each pattern's repeat count to the histogram by non-negative least
   squares (accelerated projected gradient), and round down, so that no length
   is used more often than it occurs.
3. Pack the residual histogram, longest first, each length into the fullest
   open sequences that still hold it; equal sequences are handled together.

The plan is a list of runs "pieces of length L with ranks from a to b are at
offset o of sequences s to s + b - a". Pieces get a rank among those of their
length, counted in salted groups so that no length has to fit into one task.

Defined results: a null text is empty and is packed as its end id; only
documents longer than a sequence are cut, the first piece being the shorter;
pieces of one length are ranked by doc_id, piece and their ids' crc, those that are
the same in all of them arbitrarily; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, sliced, table
from .tokens import END_ID, encode_all

QUERY = "op2_nnls_packing"
ORACLE_SQL = None  # token ids need the tokenizer
SEQUENCE = 2048
#: Rounds of the least-squares fit, and pieces of one length that share a salt.
ROUNDS, SALT_ROWS = 300, 1000


def pieces_of(docs: DataFrame, sequence: int = SEQUENCE, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False, lean: bool = False) -> DataFrame:
    """Whole texts as pieces of at most one sequence: (doc_id, piece, start, length, ids_crc32[, ids]). lean: with smaller tables of words, which end with their task."""

    def cut(batches):
        for b in sliced(batches, owner=None if lean else "tokens"):
            rows: dict[str, list] = {f.name: [] for f in schema}
            for doc_id, ids in zip(b["doc_id"].to_pylist(), encode_all(b["text"].to_pylist(), tokenizer, end_id, lean), strict=True):
                n, view = len(ids) // 4, memoryview(ids)
                start = 0
                for piece, length in enumerate([n % sequence] * (n % sequence > 0) + [sequence] * (n // sequence)):
                    part = view[4 * start : 4 * (start + length)]
                    for key, v in (("doc_id", doc_id), ("piece", piece), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(part))):
                        rows[key].append(v)
                    if with_ids:
                        rows["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
                    start += length
            yield pa.RecordBatch.from_pydict(rows, schema)

    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if with_ids else fields)
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, ddl)


def patterns(sequence: int) -> np.ndarray:
    """All ascending (a, b, c) with a + b + c = sequence; leading zeros for patterns of fewer lengths."""
    a, b = np.meshgrid(np.arange(sequence // 3 + 1), np.arange(sequence // 2 + 1), indexing="ij")
    c = sequence - a - b
    ok = (a <= b) & (b <= c)
    return np.stack([a[ok], b[ok], c[ok]], 1)


def fit(hist: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, whole repeat counts); hist[L] pieces have length L, hist[0] is 0. No length is used more than it occurs."""
    pats = patterns(len(hist) - 1)
    there = np.append(True, hist[1:] > 0)
    pats = pats[there[pats].all(1)]  # patterns with a length that doesn't occur can't be used
    goal = hist.astype(float)
    goal[0] = 0

    def use(x):
        got = sum(np.bincount(pats[:, k], x, len(hist)) for k in range(3))
        got[0] = 0
        return got

    def pull(r):
        return sum(np.where(pats[:, k] > 0, r[pats[:, k]], 0) for k in range(3))

    if not len(pats) or not goal.any():
        return pats, np.zeros(len(pats), np.int64)
    v = np.ones(len(pats))
    for _ in range(8):  # the largest eigenvalue, for the step
        v = pull(use(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y + pull(goal - use(y)) / (1.05 * top))
        if np.dot(y - new, new - x) > 0:
            t = 1.0  # the momentum points uphill: begin it anew
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, np.maximum(0, new + (t - 1) / t2 * (new - x)), t2
    left, counts = hist.astype(np.int64), np.zeros(len(pats), np.int64)
    for rounding in (np.floor(x), np.ceil(x - np.floor(x))):  # first the whole repeats, then one more of those that still fit
        for k in np.flatnonzero(rounding)[np.argsort(-x[np.flatnonzero(rounding)], kind="stable")]:
            lengths, times = np.unique(pats[k][pats[k] > 0], return_counts=True)
            n = min(int(rounding[k]), int((left[lengths] // times).min()))
            if n > 0:
                counts[k] += n
                left[lengths] -= n * times
    return pats, counts


def best_fit(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats): longest first, into the fullest open sequences that hold it."""
    n = len(hist) - 1
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room
    done = []
    rooms = np.zeros(n + 1, bool)
    for length in range(n, 0, -1):
        count = int(hist[length])
        while count:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = length + int(fits[0])
                lengths, k = open_[room].pop()
                rooms[room] = bool(open_[room])
                used = min(count, k)
                if used < k:
                    open_[room].append((lengths, k - used))
                    rooms[room] = True
                made, room = ((*lengths, length), used), room - length
            else:
                per = n // length
                used, each = (count // per, per) if count >= per else (1, count)
                made, room = ((length,) * each, used), n - length * each
                used *= each
            count -= used
            if room:
                open_[room].append(made)
                rooms[room] = True
            else:
                done.append(made)
    return done + [x for group in open_.values() for x in group]


def plan(hist: np.ndarray) -> pd.DataFrame:
    """Runs (length, rank, n, sequence_id, step, offset): the pieces of a length from rank on, n of them, each in the next sequence, at offset."""
    pats, counts = fit(hist)
    left = hist.astype(np.int64).copy()
    left[0] = 0
    groups = []
    for k in np.flatnonzero(counts):
        lengths = tuple(int(v) for v in pats[k][::-1] if v)
        groups.append((lengths, int(counts[k])))
        for v in lengths:
            left[v] -= int(counts[k])
    runs, rank, sequence_id = [], np.zeros(len(hist), np.int64), 0
    for lengths, n in groups + best_fit(left):
        offset = 0
        for v in lengths:
            runs.append((v, int(rank[v]), n, sequence_id, offset))
            rank[v] += n
            offset += v
        sequence_id += n
    return pd.DataFrame(runs, columns=["length", "rank", "n", "sequence_id", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def place(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to pieces (which must be stored: they're read twice)."""
    counted = pieces.groupBy("length").count().toPandas()  # at most one row for each length
    hist = np.zeros(sequence + 1, np.int64)
    hist[counted["length"]] = counted["count"]
    runs = plan(hist)
    lengths, firsts, ids, offsets = (runs[c].to_numpy(np.int64) for c in ("length", "rank", "sequence_id", "offset"))
    begins = np.searchsorted(lengths, np.arange(sequence + 2))
    shared = pieces.sparkSession.sparkContext.broadcast((begins, firsts, ids, offsets))  # bounded by the patterns, not by the corpus

    salts = F.element_at(F.lit(np.maximum(1, hist // SALT_ROWS).tolist()), (F.col("length") + 1).cast("int"))  # a number for each length
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts).cast("long"))
    per_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    base = per_salt.select("length", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("local", local).join(base, ["length", "salt"]).withColumn("rank", F.col("local") + F.col("base"))

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        begins, firsts, ids, offsets = shared.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.empty(len(rank), np.int64)
        for v in np.unique(length):
            own = length == v
            at[own] = begins[v] + np.searchsorted(firsts[begins[v] : begins[v + 1]], rank[own], "right") - 1
        return pd.DataFrame({"sequence_id": ids[at] + rank - firsts[at], "offset": offsets[at]})

    placed = ranked.withColumn("slot", slot("length", "rank"))
    return placed.select(*pieces.columns, "slot.sequence_id", "slot.offset")


def pack(docs: DataFrame, sequence: int = SEQUENCE, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False, lean: bool = False) -> DataFrame:
    """The whole operator: pieces of all documents with their places; with_ids adds the ids themselves; lean takes less memory and more time."""
    return place(materialize(pieces_of(docs, sequence, tokenizer, end_id, with_ids, lean), "pieces"), sequence)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
