"""Line dedup by winnowing over line hashes.

A text is a sequence of lines, each hashed without the white space around it. A
window is the shortest run of lines that begins (or ends) at a line and has
RUN_WORDS words or more. From each window the line with the smallest hash (the
first of equal ones) is selected; consecutive windows mostly select the same
line, so a text has far fewer selected positions than windows. They are its
fingerprints: a repeated run of RUN_WORDS words or more contains a whole window,
and equal windows select equal lines, so a run can only be repeated where a
selected line's hash is selected at two positions or more.

1. Selected positions are counted by line hash, partly before the shuffle.
2. Positions whose hash is met again are joined: of a selected line, the windows
   that selected it name its surroundings, and the first position (by doc_id, then
   line) with the same line and surroundings stands for all, so a passage in a
   third of all documents costs one row for each of them. Under the line's hash
   alone the first position need not lie in the run that repeats (a line may stand
   in many passages), and comparing all positions of a line would make all pairs.
3. From each later position the match is extended both ways, line by line, against
   the text of the first one: this gives the run. Lines of later runs are deleted;
   runs that overlap their own earlier copy count as well.

So a line is deleted exactly if it lies in a run of RUN_WORDS words or more
whose copy begins at an earlier position. Blank lines belong to the runs they
lie in and have no words.

Defined results: a null text stays null, an empty one empty; rows of equal
doc_id are ordered by text, and rows that are the same in both are told apart
arbitrarily (their results are alike but for which of them is the first); a null
doc_id comes first; an empty table gives no rows; further columns are kept by
``dedup``, whatever their names. Line ends other than \\n belong to their lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, fresh, hits, marked, materialize, mix, parted, powers, sliced, table

QUERY = "op3_winnow_lines"
ORACLE_SQL = None  # runs of lines are matched by brute force in the tests
RUN_WORDS = 50


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, words) of each line."""
    lines = [x.strip() for x in text.encode("utf-8", "surrogatepass").split(b"\n")]
    return np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64), np.array([len(x.split()) for x in lines], np.int64)


def windows(words: np.ndarray, run_words: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the shortest runs with enough words that begin or end at each line, in order, without repeats."""
    upto = np.append(0, np.cumsum(words))
    n = len(words)
    if upto[-1] < run_words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.arange(n)
    end = np.searchsorted(upto, upto[:n] + run_words, "left")  # the first end that makes it enough
    ok = end <= n
    back = np.searchsorted(upto, upto[1:] - run_words, "right") - 1  # the last start that does
    ok2 = back >= 0
    pairs = np.unique(np.append(start[ok], back[ok2]) * (n + 1) + np.append(end[ok], np.arange(1, n + 1)[ok2]))
    return pairs // (n + 1), pairs % (n + 1)


def selected(hashes: np.ndarray, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each window, the place of its smallest line hash, the first of equal ones; never a blank line."""
    order = np.lexsort((hashes, words == 0))
    rank = np.empty(len(hashes), np.int64)
    rank[order] = np.arange(len(hashes))
    levels, width = [rank], 1  # minima of runs by a sparse table
    while 2 * width <= int((end - start).max(initial=0)):
        levels.append(np.minimum(levels[-1][: len(levels[-1]) - width], levels[-1][width:]))
        width *= 2
    least = np.empty(len(start), np.int64)
    level = np.frexp((end - start).astype(np.float64))[1] - 1
    for v in np.unique(level):
        own = level == v
        least[own] = np.minimum(levels[v][start[own]], levels[v][end[own] - (1 << int(v))])
    return order[least]


def surroundings(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each window's lines in order."""
    up, down = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes) * up[: len(hashes)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def matched(a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int, int]], same: bool, begin: int = 0) -> list[tuple[int, int]]:
    """Runs (start, end, start in b) of a, extended both ways while lines are equal, merged; in one text, of which b begins at ``begin``, only onto earlier lines."""
    out: list[tuple[int, int]] = []
    done: dict[int, int] = {}  # of each shift, the end of the last run: what lies before is known
    for start, end, other in sorted(runs):
        shift = start - other
        if end <= done.get(shift, 0):
            continue
        while start > 0 and start - shift > 0 and a[start - 1] == b[start - 1 - shift]:
            start -= 1
        while end < len(a) and end - shift < len(b) and a[end] == b[end - shift]:
            end += 1
        done[shift] = end
        if same and shift <= begin:
            continue
        out.append((start, end))
    return out


def later_runs(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """(key, start, end): runs of lines to delete, which may overlap. docs: key (struct doc_id, row) and text."""
    key = pa.struct([("doc_id", pa.int64()), ("row", pa.int64())])
    ddl = "key struct<doc_id:long,row:long>"

    def hashed(batches):
        for b in sliced(batches):
            rows = [(k, *lines_of(t)) for k, t in zip(b["key"].to_pylist(), b["text"].to_pylist(), strict=True) if t]
            rows = [r for r in rows if r[2].sum() >= run_words]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], key), pa.array([r[1].view(np.int64) for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["key", "hashes", "words"])

    lines = materialize(docs.mapInArrow(hashed, f"{ddl}, hashes array<long>, words array<long>"), "lines")

    def prints(batches):
        for b in batches:
            found = [np.empty(0, np.uint64)]
            for h, w in _arrays(b, "hashes", "words"):
                h = h.view(np.uint64)
                found.append(h[np.unique(selected(h, w, *windows(w, run_words)))])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["line"])

    again = lines.select("hashes", "words").mapInArrow(prints, "line long").groupBy("line").agg(F.count("*").alias("n")).filter("n > 1").select("line")
    positions = materialize(lines.mapInArrow(_positions(marked(again, hashed=True), run_words, key), f"{ddl}, line long, around long, start long, end long"), "positions")
    # the first position of each line and its surroundings: partial minima before the shuffle, so hot passages shrink to a row a task
    position = F.struct("key", "start")
    first = positions.groupBy("line", "around").agg(F.min(position).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = (
        positions.join(first, ["line", "around"])
        .filter(position > F.col("first"))
        .groupBy("key", F.col("first.key").alias("first_key"))
        .agg(F.collect_list(F.struct("start", "end", F.col("first.start").alias("first_start"))).alias("runs"))  # at most two windows for each line of one text
    )
    later = materialize(later, "matches")
    shifts = F.transform("runs", lambda r: r["first_start"] - r["start"])
    firsts = lines.select(F.col("key").alias("first_key"), F.col("hashes").alias("first_hashes"))
    # of a first text only what can lie beside the later one goes further
    begin = F.greatest(F.array_min(shifts), F.lit(0))
    there = F.slice("first_hashes", (begin + 1).cast("int"), (F.array_max(shifts) + F.size("hashes") - begin).cast("int"))
    pairs = later.join(lines.select("key", "hashes"), "key").join(firsts, "first_key").select("key", "first_key", "hashes", there.alias("first_hashes"), begin.alias("begin"), "runs")

    def extended(batches):
        for b in sliced(batches):
            rows = []
            for k, first, begin, runs, (a, c) in zip(*(b[n].to_pylist() for n in ("key", "first_key", "begin", "runs")), _arrays(b, "hashes", "first_hashes"), strict=True):
                for start, end in matched(a, c, [(r["start"], r["end"], r["first_start"] - begin) for r in runs], k == first, begin):
                    rows.append((k, start, end))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], key), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["key", "start", "end"])

    runs = materialize(pairs.mapInArrow(extended, f"{ddl}, start long, end long"), "runs")
    discard(lines, positions, later)
    return runs


def _arrays(batch: pa.RecordBatch, *names: str):
    """Of each row, its lists in these columns as numpy arrays."""
    lists = [batch[n] for n in names]
    values = [(x.flatten().to_numpy(), x.value_lengths().to_numpy()) for x in lists]
    ends = [np.append(0, np.cumsum(n)) for _, n in values]
    for k in range(batch.num_rows):
        yield tuple(v[e[k] : e[k + 1]] for (v, _), e in zip(values, ends, strict=True))


def _positions(again: Broadcast, run_words: int, key: pa.DataType):
    """Of lines, the selected positions whose line hash may be selected again: (key, line, around, start, end), a row for each window that selected it."""

    def run(batches):
        for b in sliced(batches):
            keys, cols = [], [[np.empty(0, np.int64)] for _ in range(4)]
            for k, (h, w) in enumerate(_arrays(b, "hashes", "words")):
                start, end = windows(w, run_words)
                h = h.view(np.uint64)
                line = h[selected(h, w, start, end)].view(np.int64)
                kept = hits(line, again.value)
                if kept.any():
                    start, end = start[kept], end[kept]
                    keys.append(np.full(len(start), k))
                    for c, v in zip(cols, (line[kept], surroundings(h, start, end).view(np.int64), start, end), strict=True):
                        c.append(v)
            at = pa.array(np.concatenate([np.empty(0, np.int64), *keys]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b["key"].take(at).cast(key), *(pa.array(np.concatenate(c)) for c in cols)], ["key", "line", "around", "start", "end"])

    return run


def dedup(docs: DataFrame, run_words: int = RUN_WORDS, deleted: str | None = None) -> DataFrame:
    """docs with the lines of later repeated runs deleted; with ``deleted``, a column of that name has their number.

    Only texts of which something may be deleted are shuffled, to be joined with their own runs.
    """
    name, found, gone, out = fresh(docs, "__key", "__found", "__runs", "__out")
    # A row number that is the same each time: rows of one doc_id by text. Most doc_ids occur once.
    again_id = fresh(docs, "__again")[0]
    repeated = docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(again_id))
    again = docs.join(repeated, F.col("doc_id").eqNullSafe(F.col(again_id)), "left_semi")
    if again.isEmpty():
        keyed = docs.withColumn(name, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row")))
    else:
        row = F.row_number().over(Window.partitionBy("doc_id").orderBy("text")).cast("long")
        keyed = materialize(docs.withColumn(name, F.struct(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"))), "keyed")
    runs = later_runs(keyed.select(F.col(name).alias("key"), "text"), run_words)
    per = runs.groupBy(F.col("key").alias(found)).agg(F.collect_list(F.struct("start", "end")).alias(gone))

    @F.pandas_udf("text string, deleted long")
    def without(texts, runs):
        import pandas as pd

        out, count = [], []
        for t, r in zip(texts.tolist(), runs.tolist(), strict=True):
            if t is None or r is None or not len(r):
                out.append(t)
                count.append(0)
                continue
            lines = t.split("\n")
            gone = np.zeros(len(lines) + 1, np.int64)
            for x in r:
                gone[x["start"]] += 1
                gone[x["end"]] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            out.append("\n".join(x for x, g in zip(lines, gone) if not g))
            count.append(int(gone.sum()))
        return pd.DataFrame({"text": pd.Series(out, dtype=object), "deleted": count})

    # as nondeterministic it is evaluated once, whatever is filtered afterwards: else it would run in the filter and again above it, with a worker each, side by side in every task
    without = without.asNondeterministic()
    changed, same = parted(keyed, name, runs.select("key"))
    # joined by a shuffle at any size: a broadcast would have parted()'s worker and this one's run, and stay, side by side in each task
    done = changed.join(per.hint("merge"), F.col(name).eqNullSafe(F.col(found)), "left").withColumn(out, without("text", gone))
    cols = [F.col(f"{out}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    number = ([F.col(f"{out}.deleted").alias(deleted)], [F.lit(0).cast("long").alias(deleted)]) if deleted else ([], [])
    return done.select(*cols, *number[0]).unionByName(same.select(*(F.col(f"`{c}`") for c in docs.columns), *number[1]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), deleted="n_deleted")
