"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by size (distinct five-word shingles), in classes that
double. The signature of an item is its bottom-k MinHash sketch, its k smallest
shingle hashes. Each partition has its own k and its own threshold, the number of
signature hashes that a document must hold to be a candidate: of an item of n
shingles a document may lack at most d = n - ceil(t * n), so of any k of them it
holds k - d or more. With d of the partition's largest items, k = 2 * d + 2 and
the threshold d + 2 (an item of fewer shingles than that signs with all of them).
So a longer item needs more hits, the search loses nothing (its
recall is 1), and shingles that are common by themselves make no candidates.

A document looks up its shingles in the table of each partition whose smallest
items it is large enough to contain; each candidate is verified by counting the
item's shingles in the document.

The usual form, banded signatures of fixed length with a Jaccard threshold by
partition, was left out: a short item in a long document has a Jaccard similarity
near zero, where bands either miss it or pass everything.

Items are held by every worker if they have at most ITEM_SHINGLES shingles
together; else signatures and shingles are joined by shuffles, with the same rows.

Defined results: words are split at white space, A-Z lower-cased; an item of
fewer than five words is one shingle of all of them and is searched as such; an
item or document without words gives nothing; null texts are empty; repeated
documents or items give a row each; an empty table gives no rows; further
columns are ignored by ``contained`` and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, discard, fresh, hits, marked, materialize, rolled, row_keys, sliced, table, without_rows, word_hashes

QUERY = "op10_minhash_containment"
#: In hundredths, so that the comparison is exact.
CONTAINMENT = 80
ITEM_SHINGLES = 2_000_000
_MASK = (1 << 20) - 1


def partition_of(n: int) -> int:
    """The largest size in the partition of items with n shingles: a power of two."""
    return 1 << (n - 1).bit_length()


def lacking(n: int, percent: int = CONTAINMENT) -> int:
    """Shingles of an item of n that a document which contains it may lack."""
    return n - -(-percent * n // 100)


def signature(n: int, percent: int = CONTAINMENT) -> tuple[int, int]:
    """(hashes in the signature of an item with n shingles, how many of them a candidate holds), by the item's partition."""
    d = lacking(partition_of(n), percent)
    return (2 * d + 2, d + 2) if 2 * d + 2 <= n else (n, n - lacking(n, percent))


def item_sets(items: DataFrame) -> DataFrame:
    """(item_id, words, shingles): words in a shingle, and the distinct hashes, smallest first."""

    def hashed(batches):
        for b in sliced(batches):
            rows = [(i, min(SHINGLE_WORDS, len(w)), np.unique(rolled(w, min(SHINGLE_WORDS, len(w)))).view(np.int64)) for i, w in zip(b["item_id"].to_pylist(), map(word_hashes, b["text"].to_pylist()), strict=True) if len(w)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["item_id", "words", "shingles"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(hashed, "item_id long, words int, shingles array<long>")


class Partition:
    """Signatures of the items of one size class, and their sets."""

    def __init__(self, items: list[tuple[int, np.ndarray]], percent: int):
        self.items, self.percent = items, percent
        self.needs = [signature(len(s), percent)[1] for _, s in items]
        self.least = min(len(s) - lacking(len(s), percent) for _, s in items)
        self.by: dict[int, list[int]] = defaultdict(list)
        for k, (_, s) in enumerate(items):
            for h in s[: signature(len(s), percent)[0]].tolist():
                self.by[h].append(k)
        self.by = dict(self.by)

    def search(self, own: np.ndarray, near: list[int]):
        """(item_id, shared, size) of the items contained in a document: its shingles, and those of them that are in any signature."""
        hits = Counter(k for h in near if h in self.by for k in self.by[h])
        for k in sorted(k for k, n in hits.items() if n >= self.needs[k]):
            item, s = self.items[k]
            at = np.minimum(np.searchsorted(own, s), len(own) - 1)
            shared = int((own[at] == s).sum())
            if 100 * shared >= self.percent * len(s):
                yield item, shared, len(s)


class Index:
    """Partitions of all items, for one kind of shingle."""

    def __init__(self, items: list[tuple[int, np.ndarray]], percent: int):
        by_size: dict[int, list] = defaultdict(list)
        for item in items:
            by_size[partition_of(len(item[1]))].append(item)
        self.partitions = [Partition(by_size[size], percent) for size in sorted(by_size)]
        self.hashes = np.array(sorted(set().union(*(p.by for p in self.partitions))), np.uint64)
        self.maybe = np.zeros(_MASK + 1, bool)
        self.maybe[(self.hashes & np.uint64(_MASK)).astype(np.int64)] = True

    def search(self, shingles: np.ndarray):
        """(item_id, shared, size) of the items contained in a document with these shingles (repeats allowed)."""
        near = shingles[self.maybe[(shingles & np.uint64(_MASK)).astype(np.int64)]]
        met = np.intersect1d(near, self.hashes).tolist() if len(near) else []
        if met:
            own = np.unique(shingles)
            for p in self.partitions:
                if p.least <= len(own):
                    yield from p.search(own, met)


def contained(docs: DataFrame, items: DataFrame, percent: int = CONTAINMENT, item_shingles: int = ITEM_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): all items of whose shingles a document has the given percentage or more."""
    spark = docs.sparkSession
    sets = materialize(item_sets(items), "items")
    total = sets.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0)).alias("n"), F.collect_set("words").alias("words")).first()  # at most five numbers in the set
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if total["n"] > item_shingles:
        return _joined(picked, sets, percent, sorted(total["words"]))
    kinds: dict[int, list] = defaultdict(list)
    for r in sets.collect():  # bounded by item_shingles
        kinds[r["words"]].append((r["item_id"], np.array(r["shingles"], np.int64).view(np.uint64)))
    discard(sets)
    shared = spark.sparkContext.broadcast(dict(kinds))
    fields = ["doc_id", "item_id", "n_shared", "n_item"]

    def search(batches):
        indexes = {n: Index(found, percent) for n, found in shared.value.items()}
        for b in sliced(batches):
            rows = []
            for doc_id, words in zip(b["doc_id"].to_pylist(), map(word_hashes, b["text"].to_pylist()), strict=True):
                for n, index in indexes.items():
                    if len(words) >= n:
                        rows += [(doc_id, *hit) for hit in index.search(rolled(words, n))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], fields)

    return picked.mapInArrow(search, "doc_id long, item_id long, n_shared long, n_item long")


def _joined(docs: DataFrame, sets: DataFrame, percent: int, kinds: list[int]) -> DataFrame:
    """The same rows for items too many to broadcast; rows of equal documents are told apart by a number. Only shingles that may be an item's are shuffled."""
    bits = marked(sets.select(F.explode("shingles").alias("shingle")), hashed=True)

    def hashed(batches):
        for b in sliced(batches):
            cols: list[list] = [[], [], [], []]
            for doc_id, row, words in zip(b["doc_id"].to_pylist(), b["row"].to_pylist(), map(word_hashes, b["text"].to_pylist()), strict=True):
                for n in kinds:
                    if len(words) >= n:
                        h = np.unique(rolled(words, n)).view(np.int64)
                        h = h[hits(h, bits.value)]
                        for c, v in zip(cols, ([doc_id] * len(h), [row] * len(h), [n] * len(h), h.tolist()), strict=True):
                            c += v
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "row", "words", "shingle"])

    rows = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "docs")
    mine = materialize(rows.mapInArrow(hashed, "doc_id long, row long, words int, shingle long"), "doc-shingles")
    discard(rows)
    keyed = materialize(sets.withColumn("item", F.monotonically_increasing_id()), "item-sets")

    @F.udf("struct<k:int,needs:int>")
    def of(n):
        return signature(n, percent)

    # sets are ordered as unsigned numbers already, so the signature is the array's head
    signed = keyed.withColumn("of", of(F.size("shingles")))
    signs = signed.select("item", "words", "of.needs", F.explode(F.slice("shingles", F.lit(1), F.col("of.k"))).alias("shingle"))
    pairs = mine.join(signs, ["words", "shingle"]).groupBy("row", "item").agg(F.count("*").alias("met"), F.first("needs").alias("needs")).filter("met >= needs").select("row", "item")
    shared = pairs.join(keyed.select("item", "item_id", "words", F.size("shingles").alias("n_item"), F.explode("shingles").alias("shingle")), "item").join(mine, ["row", "words", "shingle"])
    return shared.groupBy("row", "item", "doc_id", "item_id", "n_item").agg(F.count("*").alias("n_shared")).filter(100 * F.col("n_shared") >= percent * F.col("n_item")).select("doc_id", "item_id", "n_shared", F.col("n_item").cast("long").alias("n_item"))


def clean(docs: DataFrame, items: DataFrame, percent: int = CONTAINMENT) -> DataFrame:
    """docs without the rows that contain an item, whatever their doc_id; columns as they were."""
    row = fresh(docs, "__row")[0]
    kept = row_keys(docs, row)
    found = materialize(contained(kept.select(F.col(row).alias("doc_id"), "text"), items, percent).select(F.col("doc_id").alias("row")).distinct(), "leaks")
    return without_rows(kept, found, row).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""
ORACLE_SQL = rf"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
k AS (SELECT DISTINCT least(5, len(w)) AS n FROM i WHERE len(w) > 0),
si AS (SELECT DISTINCT item_id, least(5, len(w)) AS n, array_to_string(w[p : p + least(5, len(w)) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
sd AS (SELECT DISTINCT r, doc_id, n, array_to_string(w[p : p + n - 1], ' ') AS s FROM (SELECT r, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, k WHERE len(w) >= n)),
size AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item
FROM sd JOIN si USING (n, s) JOIN size USING (item_id)
GROUP BY r, doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n_item)
"""
