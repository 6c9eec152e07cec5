"""N-gram Jaccard join by filters under several global orders of the tokens.

A document is the set of its distinct five-word shingles (tokens). Documents of
equal sets are one class, and only classes are joined. Two sets with a Jaccard
similarity of t or more share a token among the first n - ceil(t * n) + 1 tokens
of each, under any order of all tokens, and SHARED tokens (or all that they must
share, if those are fewer) among the first n - ceil(t * n) + SHARED. Three orders are used, each rare tokens
first (frequencies come from a counting sketch of fixed size, filled from all
documents; ties fall by a hash of that order's own). A pair is a candidate only
if it meets, in one plan and before any pair is stored, all of these:

* SHARED common tokens in the prefixes under the first order, at places that
  leave enough tokens to share, the sizes allowing the similarity (one common token
  is enough where some of them may be in crowded groups, see below);
* a common token in the prefixes under the second order, and under the third;
* bitmaps (each token flips one of BITS bits) that differ in no more bits than
  two such sets can differ in tokens.

None of these filters loses a link. What passes is counted exactly.

What is asked for is every document's component. In the order of sizes, the sets
that a set may be similar to stand beside it. In a group that shares a prefix
token, where no set has more than FEW such partners before it, they are all met.
Other groups are crowded, and there not all pairs are made: each set meets the
group's pivot; of the pivots that it meets most often the nearest by bitmap is
counted, and what is linked is contracted. Then only sets outside of a group's
largest component meet the others: by further pivots while there are many, and
all of them in the end. No link between different components can be missed that
way, and copies or near copies in thousands cost a row each.

Rows of a frequent token are dealt to several tasks by a salt, whose number
follows the token's frequency; each salt has its own pivot.

Defined results: words are split at white space, A-Z lower-cased; with fewer
than five words, all of them are one token; a null text or one without words has
no token and is its own component (of its doc_id); repeated rows get the same
component; a null doc_id takes part and never gives a component its name, unless
it has no other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, fresh, marked, materialize, mix, picked, row_keys, shingle_set, sliced, table, tidy, without_rows
from .components import components

QUERY = "op5_multi_order_jaccard"
#: Similarity in hundredths, so that the comparison is exact.
PERCENT = 80
#: Common tokens under the first order.
SHARED = 3
#: Cells of the frequency sketch, in chunks.
CELLS, CHUNK = 1 << 21, 1 << 15
#: Orders beside the first, by their hashes' salts.
ORDERS = (np.uint64(0xA5A5A5A5), np.uint64(0x5EED5EED))
#: Bits of a set's bitmap.
BITS = 1024
#: A token met about 2^HOT times or more is salted, if that is well above what other tokens add to its cell.
HOT = 12
#: Partners before a set that are met one by one; pivots of a set whose bitmaps are compared; pivots of a group that those outside of its largest component meet in a round.
FEW, PIVOTS, SPREAD = 8, 6, 16
#: Bytes of a set's name (of the digest's 16) by which it is joined, where no two sets share them; else all 16.
SHORT = 8
#: Sets whose copies one task leaves out.
SEEN = 200_000
#: While more pairs than this for each row of the index are left, pivots go on, as long as each round leaves at most this share of them.
PAIRS_A_ROW, PIVOTS_LEAVE = 0.5, 0.9


def prefix_length(n, percent: int = PERCENT):
    return n - (-(-percent * n // 100)) + 1


def rarest_first(tokens: np.ndarray, rank: np.ndarray, salt: np.uint64 = np.uint64(0)) -> np.ndarray:
    """The tokens in the order of that salt: by frequency class, then by hash."""
    return tokens[np.lexsort((mix(tokens ^ salt), rank))]


def frequency_class(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return sketch[(tokens & np.uint64(CELLS - 1)).astype(np.int64)]


def digest(tokens: np.ndarray) -> bytes:
    """128-bit name of a set; empty only for the empty one."""
    return xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else b""


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A set's bits: which of BITS buckets hold an odd number of tokens, as 64-bit numbers. Two sets differ in at least as many tokens as bits."""
    odd = np.bincount((mix(tokens ^ np.uint64(0xB17)) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(batch):
    for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
        yield doc_id, shingle_set(text)


def _pass_one(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: of each document (doc_id, n, cid); of each task's sketch, chunk by chunk, the counts (chunk, counts)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cid", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        import zlib

        sketch = np.zeros(CELLS, np.uint32)
        used = False
        for b in sliced(batches):
            rows = []
            for doc_id, s in _sets(b):
                rows.append((doc_id, len(s), digest(s)))
                np.add.at(sketch, (s & np.uint64(CELLS - 1)).astype(np.int64), 1)
            used = used or bool(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], schema=schema)
        if used:
            full = [(k, zlib.compress(sketch[k * CHUNK : (k + 1) * CHUNK].astype("<i8").tobytes(), 1)) for k in range(CELLS // CHUNK)]
            none = pa.nulls(len(full), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(full), pa.binary()), pa.array([k for k, _ in full], pa.int32()), pa.array([c for _, c in full], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n long, cid binary, chunk int, counts binary")


def _sketch(found: DataFrame) -> np.ndarray:
    """Frequency classes (the counts' binary orders) of all cells, added up by chunk, in two steps so that no task gets the sketches of all."""

    def add(batches):
        import zlib

        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b["chunk"].to_pylist(), b["counts"].to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(c), "<i8")
                held[k] = held[k] + counts if k in held else counts
        for k, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], ["chunk", "counts"])

    parts = found.filter("chunk IS NOT NULL").select("chunk", "counts", F.pmod(F.spark_partition_id(), F.lit(64)).alias("group"))
    some = parts.repartition("chunk", "group").select("chunk", "counts").mapInArrow(add, "chunk int, counts binary")
    rows = some.repartition("chunk").mapInArrow(add, "chunk int, counts binary").toLocalIterator()  # CELLS numbers
    out = np.zeros(CELLS, np.uint8)
    import zlib

    for r in rows:
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.ceil(np.log2(np.frombuffer(zlib.decompress(r["counts"]), "<i8") + 1)).astype(np.uint8)
    return out


def _index(docs: DataFrame, shared, percent: int, width: int) -> DataFrame:
    """(key, token, cid, at): the prefix of every set under the first order; at is the set's size and the token's place in it.

    key deals the rows out: the token's own number, or one of several for a frequent token, whose number then stands in token.
    """

    def run(batches):
        seen: set[bytes] = set()
        hot = max(HOT, int(np.median(shared.value)) + 3)
        for b in sliced(batches):
            keys, tokens, cids, at = [], [], [], []
            for _, s in _sets(b):
                name = digest(s)[:width]
                if not name or name in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                p = min(len(s), prefix_length(len(s), percent) + SHARED - 1)
                prefix = rarest_first(s, frequency_class(s, shared.value))[:p]
                parts = np.left_shift(np.uint64(1), np.maximum(frequency_class(prefix, shared.value).astype(np.int64) - hot, 0).astype(np.uint64))
                salt = np.uint64(int.from_bytes(name[:4], "little")) % parts
                keys.append(np.where(parts > 1, mix(prefix + (salt + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), prefix))
                tokens.append(np.where(parts > 1, prefix, np.uint64(0)))
                cids += [name] * p
                at.append((np.int64(len(s)) << 32) + np.arange(p))
            if keys:
                token = np.concatenate(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(token.view(np.int64), mask=token == 0), pa.array(cids, pa.binary()), pa.array(np.concatenate(at))], ["key", "token", "cid", "at"])

    return docs.mapInArrow(run, "key long, token long, cid binary, at long")


def _size(at) -> Column:
    return F.shiftright(at, 32)


def _place(at) -> Column:
    return F.col(at).bitwiseAND(0xFFFFFFFF) if isinstance(at, str) else at.bitwiseAND(0xFFFFFFFF)


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _near(a: Column, b: Column, percent: int) -> Column:
    """Whether two sets can be similar that share, as one of their first SHARED common tokens, the ones at these places."""
    n_a, n_b = _size(a), _size(b)
    most = F.least(n_a - _place(a), n_b - _place(b)) + (SHARED - 1)
    return _sizes_allow(n_a, n_b, percent) & ((100 + percent) * most >= percent * (n_a + n_b))


def _late(at, percent: int) -> Column:
    """Whether the token stands too late in its set for sets as large or larger to be similar: a pivot of little use."""
    return (100 + percent) * (_size(at) - _place(at) + (SHARED - 1)) < 2 * percent * _size(at)


def _groups(rows: DataFrame, percent: int) -> DataFrame:
    """(token, cid, at, partners, pivot) of sets that may be similar to another one of their group: partners are the smaller sets that it may be similar to; in crowded groups there are none, but a pivot (cid, at)."""
    one_each = rows.repartition("key").groupBy("key", "cid").agg(F.first("token").alias("token"), F.first("at").alias("at"))
    group, by_size = Window.partitionBy("key"), Window.partitionBy("key").orderBy("at", "cid")
    seen = one_each.withColumn("size", F.count("*").over(group)).filter("size > 1 OR token IS NOT NULL")
    before, beyond = F.collect_list(F.struct("cid", "at")).over(by_size.rowsBetween(-FEW, -1)), F.lag("at", FEW + 1).over(by_size)
    crowded = F.col("token").isNotNull() | (beyond.isNotNull() & _sizes_allow(_size("at"), _size(beyond), percent))
    pivot = F.min(F.struct(_late("at", percent).alias("late"), F.xxhash64("cid").alias("prio"), "cid", "at")).over(group)
    seen = seen.withColumns({"before": before, "crowded": crowded}).withColumns({"crowded": F.max("crowded").over(group), "pivot": pivot})
    partners = F.transform(F.filter("before", lambda x: _near(F.col("at"), x["at"], percent)), lambda x: x["cid"])
    seen = seen.withColumns({"partners": F.when(~F.col("crowded"), partners), "pivot": F.when(F.col("crowded"), F.struct("pivot.cid", "pivot.at"))})
    return seen.filter("crowded OR size(partners) > 0").select(F.coalesce("token", "key").alias("token"), "cid", "at", "partners", "pivot")


def _texts_to_sets(docs: DataFrame, ids: DataFrame, shared, percent: int, width: int) -> DataFrame:
    """(cid, n, bits, p0, p1..., tokens) of the documents picked by ids (and of a few more): bitmaps, 32-bit prefixes under the other orders, sets."""
    bits = marked(ids.select("doc_id"))
    extra = [f"p{k}" for k in range(len(ORDERS))]

    def run(batches):
        for b in sliced(picked(batches, bits)):
            rows = []
            for _, s in _sets(b):
                if len(s):
                    p, f = prefix_length(len(s), percent), frequency_class(s, shared.value)
                    rows.append((digest(s)[:width], len(s), bitmap(s), *((rarest_first(s, f, o)[:p] >> np.uint64(32)).astype(np.uint32).view(np.int32) for o in ORDERS), s.view(np.int64)))
            if rows:
                cols = list(zip(*rows))
                types = [pa.binary(), pa.int64(), pa.list_(pa.int64()), *(pa.list_(pa.int32()) for _ in extra), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["cid", "n", "bits", *extra, "tokens"])

    return docs.withColumn("__mark", F.xxhash64("doc_id")).mapInArrow(run, "cid binary, n long, bits array<long>" + "".join(f", {c} array<int>" for c in extra) + ", tokens array<long>")


def _side(sets: DataFrame, side: str, columns: list[str]) -> DataFrame:
    return sets.select(F.col("cid").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns))


def _apart() -> Column:
    """The bits in which a_bits and b_bits differ."""
    return F.aggregate(F.zip_with("a_bits", "b_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _bits_allow(apart: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """|A| + |B| - 2 * shared >= apart, and (100 + percent) * shared >= percent * (|A| + |B|)"""
    return (100 + percent) * apart <= (100 - percent) * (n_a + n_b)


def _by_bits(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose bitmaps allow the similarity: (a, b, apart), apart being the bits in which they differ."""
    met = pairs.join(_side(sets, "a", ["n", "bits"]), "a").join(_side(sets, "b", ["n", "bits"]), "b")
    return met.withColumn("apart", _apart()).filter(_bits_allow(F.col("apart"), F.col("a_n"), F.col("b_n"), percent)).select("a", "b", "apart")


def _by_orders(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those that share a token in the prefixes under each of the other orders."""
    columns = [f"p{k}" for k in range(len(ORDERS))]
    met = pairs.join(_side(sets, "a", columns), "a").join(_side(sets, "b", columns), "b")
    for c in columns:
        met = met.filter(F.arrays_overlap(f"a_{c}", f"b_{c}"))
    return met.select(*pairs.columns)


def _candidates(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass all filters: (a, b, apart)."""
    return _by_orders(_by_bits(pairs, sets, percent), sets)


def _verified(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of near whose sets are similar, counted exactly; stored."""
    near = materialize(near.select("a", "b").distinct(), "near")
    tidy(near.sparkSession)
    bits = marked(near.select("a").union(near.select("b")))

    def needed(batches):
        for b in picked(batches, bits):
            if b.num_rows:
                yield b

    some = sets.select("cid", "n", "tokens", F.xxhash64("cid").alias("__mark")).mapInArrow(needed, "cid binary, n long, tokens array<long>")
    whole = near.join(_side(some, "a", ["n", "tokens"]), "a").join(_side(some, "b", ["n", "tokens"]), "b")
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    links = materialize(whole.filter(100 * both >= percent * (F.col("a_n") + F.col("b_n") - both)).select("a", "b").distinct(), "links")
    del whole, both
    discard(near)
    return links


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of each a, the pair that differs in the fewest bits."""
    return pairs.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("m")).select("a", F.col("m.b").alias("b"))


def _most_met(pairs: DataFrame) -> DataFrame:
    """Of each a, the PIVOTS most frequent b, as distinct pairs."""
    times = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    most = times.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "b")), False), 1, PIVOTS).alias("m"))  # one for each token of a prefix at most
    return most.select("a", F.explode("m.b").alias("b"))


def classes_and_links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents, labels): (doc_id, n, cid) of every document, and (node, label) of the classes with links to others."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialize(_pass_one(docs), "sets")
    documents = found.filter("chunk IS NULL").select("doc_id", "n", "cid")
    shared = spark.sparkContext.broadcast(_sketch(found))
    short = F.substring("cid", 1, SHORT)
    shared_names = documents.filter("n > 0").select("cid").distinct().groupBy(short.alias("cid")).count().filter("count > 1")
    width = SHORT if shared_names.isEmpty() else 16
    documents = documents.withColumn("cid", F.substring("cid", 1, width))
    names = documents.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("doc_id"))

    index = materialize(_groups(_index(docs, shared, percent, width), percent), "index")
    tidy(spark)
    crowd = index.filter("pivot IS NOT NULL").select("token", "cid", "at", "pivot")
    crowded = materialize(crowd.select("cid").distinct(), "crowded")
    # with fewer tokens in common than SHARED, what they must share being more, the rest would have to be in crowded groups
    met = index.filter("pivot IS NULL").select("cid", _size("at").alias("n"), F.explode("partners").alias("partner"))
    met = met.groupBy(F.greatest("cid", "partner").alias("a"), F.least("cid", "partner").alias("b")).agg(F.count("*").alias("k"), F.max("n").alias("n"))
    must = F.ceil(F.lit(percent) * F.col("n") / 100)  # of the larger set's tokens
    short = met.filter(F.col("k") < F.least(F.lit(SHARED), must)).join(crowded.select(F.col("cid").alias("a")), "a", "left_semi")
    pairs = materialize(met.filter(F.col("k") >= F.least(F.lit(SHARED), must)).unionByName(short).select("a", "b"), "pairs")
    tidy(spark)
    members = crowded.union(pairs.select("a")).union(pairs.select("b")).distinct()
    sets = materialize(_texts_to_sets(docs, members.join(names, "cid"), shared, percent, width), "tokens")
    few = materialize(sets.drop("tokens").join(crowded, "cid", "left_semi"), "crowd-sets")

    near = materialize(_candidates(pairs, sets, percent), "near-pairs")
    discard(pairs)
    stars = crowd.filter(_near(F.col("at"), F.col("pivot.at"), percent) & (F.col("cid") != F.col("pivot.cid"))).select(F.col("cid").alias("a"), F.col("pivot.cid").alias("b"))
    starred = _by_orders(_by_bits(_most_met(stars), few, percent), few)
    links = _verified(_nearest(near.unionByName(starred)), sets, percent)
    n_crowd, seed, before = crowd.count(), 0, float("inf")
    labels = materialize(components(links, "a", "b"), "labels")
    while True:
        tagged = crowd.select("token", "cid", "at").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        per = tagged.groupBy("token", "label").agg(F.count("*").alias("k")).groupBy("token").agg(F.sum("k").alias("k"), F.max(F.struct("k", "label")).alias("m"))
        mixed = per.filter("k > m.k").select("token", F.col("m.label").alias("major"), (F.col("k") * (F.col("k") - F.col("m.k"))).cast("double").alias("pairs"))
        rest = materialize(tagged.join(mixed, "token"), "rest")
        left = rest.groupBy("token").agg(F.first("pairs").alias("pairs")).agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0]
        seed += 1
        many = left > PAIRS_A_ROW * n_crowd + 10_000 and left <= PIVOTS_LEAVE * before
        before = left
        minor = rest.filter("label <> major").select("token", F.col("cid").alias("a"), F.col("at").alias("at_a"), F.col("label").alias("label_a"))
        if many:
            random = F.struct(_late("at", percent).alias("late"), F.xxhash64("cid", "token", F.lit(seed)).alias("prio"), F.col("cid").alias("b"), F.col("at").alias("at_b"))
            some = rest.filter("label = major").groupBy(F.col("token").alias("token_b"), F.pmod(F.xxhash64("cid", F.lit(seed)), F.lit(SPREAD)).alias("part")).agg(F.min(random).alias("p")).select("token_b", "p.b", "p.at_b")
            met = minor.join(some, (F.col("token") == F.col("token_b")) & _near(F.col("at_a"), F.col("at_b"), percent)).select("a", "b").distinct()
            new = _by_orders(_nearest(_by_bits(met, few, percent)), few)
        else:
            # here groups are met as a whole, so the bitmaps go along and are a condition of the join
            bits = few.select(F.col("cid").alias("b"), F.col("bits").alias("b_bits"))
            minor = minor.join(bits.withColumnsRenamed({"b": "a", "b_bits": "a_bits"}), "a")
            other = rest.select(F.col("token").alias("token_b"), F.col("cid").alias("b"), F.col("at").alias("at_b"), F.col("label").alias("label_b"), (F.col("label") == F.col("major")).alias("of_major")).join(bits, "b")
            once = F.col("of_major") | (F.col("a") < F.col("b"))
            alike = _near(F.col("at_a"), F.col("at_b"), percent) & _bits_allow(_apart(), _size("at_a"), _size("at_b"), percent)
            met = minor.join(other, (F.col("token") == F.col("token_b")) & (F.col("label_a") != F.col("label_b")) & once & alike)
            new = _by_orders(met.select("a", "b").distinct(), few)
        if seed == 1:  # pairs of other groups that aren't in one component yet
            new = new.unionByName(_labelled(near, labels).filter("label_a <> label_b").select("a", "b"))
        labels = materialize(_relabelled(labels, _verified(new, sets, percent)), "labels")
        discard(rest)
        if not many:
            discard(index, sets, near, few, crowded)
            return documents, labels


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) with label_a and label_b; a class without a label is its own."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    found = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    return found.withColumns({f"label_{c}": F.coalesce(f"label_{c}", c) for c in "ab"})


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels of the components with these links as well: those of the graph of labels, which has only the new links between different ones."""
    ends = materialize(_labelled(links, labels), "ends")
    moves = components(ends, "label_a", "label_b").select(F.col("node").alias("label"), F.col("label").alias("to"))
    nodes = labels.unionByName(ends.select(F.col("a").alias("node"), F.col("label_a").alias("label"))).unionByName(ends.select(F.col("b").alias("node"), F.col("label_b").alias("label"))).distinct()
    return nodes.join(moves, "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def component_of(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    documents, labels = classes_and_links(docs, percent)
    classes = documents.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least")).join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    names = classes.join(least, "label").select("cid", "component_id")
    full = documents.filter("n > 0").join(names, "cid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(documents.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, that with the least doc_id, one without doc_id only where none has any; rows without words all stay. Columns as they were."""
    row = fresh(docs, "__row")[0]
    kept = row_keys(docs, row)  # rows are told apart by a key, as doc_ids may repeat or be null
    parts = materialize(component_of(kept.select(F.col(row).alias("doc_id"), "text"), percent).filter("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id"), "parts")
    ids = kept.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    first = parts.join(ids, "row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    gone = materialize(parts.select("row").join(first.select("first.row"), "row", "left_anti"), "gone")
    return without_rows(kept, gone, row).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_of(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s AS a JOIN s AS b USING (s) JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))
), reach AS (
  SELECT a AS node, b AS other FROM link UNION SELECT r.node, l.b FROM reach AS r JOIN link AS l ON r.other = l.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT node, min(other) AS least FROM reach GROUP BY node) AS m ON m.node = d.doc_id
"""
