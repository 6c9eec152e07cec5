"""Quality classifier: supervised subword embeddings.

Every word and its character n-grams (three to five, with the word's bounds) are
hashed into one table of learned vectors; so is how long ago each word was last
said in the document (the binary order of the distance in words, or never), which
tells running text from text that repeats itself, whatever the words. A document is
the mean of the vectors of all of them and of one end mark; a softmax layer gives
the class. Vectors and layer are trained by stochastic gradient descent in numpy, on a sample of at most
TRAIN_ROWS labelled documents outside the held-out fold (those with the smallest
hash of doc_id), as far as they have TRAIN_CHARS characters together. Scores use
whole texts.

The softmax of a trained layer is too sure of itself, and its zero lies anywhere
between the classes. So every FOLDS-th document of the sample isn't trained on,
but its output is used to fit slope and intercept of the score (Platt's scaling,
with his corrected targets).

Scoring a word needs only what its vectors add to the difference of the two
outputs, so a worker remembers one number for each word.

Defined results: a null or empty text is scored by the end mark alone; labels
that are null are left out; repeated rows are scored each; with no label, or one
class only, every document gets that class's share (or 0.5); further columns are
kept by ``reject`` and ignored by the query.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, mix, table, trim

QUERY = "op6_subword_quality"
ORACLE_SQL = None  # a trained model
#: The bounds of the training sample in rows and characters, and the model's size.
TRAIN_ROWS, TRAIN_CHARS, BUCKETS, DIM = 6000, 60_000_000, 1 << 17, 16
NGRAMS = (3, 4, 5)
PASSES, LEAST_STEPS, RATE = 4, 12_000, 0.5
THRESHOLD = 0.3
#: Words that a worker remembers (the table is emptied when full), and texts whose words it holds at once.
CACHED_WORDS, SLICE = 200_000, 128
_P = np.uint64(0x100000001B3)
#: Buckets of the end mark, and of a word's distances; buckets before the hashed ones.
END, NEVER, LAST_SAID, FIXED = 0, 1, 2, 32
#: One document of so many calibrates.
FOLDS = 5


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the word) of each word and each of its n-grams."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    left = ends[owner] - np.arange(len(data))  # bytes from here to the word's end
    h, ids, owners = np.zeros(len(data), np.uint64), [], []
    for n in range(1, min(max(NGRAMS), len(data)) + 1):
        h[: len(data) - n + 1] = h[: len(data) - n + 1] * _P + data[n - 1 :] + np.uint64(1)
        if n in NGRAMS:
            ok = left >= n
            ids.append(h[ok] + (np.uint64(n) << np.uint64(60)))
            owners.append(owner[ok])
    weight = mix((np.arange(len(data)) - starts[owner]).astype(np.uint64) + np.uint64(1))
    whole = np.add.reduceat((data + np.uint64(1)) * weight, starts)
    ids.append(whole)
    owners.append(np.arange(len(words)))
    return (mix(np.concatenate(ids)) % np.uint64(BUCKETS - FIXED)).astype(np.int64) + FIXED, np.concatenate(owners)


def words_in(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def last_said(words: np.ndarray) -> np.ndarray:
    """Of each word of a document (as a number), the bucket of the distance to the same word before it."""
    order = np.argsort(words, kind="stable")
    gap = np.diff(order, prepend=0)
    gap[np.diff(words[order], prepend=-1) != 0] = 0
    out = np.empty(len(words), np.int64)
    out[order] = np.where(gap > 0, np.minimum(LAST_SAID + np.frexp(gap.astype(np.float64))[1] - 1, FIXED - 1), NEVER)
    return out


def _weights(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its buckets and their shares."""
    vocabulary: dict[bytes, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_in(t)], np.int64) for t in texts]
    ids, owner = subwords(list(vocabulary))
    order = np.argsort(owner, kind="stable")
    ids, at = ids[order], np.searchsorted(owner[order], np.arange(len(vocabulary) + 1))
    out = []
    for d in docs:
        words, times = np.unique(d, return_counts=True)
        n = at[words + 1] - at[words]
        own = np.repeat(at[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        f, where = np.unique(np.concatenate([ids[own], last_said(d), [END]]), return_inverse=True)
        weight = np.bincount(where, np.concatenate([np.repeat(times, n), np.ones(len(d) + 1)]))
        out.append((f.astype(np.int32), (weight / weight.sum()).astype(np.float32)))
    return out


def platt(z: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the log-odds of label 1 by Newton's method; (1, 0) where there aren't both labels."""
    ones = int(labels.sum())
    if not 0 < ones < len(labels):
        return 1.0, 0.0
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x, w = np.stack([z, np.ones(len(z))], 1), np.array([1.0, np.log((ones + 1) / (len(labels) - ones + 1))])
    loss = lambda w: float(np.sum(np.logaddexp(0, x @ w) - target * (x @ w)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (p - target))
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-10:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


class Model:
    """Fitted on texts and 0/1 labels; what scoring needs of it is one number for each bucket, the scaling, and the prior where nothing can be learned."""

    def __init__(self, texts: list[str | None], labels: list[int], seed: int = 1):
        self.prior = float(np.mean(labels)) if len(labels) else 0.5
        self.gain, self.scale = None, (1.0, 0.0)
        of, aside = np.array(labels), np.arange(len(labels)) % FOLDS == FOLDS - 1
        if len(set(of[~aside].tolist())) > 1:
            self.gain = self._fit([t for t, x in zip(texts, aside, strict=True) if not x], of[~aside], np.random.default_rng(seed))
            self.scale = platt(Scorer(self.gain, self.scale, self.prior).outputs([t for t, x in zip(texts, aside, strict=True) if x]), of[aside])

    @staticmethod
    def _fit(texts, labels, random) -> np.ndarray:
        features = [x for k in range(0, len(texts), SLICE) for x in _weights(texts[k : k + SLICE])]
        vectors = random.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        layer = np.zeros((DIM, 2), np.float32)
        passes = max(PASSES, -(-LEAST_STEPS // len(features)))
        done, steps = 0, passes * len(features)
        for _ in range(passes):
            for i in random.permutation(len(features)):
                rate = RATE * (1 - done / steps)
                done += 1
                f, w = features[i]
                mean = w @ vectors[f]
                z = mean @ layer
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = layer @ p
                layer -= rate * np.outer(mean, p)
                vectors[f] -= (rate * w)[:, None] * back
        return vectors @ (layer[:, 1] - layer[:, 0])


class Scorer:
    def __init__(self, gain: np.ndarray | None, scale: tuple[float, float], prior: float):
        self.gain, self.scale, self.prior = gain, scale, prior
        self.clear()

    def clear(self):
        self.number: dict[bytes, int] = {}
        self.total, self.n = np.empty(0), np.empty(0)

    def scores(self, texts) -> np.ndarray:
        if self.gain is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.outputs(texts) + self.scale[1], -500, 500)))

    def outputs(self, texts) -> np.ndarray:
        """Differences of the layer's two outputs."""
        return np.concatenate([np.empty(0), *(self._outputs(texts[k : k + SLICE]) for k in range(0, len(texts), SLICE))])

    def _outputs(self, texts) -> np.ndarray:
        docs = [words_in(t) for t in texts]
        new = list(set().union(*docs).difference(self.number))
        if len(self.number) + len(new) > CACHED_WORDS:
            self.clear()
            new = list(set().union(*docs))
        if new:
            ids, owner = subwords(new)
            first = len(self.number)
            if first + len(new) > len(self.total):  # room for twice as many
                self.total, self.n = (np.append(a, np.zeros(first + 2 * len(new))) for a in (self.total, self.n))
            self.total[first : first + len(new)] = np.bincount(owner, self.gain[ids], len(new))
            self.n[first : first + len(new)] = np.bincount(owner, minlength=len(new))
            self.number.update(zip(new, range(first, first + len(new))))
        z = np.empty(len(docs))
        for i, d in enumerate(docs):
            k = np.fromiter(map(self.number.__getitem__, d), np.int64, len(d))
            z[i] = (self.total[k].sum() + self.gain[last_said(k)].sum() + self.gain[END]) / (self.n[k].sum() + len(k) + 1)
        return z


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Train on at most so many labelled documents, and characters of them, outside the held-out fold."""
    sample = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(rows)
    )  # bounded, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    sizes = texts.select("doc_id", "n").join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label", "n").limit(rows).toPandas()
    sizes = sizes[sizes["n"].cumsum() <= chars]
    if sizes.empty:
        return Model([], [])
    # as an Arrow table: pandas rows would go through an RDD, whose Python workers are a set of their own that stays on the executors
    chosen = pa.Table.from_pandas(sizes[["doc_id", "n", "label"]].drop_duplicates(), pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("label", pa.int32())]), preserve_index=False)
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long, n int, label int")
    found = texts.join(F.broadcast(chosen), ["doc_id", "n"]).orderBy(F.xxhash64("doc_id"), "doc_id", "label", "text").limit(len(sizes)).toPandas()
    model = Model(found["text"].tolist(), found["label"].tolist())
    del found, sizes
    trim()  # the driver goes on to other stages
    return model


def scored(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """docs with one more column, the likelihood of label 1; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((model.gain, model.scale, model.prior))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trim()
        scorer = Scorer(*shared.value)
        for texts in batches:
            yield pd.Series(scorer.scores(texts.tolist()))
        del scorer
        trim()

    return docs.withColumn(out, score("text"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score below the threshold; columns as they were."""
    name = fresh(docs, "__score")[0]
    return scored(docs, fit(docs, labels), name).filter(F.col(name) >= threshold).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
