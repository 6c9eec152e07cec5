"""Held-out accuracy of the registered query, calibration, and the bounds of the training sample."""

import zlib

import numpy as np
import pytest
from pixelquarry.llm import quality
from pyspark.sql import functions as F


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def corpus(n=700, seed=0):
    r = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = ["".join(r.choice(letters, r.integers(2, 9))) for _ in range(3000)]
    running = lambda k: " ".join(r.choice(words, k))
    rows = []
    for i in range(n):
        kind, k = i % 4, int(r.integers(20, 200))
        if kind < 2:
            text = running(k)
        elif kind == 2:  # new words that repeat
            text = " ".join(w for _ in range(3) for w in ["".join(r.choice(letters, 6))] * (k // 3))
        else:
            text = " ".join(w + "!$%"[r.integers(0, 3)] * 3 for w in r.choice(words, k))
        rows.append((i, text, int(kind < 2)))
    return rows


def auc(scores, labels):
    rank = np.argsort(np.argsort(scores, kind="stable"))
    ones = labels.sum()
    return (rank[labels == 1].mean() - (ones - 1) / 2) / (len(labels) - ones)


def test_registered_query_on_held_out_documents(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(i, t) for i, t, _ in rows] + [(10_000, None), (10_001, "")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 1 - q) for i, _, q in rows], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    got = quality.query(spark, f"file://{tmp_path}").toPandas().set_index("doc_id")
    assert len(got) == len(rows) + 2 and list(got.columns) == ["held_out", "score", "predicted"]
    assert all(got.held_out[i] == held(i) for i in got.index)
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.3)).all()
    test = [(i, q) for i, _, q in rows if held(i)]
    scores, labels = got.score[[i for i, _ in test]].to_numpy(), np.array([q for _, q in test])
    assert auc(scores, labels) > 0.98 and ((scores >= 0.3) == labels).mean() > 0.95
    # labels of held-out rows aren't learned from: turned round, they change nothing
    spark.createDataFrame([(i, 1 - q if held(i) else q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"file://{tmp_path}/labels.parquet")
    again = quality.query(spark, f"file://{tmp_path}").toPandas().set_index("doc_id")
    assert (again.score[got.index] == got.score).all()


def test_calibration_recovers_odds():
    r = np.random.default_rng(2)
    z = r.normal(0, 4, 20_000)
    y = (r.random(20_000) < 1 / (1 + np.exp(-(0.4 * z + 1)))).astype(int)
    slope, intercept = quality.platt(z, y)
    assert slope == pytest.approx(0.4, abs=0.05) and intercept == pytest.approx(1, abs=0.1)
    assert quality.platt(z, np.ones(20_000, int)) == (1.0, 0.0) == quality.platt(np.empty(0), np.empty(0, int))
    apart = quality.platt(np.array([-3.0, -2, 2, 3] * 5), np.array([0, 0, 1, 1] * 5))
    assert 0 < apart[0] < 100


def test_distances_of_words():
    d = np.array([5, 5, 7, 5, 9, 7, 5])
    want = [quality.NEVER, 0, quality.NEVER, 1, quality.NEVER, 1, 1]
    assert quality.last_said(d).tolist() == [w if w == quality.NEVER and k in (0, 2, 4) else quality.LAST_SAID + w for k, w in enumerate(want)]
    assert quality.last_said(np.empty(0, np.int64)).tolist() == []


def test_the_sample_is_bounded_in_characters(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "Model", lambda texts, labels: seen.append((texts, labels)))
    docs = spark.createDataFrame([(i, "x" * (10 if i % 3 else 100_000)) for i in range(90)] + [(i, None) for i in range(90, 95)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(95)], "doc_id long, quality int")
    quality.fit(docs, labels, chars=250_000)
    texts, _ = seen[0]
    assert 0 < sum(len(t or "") for t in texts) <= 250_000 and len(texts) < 95
    quality.fit(docs, labels, rows=7)
    assert len(seen[1][0]) == 7
    order = [r["doc_id"] for r in labels.filter(~quality.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).collect()]
    quality.fit(docs, labels.filter("doc_id < 0"))
    assert seen[2] == ([], []) and len(order) > 7
