import corpus_pipeline
from pixelquarry.llm.common import materialize

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sf(spark, tmp_path, docs, labels, items):
    spark.createDataFrame(docs, COLUMNS).coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}"


def text_of(seed, words=80):
    return " ".join(f"w{(seed * 7919 + k * 104729) % 100003}" for k in range(words))


def test_stages(spark, tmp_path):
    item, passage = text_of(999, 30), text_of(500, 60)
    docs = [(i, text_of(i), "en", "s", 0) for i in range(40)]
    docs += [(100, text_of(3), "en", "s", 0), (101, text_of(5) + " one more", "en", "s", 0)]  # an exact and a near copy
    docs += [(200, f"{text_of(200)}\n{item}\nand on", "en", "s", 0)]
    docs += [(300, f"{text_of(300)}\n{passage}", "en", "s", 0), (301, f"{text_of(301)}\n{passage}", "en", "s", 0)]
    docs += [(400 + i, " ".join("BUY!! NOW!!".split() * 30), "en", "s", 0) for i in range(30)] + [(450, None, None, None, None)]
    labels = [(i, 1, 0) for i in range(40)] + [(400 + i, 0, 0) for i in range(30)]
    path = sf(spark, tmp_path, docs, labels, [(1, item)])
    df = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        df = materialize(stage(spark, df, path), "stage")
        seen[name] = df
        if name != "best-fit packing":
            assert df.dtypes == spark.read.parquet(f"{path}/documents.parquet").dtypes
    ids = {k: {r["doc_id"] for r in v.select("doc_id").collect()} for k, v in seen.items()}
    clean = set(range(40)) | {200, 300, 301}
    assert clean <= ids["quality classifier"] and not any(400 <= i < 430 for i in ids["quality classifier"])
    lines = {r["doc_id"]: r for r in seen["line dedup"].collect()}
    assert 100 not in lines and lines[301]["text"] == text_of(301) and lines[301]["n_chars"] == len(text_of(301)) and lines[300]["n_chars"] == 0
    assert not {100, 101} & ids["n-gram Jaccard join"] and set(range(40)) <= ids["n-gram Jaccard join"]
    assert 200 not in ids["benchmark decontamination"] and clean - {200} <= ids["benchmark decontamination"]
    assert ids["best-fit packing"] == ids["benchmark decontamination"]
    assert corpus_pipeline.run(spark, path).count() == seen["best-fit packing"].count()


def test_empty_tables(spark, tmp_path):
    path = sf(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, path).count() == 0


def test_stages_on_odd_rows(spark, tmp_path, docs, rows, empty):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names the stages use themselves."""
    path = sf(spark, tmp_path, [(1, "a", "en", "s", 1)], [(1, 1, 0), (2, 1, 0), (3, 0, 0), (None, 1, 0)], [(1, "GAMMA delta epsilon zeta eta theta iota kappa lambda"), (2, None)])
    odd = docs.selectExpr("*", "1 AS __row", "2 AS __key", "3 AS __hit", "4 AS __score", "5 AS n_chars", "6 AS component_id", "7 AS deleted")
    rank = lambda t: (t is not None, t or "")
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, odd, path)
        assert got.dtypes == odd.dtypes, name
        found = [(r["doc_id"], r["text"]) for r in got.collect()]
        assert stage(spark, odd.limit(0), path).count() == 0
        texts = sorted((t for _, t in found), key=rank)
        if name == "line dedup":
            # only the later copy of the passage is cut
            assert len(found) == len(rows) and dict(found)[11] == "start of eleven\nend of eleven" and dict(found)[10] == dict((r[0], r[1]) for r in rows)[10]
        elif name == "n-gram Jaccard join":
            # one of the near copies 1, 2, 3, of 10 and 11, of "one two" and of the repeated row; rows without words stay
            ids = sorted((i for i, _ in found if i is not None))
            assert ids == [1, 4, 5, 6, 7, 8, 9, 10, 12, 13, 15] and len(found) == len(ids) + 1
        elif name == "benchmark decontamination":
            assert len(found) == len(rows) - 3 and not {1, 2, 3} & {i for i, _ in found} and texts == sorted((r[1] for r in rows if r[0] not in (1, 2, 3)), key=rank)
    packed = corpus_pipeline.STAGES[4][1](spark, odd, path).collect()
    assert sorted({r["doc_id"] for r in packed if r["doc_id"] is not None}) == sorted({r[0] for r in rows if r[0] is not None})
    taken = sorted((r["sequence_id"], r["offset"], r["length"]) for r in packed)
    for (s, at, n), (s2, at2, _) in zip(taken, taken[1:], strict=False):
        assert at2 == (at + n if s2 == s else 0)


def test_pipeline_matches_brute_force(spark, tmp_path):
    """What is kept after line dedup, join and decontamination, recomputed document by document."""
    import random

    from .test_dedup_join import brute_components, brute_lines, shingles

    r = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    running = lambda n: " ".join(r.choices(vocabulary, k=n))
    passage, item = running(60), running(40)
    docs = []
    for i in range(60):
        parts = [running(r.randint(20, 60)) for _ in range(r.randint(1, 3))]
        if i % 7 == 3:
            parts.append(passage)
        if i % 11 == 5:
            parts.append(item)
        docs.append((i, "\n".join(parts)))
    for i in range(60, 80):  # near copies of one line, with a word changed
        words = docs[i - 60][1].replace("\n", " ").split()
        words[r.randrange(len(words))] = f"new{i}"
        docs.append((i, " ".join(words)))
    path = sf(spark, tmp_path, [(i, t, "en", "s", len(t)) for i, t in docs], [(i, 1, 0) for i in range(80)], [(1, item)])
    # with one label only, the classifier keeps all
    after = [(i, t) for (i, _), t in zip(docs, brute_lines(docs, 50), strict=True) if t]
    least = {int(d): c for d, _, c in brute_components(after)}
    kept = [(i, t) for i, t in after if least[i] == i]
    want = {i for i, t in kept if 100 * len(shingles(t) & shingles(item)) < 80 * len(shingles(item))}
    assert 0 < len(want) < len(kept) < len(after)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, path).select("doc_id").distinct().collect()} == want
