"""Python workers stay on an executor once they began: as many as a task runs side by side, for each kind of use."""

import corpus_pipeline
import pytest
from pixelquarry.llm import line_dedup, packing, quality, tokens
from pyspark import SparkContext
from tokenizers import Tokenizer

LIBRARY = Tokenizer.from_file(tokens.public_tokenizers.path(tokens.TOKENIZER))


def side_by_side(node, above=0):
    """The most nodes of an executed plan that run Python within one stage."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return side_by_side(node.executedPlan(), above)
    if name.endswith("QueryStage"):
        return side_by_side(node.plan(), above)
    if "Exchange" in name:
        above = 0
    above += "Python" in name or "InArrow" in name
    below = node.children()
    return max([above, *(side_by_side(below.apply(k), above) for k in range(below.size()))])


def test_line_dedup_runs_one_worker_in_a_task(spark):
    passage = "\n".join(" ".join(f"l{k}w{j}" for j in range(12)) for k in range(6))
    docs = spark.createDataFrame([(i, f"start {i}\n{passage}\nend {i}") for i in range(20)], "doc_id long, text string")
    done = line_dedup.dedup(docs, deleted="gone")
    assert sorted(r["gone"] for r in done.collect()) == [0] + [6] * 19
    assert side_by_side(done._jdf.queryExecution().executedPlan()) == 1


def test_line_dedup_stage_runs_one_worker_in_a_task_whose_lines_are_filtered_afterwards(spark):
    passage = "\n".join(" ".join(f"l{k}w{j}" for j in range(12)) for k in range(6))
    docs = spark.createDataFrame([(i, f"start {i}\n{passage}\nend {i}" if i else passage, 7) for i in range(20)] + [(20, passage, 7), (21, None, 7), (22, "", 7)], "doc_id long, text string, n_chars int")
    done = corpus_pipeline.line_dedup_stage(spark, docs, "")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in done.collect()}
    left = {i: f"start {i}\nend {i}" for i in range(1, 20)}
    assert got == {0: (passage, 7), 21: (None, 7), 22: ("", 7)} | {i: (t, len(t)) for i, t in left.items()}
    assert side_by_side(done._jdf.queryExecution().executedPlan()) == 1


def test_quality_sample_needs_no_workers_of_rdds(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "BUY NOW") for i in range(60)], "doc_id long, text string").persist()
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int").persist()
    assert docs.count() == labels.count() == 60
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **k: pytest.fail("rows of an RDD"))
    model = quality.fit(docs, labels)
    assert model.gain is not None
    low, high = quality.Scorer(model.gain, model.scale, model.prior).scores(["BUY NOW", "good words here"])
    assert low < high


def letters(k):
    return "".join(chr(97 + int(d)) for d in str(k))


def test_frequent_words_stay_when_the_tables_are_full(monkeypatch):
    for name in ("CACHED", "WORDS", "PIECES"):
        monkeypatch.setattr(tokens, name, 50, raising=False)
    asked = []

    class Model:
        @staticmethod
        def tokenize(piece):
            asked.append(piece)
            return LIBRARY.model.tokenize(piece)

    words = tokens._Words(tokens._Pieces(Model))
    for k in range(1000):
        words["often"]
        words[f"x{letters(k)}"]
    assert asked.count("Ġoften") == 1 and len(asked) == 1001
    for t in (words, words.pieces):
        assert len(t) <= 50 and len(t.older) <= 50


def test_every_character_beside_words_white_space_and_itself():
    encoder = tokens.Encoder()
    for c in [*map(chr, range(0x2C0)), " ", "　", "日", "😀"]:
        for text in (c, f"ab{c}", f"{c}ab", f"a{c}b c", f"ab {c} {c}{c}", f"ab{c}\n{c}c\nd", f"it'{c} x1{c}"):
            for _ in range(2):  # when words are new, and when they are known
                assert encoder.encode(text) == b"".join(i.to_bytes(4, "little") for i in LIBRARY.encode(text, add_special_tokens=False).ids), repr(text)


def test_lean_packing_has_smaller_tables_and_gives_the_same_pieces(docs):
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["piece"], r["ids_crc32"])
    whole, lean = (sorted(packing.pieces_of(docs, 64, lean=x).collect(), key=key) for x in (False, True))
    assert lean == whole
    assert tokens.Encoder(lean=True).words.most < tokens.Encoder().words.most
