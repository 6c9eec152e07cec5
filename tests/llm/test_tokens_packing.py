import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pixelquarry.llm import bitplane, packing
from pixelquarry.llm.common import shared_dir
from pixelquarry.llm.tokens import TOKENIZER, encoder
from tokenizers import Tokenizer

LIBRARY = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def plain(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FF), st.sampled_from(" \n\n'sdt,.!日😀")), max_size=60))
def test_ids_are_the_library_s(text):
    assert encoder().encode(text) == plain(text)[:-1].tobytes()


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("top", [1, 2, 255, 256, 50256, 2**32])
def test_planes_round_trip(planes, top):
    ids = np.random.default_rng(top).integers(0, top, 1001).astype("<u4")
    parts = bitplane.to_planes(ids, planes)
    assert (bitplane.from_planes(parts, len(ids), planes) == ids).all()


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_ids_written_in_order_and_read_back(spark, docs, rows, planes):
    got = bitplane.read_ids(bitplane.write_ids(docs, shared_dir(spark, "t"), planes=planes)).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for g, w in zip(sorted(got, key=lambda r: r["start"]), want, strict=True):
        ids = plain(w[1])
        assert (g["doc_id"], g["start"], g["n_tokens"]) == (w[0], start, len(ids))
        assert g["ids"] == ids.tolist()
        start += len(ids)


def test_damage_is_noticed(spark, docs):
    path = shared_dir(spark, "t")
    file = bitplane.write_ids(docs.filter("doc_id = 12"), path).first()["file"].removeprefix("file://")
    data = bytearray(open(file, "rb").read())
    data[len(data) // 2] ^= 255
    open(file, "wb").write(data)
    with pytest.raises(Exception):  # noqa: B017
        list(bitplane.PlaneReader(f"file://{file}").documents())


def test_empty_tables(spark, empty):
    assert bitplane.read_ids(bitplane.write_ids(empty, shared_dir(spark, "t"))).count() == 0
    assert packing.pack(empty).count() == 0


def test_packing_places_every_piece_once(docs, rows):
    got = packing.pack(docs, sequence=256).toPandas()
    want = {}
    for doc_id, text, _ in rows:
        ids = plain(text)
        cuts = [len(ids) % 256] * (len(ids) % 256 > 0) + [256] * (len(ids) // 256)
        at = 0
        for k, n in enumerate(cuts):
            want.setdefault((-1 if doc_id is None else doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())), 0)
            want[(-1 if doc_id is None else doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes()))] += 1
            at += n
    have = got.assign(doc_id=got.doc_id.fillna(-1).astype(int)).groupby(["doc_id", "piece", "start", "length", "ids_crc32"]).size().to_dict()
    assert have == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_few_sequences(seed):
    r = np.random.default_rng(seed)
    n = 512
    lengths = np.clip(r.lognormal(4.2, 1.0, 20000).astype(int), 1, n) if seed % 2 else r.integers(1, n + 1, 5000)
    hist = np.bincount(lengths, minlength=n + 1)
    runs = packing.plan(hist)
    used = runs.groupby("length").n.sum().reindex(range(n + 1), fill_value=0).to_numpy()
    assert (used == hist).all()
    sequences = int((runs.sequence_id + runs.n).max())
    assert sequences <= np.ceil((hist * np.arange(n + 1)).sum() / n) * 1.03 + 1 or hist[n // 2 + 1 :].sum() >= sequences * 0.97


def test_least_squares_never_uses_more_than_there_is():
    hist = np.bincount([3, 5, 5, 8, 2, 6, 1, 1, 7], minlength=9)
    pats, counts = packing.fit(hist)
    used = np.zeros(9, int)
    for p, c in zip(pats, counts):
        for v in p[p > 0]:
            used[v] += c
    assert (used <= hist).all() and counts.sum() >= 2


def test_other_tokenizers_ids_are_the_library_s():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    assert encoder().plain and not encoder(path).plain
    for text in ("abc 12345 def", "It's the Same\nword word", "x"):
        assert encoder(path).encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_files_roll(spark, monkeypatch):
    monkeypatch.setattr(bitplane, "FILE_DOCS", 7)
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(i % 30))) for i in range(60)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    manifest = bitplane.write_ids(table, shared_dir(spark, "roll"))
    assert manifest.count() >= 9 and manifest.agg({"n_docs": "max"}).first()[0] <= 7
    start = 0
    for g, (i, t) in zip(sorted(bitplane.read_ids(manifest).collect(), key=lambda r: r["start"]), texts, strict=True):
        assert (g["doc_id"], g["start"], g["ids"]) == (i, start, plain(t).tolist())
        start += g["n_tokens"]
