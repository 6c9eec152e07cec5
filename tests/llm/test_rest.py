import hashlib
import zlib

import numpy as np
import pytest
from pixelquarry.llm import chat_format, html_extract, media, quality, url_filter
from pixelquarry.llm.common import shared_dir
from pyspark.sql import functions as F


# --- URL filter


def test_rules_and_parts(spark):
    urls = [("https://A.Example.com/en/7x?q#f",), ("http://x.com/en/1",), ("ftp://sub.example.net/de/81",), ("http://b.net/de/1#t",), ("http://o.org/es/",), ("http://o.org/es",), (None,), ("no scheme",), ("http://host?x=/en/",), ("http://casino-poker.example.org/fr/1",)]
    host, path = url_filter.parts(F.col("url"))
    rule, verdict = url_filter.rule_of(host, path)
    got = spark.createDataFrame(urls, "url string").select(host, path, rule, verdict).collect()
    assert [tuple(r) for r in got] == [
        ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("x.com", "/en/1", "com/en/", "block"),
        ("sub.example.net", "/de/81", "example.net/de/8", "block"),
        ("b.net", "/de/1", "net/de/", "allow"),
        ("o.org", "/es/", "org/es/", "block"),
        ("o.org", "/es", None, None),
        ("", "", None, None),
        ("", "", None, None),
        ("host", "", None, None),
        ("casino-poker.example.org", "/fr/1", None, None),
    ]


# --- quality classifier


def test_classifier_learns_and_handles_edges(spark, docs, empty):
    r = np.random.default_rng(1)
    good = [" ".join(r.choice(["river", "stone", "house", "green", "walks", "slowly"], 30)) for _ in range(150)]
    bad = [" ".join(w + "!!" for w in r.choice(["BUY", "NOW", "CHEAP", "CLICK"], 30)) for _ in range(150)]
    train = [(i, t, i < 150) for i, t in enumerate([*good, *bad])]
    table = spark.createDataFrame([(i, t, 0.1) for i, t, _ in train] + [(900, None, 0.2), (901, "", 0.2)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(g), 0) for i, _, g in train] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, text int")
    model = quality.fit(table, labels)
    got = quality.scored(table.drop("score"), model).toPandas().set_index("doc_id").score
    held = [i for i, *_ in train if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 40 and all((got[i] > 0.5) == (i < 150) for i in held)
    assert got[900] == got[901] and 0 <= got[900] <= 1
    kept = quality.reject(table, labels)
    assert kept.columns == table.columns and {i for (i,) in kept.select("doc_id").collect()} >= set(range(150))
    assert quality.scored(empty.drop("score"), model).count() == 0
    assert quality.fit(docs, labels.limit(0)).gain is None
    assert quality.scored(docs.drop("score"), quality.fit(docs, labels.limit(0))).select("score").distinct().count() == 1


def test_subwords_are_those_of_each_word():
    words = [b"ab", b"stone", b"", b"x" * 300]
    ids, owner = quality.subwords(words)
    for k, w in enumerate(words):
        own = len(w) + 2
        assert (owner == k).sum() == 1 + sum(max(0, own - n + 1) for n in quality.NGRAMS)
        alone, _ = quality.subwords([w])
        assert sorted(alone) == sorted(ids[owner == k])


# --- HTML extraction

PAGE = """<html><head><title>T</title></head><body><header><h1>Site name</h1><p>Welcome to the site of all sites.</p></header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies to improve your experience on this site.</div><main><article><h1>The title &amp; more</h1><p>A real paragraph
  here, with some <a href="#">link</a> inside it.<p>Second &lt;b&gt; one<br>goes on.<div class="ad-slot">Buy this now, it is great and cheap for all.</div><ul><li>One item</li></ul></article>
<section class="comments"><p>I really liked this article, thank you so much for writing it.</p></section><aside><p>Related stories are listed here for you.</p></aside>
<form><p>Subscribe to our newsletter today please</p></form></main><footer>&copy; someone</footer><script>var t="</p>";</script></body></html>"""


def test_extracts_the_article():
    assert html_extract.content(PAGE) == ["The title & more", "A real paragraph here, with some link inside it.", "Second <b> one goes on.", "One item"]


def test_extract_edge_cases(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <b>text here."), (5, "u", "<" * 5000), (6, "u", "<p>" + "word " * 50000 + "</p>"), (6, "u", "<nav>only menus</nav>")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    assert got.text.tolist()[1:3] == ["", ""] and got.text[3] == "unclosed text here." and got.text[6] == "" and len(got.text[5]) == 249999
    assert html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).count() == 0


def test_cut_is_a_minimum():
    r = np.random.default_rng(2)
    for _ in range(60):
        n = int(r.integers(1, 9))
        source, sink = r.uniform(0, 3, n).tolist(), r.uniform(0, 3, n).tolist()
        edges = [(int(a), int(b), float(w)) for a, b, w in zip(r.integers(0, n, 12), r.integers(0, n, 12), r.uniform(0, 2, 12)) if a != b]

        def cost(side):
            return sum(sink[i] if side[i] else source[i] for i in range(n)) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert cost(html_extract.cut(source, sink, edges)) == pytest.approx(best)


# --- media


def test_samples_round_trip():
    for text in (None, "", "a", "x" * 64, "é" * 333, "\x00" * 65, "😀" * 10000):
        data, n = media.payload(text)
        assert n == len((text or "").encode()) and len(data) % 64 == 0 and len(data) >= 64 and data[:n] == (text or "").encode()
        assert media.decode_samples(media.encode_samples(data)) == data


def test_archives(spark, docs, rows, empty):
    path = shared_dir(spark, "media")
    media.write_archives(docs, path)
    spark.dataSource.register(media.MemberArchive)
    for size in (100, 5000, 1 << 25):  # ranges that begin anywhere
        found = spark.read.format("member_archive").option("rangeBytes", size).load(path).toPandas()
        assert len(found) == len(rows) and found.error.isna().all()
    got = sorted(tuple(r) for r in media.media_columns(spark, path).fillna(-1, ["doc_id"]).collect())
    want = []
    for d, t, _ in rows:
        data, n = media.payload(t)
        stored = media.encode_samples(data)
        want.append((-1 if d is None else d, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), media.features(data)))
    assert got == sorted(want)
    path = shared_dir(spark, "media")
    media.write_archives(empty, path)
    assert media.media_columns(spark, path).count() == 0


def test_a_damaged_member_leaves_its_neighbours(spark, docs, rows, monkeypatch):
    path = shared_dir(spark, "media")
    file = media.write_archives(docs.coalesce(1), path).filter("members > 0").first()["archive"]
    data = bytearray(open(file, "rb").read())
    second = data.index(media.MEMBER, 10)
    data[second + media._HEAD.size + 20] ^= 255
    open(file, "wb").write(data)
    spark.dataSource.register(media.MemberArchive)
    found = spark.read.format("member_archive").load(path).toPandas()
    assert len(found) == len(rows) and found.error.notna().sum() == 1


# --- chat formatting


def test_chat_examples(spark):
    rows = [(1, 0, "user", "hi & <s>[USER] x"), (1, 1, "assistant", "a [b] </s>"), (1, 2, "user", None), (1, 3, "assistant", "c"), (1, 4, "user", "tail"), (2, 0, "user", "no reply"), (3, 0, None, "role"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, 0, "assistant", "")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, context string")
    got = chat_format.prefix_target(turns).collect()
    one = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["example"])
    assert [r["target"] for r in one] == ["a &lb;b&rb; &lt;/s>", "c", None]
    assert one[0]["context"] == "<s>[user] hi &amp; &lt;s>&lb;USER&rb; x </s><s>[assistant] "
    assert one[1]["context"].startswith(one[0]["context"] + one[0]["target"] + " </s>")
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.prefix_target(turns)).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    for c, said in by.items():
        assert back[c]["n_turns"] == len(said)
        assert back[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        loss = "".join(t for r, t in said if r == "assistant")
        assert (back[c]["loss_chars"], back[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.prefix_target(turns.limit(0)).count() == 0


def test_chat_runs_no_python(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat_format.read_back(chat_format.prefix_target(turns))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
