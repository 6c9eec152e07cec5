"""The cut's part in the labelling, the classifier's counts, the registered query on labelled pages, and hostile pages."""

import time
from collections import Counter

import pytest
from pixelquarry.llm import html_extract

SENTENCE = "This is a sentence of the article, and it goes on for a while so that it looks like prose, with commas."
LINKS = "".join(f'<li><a href="/{i}">Item number {i}</a></li>' for i in range(4))


def alone(page, model):
    """What the classifier says without the cut."""
    return [b.text for b in html_extract.blocks_of(page) if model.log_odds(b) > 0]


def test_the_cut_makes_a_doubtful_block_content():
    page = f"<div><p>{SENTENCE}</p><p>{SENTENCE}</p><p>By hand</p><p>{SENTENCE}</p><p>{SENTENCE}</p></div>"
    model = html_extract.Model()
    assert "By hand" not in alone(page, model) and html_extract.content(page, model) == [SENTENCE, SENTENCE, "By hand", SENTENCE, SENTENCE]


def test_the_cut_makes_a_doubtful_block_boilerplate():
    model = html_extract.Model()
    lone = "All these are offers of this week only, at our shop."
    page = f"<ul><li><a href=/1>One</a></li></ul><div><p><a href=/a>More</a></p><p><a href=/b>Other</a></p><p>{lone}</p><p><a href=/c>Next</a></p><p><a href=/d>Last</a></p></div>"
    assert alone(page, model) == [lone] and html_extract.content(page, model) == []


def test_the_cut_against_all_labellings():
    import itertools

    model = html_extract.Model()
    pages = [f"<div><p>{SENTENCE}</p><p>Of.</p><ul>{LINKS}</ul></div><div>Some text here.</div>", "<p>Of.</p><p>One two three.</p><div>x, y</div><p>Some more words here, it seems</p>", f"<table><tr><td>a</td><td>{SENTENCE}</td></tr></table>Loose words."]
    for page in pages:
        blocks = html_extract.blocks_of(page)
        z, edges = [model.log_odds(b) for b in blocks], html_extract.edges_of(blocks)
        cost = lambda kept: sum(abs(x) for x, k in zip(z, kept, strict=True) if (x > 0) != k) + sum(model.weight[kind] for i, j, kind in edges if kept[i] != kept[j])  # noqa: B023, E731
        assert cost(html_extract.labels(blocks, model)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=len(blocks)))))


def test_counts_of_examples():
    page = f"<nav><ul>{LINKS}</ul></nav><article><h1>Title</h1><p>{SENTENCE}</p></article><p>No example.</p>"
    got = html_extract.examples(page)
    assert got["tag", html_extract.TAGS["li"], 0] == 4 and got["tag", html_extract.TAGS["p"], 1] == 1 and got["tag", html_extract.TAGS["h1"], 1] == 1
    assert sum(n for (f, _, _), n in got.items() if f == "linked") == 6
    assert sum(n for (f, _, same), n in got.items() if f == "edge" and same) == 4 and sum(n for (f, _, same), n in got.items() if f == "edge" and not same) == 1
    assert html_extract.examples(None) == Counter()
    model = html_extract.Model({("tag", html_extract.TAGS["td"], 1): 100_000, ("edge", 3, 0): 10**9})
    assert model.gain[0][5] > html_extract.Model().gain[0][5] + 1 and model.weight[3] == 0


def layouts(body, k):
    menu, foot = f"<ul>{LINKS}</ul>", "&copy; 2020 someone, all rights."
    return [
        f"<html><head><title>x</title></head><body><nav>{menu}</nav><article><h1>Title {k}</h1>{body}</article><footer>{foot}</footer>",
        f'<body><div id="header"><p>The site of sites, welcome to all of you.</p></div><div class="main-content"><h1>Title {k}</h1>{body}</div><div class="sidebar"><p>{SENTENCE}</p></div><div class="site-footer">{foot}</div></body>',
        f'<main><header><h1>Title {k}</h1></header>{body}<section id="comments"><p>I liked this article very much, thank you for writing it.</p></section></main>',
        f'<div class="cookie-notice"><p>We use cookies to make this page better for you, and for us.</p></div><article><h1>Title {k}</h1>{body}<aside><p>{SENTENCE}</p></aside><form><p>Sign up, it is free.</p></form></article>',
    ]


def test_registered_query_on_labelled_pages(spark, tmp_path):
    rows, want = [], {}
    for k in range(12):
        paragraphs = [f"Paragraph {k} {i}, {SENTENCE}" if (k + i) % 3 else "Of." for i in range(1 + k % 4)]
        for page in layouts("".join(f"<p>{p}</p>" for p in paragraphs), k):
            want[len(rows)] = "\n".join([f"Title {k}", *paragraphs])
            rows.append((len(rows), f"http://x/{k}", page))
    rows += [(1000, None, None), (1001, "u", ""), (1002, "u", "<p>")]
    want |= {1000: "", 1001: "", 1002: ""}
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.query(spark, f"file://{tmp_path}").collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(want[k]) for k, r in got.items())


@pytest.mark.parametrize(
    "page",
    [
        lambda k: "<a " * k,
        lambda k: "<b>" * k + "</i>" * k,
        lambda k: "<b>" * k + "<div>x</div>" * k,
        lambda k: "<svg>" * k,
        lambda k: '<a x="' * k,
        lambda k: '<p class="' + "advert_" * k + '">x</p>',
        lambda k: "<ul><li>" * k,
        lambda k: "<p><b>" * k,
        lambda k: "<" * k,
        lambda k: ("<nav>x</nav>" + "<p>of</p>" * 3) * (k // 4),
    ],
)
def test_time_follows_the_length(page):
    def seconds(k):
        text, best = page(k), 1e9
        for _ in range(3):
            began = time.process_time()
            html_extract.content(text)
            best = min(best, time.process_time() - began)
        return best

    assert seconds(32_000) < 8 * max(0.03, seconds(8_000))
