"""HTML extraction by minimum-cut labelling.

A page is cut into text blocks at block-level tags. Every block has two kinds of
evidence, both as log-odds of being content:

* its text and tag, by a naive Bayes classifier over the bins of FEATURES. Its
  counts are made from all pages: a block inside of an element or class that says
  what it is (STRUCTURE) is an example of that label. The sum of its log-odds is
  tempered by TEMPER, as the features depend on each other, and held within SURE;
* the elements and class names around it (STRUCTURE, fixed log-odds).

Their sum is the cost of calling the block boilerplate if positive, of calling it
content if negative: its terminal capacity. Smoothness edges are on the same
scale: neighbours in page order, by the number of containers' bounds between them,
and neighbours inside one container are joined by the log-odds that two such
blocks have the same label, as counted over all pages too, held within CAPS. A
maximum flow gives the cheapest labelling; content blocks are the text.

Where pages have few examples, counts are filled up by PRIOR_BLOCKS made-up ones
of each label (DEFAULT), so a table of pages without any telling element works.

Elements that can't hold text of the page (scripts, styles, templates, forms'
controls, the head) give no blocks. Character references are decoded, white
space inside a block becomes one space, blocks are joined by line ends.

Defined results: a null or empty page, or one without content blocks, gives an
empty text; unclosed and misnested tags are closed at their parents; a text
outside any element is a block; a tag that is never closed is text, and after one
whose quotes are never closed, quotes in tags aren't heeded any more; repeated
rows are extracted each; an empty table gives no rows; further columns are kept by
``extract``, a column of the name that it adds is replaced. Whole pages are used:
parsing takes time in proportion to a page's length, whatever it holds.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

QUERY = "op4_mincut_extract"
ORACLE_SQL = None  # a flow over each page's graph

_NAMES = lambda s: frozenset(s.split())
#: Elements whose inside is never text of the page.
SKIPPED = _NAMES("script style noscript template head title svg math iframe object canvas select option button textarea video audio map")
#: Those of them whose inside isn't markup, so that only their own end tag ends them.
RAW = _NAMES("script style title textarea iframe noscript")
VOID = _NAMES("area base br col embed hr img input link meta param source track wbr")
INLINE = _NAMES("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img input")
#: Elements that a new block-level element closes.
LEAVES = _NAMES("p h1 h2 h3 h4 h5 h6 dt dd")
LISTS = _NAMES("ul ol menu")
#: STRUCTURE: what an element says of the blocks inside, as log-odds of content.
ELEMENT_SAYS = {"article": 3.0, "main": 2.0, "nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "header": -5.0, "menu": -6.0, "dialog": -6.0, "address": -2.0, "figcaption": -0.5}
BAD_SAYS, GOOD_SAYS = -6.0, 1.5
#: Words of class names, ids and roles (split at white space, "-" and "_"), and beginnings of such words.
BAD_WORDS = _NAMES(
    "ad ads adbox adslot banner sidebar side breadcrumb breadcrumbs footer foot header masthead topbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended trending widget comment comments commentlist respond replies reply disqus pagination pager tags copyright disclaimer toolbar skip search"
)
BAD_BEGIN = ("advert", "sponsor", "promo", "nav", "menu")
GOOD_WORDS = _NAMES("content entry post story body text main hentry prose")
GOOD_BEGIN = ("article",)
BAD_ROLE = _NAMES("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar")
#: A block whose structure says as much is an example of its label.
EXAMPLE = 2.0

#: Bins of what is seen of a block itself.
FEATURES = {"tag": 6, "words": 8, "linked": 5, "closed": 3, "commas": 4}
TAGS = {"p": 1, "pre": 2, "blockquote": 2, "h1": 3, "h2": 3, "h3": 3, "h4": 3, "h5": 3, "h6": 3, "li": 4, "dt": 4, "dd": 4, "td": 5, "th": 5}
TEMPER, SURE = 0.5, 2.5
#: Kinds of edges: neighbours in page order with no, one, two, or more bounds between them; in one container, but not in page order. The most that an edge can weigh.
CAPS = (1.5, 0.75, 0.5, 0.25, 1.0)
#: Shares of the made-up examples: (content, boilerplate) by feature and bin; same and different labels by kind of edge.
DEFAULT = {
    "tag": ((0.15, 0.55, 0.1, 0.1, 0.07, 0.03), (0.35, 0.12, 0.03, 0.1, 0.3, 0.1)),
    "words": ((0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.2, 0.2), (0.25, 0.25, 0.2, 0.12, 0.08, 0.05, 0.03, 0.02)),
    "linked": ((0.8, 0.14, 0.03, 0.02, 0.01), (0.4, 0.1, 0.05, 0.1, 0.35)),
    "closed": ((0.2, 0.75, 0.05), (0.65, 0.3, 0.05)),
    "commas": ((0.3, 0.2, 0.3, 0.2), (0.75, 0.05, 0.1, 0.1)),
    "edge": ((0.9, 0.7, 0.6, 0.55, 0.8), (0.1, 0.3, 0.4, 0.45, 0.2)),
}
PRIOR_BLOCKS = 200.0
#: Costs are whole multiples of this, which bounds the rounds of the flow.
GRAIN = 1 / 16

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[\s_-]+")
_TAG, _WORDS_OF, _LINKED, _CLOSED, _COMMAS = FEATURES


class Block:
    __slots__ = ("container", "depth", "linked", "says", "tag", "text")

    def __init__(self, text: str, says: float, linked: float, container: int, depth: int, tag: str):
        self.text, self.says, self.linked, self.container, self.depth, self.tag = text, says, linked, container, depth, tag

    def bins(self) -> tuple[int, ...]:
        """The bin of each feature."""
        words = self.text.count(" ") + 1
        end = 1 if self.text[-1] in ".!?…\"”»" else 2 if self.text[-1] in ":;" else 0
        commas = self.text.count(",") / words
        linked = 0 if not self.linked else 1 if self.linked <= 0.25 else 2 if self.linked <= 0.5 else 3 if self.linked <= 0.9 else 4
        return TAGS.get(self.tag, 0), min(7, words.bit_length() - 1), linked, end, 0 if not commas else 1 if commas < 0.03 else 2 if commas < 0.08 else 3


def _says(name: str, attributes: str) -> float:
    out = ELEMENT_SAYS.get(name, 0.0)
    if "=" in attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            if key.lower() == "role":
                out += BAD_SAYS if value in BAD_ROLE else GOOD_SAYS if value in ("main", "article") else 0
                continue
            words = _WORDS.split(value)
            if any(w in BAD_WORDS or w.startswith(BAD_BEGIN) for w in words):
                out += BAD_SAYS
            elif any(w in GOOD_WORDS or w.startswith(GOOD_BEGIN) for w in words):
                out += GOOD_SAYS
    return out


class _Open:
    """An open element: what it and those around it say (the worst, else the best), its container; the nearest open paragraph or heading inside inline elements only, and the nearest list item inside its list, as places in the stack."""

    __slots__ = ("bad", "container", "depth", "good", "item", "leaf", "name")

    def __init__(self, name, bad, good, container, depth, leaf, item):
        self.name, self.bad, self.good, self.container, self.depth, self.leaf, self.item = name, bad, good, container, depth, leaf, item


def _tokens(page: str):
    """("text", text), ("open", name, attributes), ("close", name): each character is read a bounded number of times."""
    at, size, quotes = 0, len(page), True
    endless: set[str] = set()  # elements that no end tag ends any more
    while at < size:
        k = page.find("<", at)
        if k < 0:
            yield "text", page[at:], ""
            return
        if k > at:
            yield "text", page[at:k], ""
        at = k
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else size
            continue
        m = _NAME.match(page, at + 1)
        if m is None:
            yield "text", "<", ""
            at += 1
            continue
        end = -1
        if quotes:
            q = _QUOTED.match(page, m.end())
            end = q.end() if q else -1
            quotes = q is not None
        if end < 0:
            end = page.find(">", m.end()) + 1
            if not end:  # no tag is closed any more
                yield "text", page[at:], ""
                return
        name, attributes = m[2].lower(), page[m.end() : end - 1]
        at = end
        if m[1]:
            yield "close", name, ""
            continue
        if name in SKIPPED:
            if name not in endless:
                # markup may be inside those that aren't raw: skip to the end tag that belongs to it, or only the tag if there is none
                found = re.compile(rf"</{name}\s*>|<body[\s>]" if name == "head" else rf"</{name}\s*>", re.I).search(page, at)
                if found:
                    at = found.start() if found[0][1] != "/" else found.end()
                    continue
                endless.add(name)
            if name in RAW:
                return
            continue
        yield "open", name, attributes


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order."""
    out: list[Block] = []
    stack = [_Open("", 0.0, 0.0, 0, 0, -1, -1)]
    held: Counter = Counter()  # open elements by name
    containers = linked = plain = in_link = 0
    parts: list[str] = []
    block_name = ""

    def flush():
        nonlocal linked, plain
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                top = stack[-1]
                out.append(Block(text, top.bad if top.bad < 0 else top.good, linked / max(1, linked + plain), top.container, top.depth, block_name))
            parts.clear()
        linked = plain = 0

    def pop(to: int):
        nonlocal in_link
        while len(stack) > to:
            name = stack.pop().name
            held[name] -= 1
            if name == "a":
                in_link -= 1

    def add(text: str):
        nonlocal linked, plain
        parts.append(text)
        if in_link:
            linked += len(text)
        else:
            plain += len(text)

    for kind, name, attributes in _tokens(page):
        if kind == "text":
            add(name)
            continue
        if kind == "close":
            if held[name]:
                if name not in INLINE:
                    flush()
                    block_name = ""
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                pop(k)
            continue
        if name in VOID or attributes.endswith("/"):
            if name == "br":
                add(" ")
            elif name == "hr":
                flush()
            continue
        if name not in INLINE:
            flush()
            if stack[-1].leaf > 0:  # an open paragraph or heading ends here, with what is open inside it
                pop(stack[-1].leaf)
            if name == "li" and stack[-1].item > 0:
                pop(stack[-1].item)
            block_name = name
        elif name == "a":
            in_link += 1
        top = stack[-1]
        container, depth = top.container, top.depth
        said = _says(name, attributes)
        if name == "header" and top.good >= ELEMENT_SAYS["main"] and said == ELEMENT_SAYS["header"]:
            said = 0.0  # the heading of an article or of the main part
        if name not in INLINE and name not in LEAVES:
            containers += 1
            container, depth = containers, depth + 1
        here = len(stack)
        leaf = here if name in LEAVES else top.leaf if name in INLINE else -1
        item = here if name == "li" else -1 if name in LISTS else top.item
        held[name] += 1
        stack.append(_Open(name, min(top.bad, said), max(top.good, said), container, depth, leaf, item))
    flush()
    return out


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(block, block, kind) of all neighbours."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        near = last.get(b.container)
        if i:
            a = blocks[i - 1]
            out.append((i - 1, i, 0 if a.container == b.container else min(3, abs(a.depth - b.depth) + 1)))
        if near is not None and near < i - 1:
            out.append((near, i, 4))
        last[b.container] = i
    return out


def example(b: Block) -> int | None:
    """1 or 0 for a block whose structure says what it is."""
    return 1 if b.says >= EXAMPLE else 0 if b.says <= -EXAMPLE else None


def examples(page: str | None) -> Counter:
    """How often (feature, bin, label) and ("edge", kind, same label) are met in a page's examples."""
    out: Counter = Counter()
    blocks = blocks_of(page) if page else []
    labels = [example(b) for b in blocks]
    for b, label in zip(blocks, labels, strict=True):
        if label is not None:
            out.update((f, k, label) for f, k in zip(FEATURES, b.bins(), strict=True))
    for i, j, kind in edges_of(blocks):
        if labels[i] is not None and labels[j] is not None:
            out["edge", kind, int(labels[i] == labels[j])] += 1
    return out


class Model:
    """Log-odds by feature and bin, and weights by kind of edge, from counts of examples."""

    def __init__(self, counts: dict[tuple[str, int, int], int] | None = None):
        counts = counts or {}
        self.gain: list[list[float]] = []
        for f, bins in FEATURES.items():
            made = [[PRIOR_BLOCKS * DEFAULT[f][1 - label][k] + counts.get((f, k, label), 0) for k in range(bins)] for label in (0, 1)]
            total = [sum(m) for m in made]
            self.gain.append([math.log(made[1][k] / total[1]) - math.log(made[0][k] / total[0]) for k in range(bins)])
        same = [[PRIOR_BLOCKS * DEFAULT["edge"][1 - s][k] + counts.get(("edge", k, s), 0) for s in (0, 1)] for k in range(len(CAPS))]
        self.weight = [min(cap, max(0.0, math.log(s / d))) for cap, (d, s) in zip(CAPS, same, strict=True)]

    def log_odds(self, b: Block) -> float:
        """That the block is content."""
        seen = TEMPER * sum(g[k] for g, k in zip(self.gain, b.bins(), strict=True))
        return round((b.says + max(-SURE, min(SURE, seen))) / GRAIN) * GRAIN


def cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Of each node, whether it is on the source's side of a minimum cut (Dinic's maximum flow; nearest to the sink on ties).

    Flow that can go straight from the source through a node to the sink is sent first, so most pages need no search.
    """
    n = len(source)
    graph: list[list[list]] = [[] for _ in range(n + 2)]  # of each arc: to, capacity, the reverse arc

    def arc(a: int, b: int, ab: float, ba: float):
        x, y = [b, ab, None], [a, ba, None]
        x[2], y[2] = y, x
        graph[a].append(x)
        graph[b].append(y)

    s, t = n, n + 1
    for i in range(n):
        both = min(source[i], sink[i])
        if source[i] > both:
            arc(s, i, source[i] - both, 0.0)
        elif sink[i] > both:
            arc(i, t, sink[i] - both, 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for b, room, _ in graph[a]:
                if room > 1e-9 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        begun = [0] * (n + 2)
        path: list[list] = []
        a = s
        while True:  # depth first, without recursion
            if a == t:
                flow = min(x[1] for x in path)
                for x in path:
                    x[1] -= flow
                    x[2][1] += flow
                k = next(i for i, x in enumerate(path) if x[1] <= 1e-9)
                a = path[k][2][0]
                del path[k:]
                continue
            arcs = graph[a]
            while begun[a] < len(arcs):
                x = arcs[begun[a]]
                if x[1] > 1e-9 and level[x[0]] == level[a] + 1:
                    break
                begun[a] += 1
            if begun[a] < len(arcs):
                path.append(arcs[begun[a]])
                a = path[-1][0]
            elif path:
                a = path.pop()[2][0]
                begun[a] += 1
            else:
                break


def labels(blocks: list[Block], model: Model) -> list[bool]:
    """Of each block, whether the cheapest labelling calls it content."""
    z = [model.log_odds(b) for b in blocks]
    edges = [(i, j, model.weight[kind]) for i, j, kind in edges_of(blocks) if model.weight[kind]]
    return cut([max(x, 0.0) for x in z], [max(-x, 0.0) for x in z], edges)


def content(page: str | None, model: Model | None = None) -> list[str]:
    """The texts of a page's content blocks."""
    blocks = blocks_of(page) if page else []
    return [b.text for b, kept in zip(blocks, labels(blocks, model or Model()), strict=True) if kept]


def fit(pages: DataFrame, column: str = "html") -> Model:
    """The model of all pages: counts by task, then summed up; the driver gets a row for each bin."""

    def count(batches):
        total: Counter = Counter()
        for b in sliced(batches):
            for page in b[0].to_pylist():
                total.update(examples(page))
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())], ["feature", "bin", "label", "n"])

    rows = pages.select(column).mapInArrow(count, "feature string, bin int, label int, n long").groupBy("feature", "bin", "label").agg(F.sum("n").alias("n")).collect()
    return Model({(r["feature"], r["bin"], r["label"]): r["n"] for r in rows})


def extract(pages: DataFrame, column: str = "html", out: str = "text", model: Model | None = None) -> DataFrame:
    """pages with one more column, the main text."""
    model = model or fit(pages, column)

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(content(p, model)) for p in pages.tolist()], dtype=object)

    return pages.withColumn(out, text(column))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
