import random
from collections import defaultdict

import pytest
from pixelquarry.llm import decontaminate, line_dedup, ngram_join


def brute_lines(docs, least):
    """Lines in runs of enough words whose copy begins at an earlier position; docs in order, null texts as they are."""
    split = [[x.strip() for x in t.encode().split(b"\n")] if t is not None else [] for _, t in docs]
    at, out = defaultdict(list), []
    for d, lines in enumerate(split):
        for i, x in enumerate(lines):
            at[x].append((d, i))
    for d, lines in enumerate(split):
        gone = [False] * len(lines)
        for i, x in enumerate(lines):
            for e, j in at[x]:
                if (e, j) >= (d, i):
                    break
                if i and j and split[e][j - 1] == lines[i - 1]:
                    continue
                n = 0
                while i + n < len(lines) and j + n < len(split[e]) and lines[i + n] == split[e][j + n]:
                    n += 1
                if sum(len(y.split()) for y in lines[i : i + n]) >= least:
                    gone[i : i + n] = [True] * n
        t = docs[d][1]
        out.append(t if t is None else "\n".join(x for x, g in zip(t.split("\n"), gone) if not g))
    return out


@pytest.mark.parametrize(("least", "count"), [(6, 100), (12, 80)])
def test_lines_match_brute_force(spark, least, count):
    r = random.Random(least)
    pool = [" ".join(r.choice("abcdef") for _ in range(r.randint(0, 4))) for _ in range(12)]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 25)))) for i in range(count)]
    got = dict(line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), least).collect())
    assert [got[i] for i, _ in docs] == brute_lines(docs, least)


def test_line_edge_cases(docs, rows, empty):
    got = line_dedup.dedup(docs, deleted="gone")
    assert got.columns == [*docs.columns, "gone"]
    found = got.toPandas()
    assert len(found) == len(rows)
    by = {i: found[found.doc_id == i] for i, *_ in rows if i is not None}
    assert by[10].text.item() == dict((r[0], r[1]) for r in rows)[10]
    assert by[11].text.item() == "start of eleven\nend of eleven" and by[11].gone.item() == 1
    assert by[4].text.item() is None and by[5].text.item() == "" and (found.gone.sum() == 1)
    assert line_dedup.dedup(empty).count() == 0


def test_hot_passage_is_deleted_from_all_but_the_first(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    docs = [(i, f"own {i}\n{passage}\nlast {i}") for i in range(300)]
    got = dict(line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got[0] == docs[0][1] and all(got[i] == f"own {i}\nlast {i}" for i in range(1, 300))


def words(t):
    return t.encode().lower().split() if t else []


def shingles(t, n=5):
    w = words(t)
    n = min(n, len(w))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()


def brute_components(docs, percent=80):
    sets = [shingles(t) for _, t in docs]
    top = list(range(len(docs)))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)].append(d)
    return sorted((str(d), len(sets[i]), min(least[find(i)]) if least[find(i)] else None) for i, (d, _) in enumerate(docs))


def chains(seed, n):
    """Documents that drift by single words, so that components are chains of links."""
    r = random.Random(seed)
    out = []
    for g in range(n // 12):
        w = [f"g{g}w{i}" for i in range(r.randint(8, 60))]
        for _ in range(12):
            w = w[:]
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = f"new{r.random()}"
            out.append(" ".join(w))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("many", [False, True])
def test_components_match_brute_force(spark, rows, many, monkeypatch):
    if many:
        monkeypatch.setattr(ngram_join, "PAIRS_A_ROW", -1e9)  # pivots go on while they help
    docs = chains(1, 24 if many else 96) + [(1000 + i if d is not None else None, t) for i, (d, t, _) in enumerate(rows)]
    got = ngram_join.component_of(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(g["doc_id"]), g["n_shingles"], g["component_id"]) for g in got) == brute_components(docs)


@pytest.mark.parametrize("percent", [50, 95])
def test_other_similarities_match_brute_force(spark, percent):
    docs = chains(percent, 60)
    docs += [(500 + i, " ".join(t.split()[: 4 + len(t.split()) // 2])) for i, (_, t) in enumerate(docs[:20])]  # sizes that differ by half
    got = ngram_join.component_of(spark.createDataFrame(docs, "doc_id long, text string"), percent).collect()
    assert sorted((str(g["doc_id"]), g["n_shingles"], g["component_id"]) for g in got) == brute_components(docs, percent)


def test_salted_tokens_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 1)  # nearly every shared token is dealt out by salts
    docs = chains(7, 72)
    index = ngram_join._index
    seen = []
    monkeypatch.setattr(ngram_join, "_index", lambda *a: seen.append(index(*a)) or seen[-1])
    got = ngram_join.component_of(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(g["doc_id"]), g["n_shingles"], g["component_id"]) for g in got) == brute_components(docs)


@pytest.mark.parametrize("short", [1, 0])
def test_names_that_sets_share_are_made_longer(spark, monkeypatch, short):
    monkeypatch.setattr(ngram_join, "SHORT", short)  # hardly any or no byte to tell sets apart by
    docs = chains(9, 36)
    got = ngram_join.component_of(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(g["doc_id"]), g["n_shingles"], g["component_id"]) for g in got) == brute_components(docs)


@pytest.mark.parametrize("drop", ["orders", "bits"])
def test_each_filter_alone_loses_nothing_and_refuses_something(spark, drop):
    import numpy as np

    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 200).astype(np.uint64)
    names, sets = [], []
    for k in range(60):  # sets that keep ever fewer tokens of the base
        own = base.copy()
        gone = r.choice(200, k, replace=False)
        own[gone] = r.integers(0, 1 << 63, k).astype(np.uint64)
        names.append(f"s{k:02d}".encode())
        sets.append(np.unique(own))
    rank = np.zeros(200, np.uint8)
    bits = [ngram_join.bitmap(np.unique(base)) if drop == "bits" else ngram_join.bitmap(s) for s in sets]
    prefix = lambda s, o: (ngram_join.rarest_first(s, rank[: len(s)], o)[: ngram_join.prefix_length(len(s)) if drop != "orders" else len(s)] >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist()
    rows = [(bytearray(i), len(s), b.tolist(), *(prefix(s, o) for o in ngram_join.ORDERS)) for i, s, b in zip(names, sets, bits, strict=True)]
    table = spark.createDataFrame(rows, "cid binary, n long, bits array<long>, p0 array<int>, p1 array<int>")
    pairs = spark.createDataFrame([(bytearray(names[0]), bytearray(x)) for x in names[1:]], "a binary, b binary")
    got = {bytes(x["b"]) for x in ngram_join._candidates(pairs, table, 80).collect()}
    similar = {n for n, s in zip(names[1:], sets[1:], strict=True) if 180 * len(np.intersect1d(s, sets[0])) >= 80 * (len(s) + len(sets[0]))}
    assert similar <= got
    if drop == "orders":
        assert len(got) < len(names) - 1


def test_join_edge_cases(docs, rows, empty):
    got = {r["doc_id"]: r for r in ngram_join.component_of(docs).collect()}
    assert got[2]["component_id"] == got[3]["component_id"] == 1
    assert got[14]["component_id"] == 7 and got[5]["component_id"] == 5 and got[4]["n_shingles"] == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert not {2, 3, 14} & set(ids) and {1, 4, 5, 6, 7, None} <= set(ids)
    assert ngram_join.component_of(empty).count() == 0


def test_containment_matches_brute_force(spark, docs, rows, empty):
    items = [(1, "GAMMA delta epsilon zeta eta theta iota kappa lambda"), (2, "one two"), (3, None), (4, ""), (5, " ".join(f"word{i}" for i in range(5, 30)) + " other words follow"), (6, "not there at all, ever, really"), (7, "t5x1 t5x2 t5x3 t5x4 t5x5 t5x6"), (7, "same row")]
    table = spark.createDataFrame([(*i, "extra") for i in items], "item_id long, text string, doc_id string")
    want = []
    for d, t, _ in rows:
        for i, q in items:
            n = min(5, len(words(q)))
            s = shingles(q)
            w = words(t)
            own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
            if s and 100 * len(s & own) >= 80 * len(s):
                want.append((str(d), i, len(s & own), len(s)))
    for limit in (10**6, 0):  # held by every worker, or joined by shuffles
        got = decontaminate.contained(docs, table, item_shingles=limit).collect()
        assert sorted((str(g["doc_id"]), *g[1:]) for g in got) == sorted(want)
    kept = decontaminate.clean(docs, table)
    assert kept.columns == docs.columns and kept.count() == len(rows) - sum(str(d) in {w[0] for w in want} for d, *_ in rows)
    assert decontaminate.contained(empty, table).count() == 0 == decontaminate.contained(docs, table.limit(0)).count()


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_signatures_can_t_be_missed(percent):
    for n in range(1, 700):
        k, needs = decontaminate.signature(n, percent)
        assert 1 <= needs <= k <= n and decontaminate.partition_of(n) // 2 < n <= decontaminate.partition_of(n)
        assert needs <= k - decontaminate.lacking(n, percent)
    # a long item needs more hits than a short one, all of a partition as many
    assert decontaminate.signature(40)[1] > decontaminate.signature(12)[1] > 1 and len({decontaminate.signature(n) for n in range(65, 129)}) == 1


def test_search_meets_brute_force_and_refuses_common_shingles():
    import numpy as np

    r = np.random.default_rng(4)
    common = r.integers(0, 1 << 63, 40).astype(np.uint64)
    items = [(i, np.unique(np.append(r.integers(0, 1 << 63, int(n)).astype(np.uint64), r.choice(common, min(int(n) // 3, 3), replace=False)))) for i, n in enumerate(r.integers(1, 200, 80))]
    index = decontaminate.Index(items, 80)
    assert len(index.partitions) > 4
    verified = found = 0
    for _ in range(300):
        own = [r.integers(0, 1 << 63, 500).astype(np.uint64), r.choice(common, 20, replace=False)]
        for i in r.choice(80, 3, replace=False):
            s = items[i][1]
            own.append(r.choice(s, int(np.ceil(len(s) * r.uniform(0.6, 1))), replace=False))  # scattered, more or less of it
        doc = np.concatenate(own)
        r.shuffle(doc)
        want = {(i, len(np.intersect1d(s, doc)), len(s)) for i, s in items if 100 * len(np.intersect1d(s, doc)) >= 80 * len(s)}
        assert set(index.search(doc)) == want
        found += len(want)
        met = set(np.intersect1d(doc, index.hashes).tolist())
        verified += sum(sum(h in met for h in s[: decontaminate.signature(len(s))[0]].tolist()) >= decontaminate.signature(len(s))[1] for _, s in items)
    touched = 300 * len([1 for _, s in items if np.intersect1d(s, common).size])
    assert found <= verified < 0.2 * touched


def test_lines_come_only_through_selected_positions(spark, monkeypatch):
    passage = "\n".join(" ".join(f"p{k}x{i}" for i in range(12)) for k in range(9))
    docs = spark.createDataFrame([(i, f"own {i}\n{passage}\nlast {i}") for i in range(5)], "doc_id long, text string")
    assert line_dedup.dedup(docs, deleted="n").agg({"n": "sum"}).first()[0] == 9 * 4
    # if every text's own lines were selected in place of the minima, no two texts would meet
    monkeypatch.setattr(line_dedup, "selected", lambda hashes, words, start, end: start * 0)
    assert line_dedup.dedup(docs, deleted="n").agg({"n": "sum"}).first()[0] == 0


def test_windows_of_lines_met_once_are_not_stored(spark, monkeypatch):
    passage = "\n".join(" ".join(f"p{k}x{i}" for i in range(12)) for k in range(9))
    own = lambda d: "\n".join(" ".join(f"d{d}l{k}x{i}" for i in range(12)) for k in range(200))
    docs = [(d, f"{own(d)}\n{passage}") for d in range(6)]
    stored = {}
    keep = line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name: stored.setdefault(name, keep(df, name)))
    monkeypatch.setattr(line_dedup, "discard", lambda *dfs: None)
    got = dict(line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got[0] == docs[0][1] and all(got[d] == own(d) for d in range(1, 6))
    assert stored["positions"].count() < 6 * 40  # of more than 6 * 400 windows


def test_selected_lines_are_minima():
    import numpy as np

    r = np.random.default_rng(0)
    for _ in range(50):
        n = int(r.integers(1, 40))
        h, w = r.integers(0, 9, n).astype(np.uint64), r.integers(0, 5, n)
        start, end = line_dedup.windows(w, 6)
        at = line_dedup.selected(h, w, start, end)
        for a, b, k in zip(start, end, at, strict=True):
            assert w[a:b].sum() >= 6 and k == min(range(a, b), key=lambda i: (w[i] == 0, h[i], i))
            assert w[a + 1 : b].sum() < 6 or w[a : b - 1].sum() < 6
        around = line_dedup.surroundings(h, start, end)
        runs = [tuple(h[a:b]) for a, b in zip(start, end, strict=True)]
        assert all((x == y) == (p == q) for x, p in zip(runs, around, strict=True) for y, q in zip(runs, around, strict=True))


def test_registered_line_query_matches_brute_force(spark, tmp_path):
    r = random.Random(5)
    pool = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 30))) for _ in range(14)]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 12)))) for i in range(80)] + [(80, None), (81, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in line_dedup.query(spark, f"file://{tmp_path}").collect()}
    want = brute_lines(docs, 50)
    assert [got[i]["text"] for i, _ in docs] == want
    assert sum(x["n_deleted"] for x in got.values()) > 0


def test_columns_with_inner_names_are_kept(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, f"own {i}\n{passage}", "a", "b", "c", "d", "e", "f") for i in range(4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, __key string, __runs string, __found string, __out string, __hit string, __row string")
    for out in (line_dedup.dedup(table), ngram_join.one_of_each(table), decontaminate.clean(table, spark.createDataFrame([(1, "quite another item of more than five words")], "item_id long, text string"))):
        assert out.dtypes == table.dtypes
        assert {tuple(r)[2:] for r in out.collect()} == {("a", "b", "c", "d", "e", "f")}
