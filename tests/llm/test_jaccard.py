import random
import re

import duckdb
import numpy as np
import pytest

from spillway.llm import exchange
from spillway.llm import jaccard as j

from .conftest import make, prose


def grams(t, n=3):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else None


def brute_links(docs, t):
    """Similar pairs of (id, text) rows, as places in the list."""
    s = [grams(text) if i is not None else None for i, text in docs]
    return [(a, b) for b in range(len(s)) for a in range(b) if s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= t]


def brute(docs, t):
    """doc_id -> (class_id, links)."""
    root, links = list(range(len(docs))), [0] * len(docs)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute_links(docs, t):
        links[a] += 1
        links[b] += 1
        root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: (least[find(k)], links[k]) for k, (i, _) in enumerate(docs)}


def copies(seed=3, groups=25):
    rng, docs, i = random.Random(seed), [], 0
    for g in range(groups):
        base = prose(1000 + g, rng.choice([4, 30, 120])).split()
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.randrange(len(w) // 12 + 1)):
                w[rng.randrange(len(w))] = "zz" + str(rng.randrange(1000))
            docs.append((i, " ".join(w)))
            i += 1
    head = prose(7, 25)  # a passage that many documents share
    docs += [(i + k, head + " " + prose(2000 + k, 90)) for k in range(40)]
    return docs + [(i + 40, docs[0][1]), (i + 41, docs[0][1].upper())]


def classes(spark, docs, **sizes):
    return {r.doc_id: (r.class_id, r.links) for r in j.classes(make(spark, docs), **sizes).collect()}


def test_keys_survive_packing():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 100_000, 300_000):
        k = np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64))
        assert (exchange.ungap(exchange.gaps(k)) == k).all() and (exchange.ungap(exchange.gaps(k >> np.uint64(3))) == k >> np.uint64(3)).all()
        assert n < 300_000 or len(exchange.gaps(k)) < 4.6 * n
        rows = list(exchange.addressed(3, 1, k, 7, lambda a, b: (np.arange(a, b, dtype=np.uint32),)))
        assert [r[0] for r in rows] == sorted({int(x) for x in exchange.part_of(k, 7)})
        got = [exchange.unpack(r[3]) for r in rows]
        assert not n or (np.concatenate([exchange.ungap(g[0]) for g in got]) == k).all() and (np.concatenate([g[1] for g in got]) == np.arange(n)).all()


def test_trie_join_is_exact():
    rng = random.Random(1)
    for t in (0.3, 0.5, 0.8):
        sets = list({frozenset(rng.sample(range(40), rng.randrange(1, 30))) for _ in range(60)} | {frozenset(range(20)), frozenset(range(20)) | {77}, frozenset(range(21))})
        members, size = [np.array(sorted(s), np.uint64) for s in sets], np.array([len(s) for s in sets])
        want = {(a, b): len(sets[a] & sets[b]) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}
        assert {(int(a), b): int(o) for i, b, overlap in j.similar(members, size, t) for a, o in zip(i, overlap)} == want
        left = np.arange(len(sets)) % 2 == 0
        got = {(min(int(a), b), max(int(a), b)): int(o) for i, b, overlap in j.similar(members, size, t, left) for a, o in zip(i, overlap)}
        assert got == {k: v for k, v in want.items() if (k[0] + k[1]) % 2}


@pytest.mark.parametrize("sizes", [{}, {"unit": 500, "part": 700, "cell": 3}])
def test_classes_against_brute_force(spark, sizes):
    docs = copies()
    assert classes(spark, docs, **sizes) == brute(docs, j.THRESHOLD)


def test_pairs_against_brute_force(spark):
    docs = copies()
    least = {}
    for i, t in docs:
        least.setdefault(grams(t), i)
    want = {tuple(sorted((least[grams(docs[a][1])], least[grams(docs[b][1])]))) for a, b in brute_links(docs, j.THRESHOLD) if grams(docs[a][1]) != grams(docs[b][1])}
    got = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in j.pairs(make(spark, docs), cell=4).collect()}
    text = dict(docs)
    assert set(got) == want
    assert all(abs(s - len(grams(text[a]) & grams(text[b])) / len(grams(text[a]) | grams(text[b]))) < 1e-9 for (a, b), s in got.items())


def test_same_as_sql(spark):
    docs = copies(8, 15) + [(900, None), (901, ""), (902, "..."), (903, "one"), (904, "One!")]
    con = duckdb.connect()
    con.register("documents", make(spark, docs).toPandas())
    assert {a: (b, c) for a, b, c in con.sql(j.ORACLE).fetchall()} == classes(spark, docs)


def test_a_group_of_near_copies_in_blocks(spark):
    base, docs = prose(5, 80).split(), []
    for i in range(70):
        w = list(base)
        w[i] = f"own{i}"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, docs[3][1]) for i in range(30)]
    assert classes(spark, docs, cell=9) == classes(spark, docs) == {i: (0, 99) for i, _ in docs}
    assert [r.doc_id for r in j.keep(make(spark, docs), cell=9).collect()] == [0]


def test_one_of_each_group_stays(spark):
    docs = copies()
    want = {c for c, _ in brute(docs, j.THRESHOLD).values()}
    assert {r.doc_id for r in j.keep(make(spark, docs)).collect()} == want


def test_rows_that_share_a_doc_id(spark):
    docs = [(0, "one two three"), (1, "one two three"), (1, "totally different words here"), (1, "totally different words here"), (1, ""), (2, "One, two, three")]
    kept = sorted((r.doc_id, r.text) for r in j.keep(make(spark, docs)).collect())
    assert kept == [(0, "one two three"), (1, ""), (1, "totally different words here")]
    assert sorted((r.doc_id, r.class_id, r.links) for r in j.classes(make(spark, docs)).collect()) == [(0, 0, 2), (1, 0, 2), (1, 1, 0), (1, 1, 0), (1, 1, 0), (2, 0, 2)]


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (3, 9), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (9, 40)]
    got = {r.id: r.root for r in j.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{x: 1 for x in (1, 2, 3, 9, 40)}, 10: 10, 11: 10, **{x: 20 for x in range(20, 26)}}


def test_edges(spark, edge):
    assert j.pairs(edge).count() == 0
    out = j.keep(edge)
    assert out.columns == edge.columns and out.count() == edge.count() - 1  # the repeated row
    assert j.pairs(edge.limit(0)).count() == 0 and j.keep(edge.limit(0)).count() == 0 and j.classes(edge.limit(0)).count() == 0
    assert j.classes(edge).count() == edge.count()
    rows = make(spark, [(1, "a"), (2, "A."), (3, "b")])
    assert j.pairs(rows).count() == 0 and sorted(map(tuple, j.classes(rows).collect())) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]
    named = rows.selectExpr("concat('d', doc_id) as doc_id", "text")
    assert sorted(map(tuple, j.classes(named).collect())) == [("d1", "d1", 1), ("d2", "d1", 1), ("d3", "d3", 0)]
    assert sorted(r.doc_id for r in j.keep(named).collect()) == ["d1", "d3"]


def test_all_sizes_of_sets(spark):
    docs, k = [], 0
    for g in range(40):
        w = [f"w{g}x{i}" for i in range(300)]
        docs += [(2 * g, " ".join(w[: 230 + g])), (2 * g + 1, " ".join(w[: 240 + g]))]
    text = " ".join(f"twice{i}" for i in range(200))
    docs += [(500, text), (501, text + " " + text), (502, " ".join(f"half{i}" for i in range(100))), (503, " ".join(f"half{i}" for i in range(51)))]
    assert classes(spark, docs) == brute(docs, j.THRESHOLD)
