import random

import numpy as np
import pyarrow as pa
import pytest

from spillway.llm import decontaminate as d

from .conftest import make, prose


def edited(text, n, seed):
    rng, s = random.Random(seed), list(text)
    for _ in range(n):
        i = rng.randrange(1, len(s) - 1)
        kind = rng.randrange(3)
        if kind == 0:
            s[i] = "q"
        elif kind == 1:
            del s[i]
        else:
            s.insert(i, "q")
    return "".join(s)


def least_edits(item, text):
    """Semi-global edit distance, whole matrix."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, e in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != e), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def words(t):
    data, offsets = d.normalise(pa.array([t]))
    return data.tobytes()


def test_normalise():
    data, offsets = d.normalise(pa.array(["Ab,  c!", None, "", "é", "x.", "..a"]))
    assert [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])] == ["ab c ", "", "", "é ", "x ", "a "]


def test_found_up_to_the_budget(spark):
    items = [(i, prose(500 + i, 40)) for i in range(12)]
    docs, want = [], set()
    for i, t in items:
        for n in (0, 2, 5, 30):
            e = edited(t, n, i)
            docs.append((100 * i + n, prose(i, 200) + " " + e + " " + prose(i + 50, 100)))
    docs.append((9999, prose(77, 3000)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in d.find(make(spark, docs), bench).collect()}
    for doc, text in docs:
        for item, t in items:
            m = words(t)
            best = least_edits(m, words(text)) if doc // 100 == item or doc == 9999 else None
            if best is None:
                assert (doc, item) not in got
            elif best <= int(len(m) * d.RATE):
                assert got[(doc, item)] == best
            else:
                assert (doc, item) not in got
    assert {r.doc_id for r in d.keep(make(spark, docs), bench).collect()} == {i for i, _ in docs} - {a for a, _ in got}
    sharded = {(r.doc_id, r.item_id): r.edits for r in d.find(make(spark, docs), bench, shard=300).collect()}
    assert sharded == got
    del want


def test_align_is_edit_distance():
    rng = random.Random(5)
    for t in range(60):
        item = words(prose(t, 12))
        k = 6
        inner = edited(item.decode(), rng.randrange(9), t).encode()
        text = b"zz " + inner + b" yyyy"
        found = d.align(item, np.frombuffer(text, np.uint8), k, 3 + 4 * k)
        best = least_edits(item, text)
        assert (found[0] if found else None) == (best if best <= k else None)


def test_edges(spark, edge):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, "same text here again"), (4, "same text here again")], "item_id bigint, text string")
    got = sorted((r.doc_id or -1, r.item_id) for r in d.find(edge, bench).collect())
    assert got == [(5, 3), *[(6, 4)] * 4]
    assert d.keep(edge, bench).columns == edge.columns and d.keep(edge, bench).count() == edge.count() - 3
    assert d.find(edge, bench.limit(0)).count() == 0 and d.find(edge.limit(0), bench).count() == 0


@pytest.mark.parametrize("m", [13, 40, 95])
def test_short_items_keep_a_bound(m):
    index = d.Index([1], [("ab " * 60)[:m]], d.Q, d.RATE)
    assert (index.bound >= 1).all()


def test_ids_of_any_type(spark, edge):
    bench = spark.createDataFrame([("a", "same text here again")], "item_id string, text string")
    named = edge.selectExpr("concat('d', doc_id) as doc_id", "text")
    assert [tuple(r)[:2] for r in d.find(named, bench).collect()] == [("d6", "a")] * 2 and d.keep(named, bench).count() == named.count() - 2
