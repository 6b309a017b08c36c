from collections import Counter, defaultdict

import duckdb
import pytest

from spillway.llm import mixing

from .conftest import make, prose


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_tokens():
    import pyarrow as pa

    texts = ["a b  c", "", None, " x\n", "a\tb", "é ü"]
    assert mixing.tokens(pa.array(texts)).tolist() == [len((t or "").split()) for t in texts]


def test_shares_follow_weights_in_every_prefix(spark):
    docs = make(spark, [(i, prose(i, 40), "en", "abc"[i % 3]) for i in range(600)])
    out = mixing.schedule(docs, {"a": 0.5, "b": 0.3, "c": 0.2}, block=80).toPandas()
    by_slot = out.drop_duplicates("slot").sort_values("slot")
    for n in (20, 50, len(by_slot)):
        share = Counter(by_slot.source[:n])
        for s, w in {"a": 0.5, "b": 0.3, "c": 0.2}.items():
            assert abs(share[s] / n - w) <= 3 / n + 0.02
    assert not out.doc_id.duplicated().any()
    blocks = defaultdict(set)
    for r in out.itertuples():
        blocks[r.source].add(r.block)
    assert all(min(b) == 0 for b in blocks.values())


def test_same_as_sql(spark, tmp_path):
    docs = make(spark, [(i, prose(i, 30 + i % 50) if i % 17 else None, "en", [None, "x", "y"][i % 3]) for i in range(900)])
    path = str(tmp_path / "documents.parquet")
    docs.toPandas().to_parquet(path)
    got = mixing.schedule(docs)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}'")
    assert rows_of(got) == sorted([tuple(x) for x in con.sql(mixing.ORACLE).fetchall()], key=str)


def test_edges(spark, edge):
    assert mixing.schedule(edge).count() > 0
    out = mixing.mixed(edge)
    assert set(out.columns) >= {"slot", "block", "block_place", "text", "keep"}
    assert mixing.mixed(edge, {"nowhere": 1.0}).count() == 0
    assert mixing.schedule(edge.limit(0)).count() == 0 and mixing.mixed(edge.limit(0)).count() == 0


def test_mixed_keeps_scheduled_rows(spark):
    docs = make(spark, [(i, prose(i, 40), "en", "ab"[i % 2]) for i in range(200)])
    a = {(r.doc_id, r.slot) for r in mixing.schedule(docs).collect()}
    b = {(r.doc_id, r.slot) for r in mixing.mixed(docs).collect()}
    assert a == b and a


@pytest.mark.parametrize("local", [1 << 24, 10])
def test_sources_that_are_used_up_leave(spark, monkeypatch, local):
    monkeypatch.setattr(mixing, "LOCAL", local)
    sizes = {"a": 300, "b": 40, "c": 4, "d": 1}
    docs = make(spark, [(i, prose(i, 40), "en", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))])
    weights, block = {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}, 80
    out = mixing.schedule(docs, weights, block=block, exhausted="leave").toPandas()
    assert sorted(out.doc_id) == list(range(sum(sizes.values())))
    mixed = mixing.mixed(docs, weights, block=block, exhausted="leave").toPandas()
    assert sorted(mixed.doc_id) == sorted(out.doc_id) and set(zip(out.doc_id, out.slot)) == set(zip(mixed.doc_id, mixed.slot))
    used = out.drop_duplicates("slot").sort_values("slot")
    live, at = dict(weights), 0
    while live:  # the shares hold among those that are left, until one of them is used up
        end = min(used[used.source == s].slot.max() for s in live)
        part = used[(used.slot >= at) & (used.slot <= end)]
        total = sum(live.values())
        for s, w in live.items():
            assert abs((part.source == s).sum() - len(part) * w / total) <= 4
        live = {s: w for s, w in live.items() if used[used.source == s].slot.max() > end}
        at = end + 1
    assert mixing.schedule(docs, {"a": 1.0}, exhausted="leave").count() == 300 and mixing.schedule(docs.limit(0), exhausted="leave").count() == 0


def test_one_small_source_among_many(spark):
    docs = make(spark, [(i, prose(i, 60), "en", "tiny" if i == 0 else f"s{i % 5}") for i in range(400)])
    assert mixing.schedule(docs, block=100, exhausted="leave").count() == 400
    named = docs.selectExpr("concat('d', doc_id) as doc_id", "text", "source", "1 as `__place`", "2 as `doc.x`")
    out = mixing.mixed(named, block=100, exhausted="leave")
    assert out.columns == [*named.columns, "slot", "block", "block_place"] and out.count() == 400
