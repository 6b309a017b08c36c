import random

import pytest

import __spark_entry__
import corpus_pipeline
from spillway.llm import decontaminate, jaccard

from .conftest import CLASH, DOCS, make, prose
from .test_jaccard import grams


@pytest.fixture
def corpus(spark, tmp_path):
    rng, docs, labels = random.Random(2), [], []
    bench = [(i, prose(9000 + i, 40)) for i in range(5)]
    for i in range(400):
        w = prose(i, 100).split()
        if i % 8 == 0:
            w[3], w[40], w[60] = "scum", "moron", "loser"
        docs.append((i, " ".join(w), "en", "ab"[i % 2]))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 1, int(i % 8 == 0)))
    for i in range(20):  # junk
        docs.append((1000 + i, " | ".join(prose(i + 70, 100).upper().split()), "en", "a"))
        labels.append((1000 + i, 0, 0))
    for i in range(20):  # near copies
        w = docs[i * 3 + 1][1].split()
        for _ in range(3):
            w[rng.randrange(len(w))] = "ra"
        docs.append((2000 + i, " ".join(w), "en", "b"))
    for i, (_, t) in enumerate(bench):
        docs.append((3000 + i, prose(400 + i, 60) + " " + t + " " + prose(500 + i, 60), "en", "a"))
    make(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs, bench


def test_run(spark, corpus):
    path, docs, bench = corpus
    out = corpus_pipeline.run(spark, path).toPandas()
    kept = set(out.doc_id)
    assert not kept & set(range(1000, 1020)) and not kept & set(range(3000, 3005))
    assert len(kept & set(range(0, 400, 8))) <= 8
    texts = {d[0]: grams(d[1]) for d in docs if d[0] in kept}
    ids = list(texts)
    assert all(len(texts[a] & texts[b]) / len(texts[a] | texts[b]) < 0.5 for i, a in enumerate(ids) for b in ids[:i])
    assert not out.doc_id.duplicated().any() and {"slot", "block", "block_place"} <= set(out.columns)
    assert len(kept) >= 0.7 * 350


def test_stages_one_by_one(spark, corpus):
    path, docs, bench = corpus
    df = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = df
        df = stage(spark, df, path)
        assert df.columns == before.columns and df.count() < before.count(), name
        df = spark.createDataFrame(df.collect(), before.schema)
    assert decontaminate.find(df, spark.read.parquet(f"{path}/benchmark.parquet")).count() == 0
    assert jaccard.pairs(df).count() == 0


def test_stages_take_edges(spark, corpus, edge):
    path, *_ = corpus
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, edge, path).count() <= edge.count(), name
        assert stage(spark, spark.createDataFrame([], DOCS), path).count() == 0, name


def test_registered(spark):
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names) and CLASH
