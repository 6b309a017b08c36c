"""The pipeline's rows against stages of plain Python: dictionaries, whole matrices and all pairs."""

import hashlib
import math
import random

import numpy as np

import corpus_pipeline
from spillway.llm import decontaminate, importance
from spillway.llm import quality_rules as q

from .conftest import make, prose
from .test_decontaminate import least_edits, words
from .test_jaccard import brute as brute_classes
from .test_others import brute_weights
from .test_quality_rules import brute as brute_model


def middle(values):
    return sorted(values)[math.ceil(len(values) / 2) - 1]


def quality(docs, labels):
    """Documents within their language's band."""
    kept = []
    good = {i for i, quality, _ in labels if quality == 1}
    for lang in {x for _, _, x, _ in docs}:
        same = [d for d in docs if d[2] == lang and d[1]]
        p = brute_model([d[1] for d in same if d[0] in good] or [d[1] for d in same], q.ORDER)
        mean = {}
        for i, t, *_ in same:
            s = "\0" * (q.ORDER - 1) + t
            mean[i] = -sum(math.log(p(s[k - q.ORDER + 1 : k + 1])) for k in range(q.ORDER - 1, len(s))) / len(t)
        centre = middle(mean.values())
        sd = 1.4826 * middle([abs(mean[i] - centre) * math.sqrt(len(t)) for i, t, *_ in same])
        for d in same:
            off, root = mean[d[0]] - centre, math.sqrt(len(d[1]))
            if -max(q.LEAST, q.LOW * sd / root) <= off <= max(q.LEAST, q.HIGH * sd / root):
                kept.append(d)
    return kept


def classify(spark, docs, labels):
    """The k greatest sums of log weight and noise."""
    good = {i: quality == 1 and not toxic for i, quality, toxic in labels}
    hashed = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i, *_ in docs], "doc_id bigint").select("doc_id", importance.key("doc_id")).collect()}
    held = {i for i, h in hashed.items() if importance.mix(np.array([h], np.int64).view(np.uint64))[0] % importance.HELD == 0}
    weight = brute_weights([d[:3] for d in docs], {i for i in hashed if good.get(i) and i not in held})
    known = [i for i in weight if i in good and i in held]
    best, limit = 0.0, -math.inf
    n = [sum(good[i] == g for i in known) for g in (False, True)]
    for cut in sorted({weight[i] for i in known}, reverse=True) if all(n) else []:
        left = [sum(good[i] == g and weight[i] >= cut for i in known) for g in (False, True)]
        gain = importance.COST * (left[1] / n[1] - 1) + 1 - left[0] / n[0]
        if gain > best:
            best, limit = gain, cut
    noise = lambda i: -math.log(-math.log((int(hashlib.md5(f"{importance.SEED}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52))
    keys = {i: w + noise(i) for i, w in weight.items()}
    k = sum(w >= limit for w in weight.values())
    least = sorted(keys.values(), reverse=True)[k - 1]
    return [d for d in docs if keys[d[0]] >= least - 1e-9]


def clean(docs, bench):
    items = [words(t) for _, t in bench]
    return [d for d in docs if all(least_edits(m, words(d[1])) > int(len(m) * decontaminate.RATE) for m in items)]


def test_rows_are_those_of_plain_python(spark, tmp_path):
    rng, docs, labels = random.Random(4), [], []
    bench = [(i, prose(9000 + i, 22)) for i in range(2)]
    for i in range(90):
        w = prose(i, 60).split()
        if i % 6 == 0:
            w[3], w[20], w[40] = "scum", "moron", "loser"
        docs.append((i, " ".join(w), "de" if i % 5 == 0 else "en", "ab"[i % 2]))
        if i % 4:
            labels.append((i, 1, int(i % 6 == 0)))
    docs += [(500 + i, " | ".join(prose(i + 70, 60).upper().split()), "en", "a") for i in range(4)]
    labels += [(500 + i, 0, 0) for i in range(4)]
    for i in range(8):  # near copies
        w = docs[i * 3 + 1][1].split()
        w[rng.randrange(len(w))] = "ra"
        docs.append((600 + i, " ".join(w), docs[i * 3 + 1][2], "b"))
    docs += [(700 + i, f"{prose(400 + i, 30)} {t} {prose(500 + i, 30)}", "en", "a") for i, t in bench]
    docs += [(800, "", "en", "a"), (801, docs[7][1], docs[7][2], "b")]
    make(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "text", "lang", "source").collect()
    one = quality(docs, labels)
    two = classify(spark, one, labels)
    classes = brute_classes([d[:2] for d in two], 0.5)
    three = [d for d in two if classes[d[0]][0] == d[0]]
    four = clean(three, bench)
    assert len(docs) > len(one) > len(two) > len(three) > len(four) > 40
    assert sorted(map(tuple, got)) == sorted(four)
