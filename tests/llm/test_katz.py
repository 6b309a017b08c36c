import math
import re
from collections import Counter

import pytest

from spillway.llm import katz as k

from .conftest import make, prose


def split(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


class Brute:
    """Katz backoff with dictionaries."""

    def __init__(self, texts):
        self.n = {1: Counter(), 2: Counter(), 3: Counter()}
        self.context = {1: Counter(), 2: Counter()}
        for t in texts:
            for h, x in self.events(t):
                for m in range(len(h) + 1):
                    self.n[m + 1][(*h[len(h) - m :], x)] += 1
                    if m:
                        self.context[m][h[len(h) - m :]] += 1
        self.d = {m: k.discounts([sum(r == i for r in c.values()) for i in range(k.K + 2)]) for m, c in self.n.items()}
        self.total = sum(self.n[1].values())
        self.children = {}
        for m in (2, 3):
            for g, r in self.n[m].items():
                if r >= k.CUT:
                    self.children.setdefault(g[:-1], []).append(g[-1])
        self.left = 1 - sum(self.p((), x[0]) for x in self.n[1])
        self.backed = Counter()

    def events(self, t):
        w = split(t)
        seq = ["<s>", *w, "</s>"]
        return [(tuple(seq[max(0, i - 2) : i]), seq[i]) for i in range(1, len(seq))] if w else []

    def p(self, h, x):
        r = self.n[len(h) + 1].get((*h, x), 0)
        if not h:
            return float(self.d[1](r)) * r / self.total if r else self.left
        if r >= k.CUT:
            return float(self.d[len(h) + 1](r)) * r / self.context[len(h)][h]
        return self.alpha(h) * self.p(h[1:], x)

    def alpha(self, h):
        seen = self.children.get(h, [])
        return (1 - sum(self.p(h, x) for x in seen)) / (1 - sum(self.p(h[1:], x) for x in seen))

    def log(self, t):
        return sum(math.log(self.p(h, x)) for h, x in self.events(t))


TEXTS = [prose(i, 80) for i in range(40)] + [prose(3, 80), "ba ne ba ne ba ne", "x"]


def scores(spark, trained, texts, unit=10**6, part=10**6):
    model = k.train(k.units(make(spark, list(enumerate(trained))), unit), part)
    got = k.score(k.units(make(spark, list(enumerate(texts))), unit), model).collect()
    return {r.doc_id: r for r in got}


@pytest.mark.parametrize("unit,part", [(10**6, 10**6), (300, 500)])
def test_scores_are_brute_force(spark, unit, part):
    model = Brute(TEXTS)
    tokens = k.units(make(spark, list(enumerate(TEXTS))), unit)
    trained = k.train(tokens, part)
    for rows in (k.score(tokens, trained, trained.answers), k.score(tokens, trained)):
        got = {r.doc_id: r for r in rows.collect()}
        assert len(got) == len(TEXTS)
        for i, t in enumerate(TEXTS):
            assert got[i].log_prob == pytest.approx(model.log(t), rel=1e-9) and got[i].n_tokens == len(split(t))
            assert got[i].perplexity == pytest.approx(math.exp(-model.log(t) / (len(split(t)) + 1)), rel=1e-9)


def test_other_texts_and_unknown_words(spark):
    model, new = Brute(TEXTS), [prose(900, 50), "ba zzz ne", "qqq www", "mi", "", "ba ne ba ne", "x x"]
    got = scores(spark, TEXTS, new, 200, 300)
    assert all(got[i].log_prob == pytest.approx(model.log(t), rel=1e-9) for i, t in enumerate(new))


def test_every_history_sums_to_one():
    model = Brute(TEXTS)
    words = [g[0] for g in model.n[1]]
    for h in [(), ("<s>",), ("never",), ("never", "ba"), *list(model.context[1])[:10], *list(model.children)[:40]]:
        assert sum(model.p(h, x) for x in [*words, "unknown"]) == pytest.approx(1)


def test_discounts_always_leave_mass():
    for n in ([0] * 7, [0, 5, 0, 0, 0, 0, 0], [0, 100, 40, 20, 12, 8, 5], [0, 1, 50, 2, 9, 9, 9], [0, 0, 3, 0, 0, 0, 1]):
        d = k.discounts(n)
        assert all(0 < float(d(r)) < 1 for r in [*range(1, 12), 1000])
    d = k.discounts([0, 100, 40, 20, 12, 8, 5])
    common = 6 * 5 / 100
    assert float(d(1)) == pytest.approx((2 * 40 / 100 - common) / (1 - common))


def test_tokens_really_back_off_and_copies_stand_out(spark, tmp_path):
    texts = [prose(i, 120) for i in range(60)]
    texts[50:60] = texts[:10]
    make(spark, list(enumerate(texts))).toPandas().to_parquet(tmp_path / "documents.parquet")
    model = Brute(texts)
    kinds = Counter(3 if model.n[3].get((*h, x), 0) >= k.CUT else 2 if model.n[2].get((*h[-1:], x), 0) >= k.CUT else 1 for t in texts for h, x in model.events(t))
    assert min(kinds.values()) > 0.1 * sum(kinds.values())
    got = {r.doc_id: r.perplexity for r in k.op5_lm_scoring(spark, str(tmp_path)).collect()}
    assert all(got[i] == pytest.approx(math.exp(-model.log(t) / (len(split(t)) + 1)), rel=1e-9) for i, t in enumerate(texts))
    assert max(got[i] for i in [*range(10), *range(50, 60)]) < min(got[i] for i in range(10, 50))


def test_edges(spark, edge):
    tokens = k.units(edge)
    out = k.score(tokens, m := k.train(tokens), m.answers).collect()
    assert {(1, 0), (2, 0), (3, 0), (5, 1), (6, 4), (None, 4)} <= {(r.doc_id, r.n_tokens) for r in out} and len(out) == edge.count()
    assert all(r.perplexity is None and r.log_prob == 0 for r in out if not r.n_tokens)
    assert len({r.log_prob for r in out if r.doc_id == 6}) == 1
    none = k.units(edge.limit(0))
    assert k.score(none, k.train(none)).count() == 0
    named = k.units(edge.selectExpr("concat('d', doc_id) as doc_id", "text"))
    assert {r.doc_id for r in k.score(named, m).collect()} == {None, *(f"d{i}" for i in range(1, 9))}
