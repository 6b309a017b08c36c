import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spillway.llm import common, html_text, importance, licenses, token_counts, url_rules

from .conftest import make, prose


# --- common
def test_words_are_those_of_a_regular_expression():
    texts = ["Ab c_d 12", None, "", "é,ß", "a" * 50, "x y", "..."]
    h, rows, s, e = common.words(pa.array(texts))
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())]
    data = "".join((t or "").lower() for t in texts).encode()
    assert [(int(r), data[a:b].decode()) for r, a, b in zip(rows, s, e)] == want
    seen = {}
    for x, (_, w) in zip(h.tolist(), want):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    assert (common.words(pa.array(["zz Ab"]).slice(0))[0][-1:] == h[:1]).all()


def test_grams():
    h, rows, _, _ = common.words(pa.array(["a b c d", "a b", None, "b c d"]))
    g, r = common.grams(h, rows, 3, 4)
    assert r.tolist() == [0, 0, 1, 3] and g[1] == g[3] and len(set(g.tolist())) == 3


# --- HTML
def test_html_rules():
    x = html_text.extract
    assert x(None) is None and x("") == ""
    assert x("<p>a<p>b<div>c</div>") == "a\n\nb\n\nc"
    assert x("<head><title>t</title></head><script>if (a<b) '</p>'</script><!-- no --><p>Hi &amp; <b>you</b><br>there") == "Hi & you\nthere"
    assert x("<p hidden>a</p><p style='color:red;display: none'>b</p><p style='visibility:hidden'>c</p><p>d") == "d"
    assert x("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>e") == "- a\n- b\n 3. c\n 4. d\n\ne"
    assert x("<table><tr><th>a<th>bb<tr><td>ccc<td>d</table>") == "a    bb\nccc  d"
    assert x("<table><tr><td colspan=2>wide one<tr><td>a<td>b</table>") == "wide one\na  b"
    assert x("<pre> a\n   b</pre>c") == "a\n   b\n\nc" or x("<pre> a\n   b</pre>c") == " a\n   b\n\nc"
    assert x("<a title='x>y'>t</a> <img alt=pic>") == "t pic"
    assert x("a < b <3 <p>c <!-- open") == "a < b <3\n\nc"
    assert x("</p></div>x</b>") == "x" and x("<div>" * 5000 + "deep") == "deep"
    assert x("<table>" * 60 + "<tr><td>in") == "in"
    assert x("one\n  two\t three") == "one two three"
    assert x("<select><option>a<option>b</select>").split() == ["a", "b"]


def test_text_in_tables_is_never_lost():
    x = html_text.extract
    assert x("<table><tbody><td>x</td></tbody></table>") == "x"
    assert x("<table><tr>text<td>cell</table>") == "text\n\ncell"
    assert x("<table><tr><form><td>a<td>b</form></tr></table>") == "a  b"
    assert x("<table><tbody><div>out</div><tr><td>in</tbody></table>") == "out\n\nin"
    assert x("<table><b>bold<tr><td>in</table>after") == "bold\n\nin\n\nafter"
    assert x("<table><td>a<td>b<tr><td>c</table>") == "a  b\nc"
    assert x("<table><caption>cap</caption><tr><td>a</table>") == "cap\na"
    assert x("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>") == "in  ner  out"
    assert x("<table><tr><td>a</table><table><tr><td>b</table>") == "a\n\nb"
    deep = x("<table><tr><td>a<td>" * 400 + "end")
    assert deep.split() == ["a"] * 400 + ["end"]


def test_spans_and_widths():
    x = html_text.extract
    assert x("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>") == "a  b\n   c\nd  e"
    assert x("<table><tr><td>x<td rowspan=0>y<tr><td>z<td>w</table>") == "x  y\nz     w"
    assert x("<table><tr><td>日本<td>b<tr><td>abcd<td>e<tr><td>e\u0301<td>f</table>") == "日本  b\nabcd  e\ne\u0301     f"


def test_visibility():
    x = html_text.extract
    assert x("<div style='visibility:hidden'>a<p style='visibility:visible'>b</p>c</div>d") == "b\n\nd"
    assert x("<svg><title>t</title><defs>n</defs><text>one</text><text>two</text></svg> <math><mi>x</mi><mo>=</mo></math> <object data=q>fall</object>") == "one two x= fall"
    assert x("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>") == "s\ns\nyes"
    assert x("<dialog>no</dialog><dialog open>yes</dialog><video>no</video><canvas>no</canvas>") == "yes"
    css = "<style>.h{display:none} /* .v{display:none} */ #i, p.q { color:red; visibility: hidden } @media print{.v{display:none}} .w{display:none} b.w{display:inline}</style>"
    assert x(css + "<p class='a h'>1</p><p class=v>2</p><p id=i>3</p><p class=q>4</p><div class=q>5</div><b class=w>6</b><i class=w>7</i><i class=w style='display:inline'>8</i>") == "2\n\n5\n68"


def test_lists_and_areas():
    x = html_text.extract
    assert x("<ol><li>a<li value=7>b<li>c</ol>") == "1. a\n7. b\n8. c"
    assert x("<ol reversed><li>a<li>b<li>c</ol>") == "3. a\n2. b\n1. c" and x("<ol reversed start=9><li>a<li>b</ol>") == "9. a\n8. b"
    assert x("<ol type=a start=26><li>a<li>b</ol><ol type=I><li>x<li value=4>y</ol>") == "z. a\naa. b\n\nI. x\nIV. y"
    assert x("a<textarea>\n1\n 2</textarea>b").split("\n")[-3:] == ["1", " 2", "b"]


def walk(rng, depth, visible, out):
    """A random tree as HTML; appends its visible words to ``out``, in order."""
    kind = rng.choice("text text text div p b ul ol pre hidden none visible details closed svg script".split()) if depth else "text"
    if kind == "text":
        word = f"w{rng.randrange(10**6)}"
        if visible:
            out.append(word)
        return f" {word} "
    inner = lambda v: "".join(walk(rng, depth - 1, v, out) for _ in range(rng.randrange(4)))
    if kind in ("script", "none", "closed"):
        held = len(out)
        body = "var x = '<p>';" if kind == "script" else inner(False)
        del out[held:]
        return {"script": f"<script>{body}</script>", "none": f"<div style='display:none'>{body}</div>", "closed": f"<dialog>{body}</dialog>"}[kind]
    if kind in ("hidden", "visible"):
        return f"<span style='visibility: {kind}'>{inner(kind == 'visible')}</span>"
    if kind in ("ul", "ol"):
        return f"<{kind}>" + "".join(f"<li>{inner(visible)}" for _ in range(rng.randrange(3))) + f"</{kind}>"
    if kind == "p":  # a block would end it
        return "<p>" + "".join(walk(rng, 0, visible, out) for _ in range(rng.randrange(4))) + "</p>"
    return f"<{kind} open>{inner(visible)}</{kind}>"


@pytest.mark.parametrize("seed", range(150))
def test_all_visible_text_and_nothing_else(seed):
    import random

    rng, want = random.Random(seed), []
    page = "".join(walk(rng, 5, True, want) for _ in range(5))
    got = [w for w in html_text.extract(page).split() if w.startswith("w")]
    assert got == want
    cells: list[list[str]] = [[], []]
    left, right = (walk(rng, 4, True, c) for c in cells)
    got = [w for w in html_text.extract(f"<table><tr><td>{left}<td>{right}</table>").split() if w.startswith("w")]
    assert sorted(got) == sorted(cells[0] + cells[1])


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (2, "u", None), (1, "u", "<p>a"), (3, None, ""), (None, "u", "<p>" + "long " * 300_000)], "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as `doc.x`")
    assert sorted(map(tuple, html_text.texts(pages).collect()), key=str) == sorted([(1, "a"), (1, "a"), (2, None), (3, ""), (None, ("long " * 300_000).strip())], key=str)
    assert html_text.texts(pages.limit(0)).count() == 0


# --- token counts
def test_token_counts_are_exact(spark, edge):
    enc = token_counts.encoding(token_counts.VOCABULARY)
    docs = edge.unionByName(make(spark, [(20 + i, prose(i, 300) + " <|endoftext|> it's 12345!?") for i in range(20)], [c for c in edge.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]))
    want = sorted((r.doc_id or -1, -1 if r.text is None else len(enc.encode_ordinary(r.text))) for r in docs.collect())
    for share in (1e-4, 0.5, 0.0):
        assert sorted((r.doc_id or -1, -1 if r.n_tokens is None else r.n_tokens) for r in token_counts.counts(docs, share=share).collect()) == want
    assert token_counts.counts(edge.limit(0)).count() == 0


# --- importance resampling
def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    values = [float(x) for x in np.concatenate([rng.normal(size=500), [3.25] * 20, [1e6, -1e6]])]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 10, 25, 300, 521):
        assert importance.kth_largest(df, "x", k, bins=16) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(df, "x", 10**6) == -np.inf


def test_toxic_goes_and_clean_stays(spark):
    bad = ["scum", "moron", "loser"]
    docs, labels = [], []
    for i in range(900):
        w = prose(i, 100).split()
        toxic = i % 6 == 0
        if toxic:
            w[5], w[50], w[70] = bad
        docs.append((i, " ".join(w)))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, 1, int(toxic)))
    df, lb = make(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id for r in importance.keep(df, lb).collect()}
    assert len([i for i in range(900) if i % 6 and i in kept]) >= 0.97 * 750
    assert len([i for i in range(0, 900, 6) if i in kept]) <= 0.15 * 150
    assert {r.doc_id for r in importance.score(df, lb).where("keep").collect()} == kept
    assert importance.score(df, lb, k=100).where("keep").count() == 100


def brute_weights(docs, target):
    """Log weights by dictionaries: docs are (id, text, lang), target is a set of ids. N-grams of one bucket are one."""
    grams, langs, half = {}, {}, importance.BUCKETS // 2

    def bucket(text, lang):
        return max(importance.buckets(pa.array([text]), pa.array([lang]))[1].tolist())

    for i, t, lang in docs:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
        grams[i] = Counter([bucket(x, lang) for x in w + re.findall(r"[^\s0-9A-Za-z\x80-\U0010ffff]+", t)] + [bucket(f"{a} {b}", lang) for a, b in zip(w, w[1:])])
        langs[i] = lang
    every = {g for c in grams.values() for g in c}
    order = [math.log(max(sum((g >= half) == n for g in every) / importance.INFORMATIVE, 1.0)) for n in (0, 1)]
    out = {}
    for i, c in grams.items():
        same = [j for j in grams if langs[j] == langs[i]]
        inner = [j for j in same if j in target]
        if not sum(sum(grams[j].values()) for j in inner):
            out[i] = 0.0
            continue
        s = sum(sum(grams[j].values()) for j in inner) / sum(sum(grams[j].values()) for j in same)
        q = len(inner) / len(same)
        total, others = 0.0, [j for j in grams if j != i]
        for g, n in c.items():
            t, r = sum(grams[j][g] for j in others if j in target), sum(grams[j][g] for j in others)
            a, m = sum(g in grams[j] for j in others if j in target), sum(g in grams[j] for j in others)
            gain = (a * math.log(a / (m * q)) if a else 0) + ((m - a) * math.log((m - a) / (m * (1 - q))) if m - a else 0)
            total += n * math.log((t + importance.PRIOR * s) / (r * s + importance.PRIOR * s)) / (1 + math.exp(order[g >= half] - gain))
        out[i] = total
    return out


def test_weights_against_brute_force(spark):
    docs = [(i, prose(i, 40) + (" !! scum" if i % 5 == 0 else " ."), "de" if i % 3 else "en") for i in range(60)] + [(90, "", "en"), (91, "only other words", "xx")]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(40)], "doc_id bigint, quality int, toxic int")
    ids, good = importance.targets(labels, 100)
    held = importance.mix(ids.view(np.uint64)) % np.uint64(importance.HELD) == 0
    number = {r[0]: r[1] for r in make(spark, docs).select("doc_id", importance.key("doc_id")).collect()}
    want = brute_weights(docs, {i for i in number if number[i] in set(ids[good & ~held].tolist())})
    got = {r.doc_id: r.log_weight for r in importance.score(make(spark, docs), labels).collect()}
    assert got.keys() == want.keys() and any(want.values())
    assert all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_ties_in_keys_stay_together(spark):
    docs = make(spark, [(i // 3, prose(i // 3, 30)) for i in range(60)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id bigint, quality int, toxic int")
    for k in (1, 10, 30):
        kept = importance.score(docs, labels, k=k).groupBy("doc_id").agg({"keep": "count", "gumbel_key": "min"}).count()
        rows = importance.score(docs, labels, k=k).where("keep").groupBy("doc_id").count().collect()
        assert kept == 20 and all(r["count"] == 3 for r in rows) and len(rows) == -(-k // 3)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_toxic_documents_go_in_a_small_table(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = importance.score(docs, labels).join(labels, "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {(r.quality, r.toxic): r.kept for r in rows}
    assert kept[1, 0] >= 0.96 and kept[1, 1] <= 0.4 and kept[0, 0] <= 0.4


def test_importance_edges(spark, edge):
    labels = spark.createDataFrame([(6, 1, 0), (5, 0, 0), (None, 1, 0), (8, None, None)], "doc_id bigint, quality int, toxic int")
    assert importance.score(edge, labels).count() == edge.count()
    assert importance.keep(edge, labels.limit(0)).count() == edge.count()
    assert importance.keep(edge, labels).columns == edge.columns
    named = edge.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", "lang")
    assert importance.score(named, labels.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "quality", "toxic")).count() == edge.count()
    assert importance.score(edge.limit(0), labels).count() == 0 and importance.keep(edge.limit(0), labels).count() == 0


# --- URL rules
def test_url_rules_against_all_rules_on_all_urls(spark):
    urls = ["http://m.free-bets.example.com/en/27#top", "https://FREE-BETS.example.com/", "http://a.example.net/fr/3.html", "", None, "x", "http://blog.tionsh.example.com/en/1?page=2&ref=x", "http://a.bit.ly/", "https://bit.ly/a"] * 2
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").selectExpr("*", "'z' as token", "'z' as n", "1 as rule_id")
    want = sorted((i, r) for i, u in enumerate(urls) for r, _, p in url_rules.RULES if u is not None and re.search(url_rules.regex(p), u.lower()))
    assert sorted((r.page_id, r.rule_id) for r in url_rules.matches(pages).collect()) == want
    assert sorted((r.page_id, r.rule_id) for r in url_rules.matches(pages, few=0).collect()) == want
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url").toPandas())
    assert sorted((a, c) for a, _, c, _ in con.sql(url_rules.ORACLE).fetchall()) == want
    assert url_rules.matches(pages.limit(0)).count() == 0
    assert None in [r.url for r in url_rules.keep(pages, ["gambling"]).collect()]


def test_literals_are_whole_tokens():
    assert url_rules.literals("||free-bets.example.com^") == ["bets", "com", "example", "free"]
    assert url_rules.literals("*casino*") == [] and url_rules.literals("/ad*x/") == [] and url_rules.literals("#top|") == ["top"]


# --- licenses
def lis(seq):
    best = []
    for i, x in enumerate(seq):
        best.append(1 + max([best[j] for j in range(i) if seq[j] < x], default=0))
    return max(best, default=0)


def test_increasing_is_longest():
    rng = np.random.default_rng(1)
    for _ in range(50):
        seq = rng.permutation(30).tolist()
        got = [seq[i] for i in licenses.increasing(seq)]
        assert got == sorted(got) and len(got) == lis(seq)


def test_patience_aligns_in_order():
    a, b = "a b c d e f g h".split(), "x a b y d d e q f h".split()
    got = licenses.patience(a, b)
    assert all(a[i] == b[j] for i, j in got) and got == sorted(got)
    assert [a[i] for i, _ in got] == ["a", "b", "d", "e", "f", "h"]


def test_license_scan(spark, edge):
    name, mit = next(t for t in licenses.TEMPLATES if t[0] == "MIT")
    w = mit.split()
    w[10], w[40] = "zzz", "yyy"
    docs = [(1, prose(1, 300) + " " + mit + " " + prose(2, 300)), (2, prose(3, 5000) + "\n" + " ".join(w)), (3, " ".join(w[: len(w) // 2])), (4, "Licensed under CC BY-NC 4.0. " + prose(4, 50)), (5, prose(5, 400)), (6, "the license of the work is under the version")]
    got = {(r.doc_id, r.license): r.coverage for r in licenses.scan(make(spark, docs)).collect()}
    assert got[1, "MIT"] == 1 and 0.95 < got[2, "MIT"] < 1 and (3, "MIT") not in got
    assert got[4, "CC-BY-NC-4.0-notice"] == 1 and not [k for k in got if k[0] in (5, 6)]
    assert licenses.scan(edge).count() == 0 and licenses.scan(edge.limit(0)).count() == 0
    assert licenses.scan(edge, [("none", "...")]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_scan_misses_nothing_that_whole_alignment_finds(seed):
    rng = np.random.default_rng(seed)
    library = licenses.Library(licenses.TEMPLATES, 0.8)
    for name, t in licenses.TEMPLATES:
        w = t.split()
        w = [x for x in w if rng.random() > 0.05]
        text = prose(seed, 400) + " " + " ".join(w) + " " + prose(seed + 9, 400)
        found = {library.names[f[1]]: f[2] for f in library.scan(pa.array([text]))}
        template, words, *_ = library.words[library.names.index(name)], common.words(pa.array([" ".join(w)]))[0].tolist()
        whole = len(licenses.patience(template, words)) / len(template)
        if whole >= 0.8:
            assert found.get(name, 0) >= 0.8


def test_repeated_licenses_and_coverage_at_the_threshold(spark):
    mit = dict(licenses.TEMPLATES)["MIT"]
    n = len(mit.split())
    docs = [
        (1, "intro Released under the MIT License and Released under the MIT License outro"),
        (2, "Copyright X " + mit + " Copyright Y " + mit),
        (3, "Released under an MIT License"),
        (4, " ".join(["Released under the MIT License."] * 5)),
        (5, " ".join(mit.split()[: n // 3]) + " Copyright X " + mit + " Copyright Y " + " ".join(mit.split()[n // 2 :])),
        (6, "Released under an old License"),
        (7, "under the MIT License. Released under the changed MIT License. Released under the"),
    ]
    got = {(r.doc_id, r.license): (r.coverage, r.first_word, r.last_word) for r in licenses.scan(make(spark, docs)).collect()}
    assert got[1, "MIT-notice"] == (1.0, 1, 5) and got[4, "MIT-notice"] == (1.0, 0, 4)
    assert got[2, "MIT"][:2] == (1.0, 2) and got[5, "MIT"][0] == 1.0
    assert got[3, "MIT-notice"] == (0.8, 0, 4) and got[7, "MIT-notice"] == (1.0, 4, 9)
    assert not any(d == 6 for d, _ in got)


def test_every_template_is_found_whole_and_in_groups(spark):
    docs = make(spark, [(i, prose(i, 200) + "\n" + t + "\n" + prose(i + 50, 200)) for i, (_, t) in enumerate(licenses.TEMPLATES)])
    rows = {(r.doc_id, r.license, r.coverage) for r in licenses.scan(docs).collect()}
    assert {(i, n, 1.0) for i, (n, _) in enumerate(licenses.TEMPLATES)} <= rows
    assert {(r.doc_id, r.license, r.coverage) for r in licenses.scan(docs, limit=900).collect()} == rows
    assert not [r for r in rows if r[1] == "BSD-3-Clause" and licenses.TEMPLATES[r[0]][0] == "MIT"]
