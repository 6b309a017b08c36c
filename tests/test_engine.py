import json
import random
import time

import pytest
from pyspark.sql import functions as F

from spillway import sinks, sources
from spillway.functions import paths, regex, substitution, timefmt
from spillway.functions.normalize import Normalizer
from spillway.operators.limits import Antispam, distribute
from spillway.operators.mask import mask_text
from spillway.operators.parse import unescape
from spillway.operators.project import level_number
from spillway.plans import config
from spillway.plans.pipeline import Pipeline, apply, play
from spillway.streaming import Cardinality, Joiner, Limiter


def one(spark, column):
    return spark.range(1).select(column).first()[0]


# --- functions -------------------------------------------------------------------------------------
def test_paths():
    assert paths.parse(r"a.b\.c.d") == ["a", "b.c", "d"] and paths.build(["a", "b.c"]) == r"a.b\.c" and paths.parse("") == []
    assert paths.outermost(["a.b", "a", "c.d"]) == [["a"], ["c", "d"]]


@pytest.mark.parametrize(
    "pattern, text, want",
    [("a$", "a\n", False), ("a.c", "a\rc", True), ("a.c", "a\nc", False), (r"\bab\b", "é ab", True), (r"(?P<x_y>b)", "abc", True), (r"[[:alpha:]]+\d", "ab1", True), (r"^\s$", "\x0b", False), (r"(?i)É", "é", True), (r"[a&&b]", "&", True), (r"\pL", "é", True)],
)
def test_regex(spark, pattern, text, want):
    assert one(spark, F.lit(text).rlike(regex.java(pattern))) is want
    assert bool(regex.python(pattern).search(text)) is want


def test_regex_boundary_is_ascii(spark):
    assert one(spark, F.regexp_replace(F.lit("aé b"), regex.java(r"\b(\w+)\b"), "*")) == "*é *"


@pytest.mark.parametrize(
    "fmt, text, want",
    [
        ("rfc3339", "2022-02-07T13:06:14Z", 1644239174), ("rfc3339nano", "2022-02-07T13:06:14.123456789+03:00", 1644228374), ("2006/01/02 15:04:05", "2022/02/07 13:06:14", 1644239174),
        ("unixtime", "998578999.1346", 998578999), ("unixtimemilli", "998578999134", 998578999), ("ansic", "Mon Feb  7 13:06:14 2022", 1644239174), ("rfc1123z", "Mon, 07 Feb 2022 13:06:14 +0000", 1644239174),
        ("rubydate", "Mon Feb 07 13:06:14 +0000 2022", 1644239174), ("nginx_errorlog", "2022/02/07 13:06:14", 1644239174), ("rfc3339", "yesterday", None), ("unixtime", "", None),
    ],
)
def test_time_formats(spark, fmt, text, want):
    assert one(spark, timefmt.to_format(timefmt.parse(F.lit(text), fmt), "unixtime")) == want


def test_time_printing(spark):
    ts = F.timestamp_micros(F.lit(1644239174120000))
    assert one(spark, timefmt.to_format(ts, "rfc3339nano")) == "2022-02-07T13:06:14.12Z"
    assert one(spark, timefmt.to_format(ts, "unixtimenano")) == 1644239174120000000
    assert one(spark, timefmt.to_format(ts, "rfc1123")) == "Mon, 07 Feb 2022 13:06:14 UTC"


@pytest.mark.parametrize(
    "filters, text, want",
    [
        (r"re('(\d+)',-1,[1],',')", "a1b22", "1,22"), (r"re('(\d+)',1,[1],',')", "a1b22", "1"), (r"re('x',-1,[0],',')", "ab", "ab"), (r"re('x',-1,[0],',',true)", "ab", ""), (r"re('a',0,[0],',')", "a", "a"),
        (r"re('(a)(b)?',-1,[1,2],'-')", "abXa", "a-b-a"), ("trim('all','\\n ')", " \nx\n ", "x"), ("trim_to('left','{')", "xx{y}", "{y}"), ("trim_to('right','}')", "{y}zz", "{y}"), ("trim_to('all','}')", "ab", "ab"),
        ("cut('first',2)", "abc", "ab"), ("cut('last',5)", "abc", "abc"), ("cut('last',2)|trim('left','b')", "abc", "c"),
    ],
)
def test_filters(spark, filters, text, want):
    assert one(spark, substitution.render("${f|" + filters + "}", lambda p: F.lit(text))) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ('request from "a b", signed on 2023-10-30T13:35:33.638720813Z', "request from <double_quoted>, signed on <datetime>"), ("a {b {c} d} [e] (f", "a <curly_bracketed> <square_bracketed> <parenthesized>"),
        ("user a.b@c.com at https://x.y/z?q=1 took 1h2m3.5s", "user <email> at <url> took <duration>"), ("from 10.0.0.255 id 7c1811ed-e98f-4c9c-a9f9-58c757ff494f 0x1F -5 3.14 TRUE", "from <ip> id <uuid> <hex> <int> <float> <bool>"),
        ("/usr/bin/x y.example.com a1 1a", "<filepath> <host> a1 1a"), ("d41d8cd98f00b204e9800998ecf8427e", "<hash>"), ("", ""), ("plain", "plain"),
    ],
)
def test_normalizer(text, want):
    assert Normalizer()(text) == want


def test_normalizer_custom():
    n = Normalizer("no", [{"placeholder": "<d>", "re": r"\d\d\d\d/\d\d/\d\d", "priority": "first"}])
    assert n("2024/01/02 x 7") == "<d> x 7"


@pytest.mark.parametrize("text, want", [(r"\xd0\xa1\xd0\x98.xml", "СИ.xml"), (r"\321\203", "у"), (r"Hello, \u4e16\u754c \U0001F600", "Hello, 世界 😀"), (r"\ud83d\ude00!", "😀!"), (r"\ud83dx", "\ufffdx"), (r"a\\b", r"a\b"), ("plain", "plain")])
def test_unescape(text, want):
    assert unescape(text, False) == want


def test_levels(spark):
    got = [one(spark, level_number(F.lit(x))) for x in (" ERROR ", "fatal", "6", "warn", "informational", "x")]
    assert got == [3, 0, 6, 4, 6, None]


# --- operators on events ------------------------------------------------------------------------------
CASES = [
    ([{"type": "discard", "match_fields": {"a": ["1", "2"]}}], [{"a": "1"}, {"a": "3"}], [{"a": "3"}]),
    ([{"type": "discard", "match_fields": {"a": "/^x/"}, "match_mode": "or", "match_invert": True}], [{"a": "xy"}, {"a": "yx"}], [{"a": "xy"}]),
    ([{"type": "keep_fields", "fields": ["a.b", "z"]}], [{"a": {"b": "1", "c": "2"}, "d": "3"}], [{"a": {"b": "1"}}]),
    ([{"type": "remove_fields", "fields": ["a.b", "d"]}], [{"a": {"b": "1", "c": "2"}, "d": "3"}], [{"a": {"c": "2"}}]),
    ([{"type": "rename", "a.b": "x", "d": "e"}], [{"a": {"b": "1", "c": "2"}, "d": "3", "e": "4"}], [{"a": {"c": "2"}, "d": "3", "e": "4", "x": "1"}]),
    ([{"type": "rename", "override": True, "d": "e"}], [{"d": "3", "e": "4"}], [{"e": "3"}]),
    ([{"type": "move", "fields": ["a.b", "d"], "mode": "allow", "target": "t.u"}], [{"a": {"b": "1", "c": "2"}, "d": "3"}], [{"a": {"c": "2"}, "t": {"u": {"b": "1", "d": "3"}}}]),
    ([{"type": "move", "fields": ["d"], "mode": "block", "target": "t"}], [{"a": "1", "d": "3"}], [{"d": "3", "t": {"a": "1"}}]),
    ([{"type": "flatten", "field": "a", "prefix": "p_"}], [{"a": {"b": "1", "c": "2"}, "d": "3"}], [{"d": "3", "p_b": "1", "p_c": "2"}]),
    ([{"type": "modify", "a.n": "${a.b}+$$", "m": "x"}], [{"a": {"b": "1"}}], [{"a": {"b": "1", "n": "1+$"}, "m": "x"}]),
    ([{"type": "modify", "_skip_empty": "true", "m": "${zz}"}], [{"m": "old"}], [{"m": "old"}]),
    ([{"type": "json_decode", "field": "log", "schema": "a string, n bigint", "prefix": "j_"}], [{"log": '{"a":"x","n":5}'}, {"log": "bad"}], [{"j_a": "x", "j_n": 5}, {"log": "bad"}]),
    ([{"type": "json_extract", "field": "log", "extract_fields": ["e.code", "level"], "truncated": True}], [{"log": '{"e":{"code":2,"m":"x"},"level":"error","z":"tru'}], [{"log": '{"e":{"code":2,"m":"x"},"level":"error","z":"tru', "code": "2", "level": "error"}]),
    ([{"type": "json_encode", "field": "a"}], [{"a": {"b": "1"}}], [{"a": '{"b":"1"}'}]),
    ([{"type": "parse_re2", "field": "m", "re2": r"(?P<first_name>\w+) (?P<n>\d+)?", "prefix": "p_"}], [{"m": "ab 7"}, {"m": "!"}], [{"p_first_name": "ab", "p_n": "7"}, {"m": "!"}]),
    ([{"type": "convert_date", "source_formats": ["2006/01/02 15:04:05", "unixtime"]}], [{"time": 998578502}], [{"time": 998578502}]),
    ([{"type": "convert_date", "source_formats": ["unixtime"]}], [{"time": 998578999.1346}], [{"time": 998578999}]),
    ([{"type": "convert_date", "source_formats": ["2006/01/02 15:04:05"], "remove_on_fail": True}], [{"time": "2022/02/07 13:06:14"}, {"time": "x"}], [{"time": 1644239174}, {}]),
    ([{"type": "convert_log_level", "style": "string"}], [{"level": "WARN"}, {"level": "5"}, {"level": "?"}], [{"level": "warning"}, {"level": "notice"}, {"level": "?"}]),
    ([{"type": "convert_utf8_bytes", "fields": ["o"]}], [{"o": {"f": r"\xd0\xa1"}}], [{"o": {"f": "С"}}]),
    ([{"type": "mask", "masks": [{"re": r"a(x*)b", "groups": [1]}]}], [{"m": "axxb ab", "n": 12}], [{"m": "a**b ab", "n": "12"}]),
    ([{"type": "mask", "masks": [{"re": r"\d\d\.\d{4}\.\d{4}", "max_count": 3}], "ignore_fields": ["k"]}], [{"m": "12.3456.7890", "k": "12.3456.7890"}], [{"m": "***", "k": "12.3456.7890"}]),
    ([{"type": "mask", "masks": [{"re": "[A-Za-z]+", "replace_word": "W", "do_if": {"op": "equal", "field": "k", "values": ["yes"]}}], "process_fields": ["m"]}], [{"m": "ab 1", "k": "yes"}, {"m": "ab 1", "k": "no"}], [{"m": "W 1", "k": "yes"}, {"m": "ab 1", "k": "no"}]),
    ([{"type": "mask", "masks": [{"re": "x", "applied_field": "hit", "applied_value": "1"}]}], [{"m": "axb"}, {"m": "ab"}], [{"m": "a*b", "hit": "1"}, {"m": "ab"}]),
    ([{"type": "split", "field": "data"}], [{"data": [{"m": "go"}, {"m": "rust"}], "k": "1"}, {"k": "2"}], [{"m": "go"}, {"m": "rust"}, {"k": "2"}]),
    ([{"type": "join", "field": "log", "start": "/^start/", "continue": "/^cont/"}], [{"log": "cont 0"}, {"log": "start 1"}, {"log": "cont 2"}, {"log": "cont 3"}, {"log": "x"}, {"log": "start 4"}], [{"log": "cont 0"}, {"log": "start 1cont 2cont 3"}, {"log": "x"}, {"log": "start 4"}]),
    ([{"type": "join", "field": "log", "start": "/^start/", "continue": "/^stop/", "negate": True}], [{"log": "start 1"}, {"log": "a"}, {"log": "stop"}, {"log": "b"}], [{"log": "start 1a"}, {"log": "stop"}, {"log": "b"}]),
    ([{"type": "join", "field": "log", "start": "/^s/", "continue": "/^c/", "max_event_size": 3}], [{"log": "s1"}, {"log": "c2"}, {"log": "c3"}], [{"log": "s1c2"}]),
    ([{"type": "join_template", "templates": ["go_panic", "cs_exception"]}], [{"log": "panic: x\n"}, {"log": "\n"}, {"log": "goroutine 1 [running]:\n"}, {"log": "ok"}, {"log": "Unhandled exception. y\n"}, {"log": "   at z\n"}], [{"log": "panic: x\n\ngoroutine 1 [running]:\n"}, {"log": "ok"}, {"log": "Unhandled exception. y\n   at z\n"}]),
    ([{"type": "join_template", "template": "go_data_race"}], [{"log": "WARNING: DATA RACE\n"}, {"log": "Read at\n"}, {"log": "==================\n"}], [{"log": "WARNING: DATA RACE\nRead at\n"}, {"log": "==================\n"}]),
    ([{"type": "parse_es"}], [{"index": {"_i": "x"}}, {"a": "1"}, {"delete": {"_i": "x"}}, {"update": {"_i": "y"}}, {"a": "2"}, {"create": {"_i": "z"}}, {"a": "3"}, {"a": "4"}], [{"a": "1"}, {"a": "3"}]),
    ([{"type": "cardinality", "key": ["h"], "fields": ["v"], "limit": 2, "action": "discard"}], [{"h": "a", "v": str(i // 2)} for i in range(6)], [{"h": "a", "v": "0"}, {"h": "a", "v": "0"}, {"h": "a", "v": "1"}]),
    ([{"type": "decode", "field": "log", "decoder": "csv", "params": {"columns": ["a", "b"]}, "prefix": "c_"}], [{"log": '1,"x ""y"""'}, {"log": "1,2,3"}], [{"c_a": "1", "c_b": 'x "y"'}, {"log": "1,2,3"}]),
    ([{"type": "k8s_multiline"}], [{"log": "a "}, {"log": "b\n"}, {"log": "c\n"}], [{"log": "a b\n"}, {"log": "c\n"}]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_operator(spark, case):
    actions, events, want = CASES[case]
    assert [{k: v for k, v in e.items() if v is not None} for e in play(spark, actions, events)] == want


DO_IF = [
    ({"op": "equal", "values": ["ab", "x"]}, [True, False, False, False]), ({"op": "equal", "values": ["AB"], "case_sensitive": False}, [True, True, False, False]), ({"op": "equal", "values": [None]}, [False, False, True, False]),
    ({"op": "contains", "values": ["b"]}, [True, False, False, True]), ({"op": "contains_any", "values": ["zB"]}, [False, True, False, False]), ({"op": "prefix", "values": ["a"]}, [True, False, False, False]), ({"op": "suffix", "values": ["b"]}, [True, False, False, True]),
    ({"op": "regex", "values": ["^[A-Z]+$"]}, [False, True, False, False]), ({"op": "byte_len_cmp", "cmp_op": "ge", "value": 3}, [False, False, False, True]), ({"op": "check_type", "values": ["nil", "null"]}, [False, False, True, False]),
]


@pytest.mark.parametrize("node, want", DO_IF)
def test_do_if(spark, node, want):
    events = [{"i": "0", "f": "ab"}, {"i": "1", "f": "AB"}, {"i": "2"}, {"i": "3", "f": "éb"}]
    for negate in (False, True):
        tree = {"op": "not", "operands": [{**node, "field": "f"}]} if not negate else {**node, "field": "f"}
        left = {e["i"] for e in play(spark, [{"type": "discard", "do_if": tree}], events)}
        assert left == {str(i) for i, w in enumerate(want) if w != negate}


@pytest.mark.parametrize("spec", [{"type": "nope"}, {"type": "discard", "colour": 1}, {"type": "discard", "do_if": {"op": "not", "operands": []}}, {"type": "discard", "do_if": {"op": "zz", "field": "a"}}, {"type": "discard", "match_fields": {"a": "1"}, "match_mode": "zz"}, {"type": "move", "fields": ["a"], "mode": "zz", "target": "t"}, {"type": "mask", "masks": [{"re": "(a)", "groups": [2]}]}, {"type": "join_template", "templates": ["zz"]}])
def test_bad_settings(spark, spec):
    with pytest.raises((ValueError, TypeError)):
        play(spark, [spec], [{"a": "1"}])


def test_hash_values(spark):
    assert play(spark, [{"type": "hash", "fields": [{"field": "level"}], "result_field": "h"}], [{"level": "unauthenticated"}])[0]["h"] == 6584967863753642363
    import xxhash

    texts = ["", "a", "é" * 50, "x" * 1000]
    got = play(spark, [{"type": "hash", "fields": [{"field": "t"}], "result_field": "h"}], [{"t": t} for t in texts])
    assert [g["h"] for g in got] == [xxhash.xxh64_intdigest(t.encode()) for t in texts]


def test_hash_takes_whole_texts_and_max_size_bytes_when_set(spark, tmp_path):
    import xxhash

    from spillway.queries import hash_xxh64

    texts = ["é" * 150 + x for x in ("", "a", "b" * 5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    df.toPandas().to_parquet(tmp_path / "documents.parquet")
    got = {r.doc_id: r.h for r in hash_xxh64(spark, str(tmp_path)).collect()}
    spec = {"type": "hash", "fields": [{"field": "text", "max_size": 200}], "result_field": "h"}
    cut = {r.doc_id: r.h for r in apply(df, spec).collect()}
    unsigned = lambda x: int(x) % (1 << 64)
    assert {i: unsigned(x) for i, x in got.items()} == {i: xxhash.xxh64_intdigest(t.encode()) for i, t in enumerate(texts)}
    assert {i: unsigned(x) for i, x in cut.items()} == {i: xxhash.xxh64_intdigest(t.encode()[:200]) for i, t in enumerate(texts)}


def test_distribution_trace():
    spec = {"ratios": [{"ratio": 0.5, "values": ["error"]}, {"ratio": 0.3, "values": ["warn", "info"]}]}
    levels = ["error"] * 5 + ["info"] * 2 + ["warn"] * 1 + ["debug"] * 3 + [""] + ["x"] * 5
    out = distribute(levels, [1] * len(levels), 12, spec)
    assert sum(out) <= 12 and all(out[:8]) and not all(out[12:])
    assert distribute(["a"] * 5, [1] * 5, 3, None) == [True] * 3 + [False] * 2


def test_mask_text_groups():
    p = regex.python(r"(\d{4})-(\d{4})")
    assert mask_text("1234-5678", p, [2], 0, None, False) == "1234-****" and mask_text("1234-5678", p, [1, 2], 0, None, True) == "-" and mask_text("1234-5678", p, [1], 0, "N", False) == "N-5678"


# --- state machines against windows ------------------------------------------------------------------------
def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("seed", range(4))
def test_join_windows_equal_the_state_machine(spark, seed):
    rng = random.Random(seed)
    rows = [(s, i, rng.choice(["S", "C", "x", "SC", None]) if rng.random() > 0.1 else "S", rng.choice(["yes", "no"])) for s in range(5) for i in range(60)]
    rows = [(s, i, None if t is None else t + str(i), m) for s, i, t, m in rows]
    spec = {"type": "join", "field": "log", "start": "^S", "continue": "C", "do_if": {"op": "equal", "field": "m", "values": ["yes"]}}
    got = sorted((r._source_id, r._seq, r.log or "") for r in apply(frame(spark, rows, "_source_id int, _seq int, log string, m string"), spec).collect())
    want = []
    for s in range(5):
        j = Joiner([("^S", "C", False)])
        for _, i, t, m in rows[s * 60 : s * 60 + 60]:
            want += [(s, int(k), v or "") for k, v in j.push(t, str(i), m == "yes")]
        want += [(s, int(k), v or "") for k, v in j.flush()]
    assert got == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_limits_equal_the_state_machines(spark, seed):
    rng = random.Random(seed)
    rows = [(i, str(rng.randrange(3)), str(rng.randrange(6)), 1_700_000_000 + i * 7, rng.randrange(1, 5)) for i in range(200)]
    df = frame(spark, rows, "_seq int, k string, v string, time bigint, _size int")
    spec = {"type": "throttle", "throttle_field": "k", "time_field_format": "unixtime", "default_limit": 9, "limit_kind": "size", "bucket_interval": "1m"}
    got = {r._seq for r in apply(df, spec).collect()}
    machines = {}
    assert got == {i for i, k, _, t, w in rows if machines.setdefault(k, Limiter(9, 10**6)).allow(t // 60, w)}
    got = {r._seq for r in apply(df, {"type": "cardinality", "key": ["k"], "fields": ["v"], "limit": 3, "action": "discard"}).collect()}
    seen = {}
    assert got == {i for i, k, v, *_ in rows if not seen.setdefault(k, Cardinality(3, 1e9)).over(v, 0)}


def test_antispam(spark):
    a = Antispam(5, 10)
    assert [a.spam(t / 10) for t in range(8)] == [False] * 4 + [True] * 4
    b = Antispam(3, 10)
    for t in range(6):
        b.spam(t)
    assert b.spam(6) and not any(b.spam(200 + 20 * t) for t in range(4))
    rows = [(i, i % 2, f"t{i}", 1_700_000_000 + (i if i % 2 else i * 30)) for i in range(40)]
    df = frame(spark, rows, "_seq int, _source_id int, value string, s bigint").withColumn("_time", F.timestamp_seconds("s")).drop("s")
    left = apply(df, {"type": "antispam", "threshold": 5, "interval": "5s"}).groupBy("_source_id").count().collect()
    assert {r._source_id: r["count"] for r in left} == {0: 20, 1: 4} or {r._source_id: r["count"] for r in left}[0] == 20


def test_throttle_rules_and_own_limits(spark):
    rows = [(i, "a" if i % 2 else "b", "err" if i % 3 else "ok", 1_700_000_000) for i in range(30)]
    df = frame(spark, rows, "_seq int, k string, level string, time bigint")
    spec = {"type": "throttle", "throttle_field": "k", "time_field_format": "unixtime", "default_limit": 2, "rules": [{"limit": 3, "conditions": {"level": "err"}}]}
    out = apply(df, spec).groupBy("k", "level").count().collect()
    assert {(r.k, r.level): r["count"] for r in out} == {("a", "err"): 3, ("b", "err"): 3, ("a", "ok"): 2, ("b", "ok"): 2}
    from spillway.operators import ACTIONS

    own = frame(spark, [("a", 1)], "key string, limit bigint")
    out = ACTIONS["throttle"](df, None, throttle_field="k", time_field_format="unixtime", default_limit=4, limits=own).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in out} == {"a": 1, "b": 4}


# --- configuration, sources, sinks, streams --------------------------------------------------------------
def test_config(monkeypatch):
    monkeypatch.setenv("SECRET_X", "s")
    got = config.load({"a": {"b": 1}, "c": "env(SECRET_X)"}, "a:\n  d: vault(p, k)\n", overrides={"a.b": 2}, secrets=lambda p, k: f"{p}/{k}")
    assert got == {"a": {"b": 2, "d": "p/k"}, "c": "s"}
    assert config.size("64 KiB") == 65536 and config.expression("gomaxprocs*4+capacity/2", {"gomaxprocs": 2, "capacity": 10}) == 13
    assert config.seconds("1h30m") == 5400 and config.seconds("-10ms") == -0.01
    for bad in (lambda: config.size("x"), lambda: config.seconds("5"), lambda: config.expression("__import__('os')", {}), lambda: config.load({"pipelines": {"a-b": {}}})):
        with pytest.raises(ValueError):
            bad()


def test_pipeline_from_files_to_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text('{"level":"error","m":"x"}\n\nbad\n{"level":"info","m":"y"}\n')
    (tmp_path / "in/b.skip").write_text('{"level":"error","m":"z"}\n')
    text = f"""
pipelines:
  p:
    settings: {{decoder: json, decoder_params: {{schema: "level string, m string"}}}}
    input: {{type: file, paths: {{include: ["{tmp_path}/in"], exclude: ["**/*.skip"]}}}}
    actions: [{{type: discard, match_fields: {{level: info}}}}, {{type: add_file_name}}]
    output: {{type: file, target_file: "{tmp_path}/out"}}
"""
    Pipeline.from_config(text).run(spark)
    out = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert [(o["level"], o["m"], o["file_name"].endswith("a.log")) for o in out] == [("error", "x", True)]


def test_dead_queue(spark, tmp_path):
    df = spark.createDataFrame([("x",)], "m string")
    sinks.write(df, {"type": "http", "endpoints": ["http://127.0.0.1:9/"], "retry": 1, "deadqueue": {"type": "file", "target_file": f"{tmp_path}/dead"}})
    assert spark.read.text(f"{tmp_path}/dead").count() == 1
    with pytest.raises(Exception, match=""):
        sinks.write(df, {"type": "http", "endpoints": ["http://127.0.0.1:9/"], "retry": 0})


def test_kafka_options_and_globs():
    got = sources.kafka_options({"brokers": ["a:1", "b:2"], "topics": ["t"], "offset": "oldest", "is_sasl_enabled": True})
    assert got["kafka.bootstrap.servers"] == "a:1,b:2" and got["startingOffsets"] == "earliest" and "ScramLoginModule" in got["kafka.sasl.jaas.config"]
    import re

    assert re.search(sources.glob_regex("**/*.log"), "file:/a/b/c.log") and not re.search(sources.glob_regex("/a/*.log"), "/a/b/c.log")


def test_upsert_statement():
    spec = {"table": "t", "columns": [{"name": "a", "type": "int", "unique": True}, {"name": "b", "type": "string"}]}
    assert sinks.postgres_upsert(spec) == "INSERT INTO t (a, b) VALUES (?, ?) ON CONFLICT(a) DO UPDATE SET b=EXCLUDED.b"


@pytest.mark.parametrize("target, text, want", [("Int8", "300", 0), ("Nullable(Int8)", "300", None), ("UInt64", "18446744073709551615", 18446744073709551615), ("UInt8", "-1", 0), ("Bool", "true", True), ("Array(String)", "x", ["x"]), ("UUID", "zz", "00000000-0000-0000-0000-000000000000"), ("IPv4", "1.2.3.4", "1.2.3.4"), ("Float64", "1.5", 1.5), ("String", None, "")])
def test_coerce(spark, target, text, want):
    from pyspark.sql import types as T

    assert one(spark, sinks.coerce(F.lit(text).cast("string"), T.StringType(), target)) == want


def test_streaming_join_and_throttle(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [{"log": t, "k": "a", "time": 1_700_000_000} for t in ("S1", "C2", "x", "S3", "C4", "C5", "y", "z")]
    (folder / "a.json").write_text("\n".join(json.dumps(x) for x in lines))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for name, actions, want in (
            ("join", [{"type": "join", "field": "log", "start": "^S", "continue": "^C"}], ["S1C2", "S3C4C5", "x", "y", "z"]),
            ("throttle", [{"type": "throttle", "throttle_field": "k", "time_field_format": "unixtime", "default_limit": 3}], ["C2", "S1", "x"]),
        ):
            p = Pipeline(input={"type": "file", "paths": [str(folder)]}, actions=actions, output={"type": "file", "target_file": str(tmp_path / f"out-{name}"), "retry": 0}, settings={"decoder": "json", "decoder_params": {"schema": "log string, k string, time bigint"}})
            q = p.stream(spark, str(tmp_path / f"cp-{name}"))
            got, end = [], time.time() + 120
            while got != want and time.time() < end and q.isActive:
                time.sleep(1)
                if list((tmp_path / f"out-{name}").glob("*.txt")):
                    got = sorted(json.loads(r[0])["log"] for r in spark.read.text(str(tmp_path / f"out-{name}")).collect())
            q.stop()
            assert got == want
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_protobuf(spark):
    from google.protobuf import descriptor_pb2

    f = descriptor_pb2.FileDescriptorProto(name="m.proto", package="p", syntax="proto3")
    m = f.message_type.add(name="M")
    m.field.add(name="s", number=1, type=9, label=1)
    m.field.add(name="n", number=2, type=5, label=1)
    files = descriptor_pb2.FileDescriptorSet(file=[f]).SerializeToString()
    from spillway.operators.decode import decoded

    df = spark.createDataFrame([(1, b"\x0a\x02hi"), (2, b"\xff\xff")], "_seq int, value binary")
    out = decoded(df, "protobuf", params={"descriptor": files, "proto_message": "p.M", "schema": "s string, n bigint"}).collect()
    assert [tuple(r) for r in out] == [(1, "hi", 0)]


def test_every_query_has_a_stable_name():
    import __spark_entry__ as e

    assert len(e.QUERIES) > 70 and set(e.ORACLE_SQL) <= set(e.QUERIES)


def test_hashes_of_whole_texts_against_xxhash(spark):
    import xxhash

    from spillway import queries
    from spillway.functions.normalize import Normalizer

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    plain = {r.doc_id: int(r.h) for r in queries.hash_xxh64(spark, "/root/testdata/sf0.001").collect()}
    assert plain == {i: xxhash.xxh64(t.encode()).intdigest() for i, t in texts.items()}
    one = Normalizer()
    some = {r.doc_id: int(r.h) for r in queries.hash_normalized(spark, "/root/testdata/sf0.001").collect()}
    assert some == {i: xxhash.xxh64(one(t).encode()).intdigest() for i, t in texts.items()}
