"""Container logs: the source's decoder, names and labels, and how fragments are glued."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spillway.operators import ACTIONS, project
from spillway.operators.ordered import AHEAD
from spillway.plans.pipeline import Pipeline, apply, play
from spillway.streaming import Gluer


def machine(fragments, limit=0, split=1_000_000, cuts=False):
    """(place, log, cut) of what a reader with a buffer emits for (text, bytes) of one stream."""
    out, held, size, skip, cut, is_open = [], "", 0, False, False, False
    for i, (t, n) in enumerate(fragments):
        full = t.endswith("\n")
        size += n
        esc = len(json.dumps(t)) - 2
        if not full and size + AHEAD <= split:
            after = 1 + len(json.dumps(held)) - 2 + esc + 2
            if not limit or after < limit:
                held += t
            elif not skip:
                skip = True
                if cuts:
                    held, cut = held + t[: max(len(t) - (after - limit), 0)], True
            is_open = True
            continue
        if skip and not full:
            is_open = True
            continue
        if not (skip and not cut):
            out.append((i, (held + ("\n" if full else "") if cut else held + t) if held else t, cut and held != ""))
        held, size, skip, cut, is_open = "", 0, False, False, False
    if is_open and (not skip or cut):
        out.append((len(fragments) - 1, held, cut))
    return out


@pytest.mark.parametrize("spec", [{}, {"split_event_size": AHEAD + 40}, {"max_event_size": 14}, {"max_event_size": 14, "cut_off_field": "short"}, {"max_event_size": 20, "split_event_size": AHEAD + 60, "cut_off_event_by_limit": True}])
def test_fragments_against_a_buffer(spark, spec):
    rng = random.Random(str(spec))
    streams = {s: [("".join(rng.choice("abcde") for _ in range(rng.randint(0, 9))) + rng.choice(["", "", "\n"]), rng.randint(5, 20)) for _ in range(60)] for s in range(5)}
    rows = [(s, i, t, n) for s, f in streams.items() for i, (t, n) in enumerate(f)]
    df = spark.createDataFrame(rows, "_source_id int, _seq bigint, log string, _size int").withColumn("place", F.col("_seq")).repartition(4)
    got = apply(df, {"type": "k8s_multiline", **spec}).collect()
    cuts = "cut_off_field" in spec or spec.get("cut_off_event_by_limit", False)
    for s, f in streams.items():
        want = machine(f, spec.get("max_event_size", 0), spec.get("split_event_size", 1_000_000), cuts)
        mine = sorted((r.place, r.log, *([bool(r.short)] if "short" in r else [])) for r in got if r["_source_id"] == s)
        assert mine == sorted(w if "cut_off_field" in spec else w[:2] for w in want)


def test_the_streaming_machine_glues_alike():
    rng = random.Random(8)
    for limit, split, cuts in [(0, 1_000_000, False), (14, 1_000_000, False), (14, 1_000_000, True), (0, AHEAD + 40, False), (20, AHEAD + 60, True)] * 40:
        f = [("".join(rng.choice("abcde") for _ in range(rng.randint(0, 9))) + rng.choice(["", "", "\n"]), rng.randint(5, 20)) for _ in range(40)]
        m, out = Gluer(limit, split, cuts), []
        for i, (t, n) in enumerate(f):
            out += m.push(t, i, n)
            m = Gluer(limit, split, cuts, json.loads(json.dumps(m.now)))
        assert out + m.flush() == machine(f, limit, split, cuts)


def test_last_fragment_names_the_event_and_nulls_are_whole(spark):
    rows = [(0, 0, "a", 1), (0, 1, "b\n", 2), (0, 2, None, 3), (0, 3, "c", 4), (0, 4, "", 5)]
    df = spark.createDataFrame(rows, "_source_id int, _seq bigint, log string, k int")
    assert sorted((r.k, r.log) for r in apply(df, {"type": "k8s_multiline"}).collect()) == [(2, "ab\n"), (3, ""), (5, "c")]
    assert apply(df.limit(0), {"type": "k8s_multiline"}).count() == 0


def test_ordered_operators_need_a_stream(spark):
    df = spark.createDataFrame([(0, "a")], "_seq bigint, log string")
    for spec in ({"type": "join", "field": "log", "start": "a", "continue": "b"}, {"type": "k8s_multiline"}, {"type": "parse_es"}, {"type": "join_template", "template": "go_panic"}):
        with pytest.raises(ValueError, match="_source_id"):
            apply(df, spec)


@pytest.mark.parametrize("cri", ["docker", "containerd"])
def test_container_source(spark, tmp_path, cri):
    cid = "0a" * 32
    logs = tmp_path / "logs"
    logs.mkdir()
    texts = ["one ", "line\n", "two\n"]
    stamp = "2024-03-01T10:00:00.1Z"
    if cri == "docker":
        lines = [json.dumps({"log": t, "stream": "stdout", "time": stamp}) for t in texts]
    else:
        lines = [f"{stamp} stdout {'F' if t.endswith(chr(10)) else 'P'} {t.rstrip(chr(10))}" for t in texts]
    (logs / f"web-1_shop_app-{cid}.log").write_text("\n".join(lines) + "\n")
    (logs / "other.txt").write_text("x\n")
    pods = spark.createDataFrame([("shop", "web-1", cid, "red", "x")], "k8s_namespace string, k8s_pod string, k8s_container_id string, k8s_pod_label_team string, k8s_pod_label_rest string")
    pipe = Pipeline(input={"type": "k8s", "watching_dir": str(logs), "cri_type": cri, "node": "n7", "pods": pods, "allowed_pod_labels": ["team"]}, settings={})
    got = pipe.transform(pipe.source(spark)).collect()
    assert {(r.k8s_pod, r.k8s_namespace, r.k8s_container, r.k8s_container_id, r.k8s_node, r.k8s_pod_label_team) for r in got} == {("web-1", "shop", "app", cid, "n7", "red")}
    assert "k8s_pod_label_rest" not in got[0]
    if cri == "docker":
        assert sorted(r.log for r in got) == ["one line\n", "two\n"]


def test_only_the_node(spark):
    assert play(spark, [{"type": "k8s_multiline", "only_node": True, "node": "n1"}], [{"log": "a"}, {"log": "b\n"}]) == [{"log": "a", "k8s_node": "n1"}, {"log": "b\n", "k8s_node": "n1"}]


@pytest.mark.parametrize("spec,shown", [({}, 25), ({"interval": "1s", "first": 10}, 10), ({"interval": "1s", "first": 10, "thereafter": 5}, 13), ({"interval": "1s", "first": 99}, 25)])
def test_debug_counts_what_is_shown(spark, spec, shown):
    df = spark.range(50)
    seen = F.count(F.when(F.col("id") % 2 == 0, 1))
    own = {"interval": "0s", "first": 10, "thereafter": 0, **spec}
    assert df.agg(project.shown(seen, **own)).first()[0] == shown
    out = ACTIONS["debug"](df, F.col("id") % 2 == 0, message="seen by me", **spec)
    assert out.count() == 50 and "seen_by_me" in out._jdf.queryExecution().analyzed().toString()
