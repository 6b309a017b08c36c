"""Sinks against a local server, and streams over several paths and with stateful operators."""

import gzip
import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from spillway import sinks
from spillway.plans.pipeline import Pipeline
from spillway.streaming import Cardinality, Joiner


@pytest.fixture
def server():
    seen, answers = [], {}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            body = gzip.decompress(body) if self.headers.get("Content-Encoding") == "gzip" else body
            code, told = answers["by"](self.path, body.decode())
            seen.append((self.path, body.decode(), code))
            self.send_response(code)
            self.end_headers()
            self.wfile.write(told.encode())

        def log_message(self, *a):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen, answers
    http.shutdown()


def rows(spark, n):
    return spark.createDataFrame([(i, f"m{i}") for i in range(n)], "id int, message string").coalesce(1)


def test_rejected_batches_go_to_the_dead_queue_row_by_row(spark, tmp_path, server):
    url, seen, answers = server
    answers["by"] = lambda path, body: (400 if "m3" in body else 200, "")
    sinks.write(rows(spark, 10), {"type": "http", "endpoints": [url], "batch_size": 2, "deadqueue": {"type": "file", "target_file": f"{tmp_path}/dead"}})
    assert sorted(json.loads(r[0])["message"] for r in spark.read.text(f"{tmp_path}/dead").collect()) == ["m2", "m3"]
    assert len(seen) == 5  # nothing is sent twice


def test_large_batches_are_halved_and_a_single_large_row_is_dead(spark, tmp_path, server):
    url, seen, answers = server
    answers["by"] = lambda path, body: (413 if body.count("message") > 2 or "m5" in body else 200, "")
    sinks.write(rows(spark, 8), {"type": "http", "endpoints": [url], "batch_size": 8, "use_gzip": True, "deadqueue": {"type": "file", "target_file": f"{tmp_path}/dead"}})
    assert [json.loads(r[0])["message"] for r in spark.read.text(f"{tmp_path}/dead").collect()] == ["m5"]
    taken = Counter(m for _, body, code in seen if code == 200 for m in [f"m{i}" for i in range(8)] if f'"{m}"' in body)
    assert taken == Counter({f"m{i}": 1 for i in range(8) if i != 5})


def test_other_errors_are_tried_again_and_fail_the_job(spark, server):
    url, seen, answers = server
    answers["by"] = lambda path, body: (500 if len(seen) < 2 else 200, "")
    sinks.write(rows(spark, 3), {"type": "http", "endpoints": [url], "retry": 3, "retention_seconds": 0.01})
    assert [c for _, _, c in seen] == [500, 500, 200]
    answers["by"] = lambda path, body: (500, "")
    with pytest.raises(RuntimeError):
        sinks.write(rows(spark, 3), {"type": "http", "endpoints": [url], "retry": 1, "retention_seconds": 0.01})
    answers["by"] = lambda path, body: (400, "")
    sinks.write(rows(spark, 3), {"type": "http", "endpoints": [url]})  # rejected rows are logged and dropped
    with pytest.raises(RuntimeError):
        sinks.write(rows(spark, 3), {"type": "http", "endpoints": [url], "fatal_on_failed_insert": True})


def test_bulk_answers_name_the_rejected_rows(spark, tmp_path, server):
    url, seen, answers = server

    def by(path, body):
        docs = [json.loads(x) for x in body.strip().split("\n")][1::2]
        items = [{"index": {"status": 400 if d["id"] % 3 == 0 else 201}} for d in docs]
        return 200, json.dumps({"errors": True, "items": items})

    answers["by"] = by
    sinks.write(rows(spark, 7), {"type": "elasticsearch", "endpoints": [url], "index_format": "i", "deadqueue": {"type": "file", "target_file": f"{tmp_path}/dead"}})
    assert seen[0][0] == "/_bulk" and sorted(json.loads(r[0])["id"] for r in spark.read.text(f"{tmp_path}/dead").collect()) == [0, 3, 6]


def test_machines():
    j = Joiner([("^S", "^ ", False), ("^P", "^p", False)])
    out = [x for t in ("S1", " a", "P1", "p", " b", "S2", "p") for x in j.push(t, t)] + j.flush()
    assert out == [("S1", "S1 a"), ("P1", "P1p"), (" b", " b"), ("S2", "S2"), ("p", "p")]
    c = Cardinality(2, 10)
    assert [c.over(v, t) for v, t in (("a", 0), ("b", 1), ("c", 2), ("c", 11), ("d", 11.5), ("e", 30))] == [False, False, True, False, False, False]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def run(spark, tmp_path, actions, lines, schema):
    """The lines as two files of two include paths, through a streaming pipeline."""
    half = len(lines) // 2
    for name, part in (("a", lines[:half]), ("b", lines[half:])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.log").write_text("".join(json.dumps(x) + "\n" for x in part))
    out = str(tmp_path / "out")
    p = Pipeline({"type": "file", "paths": {"include": [str(tmp_path / "a"), str(tmp_path / "b")]}}, actions, {"type": "file", "target_file": out}, {"decoder_params": {"schema": schema}})
    q = p.stream(spark, str(tmp_path / "cp"), {"processingTime": "1 second"})
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return [json.loads(r[0]) for r in spark.read.option("recursiveFileLookup", True).text(out).collect()]


def test_a_stream_reads_all_include_paths(spark, tmp_path):
    got = run(spark, tmp_path, [{"type": "discard", "match_fields": {"k": "3"}}], [{"k": str(i)} for i in range(6)], "k string")
    assert sorted(x["k"] for x in got) == ["0", "1", "2", "4", "5"]


def test_streams_remove_fields_beyond_the_cardinality(rocks, tmp_path):
    got = run(rocks, tmp_path, [{"type": "cardinality", "key": ["h"], "fields": ["v"], "limit": 3, "action": "remove_fields"}], [{"h": "a", "v": str(i)} for i in range(8)], "h string, v string")
    assert len(got) == 8 and sum("v" in x for x in got) == 3


def test_streams_divide_a_limit_into_shares(rocks, tmp_path):
    levels = ["error"] * 10 + ["info"] * 10
    spec = {"type": "throttle", "throttle_field": "p", "time_field": "t", "bucket_interval": "1h", "default_limit": 6, "limit_distribution": {"field": "level", "ratios": [{"ratio": 0.5, "values": ["error"]}, {"ratio": 0.5, "values": ["info"]}]}}
    got = run(rocks, tmp_path, [spec], [{"p": "x", "t": "2024-01-01T00:00:00Z", "level": v} for v in levels], "p string, t string, level string")
    assert Counter(x["level"] for x in got) == {"error": 3, "info": 3}


def test_streams_follow_antispam_rules(rocks, tmp_path):
    rules = [{"name": "pass", "threshold": -1, "do_if": {"op": "contains", "field": "event", "values": ["vip"]}}, {"name": "block", "threshold": 0, "do_if": {"op": "contains", "field": "event", "values": ["bad"]}}]
    spec = {"type": "antispam", "threshold": 3, "interval": "1h", "rules": rules, "event": "m", "source": "s", "time": "t"}
    lines = [{"s": "1", "m": m, "t": "2024-01-01T00:00:00Z"} for m in ["vip"] * 5 + ["bad"] * 5 + ["x"] * 10]
    got = run(rocks, tmp_path, [spec], lines, "s string, m string, t string")
    assert Counter(x["m"] for x in got) == {"vip": 5, "x": 2}


def test_streams_glue_fragments(rocks, tmp_path):
    """Timers keep such a query busy, so it is stopped once its rows are there."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.log").write_text("".join(json.dumps({"log": t}) + "\n" for t in ("a", "b\n", "c\n", "d", "e", "f\n")))
    out, want = tmp_path / "out", [("ab\n", "n1"), ("c\n", "n1"), ("def\n", "n1")]
    p = Pipeline({"type": "file", "paths": [str(tmp_path / "in")]}, [{"type": "k8s_multiline", "node": "n1"}], {"type": "file", "target_file": str(out), "retry": 0}, {"decoder_params": {"schema": "log string"}})
    q = p.stream(rocks, str(tmp_path / "cp"))
    got, end = [], time.time() + 120
    try:
        while got != want and time.time() < end and q.isActive:
            time.sleep(1)
            if list(out.glob("*.txt")):
                got = sorted((x["log"], x["k8s_node"]) for x in (json.loads(r[0]) for r in rocks.read.text(str(out)).collect()))
    finally:
        q.stop()
    assert got == want
