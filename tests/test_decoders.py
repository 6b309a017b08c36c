"""Decoders against cases of each format's rules."""

import json

import pytest
from pyspark.sql import functions as F

from spillway.operators.decode import decoded


def run(spark, name, lines, params=None):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "_n int, value string")
    fields = decoded(df, name, params=params)
    return {r["_n"]: {k: v for k, v in r.asDict(recursive=True).items() if k != "_n" and v is not None} for r in fields.collect()}


NGINX = "2022/08/17 10:49:27 [error] 2725122#2725122: *792412315 lua udp socket read timed out, context: ngx.timer"


def test_nginx_custom_fields_are_all_kept(spark):
    lines = [
        NGINX,
        '2022/08/18 09:29:37 [error] 844935#844935: *44934601 upstream timed out (110: Operation timed out), while connecting to upstream, client: 10.125.172.251, server: , request: "POST /download HTTP/1.1", upstream: "http://10.117.246.15:84/download", host: "mpm-youtube-downloader-38.name.tldn:84"',
        '2022/08/18 09:29:37 [error] 1#2: msg, client: a, client: b, subrequest: "/x"',
        "2022/08/17 10:49:27 [error] 2725122#2725122: ",
        "2022/08/17 10:49:27 [error] a#2725122: x",
        "2022/13/17 10:49:27 [error] 1#2: x",
    ]
    got = run(spark, "nginx_error", lines, {"nginx_with_custom_fields": True})
    assert got[0]["message"] == "lua udp socket read timed out" and got[0]["cid"] == "792412315" and got[0]["custom_fields"] == {"context": "ngx.timer"}
    assert got[1]["custom_fields"] == {"client": "10.125.172.251", "server": "", "request": "POST /download HTTP/1.1", "upstream": "http://10.117.246.15:84/download", "host": "mpm-youtube-downloader-38.name.tldn:84"}
    assert got[1]["message"] == "upstream timed out (110: Operation timed out), while connecting to upstream" and got[1]["host"].startswith("mpm")
    assert got[2]["custom_fields"] == {"client": "b", "subrequest": "/x"} and got[2]["message"] == "msg"
    assert set(got[3]) >= {"time", "level", "pid", "tid"} and "message" not in got[3] and 4 not in got


def test_syslog_5424_repeats_and_escapes(spark):
    lines = [
        '<165>1 2003-10-11T22:14:15.003Z mymachine.example.com myproc 10 ID47 [exampleSDID@32473 iut="3" eventSource="Application" eventID="1011"] An application event log',
        '<165>1 2003-10-11T22:14:15.003Z h a - - [x@1 a="1" a="2"][x@1 b="3"] m',
        '<34>1 2003-10-11T22:14:15.003Z h a 1 ID [x@1 a="q\\"u\\]o\\\\te"][y@2 c="]"] m',
        "<34>1 - - - - - -",
        "<34>1 2003-10-11T22:14:15.003Z h a 1 ID - BOM",
        "<192>1 2003-10-11T22:14:15.003Z h a 1 ID - m",
        "<34>1 2003-99-11T22:14:15.003Z h a 1 ID - m",
        "<34>1 yesterday h a 1 ID - m",
        '<34>1 2003-10-11T22:14:15+03:00 h a 1 ID [x@1 a="1" m',
        "<34>1 2003-10-11T22:14:15.123456+03:00 h a 1 ID [x@1] m",
    ]
    got = run(spark, "syslog_rfc5424", lines)
    assert got[0]["structured_data"] == {"exampleSDID@32473": {"iut": "3", "eventSource": "Application", "eventID": "1011"}} and got[0]["message"] == "An application event log"
    assert got[1]["structured_data"] == {"x@1": {"b": "3"}} or got[1]["structured_data"] == {"x@1": {"a": "2", "b": "3"}}
    assert got[2]["structured_data"] == {"x@1": {"a": 'q"u]o\\te'}, "y@2": {"c": "]"}}
    assert got[3] == {"priority": "34", "facility": "4", "severity": "2", "proto_version": "1"} and got[4]["message"] == "BOM"
    assert not {5, 6, 7, 8} & set(got) and got[9]["structured_data"] == {"x@1": {}}


def test_syslog_3164_dates(spark):
    lines = ["<34>Oct 11 22:14:15 mymachine.example.com myproc[10]: 'myproc' failed", "<34>Oct  5 22:14:15 h app: m", "<34>Oct 99 22:14:15 h app: m", "<34>Oct 11 25:14:15 h app: m", "<34>Okt 11 22:14:15 h app: m", "<34>Feb 30 22:14:15 h app: m", "<34>Feb 29 22:14:15 h app: m", "<34>Jan 00 22:14:15 h app: m", "<192>Jan 01 22:14:15 h app: m", "<34>Oct 11 22:60:15 h app: m"]
    got = run(spark, "syslog_rfc3164", lines)
    assert set(got) == {0, 1, 5, 6} and got[0]["process_id"] == "10" and got[0]["message"] == "'myproc' failed" and got[1]["timestamp"] == "Oct  5 22:14:15"


def test_csv_fields_without_a_cap(spark):
    lines = [",".join(f"f{i}" for i in range(20)), '"a ""q"" b",c,', 'a"b,c', '"open', "", "x\r\n"]
    got = run(spark, "csv", lines, {})
    assert got[0]["fields"] == {str(i): f"f{i}" for i in range(20)}
    assert got[1]["fields"] == {"0": 'a "q" b', "1": "c", "2": ""} and got[5]["fields"] == {"0": "x"}
    assert not {2, 3} & set(got)
    named = run(spark, "csv", ["1,2,3", "1,2"], {"columns": ["a", "b"]})
    assert named == {1: {"a": "1", "b": "2"}}
    loose = run(spark, "csv", ["1,2,3", "1,2", "1"], {"columns": ["a", "b"], "invalid_line_mode": "continue"})
    assert loose == {0: {"a": "1", "b": "2", "more_fields": {"2": "3"}}, 1: {"a": "1", "b": "2"}, 2: {"a": "1"}}
    for bad in ("", ",,", '"', "\n"):
        with pytest.raises(ValueError):
            run(spark, "csv", ["a"], {"delimiter": bad})
    assert run(spark, "csv", ["a\tb c \t d "], {"delimiter": "\t", "prefix": "c"}) == {0: {"fields": {"c0": "a", "c1": "b c ", "c2": "d"}}}
    assert run(spark, "csv", ["a,b", ",".join("abcde")], {"fields": 3}) == {0: {"0": "a", "1": "b"}, 1: {"0": "a", "1": "b", "2": "c"}}


def test_plans_hold_each_pattern_a_few_times(spark):
    df = spark.createDataFrame([("x",)], "value string")
    for name in ("syslog_rfc5424", "syslog_rfc3164", "nginx_error", "cri", "postgres"):
        plan = decoded(df, name)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("rlike") + plan.count("regexp_extract") <= 14, (name, plan.count("regexp_extract"))
    assert json and F
