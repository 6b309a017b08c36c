"""Queries of the event-pipeline operators over the driver's tables, each with its DuckDB SQL where SQL can say it.

Every query runs over its whole table. Ordered operators use a total order (event_id, or conv_id and turn).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions.paths import Document
from .operators.decode import decoded
from .operators.limits import cardinality_metric
from .operators.ordered import lookup
from .operators.project import level_number
from .plans.pipeline import Pipeline, apply, ingest, metrics, with_meta
from .sources import kernel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as documents in the order of event_id."""
    return table(spark, sf_dir, "events").withColumns({"_seq": F.col("event_id"), "_size": F.octet_length("props")})


def bare(df: DataFrame) -> DataFrame:
    return df.select(*[f"`{c}`" for c in df.columns if not c.startswith("_")])


def _on(name: str, source: str, spec: dict | list[dict], sql: str, keep: list[str] | None = None) -> None:
    """A query that applies operators to a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = events(spark, sf_dir) if source == "events" else table(spark, sf_dir, source)
        for s in spec if isinstance(spec, list) else [spec]:
            df = apply(df, s)
        return bare(df).select(*keep) if keep else bare(df)

    QUERIES[name], ORACLE_SQL[name] = run, sql


# --- predicates, as what discard leaves or drops -------------------------------------------------
_KEEP = ["event_id", "event_type"]


def _discard(name: str, node: dict, where: str, source: str = "events", keep: list[str] = _KEEP) -> None:
    _on(name, source, {"type": "discard", "do_if": {"op": "not", "operands": [node]}}, f"SELECT {', '.join(keep)} FROM {source} WHERE {where}", keep)


_discard("do_if_equal", {"op": "equal", "field": "event_type", "values": ["error", "purchase"]}, "event_type IN ('error', 'purchase')")
_discard("do_if_equal_nocase", {"op": "equal", "field": "event_type", "values": ["ERROR"], "case_sensitive": False}, "lower(event_type) = 'error'")
_discard("do_if_equal_null", {"op": "equal", "field": "absent", "values": [None]}, "true")
_discard("do_if_contains", {"op": "contains", "field": "event_type", "values": ["ur", "gn"]}, "contains(event_type, 'ur') OR contains(event_type, 'gn')")
_discard("do_if_contains_any", {"op": "contains_any", "field": "event_type", "values": ["xvg"]}, "regexp_matches(event_type, '[xvg]')")
_discard("do_if_prefix", {"op": "prefix", "field": "event_type", "values": ["cl", "si"]}, "starts_with(event_type, 'cl') OR starts_with(event_type, 'si')")
_discard("do_if_suffix", {"op": "suffix", "field": "event_type", "values": ["ck", "se"]}, "suffix(event_type, 'ck') OR suffix(event_type, 'se')")
_discard("do_if_regex", {"op": "regex", "field": "event_type", "values": ["^(c|v).*[kw]$"]}, "regexp_matches(event_type, '^(c|v).*[kw]$')")
_discard("do_if_regex_text", {"op": "regex", "field": "text", "values": [r"\b[0-9]{3}\b.*\s[A-Z]"]}, r"regexp_matches(text, '\b[0-9]{3}\b.*\s[A-Z]')", "documents", ["doc_id"])
_discard("do_if_byte_len_cmp", {"op": "byte_len_cmp", "field": "text", "cmp_op": "gt", "value": 2000}, "strlen(text) > 2000", "documents", ["doc_id"])
_discard("do_if_array_len_cmp", {"op": "array_len_cmp", "field": "embedding", "cmp_op": "ge", "value": 8}, "len(embedding) >= 8", "embeddings", ["vec_id"])
_discard("do_if_int_val_cmp", {"op": "int_val_cmp", "field": "user_id", "cmp_op": "lt", "value": 50}, "user_id < 50")
_discard("do_if_check_type", {"op": "check_type", "field": "props", "values": ["string"]}, "props IS NOT NULL")
_discard("do_if_logic", {"op": "or", "operands": [{"op": "and", "operands": [{"op": "equal", "field": "event_type", "values": ["error"]}, {"op": "int_val_cmp", "field": "user_id", "cmp_op": "ge", "value": 100}]}, {"op": "not", "operands": [{"op": "regex", "field": "props", "values": ["[0-4]"]}]}]}, "(event_type = 'error' AND user_id >= 100) OR NOT regexp_matches(props, '[0-4]')")
_on("match_and", "events", {"type": "discard", "match_fields": {"event_type": ["click", "view"], "user_id": "7"}, "match_invert": True}, "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND user_id = 7", _KEEP)
_on("match_or", "events", {"type": "discard", "match_fields": {"event_type": "click", "user_id": "7"}, "match_mode": "or"}, "SELECT event_id, event_type FROM events WHERE NOT (event_type = 'click' OR user_id = 7)", _KEEP)
_on("match_and_prefix", "events", {"type": "discard", "match_fields": {"event_type": "p", "user_id": "1"}, "match_mode": "and_prefix"}, "SELECT event_id, event_type FROM events WHERE NOT (starts_with(event_type, 'p') AND starts_with(user_id::VARCHAR, '1'))", _KEEP)
_on("match_or_regex", "events", {"type": "discard", "match_fields": {"event_type": "/^s.*p$/"}, "match_mode": "or"}, "SELECT event_id, event_type FROM events WHERE NOT regexp_matches(event_type, '^s.*p$')", _KEEP)


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-10 12:00:00'")
def do_if_ts_cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"))
    return apply(df, {"type": "discard", "do_if": {"op": "not", "operands": [{"op": "ts_cmp", "field": "time", "cmp_op": "lt", "value": "2024-01-10T12:00:00Z"}]}}).select("event_id")


# --- shaping ---------------------------------------------------------------------------------------
_on("keep_fields", "customer", {"type": "keep_fields", "fields": ["c_custkey", "c_name", "absent"]}, "SELECT c_custkey, c_name FROM customer")
_on("remove_fields", "customer", {"type": "remove_fields", "fields": ["c_acctbal", "c_nationkey"]}, "SELECT c_custkey, c_name, c_mktsegment FROM customer")
_on("rename", "customer", {"type": "rename", "fields": {"c_name": "name", "c_mktsegment": "c_custkey"}}, "SELECT c_custkey, c_name AS name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
_on("move_allow", "customer", [{"type": "move", "fields": ["c_name", "c_mktsegment"], "mode": "allow", "target": "info"}, {"type": "json_encode", "field": "info"}, {"type": "keep_fields", "fields": ["c_custkey", "info"]}], "SELECT c_custkey, '{\"c_name\":\"' || c_name || '\",\"c_mktsegment\":\"' || c_mktsegment || '\"}' AS info FROM customer")
_on("flatten", "customer", [{"type": "move", "fields": ["c_custkey"], "mode": "block", "target": "info"}, {"type": "flatten", "field": "info", "prefix": "x_"}], "SELECT c_custkey, c_name AS x_c_name, c_nationkey AS x_c_nationkey, c_acctbal AS x_c_acctbal, c_mktsegment AS x_c_mktsegment FROM customer")
_on("modify_template", "customer", {"type": "modify", "label": "${c_name} in $$ ${c_mktsegment} ${absent}."}, "SELECT *, c_name || ' in $ ' || c_mktsegment || ' .' AS label FROM customer")
_on("modify_re", "pages", [{"type": "modify", "id": "${url|re('([a-z]+)\\.example\\.([a-z]+)',-1,[1,2],'+')}", "n": "${url|re('[0-9]+',1,[0],',',true)}"}, {"type": "keep_fields", "fields": ["page_id", "id", "n"]}], r"SELECT page_id, regexp_extract(url, '([a-z]+)\.example\.([a-z]+)', 1) || '+' || regexp_extract(url, '([a-z]+)\.example\.([a-z]+)', 2) AS id, regexp_extract(url, '[0-9]+', 0) AS n FROM pages")
_on("modify_trim", "events", [{"type": "modify", "p": "${props|trim('all','{}')|trim('left','\"k')}"}, {"type": "keep_fields", "fields": ["event_id", "p"]}], "SELECT event_id, ltrim(trim(props, '{}'), '\"k') AS p FROM events")
_on("modify_trim_to", "events", [{"type": "modify", "p": "${props|trim_to('left','k')|trim_to('right','}')}"}, {"type": "keep_fields", "fields": ["event_id", "p"]}], "SELECT event_id, substr(props, instr(props, 'k')) AS p FROM events")
_on("modify_cut", "events", [{"type": "modify", "a": "${props|cut('first',4)}", "b": "${props|cut('last',3)}"}, {"type": "keep_fields", "fields": ["event_id", "a", "b"]}], "SELECT event_id, left(props, 4) AS a, right(props, 3) AS b FROM events")
_on("discard_conditional_rename", "events", [{"type": "rename", "fields": {"event_type": "kind"}, "do_if": {"op": "equal", "field": "event_type", "values": ["error"]}}, {"type": "keep_fields", "fields": ["event_id", "event_type", "kind"]}], "SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS event_type, CASE WHEN event_type = 'error' THEN event_type END AS kind FROM events")


@query("SELECT event_id, true AS has_host, true AS has_time FROM events")
def add_host_set_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id")
    for s in ({"type": "add_host"}, {"type": "set_time", "format": "unixtime"}):
        df = apply(df, s)
    return df.select("event_id", (F.length("host") > 0).alias("has_host"), (F.col("time") > 1_700_000_000).alias("has_time"))


@query("SELECT event_id, 'events.parquet' AS file_name FROM events")
def add_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "events").select("event_id", F.lit("events.parquet").alias("_source_name")), {"type": "add_file_name"}).select("event_id", "file_name")


# --- parsing -----------------------------------------------------------------------------------------
_on("json_extract", "events", [{"type": "json_extract", "field": "props", "extract_fields": ["k", "absent.x"]}, {"type": "keep_fields", "fields": ["event_id", "k", "x"]}], "SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS x FROM events")
_on("json_extract_truncated", "events", [{"type": "modify", "props": "${props|cut('first',8)}"}, {"type": "json_extract", "field": "props", "extract_field": "k", "truncated": True}, {"type": "keep_fields", "fields": ["event_id", "k"]}], "SELECT event_id, CASE WHEN strlen(props) <= 8 THEN json_extract_string(props, '$.k') WHEN regexp_matches(left(props, 8), ': *[0-9]+[^0-9]') THEN regexp_extract(props, ': *([0-9]+)', 1) END AS k FROM events")
_on("json_decode", "events", [{"type": "json_decode", "field": "props", "schema": "k bigint", "prefix": "p_"}, {"type": "keep_fields", "fields": ["event_id", "props", "p_k"]}], "SELECT event_id, NULL::VARCHAR AS props, json_extract_string(props, '$.k')::BIGINT AS p_k FROM events")
_on("decode_json", "events", [{"type": "decode", "field": "props", "decoder": "json", "params": {"schema": "k bigint"}, "keep_origin": True}, {"type": "keep_fields", "fields": ["event_id", "props", "k"]}], "SELECT event_id, props, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
_on("json_encode", "customer", [{"type": "json_encode", "field": "c_name"}, {"type": "keep_fields", "fields": ["c_custkey", "c_name"]}], "SELECT c_custkey, '\"' || c_name || '\"' AS c_name FROM customer")
_on("parse_re2", "pages", [{"type": "parse_re2", "field": "url", "re2": "^(?P<scheme>[a-z]+)://(?P<host_name>[^/]+)/(?P<lang>[a-z]{2})/(?P<num>[0-9]+)", "prefix": "u_"}, {"type": "keep_fields", "fields": ["page_id", "url", "u_scheme", "u_host_name", "u_lang", "u_num"]}], "SELECT page_id, CASE WHEN NOT regexp_matches(url, '^[a-z]+://[^/]+/[a-z]{2}/[0-9]+') THEN url END AS url, CASE WHEN regexp_matches(url, '^[a-z]+://[^/]+/[a-z]{2}/[0-9]+') THEN regexp_extract(url, '^([a-z]+)://', 1) END AS u_scheme, CASE WHEN regexp_matches(url, '^[a-z]+://[^/]+/[a-z]{2}/[0-9]+') THEN regexp_extract(url, '://([^/]+)/', 1) END AS u_host_name, CASE WHEN regexp_matches(url, '^[a-z]+://[^/]+/[a-z]{2}/[0-9]+') THEN regexp_extract(url, '://[^/]+/([a-z]{2})/', 1) END AS u_lang, CASE WHEN regexp_matches(url, '^[a-z]+://[^/]+/[a-z]{2}/[0-9]+') THEN regexp_extract(url, '://[^/]+/[a-z]{2}/([0-9]+)', 1) END AS u_num FROM pages")
_on("convert_date_unixtime", "orders", [{"type": "convert_date", "field": "o_orderdate"}, {"type": "keep_fields", "fields": ["o_orderkey", "o_orderdate"]}], "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS o_orderdate FROM orders")
_on("convert_date_text", "orders", [{"type": "convert_date", "field": "o_orderdate", "target_format": "02 Jan 2006 15:04"}, {"type": "keep_fields", "fields": ["o_orderkey", "o_orderdate"]}], "SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y %H:%M') AS o_orderdate FROM orders")


@query("SELECT event_id, epoch_us(ts) // 1000 AS time FROM events")
def convert_date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(F.col("event_id") % 3 == 1, F.date_format(ts, "yyyy/MM/dd HH:mm:ss.SSS")).otherwise(F.format_string("%d.%03d", F.unix_seconds(ts.cast("timestamp")), F.unix_millis(ts.cast("timestamp")) % 1000))
    df = table(spark, sf_dir, "events").select("event_id", text.alias("time"))
    df = apply(df, {"type": "convert_date", "source_formats": ["rfc3339nano", "2006/01/02 15:04:05.999", "unixtime"], "target_format": "unixtimemilli", "remove_on_fail": True})
    return df.select("event_id", "time")


_LEVEL = "CASE event_type WHEN 'error' THEN 3 ELSE 6 END"
_on("convert_log_level", "events", [{"type": "convert_log_level", "field": "event_type", "default_level": "info", "remove_on_fail": True}, {"type": "keep_fields", "fields": ["event_id", "event_type"]}], f"SELECT event_id, {_LEVEL} AS event_type FROM events")
_on("convert_log_level_text", "events", [{"type": "convert_log_level", "field": "event_type", "style": "string"}, {"type": "keep_fields", "fields": ["event_id", "event_type"]}], "SELECT event_id, event_type FROM events")


def _lines(spark: SparkSession, sf_dir: str, line) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("_seq"), line.alias("value"))


@query("SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time, CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS stream, props AS log FROM events")
def decoder_cri(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.when(F.col("event_type") == "error", " stderr P ").otherwise(" stdout F "), "props", F.when(F.col("event_type") == "error", "\n").otherwise(""))
    return bare(decoded(_lines(spark, sf_dir, line), "cri"))


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || ' GMT' AS time, user_id::VARCHAR AS pid, '3-1' AS pid_message_number, '1.2.3.4' AS client, 'db' AS db, event_type AS user, props AS log FROM events")
def decoder_postgres(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" GMT ["), F.col("user_id").cast("string"), F.lit("] => [3-1] client=1.2.3.4,db=db,user="), "event_type", F.lit(" LOG:  "), "props", F.lit("\n"))
    return bare(decoded(_lines(spark, sf_dir, line), "postgres"))


@query("SELECT strftime(ts, '%Y/%m/%d %H:%M:%S') AS time, 'error' AS level, user_id::VARCHAR AS pid, '7' AS tid, event_id::VARCHAR AS cid, 'failed ' || event_type AS message, '10.0.0.1' AS client, NULL::VARCHAR AS server, 'GET /' AS request, NULL::VARCHAR AS upstream, 'h' AS host, NULL::VARCHAR AS referrer, CASE WHEN event_id % 3 = 0 THEN 'client=10.0.0.1,host=h,kind=' || event_type || ',request=GET /' ELSE 'client=10.0.0.1,host=h,request=GET /' END AS custom FROM events")
def decoder_nginx_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', kind: "'), "event_type", F.lit('", client: 10.0.0.1'))).otherwise("")
    line = F.concat(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.lit(" [error] "), F.col("user_id").cast("string"), F.lit("#7: *"), F.col("event_id").cast("string"), F.lit(" failed "), "event_type", F.lit(', client: 10.0.0.1, request: "GET /", host: "h"'), more, F.lit("\n"))
    df = bare(decoded(_lines(spark, sf_dir, line), "nginx_error", params={"nginx_with_custom_fields": True}))
    entries = F.transform(F.array_sort(F.map_entries("custom_fields")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return df.withColumn("custom", F.array_join(entries, ",")).drop("custom_fields")


@query("SELECT (user_id % 192)::VARCHAR AS priority, (user_id % 192 // 8)::VARCHAR AS facility, ['EMERG','ALERT','CRIT','ERROR','WARN','NOTICE','INFO','DEBUG'][user_id % 8 + 1] AS severity, strftime(ts, '%b %d %H:%M:%S') AS timestamp, 'box' AS hostname, event_type AS app_name, event_id::VARCHAR AS process_id, props AS message FROM events")
def decoder_syslog_rfc3164(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("<"), (F.col("user_id") % 192).cast("string"), F.lit(">"), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" box "), "event_type", F.lit("["), F.col("event_id").cast("string"), F.lit("]: "), "props")
    return bare(decoded(_lines(spark, sf_dir, line), "syslog_rfc3164", params={"syslog_severity_format": "string"}))


@query("SELECT '165' AS priority, '1' AS proto_version, '20' AS facility, '5' AS severity, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, 'box' AS hostname, event_type AS app_name, NULL::VARCHAR AS process_id, event_id::VARCHAR AS message_id, props AS message, user_id::VARCHAR AS u, 'a\"b' AS q FROM events")
def decoder_syslog_rfc5424(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("<165>1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" box "), "event_type", F.lit(" - "), F.col("event_id").cast("string"), F.lit(' [id@1 u="'), F.col("user_id").cast("string"), F.lit('" q="a\\"b"][x@2] '), "props")
    df = bare(decoded(_lines(spark, sf_dir, line), "syslog_rfc5424"))
    sd = F.try_element_at("structured_data", F.lit("id@1"))
    return df.withColumns({"u": F.try_element_at(sd, F.lit("u")), "q": F.try_element_at(sd, F.lit("q"))}).drop("structured_data")


@query("SELECT event_id::VARCHAR AS id, props AS props, event_type AS kind FROM events")
def decoder_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.col("event_id").cast("string"), F.lit(';"'), F.replace(F.col("props"), F.lit('"'), F.lit('""')), F.lit('";'), "event_type", F.lit("\r\n"))
    return bare(decoded(_lines(spark, sf_dir, line), "csv", params={"columns": ["id", "props", "kind"], "delimiter": ";"}))


@query("SELECT props AS message FROM events WHERE strlen(props) > 0")
def decoder_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bare(decoded(ingest(_lines(spark, sf_dir, F.concat("props", F.lit("\n")))), "raw"))


@query("SELECT doc_id, CASE WHEN strlen(text) > 500 THEN left(lang, 1) ELSE lang END AS short, 'x' AS one FROM documents WHERE false UNION ALL SELECT event_id, CASE WHEN strlen(event_type) > 3 THEN left(event_type, 3) ELSE event_type END, NULL FROM events")
def decoder_json_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _lines(spark, sf_dir, F.to_json(F.struct(F.col("event_id").alias("doc_id"), F.col("event_type").alias("short"))))
    return bare(decoded(df, "json", params={"schema": "doc_id bigint, short string, one string", "json_max_fields_size": {"short": 3}}))


@query("SELECT event_id AS _seq, CASE WHEN strlen(props) > 9 THEN left(props, 9) ELSE props END AS value, strlen(props) AS _size FROM events")
def ingest_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest(_lines(spark, sf_dir, F.col("props")), {"max_event_size": 9, "cut_off_event_by_limit": True}).select("_seq", "value", F.col("_size").cast("bigint").alias("_size"))


@query("SELECT event_id, 'user ' || user_id || ' did ' || event_type AS what, 'none' AS other, 'user ' || user_id || ' did ' || event_type || '!' AS loud FROM events")
def meta_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_meta(table(spark, sf_dir, "events"), {"loud": "{{ .what }}!", "what": "user {{ .user_id }} did {{ .event_type }}", "other": '{{ .absent | default "none" }}'})
    return df.select("event_id", "what", "other", "loud")


@query("SELECT event_id::VARCHAR AS sequence_number, (event_id * 10)::VARCHAR AS ts, (user_id % 8)::VARCHAR AS priority, CASE WHEN user_id % 8 <= 3 THEN 'error' WHEN user_id % 8 <= 5 THEN 'warn' WHEN user_id % 8 = 6 THEN 'info' ELSE 'debug' END AS level, props AS message FROM events WHERE event_id * 10 > 100")
def source_dmesg(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    line = F.concat((F.col("user_id") % 8 + 8).cast("string"), F.lit(","), text("event_id"), F.lit(","), (F.col("event_id") * 10).cast("string"), F.lit(",-;"), "props")
    return bare(decoded(kernel(_lines(spark, sf_dir, line), 100), "json", params={"schema": "level string, ts string, priority string, sequence_number string, message string"}))


# --- masks and hashes ----------------------------------------------------------------------------------
_MAIL = r"[a-z0-9]+@[a-z0-9]+\.example\.(com|net|org)"


def _mask(name: str, spec: dict, sql: str) -> None:
    _on(name, "documents", [{"type": "mask", "masks": [spec], "process_fields": ["text"]}, {"type": "keep_fields", "fields": ["doc_id", "text"]}], f"SELECT doc_id, {sql} AS text FROM documents")


_mask("mask_replace_word", {"re": _MAIL, "replace_word": "SECMASKED"}, f"regexp_replace(text, '{_MAIL}', 'SECMASKED', 'g')")
_mask("mask_cut", {"re": _MAIL, "cut_values": True}, f"regexp_replace(text, '{_MAIL}', '', 'g')")
_mask("mask_digits", {"re": "[0-9]"}, "regexp_replace(text, '[0-9]', '*', 'g')")
_mask("mask_card", {"re": r"\b([0-9]{4})([0-9]{8})([0-9]{4})\b", "groups": [2]}, r"regexp_replace(text, '\b([0-9]{4})([0-9]{8})([0-9]{4})\b', '\1********\3', 'g')")
_on("mask_applied", "documents", [{"type": "mask", "masks": [{"re": _MAIL, "replace_word": "M", "applied_field": "masked", "applied_value": "mail"}], "process_fields": ["text"]}, {"type": "keep_fields", "fields": ["doc_id", "masked"]}], f"SELECT doc_id, CASE WHEN regexp_matches(text, '{_MAIL}') THEN 'mail' END AS masked FROM documents")
_on("mask_rules", "events", [{"type": "mask", "masks": [{"re": "k", "replace_word": "X", "match_rules": [{"cond": "or", "rules": [{"values": ["err", "pur"], "mode": "prefix"}, {"values": ["CK"], "mode": "suffix", "case_insensitive": True}]}]}], "process_fields": ["event_type"]}, {"type": "keep_fields", "fields": ["event_id", "event_type"]}], "SELECT event_id, CASE WHEN event_type LIKE 'err%' OR event_type LIKE 'pur%' OR lower(event_type) LIKE '%ck' THEN replace(event_type, 'k', 'X') ELSE event_type END AS event_type FROM events")
_NORM = {"type": "hash", "fields": [{"field": "text", "format": "normalize"}], "result_field": "h", "normalizer": {"builtin_patterns": "all"}}


@query()
def hash_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"), _NORM).select("doc_id", "h")


@query()
def hash_xxh64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"), {"type": "hash", "fields": [{"field": "absent"}, {"field": "text"}], "result_field": "h"}).select("doc_id", "h")


@query("SELECT event_id, 'é:' || event_type AS t FROM events")
def convert_utf8_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.concat(F.when(F.col("event_id") % 2 == 0, r"\xc3\xa9\x3a").otherwise(r"\303\251:"), "event_type").alias("t"))
    return apply(df, {"type": "convert_utf8_bytes", "fields": ["t"]})


# --- limits ----------------------------------------------------------------------------------------------
_BUCKET = "epoch(date_trunc('hour', ts))"


def _throttle(name: str, spec: dict, weight: str, limit: str, key: str = "user_id", rule: str = "0") -> None:
    _on(name, "events", {"type": "throttle", "throttle_field": "user_id", "time_field": "ts", "bucket_interval": "1h", **spec}, f"WITH t AS (SELECT *, {rule} AS rl, {weight} AS w, {limit} AS lim, {_BUCKET} AS b FROM events), s AS (SELECT *, sum(w) OVER (PARTITION BY rl, {key}, b ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS c FROM t) SELECT event_id, event_type FROM s WHERE lim < 0 OR c <= lim", _KEEP)


_throttle("throttle_count", {"default_limit": 1}, "1", "1")
_throttle("throttle_size", {"default_limit": 20, "limit_kind": "size"}, "strlen(props)", "20")
_throttle("throttle_rules", {"default_limit": 1, "rules": [{"limit": 0, "conditions": {"event_type": "view"}}, {"limit": -1, "conditions": {"event_type": ["error", "view"]}}]}, "1", "CASE WHEN event_type = 'view' THEN 0 WHEN event_type = 'error' THEN -1 ELSE 1 END", rule="CASE WHEN event_type = 'view' THEN 0 WHEN event_type = 'error' THEN 1 ELSE 2 END")


@query("""
WITH RECURSIVE e AS (SELECT event_id, event_type, user_id, floor(epoch(ts) / 86400) AS b, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 86400) ORDER BY event_id) AS r FROM events),
s AS (SELECT NULL::BIGINT AS event_id, NULL::VARCHAR AS event_type, user_id, b, 0::BIGINT AS r, 0 AS error, 0 AS seen, 0 AS other, false AS ok FROM (SELECT DISTINCT user_id, b FROM e)
UNION ALL SELECT event_id, event_type, user_id, b, r, error + (part = 0)::INT, seen + (part = 1)::INT, other + (part IN (2, 3))::INT, CASE part WHEN 0 THEN error < 3 WHEN 1 THEN seen < 2 ELSE part = 2 END
FROM (SELECT e.*, s.error, s.seen, s.other, CASE WHEN e.event_type = 'error' THEN 0 WHEN e.event_type IN ('click', 'view') THEN 1 WHEN s.other < 1 THEN 2
      WHEN greatest(3 - s.error - 1, 2 - s.seen - 1) <= -1 THEN 3 WHEN 3 - s.error >= 2 - s.seen THEN 0 ELSE 1 END AS part FROM s JOIN e ON e.user_id = s.user_id AND e.b = s.b AND e.r = s.r + 1))
SELECT event_id, event_type FROM s WHERE ok""")
def throttle_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"type": "throttle", "throttle_field": "user_id", "time_field": "ts", "bucket_interval": "24h", "default_limit": 6, "limit_distribution": {"field": "event_type", "ratios": [{"ratio": 0.5, "values": ["error"]}, {"ratio": 0.3, "values": ["click", "view"]}]}}
    return apply(events(spark, sf_dir), spec).select(*_KEEP)


_CARD = "WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AS n FROM events), o AS (SELECT *, coalesce(sum(n::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 3 AS over FROM f)"
_on("cardinality_discard", "events", {"type": "cardinality", "key": ["user_id"], "fields": ["event_type"], "limit": 3, "action": "discard"}, f"{_CARD} SELECT event_id, event_type FROM o WHERE NOT over", _KEEP)
_on("cardinality_remove_fields", "events", {"type": "cardinality", "key": ["user_id"], "fields": ["event_type"], "limit": 3, "action": "remove_fields"}, f"{_CARD} SELECT event_id, CASE WHEN NOT over THEN event_type END AS event_type FROM o", _KEEP)


@query("SELECT user_id::VARCHAR AS user_id, count(DISTINCT event_type) AS uniques FROM events GROUP BY user_id")
def cardinality_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cardinality_metric(table(spark, sf_dir, "events"), ["user_id"], ["event_type"])


@query("""
WITH RECURSIVE e AS (SELECT event_id, event_type, user_id, epoch_us(ts) AS now, CASE WHEN contains(props, '7') THEN 3 ELSE 5 END AS most, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE user_id <> 1),
s AS (SELECT NULL::BIGINT AS event_id, NULL::VARCHAR AS event_type, user_id, 0::BIGINT AS r, 0::BIGINT AS c, now AS last, now AS tick, false AS spam FROM e WHERE r = 1
UNION ALL SELECT event_id, event_type, user_id, r, CASE WHEN c = most THEN 4 * most ELSE c END, now, tick + m * 43200000000, c >= most
FROM (SELECT *, (CASE WHEN m = 0 THEN was ELSE greatest(least(greatest(was - most, 0), 4 * most) - (m - 1) * most, 0) END + (now - last < 43200000000)::INT)::BIGINT AS c
      FROM (SELECT e.*, s.c AS was, s.last, s.tick, greatest((e.now - s.tick) // 43200000000, 0) AS m FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1)))
SELECT event_id, event_type FROM s WHERE r > 0 AND NOT spam UNION ALL SELECT event_id, event_type FROM events WHERE user_id = 1""")
def antispam(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumns({"_source_id": F.col("user_id"), "_time": F.col("ts").cast("timestamp"), "value": F.col("props"), "_source_name": F.concat(F.lit("user"), F.col("user_id"))})
    rules = [{"name": "pass", "threshold": -1, "do_if": {"op": "suffix", "field": "source_name", "values": ["user1"]}}, {"name": "few", "threshold": 3, "do_if": {"op": "contains", "field": "event", "values": ["7"]}}]
    return apply(df, {"type": "antispam", "threshold": 5, "interval": "12h", "rules": rules}).select(*_KEEP)


# --- ordered -----------------------------------------------------------------------------------------------
@query("SELECT conv_id, turn, role, text FROM conversations")
def split_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns collected into arrays and split again."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "conv_id", "role", "text")))
    df = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("_seq")).agg(turns.alias("turns"))
    return bare(apply(df, {"type": "split", "field": "turns"})).select("conv_id", "turn", "role", "text")


_JOIN = """
WITH t AS (SELECT conv_id AS src, turn AS seq, role || ': ' || text AS txt FROM conversations),
a AS (SELECT *, true AS m, regexp_matches(txt, '^user') AS s, regexp_matches(txt, '^assistant') AS c FROM t),
b AS (SELECT *, (s OR NOT c) AS bb FROM a),
g AS (SELECT *, sum(bb::INT) OVER (PARTITION BY src ORDER BY seq) AS gid FROM b),
h AS (SELECT *, first_value(s) OVER (PARTITION BY src, gid ORDER BY seq) AS gst, row_number() OVER (PARTITION BY src, gid ORDER BY seq) AS rn FROM g)
SELECT src AS conv_id, min(seq) AS turn, string_agg(txt, '' ORDER BY seq) AS txt FROM h GROUP BY src, gid, CASE WHEN gst THEN -1 ELSE seq END
"""


@query(_JOIN)
def join_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("_source_id"), F.col("turn").alias("_seq"), "conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("txt"))
    return bare(apply(df, {"type": "join", "field": "txt", "start": "/^user/", "continue": "/^assistant/"}))


_PANIC = """
WITH t AS (SELECT user_id AS src, event_id AS seq, CASE event_type WHEN 'error' THEN 'panic: oops' WHEN 'click' THEN 'goroutine 7 [running]:' WHEN 'view' THEN 'main.go:' || user_id ELSE props END || '\n' AS txt FROM events),
a AS (SELECT *, regexp_matches(txt, '^(panic:|fatal error:)|http: panic serving') AS s, regexp_matches(txt, 'goroutine [0-9]+ \\[|\\.go:[0-9]+|panic:') AS c FROM t),
g AS (SELECT *, sum((s OR NOT c)::INT) OVER (PARTITION BY src ORDER BY seq) AS gid FROM a),
h AS (SELECT *, first_value(s) OVER (PARTITION BY src, gid ORDER BY seq) AS gst FROM g)
SELECT min(seq) AS event_id, string_agg(txt, '' ORDER BY seq) AS log FROM h GROUP BY src, gid, CASE WHEN gst THEN -1 ELSE seq END
""".replace("\\n", "' || chr(10) || '", 1).replace("\\\\", "\\")


@query(_PANIC)
def join_template_go_panic(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    log = F.when(kind == "error", "panic: oops").when(kind == "click", "goroutine 7 [running]:").when(kind == "view", F.concat(F.lit("main.go:"), F.col("user_id").cast("string"))).otherwise(F.col("props"))
    df = table(spark, sf_dir, "events").select(F.col("user_id").alias("_source_id"), F.col("event_id").alias("_seq"), "event_id", F.concat(log, F.lit("\n")).alias("log"))
    return bare(apply(df, {"type": "join_template", "template": "go_panic"}))


@query("""
WITH f AS (SELECT user_id AS src, event_id AS seq, props || CASE WHEN event_type IN ('error', 'view') THEN chr(10) ELSE '' END AS log, event_type IN ('error', 'view') AS whole FROM events),
g AS (SELECT *, coalesce(sum(whole::INT) OVER (PARTITION BY src ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gid FROM f)
SELECT max(seq) AS event_id, string_agg(log, '' ORDER BY seq) AS log, 'n1' AS k8s_node FROM g GROUP BY src, gid
""")
def k8s_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(F.col("user_id").alias("_source_id"), F.col("event_id").alias("_seq"), "event_id", F.concat("props", F.when(F.col("event_type").isin("error", "view"), "\n").otherwise("")).alias("log"))
    return bare(apply(df, {"type": "k8s_multiline", "node": "n1"}))


@query("""
WITH t AS (SELECT user_id AS src, event_id AS seq, CASE event_type WHEN 'click' THEN 'index' WHEN 'signup' THEN 'create' WHEN 'error' THEN 'update' WHEN 'view' THEN 'delete' ELSE 'doc' END AS kind FROM events),
a AS (SELECT *, kind IN ('index', 'create', 'update') AS h FROM t),
b AS (SELECT *, sum((NOT h)::INT) OVER (PARTITION BY src ORDER BY seq) AS r FROM a),
c AS (SELECT *, h AND (row_number() OVER (PARTITION BY src, r ORDER BY seq) - CASE WHEN first_value(h) OVER (PARTITION BY src, r ORDER BY seq) THEN 0 ELSE 1 END) % 2 = 1 AS hdr FROM b),
d AS (SELECT *, lag(hdr) OVER (PARTITION BY src ORDER BY seq) AS ph, lag(kind) OVER (PARTITION BY src ORDER BY seq) AS pk FROM c)
SELECT seq AS event_id, kind FROM d WHERE ph AND pk IN ('index', 'create')
""")
def parse_es(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    kind = F.when(t == "click", "index").when(t == "signup", "create").when(t == "error", "update").when(t == "view", "delete").otherwise("doc")
    df = table(spark, sf_dir, "events").select(F.col("user_id").alias("_source_id"), F.col("event_id").alias("_seq"), "event_id", kind.alias("kind"))
    return bare(apply(df, {"type": "parse_es", "kind": "kind"}))


# --- side aggregations, lookups, sinks ------------------------------------------------------------------------
@query("SELECT event_type, 'not_set' AS absent, count(*) AS events_count_total, sum(strlen(props))::BIGINT AS events_size_total FROM events WHERE user_id < 100 GROUP BY event_type")
def action_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"type": "discard", "metric_labels": ["event_type", "absent"], "do_if": {"op": "int_val_cmp", "field": "user_id", "cmp_op": "lt", "value": 100}}
    return metrics(events(spark, sf_dir), spec)


@query("SELECT c.c_custkey, c.c_nationkey, n.n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def lookup_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), names, ["c_nationkey"])


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1")
def postgres_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"columns": [{"name": "user_id", "type": "int", "unique": True}, {"name": "event_type", "type": "string", "unique": True}, {"name": "event_id", "type": "int"}]}
    return sinks.postgres_rows(events(spark, sf_dir), spec)


@query("SELECT event_id, least(greatest(event_id, 0), 9223372036854775807)::DECIMAL(20,0) AS u, CASE WHEN user_id <= 127 THEN user_id ELSE 0 END::TINYINT AS small, [event_type] AS arr, '00000000-0000-0000-0000-000000000000' AS id FROM events")
def clickhouse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumns({"u": F.col("event_id"), "small": F.col("user_id"), "arr": F.col("event_type"), "id": F.col("props")})
    columns = [("event_id", "Int64"), ("u", "UInt64"), ("small", "Int8"), ("arr", "Array(String)"), ("id", "UUID")]
    return sinks.clickhouse_rows(df, {"columns": [{"name": n, "type": t} for n, t in columns]})


@query("""SELECT o_orderkey, '{"index":{"_index":"orders-' || CASE WHEN o_orderstatus = '' THEN 'not_set' ELSE o_orderstatus END || '"}}' || chr(10) || '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' || chr(10) AS body FROM orders""")
def es_bulk_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return df.select("o_orderkey", sinks.es_bulk(df, {"index_format": "orders-%", "index_values": ["o_orderstatus"]}).alias("body"))


@query("""SELECT o_orderkey, '{"event":{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"},"source":"' || o_orderstatus || '"}' AS body FROM orders""")
def splunk_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return df.select("o_orderkey", sinks.splunk_event(df, {"copy_fields": [{"from": "o_orderstatus", "to": "source"}]}).alias("body"))


@query("SELECT event_id, '1.1' AS version, 'unknown' AS host, event_type AS short, epoch_us(ts) // 1000000 AS at, CASE WHEN event_type = 'error' THEN 3 ELSE 6 END AS level, user_id::VARCHAR AS extra FROM events")
def gelf_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.col("event_type").alias("lvl"))
    body = sinks.gelf_message(df, {"short_message_field": "event_type", "level_field": "lvl"})
    get = lambda p: F.get_json_object("body", f"$.{p}")
    return df.select("event_id", body.alias("body")).select("event_id", get("version").alias("version"), get("host").alias("host"), get("short_message").alias("short"), get("timestamp").cast("double").cast("bigint").alias("at"), get("level").cast("int").alias("level"), get("_user_id").alias("extra"))


@query("SELECT event_id, (epoch_us(ts) * 1000)::VARCHAR AS ts, event_type AS line, user_id::VARCHAR AS other FROM events")
def loki_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string").alias("ts"), F.col("event_type").alias("message"), "user_id")
    return df.select("event_id", sinks.loki_row(df, {}).alias("r")).select("event_id", "r.ts", "r.line", F.col("r.meta")["user_id"].alias("other"))


@query("""SELECT CASE event_type WHEN 'error' THEN 'errors' ELSE 'rest' END AS topic, '{"event_id":' || event_id || CASE event_type WHEN 'error' THEN ',"topic":"errors"' ELSE '' END || '}' AS value FROM events""")
def kafka_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "errors").alias("topic"))
    return sinks.kafka_rows(df, {"default_topic": "rest", "use_topic_field": True})


@query("""SELECT event_type AS bucket, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS value FROM events""")
def s3_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sinks.s3_buckets(df, {"bucket": "main", "bucket_field_event": "event_type"})


@query("SELECT event_id || chr(10) AS body FROM events")
def http_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("m"))
    return df.select(sinks.http_body(df, {"encoding": {"type": "raw", "field": "m"}}).alias("body"))


_FLAGSHIP = """
pipelines:
  main:
    actions:
      - type: discard
        do_if: {op: equal, field: event_type, values: [view]}
      - type: json_extract
        field: props
        extract_field: k
      - type: convert_log_level
        field: event_type
        default_level: info
        style: string
        remove_on_fail: true
      - type: mask
        process_fields: [k]
        masks: [{re: "[5-9]", replace_word: "#"}]
      - type: keep_fields
        fields: [event_id, event_type, k]
"""


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'error' ELSE 'informational' END AS event_type, regexp_replace(json_extract_string(props, '$.k'), '[5-9]', '#', 'g') AS k FROM events WHERE event_type <> 'view'")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configured pipeline of filter, extraction, levels, masks and projection."""
    return bare(Pipeline.from_config(_FLAGSHIP).transform(events(spark, sf_dir)))


__all__ = ["ORACLE_SQL", "QUERIES", "Document", "level_number"]
