"""Sinks: what is sent is a projection (``payload``), how it is sent a writer with retries and a dead queue."""

from __future__ import annotations

import json
import logging
import random
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import timefmt
from ..functions.paths import Document

SINKS: dict[str, Callable[[DataFrame, dict], None]] = {}
BY_BATCH: set[str] = set()  # sinks that give back a DataFrame (doc, error) of the rows that weren't taken, and do their work when it is read
REJECTED = frozenset(("400", "413", "rejected"))  # answers that no retry changes: without a dead queue such rows are logged and dropped
log = logging.getLogger("spillway")


def sink(name: str, by_batch: bool = False):
    def register(f):
        SINKS[name] = f
        if by_batch:
            BY_BATCH.add(name)
        return f

    return register


def fields(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def document(df: DataFrame, but: tuple = ()) -> Column:
    """The document as JSON text."""
    names = [c for c in fields(df) if c not in but]
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])) if names else F.lit("{}")


def write(df: DataFrame, spec: dict) -> None:
    """Writes with retries (exponential, jittered); what fails goes to the dead queue, or fails the job.

    Sinks by HTTP retry each of their batches and give back the rows that weren't taken, so nothing that was delivered is sent
    again; only those rows go to the dead queue. The others retry the whole write."""
    kind = spec.get("type", "devnull")
    if kind not in SINKS:
        raise ValueError(f"unknown sink {kind!r}")
    if kind in BY_BATCH:
        return _settle(SINKS[kind](df, spec), df, spec)
    retries, wait, factor = patience(spec)
    for n in range(retries + 1):
        try:
            return SINKS[kind](df, spec)
        except Exception:
            if n == retries:
                if "deadqueue" not in spec or spec.get("fatal_on_failed_insert"):
                    raise
                return write(df, spec["deadqueue"])
            time.sleep(wait * factor**n * random.uniform(0.5, 1.5))
    return None


def patience(spec: dict) -> tuple[int, float, float]:
    return int(spec.get("retry", 10)), float(spec.get("retention_seconds", 0.05)), float(spec.get("retention_exponentially_multiplier", 2))


def _settle(failed: DataFrame, df: DataFrame, spec: dict) -> None:
    """Sends what is to be sent, keeps the failed rows (doc, error) in the shared folder meanwhile, and hands them to the dead queue."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:").rstrip("/") + "/_shared"
    path = f"{root.rstrip('/')}/failed-{uuid.uuid4().hex}"
    failed.write.parquet(path)
    try:
        rows = spark.read.parquet(path)
        lost = {r["error"]: r["count"] for r in rows.groupBy("error").count().collect()}  # a row for each kind of answer
        if not lost:
            return
        log.error("%s: %d rows weren't taken: %s", spec.get("type"), sum(lost.values()), lost)
        if "deadqueue" in spec and not spec.get("fatal_on_failed_insert"):
            write(rows.select(F.from_json("doc", df.schema).alias("d")).select("d.*"), spec["deadqueue"])
        elif spec.get("fatal_on_failed_insert") or set(lost) - REJECTED:
            raise RuntimeError(f"{spec.get('type')}: {sum(lost.values())} rows weren't taken: {lost}")
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


def batch_writer(spec: dict):
    def run(df: DataFrame, batch: int) -> None:
        write(df, spec)

    return run


@sink("devnull")
def devnull(df: DataFrame, spec: dict) -> None:
    df.write.format("noop").mode("overwrite").save()


@sink("stdout")
def stdout(df: DataFrame, spec: dict) -> None:
    """Lines on the standard output: of the driver in a local session, of each executor on a cluster."""
    lines = df.select(document(df).alias("d"))
    if not df.sparkSession.sparkContext.master.startswith("local"):
        return lines.foreachPartition(_print)
    for r in lines.toLocalIterator(prefetchPartitions=True):
        print(r[0])
    return None


def _print(rows: Iterator[Row]) -> None:
    for r in rows:
        print(r[0], flush=True)


@sink("file")
def file(df: DataFrame, spec: dict) -> None:
    """Lines of JSON under target_file, one directory for each write."""
    df.select(document(df).alias("value")).write.mode("append").option("compression", spec.get("compression", "none")).text(spec["target_file"])


def es_bulk(df: DataFrame, spec: dict) -> Column:
    """Action line and document. ``%`` in index_format takes index_values in turn; @time is the time in time_format."""
    doc, parts = Document(df), spec.get("index_format", "events-%").split("%")
    values = list(spec.get("index_values") or ["@time"])
    out = [F.lit(parts[0])]
    for p, v in zip(parts[1:], values):
        text = timefmt.to_format(F.current_timestamp(), spec.get("time_format", "2006-01-02")) if v == "@time" else doc.text(v)
        out += [F.when(text == "", F.lit("not_set")).otherwise(text), F.lit(p)]
    head = F.to_json(F.struct(F.struct(F.concat(*out).alias("_index")).alias(spec.get("batch_op_type", "index"))))
    return F.concat(head, F.lit("\n"), document(df), F.lit("\n"))


def http_body(df: DataFrame, spec: dict) -> Column:
    encoding = spec.get("encoding") or {"type": "json"}
    if encoding.get("type") == "raw":
        return F.concat(Document(df).text(encoding["field"]), F.lit("\n"))
    return F.concat(document(df), F.lit("\n"))


def kafka_rows(df: DataFrame, spec: dict) -> DataFrame:
    topic = F.lit(spec["default_topic"])
    if spec.get("use_topic_field"):
        t = Document(df).text(spec.get("topic_field", "topic"))
        topic = F.when(t == "", topic).otherwise(t)
    return df.select(topic.alias("topic"), document(df).alias("value"))


def splunk_event(df: DataFrame, spec: dict) -> Column:
    """``{"event": document, ...}``; copy_fields go to the root beside it."""
    doc, extra = Document(df), []
    for c in spec.get("copy_fields") or []:
        if c["to"] in ("", "event") or c["to"].startswith("event."):
            raise ValueError("copies to the root or to event are forbidden")
        if (v := doc.get(c["from"])) is not None:
            extra.append(v.alias(c["to"]))
    return F.to_json(F.struct(F.struct(*[F.col(f"`{c}`") for c in fields(df)]).alias("event"), *extra))


def loki_row(df: DataFrame, spec: dict) -> Column:
    """[time, message, {other fields}]; a time that isn't a number of nanoseconds is none (the row is dropped), no time is now."""
    doc = Document(df)
    ts, msg = doc.text(spec.get("timestamp_field", "ts")), doc.text(spec.get("message_field", "message"))
    rest = [c for c in fields(df) if c not in (spec.get("timestamp_field", "ts"), spec.get("message_field", "message"))]
    now = (F.unix_micros(F.current_timestamp()) * 1000).cast("string")
    when = F.when(ts == "", now).when(ts.rlike("^[0-9]{19}$"), ts)
    other = F.create_map(*[x for c in rest for x in (F.lit(c), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))]) if rest else F.create_map()
    return F.when(when.isNotNull(), F.struct(when.alias("ts"), msg.alias("line"), other.alias("meta")))


def gelf_message(df: DataFrame, spec: dict) -> Column:
    """GELF 1.1: host, short_message, full_message, timestamp and level from their fields, all others as _name."""
    import re

    doc = Document(df)
    host_f, short_f, full_f = spec.get("host_field", "host"), spec.get("short_message_field", "message"), spec.get("full_message_field", "")
    time_f, level_f = spec.get("timestamp_field", "time"), spec.get("level_field", "level")
    from ..operators.project import level_number

    blank = lambda c, other: F.when(F.trim(c) == "", F.lit(other)).otherwise(c)
    out = [F.lit("1.1").alias("version"), blank(doc.text(host_f), "unknown").alias("host"), blank(doc.text(short_f), spec.get("default_short_message_value", "not set")).alias("short_message")]
    if full_f:
        out.append(F.when(doc.text(full_f) != "", doc.text(full_f)).alias("full_message"))
    kind, text = doc.kind(time_f), doc.text(time_f)
    stamp = F.unix_micros(timefmt.parse(text, spec.get("timestamp_field_format", "rfc3339nano"))) / 1e6
    if isinstance(kind, T.NumericType):
        n = doc.get(time_f).cast("double")
        stamp = F.when(n >= 1e12, n / 1000).otherwise(n)
    now = F.unix_micros(F.current_timestamp()) / 1e6
    out.append(F.when(F.coalesce(stamp, F.lit(0.0)) < 1e9, now).otherwise(stamp).alias("timestamp"))
    out.append(F.coalesce(level_number(doc.text(level_f)), F.lit(6)).alias("level"))
    for c in fields(df):
        if c not in (host_f, short_f, full_f, time_f, level_f):
            out.append(F.col(f"`{c}`").alias("_" + re.sub(r"[^\w.-]", "-", "__id" if c == "id" else c)))
    return F.to_json(F.struct(*out))


ZERO = {"string": "", "int": 0, "float": 0.0, "bool": False}


def coerce(col: Column, kind: T.DataType, target: str, strict: bool = False) -> Column:
    """A column as a sink's type; what can't be read is the type's zero, or null for Nullable(...)."""
    import re

    if m := re.fullmatch(r"Nullable\((.+)\)", target):
        return _cast(col, kind, m[1], strict)
    value = _cast(col, kind, target, strict)
    base = target.split("(")[0]
    if base.startswith(("Int", "UInt")):
        return F.coalesce(value, F.lit(0).cast(value_type(target)))
    if base.startswith("Float"):
        return F.coalesce(value, F.lit(0.0).cast(value_type(target)))
    if base == "Bool":
        return F.coalesce(value, F.lit(False))
    if base.startswith("DateTime"):
        return F.coalesce(value, F.timestamp_seconds(F.lit(0)))
    if base == "UUID":
        return F.coalesce(value, F.lit("00000000-0000-0000-0000-000000000000"))
    if base in ("IPv4", "IPv6"):
        return F.coalesce(value, F.lit("0.0.0.0" if base == "IPv4" else "::"))
    if base == "Array":
        return F.coalesce(value, F.array().cast("array<string>"))
    if base == "Map":
        return F.coalesce(value, F.create_map().cast("map<string,string>"))
    return F.coalesce(value, F.lit(""))


def value_type(target: str) -> str:
    return {
        "Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint", "UInt8": "smallint", "UInt16": "int", "UInt32": "bigint", "UInt64": "decimal(20,0)", "Int128": "decimal(38,0)",
        "UInt128": "decimal(38,0)", "Int256": "string", "UInt256": "string", "Float32": "float", "Float64": "double", "Bool": "boolean",
    }.get(target.split("(")[0], "string")


def _cast(col: Column, kind: T.DataType, target: str, strict: bool) -> Column:
    import re

    base = target.split("(")[0]
    container = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
    text = F.to_json(col) if container else col.cast("string")
    if base in ("String", "FixedString", "Enum8", "Enum16") or (m := re.fullmatch(r"LowCardinality\((.+)\)", target)):
        if base == "LowCardinality":
            return _cast(col, kind, m[1], strict)
        return F.when(F.lit(isinstance(kind, T.StringType)), col.cast("string")) if strict else text
    if base == "Array":
        if isinstance(kind, T.ArrayType):
            return F.transform(col, lambda x: F.coalesce(x.cast("string") if not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)) else F.to_json(x), F.lit("")))
        return F.lit(None).cast("array<string>") if strict else F.when(col.isNotNull(), F.array(text))
    if base == "Map":
        return F.from_json(F.to_json(col), "map<string,string>") if isinstance(kind, (T.StructType, T.MapType)) else F.lit(None).cast("map<string,string>")
    if base == "Bool":
        return col.cast("boolean") if isinstance(kind, T.BooleanType) else F.lit(None).cast("boolean") if strict else F.when(F.lower(text).isin("true", "1"), True).when(F.lower(text).isin("false", "0"), False)
    if base == "DateTime":
        return F.when(text.rlike("^[0-9]+$"), F.timestamp_seconds(text.try_cast("bigint")))
    if base == "DateTime64":
        digits = int(re.search(r"\((\d+)", target)[1]) if "(" in target else 3
        whole = text.try_cast("decimal(38,0)") * F.lit(1_000_000) / F.lit(10**digits)
        return F.when(text.rlike("^[0-9]+$"), F.timestamp_micros(F.floor(whole).cast("bigint")))
    if base == "UUID":
        return F.when(text.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lower(text))
    if base == "IPv4":
        return F.when(text.rlike(r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.|$)){4}$"), text)
    if base == "IPv6":
        return F.when(text.rlike("^[0-9a-fA-F:.]*:[0-9a-fA-F:.]*$"), text)
    number = text.try_cast(value_type(target))
    if base.startswith("UInt") and value_type(target) != "string":
        top = 2 ** int(base[4:]) - 1
        number = F.when((number >= 0) & (text.try_cast("decimal(38,0)") <= F.lit(str(min(top, 10**38 - 1))).cast("decimal(38,0)")), number)
    if base.endswith("256"):
        number = F.when(text.rlike("^-?[0-9]+$" if base[0] == "I" else "^[0-9]+$"), text)
    return F.when(F.lit(isinstance(kind, T.NumericType)), number) if strict else number


def clickhouse_rows(df: DataFrame, spec: dict) -> DataFrame:
    """The table's columns with their types."""
    doc, out = Document(df), []
    for c in spec["columns"]:
        target = c["type"]
        if any(target.startswith(p) for p in ("Array(", "Map(")) and target not in ("Array(String)", "Map(String, String)", "Map(String,String)"):
            raise ValueError(f"unsupported type {target}")
        col, kind = doc.get(c["name"]), doc.kind(c["name"])
        out.append(coerce(F.lit(None).cast("string") if col is None else col, kind or T.StringType(), target, bool(spec.get("strict_types"))).alias(c["name"]))
    return df.select(*out)


def postgres_rows(df: DataFrame, spec: dict) -> DataFrame:
    """Typed rows; rows that lack a column or have another type are discarded; of equal unique keys the first stays."""
    doc, ok, out = Document(df), F.lit(True), []
    for c in spec["columns"]:
        col, kind = doc.get(c["name"]), doc.kind(c["name"])
        if col is None:
            return df.limit(0).select(*[F.lit(None).cast("string").alias(x["name"]) for x in spec["columns"]])
        if c["type"] == "int":
            value = col.try_cast("bigint") if isinstance(kind, (T.IntegralType, T.StringType)) else F.lit(None).cast("bigint")
        elif c["type"] == "timestamp":
            n = col.try_cast("bigint")
            value = F.when(n.between(0, 221845392000), F.timestamp_seconds(n))
        elif c["type"] == "string":
            value = col.cast("string") if not isinstance(kind, (T.StructType, T.ArrayType)) else F.to_json(col)
        else:
            raise ValueError(f"unknown type {c['type']!r}")
        ok = ok & value.isNotNull()
        out.append(value.alias(c["name"]))
    seq = [F.col("_seq")] if "_seq" in df.columns else [F.monotonically_increasing_id().alias("_seq")]
    rows = df.where(ok).select(*out, *seq)
    unique = [c["name"] for c in spec["columns"] if c.get("unique")]
    if unique:
        rows = rows.withColumn("__n", F.row_number().over(W.partitionBy(*unique).orderBy("_seq"))).where("__n = 1").drop("__n")
    return rows.drop("_seq")


def postgres_upsert(spec: dict) -> str:
    """The statement a row is sent with."""
    names = [c["name"] for c in spec["columns"]]
    unique = [c["name"] for c in spec["columns"] if c.get("unique")]
    rest = [n for n in names if n not in unique]
    sql = f"INSERT INTO {spec['table']} ({', '.join(names)}) VALUES ({', '.join(['?'] * len(names))})"
    if unique:
        sets = ", ".join(f"{n}=EXCLUDED.{n}" for n in rest)
        sql += f" ON CONFLICT({', '.join(unique)}) DO " + (f"UPDATE SET {sets}" if sets else "NOTHING")
    return sql


def _post(df: DataFrame, body: Column, spec: dict, join: str = "", items: bool = False) -> DataFrame:
    """Batches of payloads by HTTP from the executors, as the rows (doc, error) that weren't taken.

    A batch that is too large is halved; one that is answered otherwise than 2xx, 400 or 413 is tried again, at the next
    endpoint. ``items``: the answer tells for each row whether it was taken (a bulk API)."""
    endpoints, most, headers = spec["endpoints"], int(spec.get("batch_size", 256)), dict(spec.get("headers") or {})
    (retries, wait, factor), gzipped, split = patience(spec), spec.get("use_gzip"), spec.get("split_batch", True)
    head = {"Content-Type": spec.get("content_type", "application/json"), **headers, **({"Content-Encoding": "gzip"} if gzipped else {})}

    def send(batches):
        import gzip
        import urllib.error
        import urllib.request

        import pyarrow as pa

        def attempt(data: bytes, n: int) -> tuple[str, bytes]:
            """The error's kind, empty for none, and the answer."""
            try:
                with urllib.request.urlopen(urllib.request.Request(endpoints[n % len(endpoints)], data, head), timeout=30) as answer:
                    return "", answer.read()
            except urllib.error.HTTPError as e:
                return str(e.code), b""
            except (OSError, TimeoutError):
                return "unreachable", b""

        def post(parts: list[str], docs: list[str], n: int) -> list[tuple[str, str]]:
            data = join.join(parts).encode()
            data = gzip.compress(data) if gzipped else data
            error = ""
            for k in range(retries + 1):
                error, answer = attempt(data, n + k)
                if error == "413" and len(parts) > 1 and split:
                    half = len(parts) // 2
                    return post(parts[:half], docs[:half], n) + post(parts[half:], docs[half:], n)
                if not error or error in REJECTED:
                    break
                if k < retries:
                    time.sleep(wait * factor**k * random.uniform(0.5, 1.5))
            if error:
                return [(d, error) for d in docs]
            if not items:
                return []
            try:
                told = json.loads(answer or b"{}")
                results = [next(iter(x.values())) for x in told.get("items", [])] if told.get("errors") else []
            except (ValueError, AttributeError):
                return []
            return [(d, "rejected") for d, r in zip(docs, results) if int(r.get("status", 200)) >= 400]

        parts: list[str] = []
        docs: list[str] = []
        n = 0
        for b in batches:
            for part, doc in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts.append(part)
                docs.append(doc)
                if len(parts) >= most:
                    if failed := post(parts, docs, n):
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*failed)], ["doc", "error"])
                    parts, docs, n = [], [], n + 1
        if parts and (failed := post(parts, docs, n)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*failed)], ["doc", "error"])

    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(body.alias("b"), whole.alias("doc")).where("b is not null").mapInArrow(send, "doc string, error string")


@sink("elasticsearch", by_batch=True)
def elasticsearch(df: DataFrame, spec: dict) -> DataFrame:
    return _post(df, es_bulk(df, spec), {**spec, "endpoints": [e.rstrip("/") + "/_bulk" for e in spec["endpoints"]], "content_type": "application/x-ndjson"}, items=True)


@sink("http", by_batch=True)
def http(df: DataFrame, spec: dict) -> DataFrame:
    return _post(df, http_body(df, spec), spec)


@sink("splunk", by_batch=True)
def splunk(df: DataFrame, spec: dict) -> DataFrame:
    return _post(df, splunk_event(df, spec), {**spec, "endpoints": [spec["endpoint"]], "headers": {"Authorization": f"Splunk {spec['token']}"}})


@sink("loki", by_batch=True)
def loki(df: DataFrame, spec: dict) -> DataFrame:
    row = loki_row(df, spec)
    labels = {x["label"]: x["value"] for x in spec.get("labels") or []}
    value = F.to_json(F.struct(F.array(F.struct(F.from_json(F.lit(json.dumps(labels)), "map<string,string>").alias("stream"), F.array(F.array(row["ts"], row["line"], F.to_json(row["meta"]))).alias("values"))).alias("streams")))
    return _post(df.where(row.isNotNull()), value, {**spec, "endpoints": [spec["address"].rstrip("/") + "/loki/api/v1/push"], "batch_size": 1})


def _stream(df: DataFrame, body: Column, address: str, network: str, delimiter: str) -> None:
    def send(rows: Iterator[Row]) -> None:
        import socket

        kind = socket.SOCK_DGRAM if network == "udp" else socket.SOCK_STREAM
        if network == "unix":
            s = socket.socket(socket.AF_UNIX, kind)
            s.connect(address)
        else:
            host, _, port = address.rpartition(":")
            s = socket.socket(socket.AF_INET, kind)
            s.connect((host or "localhost", int(port)))
        with s:
            for r in rows:
                s.sendall((r[0] + delimiter).encode())

    df.select(body.alias("b")).foreachPartition(send)


@sink("socket")
def socket_sink(df: DataFrame, spec: dict) -> None:
    _stream(df, document(df), spec["address"], spec.get("network", "tcp"), spec.get("delimiter", "\n"))


@sink("gelf")
def gelf(df: DataFrame, spec: dict) -> None:
    _stream(df, gelf_message(df, spec), spec["endpoint"], "tcp", "\0")


@sink("kafka")
def kafka(df: DataFrame, spec: dict) -> None:
    brokers = spec["brokers"]
    kafka_rows(df, spec).write.format("kafka").option("kafka.bootstrap.servers", ",".join(brokers) if isinstance(brokers, list) else brokers).option("kafka.compression.type", spec.get("compression", "none")).save()


@sink("clickhouse")
def clickhouse(df: DataFrame, spec: dict) -> None:
    clickhouse_rows(df, spec).write.format("jdbc").mode("append").options(url=spec["url"], dbtable=spec["table"]).save()


@sink("postgres")
def postgres(df: DataFrame, spec: dict) -> None:
    rows = postgres_rows(df, spec)
    if not any(c.get("unique") for c in spec["columns"]):
        return rows.write.format("jdbc").mode("append").options(url=spec["url"], dbtable=spec["table"]).save()
    sql = postgres_upsert(spec).replace("?", "%s")

    def send(part: Iterator[Row]) -> None:
        import psycopg2  # a driver that the cluster provides

        with psycopg2.connect(spec["conn_string"]) as c, c.cursor() as cur:
            cur.executemany(sql, [tuple(r) for r in part])

    return rows.foreachPartition(send)


def s3_buckets(df: DataFrame, spec: dict) -> DataFrame:
    """The document's text and its bucket: the field's, if it is known or dynamic ones are allowed, else the default."""
    bucket = F.lit(spec["bucket"])
    if spec.get("bucket_field_event"):
        value = Document(df).text(spec["bucket_field_event"])
        known = [b["bucket"] for b in spec.get("multi_buckets") or []]
        bucket = F.when((value != "") & (F.lit(int(spec.get("dynamic_buckets_limit", 32)) > 0) | value.isin(known or [""])), value).otherwise(bucket)
    return df.select(bucket.alias("bucket"), document(df).alias("value"))


@sink("s3")
def s3(df: DataFrame, spec: dict) -> None:
    s3_buckets(df, spec).write.mode("append").partitionBy("bucket").option("compression", "gzip").text(spec["path"])
