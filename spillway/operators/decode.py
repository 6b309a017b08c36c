"""Decoders: text of a known format into fields. All but protobuf and odd CSV are native expressions.

``decoder(name, text, params)`` gives (fields, ok): named columns and whether the text was well formed.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import Document, Node
from .registry import editor

CRI = r"(?s)^(\S*) (?:\S* )*?(stdout|stderr) (\S+) (.*)\z"
POSTGRES = r"(?s)^(\S+ \S+ \S+) \[([0-9]+)\] => \[([0-9-]+)\] client=([^,]*),db=([^,]*),user=([^ ]*) [A-Z]+[0-9]*:  ?(.*)\z"
_CLOCK = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
_DAY = r"(?:0[1-9]|1[0-2]){0}(?:0[1-9]|[12][0-9]|3[01])"
NGINX = rf"(?s)^([0-9]{{4}}/{_DAY.format('/')} {_CLOCK}) \[([a-z]+)\] ([0-9]+)#([0-9]+):(?: \*([0-9]+))?(?: ?(.*))\z"
_PRIORITY = r"<(0?[0-9]{1,2}|1[0-8][0-9]|19[01])>"
_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
SYSLOG3164 = rf"(?s)^{_PRIORITY}((?:{_MONTHS}) (?:[ 0][1-9]|[12][0-9]|3[01]) {_CLOCK}) (\S+) ([^\[: ]+)(?:\[([^\]]*)\])?: ?(.*)\z"
_RFC3339 = rf"[0-9]{{4}}-{_DAY.format('-')}T{_CLOCK}(?:\.[0-9]{{1,6}})?(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])\S*"
SYSLOG5424 = rf"(?s)^{_PRIORITY}([0-9]{{1,3}}) (-|{_RFC3339}) (\S+) (\S+) (\S+) (\S+) (-|(?:\[[^\]\\\"]+(?:\"(?:[^\"\\]|\\.)*\"[^\]\"]*)*\])+)(?: (?:\x{{FEFF}})?(.*))?\z"
FACILITIES = "KERN USER MAIL DAEMON AUTH SYSLOG LPR NEWS UUCP CRON AUTHPRIV FTP NTP SECURITY CONSOLE SOLARISCRON LOCAL0 LOCAL1 LOCAL2 LOCAL3 LOCAL4 LOCAL5 LOCAL6 LOCAL7".split()
SEVERITIES = "EMERG ALERT CRIT ERROR WARN NOTICE INFO DEBUG".split()
_CUT = "\u0001\ue000\u0001"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"\r?\n\z", "")


def _match(text: Column, pattern: str, groups: int) -> Column:
    """The groups of a pattern of the whole text as an array, null where it doesn't match. The text is matched
    twice, however many groups are used: once for the test, once for all groups."""
    return F.when(text.rlike(pattern), F.split(F.regexp_replace(text, pattern, _CUT.join(f"${i}" for i in range(1, groups + 1))), _CUT, groups))


def _named(parsed: Column, names: list[str], optional: tuple = ()) -> tuple[dict[str, Column], Column]:
    """Named groups; an empty one of the optional is null."""
    out = {n: F.get(parsed, F.lit(i)) for i, n in enumerate(names)}
    return {n: F.nullif(v, F.lit("")) if n in optional else v for n, v in out.items()}, parsed.isNotNull()


def _let(value: Column, use) -> Column:
    """What ``use`` makes of the value, which is evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _last(keys: Column, values: Column) -> Column:
    """A map of keys and values in which the last of equal keys counts."""

    def unique(entries: Column) -> Column:
        later = lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"])
        return F.map_from_entries(F.filter(entries, later))

    return _let(F.arrays_zip(keys.alias("key"), values.alias("value")), unique)


def cri(parsed: Column, params: dict) -> tuple[dict, Column]:
    """time, stream, log; a partial line (tag P...) loses its line end."""
    out, ok = _named(parsed, ["time", "stream", "_tag", "log"])
    tag = out.pop("_tag")
    out["log"] = F.when(F.startswith(tag, F.lit("P")), _strip(out["log"])).otherwise(out["log"])
    return out, ok


def postgres(parsed: Column, params: dict) -> tuple[dict, Column]:
    return _named(parsed, ["time", "pid", "pid_message_number", "client", "db", "user", "log"])


def nginx_error(parsed: Column, params: dict) -> tuple[dict, Column]:
    """time, level, pid, tid, cid, message; with ``nginx_with_custom_fields`` the trailing ``, key: value`` parts (keys of
    letters) leave the message for the map custom_fields, of equal keys the last that isn't cut off; those that
    the parameter custom_fields names are columns too."""
    out, ok = _named(parsed, ["time", "level", "pid", "tid", "cid", "message"], ("cid", "message"))
    if params.get("nginx_with_custom_fields"):
        tail = r"((?:, [a-zA-Z]+:(?: (?:\"[^\"]*\"|[^,\"]*))?)*)\z"
        rest = F.regexp_extract(out["message"], tail, 1)
        keys = F.regexp_extract_all(rest, F.lit(r", ([a-zA-Z]+):(?: (?:\"[^\"]*\"|[^,\"]*))?"), F.lit(1))
        values = F.regexp_extract_all(rest, F.lit(r", [a-zA-Z]+:(?: (\"[^\"]*\"|[^,\"]*))?"), F.lit(1))
        values = F.transform(values, lambda v: F.regexp_replace(v, r"^\"|\"\z", ""))
        out["custom_fields"] = F.when(out["message"].isNotNull(), _last(keys, values))
        for name in params.get("custom_fields", ["client", "server", "request", "upstream", "host", "referrer"]):
            out[name] = F.try_element_at(out["custom_fields"], F.lit(name))
        out["message"] = F.substring(out["message"], F.lit(1), F.length(out["message"]) - F.length(rest))
    return out, ok


def _levels(out: dict, params: dict) -> None:
    n = out["priority"].try_cast("int")
    facility, severity = F.floor(n / F.lit(8)).cast("int"), F.pmod(n, F.lit(8))
    named = lambda x, names: F.get(F.array(*[F.lit(v) for v in names]), x)
    out["facility"] = named(facility, FACILITIES) if params.get("syslog_facility_format") == "string" else facility.cast("string")
    out["severity"] = named(severity, SEVERITIES) if params.get("syslog_severity_format") == "string" else severity.cast("string")


def syslog_rfc3164(parsed: Column, params: dict) -> tuple[dict, Column]:
    out, ok = _named(parsed, ["priority", "timestamp", "hostname", "app_name", "process_id", "message"], ("process_id",))
    _levels(out, params)
    return out, ok


def syslog_rfc5424(parsed: Column, params: dict) -> tuple[dict, Column]:
    """Header fields ('-' is null), message, and structured data as map<id, map<name, value>>; of equal names or ids the last counts."""
    out, ok = _named(parsed, ["priority", "proto_version", "timestamp", "hostname", "app_name", "process_id", "message_id", "_sd", "message"], ("message",))
    _levels(out, params)
    sd = out.pop("_sd")
    out = {k: F.nullif(v, F.lit("-")) if k not in ("message", "priority", "facility", "severity") else v for k, v in out.items()}
    blocks = F.regexp_extract_all(sd, F.lit(r"\[((?:[^\]\"]|\"(?:[^\"\\]|\\.)*\")+)\]"), F.lit(1))

    def one(block: Column) -> Column:
        keys = F.regexp_extract_all(block, F.lit(r" ([^ =\]\"]+)=\"((?:[^\"\\]|\\.)*)\""), F.lit(1))
        values = F.regexp_extract_all(block, F.lit(r" ([^ =\]\"]+)=\"((?:[^\"\\]|\\.)*)\""), F.lit(2))
        return _last(keys, F.transform(values, lambda v: F.regexp_replace(v, r"\\([\\\]\"])", "$1")))

    out["structured_data"] = F.when(sd != "-", _let(blocks, lambda all_: _last(F.transform(all_, lambda b: F.regexp_extract(b, r"^([^ ]+)", 1)), F.transform(all_, one))))
    return out, ok


def _delimiter(params: dict) -> str:
    sep = params.get("delimiter", ",")
    if len(sep.encode()) != 1 or sep in '"\r\n\0':
        raise ValueError("the delimiter must be one byte, and no quote or line end")
    return sep


def cells(text: Column, params: dict) -> Column:
    """The fields of an RFC 4180 line as an array, null where a quote is bare or open. A last field without quotes is trimmed."""
    sep = _delimiter(params)
    s = "\\" + sep if sep != "\t" else "\\t"
    field = rf"(?:\"(?:[^\"]|\"\")*\"|[^{s}\"]*)"
    body = _strip(text)
    found = F.regexp_extract_all(F.concat(F.lit(sep), F.regexp_replace(body, rf"(^|{s})\s*([^{s}\"]*[^{s}\"\s])\s*\z", "$1$2")), F.lit(rf"(?s){s}({field})"), F.lit(1))
    found = F.transform(found, lambda c: F.when(F.startswith(c, F.lit('"')), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(body.rlike(rf"(?s)^{field}(?:{s}{field})*\z"), found)


def csv(parsed: Column, params: dict) -> tuple[dict, Column]:
    """Fields named by ``columns``: another number of them is an error, unless ``invalid_line_mode`` is continue; then missing ones are
    null and more are in the map more_fields. Without columns all fields are in the map ``fields``, named by prefix and
    number, or, where ``fields`` says how many are wanted, those first ones are columns."""
    names, prefix, size = list(params.get("columns") or []), params.get("prefix", ""), F.size(parsed)
    numbered = F.map_from_arrays(F.transform(parsed, lambda c, i: F.concat(F.lit(prefix), i.cast("string"))), parsed)
    ok = parsed.isNotNull()
    if not names:
        if "fields" not in params:
            return {"fields": numbered}, ok
        return {f"{prefix}{i}": F.get(parsed, F.lit(i)) for i in range(int(params["fields"]))}, ok
    out = {name: F.get(parsed, F.lit(i)) for i, name in enumerate(names)}
    if params.get("invalid_line_mode") == "continue":
        out["more_fields"] = F.when(size > len(names), F.map_filter(numbered, lambda k, v: F.substring(k, F.lit(len(prefix) + 1), F.lit(9)).cast("int") >= len(names)))
        return out, ok
    ok = F.coalesce(ok & (size == len(names)), F.lit(False))
    return {k: F.when(ok, v) for k, v in out.items()}, ok


def raw(text: Column, params: dict) -> tuple[dict, Column]:
    """The text without its line end; ``compat`` drops the last byte whatever it is."""
    value = F.substring(text, F.lit(1), F.length(text) - 1) if params.get("compat") else F.regexp_replace(text, r"\n\z", "")
    return {"message": value}, text.isNotNull()


def _schema(schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)


def cut_strings(col: Column, kind: T.DataType, limits: dict[str, int], at: str = "") -> Column:
    """Strings of the paths that ``limits`` names cut to so many bytes."""
    if isinstance(kind, T.StructType) and any(p.startswith(at) for p in limits):
        return F.when(col.isNotNull(), F.struct(*[cut_strings(col.getField(f.name), f.dataType, limits, f"{at}{f.name}.").alias(f.name) for f in kind.fields]))
    limit = limits.get(at[:-1])
    if limit is not None and isinstance(kind, T.StringType):
        return F.when(F.octet_length(col) > limit, F.substring(F.encode(col, "utf-8"), 1, limit).cast("string")).otherwise(col)
    return col


def from_json(text: Column, schema: T.StructType, limits: dict | None = None) -> tuple[dict, Column]:
    value = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    ok = F.coalesce(F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("{"), F.lit(False))
    return {f.name: F.when(ok, cut_strings(value.getField(f.name), f.dataType, limits or {}, f"{f.name}.")) for f in schema.fields}, ok


def protobuf(text: Column, params: dict) -> tuple[dict, Column]:
    """Binary messages by a serialized FileDescriptorSet (``descriptor``) and ``proto_message``; default values appear."""
    descriptor, message, schema = params["descriptor"], params["proto_message"], _schema(params["schema"])

    @F.pandas_udf(T.StringType())
    def decode(data: pd.Series) -> pd.Series:
        from google.protobuf import descriptor_pb2, descriptor_pool, json_format, message_factory

        pool = descriptor_pool.DescriptorPool()
        for f in descriptor_pb2.FileDescriptorSet.FromString(descriptor).file:
            pool.Add(f)
        kind = message_factory.GetMessageClass(pool.FindMessageTypeByName(message))

        def one(b):
            try:
                return json.dumps(json_format.MessageToDict(kind.FromString(bytes(b)), preserving_proto_field_name=True, always_print_fields_with_no_presence=True))
            except Exception:  # noqa: BLE001 - any malformed message is a decode error
                return None

        return data.map(one)

    return from_json(decode(text.cast("binary")), schema)


#: What is parsed once from the text, and the fields of what was parsed.
PARSED = {
    "cri": (lambda t, p: _match(t, CRI, 4), cri),
    "postgres": (lambda t, p: _match(_strip(t), POSTGRES, 7), postgres),
    "nginx_error": (lambda t, p: _match(_strip(t), NGINX, 6), nginx_error),
    "syslog_rfc3164": (lambda t, p: _match(_strip(t), SYSLOG3164, 6), syslog_rfc3164),
    "syslog_rfc5424": (lambda t, p: _match(_strip(t), SYSLOG5424, 9), syslog_rfc5424),
    "csv": (cells, csv),
}
DECODERS = {"raw": raw, "protobuf": protobuf}


def decoder(name: str, text: Column, params: dict) -> tuple[dict[str, Column], Column]:
    if name in ("json", "auto"):
        return from_json(text, _schema(params["schema"]), params.get("json_max_fields_size"))
    if name in PARSED:
        parse, fields = PARSED[name]
        return fields(parse(text, params), params)
    return DECODERS[name](text, params)


def decoded(df: DataFrame, name: str, column: str = "value", params: dict | None = None, strict: bool = False) -> DataFrame:
    """Rows of raw text as documents: those that can't be decoded are dropped, or fail the job if strict."""
    env = [F.col(c) for c in df.columns if c.startswith("_")]
    if name in PARSED:  # a projection of its own, so that all fields come from one match
        parse, build = PARSED[name]
        df = df.select(*env, F.col(column), parse(F.col(column), params or {}).alias("__parsed"))
        fields, ok = build(F.col("__parsed"), params or {})
    else:
        fields, ok = decoder(name, F.col(column), params or {})
    good = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.col(column)))) if strict else ok
    return df.where(good).select(*env, *[v.alias(k) for k, v in fields.items()])


@editor("decode")
def decode(doc: Document, field: str, decoder: str = "json", params: dict | None = None, prefix: str = "", keep_origin: bool = False, log_decode_error_mode: str = "off") -> None:
    """Decodes a field and merges the result into the root; rows that don't decode keep the field."""
    col = doc.get(field)
    if col is None:
        return
    fields, ok = globals()["decoder_of"](decoder, col, params or {})
    before = {k: n for k, n in doc.root.children.items()}
    if not keep_origin:
        doc.set(field, F.when(~ok, col), doc.kind(field))
    for k, v in fields.items():
        name = prefix + k
        if name in before and name != field:
            v = F.when(ok, v.cast("string")).otherwise(before[name].value().cast("string"))
        elif name == field:
            v = F.when(ok, v).otherwise(col)
        doc.put(name, Node(v))


decoder_of = decoder


@editor("json_decode")
def json_decode(doc: Document, field: str, schema: str, prefix: str = "", log_json_parse_error_mode: str = "off") -> None:
    """An object's JSON text is replaced by its fields at the root; other texts stay. ``schema`` is DDL."""
    decode_into(doc, field, schema, prefix)


def decode_into(doc: Document, field: str, schema: str, prefix: str) -> None:
    col = doc.get(field)
    if col is None:
        return
    fields, ok = from_json(col, _schema(schema))
    doc.set(field, F.when(~ok, col), T.StringType())
    for k, v in fields.items():
        doc.put(prefix + k, Node(v))
