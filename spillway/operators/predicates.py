"""Predicates: do_if trees, match_fields and rule sets, as boolean columns that are never null."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import regex, timefmt
from ..functions.paths import Document

CONTAINERS = (T.StructType, T.ArrayType, T.MapType)
COMPARE = {"lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b}
TYPES = {
    "object": "object", "obj": "object", "array": "array", "arr": "array", "number": "number", "num": "number", "string": "string", "str": "string", "null": "null", "nil": "nil",
}
STARTED = datetime.now(UTC)


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def any_of(parts: list[Column]) -> Column:
    return reduce(or_, parts) if parts else F.lit(False)


def all_of(parts: list[Column]) -> Column:
    return reduce(and_, parts) if parts else F.lit(True)


def seconds(text: str) -> float:
    """A duration such as 1h30m, 500ms or -10s."""
    import re

    unit = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
    body = text.lstrip("+-")
    found = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h|d|w)", body)
    if "".join(a + b for a, b in found) != body:
        raise ValueError(f"bad duration {text!r}")
    return sum(float(a) * unit[b] for a, b in found) * (-1 if text.startswith("-") else 1)


def _values(node: dict) -> list[str | None]:
    v = node.get("values", node.get("value"))
    return list(v) if isinstance(v, (list, tuple)) else [v]


def _field_op(doc: Document, op: str, node: dict) -> Column:
    values = _values(node)
    if not values:
        raise ValueError(f"{op}: no values")
    col, kind = doc.get(node["field"]), doc.kind(node["field"])
    if kind is not None and isinstance(kind, CONTAINERS):
        return F.lit(False)
    if col is None:
        return F.lit(op == "equal" and None in values)
    data = col.cast("string")
    if op == "equal" and None in values:
        rest = [v for v in values if v is not None]
        return data.isNull() | (_field_op(doc, op, {**node, "values": rest}) if rest else F.lit(False))
    texts = [str(v) for v in values]
    if op == "regex":
        return sure(any_of([data.rlike(regex.java(v)) for v in texts]))
    data = F.coalesce(data, F.lit("")) if op != "equal" else data
    if not node.get("case_sensitive", True):
        data, texts = F.lower(data), [v.lower() for v in texts]
    if op == "equal":
        return sure(data.isin(texts))
    if op == "contains":
        return any_of([F.contains(data, F.lit(v)) for v in texts])
    if op == "contains_any":
        if len(texts) != 1:
            raise ValueError("contains_any takes one value")
        return any_of([F.contains(data, F.lit(c)) for c in dict.fromkeys(texts[0])])
    if op == "prefix":
        return any_of([F.startswith(data, F.lit(v)) for v in texts])
    return any_of([F.endswith(data, F.lit(v)) for v in texts])


def _compare(doc: Document, op: str, node: dict) -> Column:
    cmp, value = COMPARE[node["cmp_op"]], int(node["value"])
    if value < 0:
        raise ValueError(f"{op}: value must not be negative")
    col, kind = doc.get(node["field"]), doc.kind(node["field"])
    if col is None:
        return F.lit(False)
    if op == "byte_len_cmp":
        data = F.octet_length(F.to_json(col, {"ignoreNullFields": "false"})) if isinstance(kind, CONTAINERS) else F.octet_length(col.cast("string"))
    elif op == "array_len_cmp":
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        data = F.when(col.isNotNull(), F.size(col))
    else:
        if isinstance(kind, CONTAINERS):
            return F.lit(False)
        data = col.cast("string").try_cast("bigint")
    return sure(cmp(data, F.lit(value)))


def _ts(doc: Document, node: dict) -> Column:
    col, kind = doc.get(node["field"]), doc.kind(node["field"])
    if col is None or not isinstance(kind, T.StringType):
        return F.lit(False)
    value, shift = str(node.get("value", "now")), seconds(str(node.get("value_shift", "0s")))
    right = F.current_timestamp() if value == "now" else F.lit(STARTED) if value == "started" else F.lit(value).cast("timestamp")
    if value == "now":
        shift += seconds(str(node.get("update_interval", "10s")))
    micros = F.unix_micros(right) + F.lit(int(shift * 1_000_000))
    return sure(COMPARE[node["cmp_op"]](F.unix_micros(timefmt.parse(col, node.get("format", "rfc3339nano"))), micros))


def _type(doc: Document, node: dict) -> Column:
    wanted = {TYPES[str(v)] for v in _values(node)}
    col, kind = doc.get(node["field"]), doc.kind(node["field"])
    if col is None:
        return F.lit("nil" in wanted)
    have = "object" if isinstance(kind, (T.StructType, T.MapType)) else "array" if isinstance(kind, T.ArrayType) else "number" if isinstance(kind, T.NumericType) else "string" if isinstance(kind, T.StringType) else "other"
    return F.when(col.isNull(), F.lit(bool(wanted & {"null", "nil"}))).otherwise(F.lit(have in wanted))


def do_if(doc: Document, node: dict) -> Column:
    op = node["op"]
    if op in ("and", "or", "not"):
        kids = [do_if(doc, n) for n in node.get("operands", [])]
        if not kids or (op == "not" and len(kids) != 1):
            raise ValueError(f"{op}: wrong number of operands")
        return ~kids[0] if op == "not" else (all_of if op == "and" else any_of)(kids)
    if op in ("equal", "contains", "contains_any", "prefix", "suffix", "regex"):
        return _field_op(doc, op, node)
    if op in ("byte_len_cmp", "array_len_cmp", "int_val_cmp"):
        return _compare(doc, op, node)
    if op == "ts_cmp":
        return _ts(doc, node)
    if op == "check_type":
        return _type(doc, node)
    raise ValueError(f"unknown op {op!r}")


def match_fields(doc: Document, fields: dict, mode: str = "and", invert: bool = False, compat: bool = False) -> Column:
    """Exact values (prefixes in the _prefix modes) or, for a value /.../, a regular expression.

    ``compat`` keeps a known defect: in the and modes a regular expression never holds."""
    if mode not in ("and", "or", "and_prefix", "or_prefix"):
        raise ValueError(f"unknown match_mode {mode!r}")
    parts = []
    for path, values in (fields or {}).items():
        col, kind = doc.get(path), doc.kind(path)
        texts = [str(v) for v in (values if isinstance(values, (list, tuple)) else [values])]
        if col is None or isinstance(kind, CONTAINERS):
            parts.append(F.lit(False))
        elif len(texts) == 1 and texts[0].startswith("/"):
            parts.append(F.lit(False) if compat and mode.startswith("and") else sure(col.cast("string").rlike(regex.java(texts[0].strip("/")))))
        elif mode.endswith("_prefix"):
            parts.append(any_of([sure(F.startswith(col.cast("string"), F.lit(v))) for v in texts]))
        else:
            parts.append(sure(col.cast("string").isin(texts)))
    found = (all_of if mode.startswith("and") else any_of)(parts)
    return ~found if invert else found


def rule_sets(data: Column, sets: list[dict]) -> Column:
    """Whether any of the rule sets holds for the text."""
    return any_of([rule_set(data, s) for s in sets])


def rule_set(data: Column, spec: dict) -> Column:
    parts = []
    for rule in spec.get("rules", []):
        text, values = F.coalesce(data.cast("string"), F.lit("")), [str(v) for v in rule.get("values", [])]
        if rule.get("case_insensitive"):
            text, values = F.lower(text), [v.lower() for v in values]
        test = {"prefix": F.startswith, "contains": F.contains, "suffix": F.endswith}[rule.get("mode", "prefix")]
        found = any_of([test(text, F.lit(v)) for v in values])
        parts.append(~found if rule.get("invert") else found)
    if not parts:
        return F.lit(False)
    return (any_of if spec.get("cond", "and") == "or" else all_of)(parts)
