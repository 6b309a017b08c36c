"""Field-shaping operators. All are projections: Catalyst collapses a chain of them into one."""

from __future__ import annotations

import socket

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths, substitution, timefmt
from ..functions.paths import Document, Node
from .predicates import seconds
from .registry import action, editor


@editor("add_file_name")
def add_file_name(doc: Document, field: str = "file_name") -> None:
    """The source's name: the envelope's, or the file a row was read from."""
    name = F.col("_source_name") if "_source_name" in doc.df.columns else F.input_file_name()
    doc.set([field], name, T.StringType())


@editor("add_host")
def add_host(doc: Document, field: str = "host") -> None:
    doc.set(field, F.lit(socket.gethostname()), T.StringType())


@editor("keep_fields")
def keep_fields(doc: Document, fields: list[str]) -> None:
    """Only the paths that exist, in the document's order; a parent stays if one of its targets exists."""
    wanted = [p for p in paths.outermost(fields) if doc.find(p) is not None]

    def prune(node: Node, rest: list[list[str]]) -> Node:
        if any(not r for r in rest):
            return node
        kids = node.open()
        names = {r[0] for r in rest}
        return Node(children={k: prune(v, [r[1:] for r in rest if r[0] == k]) for k, v in kids.items() if k in names})

    doc.root = prune(doc.root, wanted) if wanted else Node(children={})


@editor("remove_fields")
def remove_fields(doc: Document, fields: list[str]) -> None:
    for p in paths.outermost(fields):
        doc.drop(p)


@editor("rename")
def rename(doc: Document, fields: dict | list, override: bool = False) -> None:
    """Moves each path, in order, to the root under its new name, unless that exists and override is off."""
    for path, name in fields.items() if isinstance(fields, dict) else fields:
        if name in doc.root.children and not override or doc.find(path) is None:
            continue
        doc.put(name, doc.drop(path[1:] if path.startswith("_") else path))


@editor("move")
def move(doc: Document, fields: list[str], mode: str, target: str) -> None:
    """allow: the listed paths into the target by their last names; block: all other root fields."""
    if mode not in ("allow", "block"):
        raise ValueError(f"unknown mode {mode!r}")
    into = paths.parse(target)
    if mode == "block":
        fields = [k for k in doc.names() if k not in fields and k != into[0]]
        chosen = [[k] for k in fields]
    else:
        chosen = [paths.parse(f) for f in fields]
    for p in chosen:
        if p == into or (node := doc.drop(p)) is None:
            continue
        here = doc.root
        for part in into:
            kids = here.own()
            if part not in kids or kids[part].open() is None:
                kids[part] = Node(children={})
            here = kids[part]
        here.own()[p[-1]] = node


@editor("flatten")
def flatten(doc: Document, field: str, prefix: str = "") -> None:
    """An object's children go to the root under prefixed names; other fields stay as they are."""
    node = doc.find(field)
    if node is None or node.open() is None:
        return
    kids = doc.drop(field).open()
    for k, v in kids.items():
        doc.put(prefix + k, v)


@editor("modify")
def modify(doc: Document, fields: dict[str, str], skip_empty: bool = False) -> None:
    """Templates whose results are strings; with ``skip_empty`` (or _skip_empty) empty results change nothing."""
    fields = dict(fields)
    skip_empty = fields.pop("_skip_empty", skip_empty) in (True, "true")
    for path, template in fields.items():
        value = substitution.render(template, doc.text)
        if skip_empty:
            before, kind = doc.get(path), doc.kind(path)
            old = F.lit(None).cast("string") if before is None else before.cast("string")
            if kind is not None and not isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
                value = F.when(value == "", old).otherwise(value)
            elif before is None:
                value = F.when(value != "", value)
        doc.set(path, value, T.StringType())


@editor("set_time")
def set_time(doc: Document, field: str = "time", format: str = "rfc3339nano", override: bool = True) -> None:
    if field in doc.root.children and not override:
        return
    kind = T.LongType() if timefmt.known(format) in timefmt.UNIX else T.StringType()
    doc.set([field], timefmt.to_format(F.current_timestamp(), format), kind)


@editor("json_encode")
def json_encode(doc: Document, field: str) -> None:
    """A field becomes its JSON text."""
    node, kind = doc.find(field), doc.kind(field)
    if node is None:
        return
    value = node.value()
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(value, {"ignoreNullFields": "false"})
    else:
        wrapped = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
        text = F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)
    doc.set(field, text, T.StringType())


@action("discard")
def discard(df: DataFrame, when: Column | None = None) -> DataFrame:
    """Drops the rows that match."""
    return df.where(F.lit(False) if when is None else ~when)


@action("debug")
def debug(df: DataFrame, when: Column | None = None, interval: str = "0s", first: int = 10, thereafter: int = 0, message: str = "event sample") -> DataFrame:
    """Passes every row; how many matched, and how many of them a log would show, are observed metrics named by the message.

    With an interval, of each run or micro-batch the first and then every ``thereafter``-th row (none for 0) is shown."""
    seen = F.count(F.lit(1) if when is None else F.when(when, 1))
    return df.observe(message.replace(" ", "_"), seen.alias("seen"), shown(seen, interval, first, thereafter).alias("shown"))


def shown(seen: Column, interval: str, first: int, thereafter: int) -> Column:
    """How many of so many rows a log with these settings shows."""
    if seconds(interval) <= 0:
        return seen
    later = F.floor(F.greatest(seen - first, F.lit(0)) / thereafter) if thereafter > 0 else F.lit(0)
    return (F.least(seen, F.lit(first)) + later).cast("bigint")


@editor("convert_date")
def convert_date(doc: Document, field: str = "time", source_formats: list[str] = ("rfc3339nano", "rfc3339"), target_format: str = "unixtime", remove_on_fail: bool = False) -> None:
    """The first format that parses wins; what none parses stays, or goes."""
    col, kind = doc.get(field), doc.kind(field)
    if col is None:
        return
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        ts = col.cast("timestamp")
    else:
        text = F.format_string("%.6f", col) if isinstance(kind, T.DoubleType) else col.cast("string")
        ts = F.coalesce(*[timefmt.parse(text, f) for f in source_formats])
    value = timefmt.to_format(ts, target_format)
    number = timefmt.known(target_format) in timefmt.UNIX
    if remove_on_fail or isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        doc.set(field, value, T.LongType() if number else T.StringType())
    elif number and isinstance(kind, (T.LongType, T.IntegerType, T.DoubleType)):
        doc.set(field, F.coalesce(value, col.cast("bigint")), T.LongType())
    else:
        doc.set(field, F.coalesce(value.cast("string"), col.cast("string")), T.StringType())


LEVELS = [
    ("emergency", "0", "emerg", "fatal", "panic", "dpanic"), ("alert", "1"), ("critical", "2", "crit"), ("error", "3", "err"),
    ("warning", "4", "warn"), ("notice", "5"), ("informational", "6", "info"), ("debug", "7"),
]


def level_number(text: Column) -> Column:
    t = F.lower(F.trim(text))
    out = F.when(F.lit(False), F.lit(0))
    for i, names in enumerate(LEVELS):
        out = out.when(t.isin(list(names)), F.lit(i))
    return out


@editor("convert_log_level")
def convert_log_level(doc: Document, field: str = "level", style: str = "number", default_level: str = "", remove_on_fail: bool = False) -> None:
    if style not in ("number", "string"):
        raise ValueError(f"unknown style {style!r}")
    col = doc.get(field)
    if col is None and not default_level:
        return
    n = level_number(doc.text(field))
    if default_level:
        n = F.coalesce(n, level_number(F.lit(default_level)))
    if style == "number":
        failed = None if remove_on_fail or col is None else F.when(n.isNull(), col.cast("string"))
        if failed is None or isinstance(doc.kind(field), T.NumericType):
            doc.set(field, n if failed is None else F.coalesce(n, col.cast("int")), T.IntegerType())
        else:
            doc.set(field, F.coalesce(n.cast("string"), failed), T.StringType())
        return
    name = F.when(n == 0, F.lit(LEVELS[0][0]))
    for i, names in enumerate(LEVELS[1:], 1):
        name = name.when(n == i, F.lit(names[0]))
    doc.set(field, name if remove_on_fail or col is None else F.coalesce(name, col.cast("string")), T.StringType())
