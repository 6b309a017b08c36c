"""Operators over ordered streams, and generators: split, join, templates, fragments, bulk streams.

A stream is (_source_id, _stream), or the one of these columns that there is; its order is _seq. All ordered operators share one window specification, so chained ones share an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import regex
from ..functions.paths import Document, parse
from .registry import action

TEMPLATES = {
    "go_panic": (
        r"^(panic:|fatal error:)|http: panic serving",
        r"^\[signal|^\s*$|goroutine [0-9]+ (?:.* )?\[|\.go:[0-9]+|created by .*/?.*\.|panic.+[0-9]x[0-9a-f]+|panic:|<autogenerated>:|[A-Za-z_]+[A-Za-z0-9_]*\)?\.[A-Za-z0-9_]+\(.*\)",
        False,
    ),
    "cs_exception": (r"(?i)^\s*unhandled exception", r"^\s*at\s|^\s*--->|(?i:^\s*--- end of)|\.?\w+\.?Exception:", False),
    "go_data_race": (r"^WARNING: DATA RACE", r"^==================", True),
}


def stream_of(df: DataFrame) -> list[str]:
    keys = [c for c in ("_source_id", "_stream") if c in df.columns]
    if not keys:
        raise ValueError("ordered operators need _source_id or _stream: rows without would be one stream, which one task sorts")
    return keys


@action("split")
def split(df: DataFrame, when: Column | None = None, field: str = "") -> DataFrame:
    """An array of objects becomes a row for each object; other rows pass. Children keep the envelope only.

    ``_seq`` of children is followed by ``_child``, their place, so that order stays total."""
    doc = Document(df)
    kind, col = doc.kind(field), doc.get(field)
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)):
        return df
    objects = F.filter(col, lambda x: x.isNotNull())
    does = (F.size(objects) > 0) if when is None else (F.size(objects) > 0) & when
    env = [F.col(f"`{c}`") for c in df.columns if c.startswith("_")]
    own = [f.name for f in kind.elementType.fields]
    rest = [c for c in df.columns if not c.startswith("_")]
    one = F.struct(F.lit(None).cast("int").alias("__at"), F.lit(None).cast(kind.elementType).alias("__item"))
    items = F.transform(objects, lambda x, i: F.struct(i.alias("__at"), x.alias("__item")))
    rows = df.withColumn("__each", F.explode(F.when(does, items).otherwise(F.array(one))))
    item = F.col("__each.__item")
    child = F.col("__each.__at").isNotNull()
    out = []
    for name in dict.fromkeys([*rest, *own]):
        old = F.col(f"`{name}`") if name in rest else None
        new = item.getField(name) if name in own else None
        if old is not None and new is not None and df.schema[name].dataType != kind.elementType[name].dataType:
            old, new = old.cast("string"), new.cast("string")
        value = F.when(child, new) if old is None else F.when(~child, old) if new is None else F.when(child, new).otherwise(old)
        out.append(value.alias(name))
    return rows.select(*env, *out, F.coalesce("__each.__at", F.lit(0)).alias("_child"))


def chained(df: DataFrame, start: Column, go_on: Column, when: Column, field: list[str], max_event_size: int, ends: bool = False) -> DataFrame:
    """Groups of a start and what continues it, concatenated; first rows' other fields survive.

    A row begins a new piece unless it continues; a piece is joined if it begins with a start and, the predicate being
    asked only when nothing is held, any earlier start of the same run of starts passed it."""
    doc = Document(df)
    col = doc.get(field)
    keys = stream_of(df)
    by = W.partitionBy(*keys).orderBy("_seq")
    rows = df.withColumns({"__txt": col.cast("string"), "__st": F.coalesce(start, F.lit(False)), "__c": F.coalesce(go_on, F.lit(False)), "__m": F.coalesce(when, F.lit(False))})
    rows = rows.withColumn("__gid", F.sum((F.col("__txt").isNull() | F.col("__st") | ~F.col("__c")).cast("int")).over(by))
    piece = W.partitionBy(*keys, "__gid").orderBy("_seq")
    rows = rows.withColumns({"__gst": F.first("__st").over(piece), "__gm": F.first("__m").over(piece), "__head": F.row_number().over(piece) == 1})
    # the chain of starts: it ends with a piece that begins with no start
    rows = rows.withColumn("__chain", F.sum((F.col("__head") & ~F.col("__gst")).cast("int")).over(by))
    chain = W.partitionBy(*keys, "__chain").orderBy("_seq").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__joined", F.col("__gst") & F.max(F.col("__gst") & F.col("__gm") & F.col("__head")).over(chain))
    unit = F.when(F.col("__joined"), F.lit(None).cast("bigint")).otherwise(F.col("_seq"))
    if max_event_size > 0:  # a part is left out once the parts before it reach the limit
        before = F.sum(F.octet_length("__txt")).over(piece.rowsBetween(W.unboundedPreceding, -1))
        rows = rows.withColumn("__txt", F.when(F.col("__joined") & (F.coalesce(before, F.lit(0)) >= max_event_size), F.lit(None).cast("string")).otherwise(F.col("__txt")))
    parts = F.array_sort(F.collect_list(F.when(F.col("__txt").isNotNull(), F.struct("_seq", "__txt"))))
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.col("_seq")).alias("__first")
    grouped = rows.groupBy(*keys, "__gid", unit.alias("__unit"), "__joined").agg(first, F.array_join(F.transform(parts, lambda p: p["__txt"]), "").alias("__all"))
    grouped = grouped.select(*[F.col("__first")[c].alias(c) for c in df.columns], "__joined", "__all")
    out = Document(grouped.withColumnsRenamed({"__joined": "_joined_", "__all": "_all_"}))
    out.set(field, F.when(F.col("_joined_"), F.col("_all_")).otherwise(out.get(field).cast("string")), T.StringType())
    return out.frame().drop("_joined_", "_all_")


@action("join")
def join(df: DataFrame, when: Column | None = None, field: str = "", start: str = "", **more) -> DataFrame:
    """Multi-line texts: a row that matches ``start`` and the following that match ``continue`` (or, negated, don't)."""
    go_on, negate, limit = more.get("continue", ""), bool(more.get("negate", False)), int(more.get("max_event_size", 0))
    return _join(df, when, parse(field), start.strip("/"), go_on.strip("/"), negate, limit)


join.settings |= {"continue", "negate", "max_event_size"}
join.settings -= {"more"}


def _join(df: DataFrame, when: Column | None, field: list[str], start: str, go_on: str, negate: bool, limit: int) -> DataFrame:
    doc = Document(df)
    col, kind = doc.get(field), doc.kind(field)
    if col is None or not isinstance(kind, T.StringType):
        return df
    c = col.rlike(regex.java(go_on))
    return chained(df, col.rlike(regex.java(start)), ~c if negate else c, F.lit(True) if when is None else when, field, limit)


@action("join_template")
def join_template(df: DataFrame, when: Column | None = None, field: str = "log", template: str = "", templates: list[str] | None = None, max_event_size: int = 0) -> DataFrame:
    """join with known patterns; with several, the first whose start matches is current until its group ends."""
    names = list(templates or ([template] if template else []))
    if not names or (unknown := set(names) - set(TEMPLATES)):
        raise ValueError(f"unknown templates {names if not names else sorted(unknown)}")
    doc = Document(df)
    col = doc.get(field)
    if col is None:
        return df
    keys = stream_of(df)
    by = W.partitionBy(*keys).orderBy("_seq")
    which = F.lit(None).cast("int")
    for i, n in reversed(list(enumerate(names))):
        which = F.when(col.rlike(regex.java(TEMPLATES[n][0])), F.lit(i)).otherwise(which)
    df2 = df.withColumn("_which_", which)
    current = F.last("_which_", ignorenulls=True).over(by)
    df2 = df2.withColumn("_current_", current)
    go_on = F.lit(False)
    for i, n in enumerate(names):
        c = col.rlike(regex.java(TEMPLATES[n][1]))
        go_on = F.when(F.col("_current_") == i, ~c if TEMPLATES[n][2] else c).otherwise(go_on)
    return chained(df2, F.col("_which_").isNotNull(), go_on, F.lit(True) if when is None else when, parse(field), max_event_size).drop("_which_", "_current_")


AHEAD = 128 << 10  # bytes that a fragment to come may have
_HELD = "struct<n:int,held:string,used:int,bytes:bigint,open:boolean,skip:boolean,cut:boolean,out:array<struct<at:int,log:string,cut:boolean>>>"


def glued(parts: Column, limit: int, split: int, cuts: bool) -> Column:
    """The texts that fragments (t, escaped, bytes, full; one line's at most) make: (place of the last fragment, log, cut).

    Once the fragments' bytes and AHEAD exceed ``split``, what there is counts as whole. A fragment with which the text as a JSON
    string would reach ``limit`` is cut (by bytes) or dooms its line; those after it, but for a last one, are skipped."""

    def step(a: Column, x: Column) -> Column:
        size = a["bytes"] + x["bytes"]
        ends = x["full"] | (size + AHEAD > split)
        after = a["used"] + x["escaped"] + 3  # with the quotes of the text and of the fragment
        fits = F.lit(True) if limit <= 0 else after < limit
        left = F.encode(x["t"], "utf-8").substr(F.lit(1), F.greatest(F.octet_length(x["t"]) - (after - limit), F.lit(0))).cast("string")
        held = F.when(fits, F.concat(a["held"], x["t"])).when(~a["skip"] & F.lit(cuts), F.concat(a["held"], left)).otherwise(a["held"])
        used = F.when(fits, a["used"] + x["escaped"]).when(~a["skip"] & F.lit(cuts), F.lit(max(limit - 3, 0))).otherwise(a["used"])
        goes_on = F.struct(a["n"] + 1, held, used, size, F.lit(True), a["skip"] | ~fits, a["cut"] | (~fits & F.lit(cuts)), a["out"])
        skipped = F.struct(a["n"] + 1, a["held"], a["used"], size, F.lit(True), a["skip"], a["cut"], a["out"])
        tail = F.when(~a["cut"], x["t"]).otherwise(F.when(x["full"], F.lit("\n")).otherwise(F.lit("")))
        log = F.when(a["held"] == "", x["t"]).otherwise(F.concat(a["held"], tail))
        out = F.when(a["skip"] & ~a["cut"], a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(a["n"].alias("at"), log.alias("log"), (a["cut"] & (a["held"] != "")).alias("cut")))))
        whole = F.struct(a["n"] + 1, F.lit(""), F.lit(0), F.lit(0).cast("bigint"), F.lit(False), F.lit(False), F.lit(False), out)
        return F.when(~ends, goes_on.cast(_HELD)).when(a["skip"] & ~x["full"], skipped.cast(_HELD)).otherwise(whole.cast(_HELD))

    def finish(a: Column) -> Column:
        rest = F.array(F.struct((a["n"] - 1).alias("at"), a["held"].alias("log"), a["cut"].alias("cut")))
        return F.when(a["open"] & (~a["skip"] | a["cut"]), F.concat(a["out"], rest)).otherwise(a["out"])

    none = F.array().cast("array<struct<at:int,log:string,cut:boolean>>")
    start = F.struct(F.lit(0), F.lit(""), F.lit(0), F.lit(0).cast("bigint"), F.lit(False), F.lit(False), F.lit(False), none).cast(_HELD)
    return F.aggregate(parts, start, step, finish)


@action("k8s_multiline")
def k8s_multiline(
    df: DataFrame, when: Column | None = None, field: str = "log", max_event_size: int = 0, cut_off_field: str = "", pods: DataFrame | None = None, node: str = "",
    split_event_size: int = 1_000_000, cut_off_event_by_limit: bool = False, only_node: bool = False, allowed_pod_labels: list[str] | None = None,
) -> DataFrame:
    """Glues fragments until one ends in a line end, and adds the node and labels of pods.

    The last fragment's other fields survive. A line grows to ``split_event_size`` bytes at most, beyond which it is emitted in pieces;
    beyond ``max_event_size`` it goes, or, with ``cut_off_event_by_limit`` or a ``cut_off_field`` (set to true), is cut. A line that hasn't ended with the
    rows is kept. ``pods`` has k8s_namespace, k8s_pod and k8s_container_id, and columns k8s_pod_label_*, of which ``allowed_pod_labels``
    names those wanted. ``only_node`` adds the node and nothing else."""
    if only_node:
        out = Document(df)
        out.set(["k8s_node"], F.lit(node), T.StringType())
        return out.frame()
    keys = stream_of(df)
    by = W.partitionBy(*keys).orderBy("_seq")
    col = Document(df).get(field)
    text = F.coalesce(col, F.lit(""))
    full = F.coalesce(F.endswith(col, F.lit("\n")) | F.endswith(col, F.lit("\\n")), F.lit(True))
    escaped = F.octet_length(F.to_json(F.struct(text.alias("t")))) - 8
    bytes_ = F.col("_size") if "_size" in df.columns else F.octet_length(text)
    rows = df.withColumn("__gid", F.coalesce(F.sum(full.cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    part = F.struct("_seq", text.alias("t"), escaped.alias("escaped"), bytes_.cast("bigint").alias("bytes"), full.alias("full"), row.alias("row"))
    rows = rows.groupBy(*keys, "__gid").agg(F.array_sort(F.collect_list(part), lambda a, b: F.when(a["_seq"] < b["_seq"], -1).when(a["_seq"] > b["_seq"], 1).otherwise(0)).alias("__parts"))
    cuts = cut_off_event_by_limit or bool(cut_off_field)
    rows = rows.select("__parts", F.explode(glued(F.col("__parts"), max_event_size, split_event_size, cuts)).alias("__piece"))
    rows = rows.select(F.get("__parts", F.col("__piece.at"))["row"].alias("__row"), "__piece")
    rows = rows.select(*[F.col("__row")[c].alias(c) for c in df.columns], F.col("__piece.log").alias("_all_"), F.col("__piece.cut").alias("_short_"))
    return labelled(rows, field, cut_off_field if max_event_size > 0 else "", node, pods, allowed_pod_labels)


def labelled(rows: DataFrame, field: str, cut_off_field: str, node: str, pods: DataFrame | None, allowed: list[str] | None) -> DataFrame:
    """Glued rows with their text (_all_), whether it was cut (_short_), the node and the labels of their pods."""
    out = Document(rows)
    out.set(field, F.col("_all_"), T.StringType())
    if cut_off_field:
        out.set([cut_off_field], F.when(F.col("_short_"), F.lit(True)), T.BooleanType())
    if node:
        out.set(["k8s_node"], F.lit(node), T.StringType())
    got = out.frame().drop("_all_", "_short_")
    if pods is None:
        return got
    on = [c for c in ("k8s_namespace", "k8s_pod", "k8s_container_id") if c in pods.columns]
    if allowed:
        pods = pods.select(*on, *[f"k8s_pod_label_{n}" for n in allowed if f"k8s_pod_label_{n}" in pods.columns])
    return lookup(got, pods, on)


def lookup(df: DataFrame, table: DataFrame, on: list[str], limit: int = 64 << 20) -> DataFrame:
    """Left outer join with a table of labels: broadcast where its estimated size is within the limit."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.join(F.broadcast(table) if size <= limit else table, on, "left")


@action("parse_es")
def parse_es(df: DataFrame, when: Column | None = None, fields: list[str] = ("index", "create", "update", "delete"), kind: str = "") -> DataFrame:
    """The documents of a bulk stream: those after an index or create header.

    A header is an object field of that name, or, with ``kind``, the value of one string field. A delete has no
    document; the row after an update is dropped. Within a run of rows that look like headers every second one is a document."""
    doc = Document(df)
    name = F.lit("doc")
    for f in reversed(fields):
        there = doc.get(f)
        if kind:
            name = F.when(doc.text(kind) == f, F.lit(f)).otherwise(name)
        elif there is not None:
            name = F.when(there.isNotNull(), F.lit(f)).otherwise(name)
    keys = stream_of(df)
    by = W.partitionBy(*keys).orderBy("_seq")
    rows = df.withColumn("__kind", name).withColumn("__h", F.col("__kind").isin("index", "create", "update"))
    rows = rows.withColumn("__run", F.sum((~F.col("__h")).cast("int")).over(by))
    run = W.partitionBy(*keys, "__run").orderBy("_seq")
    place = F.row_number().over(run) - F.when(F.first("__h").over(run), F.lit(0)).otherwise(F.lit(1))
    rows = rows.withColumn("__hdr", F.col("__h") & (place % 2 == 1))
    rows = rows.withColumns({"__ph": F.lag("__hdr").over(by), "__pk": F.lag("__kind").over(by)})
    return rows.where(F.col("__ph") & F.col("__pk").isin("index", "create")).select(*[f"`{c}`" for c in df.columns])
