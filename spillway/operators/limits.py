"""Filters with state, as window queries over the event order ``_seq``: throttle, cardinality, antispam.

Windows are partitioned by the limiter's key and bucket, so a key's rows of one bucket are
the most that a task sorts at once. What no window can say (shares, the spam counter) is streamed through a
state machine in the same order, from one shuffle and with constant memory (``stepped``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import timefmt
from ..functions.paths import Document
from .predicates import do_if, match_fields, seconds
from .registry import action


def _seq(df: DataFrame) -> str:
    if "_seq" not in df.columns:
        raise ValueError("ordered operators need the envelope column _seq")
    return "_seq"


def _rest(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("__")]


def bucket_of(doc: Document, time_field: str, time_field_format: str, interval: str) -> Column:
    kind = doc.kind(time_field)
    col = doc.get(time_field)
    if col is None:
        ts = F.current_timestamp()
    elif kind.typeName().startswith("timestamp"):
        ts = col.cast("timestamp")
    else:
        ts = F.coalesce(timefmt.parse(col.cast("string"), time_field_format), F.current_timestamp())
    return F.floor(F.unix_micros(ts) / F.lit(int(seconds(interval) * 1_000_000))).cast("bigint")


@action("throttle")
def throttle(
    df: DataFrame, when: Column | None = None, throttle_field: str = "", time_field: str = "time", time_field_format: str = "rfc3339nano", default_limit: int = 5000, limit_kind: str = "count",
    bucket_interval: str = "1m", buckets_count: int = 60, rules: list[dict] | None = None, limit_distribution: dict | None = None, limits: DataFrame | None = None, limiter_expiration: str = "30m",
    limiter_backend: str = "memory", redis_backend_config: dict | None = None,
) -> DataFrame:
    """Rows of a key in a bucket of time pass while the sum of what came before and themselves is within the limit.

    The first rule whose conditions hold gives limit and kind, else the defaults; a negative limit passes all. Rows
    over the limit use it up as well. ``limits`` (key, limit) overrides limits by key, as a shared
    limits store would. Buckets are those of event time; rows outside any window of live buckets can't occur in batch."""
    doc = Document(df)
    key = doc.text(throttle_field) if throttle_field else F.lit("default")
    rule, limit, kind = F.lit(len(rules or [])), F.lit(default_limit).cast("bigint"), F.lit(limit_kind)
    dists: list[dict | None] = []
    for i, r in reversed(list(enumerate(rules or []))):
        ok = do_if(doc, r["do_if"]) if r.get("do_if") else match_fields(doc, r.get("conditions") or {}, "and")
        rule, limit, kind = F.when(ok, F.lit(i)).otherwise(rule), F.when(ok, F.lit(int(r["limit"]))).otherwise(limit), F.when(ok, F.lit(r.get("limit_kind", "count"))).otherwise(kind)
        dists.insert(0, r.get("limit_distribution"))
    dists.append(limit_distribution)
    weight = F.when(kind == "size", F.col("_size").cast("bigint") if "_size" in df.columns else F.lit(1)).otherwise(F.lit(1))
    rows = df.withColumns({"__when": F.lit(True) if when is None else when, "__key": key, "__rule": rule, "__limit": limit, "__w": weight, "__bucket": bucket_of(doc, time_field, time_field_format, bucket_interval)})
    if limits is not None:
        rows = rows.join(limits.select(F.col("key").alias("__key"), F.col("limit").alias("__own")), "__key", "left").withColumn("__limit", F.coalesce("__own", "__limit"))
    on = F.when(F.col("__when"), F.col("__w")).otherwise(F.lit(0))
    if any(d and d.get("ratios") for d in dists):
        values = F.lit("")
        for i, d in enumerate(dists):
            if d and d.get("field"):
                values = F.when(F.col("__rule") == i, doc.text(d["field"])).otherwise(values)
        return _distributed(rows.withColumns({"__value": values, "__w": on}), dists, _rest(df))
    before = F.sum(on).over(W.partitionBy("__rule", "__key", "__bucket").orderBy(_seq(df)).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("__sum", before).where(~F.col("__when") | (F.col("__limit") < 0) | (F.col("__sum") <= F.col("__limit"))).select(*[f"`{c}`" for c in _rest(df)])


def distribution(spec: dict | None, limit: int) -> tuple[dict[str, int], list[int], int]:
    """Shares by value, the limits of the shares, and the limit of all other values."""
    ratios = (spec or {}).get("ratios") or []
    if sum(r["ratio"] for r in ratios) > 1 + 1e-9:
        raise ValueError("sum of ratios must be at most 1")
    half_up = lambda x: int(x + 0.5) if x >= 0 else -int(-x + 0.5)
    index = {v: i for i, r in enumerate(ratios) for v in r["values"]}
    rest = half_up((1 - sum(r["ratio"] for r in ratios)) * 100) / 100
    return index, [half_up(r["ratio"] * limit) for r in ratios], half_up(rest * limit)


class Shares:
    """One bucket's counters: rows pass under shares; other values take from the emptiest share when theirs is full."""

    def __init__(self, limit: int, spec: dict | None):
        self.limit = limit
        self.index, self.shares, self.other = distribution(spec, limit)
        self.used, self.own = [0] * len(self.shares), 0

    def __call__(self, value: str, weight: int) -> bool:
        if self.limit < 0:
            return True
        if not self.shares:
            self.own += weight
            return self.own <= self.limit
        i = self.index.get(value, -1)
        if i < 0:
            if self.own + weight <= self.other:
                self.own += weight
                return True
            room = [s - (u + weight) for s, u in zip(self.shares, self.used)]
            i = max(range(len(room)), key=lambda k: (room[k], -k))
            if room[i] <= -1:
                self.own += weight
                return False
        self.used[i] += weight
        return self.used[i] <= self.shares[i]


def distribute(values: list[str], weights: list[int], limit: int, spec: dict | None) -> list[bool]:
    """Which of a bucket's rows, in order, pass."""
    step = Shares(limit, spec)
    return [step(v, w) for v, w in zip(values, weights)]


def stepped(rows: DataFrame, keys: list[str], inputs: list[str], kept: list[str], make) -> DataFrame:
    """The rows that the state machine of their group passes, given them one after another by _seq.

    ``make`` gets the inputs of a group's first row and returns the machine. One shuffle brings groups together; a group is streamed
    in batches and only its state is held, so a hot group needs time, not memory."""
    columns = [F.col(f"`{c}`") for c in kept]
    shape = rows.select(*columns)
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "_seq").select(*columns, *[F.col(c).alias(f"__{i}") for i, c in enumerate([*keys, *inputs])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for b in batches:
            ok, n = [], len(kept)
            own = [b.column(n + i).to_pylist() for i in range(len(keys) + len(inputs))]
            for row in zip(*own):
                key, args = row[: len(keys)], row[len(keys) :]
                if step is None or key != last:
                    last, step = key, make(*args)
                ok.append(bool(step(*args)))
            yield b.select(list(range(n))).filter(pa.array(ok, pa.bool_()))

    return ordered.mapInArrow(run, shape.schema)


def _distributed(rows: DataFrame, dists: list[dict | None], kept: list[str]) -> DataFrame:
    """Rows to which a limit with shares applies pass by the counters of their bucket."""

    class Bucket:
        def __init__(self, when, rule, limit, value, weight):
            self.shares = {}

        def __call__(self, when, rule, limit, value, weight):
            if not when:
                return True
            if not self.shares:
                self.shares[0] = Shares(int(limit), dists[int(rule)])
            return self.shares[0](value, int(weight))

    return stepped(rows, ["__rule", "__key", "__bucket"], ["__when", "__rule", "__limit", "__value", "__w"], kept, Bucket)


@action("cardinality")
def cardinality(df: DataFrame, when: Column | None = None, key: list[str] = (), fields: list[str] = (), action: str = "nothing", limit: int = 10000, ttl: str = "1h", metric_prefix: str = "") -> DataFrame:
    """Once a key has shown ``limit`` different tuples of the fields, each further row of it is acted upon."""
    if action not in ("discard", "remove_fields", "nothing"):
        raise ValueError(f"unknown action {action!r}")
    if action == "nothing" or limit < 0:
        return df
    doc = Document(df)
    seq = _seq(df)
    rows = df.withColumns({"__when": F.lit(True) if when is None else when, "__k": F.array(*[doc.text(p) for p in key]), "__v": F.array(*[doc.text(p) for p in fields])})
    first = (F.row_number().over(W.partitionBy("__k", "__v", "__when").orderBy(seq)) == 1) & F.col("__when")
    rows = rows.withColumn("__new", first.cast("int"))
    before = F.coalesce(F.sum("__new").over(W.partitionBy("__k").orderBy(seq).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__over", F.col("__when") & (before >= limit))
    if action == "discard":
        return rows.where(~F.col("__over")).select(*[f"`{c}`" for c in df.columns])
    doc = Document(rows)
    for p in fields:
        doc.drop(p)
    return doc.frame(F.col("__over")).select(*[f"`{c}`" for c in df.columns])


def cardinality_metric(df: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """The number of different tuples of the fields for each key: the operator's gauge."""
    doc = Document(df)
    return df.select(*[doc.text(p).alias(p) for p in key], F.array(*[doc.text(p) for p in fields]).alias("__v")).groupBy(*key).agg(F.countDistinct("__v").alias("uniques"))


class Antispam:
    """The counter of one source: banned at the threshold, relieved by maintenance at every interval."""

    def __init__(self, threshold: int, interval: float, unban: int = 4):
        self.threshold, self.interval, self.unban = threshold, interval, unban
        self.counter, self.last, self.tick = 0, None, None

    def maintain(self) -> None:
        self.counter = min(max(self.counter - self.threshold, 0), self.unban * self.threshold)

    def spam(self, now: float, new_source: bool = False) -> bool:
        if self.tick is None:
            self.tick = now
        while now - self.tick >= self.interval:
            self.tick += self.interval
            self.maintain()
            if not self.counter:
                self.tick += (now - self.tick) // self.interval * self.interval
        last, self.last = (now if self.last is None else self.last), now
        if new_source:
            self.counter = 0
            return False
        if now - last < self.interval:
            self.counter += 1
        x = self.counter
        if x == self.threshold:
            self.counter = self.unban * self.threshold
        return x >= self.threshold


def antispam_threshold(df: DataFrame, threshold: int, rules: list[dict] | None, exceptions: list[dict] | None, event: str) -> Column:
    """Each row's threshold: -1 passes, 0 blocks. Rules are tried in order on event, source_name and meta.x."""
    from .predicates import rule_set

    value = F.lit(threshold)
    if rules is None:
        for e in exceptions or []:
            data = F.col("_source_name") if e.get("check_source_name") else F.col(event)
            value = F.when(rule_set(data, e), F.lit(-1)).otherwise(value)
        return value
    names = {"event": F.col(event), "source_name": F.col("_source_name") if "_source_name" in df.columns else F.lit("")}
    if "_meta" in df.columns:
        names["meta"] = F.col("_meta")
    view = Document(df.select(*[c.alias(n) for n, c in names.items()]))
    for r in reversed(rules):
        value = F.when(_bound(do_if(view, r["do_if"]), names), F.lit(int(r["threshold"]))).otherwise(value)
    return value


def _bound(cond: Column, names: dict) -> Column:
    return cond


@action("antispam")
def antispam(df: DataFrame, when: Column | None = None, threshold: int = -1, interval: str = "5s", rules: list[dict] | None = None, exceptions: list[dict] | None = None, event: str = "value", source: str = "_source_id", time: str = "_time") -> DataFrame:
    """Drops the rows of sources that send ``threshold`` rows or more within an interval, until they calm down.

    Counting needs a source's rows in order, one after another; rows without a source are one source, rows without a time pass."""
    if threshold < 0 and rules is None:
        return df
    every = seconds(interval)
    base = df
    if rules is not None:
        base = df.withColumns({"event": F.col(event), "source_name": F.col("_source_name") if "_source_name" in df.columns else F.lit("")})
        if "_meta" in df.columns:
            base = base.withColumn("meta", F.col("_meta"))
    rows = base.withColumn("__limit", antispam_threshold(base, threshold, rules, exceptions, event))
    rows = rows.where(F.col("__limit") != 0).withColumn("__t", F.unix_micros(F.col(time).cast("timestamp")) / 1e6)

    class Source:
        def __init__(self, limit, t):
            self.state = Antispam(int(limit), every)

        def __call__(self, limit, t):
            if limit < 0 or t is None:
                return True
            self.state.threshold = int(limit)
            return not self.state.spam(float(t))

    return stepped(rows.withColumn("__s", F.col(source)), ["__s"], ["__limit", "__t"], df.columns, Source)
