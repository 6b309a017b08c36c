"""A pipeline: one source, ordered operators and one sink, compiled into one DataFrame plan."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks, sources
from ..functions.paths import Document
from ..operators import ACTIONS
from ..operators.decode import decoded
from ..operators.predicates import do_if, match_fields
from .config import COMMON, load, size

FREE = {"modify": "fields", "rename": "fields"}  # operators whose settings are a map of fields


def condition(df: DataFrame, spec: dict) -> Column | None:
    """An operator's predicate: do_if replaces match_fields and what goes with it."""
    doc = Document(df)
    if spec.get("do_if"):
        return do_if(doc, spec["do_if"])
    if spec.get("match_fields") or spec.get("match_invert"):
        return match_fields(doc, spec.get("match_fields") or {}, spec.get("match_mode", "and"), bool(spec.get("match_invert")))
    return None


def apply(df: DataFrame, spec: dict) -> DataFrame:
    """One operator with its settings."""
    kind = spec.get("type")
    if kind not in ACTIONS:
        raise ValueError(f"unknown operator {kind!r}")
    own = {k: v for k, v in spec.items() if k not in COMMON}
    f = ACTIONS[kind]
    if kind in FREE and set(own) - {"fields", "override", "skip_empty"}:
        extra = {k: own.pop(k) for k in ("override",) if k in own}
        own = {"fields": own, **extra}
    if unknown := set(own) - f.settings:
        raise ValueError(f"{kind}: unknown settings {sorted(unknown)}")
    return f(df, condition(df, spec), **own)


def metrics(df: DataFrame, spec: dict) -> DataFrame:
    """Rows and bytes by labels of the rows an operator matches; an absent label is not_set."""
    doc = Document(df)
    when = condition(df, spec)
    labels = [F.coalesce(F.when(doc.text(p) != "", doc.text(p)), F.lit("not_set")).alias(p) for p in spec.get("metric_labels") or []]
    rows = df if when is None else df.where(when)
    bytes_ = F.col("_size") if "_size" in df.columns else F.lit(0)
    return rows.groupBy(*labels).agg(F.count("*").alias("events_count_total"), F.sum(bytes_).alias("events_size_total"))


def ingest(df: DataFrame, settings: dict | None = None, value: str = "value") -> DataFrame:
    """Raw lines before decoding: empty ones go, too long ones go or are cut, spam goes; ``_size`` is set."""
    s = settings or {}
    col = F.col(value)
    df = df.where(col.isNotNull() & (F.octet_length(col) > 0) & (col != "\n"))
    if "_size" not in df.columns:
        df = df.withColumn("_size", F.octet_length(col))
    limit = size(s.get("max_event_size", 0))
    if limit:
        big = F.octet_length(col) > limit
        if s.get("cut_off_event_by_limit"):
            short = F.substring(F.encode(col, "utf-8"), 1, limit).cast("string")
            df = df.withColumns({value: F.when(big, F.concat(short, F.when(F.endswith(col, F.lit("\n")), F.lit("\n")).otherwise(F.lit("")))).otherwise(col), "_cut": big})
        else:
            df = df.where(~big)
    if "antispam" in s:
        df = ACTIONS["antispam"](df, None, event=value, **s["antispam"])
    return df


def with_meta(df: DataFrame, meta: dict[str, str]) -> DataFrame:
    """Metadata templates ``{{ .name }}`` and ``{{ .name | default "x" }}`` as fields, in order of what they need."""
    import re

    left, done = dict(meta), set()
    while left:
        ready = [k for k, v in left.items() if not (set(re.findall(r"\.([a-zA-Z_]\w*)", v)) & set(left) - {k})]
        if not ready:
            raise ValueError(f"metadata templates need each other: {sorted(left)}")
        for k in ready:
            parts, at, template = [], 0, left[k]
            for m in re.finditer(r"\{\{\s*\.?(?:default\s+\"([^\"]*)\"\s+)?\.?([\w.]+)(?:\s*\|\s*default\s+\"([^\"]*)\")?\s*\}\}", template):
                name, default = m[2], m[1] if m[1] is not None else m[3]
                col = F.col(name) if name in df.columns else F.col(f"_{name}") if f"_{name}" in df.columns else F.lit(None)
                parts += [F.lit(template[at : m.start()]), F.coalesce(F.when(col.cast("string") != "", col.cast("string")), F.lit(default if default is not None else ""))]
                at = m.end()
            df = df.withColumn(k, F.concat(*parts, F.lit(template[at:])))
            done.add(k)
            del left[k]
    return df


@dataclass
class Pipeline:
    input: dict = field(default_factory=dict)
    actions: list[dict] = field(default_factory=list)
    output: dict = field(default_factory=dict)
    settings: dict = field(default_factory=dict)

    @classmethod
    def from_config(cls, config: dict | str, name: str | None = None) -> "Pipeline":
        found = load(config)
        found = found["pipelines"][name or next(iter(found["pipelines"]))] if "pipelines" in found else found
        if unknown := set(found) - {"input", "actions", "output", "settings"}:
            raise ValueError(f"unknown keys {sorted(unknown)}")
        return cls(found.get("input") or {}, found.get("actions") or [], found.get("output") or {}, found.get("settings") or {})

    def source(self, spark: SparkSession, streaming: bool = False) -> DataFrame:
        raw = sources.read(spark, self.input, streaming)
        name, params = self.settings.get("decoder", "auto"), self.settings.get("decoder_params")
        if name == "auto":
            name, suggested = sources.suggested(self.input)
            params = {**suggested, **(params or {})}
        df = ingest(raw, self.settings)
        df = decoded(df, name, "value", params, bool(self.settings.get("is_strict")))
        if self.settings.get("cut_off_event_by_limit_field") and "_cut" in df.columns:
            df = df.withColumn(self.settings["cut_off_event_by_limit_field"], F.when(F.col("_cut"), F.lit(True))).drop("_cut")
        return with_meta(df, {**sources.built_in_meta(self.input), **(self.input.get("meta") or {})})

    def transform(self, df: DataFrame) -> DataFrame:
        """The source's own operators, then the pipeline's."""
        for spec in [*sources.additional(df.sparkSession, self.input, self.settings), *self.actions]:
            df = apply(df, spec)
        return df

    def run(self, spark: SparkSession) -> None:
        sinks.write(self.transform(self.source(spark)), self.output)

    def stream(self, spark: SparkSession, checkpoint: str, trigger: dict | None = None):
        """The pipeline as a streaming query; ordered and limiting operators use keyed state.

        Their timers are in processing time, so a query with any of them runs until it is stopped."""
        from ..streaming import STATEFUL, apply_streaming

        df = self.source(spark, streaming=True)
        specs = [*sources.additional(spark, self.input, self.settings), *self.actions]
        for spec in specs:
            df = apply_streaming(df, spec)
        writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sinks.batch_writer(self.output))
        timed = any(a.get("type") in STATEFUL for a in specs)
        return writer.trigger(**(trigger or ({"processingTime": "1 second"} if timed else {"availableNow": True}))).start()


def play(spark: SparkSession, actions: list[dict], events: list[dict | str], schema: str | None = None) -> list[dict]:
    """Runs operators over a few events and returns what comes out, in order: for trying things and for tests."""
    texts = [e if isinstance(e, str) else json.dumps(e) for e in events]
    kind = schema or spark.range(1).select(F.schema_of_json(F.lit(json.dumps(_shape([json.loads(t) for t in texts]))))).first()[0]
    seq = spark.createDataFrame([(0, i, t, len(t.encode())) for i, t in enumerate(texts)], "_source_id bigint, _seq bigint, value string, _size int")
    docs = seq.select("_source_id", "_seq", "_size", F.from_json("value", kind).alias("d")).select("_source_id", "_seq", "_size", "d.*")
    for spec in actions:
        docs = apply(docs, spec)
    order = [c for c in ("_seq", "_child") if c in docs.columns]
    out = docs.orderBy(*order).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith("_")])).alias("j") if [c for c in docs.columns if not c.startswith("_")] else F.lit("{}").alias("j"))
    return [json.loads(r[0]) for r in out.collect()]


def _shape(docs: list):
    """One document that has every field of all."""
    if all(isinstance(d, dict) for d in docs):
        keys = dict.fromkeys(k for d in docs for k in d)
        return {k: _shape([d[k] for d in docs if k in d and d[k] is not None] or [""]) for k in keys}
    if all(isinstance(d, list) for d in docs):
        items = [x for d in docs for x in d if x is not None]
        return [_shape(items)] if items else [""]
    if all(isinstance(d, bool) for d in docs):
        return True
    if all(isinstance(d, (int, float)) and not isinstance(d, bool) for d in docs):
        return docs[0] if all(isinstance(d, int) for d in docs) else 0.5
    return ""

