"""Operators over streams: stateless ones as they are, ordered and limiting ones by keyed state.

State machines are plain classes over a key's events in order (``Joiner``, ``Limiter``,
``Gluer``, ``Cardinality`` and the batch module's ``Antispam``), run by ``transformWithStateInPandas``.
Their timers are in processing time: a joined event that nothing follows is emitted after event_timeout.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import regex
from ..functions.paths import Document
from ..operators.limits import Antispam, Shares, antispam_threshold, bucket_of
from ..operators.ordered import AHEAD, TEMPLATES, labelled
from ..operators.predicates import seconds

STATE = "value string"
STATEFUL = ("join", "join_template", "k8s_multiline", "throttle", "cardinality", "antispam")


class Joiner:
    """Holds a start and appends what continues it; anything else lets it go."""

    def __init__(self, kinds: list[tuple[str, str, bool]], limit: int = 0):
        """``kinds`` are (start, continue, negate); the first whose start matches counts until the event is let go."""
        self.kinds, self.limit = [(regex.python(s), regex.python(c), n) for s, c, n in kinds], limit
        self.held: str | None = None
        self.text, self.kind = "", 0

    def push(self, text: str | None, row: str, passes: bool = True) -> list[tuple[str, str | None]]:
        """(row, text) that are let go by this row."""
        out: list[tuple[str, str | None]] = []
        busy = self.held is not None
        if text is None:
            out += self.flush()
            return [*out, (row, None)]
        if busy or passes:
            kind = next((i for i, (start, _, _) in enumerate(self.kinds) if start.search(text)), None)
            if kind is not None:
                out += self.flush()
                self.held, self.text, self.kind = row, text, kind
                return out
        if busy and bool(self.kinds[self.kind][1].search(text)) != self.kinds[self.kind][2]:
            if not self.limit or len(self.text.encode()) < self.limit:
                self.text += text
            return out
        out += self.flush()
        return [*out, (row, text)]

    def flush(self) -> list[tuple[str, str | None]]:
        if self.held is None:
            return []
        out = [(self.held, self.text)]
        self.held, self.text = None, ""
        return out


class Gluer:
    """Glues the fragments of a line as ``k8s_multiline`` does; what is held is plain values, kept as they are."""

    START = {"held": "", "bytes": 0, "skip": False, "cut": False, "row": None}

    def __init__(self, limit: int = 0, split: int = 1_000_000, cuts: bool = False, kept: dict | None = None):
        self.limit, self.split, self.cuts = limit, split, cuts
        self.now = {**self.START, **(kept or {})}

    def push(self, text: str | None, row: str, size: int) -> list[tuple[str, str, bool]]:
        """(row, text, cut) that are whole with this fragment."""
        now, t = self.now, text or ""
        full = text is None or t.endswith(("\n", "\\n"))
        now["bytes"] += size
        if not full and now["bytes"] + AHEAD <= self.split:
            over = _escaped(now["held"]) + _escaped(t) + 3 - self.limit
            if not self.limit or over < 0:
                now["held"] += t
            elif not now["skip"]:
                now["skip"] = True
                if self.cuts:
                    raw = t.encode()
                    now["held"], now["cut"] = now["held"] + raw[: max(len(raw) - over, 0)].decode("utf-8", "replace"), True
            now["row"] = row
            return []
        if now["skip"] and not full:
            now["row"] = row
            return []
        held, cut, gone = now["held"], now["cut"], now["skip"] and not now["cut"]
        self.now = dict(self.START)
        if gone:
            return []
        if not held:
            return [(row, t, False)]
        return [(row, held + (("\n" if full else "") if cut else t), cut)]

    def flush(self) -> list[tuple[str, str, bool]]:
        """What is held of a line that doesn't go on."""
        now, self.now = self.now, dict(self.START)
        return [(now["row"], now["held"], now["cut"])] if now["row"] is not None and (now["cut"] or not now["skip"]) else []


def _escaped(text: str) -> int:
    return len(json.dumps(text, ensure_ascii=False).encode()) - 2


class Limiter:
    """Sums of the newest buckets of a key; a time outside them counts for the newest."""

    def __init__(self, limit: int, buckets: int = 60):
        self.limit, self.buckets, self.sums = limit, buckets, {}

    def allow(self, bucket: int, weight: int) -> bool:
        newest = max(self.sums, default=bucket)
        if bucket > newest:
            newest = bucket
        elif bucket <= newest - self.buckets:
            bucket = newest
        self.sums = {b: s for b, s in self.sums.items() if b > newest - self.buckets}
        self.sums[bucket] = self.sums.get(bucket, 0) + weight
        return self.limit < 0 or self.sums[bucket] <= self.limit


class Cardinality:
    """Values seen by a key, with the times at which they expire."""

    def __init__(self, limit: int, ttl: float):
        self.limit, self.ttl, self.seen = limit, ttl, {}

    def over(self, value: str, now: float) -> bool:
        while self.seen and (oldest := next(iter(self.seen))) is not None and self.seen[oldest] <= now:
            del self.seen[oldest]
        if len(self.seen) >= self.limit:
            return True
        self.seen.pop(value, None)  # a value that is seen again expires last
        self.seen[value] = now + self.ttl
        return False


class _Keyed(StatefulProcessor):
    """Rows of a key in the order of _seq through a machine whose fields are kept as JSON."""

    def __init__(self, spec: dict):
        self.spec = spec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def load(self) -> dict:
        got = self.state.get()
        return json.loads(got[0]) if got else {}

    def save(self, value: dict) -> None:
        self.state.update((json.dumps(value),))

    def close(self) -> None:
        pass


class JoinProcessor(_Keyed):
    def machine(self, kept: dict) -> Joiner:
        s = self.spec
        j = Joiner([tuple(k) for k in s["kinds"]], s.get("max_event_size", 0))
        j.held, j.text, j.kind = kept.get("held"), kept.get("text", ""), kept.get("kind", 0)
        return j

    def rows(self, out: list[tuple[str, str | None]], key) -> pd.DataFrame:
        return pd.DataFrame([(*key, r, t) for r, t in out], columns=[*self.spec["keys"], "row", "txt"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        j, out = self.machine(self.load()), []
        for pdf in rows:
            for t, r, m in pdf.sort_values("seq")[["txt", "row", "m"]].itertuples(index=False):
                out += j.push(t, r, bool(m))
        self.save({"held": j.held, "text": j.text, "kind": j.kind})
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if j.held is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.spec.get("timeout", 30.0) * 1000))
        yield self.rows(out, key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        j = self.machine(self.load())
        out = j.flush()
        self.save({"held": None, "text": ""})
        yield self.rows(out, key)


class GlueProcessor(_Keyed):
    def machine(self) -> Gluer:
        s = self.spec
        return Gluer(s["limit"], s["split"], s["cuts"], self.load())

    def rows(self, out: list[tuple[str, str, bool]], key) -> pd.DataFrame:
        return pd.DataFrame([(*key, *x) for x in out], columns=[*self.spec["keys"], "row", "txt", "cut"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        m, out = self.machine(), []
        for pdf in rows:
            for t, r, n in pdf.sort_values("seq")[["txt", "row", "size"]].itertuples(index=False):
                out += m.push(t, r, int(n))
        self.save(m.now)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if m.now["row"] is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.spec["timeout"] * 1000))
        yield self.rows(out, key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        m = self.machine()
        out = m.flush()
        self.save(m.now)
        yield self.rows(out, key)


class FilterProcessor(_Keyed):
    """Rows and whether a machine lets them pass: throttle, cardinality or antispam. The machine is loaded and saved once for a batch of a key."""

    def machine(self, kept: dict):
        """(what decides on a row, what is to be kept afterwards)."""
        s = self.spec
        if s["kind"] == "throttle":
            m, shares = Limiter(-1, s["buckets"]), kept.get("shares", {})
            m.sums = {int(k): v for k, v in kept.get("sums", {}).items()}

            def throttled(r, now) -> bool:
                m.limit = int(r.lim)
                spec = s["shares"][int(r.c)] if s["shares"] else None
                if not spec or m.limit < 0:
                    return m.allow(int(r.a), int(r.b))
                newest = max(map(int, shares), default=int(r.a))
                bucket = int(r.a) if int(r.a) > newest - s["buckets"] else newest
                step = Shares(m.limit, spec)
                step.used, step.own = (list(x) if isinstance(x, list) else x for x in shares.get(str(bucket), (step.used, 0)))
                ok = step(str(r.txt or ""), int(r.b))
                shares[str(bucket)] = [step.used, step.own]
                for old in [k for k in shares if int(k) <= max(newest, bucket) - s["buckets"]]:
                    del shares[old]
                return ok

            return throttled, lambda: {"sums": {str(k): v for k, v in m.sums.items()}, "shares": shares}
        if s["kind"] == "cardinality":
            m = Cardinality(0, s["ttl"])
            m.seen = kept

            def counted(r, now) -> bool:
                m.limit = int(r.lim)
                return not m.over(str(r.txt), now)

            return counted, lambda: m.seen
        m = Antispam(1, s["interval"])
        m.counter, m.last, m.tick = kept.get("counter", 0), kept.get("last"), kept.get("tick")

        def calm(r, now) -> bool:
            m.threshold = int(r.lim)
            return not m.spam(r.a / 1e6)

        return calm, lambda: {"counter": m.counter, "last": m.last, "tick": m.tick}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        decide, kept = self.machine(self.load())
        now = timerValues.getCurrentProcessingTimeInMs() / 1000
        for pdf in rows:
            pdf = pdf.sort_values("seq")
            ok = [decide(r, now) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame([(*key, x, o) for x, o in zip(pdf["row"], ok)], columns=[*self.spec["keys"], "row", "ok"])
        self.save(kept())


def _packed(df: DataFrame):
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def _unpacked(rows: DataFrame, df: DataFrame) -> DataFrame:
    return rows.select(F.from_json("row", df.schema).alias("d")).select("d.*")


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("_source_id", "_stream") if c in df.columns]


def _decided(df: DataFrame, spec: dict, key, lim, a, b, c, txt, on) -> DataFrame:
    """Rows with __ok: where ``on`` holds the machine decides, the others pass."""
    rows = df.select(key.alias("k"), F.col("_seq").alias("seq"), _packed(df).alias("row"), lim.cast("bigint").alias("lim"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), c.cast("bigint").alias("c"), txt.cast("string").alias("txt"), F.coalesce(on, F.lit(False)).alias("on"))
    out = rows.where("on").groupBy("k").transformWithStateInPandas(FilterProcessor({**spec, "keys": ["k"]}), "k string, row string, ok boolean", "append", "ProcessingTime")
    out = out.select("row", "ok").unionByName(rows.where("not on").select("row", F.lit(True).alias("ok")))
    return out.select(F.from_json("row", df.schema).alias("d"), F.col("ok").alias("__ok")).select("d.*", "__ok")


def _filtered(df: DataFrame, spec: dict, key, lim, a, b, c, txt, on) -> DataFrame:
    return _decided(df, spec, key, lim, a, b, c, txt, on).where("__ok").drop("__ok")


def apply_streaming(df: DataFrame, spec: dict) -> DataFrame:
    """An operator over a stream."""
    from ..plans.pipeline import apply, condition

    kind = spec["type"]
    if not df.isStreaming or kind not in STATEFUL:
        return apply(df, spec)
    doc, when = Document(df), condition(df, spec)
    when = F.lit(True) if when is None else when
    if kind in ("join", "join_template"):
        if kind == "join_template":
            names = spec.get("templates") or [spec["template"]]
            kinds = [TEMPLATES[n if isinstance(n, str) else n["name"]] for n in names]
        else:
            kinds = [(spec["start"].strip("/"), spec["continue"].strip("/"), bool(spec.get("negate")))]
        field = spec.get("field", "log")
        keys = _keys(df) or ["__one"]
        base = df if _keys(df) else df.withColumn("__one", F.lit("1"))
        rows = base.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col("_seq").alias("seq"), _packed(df).alias("row"), doc.get(field).cast("string").alias("txt"), when.alias("m"))
        own = {"kinds": kinds, "max_event_size": int(spec.get("max_event_size", 0)), "timeout": seconds(spec.get("event_timeout", "30s")), "keys": keys}
        out = rows.groupBy(*keys).transformWithStateInPandas(JoinProcessor(own), ", ".join(f"{k} string" for k in keys) + ", row string, txt string", "append", "ProcessingTime")
        back = Document(out.select(F.from_json("row", df.schema).alias("d"), F.col("txt").alias("__txt")).select("d.*", "__txt"))
        back.set(field, F.col("__txt"))
        return back.frame().drop("__txt")
    if kind == "k8s_multiline" and not spec.get("only_node"):
        field, keys, limit, mark = spec.get("field", "log"), _keys(df), int(spec.get("max_event_size", 0)), spec.get("cut_off_field", "")
        text = doc.get(field)
        rows = df.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col("_seq").alias("seq"), _packed(df).alias("row"), text.alias("txt"), (F.col("_size") if "_size" in df.columns else F.coalesce(F.octet_length(text), F.lit(0))).cast("bigint").alias("size"))
        own = {"limit": limit, "split": int(spec.get("split_event_size", 1_000_000)), "cuts": bool(spec.get("cut_off_event_by_limit") or mark), "timeout": seconds(spec.get("event_timeout", "30s")), "keys": keys}
        out = rows.groupBy(*keys).transformWithStateInPandas(GlueProcessor(own), ", ".join(f"{k} string" for k in keys) + ", row string, txt string, cut boolean", "append", "ProcessingTime")
        back = out.select(F.from_json("row", df.schema).alias("d"), F.col("txt").alias("_all_"), F.col("cut").alias("_short_")).select("d.*", "_all_", "_short_")
        return labelled(back, field, mark if limit > 0 else "", spec.get("node", ""), spec.get("pods"), spec.get("allowed_pod_labels"))
    if kind == "k8s_multiline":
        return apply(df, spec)
    zero, none = F.lit(0), F.lit(None)
    if kind == "throttle":
        key, lim, size = F.lit("default") if not spec.get("throttle_field") else doc.text(spec["throttle_field"]), F.lit(int(spec.get("default_limit", 5000))), F.lit(spec.get("limit_kind", "count"))
        given = spec.get("rules") or []
        dists = [r.get("limit_distribution") for r in given] + [spec.get("limit_distribution")]
        rule, value = F.lit(len(given)), F.lit("") if not (dists[-1] or {}).get("field") else doc.text(dists[-1]["field"])
        from ..operators.predicates import do_if, match_fields

        for i, r in reversed(list(enumerate(given))):
            ok = do_if(doc, r["do_if"]) if r.get("do_if") else match_fields(doc, r.get("conditions") or {})
            value = F.when(ok, doc.text(dists[i]["field"]) if (dists[i] or {}).get("field") else F.lit("")).otherwise(value)
            rule, lim, size = F.when(ok, F.lit(i)).otherwise(rule), F.when(ok, F.lit(int(r["limit"]))).otherwise(lim), F.when(ok, F.lit(r.get("limit_kind", "count"))).otherwise(size)
        weight = F.when(size == "size", F.col("_size") if "_size" in df.columns else F.lit(1)).otherwise(F.lit(1))
        bucket = bucket_of(doc, spec.get("time_field", "time"), spec.get("time_field_format", "rfc3339nano"), spec.get("bucket_interval", "1m"))
        shares = [d if d and d.get("ratios") else None for d in dists]
        return _filtered(df, {"kind": kind, "buckets": int(spec.get("buckets_count", 60)), "shares": shares if any(shares) else None}, F.concat_ws("|", rule.cast("string"), key), lim, bucket, weight, rule, value, when)
    if kind == "cardinality":
        if spec.get("action", "nothing") == "nothing" or int(spec.get("limit", 10000)) < 0:
            return df
        join = lambda names: F.to_json(F.array(*[doc.text(p) for p in names]))
        out = _decided(df, {"kind": kind, "ttl": seconds(spec.get("ttl", "1h"))}, join(spec["key"]), F.lit(int(spec.get("limit", 10000))), zero, zero, zero, join(spec["fields"]), when)
        if spec["action"] == "discard":
            return out.where("__ok").drop("__ok")
        less = Document(out)
        for p in spec["fields"]:
            less.drop(p)
        return less.frame(~F.col("__ok")).drop("__ok")
    time = F.unix_micros(F.col(spec.get("time", "_time")).cast("timestamp"))
    base, event = df, spec.get("event", "value")
    if spec.get("rules") is not None:
        base = df.withColumns({"event": F.col(event), "source_name": F.col("_source_name") if "_source_name" in df.columns else F.lit("")})
        base = base.withColumn("meta", F.col("_meta")) if "_meta" in df.columns else base
    most = base.withColumn("__most", antispam_threshold(base, int(spec.get("threshold", -1)), spec.get("rules"), spec.get("exceptions"), event)).where("__most <> 0").select(*[F.col(f"`{c}`") for c in df.columns], "__most")
    out = _filtered(most, {"kind": kind, "interval": seconds(spec.get("interval", "5s"))}, F.col(spec.get("source", "_source_id")).cast("string"), F.col("__most"), time, zero, zero, none, when & (F.col("__most") > 0))
    return out.drop("__most")
