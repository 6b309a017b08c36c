"""Parsing operators beyond the decoders: JSON paths, regular expressions, escapes and hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import regex
from ..functions.arrow import small_batches
from ..functions.normalize import Normalizer
from ..functions.paths import Document, Node, parse
from .registry import editor


@F.pandas_udf(T.ArrayType(T.StringType()))
def _from_broken(text: pd.Series, names: pd.Series) -> pd.Series:
    """Complete values of the paths in JSON text that may end early; null where a path isn't reached."""
    import json

    decoder = json.JSONDecoder()
    space = re.compile(r"[ \t\r\n]*")

    def walk(s: str, wanted: dict) -> dict:
        found: dict = {}
        stack = [wanted]
        i = space.match(s).end()
        if not s.startswith("{", i):
            return found
        i += 1
        while stack:
            i = space.match(s, i).end()
            if i >= len(s):
                return found
            if s[i] == "}":
                stack.pop()
                i += 1
                continue
            if s[i] == ",":
                i += 1
                continue
            try:
                key, i = decoder.raw_decode(s, i)
                i = space.match(s, i).end()
                if s[i : i + 1] != ":":
                    return found
                i = space.match(s, i + 1).end()
                sub = stack[-1].get(key)
                if isinstance(sub, dict) and s.startswith("{", i):
                    stack.append(sub)
                    i += 1
                    continue
                begin = i
                value, i = decoder.raw_decode(s, i)
                if i == len(s) and isinstance(value, (int, float)) and not isinstance(value, bool):
                    return found  # a number at the end may go on
                if isinstance(sub, str):
                    found[sub] = value if isinstance(value, str) else s[begin:i]
            except (ValueError, TypeError):
                return found
        return found

    out = []
    for s, ns in zip(text, names):
        tree: dict = {}
        for n in ns:
            node = tree
            *up, last = parse(n)
            for p in up:
                node = node.setdefault(p, {}) if isinstance(node.get(p, {}), dict) else node
            node[last] = n
        got = walk(s, tree) if isinstance(s, str) else {}
        out.append([got.get(n) for n in ns])
    return pd.Series(out)


def _json_path(path: str) -> str:
    return "$" + "".join(f"['{p}']" for p in parse(path))


@editor("json_extract")
def json_extract(doc: Document, field: str, extract_fields: list[str] | None = None, extract_field: str = "", prefix: str = "", truncated: bool = False) -> None:
    """Values at paths of JSON text, to the root under the paths' last names, as strings.

    Whole documents are read in the JVM. ``truncated`` also takes what is complete in text that ends early
    (an Arrow function)."""
    col = doc.get(field)
    wanted = list(extract_fields or ([extract_field] if extract_field else []))
    if col is None or not wanted:
        return
    if truncated:
        small_batches(doc.df)
        values = _from_broken(col, F.array(*[F.lit(w) for w in wanted]))
        found = {w: values[i] for i, w in enumerate(wanted)}
    else:
        found = {w: F.get_json_object(col, _json_path(w)) for w in wanted}
    for w in wanted:
        name = prefix + parse(w)[-1]
        old = doc.root.children.get(name)
        value = found[w] if old is None else F.coalesce(found[w], old.value().cast("string"))
        doc.put(name, Node(value, T.StringType()))


@editor("parse_re2")
def parse_re2(doc: Document, field: str, re2: str, prefix: str = "") -> None:
    """Named groups of a match become root fields and the field goes; without a match nothing changes."""
    col = doc.get(field)
    if col is None:
        return
    java = regex.java(re2)
    text = col.cast("string")
    ok = F.coalesce(text.rlike(java), F.lit(False))
    doc.set(field, F.when(~ok, text), T.StringType())
    for i, name in enumerate(regex.group_names(re2), 1):
        if name:
            old = doc.root.children.get(prefix + name)
            value = F.when(ok, F.regexp_extract(text, java, i))
            doc.put(prefix + name, Node(value if old is None else value.otherwise(old.value().cast("string")), T.StringType()))


_ESCAPE = re.compile(rb"\\(?:x([0-9a-fA-F]{2})|([0-7]{3})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|(\\))")


def unescape(s: str, replace: bool) -> str:
    """Escaped bytes (\\xhh, octal), code units (\\uhhhh, also pairs) and code points (\\Uhhhhhhhh) decoded."""
    if "\\" in s:
        data = s.encode("utf-8", "surrogatepass")
        out, at, high = [], 0, None
        for m in _ESCAPE.finditer(data):
            if m.start() > at or high is None:
                if high is not None:
                    out.append("\ufffd".encode())
                    high = None
                out.append(data[at : m.start()])
            at = m.end()
            code = int(m[3], 16) if m[3] else None
            if high is not None:
                if code is not None and 0xDC00 <= code < 0xE000:
                    out.append(chr(0x10000 + ((high - 0xD800) << 10) + code - 0xDC00).encode())
                    high = None
                    continue
                out.append("\ufffd".encode())
                high = None
            if m[1]:
                out.append(bytes([int(m[1], 16)]))
            elif m[2]:
                out.append(bytes([int(m[2], 8)]) if int(m[2], 8) < 256 else m[0])
            elif code is not None:
                if 0xD800 <= code < 0xDC00:
                    high = code
                else:
                    out.append(chr(code).encode("utf-8", "replace") if not 0xDC00 <= code < 0xE000 else "\ufffd".encode())
            elif m[4]:
                out.append(chr(int(m[4], 16)).encode("utf-8", "replace") if int(m[4], 16) < 0x110000 else "\ufffd".encode())
            else:
                out.append(b"\\")
        if high is not None:
            out.append("\ufffd".encode())
        out.append(data[at:])
        s = b"".join(out).decode("utf-8", "replace")
    return "".join(c if c.isprintable() or c in "\n\t\r" else "\ufffd" for c in s) if replace else s


@editor("convert_utf8_bytes")
def convert_utf8_bytes(doc: Document, fields: list[str], replace_non_graphic: bool = False) -> None:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unescape(x, replace_non_graphic), na_action="ignore")

    def unescaped(col: Column) -> Column:  # null to Python where there is nothing to do, as Spark calls it on every row
        return run(col) if replace_non_graphic else F.coalesce(run(F.when(F.contains(col, F.lit("\\")), col)), col)

    small_batches(doc.df)

    def strings(node: Node) -> None:
        kids = node.open()
        if kids is not None:
            for k, v in node.own().items():
                strings(v)
        elif isinstance(node.kind, T.StringType):
            node.column = unescaped(node.column)

    for f in fields:
        if node := doc.find(f):
            if node.open() is None and isinstance(doc.kind(f), T.StringType):
                doc.set(f, unescaped(node.value()), T.StringType())
            elif node.open() is not None:
                kept = doc.drop(f)
                strings(kept)
                up = parse(f)
                here = doc.root
                for p in up[:-1]:
                    here = here.own()[p]
                here.own()[up[-1]] = kept


def xxh64(text: Column) -> Column:
    """XXH64 with seed 0 of UTF-8 text, as decimal(20, 0). Runs in the JVM; by Arrow where there is no JVM access."""
    spark = SparkSession.getActiveSession()
    try:
        jvm = spark._jvm
        expr = jvm.org.apache.spark.sql.classic.ExpressionUtils.expression(text._jc)
        seq = jvm.PythonUtils.toSeq([expr])
        signed = Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(seq, 0)))
    except (AttributeError, TypeError):
        signed = _xxh64(text)
    wide = signed.cast("decimal(20,0)")
    return F.when(signed < 0, (wide + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(wide)


@F.pandas_udf(T.LongType())
def _xxh64(s: pd.Series) -> pd.Series:
    import xxhash

    return s.map(lambda x: int.from_bytes(xxhash.xxh64(x.encode(), seed=0).digest(), "big", signed=True), na_action="ignore").astype("Int64")


def normalizer(builtin: str = "all", custom: list[dict] | None = None):
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = Normalizer(builtin, custom)
        for s in batches:
            yield s.map(one, na_action="ignore")

    return run


@editor("hash")
def hash_(doc: Document, fields: list[dict], result_field: str, normalizer: dict | None = None) -> None:
    """XXH64 of the first field that is present and no container; its text may be cut in bytes and normalised."""
    make = globals()["normalizer"]
    value = None
    for f in fields:
        col, kind = doc.get(f["field"]), doc.kind(f["field"])
        if col is None or isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            continue
        text = col.cast("string")
        if size := f.get("max_size", 0):
            text = F.when(F.octet_length(text) > size, F.substring(F.encode(text, "utf-8"), 1, size).cast("string")).otherwise(text)
        if f.get("format", "no") == "normalize":
            small_batches(doc.df)
            text = make((normalizer or {}).get("builtin_patterns", "all"), (normalizer or {}).get("custom_patterns"))(text)
        value = xxh64(text) if value is None else F.coalesce(value, xxh64(text))
    if value is not None:
        doc.set(result_field, value, T.DecimalType(20, 0))
