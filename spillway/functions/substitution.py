"""Templates with ``${path|filter(...)|...}`` parts, and their string filters."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import regex


def _call(text: str) -> tuple[str, list]:
    """``name(arg, ...)``: arguments are JSON-like; a quoted text may use ' or "."""
    m = re.fullmatch(r"\s*([a-z_]+)\s*\((.*)\)\s*", text, re.S)
    if not m:
        raise ValueError(f"bad filter {text!r}")
    body = re.sub(r"\b(true|false)\b(?=\s*[,)]|\s*$)", lambda x: x[1].title(), m[2])
    args = []
    depth, cur, quote, i = 0, "", "", 0
    while i <= len(body):
        c = body[i] if i < len(body) else ","
        if quote:
            cur += c
            if c == "\\" and i + 1 < len(body):
                cur += body[i + 1]
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"":
            quote, cur = c, cur + c
        elif c == "," and not depth:
            if cur.strip():
                args.append(cur.strip())
            cur = ""
        else:
            depth += (c in "[(") - (c in "])")
            cur += c
        i += 1

    def value(a: str):
        if a[:1] in "'\"":
            inner = a[1:-1]
            return re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1] if x[1] in "'\"\\" else x[0]), inner)
        try:
            return ast.literal_eval(a)
        except (ValueError, SyntaxError):
            return a

    return m[1], [value(a) for a in args]


def split(text: str, sign: str) -> list[str]:
    """Parts between signs that lie outside quotes and parentheses."""
    out, cur, quote, depth, i = [], "", "", 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            cur += c
            if c == "\\" and i + 1 < len(text):
                cur += text[i + 1]
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"":
            quote, cur = c, cur + c
        elif c == sign and not depth:
            out.append(cur)
            cur = ""
        else:
            depth += (c == "(") - (c == ")")
            cur += c
        i += 1
    return [*out, cur]


def parts(template: str) -> list[tuple[str, str, list]]:
    """("text", text, []) and ("field", path, [(filter, args), ...]) in order."""
    out, cur, i = [], "", 0
    while i < len(template):
        if template.startswith("$$", i):
            cur, i = cur + "$", i + 2
        elif template.startswith("${", i):
            quote, j = "", i + 2
            while j < len(template) and (quote or template[j] != "}"):
                c = template[j]
                if quote:
                    if c == "\\":
                        j += 1
                    elif c == quote:
                        quote = ""
                elif c in "'\"":
                    quote = c
                j += 1
            if j >= len(template):
                raise ValueError(f"unclosed substitution in {template!r}")
            path, *filters = split(template[i + 2 : j], "|")
            if cur:
                out.append(("text", cur, []))
            out.append(("field", path.strip(), [_call(f) for f in filters]))
            cur, i = "", j + 1
        else:
            cur, i = cur + template[i], i + 1
    return [*out, ("text", cur, [])] if cur else out


def re_filter(s: Column, pattern: str, limit: int, groups: list[int], sep: str, empty: bool = False) -> Column:
    """All matches' groups joined by ``sep``; limit 0 counts as no match."""
    missing = F.lit("") if empty else s
    if limit == 0:
        return missing
    java = regex.java(pattern)
    one = [F.regexp_extract_all(s, F.lit(java), F.lit(g)) for g in groups]
    if limit > 0:
        one = [F.slice(x, 1, limit) for x in one]
    found = one[0]
    if len(groups) > 1:
        found = F.flatten(F.transform(F.arrays_zip(*[x.alias(f"g{i}") for i, x in enumerate(one)]), lambda z: F.array(*[z[f"g{i}"] for i in range(len(groups))])))
    if any(groups):  # a group that takes no part gives ""
        found = F.filter(found, lambda x: x != "")
    return F.when(s.rlike(java), F.array_join(found, sep)).otherwise(missing)


def trim(s: Column, mode: str, cutset: str) -> Column:
    t = F.lit(cutset)
    return {"all": F.btrim, "left": F.ltrim, "right": F.rtrim}[mode](s, t)


def trim_to(s: Column, mode: str, cutset: str) -> Column:
    """From the first place of cutset (left), to the last and one byte of it (right), or both (all)."""
    if mode in ("all", "left"):
        at = F.instr(s, F.lit(cutset))
        s = F.when(at > 0, F.substring(s, at, F.length(s))).otherwise(s)
    if mode in ("all", "right"):
        tail = F.length(F.substring_index(s, cutset, -1))
        s = F.when(F.instr(s, F.lit(cutset)) > 0, F.substring(s, F.lit(1), F.length(s) - tail - len(cutset) + 1)).otherwise(s)
    return s


def cut(s: Column, mode: str, n: int) -> Column:
    """The first or last n bytes."""
    data = F.encode(s, "utf-8")
    size = F.octet_length(s)
    part = F.substring(data, F.lit(1), F.lit(n)) if mode == "first" else F.substring(data, F.greatest(size - n, F.lit(0)) + 1, F.lit(n))
    return F.when(size <= n, s).otherwise(part.cast("string"))


FILTERS = {"re": re_filter, "trim": trim, "trim_to": trim_to, "cut": cut}


def render(template: str, get) -> Column:
    """The template as a string column; ``get(path)`` gives a field as text."""
    out = []
    for kind, text, filters in parts(template):
        if kind == "text":
            out.append(F.lit(text))
            continue
        col = get(text)
        for name, args in filters:
            if name not in FILTERS:
                raise ValueError(f"unknown filter {name!r}")
            col = FILTERS[name](col, *args)
        out.append(col)
    return F.concat(*out) if len(out) > 1 else out[0] if out else F.lit("")
