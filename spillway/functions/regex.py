"""RE2 patterns for the JVM (``java``) and for Python's regex module (``python``).

Both keep RE2's meaning where the engines differ: ``$`` is the end of the text, not
also a place before a last line end; ``.`` excludes only line feeds; ``\\b``, ``\\w``,
``\\d`` and ``\\s`` are ASCII; named groups are ``(?P<name>...)``.
"""

from __future__ import annotations

import re
from functools import lru_cache

_BOUND = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_UNBOUND = r"(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"
_POSIX = {"alpha": "A-Za-z", "digit": "0-9", "alnum": "0-9A-Za-z", "upper": "A-Z", "lower": "a-z", "space": r"\t\n\x0B\f\r ", "blank": r"\t ", "xdigit": "0-9A-Fa-f", "word": "0-9A-Za-z_", "punct": r"!-/:-@\[-`{-~"}


def _walk(pattern: str, to_java: bool) -> tuple[str, list[str | None]]:
    out, names, i, depth_class, multiline = [], [], 0, False, False
    first = False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            d = pattern[i + 1]
            if d == "Q":
                end = pattern.find(r"\E", i + 2)
                end = len(pattern) if end < 0 else end
                out.append(re.escape(pattern[i + 2 : end]))
                i = end + 2
                continue
            piece = {"b": _BOUND, "B": _UNBOUND, "s": r"[\t\n\f\r ]", "S": r"[^\t\n\f\r ]", "z": r"\z" if to_java else r"\Z", "a": r"\x07", "v": r"\x0B"}.get(d)
            if not to_java and d in "wWdD":  # ASCII, while letters still fold and \\p works
                span = "0-9A-Za-z_" if d in "wW" else "0-9"
                piece = span if depth_class and d in "wd" else None if depth_class else f"[{'^' if d in 'WD' else ''}{span}]"
            elif depth_class:
                piece = {"s": r"\t\n\f\r ", "a": r"\x07", "v": r"\x0B"}.get(d)
            if piece is None and d in "pP" and i + 2 < len(pattern) and pattern[i + 2] != "{":
                piece, i = f"\\{d}{{{pattern[i + 2]}}}", i + 1
            out.append(piece if piece is not None else c + d)
            i, first = i + 2, False
            continue
        if depth_class:
            if c == "[" and pattern.startswith("[:", i) and (end := pattern.find(":]", i)) > 0:
                name = pattern[i + 2 : end]
                out.append(_POSIX[name] if name[0] != "^" else f"\\P{{{name[1:].title()}}}")
                i, first = end + 2, False
                continue
            if c == "]" and not first:
                depth_class = False
                out.append(c)
            elif c in "[]&~|" or (c == "-" and pattern.startswith("--", i)):
                out.append("\\" + c)
            else:
                out.append(c)
            i, first = i + 1, False
            continue
        if c == "[":
            depth_class, first = True, True
            out.append(c)
            i += 1
            if pattern.startswith("^", i):
                out.append("^")
                i += 1
            continue
        if c == "(":
            if m := re.match(r"\(\?P?<([A-Za-z0-9_]+)>", pattern[i:]):
                names.append(m[1])
                out.append("(")
                i += len(m[0])
                continue
            if m := re.match(r"\(\?([a-zA-Z]*)(-[a-zA-Z]+)?([:)])", pattern[i:]):
                if "U" in m[1]:
                    raise ValueError("the flag U isn't supported")
                multiline = multiline or "m" in m[1]
                flags = m[1] + ("u" if to_java and "i" in m[1] else "")
                out.append(f"(?{flags}{m[2] or ''}{m[3]}")
                i += len(m[0])
                continue
            if not pattern.startswith("(?", i):
                names.append(None)
        if c == "$" and not multiline:
            out.append(r"\z" if to_java else r"\Z")
        else:
            out.append(c)
        i += 1
    return "".join(out), names


@lru_cache(maxsize=1024)
def java(pattern: str) -> str:
    return "(?d)" + _walk(pattern, True)[0]


@lru_cache(maxsize=1024)
def group_names(pattern: str) -> tuple[str | None, ...]:
    """The names of the groups, by their numbers from 1."""
    return tuple(_walk(pattern, True)[1])


def python(pattern: str):
    import regex

    text, _ = _walk(pattern, False)
    # flags in mid-pattern apply to the rest of their group in RE2; here they must begin it
    if m := re.match(r"(.+?)\(\?([ims]+)\)(.*)\Z", text, re.S):
        text = f"{m[1]}(?{m[2]}:{m[3]})"
    return regex.compile(text, regex.V0)
