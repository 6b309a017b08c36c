"""YAML or dict configuration: values, units, expressions, overrides; unknown keys are errors."""

from __future__ import annotations

import ast
import json
import operator
import os
import re
from pathlib import Path
from typing import Any

from ..operators.predicates import seconds  # noqa: F401  (durations are read here as well)

UNITS = {"b": 1, "kb": 1000, "mb": 1000**2, "gb": 1000**3, "tb": 1000**4, "kib": 1024, "mib": 1024**2, "gib": 1024**3, "tib": 1024**4}
_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.floordiv, ast.FloorDiv: operator.floordiv}
COMMON = {"type", "do_if", "match_fields", "match_mode", "match_invert", "metric_name", "metric_labels", "metric_skip_status"}


def size(text: str | int) -> int:
    """Bytes of a size such as 64 KB or 1.5GiB."""
    if isinstance(text, int):
        return text
    m = re.fullmatch(r"\s*([0-9.]+)\s*([a-zA-Z]*)\s*", text)
    if not m or (m[2] or "b").lower() not in UNITS:
        raise ValueError(f"bad size {text!r}")
    return int(float(m[1]) * UNITS[(m[2] or "b").lower()])


def expression(text: str | int, values: dict[str, int]) -> int:
    """Integer arithmetic over names such as capacity and gomaxprocs."""

    def run(node: ast.AST) -> int:
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](run(node.left), run(node.right))
        if isinstance(node, ast.Constant) and isinstance(node.value, int):
            return node.value
        if isinstance(node, ast.Name) and node.id in values:
            return values[node.id]
        raise ValueError(f"bad expression {text!r}")

    return run(ast.parse(str(text), mode="eval").body)


def resolved(value: Any, secrets: Any = None) -> Any:
    """env(NAME) and vault(path, key) texts replaced; ``secrets(path, key)`` looks the latter up."""
    if isinstance(value, dict):
        return {k: resolved(v, secrets) for k, v in value.items()}
    if isinstance(value, list):
        return [resolved(v, secrets) for v in value]
    if isinstance(value, str) and (m := re.fullmatch(r"env\(([^)]+)\)", value)):
        return os.environ[m[1].strip()]
    if isinstance(value, str) and (m := re.fullmatch(r"vault\(([^,]+),([^)]+)\)", value)):
        if secrets is None:
            raise ValueError("vault() needs a secrets function")
        return secrets(m[1].strip(), m[2].strip())
    return value


def merged(a: dict, b: dict) -> dict:
    out = dict(a)
    for k, v in b.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(*sources: str | dict, overrides: dict[str, str] | None = None, secrets: Any = None) -> dict:
    """Sources (paths, YAML texts or dicts) merged from left to right; overrides are dotted paths."""
    import yaml

    found: dict = {}
    for s in sources:
        if not isinstance(s, dict):
            s = yaml.safe_load(Path(s).read_text() if "\n" not in s and os.path.exists(s) else s) or {}
        found = merged(found, json.loads(json.dumps(s)))
    for path, value in (overrides or {}).items():
        here = found
        *up, last = path.split(".")
        for p in up:
            here = here.setdefault(p, {})
        here[last] = value
    for name in found.get("pipelines", {}):
        if not re.fullmatch("[a-zA-Z0-9_]+", name):
            raise ValueError(f"bad pipeline name {name!r}")
    return resolved(found, secrets)
