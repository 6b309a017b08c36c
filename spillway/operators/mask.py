"""Masking of string and number leaves.

A mask with a replacement word, or one that cuts whole matches, is a regexp_replace in the
JVM; asterisks of a match's length and masks of groups run in one Arrow function over a row's leaf.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import regex
from ..functions.arrow import small_batches
from ..functions.paths import Document, Node, build, parse
from .predicates import do_if, rule_sets
from .registry import editor


def mask_text(s: str, pattern, groups: list[int], max_count: int, word: str | None, cut: bool) -> str:
    """Every match's groups (0 is the whole) replaced by the word, nothing, or an asterisk a character."""
    out, at = [], 0
    for m in pattern.finditer(s):
        for g in [0] if 0 in groups else groups:
            a, b = m.span(g)
            if a < at or a < 0 or (a == b and word is None):
                continue
            out.append(s[at:a])
            if word is not None:
                out.append(word)
            elif not cut:
                n = b - a
                out.append("*" * (min(n, max_count) if max_count else n))
            at = b
    return "".join(out) + s[at:]


def masked(text: Column, re2: str, groups: list[int], max_count: int = 0, word: str | None = None, cut: bool = False) -> Column:
    if 0 in groups and (word is not None or cut):
        replacement = "" if word is None else word.replace("\\", "\\\\").replace("$", "\\$")
        return F.regexp_replace(text, F.lit(regex.java(re2)), F.lit(replacement))

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        pattern = regex.python(re2)
        return s.map(lambda x: mask_text(x, pattern, groups, max_count, word, cut), na_action="ignore")

    # only texts that match leave the JVM: Spark calls a Python function on every row, in a branch too, so the others are null to it
    return F.coalesce(run(F.when(text.rlike(regex.java(re2)), text)), text)


def _listed(path: list[str], listed: list[list[str]]) -> bool:
    return any(path[: len(p)] == p for p in listed)


def _array(col: Column, kind: T.DataType, f) -> Column:
    return F.transform(col, lambda x: f(x, kind))


@editor("mask")
def mask(
    doc: Document, masks: list[dict], skip_mismatched: bool = False, mask_applied_field: str = "", mask_applied_value: str = "", ignore_fields: list[str] | None = None,
    process_fields: list[str] | None = None, applied_metric_name: str = "mask_applied_total", applied_metric_labels: list[str] | None = None,
) -> None:
    """Masks are applied one after another to all leaves, or to those that the lists of fields name.

    A mask has re and groups, and one of max_count, replace_word and cut_values; match_rules and do_if decide whether
    it is applied; applied_field and applied_value mark the rows that it changed."""
    if process_fields and ignore_fields:
        raise ValueError("process_fields and ignore_fields exclude each other")
    changed_any: list[Column] = []
    for spec in masks:
        re2 = spec.get("re", "")
        groups = list(spec.get("groups") or [0])
        if spec.get("max_count") and spec.get("replace_word"):
            raise ValueError("max_count and replace_word exclude each other")
        if re2:
            total = len(regex.group_names(re2))
            if any(g > total for g in groups) or groups != sorted(set(groups)):
                raise ValueError("groups must exist and ascend")
        plain = bool(re2) and 0 in groups and (spec.get("replace_word") or spec.get("cut_values"))
        if re2 and not plain:
            small_batches(doc.df)
        only = [parse(p) for p in spec.get("process_fields") or ([] if spec.get("ignore_fields") else process_fields or [])]
        skip = [parse(p) for p in spec.get("ignore_fields") or ([] if spec.get("process_fields") else ignore_fields or [])]
        allowed = do_if(doc, spec["do_if"]) if spec.get("do_if") else None
        changed: list[Column] = []

        def leaf(col: Column, kind: T.DataType) -> Column | None:
            if isinstance(kind, T.ArrayType):
                inner = leaf(F.lit(None).cast(kind.elementType), kind.elementType)
                return None if inner is None else F.transform(col, lambda x: leaf(x, kind.elementType))
            if not isinstance(kind, (T.StringType, T.NumericType)):
                return None
            text = col.cast("string")
            new = masked(text, re2, groups, int(spec.get("max_count", 0)), spec.get("replace_word") or None, bool(spec.get("cut_values"))) if re2 else text
            ok = allowed
            if spec.get("match_rules"):
                rules = rule_sets(text, spec["match_rules"])
                ok = rules if ok is None else ok & rules
            return new if ok is None else F.when(ok, new).otherwise(text)

        def walk(node: Node, path: list[str]) -> None:
            kids = node.open()
            if kids is not None:
                if _listed(path, skip) and path:
                    return
                for k, child in node.own().items():
                    walk(child, [*path, k])
                return
            if _listed(path, skip) or (only and not _listed(path, only)):
                return
            kind = node.kind
            if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.NumericType)):
                return
            if isinstance(kind, T.ArrayType):
                if not plain:
                    return _exploded(node, spec, re2, groups)
            new = leaf(node.column, kind)
            if new is None:
                return
            old = node.column
            was = old.cast("array<string>") if isinstance(kind, T.ArrayType) else old.cast("string")
            # without groups a mask counts as applied wherever its rules hold
            changed.append(F.coalesce(new != was, F.lit(False)) if re2 else F.coalesce(rule_sets(was, spec.get("match_rules") or []), F.lit(False)))
            if re2:
                node.column, node.kind = new, T.ArrayType(T.StringType()) if isinstance(kind, T.ArrayType) else T.StringType()

        walk(doc.root, [])
        hit = F.lit(False)
        for c in changed:
            hit = hit | c
        changed_any.append(hit)
        if spec.get("applied_field"):
            name = spec["applied_field"]
            old = doc.get(name)
            doc.set(name, F.when(hit, F.lit(spec.get("applied_value", ""))).otherwise(F.lit(None).cast("string") if old is None else old.cast("string")), T.StringType())
    if mask_applied_field:
        hit = F.lit(False)
        for c in changed_any:
            hit = hit | c
        old = doc.get(mask_applied_field)
        doc.set(mask_applied_field, F.when(hit, F.lit(mask_applied_value)).otherwise(F.lit(None).cast("string") if old is None else old.cast("string")), T.StringType())


def _exploded(node: Node, spec: dict, re2: str, groups: list[int]) -> None:
    """Arrays of strings under masks that need Python: one Arrow call for a whole array."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        pattern = regex.python(re2)
        return s.map(lambda xs: [None if x is None else mask_text(x, pattern, groups, int(spec.get("max_count", 0)), spec.get("replace_word") or None, bool(spec.get("cut_values"))) for x in xs], na_action="ignore")

    if re2:
        texts = node.column.cast("array<string>")
        hit = F.exists(texts, lambda x: x.rlike(regex.java(re2)))
        node.column, node.kind = F.coalesce(run(F.when(hit, texts)), texts), T.ArrayType(T.StringType())


__all__ = ["mask", "mask_text", "masked", "build"]
