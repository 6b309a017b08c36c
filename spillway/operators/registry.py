"""The registry of operators. An operator takes a DataFrame, its predicate and its settings.

``@action("name")`` registers ``f(df, when, **settings) -> DataFrame``; ``when`` is the operator's
predicate as a boolean column or None. ``@editor("name")`` registers ``f(doc, **settings)``, which
edits a Document in place; rows that the predicate excludes stay as they were.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from ..functions.paths import Document

ACTIONS: dict[str, Callable[..., DataFrame]] = {}


def _checked(name: str, f: Callable, skip: int) -> None:
    f.settings = {p for p in list(inspect.signature(f).parameters)[skip:]}
    f.operator = name


def action(name: str):
    def register(f):
        _checked(name, f, 2)
        ACTIONS[name] = f
        return f

    return register


def editor(name: str):
    def register(f):
        def run(df: DataFrame, when: Column | None = None, **settings) -> DataFrame:
            doc = Document(df)
            f(doc, **settings)
            return doc.frame(when)

        _checked(name, f, 1)
        run.settings, run.operator, run.__doc__ = f.settings, name, f.__doc__
        ACTIONS[name] = run
        return run

    return register
