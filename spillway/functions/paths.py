"""Field paths and a document's columns as a tree that operators edit before Spark sees it.

A path is dot-separated; ``\\.`` is a dot within a name. Columns whose names begin with
an underscore are the event's envelope and no document fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse(path: str) -> list[str]:
    out, cur, i = [], "", 0
    while i < len(path):
        if path.startswith("\\.", i):
            cur, i = cur + ".", i + 2
            continue
        if path[i] == ".":
            out.append(cur)
            cur = ""
        else:
            cur += path[i]
        i += 1
    return [*out, cur] if path else []


def build(parts: list[str]) -> str:
    return ".".join(p.replace(".", "\\.") for p in parts)


def outermost(paths: list[str]) -> list[list[str]]:
    """Parsed paths without those that lie below another."""
    parsed = sorted({tuple(parse(p)) for p in paths if p}, key=len)
    out: list[tuple] = []
    for p in parsed:
        if not any(p[: len(q)] == q for q in out):
            out.append(p)
    return [list(p) for p in out]


class Node:
    """A field: a column and its type, or, once edited below, named children."""

    def __init__(self, column: Column | None = None, kind: T.DataType | None = None, children: dict[str, "Node"] | None = None):
        self.column, self.kind, self.children = column, kind, children

    def open(self) -> dict[str, "Node"] | None:
        """The children of an object; an unedited object stays as it is in ``value``."""
        if self.children is None and isinstance(self.kind, T.StructType):
            return {f.name: Node(self.column.getField(f.name), f.dataType) for f in self.kind.fields}
        return self.children

    def own(self) -> dict[str, "Node"]:
        if self.children is None:
            self.children = self.open() or {}
            self.column = None
        return self.children

    def value(self) -> Column:
        if self.children is None:
            return self.column
        return F.struct(*[n.value().alias(k) for k, n in self.children.items()]) if self.children else F.struct()


class Document:
    """The fields of a DataFrame's rows; ``frame`` makes the edited DataFrame."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.envelope = [c for c in df.columns if c.startswith("_")]
        self.root = Node(children={f.name: Node(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if not f.name.startswith("_")})

    def find(self, path: str | list[str]) -> Node | None:
        node = self.root
        for p in parse(path) if isinstance(path, str) else path:
            kids = node.open()
            if kids is None or p not in kids:
                return None
            node = kids[p]
        return node

    def get(self, path: str | list[str]) -> Column | None:
        node = self.find(path)
        return None if node is None else node.value()

    def kind(self, path: str | list[str]) -> T.DataType | None:
        node = self.find(path)
        if node is None:
            return None
        return node.kind if node.children is None else T.StructType()

    def set(self, path: str | list[str], column: Column, kind: T.DataType | None = None) -> None:
        parts = parse(path) if isinstance(path, str) else path
        node = self.root
        for p in parts[:-1]:
            kids = node.own()
            if p not in kids or (kids[p].children is None and not isinstance(kids[p].kind, T.StructType)):
                kids[p] = Node(children={})
            node = kids[p]
        node.own()[parts[-1]] = Node(column, kind)

    def put(self, name: str, node: Node) -> None:
        self.root.own()[name] = node

    def drop(self, path: str | list[str]) -> Node | None:
        parts = parse(path) if isinstance(path, str) else path
        if self.find(parts) is None:
            return None
        node = self.root
        for p in parts[:-1]:
            node = node.own()[p]
        return node.own().pop(parts[-1])

    def text(self, path: str | list[str]) -> Column:
        """A field as a string: "" where absent, null or a container is missing."""
        node = self.find(path)
        if node is None:
            return F.lit("")
        kind = self.kind(path)
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return F.lit("")
        return F.coalesce(node.value().cast("string"), F.lit(""))

    def names(self) -> list[str]:
        return list(self.root.children)

    def frame(self, when: Column | None = None) -> DataFrame:
        """The edited rows; where ``when`` is false a row stays as it was (fields it lacked are null)."""
        new = {k: n.value() for k, n in self.root.children.items()}
        env = [F.col(f"`{c}`") for c in self.envelope]
        if when is None:
            return self.df.select(*env, *[c.alias(k) for k, c in new.items()])
        before = {f.name: f.dataType for f in self.df.schema.fields if not f.name.startswith("_")}
        kinds = {f.name: f.dataType for f in self.df.select(*[c.alias(k) for k, c in new.items()]).schema.fields} if new else {}
        out = []
        for name in [*before, *[k for k in new if k not in before]]:
            a = new.get(name, F.lit(None))
            b = F.col(f"`{name}`") if name in before else F.lit(None)
            if name in before and name in kinds and before[name] != kinds[name]:
                a, b = (F.to_json(x) if isinstance(k, (T.StructType, T.ArrayType, T.MapType)) else x.cast("string") for x, k in ((a, kinds[name]), (b, before[name])))
            out.append(F.when(when, a).otherwise(b).alias(name))
        return self.df.select(*env, *out)
