"""Operator 4, n-gram Jaccard join: an exact prefix-tree join of word N-gram sets.

A document is the set of its hashed word N-grams (48 bits). The join finds all pairs of documents whose
sets have a Jaccard similarity of THRESHOLD or more; nothing is sampled, capped or met by chance.

1. All n-grams are counted (``exchange``). The global order is rarest first (by a step of an
   eighth of a power of two), then by hash. An n-gram of a single set overlaps with nothing and isn't kept.
2. Prefix filter: two similar sets share an n-gram among the first size - ceil(threshold * size) + 1 of
   each in the global order. A set with fewer shared n-grams than its bound has no partner and goes.
3. Each prefix n-gram is named by the least set (by hash) that has it in its prefix. A set is sent to the
   cells named by its own prefix n-grams: mostly one, since near copies share nearly all. So
   two similar sets meet in at least one cell, and a cell holds only sets that share a
   prefix n-gram with one set: there are no chains. A cell of more than CELL sets
   is cut in blocks, and each pair of blocks is a task of its own.
4. In a cell the sets, in the global order with the most frequent n-gram first, form a trie; chains
   without branches are one node. All sets query it at once: a node's partial overlaps with the queries are
   its parent's plus those of its own n-grams, and a query leaves a subtree as
   soon as its overlap and what can still follow (the lesser of the query's and the subtree's
   greatest remaining length) can't reach the bound for the subtree's least size. Leaves are
   exact. A pair that meets in several cells counts in the least cell that both have.
5. A cell reports for each set the number of its links and a root that links reach within the cell, so
   its result is as long as the cell. Sums by set give links; connected components over
   the roots (alternating large-star and small-star steps) give classes.

``classes`` returns a row for each document: its class (least doc_id of the connected component) and its links (how
many other documents are similar to it, copies included). ``pairs`` gives the similar pairs of different sets, each
set by its least doc_id. ``keep`` keeps of each class the rows with its least doc_id.

Defined cases. A null, empty or wordless text has no set: class doc_id, no links. A text of fewer
than N words is one shorter n-gram. Rows of equal doc_id and set are one document; rows of equal doc_id and
different sets are different documents. A null doc_id is left out of the join (class null, no links; always kept by ``keep``).
doc_id may be of any type that can be ordered. Empty tables give an empty result. Other columns are passed
through by ``keep``, whatever their names, and ignored otherwise. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, discard, grams, mapped, mix, read, words, written
from .exchange import KEY_BITS, SENT, addressed, answered, batch, gaps, pack, runs, streamed, ungap, unpack

N = 3
THRESHOLD = 0.5
UNIT = 1_500_000  # n-grams of a unit
PART = 2_000_000  # n-grams of a partition, on average
CELL = 2000  # sets of a block of a cell
FEW = 4_000_000  # ids that are broadcast (64 MB)
MATRIX = 32 << 20  # bytes of the queries' n-grams
OWN, GRAMS = 0, 1
LOW48 = np.uint64((1 << 48) - 1)


def sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram) of the different n-grams of each text, ascending."""
    hashes, rows, _, _ = words(column)
    g, r = grams(hashes, rows, n, len(column))
    x = (r.astype(np.uint64) << KEY_BITS) | (g >> np.uint64(16))
    x.sort()
    if len(x):
        x = x[np.append(True, x[1:] != x[:-1])]
    return (x >> KEY_BITS).astype(np.int64), x & LOW48


def identity(rows: np.ndarray, key: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, size) of each row's set; size 0 where there is none."""
    size = np.bincount(rows, minlength=count)
    total = np.zeros(len(key) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(key + np.uint64(1)), out=total[1:])
        end = np.cumsum(size)
        return mix(total[end] - total[end - size] + size.astype(np.uint64)), size


def signed(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` (with text) with __set, the hash of its set (null for none), and __size."""
    schema = docs.withColumns({"__set": F.lit(0).cast("long"), "__size": F.lit(0)}).schema
    schema["__set"].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in chunks(b):
                h, size = identity(*sets(part.column("text"), n), part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(h.view(np.int64), mask=size == 0), pa.array(size.astype(np.int32))], schema.names)

    return mapped(docs, run, schema)


def sent(docs: DataFrame, n: int, parts: int, unit: int) -> DataFrame:
    """Each unit's n-grams, with the documents that have them, addressed to their partitions; equal sets of a unit once."""

    def flush(number: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, doc, h, size = (np.concatenate(x) for x in zip(*held))
        once = np.zeros(len(h), bool)
        once[np.unique(h, return_index=True)[1]] = True
        once &= size > 0
        x = (key << np.uint64(16)) | doc.astype(np.uint64)
        x = x[once[doc]]
        x.sort()
        keys, docs_of = x >> np.uint64(16), (x & np.uint64(0xFFFF)).astype(np.uint32)
        first, count = runs(keys)
        count = count.astype(np.uint32)
        ends = np.append(first, len(x))
        rows = [(number % parts, number, OWN, pack(h, size.astype(np.uint32)))]
        for row in addressed(number, GRAMS, keys[first], parts, lambda a, b: (count[a:b], docs_of[ends[a] : ends[b]])):
            rows.append(row)
            if len(rows) == 64:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n_keys, n_docs = TaskContext.get().partitionId() << 32, [], 0, 0
        for b in batches:
            for part in chunks(b):
                rows, key = sets(part.column("text"), n)
                if held and (n_keys + len(key) > unit or n_docs + part.num_rows > 1 << 16):
                    yield from flush(number, held)
                    number, held, n_keys, n_docs = number + 1, [], 0, 0
                held.append((key, rows + n_docs, *identity(rows, key, part.num_rows)))
                n_keys, n_docs = n_keys + len(key), n_docs + part.num_rows
        if held:
            yield from flush(number, held)

    return mapped(docs.select("text"), run, SENT)


def counted(table: pa.Table) -> list[tuple]:
    """The answers of one partition: each unit's n-grams that occur elsewhere too, with their step of the order."""
    kinds, units, payloads = np.asarray(table.column("kind")), np.asarray(table.column("unit")), table.column("payload")
    out = [(0, int(units[i]), OWN, payloads[int(i)].as_py()) for i in np.flatnonzero(kinds == OWN)]
    at = np.flatnonzero(kinds == GRAMS)
    if not len(at):
        return out
    got = [unpack(payloads[int(i)].as_buffer()) for i in at]
    keys = [ungap(g[0]) for g in got]
    _, code = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(code, np.concatenate([g[1] for g in got]))
    lo = 0
    for i, k, (_, count, docs) in zip(at, keys, got):
        r = total[code[lo : lo + len(k)]]
        lo += len(k)
        many = r > 1
        if many.any():
            step = np.minimum(8 * np.log2(r[many]), 255).astype(np.uint8)
            out.append((0, int(units[i]), GRAMS, pack(gaps(k[many]), step, count[many].astype(np.uint32), docs[np.repeat(many, count)].astype(np.uint32))))
    return out


def bound(size: np.ndarray, threshold: float) -> np.ndarray:
    """The n-grams that a set of the size must share with a similar one."""
    return np.maximum(np.ceil(threshold * size - 1e-9), 1).astype(np.int64)


FOUND = "set long, size int, grams binary, prefix array<long>"


def candidates(table: pa.Table, threshold: float) -> pa.Table:
    """Of one unit, the sets that may have a partner: shared n-grams in the global order, and which of them are in the prefix."""
    kinds, payloads = np.asarray(table.column("kind")), table.column("payload")
    h, size = unpack(payloads[int(np.flatnonzero(kinds == OWN)[0])].as_buffer())
    got = [unpack(payloads[int(i)].as_buffer()) for i in np.flatnonzero(kinds == GRAMS)]
    none = np.zeros(0, np.uint64)
    key, step, count, doc = ([ungap(g[0]) for g in got], *([g[i] for g in got] for i in (1, 2, 3)))
    key, step, count, doc = (np.concatenate(x) if x else none for x in (key, step, count, doc))
    code = (step.astype(np.uint64) << KEY_BITS) | key
    code, doc = np.repeat(code, count.astype(np.int64)), doc.astype(np.int64)
    need = bound(size.astype(np.int64), threshold)
    shared = np.bincount(doc, minlength=len(h))
    ok = (shared >= need) & (shared > 0)
    code, doc = code[ok[doc]], doc[ok[doc]]
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    at = np.flatnonzero(ok)
    lo, hi = np.searchsorted(doc, at), np.searchsorted(doc, at, "right")
    first = hi - lo - need[at] + 1
    prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(first)).astype(np.int32)), pa.array(np.concatenate([code[a : a + f] for a, f in zip(lo, first)] or [none]).view(np.int64)))
    return pa.table({"set": pa.array(h[at].view(np.int64)), "size": pa.array(size[at].astype(np.int32)), "grams": pa.array([code[a:b].tobytes() for a, b in zip(lo, hi)], pa.binary()), "prefix": prefix})


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, root): the least id of each id's connected component, by large-star and small-star steps."""
    mark = (F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    now = written(links.select("a", "b").distinct(), name)
    before = tuple(now.agg(*mark).first())
    while before[0]:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b"), F.col("m").alias("a")).distinct()
        # small star: every id's smaller neighbours, and itself, hang on the least of them
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        hung = large.join(small, "b").where("a <> m").select(F.col("a").alias("b"), F.col("m").alias("a"))
        step = hung.unionByName(small.select("b", F.col("m").alias("a"))).where("a <> b").distinct()
        last, now = now, written(step.select("a", "b"), name)
        discard(last)
        state = tuple(now.agg(*mark).first())
        if state == before:
            break
        before = state
    members = now.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("id"), "root")
    return members.unionByName(members.select(F.col("root").alias("id"), "root").distinct())


class Trie:
    """A path-compressed trie of increasing sequences. A node comes after its parent; ``leaf`` has the sequences that
    end in a node, ``rest`` the greatest number of elements below it, ``least`` the least size of a set in its subtree."""

    def __init__(self, ranks: list[np.ndarray], size: np.ndarray):
        self.parent, self.run, self.rest, self.leaf, self.least = [], [], [], [], []
        keys = [r.astype(">u4").tobytes() for r in ranks]
        todo = [(-1, sorted(range(len(ranks)), key=keys.__getitem__), 0)]
        while todo:
            parent, part, depth = todo.pop()
            first, last = ranks[part[0]], ranks[part[-1]]
            n = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:n] != last[depth:n])
            end = depth + int(differ[0]) if len(differ) else n
            node = len(self.run)
            self.parent.append(parent)
            self.run.append(first[depth:end])
            self.rest.append(max(len(ranks[i]) for i in part) - end)
            self.least.append(int(size[part].min()))
            groups: list[list[int]] = []
            here = []
            for i in part:
                if len(ranks[i]) == end:
                    here.append(i)
                elif groups and ranks[groups[-1][0]][end] == ranks[i][end]:
                    groups[-1].append(i)
                else:
                    groups.append([i])
            self.leaf.append(np.array(here, np.int64))
            todo += [(node, g, end) for g in groups]


def similar(members: list[np.ndarray], size: np.ndarray, threshold: float, left: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(i's, j, overlaps) of the pairs of sets whose similarity reaches the threshold, each pair once.

    Members are arrays of n-grams in the global order, of which others may hold some; size has
    the sizes of the whole sets. ``left`` marks one side where only pairs of both sides are wanted."""
    if len(members) < 2:
        return
    flat, code, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    used = count > 1
    rank = np.cumsum(used[::-1])[::-1] - 1  # the most frequent come first
    shared = int(used.sum())
    ends = np.cumsum([len(m) for m in members])
    ranks = [rank[c[used[c]]][::-1] for c in (code[e - len(m) : e] for m, e in zip(members, ends))]
    stored = np.arange(len(members)) if left is None else np.flatnonzero(left)
    asking = np.arange(len(members)) if left is None else np.flatnonzero(~left)
    if not len(stored) or not len(asking):
        return
    trie = Trie([ranks[i] for i in stored], size[stored])
    kids: list[list[int]] = [[] for _ in trie.run]
    for node, parent in enumerate(trie.parent):
        if parent >= 0:
            kids[parent].append(node)
    few = max(16, MATRIX // max(shared, 1))
    factor = threshold / (1 + threshold)
    for lo in range(0, len(asking), few):
        queries = asking[lo : lo + few]
        matrix = np.zeros((len(queries), shared), bool)
        for k, q in enumerate(queries):
            matrix[k, ranks[q]] = True
        sizes = size[queries]
        todo = [(0, np.arange(len(queries)), np.zeros(len(queries), np.int64), matrix.sum(1))]
        while todo:
            node, alive, overlap, remaining = todo.pop()
            run = trie.run[node]
            if len(run):
                got = np.concatenate([matrix[alive[k : k + 64, None], run].sum(1) for k in range(0, len(alive), 64)])
                overlap, remaining = overlap + got, remaining - got
            # |a & b| >= t / (1 + t) * (|a| + |b|)
            ok = overlap + np.minimum(remaining, trie.rest[node]) >= factor * (sizes[alive] + trie.least[node]) - 1e-9
            if not ok.all():
                alive, overlap, remaining = alive[ok], overlap[ok], remaining[ok]
            if not len(alive):
                continue
            for k in trie.leaf[node]:
                j = int(stored[k])
                fits = overlap >= threshold * (sizes[alive] + size[j] - overlap) - 1e-9
                if left is None:
                    fits &= queries[alive] < j
                if fits.any():
                    yield queries[alive[fits]], j, overlap[fits]
            todo += [(k, alive, overlap, remaining) for k in kids[node]]


def linked(table: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """The similar pairs of one task, of those that count in its cell."""
    members = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("grams")]
    size = np.asarray(table.column("size")).astype(np.int64)
    cell = int(table.column("cell")[0].as_py())
    cells = table.column("cells").combine_chunks()
    of = np.repeat(np.arange(len(cells)), np.diff(np.asarray(cells.offsets)))
    other = np.asarray(cells.flatten())
    of, other = of[other < cell], other[other < cell]
    _, code, count = np.unique(other, return_inverse=True, return_counts=True)
    earlier = np.zeros((len(members), int((count > 1).sum())), bool)
    place = np.cumsum(count > 1) - 1
    many = count[code] > 1
    earlier[of[many], place[code[many]]] = True
    low, high = (int(table.column(c)[0].as_py()) for c in ("low", "high"))
    left = None if low == high else np.asarray(table.column("block")) == low
    for i, j, overlap in similar(members, size, threshold, left):
        if earlier.shape[1]:
            here = ~(earlier[i] & earlier[j]).any(1)
            i, overlap = i[here], overlap[here]
        if len(i):
            yield i, j, overlap


def roots(table: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, root, links) of the sets of a task that have links in it."""
    ids, weight = np.asarray(table.column("set")), np.asarray(table.column("n"))
    up, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j, _ in linked(table, threshold):
        links[i] += weight[j]
        links[j] += weight[i].sum()
        r = top(j)
        for k in np.unique(up[i]):
            up[top(int(k))] = r
    some = np.flatnonzero(links)
    root = np.array([top(int(k)) for k in some], np.int64)
    return ids[some], ids[root], links[some]


def tasks(docs: DataFrame, n: int, threshold: float, unit: int = UNIT, part: int = PART, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """(doc_id, __set, __size) of all documents with an id, and the rows that meet in each task."""
    known = docs.where("doc_id is not null").select("doc_id", "text")
    all_sets = written(signed(known, n).select("doc_id", "__set", "__size"), "sets")
    total = all_sets.agg(F.sum("__size")).first()[0] or 0
    parts = int(min(max(1, -(-total // part)), (1 << 31) - 1))
    answers = answered(sent(known, n, parts, unit), parts, counted)
    found = written(answers.select("unit", "kind", "payload").groupBy("unit").applyInArrow(lambda t: candidates(t, threshold), FOUND), "candidates")
    prefix = found.select("set", F.explode("prefix").alias("gram"))
    named = prefix.groupBy("gram").agg(F.min("set").alias("cell"), F.max("set").alias("most")).where("cell < most").select("gram", "cell")
    of = prefix.join(named, "gram").groupBy("set").agg(F.array_sort(F.collect_set("cell")).alias("cells"))
    copies = all_sets.where("__set is not null").distinct().groupBy(F.col("__set").alias("set")).agg(F.count("*").alias("n"))
    whole = found.select("set", "size", "grams").dropDuplicates(["set"])
    members = written(of.join(whole, "set").join(copies, "set").select("*", F.explode("cells").alias("cell")), "members")
    discard(found)
    large = members.groupBy("cell").count().where(F.col("count") > cell).select("cell", F.ceil(F.col("count") / cell).cast("int").alias("blocks"))
    rows = members.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")}).drop("with", "blocks")
    key = ["cell", "low", "high"]
    return all_sets, rows.repartition(*key).sortWithinPartitions(*key)


def classed(docs: DataFrame, n: int, threshold: float, **sizes) -> tuple[DataFrame, DataFrame]:
    """(doc_id, __set, __size) of all documents with an id, and (set, class_id, kept, links) of all sets; kept is the set of the class's first document."""
    all_sets, rows = tasks(docs, n, threshold, **sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in streamed(batches, ["cell", "low", "high"]):
            if t.num_rows > 1:
                found = roots(t, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["set", "root", "links"])

    links = written(mapped(rows, run, "set long, root long, links long"), "links")
    group = components(links.where("set <> root").select(F.least("set", "root").alias("a"), F.greatest("set", "root").alias("b")), "classes").select(F.col("id").alias("set"), "root")
    one = all_sets.where("__set is not null").distinct().groupBy(F.col("__set").alias("set")).agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    sums = links.groupBy("set").agg(F.sum("links").alias("links"))
    one = one.join(sums, "set", "left").join(group, "set", "left").withColumn("root", F.coalesce("root", "set"))
    first = one.groupBy("root").agg(F.min(F.struct("least", "set")).alias("first")).select("root", F.col("first.least").alias("class_id"), F.col("first.set").alias("kept"))
    return all_sets, one.join(first, "root").select("set", "class_id", "kept", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, **sizes) -> DataFrame:
    """(doc_id, class_id, links) of every row of ``docs`` (doc_id, text)."""
    all_sets, found = classed(docs, n, threshold, **sizes)
    rows = all_sets.join(found, F.col("__set") == F.col("set"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    without = docs.where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return rows.unionByName(without)


def pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, **sizes) -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard): similar pairs of different sets, each by its least document."""
    all_sets, rows = tasks(docs, n, threshold, **sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in streamed(batches, ["cell", "low", "high"]):
            if t.num_rows > 1:
                ids, size = np.asarray(t.column("set")), np.asarray(t.column("size"))
                for i, j, overlap in linked(t, threshold):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(np.repeat(ids[j], len(i))), pa.array(overlap / (size[i] + size[j] - overlap))], ["a", "b", "jaccard"])

    least = all_sets.where("__set is not null").groupBy("__set").agg(F.min("doc_id").alias("least"))
    a, b = (least.select(F.col("__set").alias(x), F.col("least").alias(f"doc_id_{x}")) for x in "ab")
    out = mapped(rows, run, "a long, b long, jaccard double").join(a, "a").join(b, "b")
    return out.select(F.least("doc_id_a", "doc_id_b").alias("doc_id_a"), F.greatest("doc_id_a", "doc_id_b").alias("doc_id_b"), "jaccard")


def few(table: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast while it has FEW rows at most; a larger one is joined by shuffle."""
    return F.broadcast(table) if table.count() <= FEW else table


def keep(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, **sizes) -> DataFrame:
    """``docs`` with one row of each class, all columns: that of least doc_id, of several such the one whose set has the least hash."""
    all_sets, found = classed(docs, n, threshold, **sizes)
    rows = all_sets.where("__set is not null").join(found, F.col("__set") == F.col("set")).where("doc_id <> class_id or __set <> kept")
    drop = written(rows.select(F.col("doc_id").alias("__id"), "__set").distinct(), "drop")
    again = few(written(all_sets.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")), "again"))
    ids = few(written(drop.join(again, F.col("__id") == F.col("__again"), "left_anti").select("__id"), "drop-ids"))
    rest = docs.join(ids, docs["doc_id"] == ids["__id"], "left_anti")
    if again.isEmpty():
        return rest
    # a doc_id of several rows: each row is decided by its own set
    once = rest.join(again, rest["doc_id"] == again["__again"], "left_anti")
    several = docs.join(again, docs["doc_id"] == again["__again"], "left_semi")
    several = signed(several.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")), n)
    several = several.join(few(drop).select("__id", F.col("__set").alias("__gone")), (F.col("doc_id") == F.col("__id")) & (F.col("__set") == F.col("__gone")), "left_anti")
    several = several.where("__set is null").unionByName(several.where("__set is not null").dropDuplicates(["doc_id", "__set"]))
    return once.union(several.select(*[F.col("__row")[c].alias(c) for c in docs.columns]))


_GRAMS = "[0-9a-z\\x{80}-\\x{10FFFF}]+"
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '{_GRAMS}') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {N - 1}, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + {N - 1}), ' ')))) AS g FROM w WHERE len(w) > 0),
s AS (SELECT min(doc_id) AS id, count(*) AS n, g FROM g GROUP BY g),
t AS MATERIALIZED (SELECT id, len(g) AS size, unnest(g) AS gram FROM s),
p AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.gram = b.gram AND a.id < b.id GROUP BY a.id, b.id, a.size, b.size HAVING count(*) >= {THRESHOLD} * (a.size + b.size - count(*)) - 1e-9),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT id, id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a),
c AS (SELECT id, min(root) AS class_id FROM r GROUP BY id),
l AS (SELECT s.id, s.n - 1 + coalesce(sum(o.n), 0) AS links FROM s LEFT JOIN e ON s.id = e.a LEFT JOIN s o ON e.b = o.id GROUP BY s.id, s.n)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(l.links, 0)::BIGINT AS links
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN s ON s.g = g.g LEFT JOIN c ON c.id = s.id LEFT JOIN l ON l.id = s.id
"""


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))
