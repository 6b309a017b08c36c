"""Operator 3, benchmark decontamination: q-gram lemma filter and banded alignment.

Texts and benchmark items are normalised alike: lower case, words joined by one
space, as UTF-8 bytes. An item of m bytes has an edit budget of k = RATE * m, or less if it is short: (m - q) / q at most, so that the
bound below stays positive (with q = 12 and 6 % this concerns items of fewer than some 40 bytes). If a
text holds it within k edits, they share at least m - q + 1 - k * q of the item's q-grams
(the q-gram lemma), on diagonals that lie within k of each other. So the q-grams that a text shares
with an item are counted in diagonal bands that overlap by more than 2k, only
bands that reach the bound are kept, and a banded alignment of the item against
the band's part of the text decides.

The benchmark's q-grams are broadcast as sorted arrays; a benchmark of more than
SHARD bytes is taken in shards, each with its own pass over the documents.

Defined cases. A null or empty text matches nothing; neither does an item that is null
or has no word. An item of fewer than q bytes is found only without edits, as
whole words. Repeated rows each get their rows; repeated items likewise. An item
that occurs several times in a document is reported once, at its best place (the
first among equals). Empty tables give an empty result. Ids may be of any type. Other columns are passed through by
``keep``, whatever their names, and ignored by ``find``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTE, _WORD, chunks, mapped, mix, powers, read, text_buffer

Q = 12
RATE = 0.06
SHARD = 32 << 20
BITS = 20


def normalise(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the normalised texts and row offsets; every word is followed by one space."""
    data, offsets = text_buffer(pc.utf8_lower(column))
    end = np.zeros(len(data) + 1, bool)
    word = _WORD[data]
    # a row's last word ends where the row ends: such a row gets its space by an extra byte below
    filled = offsets[1:][offsets[1:] > offsets[:-1]]
    open_end = filled[word[filled - 1]] if len(filled) else filled
    after = np.zeros(len(data), bool)
    after[1:] = word[:-1]
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]
    after[starts] = False
    kept = word | (~word & after)
    out = np.where(word, data, np.uint8(32))
    size = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kept, out=size[1:])
    extra = np.zeros(len(offsets), np.int64)
    rows_open = np.searchsorted(offsets, open_end, "left") - 1
    extra_rows = np.zeros(len(offsets) - 1, np.int64)
    extra_rows[rows_open] = 1
    np.cumsum(extra_rows, out=extra[1:])
    packed = np.insert(out[kept], size[open_end], np.uint8(32))
    del end
    return packed, size[offsets] + extra


def rolling(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q bytes from each place."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        return mix((total[q:] - total[:n]) * down[:n])


class Index:
    """q-grams of the benchmark's items: sorted hashes, and for each the (item, place) that have it."""

    def __init__(self, ids: pa.Array, texts: list, q: int, rate: float):
        data, offsets = normalise(pa.array(texts, pa.string()))
        self.q, self.ids = q, ids
        self.items = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
        m = np.array([len(x) for x in self.items], dtype=np.int64)
        self.m = m
        # an item's budget is cut where the bound would fall below 1
        self.k = np.maximum(np.minimum((m * rate).astype(np.int64), (m - q) // q), 0)
        self.bound = m - q + 1 - self.k * q
        self.band = 2 * self.k + 1
        hashes, item, place = [], [], []
        for i, x in enumerate(self.items):
            h = rolling(np.frombuffer(x, np.uint8), q)
            hashes.append(h)
            item.append(np.full(len(h), i))
            place.append(np.arange(len(h)))
        h = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.hashes, first, self.copies = np.unique(h[order], return_index=True, return_counts=True)
        self.first = first
        self.item = np.concatenate(item or [np.zeros(0, np.int64)])[order]
        self.place = np.concatenate(place or [np.zeros(0, np.int64)])[order]
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[(self.hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True
        self.short = [i for i in range(len(m)) if 0 < m[i] < q]

    def matches(self, column: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item, start, edits) of the items that the texts hold, one for each row and item."""
        data, offsets = normalise(column)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        h = rolling(data, self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - BITS)).astype(np.int64)]) if len(self.hashes) else np.zeros(0, np.int64)
        if len(at):
            i = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            hit = self.hashes[i] == h[at]
            at, i = at[hit], i[hit]
            n = self.copies[i]
            flat = np.repeat(self.first[i] - np.cumsum(n) + n, n) + np.arange(n.sum())
            item, diagonal = self.item[flat], np.repeat(at, n) - self.place[flat]
            row = np.repeat(np.searchsorted(offsets, at, "right") - 1, n)
            low = diagonal // self.band[item]
            width = len(data) + int(self.m.max()) + 2  # bands of an item lie in [-width, width)
            for shift in (0, 1):  # a diagonal lies in two bands of twice the width
                key = ((row * len(self.items) + item) * (2 * width) + (low - shift) + width)
                keys, count = np.unique(key, return_counts=True)
                of = (keys // (2 * width)) % len(self.items)
                for key, j in zip(keys[count >= self.bound[of]], of[count >= self.bound[of]]):
                    r, band = int(key // (2 * width) // len(self.items)), int(key % (2 * width)) - width
                    k, m = int(self.k[j]), int(self.m[j])
                    first = band * int(self.band[j])
                    a, b = max(first, int(offsets[r])), min(first + 2 * int(self.band[j]) + m + k, int(offsets[r + 1]))
                    found = align(self.items[j], data[a:b], k, 2 * int(self.band[j]) + 2 * k)
                    if found and (d := (found[0], a + found[1] - int(offsets[r]))) < best.get((r, int(j)), (1 << 60, 0)):
                        best[(r, int(j))] = d
        if self.short:
            for r in range(len(offsets) - 1):
                text = b" " + data[offsets[r] : offsets[r + 1]].tobytes()
                for j in self.short:
                    if (p := text.find(b" " + self.items[j])) >= 0:
                        best[(r, j)] = (0, p)
        return [(r, j, start, edits) for (r, j), (edits, start) in sorted(best.items())]


def align(item: bytes, text: np.ndarray, k: int, width: int) -> tuple[int, int] | None:
    """(edits, start) of the item's best place in the text if it takes k edits at most.

    Columns are diagonals -k .. width of the text: after j bytes of the item, diagonal d stands
    at place j + d of the text. All starts cost nothing; the least cost of the last row counts.
    """
    whole = text.tobytes()
    if (p := whole.find(item)) >= 0:
        return 0, p
    pattern = np.frombuffer(item, np.uint8)
    n, width = len(text), min(width, len(text))
    size = width + k + 1
    padded = np.concatenate([np.zeros(k, np.uint8), text, np.zeros(size + len(item), np.uint8)])
    steps = np.arange(size)
    beyond = np.int64(1 << 40)
    cost, start = np.where(steps >= k, 0, beyond), steps - k
    for j, c in enumerate(pattern):
        same = cost + (padded[j : j + size] != c)
        # the byte that is taken must lie in the text; its place is j + column - k
        same[: max(k - j, 0)] += beyond
        same[max(n - j + k, 0) :] += beyond
        skip, skip_start = np.append(cost[1:] + 1, beyond), np.append(start[1:], 0)
        take = skip < same
        cost, start = np.where(take, skip, same), np.where(take, skip_start, start)
        # insertions: from a smaller diagonal of the same row, one edit a step, within the text
        level = cost - steps
        least = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == least, steps, 0))
        start = start[source]
        cost = least + steps
        cost[max(n - j + k, 0) :] = beyond
        if cost.min() > k:
            return None
    at = int(np.argmin(cost))
    return (int(cost[at]), int(start[at])) if cost[at] <= k else None


def shards(benchmark: DataFrame, q: int, rate: float, shard: int) -> list[Index]:
    rows = benchmark.select("item_id", "text").where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // shard))
    out = []
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        table = part.orderBy("item_id").toArrow()
        out.append(Index(table.column("item_id").combine_chunks(), table.column("text").to_pylist(), q, rate))
    return out


def find(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, shard: int = SHARD) -> DataFrame:
    """(doc_id, item_id, start, edits): each item that a document holds; start counts normalised bytes."""
    some = docs.select("doc_id", "text")
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    out = None
    for index in shards(benchmark, q, rate, shard):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch):
                    found = shared.value.matches(part.column("text"))
                    ids = part.column("doc_id").take(pa.array([r for r, _, _, _ in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [ids, shared.value.ids.take(pa.array([j for _, j, _, _ in found], pa.int64())), pa.array([s for _, _, s, _ in found], pa.int64()), pa.array([e for _, _, _, e in found], pa.int32())],
                        ["doc_id", "item_id", "start", "edits"],
                    )

        part = mapped(some, run, f"doc_id {id_type}, item_id {item_type}, start bigint, edits int")
        out = part if out is None else out.unionByName(part)
    return out


def keep(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, shard: int = SHARD) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark, with all their columns."""
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    for index in shards(benchmark, q, rate, shard):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch):
                    clean = np.ones(part.num_rows, bool)
                    clean[[r for r, _, _, _ in shared.value.matches(part.column("text"))]] = False
                    yield part.filter(pa.array(clean))

        rows = mapped(rows, run, rows.schema)
    return rows.select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
