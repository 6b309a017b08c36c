"""Counting keys over all documents without a row for each occurrence.

A unit is some millions of n-grams of consecutive documents. It sends each of its different
keys once, with its number of occurrences, to the hash partition of the key, as one byte string for
each partition. A partition adds up what all units sent and answers each unit. So a key costs
some bytes of shuffle instead of a row, a hot key costs each unit one entry however often it occurs,
and no task holds more than a unit or a partition, whose sizes are parameters.

Keys are 48-bit hashes, sent as differences of sorted keys (four bytes each).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KEY_BITS = np.uint64(48)
KEY = np.uint64((1 << 48) - 1)
SENT = "part int, unit long, kind int, payload binary"
_KINDS = [np.dtype(x) for x in (np.uint8, np.uint16, np.uint32, np.uint64, np.int64, np.float32, np.float64)]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one byte string; unsigned 32-bit numbers take as few bytes as they can."""
    out, head = [], [len(arrays)]
    for x in arrays:
        if x.dtype == np.uint32:
            most = int(x.max()) if len(x) else 0
            x = x.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32)
        head += [_KINDS.index(x.dtype), x.nbytes]
        out.append(x.tobytes())
    return b"".join([np.array(head, np.int64).tobytes(), *out])


def unpack(blob) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 2 * n + 1)[1:]
    at, out = 8 * (2 * n + 1), []
    for kind, size in zip(head[::2], head[1::2]):
        kind = _KINDS[kind]
        out.append(np.frombuffer(blob, kind, int(size) // kind.itemsize, at))
        at += int(size)
    return out


_STEP = np.uint64((1 << 32) - 1)


def gaps(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as 32-bit differences, as the bytes of the numbers; the greatest number adds to the next. Few far keys are sent as they are."""
    d = np.diff(keys)
    more = d // _STEP
    if int(more.sum()) > len(keys) or not len(keys):
        return keys
    out = np.full(int(more.sum()) + len(d), _STEP, np.uint64)
    out[np.cumsum(more + np.uint64(1), dtype=np.int64) - 1] = d % _STEP
    first = keys[:1]
    return np.concatenate([first >> np.uint64(32), first & _STEP, out]).astype(np.uint32).view(np.uint8)


def ungap(x: np.ndarray) -> np.ndarray:
    if x.dtype == np.uint64:
        return x
    d = np.frombuffer(x.tobytes(), np.uint32).astype(np.uint64)
    if not len(d):
        return d
    first = (d[0] << np.uint64(32)) | d[1]
    return np.append(first, first + np.cumsum(d[2:], dtype=np.uint64)[d[2:] < _STEP])


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each key; ascending keys have ascending partitions."""
    return (((keys >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def runs(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and its length."""
    if not len(ascending):
        none = np.zeros(0, np.int64)
        return none, none
    first = np.flatnonzero(np.append(True, ascending[1:] != ascending[:-1]))
    return first, np.diff(np.append(first, len(ascending)))


def batch(rows: list[tuple]) -> pa.RecordBatch:
    part, unit, kind, payload = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(unit, pa.int64()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], ["part", "unit", "kind", "payload"])


def addressed(unit: int, kind: int, keys: np.ndarray, parts: int, columns: Callable[[int, int], tuple]) -> Iterator[tuple]:
    """The rows that take a unit's ascending keys to their partitions; ``columns`` gives the arrays that go with keys[a:b]."""
    cut = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
    for i in np.flatnonzero(cut[1:] > cut[:-1]):
        a, b = int(cut[i]), int(cut[i + 1])
        yield int(i), unit, kind, pack(gaps(keys[a:b]), *columns(a, b))


def answered(sent: DataFrame, parts: int, answer: Callable[[pa.Table], list[tuple]]) -> DataFrame:
    """What each partition answers to all that was sent to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held and sum(b.num_rows for b in held):
            rows = answer(pa.Table.from_batches(held))
            for lo in range(0, len(rows), 64):
                yield batch(rows[lo : lo + 64])

    return sent.repartitionById(parts, "part").mapInArrow(run, SENT)


def streamed(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from batches in which such rows lie together."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [np.asarray(b.column(k)) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        now = tuple(c[0] for c in columns)
        change[0] = last is not None and now != last
        last = tuple(c[-1] for c in columns)
        lo = 0
        for hi in [*np.flatnonzero(change).tolist(), b.num_rows]:
            if hi > lo or hi == 0:
                if hi > lo:
                    held.append(b.slice(lo, hi - lo))
                if hi < b.num_rows and held:
                    yield pa.Table.from_batches(held)
                    held = []
                lo = hi
    if held:
        yield pa.Table.from_batches(held)
