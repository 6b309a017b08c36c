"""What the corpus operators share: vectorised tokenising and small Spark helpers.

Texts are handled as Arrow buffers: a chunk of rows is one byte array with row
offsets, and words are found and hashed with numpy over the whole chunk, so no
Python object is made for a word.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import BATCH, small_batches  # noqa: F401

CHUNK = 2 << 20  # bytes of text that are handled at once; a longer text is a chunk of its own
ROWS = 1 << 15  # rows of a chunk

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SIGN = ~_WORD
_SIGN[[9, 10, 11, 12, 13, 32]] = False
_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept and grown as needed."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            up, down = (np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]) for b in (_BASE, inverse))
            _powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all (splitmix64's finish)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of an ordered pair of hashes."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text and ROWS rows, or one row."""
    if not batch.num_rows:
        return
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    lo = 0
    while lo < len(size):
        before = size[lo - 1] if lo else 0
        hi = min(max(lo + 1, int(np.searchsorted(size, before + limit, "right"))), lo + ROWS)
        yield batch.slice(lo, hi - lo)
        lo = hi


def release() -> None:
    """Returns the memory that Arrow and the C library hold free to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(c := ctypes.CDLL(None), "malloc_trim"):  # glibc
        c.malloc_trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` that releases memory when its task ends."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` that needs little memory beside what ``run`` holds: a worker, which lives on from task to task beside its
    executor's heap, keeps none that is free, and batches have about BATCH bytes at most (``small_batches``).
    """
    small_batches(df)
    return df.mapInArrow(releasing(run), schema)


def words(column: pa.Array, lower: bool = True, signs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of each word of a string column, in order.

    A word is a longest run of ASCII letters, ASCII digits and non-ASCII
    characters; start and end are byte offsets into the column's buffer. ``signs``
    gives the longest runs of other characters but white space instead.
    """
    if lower:
        column = pc.utf8_lower(column)
    data, offsets = text_buffer(column)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    word = (_SIGN if signs else _WORD)[data]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before[filled] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    after[filled[1:] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * down[starts])
    rows = np.searchsorted(offsets, starts, "right") - 1
    return hashes, rows, starts, ends


def prefixes(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the first n bytes of every lower-case word that is longer."""
    column = pc.utf8_lower(column)
    data, _ = text_buffer(column)
    _, rows, starts, ends = words(column, lower=False)
    long = ends - starts > n
    rows, starts = rows[long], starts[long]
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        return mix((total[starts + n] - total[starts]) * down[starts] + np.uint64(n)), rows


def grams(hashes: np.ndarray, rows: np.ndarray, n: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of n words of a row. A row of fewer words is one shorter run."""
    if n == 1 or not len(hashes):
        return hashes, rows
    h = hashes
    for k in range(1, n):
        h = pair(h[:-1], hashes[k:]) if len(h) > 1 else h[:0]
    r = rows[: len(h)]
    h = h[inside] if len(h) and not (inside := r == rows[n - 1 :]).all() else h
    r = r if len(h) == len(r) else r[inside]
    size = np.bincount(rows, minlength=count)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        first = np.searchsorted(rows, short)
        tail = []
        for s, f in zip(short, first):
            x = hashes[f : f + 1]
            for k in range(1, size[s]):
                x = pair(x, hashes[f + k : f + k + 1])
            tail.append(x)
        h, r = np.concatenate([h, *tail]), np.concatenate([r, short])
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a string column in one array, and row offsets."""
    data, offsets = text_buffer(column)
    starts = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(starts, out=at[1:])
    return points, at[offsets]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    Where the session names none, a local session (as in tests) gets a folder under its warehouse; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.path.join(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"), "_shared")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """The same rows read from a table in the shared folder, which cuts the lineage.

    The shuffle files of the write are removed with its end, as the table replaces them.
    """
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` from which nothing will be read any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unit(seed: str, *columns) -> "F.Column":
    """A number in (0, 1) that depends on the columns and the seed alone; the same in DuckDB by md5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
