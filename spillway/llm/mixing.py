"""Operator 1, mixing sources to target weights by a low-discrepancy schedule.

Within its source every document has a random place (md5 of seed and doc_id), and
the source's tokens in that order are cut into blocks of BLOCK tokens; a document belongs
to the block in which it begins, so a long one leaves the next blocks empty and
token shares stay right. Slot i takes the golden-ratio point i * phi mod 1, mapped
through the cumulative weights to a source; the r-th slot of a source takes its block r.
Nothing is repeated. A source that is used up either ends the schedule (``exhausted="stop"``: the weights hold to the last slot)
or leaves it (``"leave"``: the others go on with their weights among themselves, in a round of its own, until every block is
used; the shares hold in each round). A round has some slots more than its scarcest source has blocks, as the
points are only nearly even; such slots stay empty.

Weights default to the root of each source's tokens (temperature 2), as whole numbers, so that
every engine computes the same schedule. Tokens are words between white space.

Running sums are taken in two levels (sums of a source's hash ranges, then within
a range), and likewise ranks of slots in chunks, so no task holds a whole
source, however large.

Defined cases. A null source is the source ""; a source without weight or
with weight 0 is left out, whatever ``exhausted``; a weighted source that has no document is ignored. A null
or empty text has no tokens and begins in the block that is open. A null doc_id
is placed like "". Repeated rows lie next to each other; in ``mixed`` rows of equal source
and doc_id share the place of the first. Empty tables give an empty result. Other
columns are passed through by ``mixed``, whatever their names (which replaces columns named slot, block or block_place), and
ignored by ``schedule``. doc_id may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, mapped, read, text_buffer, written

BLOCK = 2048
SEED = "mixing-1"
PHI = 2654435769  # 2**32 / golden ratio
RANGE = 3  # hex digits of the hash that name a range
FEW = 2_000_000  # places that are broadcast (128 MB)
SLOTS = 1 << 16  # slots of a chunk
LOCAL = 1 << 24  # slots that the driver counts itself
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 12, 13, 32]] = True


def tokens(column: pa.Array) -> np.ndarray:
    data, offsets = text_buffer(column)
    full = ~_SPACE[data]
    begin = full.copy()
    begin[1:] &= ~full[:-1]
    firsts = offsets[:-1][offsets[1:] > offsets[:-1]]
    begin[firsts] = full[firsts]
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(begin, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` (with text) with __tokens."""
    schema = docs.withColumn("__tokens", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=8 << 20):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tokens(part.column("text")))], [*part.schema.names, "__tokens"])

    return mapped(docs, run, schema)


def running(rows: DataFrame, key: str, part: str, order: list, amount, out: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over the rows of its key before it, in two levels."""
    sums = rows.groupBy(key, part).agg(F.sum(amount).alias("__sum"))
    before = sums.select(key, part, (F.sum("__sum").over(W.partitionBy(key).orderBy(part)) - F.col("__sum")).alias("__before"))
    inside = F.sum(amount).over(W.partitionBy(key, part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - amount
    return rows.withColumn(out, inside).join(before, [key, part]).withColumn(out, F.col(out) + F.col("__before")).drop("__before")


def placed(rows: DataFrame, block: int, seed: str) -> DataFrame:
    """``rows`` (doc_id, __source, __tokens) with __hash and __block."""
    rows = rows.withColumn("__hash", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = rows.withColumn("__range", F.substring("__hash", 1, RANGE))
    rows = running(rows, "__source", "__range", ["__hash", "__tokens"], F.col("__tokens"), "__start")
    return rows.withColumn("__block", F.floor(F.col("__start") / F.lit(block)).cast("long"))


def drawn(slot, sources: list[tuple[str, int, int]]):
    """The source of a slot of a round."""
    total = sum(w for _, w, _ in sources)
    point = (slot % F.lit(1 << 31)) * F.lit(PHI) % F.lit(1 << 32)
    name, cum = None, 0
    for s, w, _ in sources:
        cum += w
        bound = point < F.lit((cum << 32) // total)
        name = F.when(bound, F.lit(s)) if name is None else name.when(bound, F.lit(s))
    return name


def taken(spark: SparkSession, n: int, sources: list[tuple[str, int, int]]) -> dict[str, int]:
    """How many of the first n slots of a round each source has: by numpy while they are few, else by Spark, alike."""
    if n > LOCAL:
        return {r[0]: r[1] for r in spark.range(n).select(drawn(F.col("id"), sources).alias("s")).groupBy("s").count().collect()}
    total = sum(w for _, w, _ in sources)
    point = (np.arange(n, dtype=np.uint64) % np.uint64(1 << 31)) * np.uint64(PHI) % np.uint64(1 << 32)
    bounds = [(c << 32) // total for c in np.cumsum([w for _, w, _ in sources], dtype=object).tolist()]
    found = np.bincount(np.searchsorted(np.array(bounds, np.uint64), point, "right"), minlength=len(sources))
    return {s: int(c) for (s, _, _), c in zip(sources, found)}


def rounds(spark: SparkSession, sources: list[tuple[str, int, int]], exhausted: str) -> list[tuple[int, int, list[tuple[str, int, int]]]]:
    """(first slot, slots, sources) of each round; sources are (name, weight, first block)."""
    left = {s: b for s, w, b in sorted(sources) if w > 0 and b > 0}
    weight, first, base, out = {s: w for s, w, _ in sources}, dict.fromkeys(left, 0), 0, []
    while left:
        live = [(s, weight[s], first[s]) for s in sorted(left)]
        total = sum(w for _, w, _ in live)
        if exhausted == "stop":
            return [(0, min(left[s] * total // w for s, w, _ in live), live)]
        n = min(-(-(b + 3) * total // weight[s]) for s, b in left.items())
        out.append((base, n, live))
        base += n
        for s, c in taken(spark, n, live).items():
            first[s] += c
            left[s] -= c
            if left[s] <= 0:
                del left[s]
    return out


def slots(spark: SparkSession, sources: list[tuple[str, int, int]], exhausted: str = "stop") -> DataFrame:
    """(slot, __source, __block): sources are (name, weight, blocks)."""
    plan = rounds(spark, sources, exhausted)
    rows = spark.range(sum(n for _, n, _ in plan)).select(F.col("id").alias("slot"))
    name, turn, first = F.lit(""), F.lit(0), F.lit(0)
    for i, (base, _, live) in enumerate(plan):
        here = F.col("slot") >= F.lit(base)
        name, turn = F.when(here, drawn(F.col("slot") - F.lit(base), live)).otherwise(name), F.when(here, F.lit(i)).otherwise(turn)
        offset = F.lit(0)
        for s, _, f in live:
            if f:
                offset = F.when(F.col("__source") == s, F.lit(f)).otherwise(offset)
        first = F.when(here, offset).otherwise(first)
    rows = rows.select("slot", name.alias("__source"), turn.alias("__turn"), F.floor(F.col("slot") / F.lit(SLOTS)).alias("__chunk"))
    rows = running(rows.withColumn("__key", F.concat_ws("|", "__turn", "__source")), "__key", "__chunk", ["slot"], F.lit(1), "__block")
    return rows.select("slot", "__source", (F.col("__block") + first).cast("long").alias("__block"))


def totals(rows: DataFrame, block: int, weights: dict[str, float] | None) -> list[tuple[str, int, int]]:
    """(source, weight, blocks) of each source; a row for each source comes to the driver."""
    sums = rows.groupBy("__source").agg(F.sum("__tokens").alias("n")).collect()
    weight = (lambda s, n: int(np.floor(np.sqrt(float(n))))) if weights is None else (lambda s, n: int(round(weights.get(s, 0) * 1e6)))
    return [(r["__source"], weight(r["__source"], r["n"]), -(-r["n"] // block)) for r in sums]


def planned(docs: DataFrame, weights: dict[str, float] | None, block: int, seed: str, exhausted: str) -> DataFrame:
    """(slot, __source, __block, __start, doc_id, __tokens) of the scheduled rows; texts are read once and stay where they are."""
    rows = counted(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("__source"), "text")).drop("text")
    rows = written(rows, "token-counts")
    plan = slots(docs.sparkSession, totals(rows, block, weights), exhausted)
    return placed(rows, block, seed).join(plan, ["__source", "__block"])


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, seed: str = SEED, exhausted: str = "stop") -> DataFrame:
    """(slot, source, block, doc_id, n_tokens): the documents of each slot of the schedule."""
    rows = planned(docs, weights, block, seed, exhausted)
    return rows.select("slot", F.col("__source").alias("source"), F.col("__block").alias("block"), "doc_id", F.col("__tokens").alias("n_tokens"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, seed: str = SEED, exhausted: str = "stop") -> DataFrame:
    """The scheduled rows of ``docs`` with all their columns, and slot, block and block_place (tokens before it in its block).

    The places join the texts by source and doc_id: broadcast while they are FEW rows at most, else one shuffle."""
    rows = planned(docs, weights, block, seed, exhausted)
    first = F.min(F.struct("slot", F.col("__block").alias("block"), (F.col("__start") - F.col("__block") * block).alias("block_place"))).alias("__place")
    places = written(rows.groupBy("__source", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id")).agg(first), "places")
    if places.count() <= FEW:
        places = F.broadcast(places)
    kept = [c for c in docs.columns if c.lower() not in ("slot", "block", "block_place")]
    packed = docs.select(F.coalesce("source", F.lit("")).alias("__source"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"))
    full = packed.join(places, ["__source", "__id"])
    return full.select(*[F.col("__row")[c].alias(c) for c in kept], *[F.col("__place")[c].alias(c) for c in ("slot", "block", "block_place")])


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\f\\r]+'))::BIGINT AS n_tokens,
                  md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
p AS (SELECT *, (sum(n_tokens) OVER (PARTITION BY source ORDER BY h, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens)::BIGINT // {BLOCK} AS block FROM d),
s AS (SELECT source, floor(sqrt(sum(n_tokens)::DOUBLE))::BIGINT AS w, ((sum(n_tokens) + {BLOCK - 1})::BIGINT // {BLOCK})::BIGINT AS blocks FROM d GROUP BY source),
u AS (SELECT * FROM s WHERE w > 0 AND blocks > 0),
t AS (SELECT sum(w)::BIGINT AS total FROM u),
c AS (SELECT source, ((sum(w) OVER (ORDER BY source))::BIGINT * 4294967296) // total AS upper, ((sum(w) OVER (ORDER BY source) - w)::BIGINT * 4294967296) // total AS lower FROM u, t),
n AS (SELECT min(blocks * total // w)::BIGINT AS n FROM u, t),
i AS (SELECT unnest(range(0, n)) AS slot FROM n),
k AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS block FROM i JOIN c ON ((slot % 2147483648) * {PHI}) % 4294967296 >= lower AND ((slot % 2147483648) * {PHI}) % 4294967296 < upper)
SELECT k.slot, k.source, k.block, p.doc_id, p.n_tokens FROM k JOIN p ON k.source = p.source AND k.block = p.block
"""


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(read(spark, sf_dir, "documents"))
