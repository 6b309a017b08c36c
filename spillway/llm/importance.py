"""Operator 8, quality classifier: importance resampling with hashed n-gram models.

Two bag-of-n-grams models, of the target's text (documents labelled of good quality and not toxic) and of the raw text (all
documents), count hashed n-grams in one pass: words, pairs of words and runs of other signs, each with its language, so
that a language's share of the labels decides nothing. A document's log importance weight is the sum, over its n-grams as often as
they occur, of the log ratio of the n-gram's probability in the target to that in the raw text:

    log (t + PRIOR s) / (r s + PRIOR s) * P(differs)

t and r are counts without the document itself (its own n-grams would speak for a labelled document and against
others), s the target's share of the language's n-grams. PRIOR raw occurrences are taken to have the target's share.
P(differs) is the posterior probability that the n-gram's document frequencies in target and raw text differ at all: from their binomial
likelihood ratio and a prior of INFORMATIVE n-grams among those of the order that occur. It is smooth and the same formula at every size.

The sample is the Gumbel top-k: the k greatest sums of log weight and standard Gumbel noise, the noise being a function
of the seed and doc_id. k may be given; by default it is the number of documents whose log weight
reaches the threshold that best parts the labelled rows that the target model hasn't seen, one of HELD (greatest
share of others dropped less COST times the share of target dropped).

The labels of at most MAX_LABELS documents (those of least hash of doc_id) fit the target model and the
threshold. Everything else covers all documents. What is broadcast has a fixed size (BUCKETS counts and LANGS languages, and the labels' ids);
it is broadcast once for all passes, and counts take as few bytes as they can.

Defined cases. A null or empty text has log weight 0, and so has a text in a language without target rows; a null language is the language "".
Without any labelled target row all documents are kept. Equal keys (repeated rows) are kept or dropped
together. A null doc_id counts as unlabelled and shares one noise. doc_id may be of any type. An empty table
gives an empty result. ``keep`` passes other columns through, whatever their names; ``score`` ignores them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, mapped, mix, pair, read, release, unit, words, written
from .exchange import SENT, batch, pack, unpack

BUCKETS = 1 << 20  # half for words and signs, half for pairs
LANGS = 1 << 12
SLICES = 64
PRIOR = 2.0
INFORMATIVE = 100.0
HELD = 3  # one of so many labelled documents fits the threshold, the others the target model
COST = 5.0  # what a target row that is dropped costs, in other rows that are
MAX_LABELS = 2_000_000
SEED = "importance-1"
NO_ID = -(1 << 62)
_langs: dict[str, int] = {}


def language(name: str | None) -> int:
    name = name or ""
    if name not in _langs:
        _langs[name] = int.from_bytes(hashlib.blake2b(name.encode("utf-8", "replace"), digest_size=8).digest(), "little")
    return _langs[name]


def buckets(text: pa.Array, lang: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the different hashed n-grams of each text, and each row's language slot."""
    names = np.array([language(x) for x in lang.to_pylist()], np.uint64)
    half = BUCKETS // 2
    shift = np.uint64(64 - half.bit_length() + 1)
    h, rows, _, _ = words(text)
    found = [((mix(h ^ names[rows]) >> shift).astype(np.int64), rows)]
    if len(h) > 1:
        inside = rows[1:] == rows[:-1]
        r = rows[1:][inside]
        found.append(((mix(pair(h[:-1], h[1:])[inside] ^ names[r]) >> shift).astype(np.int64) + half, r))
    h, rows, _, _ = words(text, lower=False, signs=True)
    found.append(((mix(pair(h, h) ^ names[rows]) >> shift).astype(np.int64), rows))
    b, r = (np.concatenate(x) for x in zip(*found))
    both, count = np.unique(r * BUCKETS + b, return_counts=True)
    return both // BUCKETS, both % BUCKETS, count, (names >> np.uint64(64 - LANGS.bit_length() + 1)).astype(np.int64)


def key(column: str):
    """A document's id as a number, for ids of any type."""
    return F.when(F.col(column).isNotNull(), F.xxhash64(F.col(column).cast("string")))


def targets(labels: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids of labelled documents, and whether each is target; an id with any bad label isn't."""
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    one = labels.where("doc_id is not null and quality is not null").select(key("doc_id").alias("id"), good.alias("good")).groupBy("id").agg(F.min("good").alias("good"))
    if one.count() > most:
        one = one.orderBy("id").limit(most)
    table = one.toArrow()
    ids, good = np.asarray(table.column("id"), dtype=np.int64), np.asarray(table.column("good")).astype(bool)
    order = np.argsort(ids)
    return ids[order], good[order]


def among(ids: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each id is among some ascending ones."""
    if not len(some):
        return np.zeros(len(ids), bool)
    return some[np.minimum(np.searchsorted(some, ids), len(some) - 1)] == ids


@dataclass
class Counts:
    """Of each bucket: occurrences in the target and in all text, documents that have it in both; likewise by language slot.

    Whole numbers of any type; only what is looked up is made floats."""

    target: np.ndarray
    raw: np.ndarray
    target_docs: np.ndarray
    raw_docs: np.ndarray
    lang_target: np.ndarray
    lang_raw: np.ndarray
    lang_target_docs: np.ndarray
    lang_raw_docs: np.ndarray

    def weights(self, rows: np.ndarray, of: np.ndarray, count: np.ndarray, lang: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Log weights of documents by their n-grams; ``own`` marks documents of the target."""
        n, half = len(lang), BUCKETS // 2
        with np.errstate(divide="ignore", invalid="ignore"):
            share = (self.lang_target.astype(float) / self.lang_raw)[lang][rows]
            docs = (self.lang_target_docs.astype(float) / self.lang_raw_docs)[lang][rows]
        known = share > 0
        rows, of, count, share, docs = rows[known], of[known], count[known], share[known], docs[known]
        mine = own[rows]
        ratio = np.log((self.target[of].astype(float) - count * mine + PRIOR * share) / ((self.raw[of].astype(float) - count) * share + PRIOR * share))
        inside, all_ = self.target_docs[of].astype(float) - mine, self.raw_docs[of].astype(float) - 1
        gain = likelihood(inside, all_, np.clip(docs, 1e-9, 1 - 1e-9))
        odds = np.array([np.log(max((self.raw_docs[:half] > 0).sum() / INFORMATIVE, 1.0)), np.log(max((self.raw_docs[half:] > 0).sum() / INFORMATIVE, 1.0))])
        p = 1 / (1 + np.exp(np.minimum(odds[(of >= half).astype(int)] - gain, 700)))
        return np.bincount(rows, count * ratio * p, n).round(9) + 0.0


def likelihood(a: np.ndarray, m: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of a out of m documents in the target, of their own share against the share s."""
    b = m - a
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(a > 0, a * np.log(a / (m * s)), 0.0) + np.where(b > 0, b * np.log(b / (m * (1 - s))), 0.0)


SIZES = [BUCKETS] * 4 + [LANGS] * 4


def narrow(x: np.ndarray) -> np.ndarray:
    """The same counts in 32 bits if they fit, which ``pack`` makes fewer still."""
    return x.astype(np.uint32) if not len(x) or x.max() < 1 << 32 else x


def count(docs: DataFrame, good: Broadcast) -> Counts:
    """The counts of all documents, added up by slices of the buckets; a task sends a few megabytes, whatever it read.

    A slice's row has at most some 260 KB while counts fit 32 bits, so none takes a region of the driver's heap by itself."""
    cuts = [np.linspace(0, n, SLICES + 1).astype(int) for n in SIZES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(n, np.int64) for n in SIZES]
        for b in batches:
            for part in chunks(b):
                rows, of, n, lang = buckets(part.column("text"), part.column("lang"))
                mine = among(np.asarray(part.column("id").fill_null(NO_ID), dtype=np.int64), good.value)
                size = np.bincount(rows, n, len(lang)).astype(np.int64)
                at = mine[rows]
                for i, (where, amount, most) in enumerate(((of[at], n[at], BUCKETS), (of, n, BUCKETS), (of[at], None, BUCKETS), (of, None, BUCKETS), (lang[mine], size[mine], LANGS), (lang, size, LANGS), (lang[mine], None, LANGS), (lang, None, LANGS))):
                    sums[i] += np.bincount(where, amount, most).astype(np.int64)
        if sums[7].any():
            for i in range(SLICES):
                parts = [x[c[i] : c[i + 1]] for x, c in zip(sums, cuts)]
                yield batch([(i, 0, 0, pack(*map(narrow, parts)))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, which = None, 0
        for b in batches:
            for which, payload in zip(b.column("part").to_pylist(), b.column("payload")):
                got = [x.astype(np.int64) for x in unpack(payload.as_buffer())]
                sums = got if sums is None else [x + y for x, y in zip(sums, got)]
        if sums is not None:
            yield batch([(which, 0, 0, pack(*map(narrow, sums)))])

    some = docs.select(key("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    rows = mapped(mapped(some, run, SENT).repartitionById(SLICES, "part"), add, SENT).select("part", "payload").collect()  # SLICES rows of a fixed size
    got = {r["part"]: unpack(r["payload"]) for r in rows}
    return Counts(*(np.concatenate([got[i][k] if i in got else np.zeros(c[i + 1] - c[i], np.uint8) for i in range(SLICES)]) for k, c in enumerate(cuts)))


def weighed(docs: DataFrame, counts: Broadcast, good: Broadcast) -> DataFrame:
    """``docs`` (doc_id, lang, text and others) with __weight, the log importance weight."""
    docs = docs.withColumn("__key", key("doc_id"))
    schema = docs.withColumn("__weight", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in chunks(b):
                own = among(np.asarray(part.column("__key").fill_null(NO_ID), dtype=np.int64), good.value)
                total = counts.value.weights(*buckets(part.column("text"), part.column("lang")), own)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(total)], schema.names)

    return mapped(docs, run, schema)


def noise(seed: str = SEED):
    return -F.log(-F.log(unit(seed, F.col("doc_id"))))


def best_threshold(weight: np.ndarray, good: np.ndarray) -> float:
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(-weight, kind="stable")
    w, g = weight[order], good[order]
    last = np.append(w[1:] != w[:-1], True)
    gain = (COST * (np.cumsum(g) / g.sum() - 1) + 1 - np.cumsum(~g) / (~g).sum())[last]
    return float(w[last][np.argmax(gain)]) if gain.max() > 0 else -np.inf


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a column of doubles, by counting ever finer bins; no sort."""
    row = df.agg(F.min(column), F.max(column), F.count(column)).first()
    low, high, n = row
    if not n or k >= n:
        return -np.inf
    if k <= 0:
        return np.inf
    left, inside = k, df.where(F.col(column).isNotNull())
    while True:
        step = (high - low) / bins
        if step <= 0 or low + step == low:
            return low
        some = inside.where(F.col(column).between(low, high))
        of = F.least(F.floor((F.col(column) - low) / step), F.lit(bins - 1))
        counts = {r[0]: r for r in some.groupBy(of.alias("b")).agg(F.count("*"), F.min(column), F.max(column)).collect()}  # bins rows at most
        for b in sorted(counts, reverse=True):
            _, c, least, most = counts[b]
            if left <= c:
                low, high = least, most
                break
            left -= c
        if low == high or left == c == 1:
            return low


def fit(docs: DataFrame, labels: DataFrame, k: int | None, most: int, seed: str) -> tuple[DataFrame, tuple[Broadcast, Broadcast], float]:
    """(doc_id, weight, key) of all documents, the model, and the least key that is kept."""
    ids, good = targets(labels, most)
    held = mix(ids.view(np.uint64)) % np.uint64(HELD) == 0
    context = docs.sparkSession.sparkContext
    target = context.broadcast(ids[good & ~held])
    model = context.broadcast(count(docs, target)), target
    release()
    rows = weighed(docs.select("doc_id", "lang", "text"), *model).select("doc_id", F.col("__key").alias("id"), F.col("__weight").alias("weight"))
    rows = written(rows.withColumn("key", F.col("weight") + noise(seed)), "weights")
    if k is None:
        known = context.broadcast((ids[held], good[held]))

        def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, want = known.value
                doc = np.asarray(b.column("id").fill_null(NO_ID), dtype=np.int64)
                if len(at):
                    hit = among(doc, at)
                    yield pa.RecordBatch.from_arrays([b.column("weight").filter(pa.array(hit)), pa.array(want[np.searchsorted(at, doc[hit])])], ["weight", "good"])

        sample = mapped(rows.select("id", "weight"), labelled, "weight double, good boolean").toArrow()
        limit = best_threshold(np.asarray(sample.column("weight"), dtype=float), np.asarray(sample.column("good")).astype(bool)) if sample.num_rows else -np.inf
        k = rows.where(F.col("weight") >= F.lit(limit)).count()
    return rows, model, kth_largest(rows, "key", k)


def score(docs: DataFrame, labels: DataFrame, k: int | None = None, most: int = MAX_LABELS, seed: str = SEED) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, keep) for every row of ``docs`` (doc_id, lang, text)."""
    rows, _, least = fit(docs, labels, k, most, seed)
    return rows.select("doc_id", F.col("weight").alias("log_weight"), F.col("key").alias("gumbel_key"), (F.col("key") >= F.lit(float(least))).alias("keep"))


def keep(docs: DataFrame, labels: DataFrame, k: int | None = None, most: int = MAX_LABELS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` that the sample takes, with all their columns."""
    _, model, least = fit(docs, labels, k, most, seed)
    packed = docs.select("doc_id", "lang", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    rows = weighed(packed, *model).where(F.col("__weight") + noise(seed) >= F.lit(float(least)))
    return rows.select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
