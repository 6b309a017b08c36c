"""Operator 5, LM scoring: a Katz backoff model of order 3 over words.

A text is the words w1 .. wn and an end, after a start that is only a history. r counts n-grams over all
documents. An n-gram of two or three words is in the model if it occurs CUT times at least (singletons
are left to the backoff, as Katz proposes), a word always. Then

    p(w | u v) = d3(r) r / c(u v)            if u v w is in the model, else alpha(u v) p(w | v)
    p(w | v)   = d2(r) r / c(v)              if v w is in the model,   else alpha(v) p(w)
    p(w)       = d1(r) r / tokens            if w was seen, else what the seen words leave

d is Katz's Good-Turing discount for r up to K; where its estimate doesn't exist (a count of counts is 0, or
the discount isn't in (0, 1)) and for greater r it is Good-Turing's with counts of counts on a fitted power law
(Gale and Sampson). So every history leaves mass, and alpha, what its seen words leave over what the lower
model leaves to the others, makes every history sum to 1 exactly. As texts have an end,
c(u v) and c(v) are the counts of u v and v themselves. A history that was never seen has alpha 1.

The model is a set of tables in the shared folder, one for each kind (counts of three, two and one
words, backoff weights of two and one), partitioned by key and sorted within.

Documents are held in units, whose tokens are written once as numbers of the unit's own words. To train, each
unit sends its different n-grams to the partitions of the keys (``exchange``), which add them up, write
the tables and tell one unit of each n-gram that it is responsible for it. That unit sends the
n-gram's share to the sums of its history. To score, a unit looks its n-grams up in the partitions, decides
level by level for each token, and asks for the weights of the histories that it backs off from.
No row is made for a token, a hot n-gram costs a unit one entry, and a task holds one unit or one partition of keys.

The registered query trains on all documents and scores all. A text's own singletons aren't in the
model, so most tokens of a text that occurs once are backed off.

Defined cases. A null or empty text has no tokens: log probability 0, perplexity null. Repeated rows count as
often as they occur and get equal results. doc_id is passed through, null or of any type. An empty table gives an
empty result. Other columns are ignored, whatever their names. The end counts in log_prob and perplexity, but not in n_tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, discard, mix, pair, read, words, written
from .exchange import SENT, addressed, answered, batch, gaps, pack, runs, ungap, unpack

K = 5
CUT = 2
UNIT = 750_000  # tokens of a unit
PART = 1_250_000  # tokens for each partition of keys
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x2545F4914F6CDD1D)
_SINGLE = np.uint64(0x9E3779B97F4A7C15)
ONE, TWO, THREE, OWN, STATS = 1, 2, 3, 0, 9
TABLE, WEIGHT = 10, 20  # kinds of the model's rows: TABLE + words of the n-gram, WEIGHT + words of the history
BIG = 127


@dataclass
class Discount:
    """d(r) for r = 1 .. K and the power law's exponent for what is greater."""

    few: np.ndarray
    exponent: float

    def __call__(self, r: np.ndarray) -> np.ndarray:
        r = np.asarray(r, dtype=np.float64)
        return np.where(r < len(self.few), self.few[np.minimum(r, len(self.few) - 1).astype(int)], (1 + 1 / np.maximum(r, 1)) ** (self.exponent + 1))


def discounts(n: list[int], k: int = K) -> Discount:
    """From the numbers n[r] of n-grams that occur r times, r up to k + 1."""
    r = np.array([i for i in range(1, k + 2) if n[i]], dtype=float)
    exponent = -2.0
    if len(r) > 1:
        exponent = float(np.clip(np.polyfit(np.log(r), np.log([n[int(i)] for i in r]), 1)[0], -4.0, -1.1))
    few = (1 + 1 / np.arange(1, k + 1)) ** (exponent + 1)
    if n[1] and n[k + 1]:
        common = (k + 1) * n[k + 1] / n[1]
        for i in range(1, k + 1):
            if n[i] and common != 1:
                x = ((i + 1) * n[i + 1] / (i * n[i]) - common) / (1 - common)
                if 0 < x < 1:
                    few[i - 1] = x
    return Discount(np.append(0.0, few), exponent)


# --- units


def units(docs: DataFrame, size: int = UNIT) -> DataFrame:
    """A written table (unit, n, ids, payload): the documents of each unit as numbers of the unit's own words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def flush(number: int, held: list[tuple]) -> pa.RecordBatch:
        word, length = (np.concatenate(x) for x in list(zip(*held))[:2])
        vocabulary, code, count = np.unique(word, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")  # frequent words have small numbers, whose bytes pack well
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        ids = pa.concat_arrays([h[2] for h in held])
        planes = rank[code].astype("<u4").view(np.uint8).reshape(-1, 4).T
        payload = zstandard.ZstdCompressor(level=1).compress(pack(vocabulary[order], *(np.ascontiguousarray(x) for x in planes), length.astype(np.uint32)))
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(word)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([payload], pa.binary())], ["unit", "n", "ids", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n, n_docs = TaskContext.get().partitionId() << 32, [], 0, 0
        for b in batches:
            for part in chunks(b):
                word, rows, _, _ = words(part.column("text"))
                if held and (n + len(word) > size or n_docs + part.num_rows > 1 << 16):
                    yield flush(number, held)
                    number, held, n, n_docs = number + 1, [], 0, 0
                held.append((word, np.bincount(rows, minlength=part.num_rows), part.column("doc_id")))
                n, n_docs = n + len(word), n_docs + part.num_rows
        if held:
            yield flush(number, held)

    return written(docs.select("doc_id", "text").mapInArrow(run, f"unit long, n long, ids array<{kind}>, payload binary"), "units")


class Events:
    """What is to be predicted in a unit: words and ends, in order.

    Keys of the n-grams by number of words, the places of those with a history of two, and each event's document."""

    def __init__(self, payload):
        vocabulary, *planes, length = unpack(zstandard.ZstdDecompressor().decompress(payload))
        word = vocabulary[np.stack(planes, 1).view("<u4").ravel()]
        self.length = length.astype(np.int64)
        some = self.length[self.length > 0]
        seq = np.empty(len(word) + 2 * len(some), np.uint64)
        begin = np.cumsum(some + 2) - some - 2
        inner = np.ones(len(seq), bool)
        inner[begin] = inner[begin + some + 1] = False
        seq[begin], seq[begin + some + 1], seq[inner] = START, END, word
        two = pair(seq[:-1], seq[1:]) if len(seq) else seq
        three = pair(two[:-1], seq[2:]) if len(seq) > 1 else seq[:0]
        event = np.ones(len(seq), bool)
        event[begin] = False
        at = np.flatnonzero(event)
        first = np.zeros(len(seq), bool)
        first[begin + 1] = True
        self.doc = np.repeat(np.flatnonzero(self.length), some + 1)
        self.deep = np.flatnonzero(~first[at])  # events whose history has two words
        sixteen = np.uint64(16)
        single = mix(seq ^ _SINGLE) >> sixteen
        single[begin] = single[begin + some + 1]  # the start occurs as often as the end, which is no history
        self.keys = {ONE: single[at], TWO: two[at - 1] >> sixteen, THREE: three[at[self.deep] - 2] >> sixteen}
        self.history = {ONE: single[at - 1], TWO: two[at[self.deep] - 2] >> sixteen}

    def distinct(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, first place, inverse) of the different n-grams by number of words."""
        return {n: np.unique(k, return_index=True, return_inverse=True) for n, k in self.keys.items()}


def coded(r: np.ndarray, mark: np.ndarray | None = None) -> bytes:
    """Counts in seven bits, the greater ones apart; the eighth bit marks responsibility."""
    code = np.minimum(r, BIG).astype(np.uint8)
    if mark is not None:
        code |= mark.astype(np.uint8) << 7
    return pack(code, r[r >= BIG].astype(np.uint32))


def decoded(blob) -> tuple[np.ndarray, np.ndarray]:
    code, big = unpack(blob)
    r = (code & 127).astype(np.int64)
    r[r == BIG] = big
    return r, code >= 128


def asked(tokens: DataFrame, parts: int, count: bool) -> DataFrame:
    """Each unit's different n-grams, with their counts where asked for, addressed to their partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for unit, payload in zip(b.column("unit").to_pylist(), b.column("payload")):
                for n, key in Events(payload.as_buffer()).keys.items():
                    key = np.sort(key)
                    first, c = runs(key)
                    c = c.astype(np.uint32)
                    rows = []
                    for row in addressed(unit, n, key[first], parts, (lambda i, j: (c[i:j],)) if count else (lambda i, j: ())):
                        rows.append(row)
                        if len(rows) == 64:
                            yield batch(rows)
                            rows = []
                    if rows:
                        yield batch(rows)

    return tokens.select("unit", "payload").mapInArrow(run, SENT)


def learned(table: pa.Table) -> list[tuple]:
    """Of one partition: the tables' rows, counts of counts, and the answers to the units."""
    kinds, units_, payloads = np.asarray(table.column("kind")), np.asarray(table.column("unit")), table.column("payload")
    part, out = int(table.column("part")[0].as_py()), []
    for n in (ONE, TWO, THREE):
        at = np.flatnonzero(kinds == n)
        if not len(at):
            continue
        got = [unpack(payloads[int(i)].as_buffer()) for i in at]
        sent = [ungap(g[0]) for g in got]
        keys, first, code = np.unique(np.concatenate(sent), return_index=True, return_inverse=True)
        r = np.bincount(code, np.concatenate([g[1] for g in got])).astype(np.int64)
        kept = r >= (1 if n == ONE else CUT)
        out.append((part, 0, TABLE + n, pack(gaps(keys[kept]), r[kept].astype(np.uint32))))
        out.append((part, n, STATS, np.append(np.bincount(np.minimum(r, K + 2), minlength=K + 3), r.sum()).astype(np.int64).tobytes()))
        mark = np.zeros(len(code), bool)
        mark[first] = True
        lo = 0
        for i, k in zip(at, sent):
            hi = lo + len(k)
            out.append((part, int(units_[i]), n, coded(r[code[lo:hi]], mark[lo:hi])))
            lo = hi
    return out


def lookup(keys: np.ndarray, table: list[np.ndarray] | None) -> np.ndarray:
    """The table's value of each key, 0 where it has none."""
    if table is None or not len(table[0]):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return np.where(table[0][at] == keys, table[1][at], 0)


def looked_up(table: pa.Table) -> list[tuple]:
    """The answers of one partition of the model's tables to the units."""
    kinds, units_, payloads = np.asarray(table.column("kind")), np.asarray(table.column("unit")), table.column("payload")
    part, tables, out = int(table.column("part")[0].as_py()), {}, []
    for i in np.flatnonzero(kinds > TABLE):
        keys, r = unpack(payloads[int(i)].as_buffer())
        tables[int(kinds[i]) - TABLE] = [ungap(keys), r.astype(np.int64)]
    for i in np.flatnonzero(kinds < TABLE):
        keys = ungap(unpack(payloads[int(i)].as_buffer())[0])
        out.append((part, int(units_[i]), int(kinds[i]), coded(lookup(keys, tables.get(int(kinds[i]))))))
    return out


# --- the model


@dataclass
class Model:
    counts: DataFrame  # (part, kind, payload): the tables of counts
    weights: DataFrame  # (part, kind, payload): the tables of backoff weights
    parts: int
    discount: dict[int, Discount]
    tokens: int
    unknown: float  # the probability of a word that wasn't seen
    answers: DataFrame  # what the partitions told the units that trained it


class Counts:
    """What a unit knows of its n-grams: counts by event, and by different n-gram."""

    def __init__(self, table: pa.Table):
        kinds, parts, payloads = np.asarray(table.column("kind")), np.asarray(table.column("part")), table.column("payload")
        self.events = Events(payloads[int(np.flatnonzero(kinds == OWN)[0])].as_buffer())
        self.distinct = self.events.distinct()
        self.r, self.mine, self.all = {}, {}, {}
        for n in (ONE, TWO, THREE):
            at = np.flatnonzero(kinds == n)
            got = [decoded(payloads[int(i)].as_buffer()) for i in at[np.argsort(parts[at])]]
            r, mine = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0, bool))
            self.all[n], self.mine[n] = r, mine
            self.r[n] = r[self.distinct[n][2]] if len(r) else r
        # counts of the histories: of one word for all events, of two for the deep ones
        ones = np.concatenate([[0], self.r[ONE][:-1]]) if len(self.r[ONE]) else self.r[ONE]
        first = np.ones(len(ones), bool)
        first[self.events.deep] = False
        if len(ones):
            last = np.flatnonzero(np.append(first[1:], True))
            ones[first] = self.r[ONE][last]  # the start counts as the end of its text
        self.c = {ONE: ones, TWO: self.r[TWO][self.events.deep - 1]}


def with_tokens(answers: DataFrame, tokens: DataFrame) -> DataFrame:
    own = tokens.select(F.lit(0).alias("part"), "unit", F.lit(OWN).alias("kind"), "payload")
    return answers.select("part", "unit", "kind", "payload").unionByName(own).groupBy("unit")


def train(tokens: DataFrame, part: int = PART) -> Model:
    """The model of the units of ``units``."""
    total = tokens.agg(F.sum("n")).first()[0] or 0
    parts = int(min(max(1, -(-total // part)), (1 << 31) - 1))
    found = written(answered(asked(tokens, parts, True), parts, learned), "katz-counts")
    counts, answers = found.where(F.col("kind") > TABLE), found.where(F.col("kind").between(ONE, THREE))
    answers.written_path = found.written_path
    n = {k: np.zeros(K + 4, np.int64) for k in (ONE, TWO, THREE)}
    for r in found.where(F.col("kind") == STATS).select("unit", "payload").collect():  # a few numbers a partition
        n[r[0]] += np.frombuffer(r[1], np.int64)
    d = {k: discounts(x[:-1].tolist()) for k, x in n.items()}
    events = int(n[ONE][-1])

    def mass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = [unpack(x.as_buffer())[1].astype(np.float64) for x in b.column("payload")]
            yield pa.RecordBatch.from_arrays([pa.array([float((d[ONE](x) * x).sum()) for x in r], pa.float64())], ["x"])

    seen = counts.where(F.col("kind") == TABLE + ONE).select("payload").mapInArrow(mass, "x double").agg(F.sum("x")).first()[0] or 0.0
    unknown = 1 - seen / events if events else 1.0

    def shares(table: pa.Table) -> pa.Table:
        """What the n-grams that a unit is responsible for add to their histories: their probability, and that of the lower model."""
        known, rows = Counts(table), []
        e = known.events
        for n_ in (TWO, THREE):
            _, first, _ = known.distinct[n_]
            r = known.all[n_]
            at = np.flatnonzero(known.mine[n_] & (r >= CUT)) if len(r) else np.zeros(0, np.int64)
            if not len(at):
                continue
            place = first[at]
            whole = place if n_ == TWO else e.deep[place]
            lower = known.r[n_ - 1][whole]
            p = d[n_](r[at]) * r[at] / known.c[n_ - 1][place]
            q = d[n_ - 1](lower) * lower / (known.c[ONE][whole] if n_ == THREE else events)
            history = e.history[n_ - 1][place]
            order = np.argsort(history, kind="stable")
            history, p, q = history[order], p[order], q[order]
            begin, _ = runs(history)
            p, q = np.add.reduceat(p, begin), np.add.reduceat(q, begin)
            rows += addressed(int(table.column("unit")[0].as_py()), n_ - 1, history[begin], parts, lambda i, j, p=p, q=q: (p[i:j], q[i:j]))
        return pa.Table.from_batches([batch(rows)])

    def weigh(table: pa.Table) -> list[tuple]:
        kinds, payloads = np.asarray(table.column("kind")), table.column("payload")
        part_, out = int(table.column("part")[0].as_py()), []
        for n_ in (ONE, TWO):
            got = [unpack(payloads[int(i)].as_buffer()) for i in np.flatnonzero(kinds == n_)]
            if got:
                keys, code = np.unique(np.concatenate([ungap(g[0]) for g in got]), return_inverse=True)
                p, q = (np.bincount(code, np.concatenate([g[i] for g in got])) for i in (1, 2))
                out.append((part_, 0, WEIGHT + n_, pack(gaps(keys), np.log1p(-p) - np.log1p(-q))))
        return out

    weights = written(answered(with_tokens(answers, tokens).applyInArrow(shares, SENT), parts, weigh), "katz-weights")
    return Model(counts, weights, parts, d, events, unknown, answers)


def score(tokens: DataFrame, model: Model, answers: DataFrame | None = None, spent: bool = False) -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) of every document of the units ``tokens``; ``answers`` are those of the model if
    these units trained it. ``spent`` deletes the units and the model's counts as soon as they aren't needed."""
    parts, d, unknown, events = model.parts, model.discount, model.unknown, model.tokens
    if answers is None:
        answers = written(answered(asked(tokens, parts, False).unionByName(model.counts), parts, looked_up), "katz-answers")

    def decide(table: pa.Table) -> pa.Table:
        """Each token's own part by the longest n-gram that is known, and the histories from which it backs off."""
        known, unit = Counts(table), int(table.column("unit")[0].as_py())
        e, r, c = known.events, known.r, known.c
        three = np.zeros(len(e.doc), np.int64)
        three[e.deep] = r[THREE]
        above = np.ones(len(e.doc), np.int64)
        above[e.deep] = c[TWO]
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.where(r[ONE] > 0, np.log(d[ONE](r[ONE]) * r[ONE] / max(events, 1)), np.log(unknown))
            own = np.where(r[TWO] >= CUT, np.log(d[TWO](r[TWO]) * r[TWO] / c[ONE]), own)
            own = np.where(three >= CUT, np.log(d[THREE](three) * three / above), own)
        rows = [(unit % parts, unit, OWN, pack(np.bincount(e.doc, own, len(e.length)), e.length))]
        from_two = np.flatnonzero((r[THREE] < CUT) & (c[TWO] >= CUT))
        from_one = np.flatnonzero((three < CUT) & (r[TWO] < CUT) & (c[ONE] >= CUT))
        for n, at, doc in ((TWO, from_two, e.doc[e.deep]), (ONE, from_one, e.doc)):
            history, doc = e.history[n][at], doc[at].astype(np.uint32)
            order = np.argsort(history, kind="stable")
            history, doc = history[order], doc[order]
            begin, count = runs(history)
            ends, count = np.append(begin, len(history)), count.astype(np.uint32)
            rows += addressed(unit, n, history[begin], parts, lambda i, j, doc=doc, ends=ends, count=count: (count[i:j], doc[ends[i] : ends[j]]))
        return pa.Table.from_batches([batch(rows)])

    def weigh(table: pa.Table) -> list[tuple]:
        """Sums of the weights that a unit's documents ask for."""
        kinds, units_, payloads = np.asarray(table.column("kind")), np.asarray(table.column("unit")), table.column("payload")
        tables, out = {}, []
        for i in np.flatnonzero(kinds > WEIGHT):
            keys, value = unpack(payloads[int(i)].as_buffer())
            tables[int(kinds[i]) - WEIGHT] = [ungap(keys), value]
        for i in np.flatnonzero(kinds < WEIGHT):
            if kinds[i] == OWN:
                out.append((0, int(units_[i]), OWN, payloads[int(i)].as_py()))
                continue
            keys, count, doc = unpack(payloads[int(i)].as_buffer())
            value = np.repeat(lookup(ungap(keys), tables.get(int(kinds[i]))), count.astype(np.int64))
            some, of = np.unique(doc, return_inverse=True)
            out.append((0, int(units_[i]), int(kinds[i]), pack(some.astype(np.uint32), np.bincount(of, value))))
        return out

    def finish(table: pa.Table) -> pa.Table:
        kinds, payloads = np.asarray(table.column("kind")), table.column("payload")
        total, length = unpack(payloads[int(np.flatnonzero(kinds == OWN)[0])].as_buffer())
        total = total.copy()
        parts_ = np.asarray(table.column("kind"))
        for i in np.flatnonzero(parts_ != OWN):
            doc, value = unpack(payloads[int(i)].as_buffer())
            total[doc] += value
        return pa.table({"unit": [table.column("unit")[0].as_py()], "n_tokens": pa.array([length.astype(np.int64)], pa.list_(pa.int64())), "log_prob": pa.array([total], pa.list_(pa.float64()))})

    ids = written(tokens.select("unit", "ids"), "katz-ids")
    asks = written(with_tokens(answers, tokens).applyInArrow(decide, SENT), "katz-asks")
    if spent:
        discard(tokens, answers)
    sums = answered(asks.unionByName(model.weights), parts, weigh)
    rows = sums.groupBy("unit").applyInArrow(finish, "unit long, n_tokens array<long>, log_prob array<double>")
    rows = rows.join(ids, "unit").select(F.explode(F.arrays_zip("ids", "n_tokens", "log_prob")).alias("x"))
    rows = rows.select(F.col("x.ids").alias("doc_id"), F.col("x.n_tokens").alias("n_tokens"), F.col("x.log_prob").alias("log_prob"))
    return rows.withColumn("perplexity", F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_prob") / (F.col("n_tokens") + 1))))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the model of all documents."""
    tokens = units(read(spark, sf_dir, "documents"))
    model = train(tokens)
    return score(tokens, model, model.answers, spent=True)
