"""Operator 7, token counts: two tiers of known pre-token lengths, both on the map side.

A byte-level BPE encodes each pre-token by itself, so a text's tokens are the sum of
its pre-tokens' lengths. A first pass finds pre-tokens that take a great share of some
chunk of the documents (they are few by construction: at most 1 / SHARE of a chunk)
and encodes them; they are broadcast as one string and a byte array of lengths,
which every Python worker turns into a hash table once. In the
second pass a document's pre-tokens are looked up there; what is missing is
encoded once and kept in the worker's cache, which is emptied when it holds CACHE entries. No
pre-token is ever shuffled but the candidates of the first tier.

The counts are exact and don't depend on what the tiers hold. The vocabulary is a
file of ranks in the tiktoken format; its path is a parameter and must be readable on every executor.

Defined cases. A null text has a null count, an empty one 0. Strings that name special
tokens are ordinary text. Very long pre-tokens are encoded once like others. Repeated rows give repeated
results. A null doc_id is passed through. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, read, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARE = 1e-4
CACHE = 400_000
LIMIT = 64 << 20  # bytes of pre-tokens in the first tier
_state: dict = {}


def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary's encoding, made once in a process."""
    if ("encoding", path) not in _state:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _state["encoding", path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _state["encoding", path]


def splitter():
    if "split" not in _state:
        _state["split"] = regex.compile(PATTERN).findall
    return _state["split"]


def tiers(names: str, lengths: bytes, key: str) -> tuple[dict[str, int], dict[str, int]]:
    """The first tier as a hash table and the cache of this process, both kept from task to task."""
    if _state.get("tier") != key:
        _state["first"], _state["cache"] = dict(zip(names.split("\0"), lengths)) if lengths else {}, {}
        _state["tier"] = key
    return _state["first"], _state["cache"]


def frequent(docs: DataFrame, path: str = VOCABULARY, share: float = SHARE) -> tuple[str, bytes]:
    """The first tier: frequent pre-tokens, joined by NUL, and their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, found = splitter(), Counter()
        for batch in batches:
            for part in chunks(batch):
                counts: Counter = Counter()
                for text in part.column("text").to_pylist():
                    if text:
                        counts.update(split(text))
                least = max(2, share * counts.total())
                found.update({t: n for t, n in counts.items() if n >= least and "\0" not in t})
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["token", "n"])

    rows = written(docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")), "frequent")
    size = rows.agg(F.sum(F.octet_length("token") + 2)).first()[0] or 0
    if size > LIMIT:  # keep the most frequent that fit; the others fall to the second tier
        rows = rows.orderBy(F.desc("n"), "token").limit(int(rows.count() * LIMIT / size))
    tokens = [r[0] for r in rows.select("token").orderBy("token").collect()]
    encode = encoding(path).encode_ordinary
    lengths = [len(encode(t)) for t in tokens]
    kept = [(t, n) for t, n in zip(tokens, lengths) if n < 256]
    return "\0".join(t for t, _ in kept), bytes(n for _, n in kept)


def counts(docs: DataFrame, path: str = VOCABULARY, share: float = SHARE) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((*frequent(docs, path, share), uuid.uuid4().hex))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, encode = splitter(), encoding(path).encode_ordinary
        known, cache = tiers(*shared.value)
        first = known.get
        for batch in batches:
            for part in chunks(batch):
                out: list[int | None] = []
                for text in part.column("text").to_pylist():
                    if text is None:
                        out.append(None)
                        continue
                    total = 0
                    missing = []
                    for t in split(text):
                        n = first(t) or cache.get(t)
                        if n is None:
                            missing.append(t)
                        else:
                            total += n
                    if missing:
                        if len(cache) + len(missing) > CACHE:
                            cache.clear()
                        for t, k in Counter(missing).items():
                            n = cache[t] = len(encode(t))
                            total += n * k
                    out.append(total)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(read(spark, sf_dir, "documents"))
