"""Python workers beside an executor's heap: small batches in, and nothing kept after a task."""

import os
import pickle
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from spillway.llm import common, decontaminate, exchange, importance, mixing

from .conftest import make, prose

HELD = """
import re, sys
import pyarrow as pa
from spillway.llm.common import releasing

def pss():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def run(batches):
    kept = []
    for b in batches:  # pieces too small to be mapped by themselves
        kept += [bytes(1000) + bytes([i % 256]) for i in range(100_000)]
        kept.append(pa.array(range(1_000_000)))
        yield b
    del kept

task = releasing(run) if sys.argv[1] == "releasing" else run
before = pss()
for b in task(iter([1])):
    pass
print(pss() - before)
"""


def held(how):
    env = {**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}
    return float(subprocess.run([sys.executable, "-c", HELD, how], env=env, capture_output=True, text=True, check=True).stdout)


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_a_task_keeps_no_free_memory():
    assert held("releasing") < 0.75 * held("plain")


@pytest.fixture
def big(spark):
    """A session with default batches, and one partition of 24 MB of text."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    text = prose(1, 2000)
    yield make(spark, [(i, f"{text} {i}") for i in range((24 << 20) // len(text))]).coalesce(1)
    spark.conf.unset(name)


def test_batches_are_small(spark, big):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "n"])

    sizes = common.mapped(big, run, "size long, n long").collect()
    assert sum(r.n for r in sizes) == big.count() and len(sizes) >= 3
    assert max(r.size for r in sizes) < 1.2 * common.BATCH


def test_stages_take_small_batches(spark, big):
    """A stage's rows are read after its function returned, so the setting must still hold. (The others run jobs; all call ``mapped``.)"""
    bench = spark.createDataFrame([(1, prose(5, 40))], "item_id bigint, text string")
    some = big.limit(20)
    for stage in (lambda: decontaminate.keep(some, bench), lambda: mixing.counted(some)):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage()
        assert int(re.sub(r"\D", "", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))) == common.BATCH


def test_a_smaller_setting_stays(spark, big):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000000")
    common.mapped(big, lambda batches: batches, big.schema)
    assert int(re.sub(r"\D", "", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))) == 1_000_000


def test_classifier_takes_little_of_the_driver(spark, monkeypatch):
    """Rows that reach the driver lie below half a region of its heap (1 MB), and the model is broadcast once, in 32 bits a count at most."""
    rows, sent, broadcast = [], [], spark.sparkContext.broadcast
    monkeypatch.setattr(importance, "unpack", lambda blob: rows.append(len(blob)) or exchange.unpack(blob))
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(len(pickle.dumps(x))) or broadcast(x))
    docs = make(spark, [(i, prose(i, 40)) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    assert importance.keep(docs, labels).count() > 0
    assert len(rows) == importance.SLICES and max(rows) < 1 << 19
    assert sum(sent) < 16 * (importance.BUCKETS + importance.LANGS) + (1 << 20)


def test_counts_of_any_width(spark):
    """Counts above 8, 16 and 32 bits weigh as floats of the same numbers do."""
    text, lang = pa.array(["ba ne !! lo", "ne ne su"]), pa.array(["en", "en"])
    found = importance.buckets(text, lang)
    for top in (200, 60_000, 1 << 31, 1 << 40):
        arrays = [np.full(n, top // d + 5) for n, d in zip(importance.SIZES, (2, 1, 2, 1, 4, 1, 4, 1))]
        small = importance.Counts(*[exchange.unpack(exchange.pack(importance.narrow(x)))[0] for x in arrays])
        own = np.array([True, False])
        want = importance.Counts(*[x.astype(float) for x in arrays]).weights(*found, own)
        assert (small.weights(*found, own) == want).all() and want.any()
