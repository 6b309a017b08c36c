"""What masks and the other Arrow functions of the operators send to Python: texts that need it, in small batches."""

import re

import pytest

from spillway.functions.arrow import BATCH
from spillway.operators import mask, parse
from spillway.plans.pipeline import apply

CARD = {"re": r"\b([0-9]{4})([0-9]{8})([0-9]{4})\b", "groups": [2]}
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def recorded(monkeypatch, module, name, path):
    """Writes the texts that a worker gives to a function of the module; a nested function, so that workers get it by value."""
    own, path = getattr(module, name), str(path)

    def record(s, *args):
        with open(path, "a") as out:
            out.write(s + "\n")
        return own(s, *args)

    monkeypatch.setattr(module, name, record)
    return lambda: sorted(set(open(path).read().splitlines()))


def bytes_of_a_batch(spark):
    return int(re.sub(r"\D", "", spark.conf.get(SETTING)))


@pytest.fixture
def default_batches(spark):
    spark.conf.unset(SETTING)
    yield
    spark.conf.unset(SETTING)


def test_masks_send_only_texts_that_match(spark, monkeypatch, tmp_path):
    sent = recorded(monkeypatch, mask, "mask_text", tmp_path / "sent")
    df = spark.createDataFrame([(1, "a 1234567812345678 b"), (2, "no card"), (3, None), (4, "")] + [(i, f"text {i}") for i in range(5, 50)], "n int, m string").coalesce(1)
    out = apply(df, {"type": "mask", "masks": [CARD], "process_fields": ["m"]}).collect()
    assert {r.n: r.m for r in out} == {1: "a 1234********5678 b", 2: "no card", 3: None, 4: ""} | {i: f"text {i}" for i in range(5, 50)}
    assert sent() == ["a 1234567812345678 b"]


def test_masks_send_only_arrays_that_match(spark, monkeypatch, tmp_path):
    sent = recorded(monkeypatch, mask, "mask_text", tmp_path / "sent")
    rows = [(1, ["x 1234567812345678", None, "y"]), (2, ["z", None]), (3, None), (4, []), (5, [None])]
    out = apply(spark.createDataFrame(rows, "n int, m array<string>"), {"type": "mask", "masks": [CARD], "process_fields": ["m"]}).collect()
    assert {r.n: r.m for r in out} == {1: ["x 1234********5678", None, "y"], 2: ["z", None], 3: None, 4: [], 5: [None]}
    assert sent() == ["x 1234567812345678", "y"]


def test_a_mask_that_leaves_nothing(spark):
    df = spark.createDataFrame([("12",), ("a1",), (None,)], "m string")
    out = apply(df, {"type": "mask", "masks": [{"re": "([0-9]+)", "groups": [1], "cut_values": True}]}).collect()
    assert [r.m for r in out] == ["", "a", None]


def test_escapes_send_only_texts_with_them(spark, monkeypatch, tmp_path):
    sent = recorded(monkeypatch, parse, "unescape", tmp_path / "sent")
    df = spark.createDataFrame([(r"\x41b", "c"), ("plain", r"\101"), (None, "d")], "t string, u string")
    out = apply(df, {"type": "convert_utf8_bytes", "fields": ["t", "u"]}).collect()
    assert [tuple(r) for r in out] == [("Ab", "c"), ("plain", "A"), (None, "d")]
    assert sent() == [r"\101", r"\x41b"]


@pytest.mark.parametrize("spec", [
    {"type": "mask", "masks": [CARD]},
    {"type": "mask", "masks": [{"re": "[0-9]"}], "process_fields": ["a"]},
    {"type": "hash", "fields": [{"field": "m", "format": "normalize"}], "result_field": "h"},
    {"type": "convert_utf8_bytes", "fields": ["m"]},
    {"type": "json_extract", "field": "m", "extract_fields": ["a"], "truncated": True},
])
def test_batches_are_small(spark, default_batches, spec):
    df = spark.createDataFrame([("1", ["1"])], "m string, a array<string>")
    apply(df, spec)
    assert bytes_of_a_batch(spark) == BATCH


def test_masks_in_the_jvm_leave_the_setting(spark, default_batches):
    before = bytes_of_a_batch(spark)
    apply(spark.createDataFrame([("1",)], "m string"), {"type": "mask", "masks": [{"re": "[0-9]", "replace_word": "N"}]})
    assert bytes_of_a_batch(spark) == before
