from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from matchloom.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def targets(size: dict, weights=(1, 2, 3), most=3) -> dict:
    """Shares of all sizes by weight; what stops at its limit is shared out again, in exact steps."""
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, stopped, left, free = {}, set(), sum(size.values()), set(names)
    while True:
        level = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if w[s] * level >= most * size[s]}
        if not over:
            return out | {s: w[s] * level for s in free}
        for s in over:
            out[s] = most * size[s]
            left -= out[s]
        free -= over


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_sizes(spark):
    docs = [(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(300)] + [(1000, "a", "tiny"), (1001, None, None), (1002, "b c", None), (1003, "", "empty"), (1004, "x y z", "é")]
    rows = mixing.mix_report(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(rows) == len(docs)
    size: dict = {}
    for _, t, s in docs:
        size[s] = size.get(s, 0) + words(t)
    want = targets(size)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == size[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    for s in ("s0", "s1", "s2"):
        taken = sum(r["taken"] for r in rows if r["source"] == s)
        assert abs(taken - want[s]) <= 7 + 0.02 * want[s]
    assert {r["doc_id"]: r["size"] for r in rows}[1004] == 2


def test_copies_follow_the_integer_boundaries(spark):
    docs = [(i, "w", "a") for i in range(50)] + [(100 + i, "w", "b") for i in range(10)]
    rows = mixing.mix_report(spark.createDataFrame(docs, SCHEMA)).collect()
    a = [r["copies"] for r in rows if r["source"] == "a"]
    b = [r["copies"] for r in rows if r["source"] == "b"]
    assert set(b) == {3}  # two thirds of 60 are over three times 10
    assert set(a) <= {0, 1} and abs(sum(a) - 30) <= 1


def test_reruns_agree_whatever_the_partitions(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 5), f"s{i % 4}") for i in range(400)], SCHEMA)
    get = lambda d: sorted(mixing.mix_report(d).select("doc_id", "taken").collect())
    assert get(docs) == get(docs.repartition(7))


def test_mix_emits_copies_with_all_columns(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), f"s{i % 4}") for i in range(100)], SCHEMA)
    clash = docs.withColumn("_size", F.lit(1)).withColumn("copies", F.lit("x")).withColumn("rank", F.lit(2))
    out = mixing.mix(clash)
    assert out.columns == clash.columns
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_report(docs).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == want


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "s")] * 30, SCHEMA)
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == 30 and all(r["copies"] == 1 for r in rows)
    assert mixing.mix_report(docs.limit(0)).isEmpty() and mixing.mix(docs.limit(0)).isEmpty()
    assert mixing.mix_report(spark.createDataFrame([(1, None, None)], SCHEMA)).first()["taken"] == 0


def test_other_weights(spark):
    docs = spark.createDataFrame([(i, "w", f"s{i % 2}") for i in range(200)], SCHEMA)
    rows = mixing.mix_report(docs, weights=(1, 3), max_repeat=2).collect()
    taken = {s: sum(r["taken"] for r in rows if r["source"] == s) for s in ("s0", "s1")}
    assert math.isclose(taken["s0"], 50, abs_tol=1) and math.isclose(taken["s1"], 150, abs_tol=1)
