from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import vecdup

SCHEMA = "vec_id long, embedding array<float>"


def unit(rng, n, size=64):
    x = rng.standard_normal((n, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def at(rng, cosine, base):
    r = rng.standard_normal(len(base))
    r -= r @ base * base
    return cosine * base + np.sqrt(1 - cosine * cosine) * r / np.linalg.norm(r)


def brute(ids, x):
    """Links and least ids reachable, by all cosines in double precision."""
    x = x.astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    part = dict.fromkeys(range(len(ids)))
    for s in np.argsort(ids):
        todo = [s] if part[s] is None else []
        while todo:
            k = todo.pop()
            if part[k] is None:
                part[k] = int(ids[s])
                todo += np.flatnonzero(near[k]).tolist()
    return near, part


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], SCHEMA).repartition(4)


@pytest.mark.parametrize("sizes", [{}, {"CHUNK": 60, "GROUP": 40}, {"LOCAL": 32, "NARROW": 16, "BLOCK": 16}])
def test_links_equal_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes.items():  # hot buckets go by pairs of chunks, large ones by further bits
        monkeypatch.setattr(vecdup, name, value)
    vecdup.plan.cache_clear()
    rng = np.random.default_rng(1)
    base = unit(rng, 400)
    near = np.array([at(rng, c, base[i]) for i, c in enumerate(rng.uniform(0.94, 0.97, 300))])
    group = np.array([at(rng, c, base[7]) for c in rng.uniform(0.985, 0.999, 300)])
    x = np.concatenate([base, near, group, base[:50], base[:9], 2 * base[20:40]]).astype(np.float32)
    ids = rng.permutation(len(x))
    links, part = brute(ids, x)
    got = {r["vec_id"]: r for r in vecdup.near_duplicates(frame(spark, ids, x)).collect()}
    n, want = np.array([got[i]["n_links"] for i in ids.tolist()]), links.sum(axis=1)
    assert len(got) == len(x) and (n <= want).all() and n.sum() >= 0.9995 * want.sum()
    assert np.mean([got[i]["component_id"] == part[k] for k, i in enumerate(ids.tolist())]) > 0.995
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    base = unit(rng, 1500)
    x = np.concatenate([base, [at(rng, 0.9502, b) for b in base]]).astype(np.float32)
    got = {r["vec_id"]: r["n_links"] for r in vecdup.near_duplicates(frame(spark, range(len(x)), x)).collect()}
    assert sum(got.values()) >= 0.998 * 3000


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    base = unit(rng, 400)
    _, turned, signs, f = vecdup.encode(np.concatenate([base, [at(rng, 0.9, b) for b in base]]))
    estimate = ((2.0 * signs[:400] - 1) * turned[400:]).sum(axis=1) / (np.sqrt(vecdup.BITS) * f[:400])
    spread = np.sqrt((1 - f[:400] ** 2) / f[:400] ** 2 / (vecdup.BITS - 1))
    assert abs(estimate.mean() - 0.9) < 0.01 and (np.abs(estimate - 0.9) <= vecdup.CONFIDENCE * spread).all()
    assert np.allclose(vecdup.rotation(64).T @ vecdup.rotation(64), np.eye(64))


def test_the_plan_holds_its_miss_at_any_size():
    for n in (10, 80_000, 10**7, 10**9):
        bits, limit = vecdup.plan(n, 64)
        assert bits.shape[0] < 60 and n / 2 ** bits.shape[1] <= vecdup.BUCKET and 40 < limit < 60
    # pairs right at the threshold, drawn as codes: how many meet in no table within the limit
    rng = np.random.default_rng(6)
    bits, limit = vecdup.plan(80_000, 64)
    differ = rng.random((200_000, 256)) < np.arccos(0.95) / np.pi
    met = np.any([~differ[:, b].any(axis=1) for b in bits], axis=0) & (differ.sum(axis=1) <= limit)
    assert (~met).mean() < 3 * vecdup.MISS


def test_a_dense_bucket_is_tied_without_all_pairs(monkeypatch):
    rng = np.random.default_rng(7)
    x = np.array([at(rng, 0.999, v) for v in np.repeat(unit(rng, 1), 8000, axis=0)])
    bits, limit = vecdup.plan(len(x), 64)
    code = vecdup.packed(vecdup.encode(x)[2])
    groups, calls = vecdup.Groups(code, np.zeros((len(x), len(bits)), np.int64), 0, limit, None), []
    plain = vecdup.Groups._tie
    monkeypatch.setattr(vecdup.Groups, "_tie", lambda self, a, b: (calls.append(1), plain(self, a, b)))
    assert (groups.search(64, bits[0]) == 0).all() and len(calls) <= 2 * (len(x) // vecdup.BLOCK + 1)


def test_names_that_clash_are_drawn_again(spark, monkeypatch):
    named = vecdup._named
    monkeypatch.setattr(vecdup, "_named", lambda rows, seed: named(rows, seed).withColumn("v", F.col("v") % 2) if seed == vecdup.SEED else named(rows, seed))
    docs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(-3, 3)], SCHEMA)
    # -3 and -2 are 8 degrees apart, -2 and -1 18.4: the threshold is at 18.2
    assert {r["vec_id"]: r["n_links"] for r in vecdup.near_duplicates(docs).collect()} == {-3: 1, -2: 1, -1: 0, 0: 0, 1: 0, 2: 0}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 3, [nan, 1.0, 1.0], [None, 1.0, 1.0], [inf, 1.0, 1.0], [1.0, 2.0], [1.0, 2.0], [2.0, 4.0], [1.0, 2.0, 0.0], [-0.0, 1.0], [0.0, 1.0], [1e-30, 2e-30]]
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(odd)] + [(6, [1.0, 2.0])], SCHEMA).withColumn("n_links", F.lit("clash")).withColumn("_e", F.lit(1))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vecdup.near_duplicates(docs).collect())
    alone = [(i, 0, i, True) for i in range(6)]
    tied = [(6, 4, 6, True), (6, 4, 6, True), (7, 4, 6, False), (8, 4, 6, False), (12, 4, 6, False)]
    assert got == sorted([*alone, *tied, (9, 0, 9, True), (10, 1, 10, True), (11, 1, 10, False)])
    assert vecdup.near_duplicates(docs.limit(0)).isEmpty()


def test_doubles(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.96, 0.28]), (3, [0.9, 0.4359])], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["n_links"] for r in vecdup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
