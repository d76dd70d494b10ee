from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from matchloom.functions.text import edit_similarity
from matchloom.model import ROOT
from matchloom.operators import corpora as co
from matchloom.operators import graph as gr
from matchloom.operators import repair as rp
from matchloom.operators.near import near_labels
from matchloom.operators.scorers import edit_scorer
from matchloom.plans import queries


def labels(spark, classes):
    return spark.createDataFrame([("S", iri, x) for iri, texts in classes.items() for x in texts], "onto string, iri string, label string")


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "child string, parent string")


def pairs(df):
    return {(r["a"], r["b"]) for r in df.collect()}


CLASSES = {f"c{i}": [f"l{i}", f"m{i}", "shared"] for i in range(12)}


def test_synonyms_and_identity(spark):
    rows = labels(spark, {"a": ["x", "y"], "b": ["y", "z"]})
    assert pairs(co.synonyms(rows)) == {("x", "y"), ("y", "x"), ("y", "z"), ("z", "y")}
    assert pairs(co.identity_synonyms(rows)) == {("x", "x"), ("y", "y"), ("z", "z")}  # none is lost


def test_soft_negatives_are_checked_and_symmetric(spark):
    rows = labels(spark, CLASSES)
    known = co.synonyms(rows)
    soft = pairs(co.soft_nonsynonyms(rows, known, 5))
    assert soft and soft == {(b, a) for a, b in soft} and not soft & pairs(known) and all(a != b for a, b in soft)
    assert soft == pairs(co.soft_nonsynonyms(rows, known, 5))
    assert pairs(co.soft_nonsynonyms(labels(spark, {"a": ["x"]}), known, 5)) == set()


def test_soft_draws_never_hit_the_own_class(spark):
    rows = labels(spark, {k: v[:1] for k, v in CLASSES.items()})
    drawn = co.soft_draws(rows, 10)
    assert drawn.count() == 120 and drawn.where("a = b").isEmpty()


def test_hard_negatives(spark):
    rows = labels(spark, {"a": ["x"], "b": ["y"], "c": ["x"], "d": ["w"]})
    e = edges(spark, ("a", "p"), ("b", "p"), ("c", "p"), ("d", "q"), ("p", "q"))
    assert pairs(co.hard_nonsynonyms(rows, e, co.synonyms(rows))) == {("x", "y"), ("y", "x")}
    depth = gr.depth(e)
    assert pairs(co.hard_nonsynonyms(rows, e, co.synonyms(rows), depth, 0)) == set()  # q only


def test_merge_checks_both_sides(spark):
    make = lambda *r: spark.createDataFrame(list(r), "a string, b string, kind string")
    one, two = make(("x", "y", "soft"), ("q", "r", "soft")), make(("y", "x", "synonym"), ("r", "q", "soft"))
    assert pairs(co.merge(one, two).where("kind = 'soft'")) == {("q", "r"), ("r", "q")}
    assert ("x", "y") in pairs(co.merge(one, two, strict=False).where("kind = 'soft'"))


def test_split_sizes(spark):
    rows = spark.range(101).withColumnRenamed("id", "k")
    n = {r["split"]: r["count"] for r in co.split(rows, ["k"], {"train": 0.2, "val": 0.1, "test": 0.7}).groupBy("split").count().collect()}
    assert n == {"train": 20, "val": 10, "test": 71}
    with pytest.raises(ValueError):
        co.split(rows, ["k"], {"a": 0.5, "b": 0.4})


def test_take(spark):
    p = spark.createDataFrame([(str(i), "x") for i in range(9)], "a string, b string")
    assert co.take(p, 4).count() == 4
    with pytest.raises(ValueError):
        co.take(p, 10)


def test_take_all_where_there_are_fewer(spark):
    p = spark.createDataFrame([(str(i), "x") for i in range(9)], "a string, b string")
    assert pairs(co.take(p, 10, fewer=True)) == pairs(p) and pairs(co.take(p, 4, fewer=True)) == pairs(co.take(p, 4))


def test_label_data_and_conflicts(spark):
    known = [(a, b, "synonym") for i in range(5) for a, b in itertools.permutations((f"a{i}", f"b{i}"))]
    bad = [(f"a{i}", f"a{j}", kind) for i in range(5) for j in range(5) if i != j for kind in ("soft", "hard")]
    corpus = spark.createDataFrame(known + bad, "a string, b string, kind string")
    ids = spark.createDataFrame([("a1", "a1"), ("b1", "b1")], "a string, b string")
    rows = co.intra_label_data(corpus, ids, 1, 1, 0.2)
    assert rows.where("label = 1 and split in ('train', 'val')").count() == 10
    assert rows.where("label = 1 and split in ('train_ids', 'val_ids')").count() == 2
    us = co.unsupervised(corpus, ids, corpus, 1, 1, 1)
    assert {r["split"] for r in us.select("split").distinct().collect()} == {"train", "train+", "val", "val+", "test"}
    twice = spark.createDataFrame([("t", "a", "b", 1), ("t", "a", "b", 0)], "split string, sent1 string, sent2 string, label int")
    assert co.conflicts(twice).count() == 1


DAG = (("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("a", ROOT), ("d", "d"))


def test_depth_and_ancestors(spark):
    e = edges(spark, *DAG)
    get = lambda s: {r["iri"]: r["depth"] for r in gr.depth(e, s).collect()}
    assert get("max") == {"a": 0, "b": 1, "c": 2, "d": 3} and get("min") == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {(r["iri"], r["ancestor"]) for r in gr.ancestors(e).collect()} == {("b", "a"), ("c", "a"), ("c", "b"), ("d", "a"), ("d", "b"), ("d", "c")}


def test_cycles_end(spark):
    e = edges(spark, ("b", "a"), ("c", "b"), ("b", "c"))
    assert {r["iri"]: r["depth"] for r in gr.depth(e, "min").collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(ValueError, match="cycle"):
        gr.depth(e, "max")
    assert gr.ancestors(e).count() == 6  # b and c are above themselves


def test_long_chains_come_to_their_end(spark):
    chain = edges(spark, *((f"c{i + 1:03}", f"c{i:03}") for i in range(110)))
    assert gr.max_depth(chain).first()["depth"] == 110 and gr.ancestors(chain).count() == 110 * 111 // 2


def test_extension(spark):
    s, t = edges(spark, ("s2", "s1"), ("s3", "s2"), ("s4", "s3")), edges(spark, ("t2", "t1"), ("t3", "t2"), ("t4", "t3"))
    ls = spark.createDataFrame([("S", f"s{i}", x) for i, x in enumerate(("one", "two", "three", "x"), 1)], "onto string, iri string, label string")
    lt = spark.createDataFrame([("T", f"t{i}", x) for i, x in enumerate(("one", "two", "three", "yyyy"), 1)], "onto string, iri string, label string")
    seed = spark.createDataFrame([("s1", "t1", 1.0), ("s9", "t9", 0.1)], "src string, tgt string, score double")
    got = {(r["src"], r["tgt"], r["hop"]) for r in gr.extend(seed, s, t, ls, lt, edit_scorer).collect()}
    assert got == {("s2", "t2", 1), ("s3", "t3", 2)}
    assert gr.extend(seed, s, t, ls, lt, edit_scorer, max_iter=1).count() == 1
    all_ = seed.unionByName(gr.extend(seed, s, t, ls, lt, edit_scorer).select("src", "tgt", "score"))
    assert gr.extend(all_, s, t, ls, lt, edit_scorer).isEmpty()  # nothing is left to add
    assert gr.extend(seed.where("score > 2"), s, t, ls, lt, edit_scorer).isEmpty()


def test_repair(spark):
    s = edges(spark, ("s2", "s1"), ("s3", "s1"))
    t = edges(spark, ("t1", "r"), ("t2", "r"), ("t3", "t1"))
    maps = spark.createDataFrame([("s1", "t1", 0.9), ("s2", "t2", 0.5), ("s3", "t3", 0.4)], "src string, tgt string, score double")
    assert {(r["src"], r["tgt2"]) for r in rp.conflicts(maps, s, t).collect()} == {("s2", "t1")}
    left = rp.repair(maps, s, t)
    assert {r["src"] for r in left.collect()} == {"s1", "s3"} and rp.conflicts(left, s, t).isEmpty()
    one = rp.one_to_one(spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.7)], "src string, tgt string, score double"))
    assert [(r["src"], r["tgt"]) for r in one.collect()] == [("a", "x")]


def test_repair_is_what_dropping_the_worst_by_rounds_comes_to(spark):
    r = random.Random(3)
    s = edges(spark, *((f"s{i:02}", f"s{r.randrange(i):02}") for i in range(1, 30)))
    t = edges(spark, *((f"t{i:02}", f"t{r.randrange(i):02}") for i in range(1, 30)))
    rows = {(f"s{r.randrange(30):02}", f"t{r.randrange(30):02}"): r.randrange(8) / 8 for _ in range(60)}
    maps = spark.createDataFrame([(*k, x) for k, x in rows.items()], "src string, tgt string, score double")
    links = {((c["src"], c["tgt"]), (c["src2"], c["tgt2"])) for c in rp.conflicts(maps, s, t).collect()}
    links |= {(y, x) for x, y in links}
    key = lambda m: (-rows[m], m)  # noqa: E731  (larger is worse)
    left = set(rows)
    while True:
        live = {m: [y for x, y in links if x == m and y in left] for m in left}
        worst = {m for m, against in live.items() if against and all(key(m) > key(y) for y in against)}
        if not worst:
            break
        left -= worst
    assert len(links) > 40 and 0 < len(left) < len(rows)
    assert {(x["src"], x["tgt"]) for x in rp.repair(maps, s, t).collect()} == left


def test_repair_leaves_no_conflict_and_drops_no_free_mapping(spark):
    from matchloom.plans import fixtures as fx

    d = "/root/testdata/sf0.01"
    maps, s, t = fx.place_mappings(spark, d), fx.place_edges(spark, d, "SRC"), fx.place_edges(spark, d, "TGT")
    left, links = rp.repair(maps, s, t), rp.conflicts(maps, s, t)
    assert rp.conflicts(left, s, t).isEmpty()
    touched = links.select("src", "tgt").unionByName(links.select(F.col("src2").alias("src"), F.col("tgt2").alias("tgt")))
    assert maps.join(left, ["src", "tgt"], "left_anti").join(touched, ["src", "tgt"], "left_anti").isEmpty()


def test_near_labels_are_those_of_all_pairs(spark):
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abß ") for _ in range(n))

    def change(s: str) -> str:
        for _ in range(r.randrange(5)):
            at = r.randrange(len(s) + 1)
            s = s[:at] + r.choice(["", "a", "xy"]) + s[at + r.randrange(2) :]
        return s

    one = [text(n % 45) for n in range(120)] + ["", None]
    two = [change(s) for s in one if s is not None] + [text(r.randrange(6)) for _ in range(30)] + ["", None]
    a = spark.createDataFrame([(i % 2, s) for i, s in enumerate(one)], "g int, a string")
    b = spark.createDataFrame([(i % 2, s) for i, s in enumerate(two)], "g int, b string")
    for threshold in (0.75, 0.8, 0.9, 0.94, 1.0):
        want = {(x["g"], x["a"], x["b"]) for x in a.join(b, "g").dropna().where(edit_similarity(F.col("a"), F.col("b")) >= threshold).collect()}
        got = near_labels(a, b, ["g"], threshold).collect()
        assert len(got) == len(want) > 0 and {tuple(x) for x in got} == want
    with pytest.raises(ValueError):
        near_labels(a, b, ["g"], 0.7)


def test_extension_pairs_only_near_children(spark):
    n = 300
    s, t = edges(spark, *((f"s{i}", "s") for i in range(n))), edges(spark, *((f"t{i}", "t") for i in range(n)))
    labels = lambda x: spark.createDataFrame([(x, x, "top")] + [(x, f"{x}{i}", f"company {i * i:09}") for i in range(n)] + [(x, f"{x}{i}", f"other name {i}") for i in range(0, n, 3)], "onto string, iri string, label string")
    ls, lt = labels("s"), labels("t")
    seed = spark.createDataFrame([("s", "t", 1.0)], "src string, tgt string, score double")
    assert gr.near_hop(seed, s, t, ls, lt, 0.94).count() < n * n / 10
    plain = lambda rows: edit_scorer(rows)  # noqa: E731  (not known as edit similarity, so all are paired)
    for threshold in (0.8, 0.94):
        got, want = (sorted(map(tuple, gr.extend(seed, s, t, ls, lt, f, threshold).collect())) for f in (edit_scorer, plain))
        assert got == want and len(got) >= n


def test_fine_tuning_data_is_made_of_stored_corpora(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    once = co.both_ways(spark.range(4).selectExpr("id AS a", "id + 1 AS b"))
    assert plan(once).count("Range") == 1 and pairs(once) == {p for i in range(4) for p in ((i, i + 1), (i + 1, i))}
    final = plan(queries.finetune_us(spark, "/root/testdata/sf0.001"))
    assert "parquet" not in final and len(final.splitlines()) < 150  # no corpus is worked out again for each use
