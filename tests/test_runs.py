from __future__ import annotations

import numpy as np
import pytest

from matchloom.operators import scorers as sc
from matchloom.plans import corpora as cp
from matchloom.plans import run as rn
from matchloom.sources import mappings as io
from matchloom.sources.config import Settings
from matchloom.streaming import labels as _  # noqa: F401  (imports without a stream)

SRC = [("S", "s1", "red bolt"), ("S", "s2", "blue gear"), ("S", "s2", "azure gear"), ("S", "s3", "green nut")]
TGT = [("T", "t1", "red bolt"), ("T", "t2", "blue gears gear"), ("T", "t3", "lone washer"), ("T", "t4", "green")]


@pytest.fixture(scope="module")
def sides(spark):
    return [spark.createDataFrame(rows, "onto string, iri string, label string") for rows in (SRC, TGT)]


def mapped(df):
    return {(r["direction"], r["src"], r["tgt"]): r["score"] for r in df.collect()}


def test_modes(spark, sides):
    edit = mapped(rn.align_both(*sides, Settings(mode="edit"), 5))
    assert edit["SRC", "s1", "t1"] == 1.0 and ("SRC", "s2", "t2") in edit
    vectors = tuple(sc.class_vectors(sc.word_vectors(x)) for x in sides)
    by_vectors = mapped(rn.align_both(*sides, Settings(mode="vectors"), 5, vectors=vectors))
    assert by_vectors["SRC", "s1", "t1"] == 1.0 and 0 < by_vectors["TGT", "s2", "t2"] < 1
    pairs = spark.createDataFrame([("a b", "b a", 1), ("a b", "c d", 0), ("c d", "d c", 1), ("c", "x y", 0)] * 5, "sent1 string, sent2 string, label int")
    model, right = sc.train_best(pairs, pairs)
    learned = mapped(rn.align_both(*sides, Settings(mode="learned"), 5, sc.learned_scorer(model)))
    assert right == 1.0 and learned["SRC", "s1", "t1"] == 1.0 and all(0 < s <= 1 for s in learned.values())
    for mode in ("vectors", "learned", "other"):
        with pytest.raises(ValueError, match="mode"):
            rn.align_both(*sides, Settings(mode=mode), 5)
    with pytest.raises(ValueError, match="penalties"):
        sc.train_best(pairs, pairs, ())


def test_classes_without_vectors_match_by_label_alone(spark, sides):
    none = spark.createDataFrame([("s2", [0.0, 0.0]), ("t2", [1.0, 0.0])], "iri string, vec array<double>")
    got = mapped(rn.align_both(*sides, Settings(mode="vectors"), 5, vectors=(none, none)))
    assert got == {("SRC", "s1", "t1"): 1.0, ("TGT", "s1", "t1"): 1.0}


def test_an_encoder_gets_each_text_of_a_batch_once(spark):
    labels = spark.createDataFrame([("a", "one"), ("b", "one"), ("c", None), ("d", "three")], "iri string, label string").coalesce(1)

    def encode(texts):
        assert len(texts) == len(set(texts))
        return np.array([[len(t), 1.0] for t in texts])

    assert {r["iri"]: r["vec"] for r in sc.encoded(labels, encode).collect()} == {"a": [3.0, 1.0], "b": [3.0, 1.0], "c": [0.0, 1.0], "d": [5.0, 1.0]}
    assert sc.encoded(labels.limit(0), encode).isEmpty()


def test_corpora_as_one_call(spark, sides, tmp_path):
    edges = [spark.createDataFrame(rows, "child string, parent string") for rows in ([("s1", "p"), ("s2", "p"), ("s3", "p")], [("t1", "q"), ("t2", "q"), ("t3", "q"), ("t4", "t3")])]
    maps = spark.createDataFrame([("s1", "t1"), ("s2", "t2"), ("s3", "t4"), ("s1", "t4"), ("s2", "t1")], "src string, tgt string")
    corpora = cp.assemble(*sides, *edges, maps, Settings(train_share=0.4, val_share=0.2, test_share=0.4, sample_rate=2, depth_threshold=0))
    assert tuple(sorted(corpora)) == tuple(sorted(cp.NAMES))
    cp.save(corpora, str(tmp_path))
    again = cp.load(spark, str(tmp_path))
    for name in cp.NAMES:
        assert sorted(again[name].collect()) == sorted(corpora[name].collect())
    assert {(r["a"], r["b"]) for r in again["src"].where("kind = 'synonym'").collect()} == {("blue gear", "azure gear"), ("azure gear", "blue gear")}
    # only parents of depth 0 give siblings here
    assert again["tgt"].where("kind = 'hard' and (a = 'green' or b = 'green')").isEmpty()


def test_repair_and_extension_runs(spark):
    s = spark.createDataFrame([("s2", "s1"), ("s3", "s1")], "child string, parent string")
    t = spark.createDataFrame([("t1", "r"), ("t2", "r"), ("t3", "t1")], "child string, parent string")
    maps = spark.createDataFrame([("s1", "t1", 1.0), ("s2", "t2", 0.9995), ("s3", "t3", 0.9999), ("s9", "t9", 0.5)], "src string, tgt string, score double")
    ref = spark.createDataFrame([("s1", "t1"), ("s3", "t3")], "src string, tgt string")
    parts = spark.createDataFrame([("s1", "t1", "test"), ("s3", "t3", "val")], "src string, tgt string, split string")
    kept, scores = rn.run_repair(maps, s, t, ref, parts, ref.limit(0), Settings())
    assert {r["src"] for r in kept.collect()} == {"s1", "s3"}
    assert {r["setting"]: (r["n_mappings"], r["p"], r["r"]) for r in scores.collect()} == {"ss": (2, 1.0, 1.0), "us": (2, 1.0, 1.0)}
    labels = [spark.createDataFrame(rows, "onto string, iri string, label string") for rows in ([("S", "s1", "a"), ("S", "s2", "same")], [("T", "t1", "a"), ("T", "t3", "same")])]
    out = rn.run_extension(maps.where("src = 's1'"), s, t, *labels, Settings())
    assert {(r["src"], r["tgt"]) for r in out.collect()} == {("s1", "t1"), ("s2", "t3")}


def test_template():
    text = "<rdf:RDF>\n<Alignment>\n<map><Cell/></map>\n<map><Cell/></map>\n</Alignment></rdf:RDF>"
    assert io.rdf_template(text) == "<rdf:RDF>\n<Alignment>\n</Alignment></rdf:RDF>" and io.rdf_template("<a/>") == "<a/>"
