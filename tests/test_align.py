"""Hand-computed cases on a hierarchy of a few classes."""

from __future__ import annotations

import math

import pytest

from matchloom.operators import align as al
from matchloom.operators import evaluate as ev
from matchloom.operators.candidates import all_pairs, select_candidates
from matchloom.operators.index import postings, token_weights
from matchloom.operators.scorers import class_vectors, edit_scorer, vector_scores
from matchloom.plans.run import align_both, resumable, run, validate_then_test
from matchloom.sources.config import Settings


def labels(spark, onto, classes):
    return spark.createDataFrame([(onto, iri, x) for iri, texts in classes.items() for x in texts], "onto string, iri string, label string")


@pytest.fixture
def src(spark):
    return labels(spark, "S", {"s1": ["red bolt", "bolt"], "s2": ["blue gear"], "s3": ["nothing"]})


@pytest.fixture
def tgt(spark):
    return labels(spark, "T", {"t1": ["red bolt"], "t2": ["blue gears", "gear"], "t3": ["bolt bolt bolt bolt"]})


def maps(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"{extra}src string, tgt string, score double")


def test_postings_keep_repeats_and_weights_can_be_negative(spark, tgt):
    p = {(r["token"], r["iri"]): r["dtf"] for r in postings(tgt).collect()}
    assert p[("bolt", "t3")] == 4 and p[("bolt", "t1")] == 1
    n = spark.createDataFrame([("T", 3)], "onto string, n long")
    w = {r["token"]: r for r in token_weights(postings(tgt), n).collect()}
    assert w["bolt"]["cf"] == 5 and w["bolt"]["df"] == 2 and w["bolt"]["weight"] == pytest.approx(math.log10(3 / 5)) and w["bolt"]["weight"] < 0


def test_candidates_by_hand(src, tgt):
    got = {(r["from_iri"], r["to_iri"]): (r["score"], r["rank"]) for r in select_candidates(src, tgt, 10).collect()}
    bolt, red = math.log10(3 / 5), math.log10(3)
    assert got[("s1", "t1")] == (round(2 * bolt + red, 6), 1)
    assert got[("s1", "t3")] == (round(8 * bolt, 6), 2)  # returned though negative
    assert not any(s == "s3" for s, _ in got)
    assert select_candidates(src, tgt, 1).count() == 2
    assert select_candidates(src, tgt, None, max_share=0.5).where("from_iri = 's1' and to_iri = 't3'").isEmpty()


def test_index_cut_leaves_the_query_alone(src, tgt):
    assert select_candidates(src, tgt, 10, cut=4).where("from_iri = 's1'").isEmpty()


def test_all_pairs_is_guarded(src, tgt):
    assert all_pairs(src, tgt, 9).count() == 9
    with pytest.raises(ValueError):
        all_pairs(src, tgt, 8)


def test_string_match_is_returned_alone(src, tgt):
    out = al.align(select_candidates(src, tgt, 10), src, tgt, edit_scorer, nbest=5).where("from_iri = 's1'").collect()
    assert [(r["to_iri"], r["score"], r["rank"]) for r in out] == [("t1", 1.0, 1)]


def test_pooling_and_fewer_candidates_than_nbest(src, tgt):
    c = select_candidates(src, tgt, 10)
    most = {r["to_iri"]: r["score"] for r in al.align(c, src, tgt, edit_scorer, "max", 5, False, False).where("from_iri = 's2'").collect()}
    mean = {r["to_iri"]: r["score"] for r in al.align(c, src, tgt, edit_scorer, "mean", 5, False, False).where("from_iri = 's2'").collect()}
    assert most == {"t2": 0.9} and mean == {"t2": round((0.9 + 4 / 9) / 2, 6)}  # no padding


def test_sets_keep_pairs_of_different_scores(spark):
    rows = [("SRC", "a", "x", 0.9, 1), ("TGT", "a", "x", 0.8, 1), ("SRC", "b", "y", 0.7, 1), ("TGT", "b", "y", 0.7, 1), ("SRC", "b", "z", 0.10, 2)]
    sets = al.mapping_sets(spark.createDataFrame(rows, "direction string, src string, tgt string, score double, rank int"))
    assert sets.where("set_type = 'combined'").count() == 3 and sets.where("set_type = 'src'").count() == 2


def test_evaluation_by_hand(spark):
    sets = maps(spark, [("src", "a", "x", 0.9), ("src", "b", "y", 0.8), ("src", "c", "c", 0.9), ("src", "d", "w", 0.5), ("src", "e", "v", 0.9)], "set_type string, ")
    ref, ign = maps(spark, [("a", "x", 1.0), ("f", "u", 1.0), ("e", "v", 1.0)]), maps(spark, [("e", "v", 1.0)])
    row = ev.evaluate(sets, ref, ign, [0.8]).first()
    assert (row["n_mappings"], row["n_ignored"]) == (3, 3)  # c-c, and e-v twice
    assert (row["p"], row["r"], row["f1"]) == (0.5, 0.5, 0.5)
    assert ev.evaluate(sets, ref, None, [0.8]).first()["n_ignored"] == 1  # nothing to ignore is no error
    none = ev.evaluate(sets, maps(spark, [("q", "q2", 1.0)]), ign, [0.8]).first()
    assert (none["p"], none["r"], none["f1"]) == (0.0, 0.0, 0.0)


def test_grid_and_best_row(spark):
    assert len(ev.thresholds()) == 38 and ev.thresholds()[0] == 0.0 and ev.thresholds()[-1] == 1.0
    rows = [("src", 0.1, 0.5), ("combined", 0.1, 0.5), ("tgt", 0.0, 0.4)]
    best = ev.best_row(spark.createDataFrame(rows, "set_type string, threshold double, f1 double")).first()
    assert (best["set_type"], best["threshold"]) == ("combined", 0.1)


def test_recall_does_not_rise_with_the_threshold(spark):
    sets = maps(spark, [("src", str(i), str(i + 100), i / 20) for i in range(20)], "set_type string, ")
    ref = maps(spark, [(str(i), str(i + 100), 1.0) for i in range(0, 20, 2)])
    r = [x["r"] for x in ev.evaluate(sets, ref).orderBy("threshold").collect()]
    assert r == sorted(r, reverse=True) and all(0 <= x <= 1 for x in r)


def test_class_vectors_and_scores(spark):
    v = class_vectors(spark.createDataFrame([("a", [1.0, 3.0]), ("a", [3.0, 5.0])], "iri string, vec array<float>"))
    assert v.first()["vec"] == [2.0, 4.0]
    c = spark.createDataFrame([("a", "b", 1)], "from_iri string, to_iri string, rank int")
    t = spark.createDataFrame([("b", [1.0, 2.0])], "iri string, vec array<double>")
    assert vector_scores(c, v, t).first()["score"] == pytest.approx(1.0)


def test_nearest_by_a_search_over_all_targets(spark):
    own = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [0.0, 0.0]), ("q3", [1.0, 1.0])], "iri string, vec array<double>")
    other = spark.createDataFrame([("t2", [0.0, 2.0]), ("t1", [3.0, 0.0]), ("t3", [-1.0, 0.0])], "iri string, vec array<float>")
    got = [tuple(r) for r in al.nearest(own, other, 2, 9).orderBy("from_iri", "rank").collect()]
    assert got == [("q1", "t1", 1.0, 1), ("q3", "t1", 0.707107, 1), ("q3", "t2", 0.707107, 2)]  # no score of 0; of equals the smaller
    with pytest.raises(ValueError):
        al.nearest(own, other, 2, 8)


def test_run_is_resumed(spark, src, tgt, tmp_path):
    s = Settings(candidate_limits=[5, 2])
    out = run(spark, src, tgt, s, str(tmp_path))
    assert {r["limit"] for r in out.select("limit").distinct().collect()} == {5, 2}
    again = resumable(spark, f"{tmp_path}/{s.key()}/map.5", lambda: pytest.fail("made again"))
    assert again.count() > 0
    assert Settings(candidate_limits=[5]).key() != s.key()


def test_validate_then_test(spark, src, tgt):
    sets = al.mapping_sets(align_both(src, tgt, Settings(), 5))
    ref = maps(spark, [("s1", "t1", 1.0), ("s2", "t2", 1.0)])
    row = validate_then_test(sets, ref, ref, ref.limit(0), ref.limit(0)).first()
    assert row["f1"] == 1.0


def test_settings(tmp_path):
    assert Settings(mode="nes").mode == "edit"
    (p := tmp_path / "c.json").write_text('{"map": {"nbest": 2}, "cut": 1}')
    assert (Settings.read(str(p)).nbest, Settings.read(str(p)).cut) == (2, 1)
    p.write_text('{"nbets": 2}')
    with pytest.raises(ValueError):
        Settings.read(str(p))
