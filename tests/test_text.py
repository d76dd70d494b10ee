from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.functions import text as tx
from matchloom.functions.tables import dense_index


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (_, t) in values.items())
    return spark.createDataFrame([tuple(v for v, _ in values.values())], schema or "x int").select(column.alias("r")).first()["r"]


def test_fold_labels_keeps_order_and_drops_repeats(spark):
    got = one(spark, tx.fold_labels([F.col("a"), F.col("b")]), a=(["Red_Bolt", "", None, "red bolt"], "array<string>"), b=(["GEAR", "Red Bolt"], "array<string>"))
    assert got == ["red bolt", "gear"]
    assert one(spark, tx.fold_labels([F.col("a")]), a=(None, "array<string>")) == []


def test_edit_similarity(spark):
    sim = tx.edit_similarity(F.col("a"), F.col("b"))
    for a, b, want in (("", "", 1.0), ("abc", "", 0.0), ("abcd", "abcx", 0.75), ("é", "e", 0.0)):
        assert one(spark, sim, a=(a, "string"), b=(b, "string")) == want


def test_cosine(spark):
    c = tx.cosine(F.col("a"), F.col("b"))
    assert abs(one(spark, c, a=([3.0, 4.0], "array<float>"), b=([6.0, 8.0], "array<float>")) - 1) < 1e-12
    assert one(spark, c, a=([0.0, 0.0], "array<float>"), b=([1.0, 0.0], "array<float>")) is None


def test_pooling(spark):
    v, m = ([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], "array<array<float>>"), ([1.0, 1.0, 0.0], "array<double>")
    assert one(spark, tx.mean_pool(F.col("v"), F.col("m")), v=v, m=m) == [2.0, 3.0]
    assert one(spark, tx.mean_pool(F.col("v"), F.col("m")), v=v, m=([0.0] * 3, "array<double>")) is None
    assert one(spark, tx.first_pool(F.col("v")), v=v) == [1.0, 2.0]


def test_iris(spark):
    full = "http://purl.obolibrary.org/obo/X_1"
    assert one(spark, tx.abbreviate(F.col("a")), a=(full, "string")) == "obo:X_1"
    assert one(spark, tx.abbreviate(F.col("a")), a=("http://other/X", "string")) == "http://other/X"
    assert one(spark, tx.expand(F.col("a")), a=("obo:X_1", "string")) == full
    assert one(spark, tx.expand(F.col("a")), a=("zzz:1", "string")) is None
    nested = {"http://a/": "a:", "http://a/b/": "b:"}
    assert one(spark, tx.abbreviate(F.col("a"), nested), a=("http://a/b/c", "string")) == "b:c"


def test_tokenizers(spark):
    assert one(spark, tx.word_tokens(F.col("a")), a=("red  bolt red", "string")) == ["red", "bolt", "red"]
    assert one(spark, tx.char_ngrams(3)(F.col("a")), a=("abcd", "string")) == ["abc", "bcd"]
    assert one(spark, tx.char_ngrams(3)(F.col("a")), a=("ab", "string")) == ["ab"]
    pieces = tx.wordpiece(["un", "##able", "##a", "able"])
    assert one(spark, pieces(F.col("a")), a=("unable able xyz", "string")) == ["un", "##able", "able", "[UNK]"]
    assert one(spark, pieces(F.col("a")), a=(None, "string")) == []


def test_clamp(spark):
    for x, want in ((0.005, 0.0), (0.01, 0.0), (0.02, 0.02)):
        assert one(spark, tx.clamp(F.col("a")), a=(x, "double")) == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("abc", max_size=3), min_size=1, max_size=40, unique=True))
def test_dense_index_counts_from_zero(spark, keys):
    got = dense_index(spark.createDataFrame([(k,) for k in keys], "k string"), ["k"]).collect()
    assert sorted(r["idx"] for r in got) == list(range(len(keys)))
