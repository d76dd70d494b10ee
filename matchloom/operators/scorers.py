"""Scorers of label pairs and vectors.

A scorer takes a DataFrame with from_iri, to_iri, rank, a (a label of the one class) and b (one
of the other) and adds ``score``, 0 to 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_ngrams, cosine, edit_similarity, hash_int, word_tokens

Scorer = Callable[[DataFrame], DataFrame]


def edit_scorer(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("score", edit_similarity(F.col("a"), F.col("b")))


def _overlap(x: Column, y: Column) -> Column:
    """Jaccard index of two arrays."""
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


FEATURES = ("edit", "words", "grams", "length", "first")
#: Places of the hashed features of word pairs.
HASHED = 1 << 16


def lexical_features(pairs: DataFrame, a: str = "sent1", b: str = "sent2") -> DataFrame:
    """``pairs`` with the features that the learned scorer reads: five measures, and ``swaps``, the
    words that stand in place of one another, alone and with the words they share. Swaps are the
    same for both orders of a pair."""
    x, y, grams = F.col(a), F.col(b), char_ngrams(3)
    longer, shorter = F.greatest(F.length(x), F.length(y)), F.least(F.length(x), F.length(y))
    text = lambda words: F.array_join(F.array_sort(words), " ")
    own, other = (text(F.array_except(word_tokens(p), word_tokens(q))) for p, q in ((x, y), (y, x)))
    swap = F.concat_ws("|", F.least(own, other), F.greatest(own, other))
    return pairs.select(
        "*",
        edit_similarity(x, y).alias("edit"),
        _overlap(word_tokens(x), word_tokens(y)).alias("words"),
        _overlap(grams(x), grams(y)).alias("grams"),
        F.when(longer > 0, shorter / longer).otherwise(F.lit(1.0)).alias("length"),
        (F.substring(x, 1, 1) == F.substring(y, 1, 1)).cast("double").alias("first"),
        F.array(swap, F.concat_ws("|", swap, text(F.array_intersect(word_tokens(x), word_tokens(y))))).alias("swaps"),
    )


def train_scorer(label_pairs: DataFrame, iterations: int = 50, tolerance: float = 1e-6, penalty: float = 1e-3) -> PipelineModel:
    """A logistic regression over lexical features of (sent1, sent2, label); it ends after
    ``iterations``, or before when the loss changes by less than ``tolerance``."""
    hashed = HashingTF(inputCol="swaps", outputCol="hashed", numFeatures=HASHED, binary=True)
    stages = [hashed, VectorAssembler(inputCols=[*FEATURES, "hashed"], outputCol="features"), LogisticRegression(labelCol="label", maxIter=iterations, tol=tolerance, regParam=penalty)]
    return Pipeline(stages=stages).fit(lexical_features(label_pairs).withColumn("label", F.col("label").cast("double")))


def train_best(train: DataFrame, val: DataFrame, penalties: Sequence[float] = (1e-2, 1e-3, 1e-4), iterations: int = 50) -> tuple[PipelineModel, float]:
    """The model of the best accuracy on ``val`` over the penalties, and that accuracy; of equals the
    first."""
    best: tuple[PipelineModel, float] | None = None
    for penalty in penalties:
        model = train_scorer(train, iterations, penalty=penalty)
        right = accuracy(model, val).first()["accuracy"] or 0.0
        if best is None or right > best[1]:
            best = model, right
    if best is None:
        raise ValueError("no penalties")
    return best


def learned_scorer(model: PipelineModel) -> Scorer:
    """The positive class's probability under a trained model."""

    def score(pairs: DataFrame) -> DataFrame:
        out = model.transform(lexical_features(pairs, "a", "b"))
        return out.select(*pairs.columns, vector_to_array("probability")[1].alias("score"))

    return score


def accuracy(model: PipelineModel, label_pairs: DataFrame) -> DataFrame:
    """(n, accuracy) of a model over label pairs."""
    out = model.transform(lexical_features(label_pairs))
    return out.agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


def class_vectors(vectors: DataFrame) -> DataFrame:
    """(iri, vec) of texts to the mean vector of each class, place by place."""
    places = vectors.select("iri", F.posexplode("vec").alias("pos", "x")).groupBy("iri", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = places.groupBy("iri").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return ordered.select("iri", F.col("v.x").alias("vec"))


def encoded(labels: DataFrame, encode: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(iri, vec) of (iri, label) by a supplied encoder, in Arrow batches; a batch's labels that
    repeat are encoded once. ``encode`` gives a row of numbers per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).dictionary_encode()
            vectors = np.asarray(encode([t or "" for t in texts.dictionary.to_pylist()]), np.float64)[texts.indices.to_numpy()] if len(batch) else np.empty((0, 1))
            at = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, vectors.ravel())], names=["iri", "vec"])

    return labels.select("iri", F.coalesce("label", F.lit("")).alias("label")).mapInArrow(run, "iri string, vec array<double>")


def word_vectors(labels: DataFrame, size: int = 32) -> DataFrame:
    """(iri, vec) of (iri, label): how many of a label's words have each of ``size`` hashes, for when
    no encoder is at hand."""
    at = F.transform(word_tokens(F.col("label")), lambda w: hash_int("word", w) % size)
    return labels.select("iri", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(at, lambda x: x == k)).cast("double")).alias("vec"))


def vector_scores(candidates: DataFrame, query: DataFrame, target: DataFrame) -> DataFrame:
    """``candidates`` (from_iri, to_iri, rank) with the cosine of the classes' vectors."""
    q = query.select(F.col("iri").alias("from_iri"), F.col("vec").alias("_q"))
    t = target.select(F.col("iri").alias("to_iri"), F.col("vec").alias("_t"))
    return candidates.join(q, "from_iri").join(t, "to_iri").withColumn("score", cosine(F.col("_q"), F.col("_t"))).drop("_q", "_t")
