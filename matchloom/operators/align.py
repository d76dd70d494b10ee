"""Alignment: candidates to the best mappings of each class, in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import checkpointed
from ..functions.text import clamp, cosine
from .candidates import bounded_product
from .scorers import Scorer, vector_scores


def label_pairs(candidates: DataFrame, query: DataFrame, target: DataFrame) -> DataFrame:
    """(from_iri, to_iri, rank, a, b): all label pairs of each candidate pair."""
    q = query.select(F.col("iri").alias("from_iri"), F.col("label").alias("a"))
    t = target.select(F.col("iri").alias("to_iri"), F.col("label").alias("b"))
    return candidates.select("from_iri", "to_iri", "rank").join(q, "from_iri").join(t, "to_iri")


def string_matches(candidates: DataFrame, query: DataFrame, target: DataFrame) -> DataFrame:
    """(from_iri, to_iri, rank) of candidates that share a label, by an equi-join."""
    q = query.select(F.col("iri").alias("from_iri"), "label")
    t = target.select(F.col("iri").alias("to_iri"), "label")
    shared = q.join(t, "label").select("from_iri", "to_iri").distinct()
    return candidates.select("from_iri", "to_iri", "rank").join(shared, ["from_iri", "to_iri"])


def _matched_first(candidates: DataFrame, query: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mappings of score 1 of the classes that share a label with a candidate (the first such), and
    the candidates of the other classes."""
    exact = string_matches(candidates, query, target).groupBy("from_iri").agg(F.min_by("to_iri", "rank").alias("to_iri"))
    found = exact.select("from_iri", "to_iri", F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    return found, candidates.join(exact.select("from_iri"), "from_iri", "left_anti")


def align(
    candidates: DataFrame, query: DataFrame, target: DataFrame, scorer: Scorer, pooling: str = "mean", nbest: int = 1, string_match: bool = True, clamp_low: bool = True, places: int = 6
) -> DataFrame:
    """(from_iri, to_iri, score, rank): the ``nbest`` candidates of each class.

    With ``string_match`` a class that shares a label with a candidate gets the first such
    candidate alone, with score 1, and is not scored. Else a candidate's score is the ``mean`` or
    ``max`` of its label pairs' scores; ties go to the better candidate rank. Scores of 0 go.
    """
    found, rest = _matched_first(candidates, query, target) if string_match else (None, candidates)
    pool = {"mean": F.avg, "max": F.max}[pooling]
    scored = scorer(label_pairs(rest, query, target)).groupBy("from_iri", "to_iri", "rank").agg(F.round(pool("score"), places).alias("score"))
    out = best(scored.withColumn("score", clamp(F.col("score"))) if clamp_low else scored, nbest)
    return out if found is None else found.unionByName(out)


def align_vectors(
    candidates: DataFrame, query: DataFrame, target: DataFrame, query_vectors: DataFrame, target_vectors: DataFrame, nbest: int = 1, string_match: bool = True, places: int = 6
) -> DataFrame:
    """As ``align``, by the cosine of the classes' vectors (iri, vec) over their candidates; a class
    without a vector, or with a zero one, matches by labels alone."""
    found, rest = _matched_first(candidates, query, target) if string_match else (None, candidates)
    scored = vector_scores(rest.select("from_iri", "to_iri", "rank"), query_vectors, target_vectors)
    out = best(scored.withColumn("score", F.round(clamp(F.col("score")), places)), nbest)
    return out if found is None else found.unionByName(out)


def nearest(query_vectors: DataFrame, target_vectors: DataFrame, nbest: int, most: int, places: int = 6) -> DataFrame:
    """(from_iri, to_iri, score, rank): the ``nbest`` targets of each vector (iri, vec) by cosine, by a
    search over all targets; ties go to the smaller to_iri. More than ``most`` pairs are an error.

    The vectors are at hand where a pair is made, so pairs are scored and cut to ``nbest`` in each
    task and only those are shuffled."""
    q = query_vectors.select(F.col("iri").alias("from_iri"), F.col("vec").alias("_q"))
    t = target_vectors.select(F.col("iri").alias("to_iri"), F.col("vec").alias("_t"))
    score = F.round(cosine(F.col("_q"), F.col("_t")), places).alias("score")
    return best(bounded_product(q, t, most).select("from_iri", "to_iri", F.col("to_iri").alias("rank"), score), nbest)


def best(scored: DataFrame, nbest: int = 1) -> DataFrame:
    """The ``nbest`` of (from_iri, to_iri, rank, score) by score, then rank; scores of 0 go."""
    order = Window.partitionBy("from_iri").orderBy(F.desc("score"), "rank")
    ranked = scored.where(F.col("score") > 0).withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= nbest)
    return ranked.select("from_iri", "to_iri", "score", F.col("_nth").alias("rank"))


def bidirectional(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """(direction, src, tgt, score, rank) of the alignments from either side."""
    one = forward.select(F.lit("SRC").alias("direction"), F.col("from_iri").alias("src"), F.col("to_iri").alias("tgt"), "score", "rank")
    two = backward.select(F.lit("TGT").alias("direction"), F.col("to_iri").alias("src"), F.col("from_iri").alias("tgt"), "score", "rank")
    return one.unionByName(two)


def mapping_sets(mappings: DataFrame, keep: int = 1) -> DataFrame:
    """(set_type, src, tgt, score): the best ``keep`` per source class, per target class, and
    their union without repeats. A pair is twice in the union if its scores differ."""
    mappings, sides = checkpointed(mappings), []  # read four times, worked out once
    for direction, key, other, name in (("SRC", "src", "tgt", "src"), ("TGT", "tgt", "src", "tgt")):
        order = Window.partitionBy(key).orderBy(F.desc("score"), "rank", other)
        kept = mappings.where(F.col("direction") == direction).withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= keep)
        sides.append(kept.select(F.lit(name).alias("set_type"), "src", "tgt", "score"))
    both = sides[0].drop("set_type").unionByName(sides[1].drop("set_type")).dropna().dropDuplicates()
    return sides[0].unionByName(sides[1]).unionByName(both.select(F.lit("combined").alias("set_type"), "src", "tgt", "score"))
