"""Candidate targets of each class: shared tokens weighted by rarity, the best ``limit``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import ordered_index
from ..functions.text import Tokenizer, word_tokens
from .index import label_tokens, postings, token_weights


def select_candidates(
    query: DataFrame, target: DataFrame, limit: int | None, tokenizer: Tokenizer = word_tokens, cut: int = 0, idf: str = "cf", n_target: DataFrame | None = None, max_share: float | None = None
) -> DataFrame:
    """(from_iri, to_iri, score, rank) for class_label tables of one hierarchy each.

    score is the sum over shared tokens of qtf * dtf * weight, rounded to 6 places; ties go to the
    smaller to_iri. ``n_target`` (onto, n) counts the target's classes if some have no label.
    ``max_share`` drops tokens that are in more than that share of the target's classes: the join
    on a token grows with the product of its two lists, so set it where some are in most classes.
    Without ``limit`` every class that shares a token is a candidate.
    """
    n_target = target.groupBy("onto").agg(F.countDistinct("iri").alias("n")) if n_target is None else n_target
    index = postings(target, tokenizer, cut)
    weights = token_weights(index, n_target, idf)
    if max_share is not None:
        weights = weights.join(F.broadcast(n_target), "onto").where(F.col("df") <= F.col("n") * max_share)
    index = index.join(weights.select("onto", "token", "weight"), ["onto", "token"])
    # the join on tokens and the sums run on numbers in place of IRIs; they ascend with the IRIs, so
    # that ties go the same way
    own, other = ordered_index(query, "iri", "_from"), ordered_index(target, "iri", "_to")
    # the query side keeps short tokens: only the index has a cut
    asked = label_tokens(query, tokenizer).groupBy("iri", "token").agg(F.count("*").alias("qtf")).join(own, "iri").select("_from", "token", "qtf")
    pairs = asked.join(index.join(other, "iri").select("_to", "token", "dtf", "weight"), "token")
    scored = pairs.groupBy("_from", "_to").agg(F.round(F.sum(F.col("qtf") * F.col("dtf") * F.col("weight")), 6).alias("score"))
    best = Window.partitionBy("_from").orderBy(F.desc("score"), "_to")
    ranked = scored.withColumn("rank", F.row_number().over(best))
    ranked = ranked if limit is None else ranked.where(F.col("rank") <= limit)
    named = ranked.join(own.withColumnRenamed("iri", "from_iri"), "_from").join(other.withColumnRenamed("iri", "to_iri"), "_to")
    return named.select("from_iri", "to_iri", "score", "rank")


def bounded_product(query: DataFrame, target: DataFrame, most: int) -> DataFrame:
    """Each row of the one table with each of the other, for up to ``most`` pairs (else an error)."""
    n = query.count() * target.count()
    if n > most:
        raise ValueError(f"{n} pairs are more than {most}: set a candidate limit")
    return query.crossJoin(target)


def all_pairs(query: DataFrame, target: DataFrame, most: int) -> DataFrame:
    """Every target of every class, for hierarchies of up to ``most`` pairs (else an error)."""
    a, b = query.select(F.col("iri").alias("from_iri")).distinct(), target.select(F.col("iri").alias("to_iri")).distinct()
    return bounded_product(a, b, most).select("*", F.lit(0.0).alias("score"), F.row_number().over(Window.partitionBy("from_iri").orderBy("to_iri")).alias("rank"))
