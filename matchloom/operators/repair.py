"""Mapping repair by conflict rules (an approximation in the spirit of logic-based repair, not
the equal of an external reasoner)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import checkpointed
from .graph import ancestors, named_edges


def one_to_one(mappings: DataFrame) -> DataFrame:
    """Mappings that are the best of both their classes (score, then other class)."""
    of_src = Window.partitionBy("src").orderBy(F.desc("score"), "tgt")
    of_tgt = Window.partitionBy("tgt").orderBy(F.desc("score"), "src")
    ranked = mappings.withColumn("_s", F.row_number().over(of_src)).withColumn("_t", F.row_number().over(of_tgt))
    return ranked.where("_s = 1 and _t = 1").drop("_s", "_t")


def conflicts(mappings: DataFrame, src_edges: DataFrame, tgt_edges: DataFrame) -> DataFrame:
    """(src, tgt, src2, tgt2): src is below or equal to src2, but tgt and tgt2 lie under
    different children of one parent, which count as disjoint, and not under one another."""
    up = ancestors(src_edges)
    pairs = mappings.select("src", "tgt")
    below = up.select(F.col("iri").alias("src"), F.col("ancestor").alias("src2")).unionByName(pairs.select("src", F.col("src").alias("src2"))).distinct()
    related = pairs.join(below, "src").join(pairs.select(F.col("src").alias("src2"), F.col("tgt").alias("tgt2")), "src2").where("tgt <> tgt2")
    over = ancestors(tgt_edges)
    nodes = named_edges(tgt_edges)
    every = over.unionByName(nodes.select(F.col("child").alias("iri"), F.col("child").alias("ancestor")).distinct()).distinct()
    # the child of a parent that a class lies under
    under = every.join(nodes.select(F.col("child").alias("ancestor"), "parent"), "ancestor").select("iri", F.col("ancestor").alias("top"), "parent")
    one = under.select(F.col("iri").alias("tgt"), F.col("top").alias("top1"), "parent")
    two = under.select(F.col("iri").alias("tgt2"), F.col("top").alias("top2"), "parent")
    disjoint = related.join(one, "tgt").join(two, ["tgt2", "parent"]).where("top1 <> top2").select("src", "tgt", "src2", "tgt2").distinct()
    along = every.select(F.col("iri").alias("tgt"), F.col("ancestor").alias("tgt2"))
    either = along.unionByName(along.select(F.col("tgt2").alias("tgt"), F.col("tgt").alias("tgt2"))).distinct()
    return disjoint.join(either, ["tgt", "tgt2"], "left_anti")


def repair(mappings: DataFrame, src_edges: DataFrame, tgt_edges: DataFrame) -> DataFrame:
    """``mappings`` (src, tgt, score) without conflicts: of two in conflict the worse goes (lower
    score, then larger src, tgt), so that what stays has no better mapping against it.

    This is what dropping the worst of a conflict round by round comes to, in one pass: a mapping
    outlives all worse ones it conflicts with, so whatever beats it is still there when it goes."""
    left = checkpointed(mappings.groupBy("src", "tgt").agg(F.max("score").alias("score")))
    links = conflicts(left, src_edges, tgt_edges)
    other = left.select(F.col("src").alias("src2"), F.col("tgt").alias("tgt2"), F.col("score").alias("score2"))
    pairs = links.join(left, ["src", "tgt"]).join(other, ["src2", "tgt2"])
    one, two = F.struct("src", "tgt"), F.struct(F.col("src2").alias("src"), F.col("tgt2").alias("tgt"))
    worse = (F.col("score") < F.col("score2")) | ((F.col("score") == F.col("score2")) & (one > two))
    losers = pairs.select(F.when(worse, one).otherwise(two).alias("x")).select("x.*").distinct()
    return left.join(losers, ["src", "tgt"], "left_anti")
