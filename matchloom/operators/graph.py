"""Hierarchy operations: depth, ancestors, and extension of mappings along the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import checkpointed
from ..model import ROOT
from .near import LEAST, near_labels
from .scorers import Scorer, edit_scorer


def named_edges(edges: DataFrame) -> DataFrame:
    """(child, parent) between named classes; the root above all is dropped, loops too."""
    return edges.where((F.col("parent") != ROOT) & (F.col("child") != F.col("parent"))).select("child", "parent").distinct()


def depth(edges: DataFrame, strategy: str = "max") -> DataFrame:
    """(iri, depth): the longest (``max``) or shortest (``min``) way up to a class without parents.

    Level by level, each class once: for ``max`` when the last of its parents has been reached, for
    ``min`` when the first has. Rounds go on until no class is left. A class in or below a cycle has
    no longest way, which is an error; a cycle that no root leads to has no shortest way either and
    its classes are not in the result."""
    e = checkpointed(named_edges(edges))
    nodes = e.select(F.col("child").alias("iri")).unionByName(e.select(F.col("parent").alias("iri"))).distinct()
    roots = nodes.join(e.select(F.col("child").alias("iri")), "iri", "left_anti")
    known = level = checkpointed(roots.withColumn("depth", F.lit(0)))
    open_, k = e, 0
    while not level.isEmpty():
        k += 1
        step = level.join(e, level["iri"] == e["parent"]).select(F.col("child").alias("iri")).distinct()
        if strategy == "min":
            step = step.join(known, "iri", "left_anti")
        else:  # edges to parents that are not reached yet
            open_ = checkpointed(open_.join(level.select(F.col("iri").alias("parent")), "parent", "left_anti"))
            step = step.join(open_.select(F.col("child").alias("iri")), "iri", "left_anti")
        level = checkpointed(step.withColumn("depth", F.lit(k)))
        known = known.unionByName(level)
    if strategy == "max" and not open_.isEmpty():
        raise ValueError("classes in or below a cycle have no longest way up")
    return known


def max_depth(edges: DataFrame) -> DataFrame:
    """(depth): the largest depth of a hierarchy, one row."""
    return depth(edges, "max").agg(F.max("depth").alias("depth"))


def ancestors(edges: DataFrame) -> DataFrame:
    """(iri, ancestor): the strict transitive closure of the edges, in rounds until none is new; a
    class in a cycle is above itself."""
    e = checkpointed(named_edges(edges))
    closure = level = e.select(F.col("child").alias("iri"), F.col("parent").alias("ancestor"))
    while not level.isEmpty():
        up = level.join(e, level["ancestor"] == e["child"]).select("iri", F.col("parent").alias("ancestor")).distinct()
        level = checkpointed(up.join(closure, ["iri", "ancestor"], "left_anti"))
        closure = closure.unionByName(level)
    return closure


def _step(frontier: DataFrame, src_edges: DataFrame, tgt_edges: DataFrame, here: str, there: str) -> DataFrame:
    s = src_edges.select(F.col(here).alias("src"), F.col(there).alias("src2"))
    t = tgt_edges.select(F.col(here).alias("tgt"), F.col(there).alias("tgt2"))
    return frontier.select("src", "tgt").join(s, "src").join(t, "tgt").select(F.col("src2").alias("src"), F.col("tgt2").alias("tgt"))


def one_hop(frontier: DataFrame, src_edges: DataFrame, tgt_edges: DataFrame) -> DataFrame:
    """(src, tgt): parents with parents and children with children of each mapping."""
    steps = [_step(frontier, src_edges, tgt_edges, *ways) for ways in (("child", "parent"), ("parent", "child"))]
    return steps[0].unionByName(steps[1]).distinct()


def near_hop(frontier: DataFrame, src_edges: DataFrame, tgt_edges: DataFrame, src_labels: DataFrame, tgt_labels: DataFrame, threshold: float) -> DataFrame:
    """The pairs of ``one_hop`` but for those of children that have no two labels of an edit similarity
    of ``threshold``: a mean over label pairs that reaches it has one that does.

    Two classes with many children have far more pairs of children than near ones, so these are found
    by their labels; parents are few."""
    open_ = frontier.select("src", "tgt").distinct()
    open_ = open_.join(src_edges.select(F.col("parent").alias("src")), "src", "left_semi").join(tgt_edges.select(F.col("parent").alias("tgt")), "tgt", "left_semi")
    s = src_edges.select(F.col("parent").alias("src"), F.col("child").alias("iri")).join(src_labels.select("iri", F.col("label").alias("a")), "iri")
    t = tgt_edges.select(F.col("parent").alias("tgt"), F.col("child").alias("iri")).join(tgt_labels.select("iri", F.col("label").alias("b")), "iri")
    below = checkpointed(open_.join(s, "src").select("src", "tgt", "a", F.col("iri").alias("src2"))), checkpointed(open_.join(t, "tgt").select("src", "tgt", "b", F.col("iri").alias("tgt2")))
    near = near_labels(*below, ["src", "tgt"], threshold)
    children = near.join(below[0], ["src", "tgt", "a"]).join(below[1], ["src", "tgt", "b"]).select(F.col("src2").alias("src"), F.col("tgt2").alias("tgt"))
    return _step(frontier, src_edges, tgt_edges, "child", "parent").unionByName(children).distinct()


def score_pairs(pairs: DataFrame, src_labels: DataFrame, tgt_labels: DataFrame, scorer: Scorer, places: int = 6) -> DataFrame:
    """(src, tgt, score): 1 for pairs that share a label, else the mean over label pairs; null labels
    do not count."""
    s = src_labels.where("label is not null").select(F.col("iri").alias("src"), F.col("label").alias("a"))
    t = tgt_labels.where("label is not null").select(F.col("iri").alias("tgt"), F.col("label").alias("b"))
    rows = pairs.select("src", "tgt").join(s, "src").join(t, "tgt").select(F.col("src").alias("from_iri"), F.col("tgt").alias("to_iri"), F.lit(1).alias("rank"), "a", "b")
    score = F.when(F.max(F.col("a") == F.col("b")), F.lit(1.0)).otherwise(F.round(F.avg("score"), places))
    return scorer(rows).groupBy(F.col("from_iri").alias("src"), F.col("to_iri").alias("tgt")).agg(score.alias("score"))


def extend(mappings: DataFrame, src_edges: DataFrame, tgt_edges: DataFrame, src_labels: DataFrame, tgt_labels: DataFrame, scorer: Scorer, threshold: float = 0.9, max_iter: int = 50) -> DataFrame:
    """(src, tgt, score, hop): mappings that extension adds to those of ``threshold`` or more.

    Each round scores the neighbours of the last round's mappings that are not known yet and
    keeps those that reach the threshold, until none do. A mapping below the threshold is not
    known, so it can come back. For edit similarity and a threshold of ``LEAST`` or more, neighbours
    that cannot reach it are not paired; what comes out is the same."""
    least = threshold - 1e-6  # scores are rounded
    by_label = scorer is edit_scorer and least >= LEAST
    seen = checkpointed(mappings.where(F.col("score") >= threshold).select("src", "tgt").distinct())
    frontier, out = seen, None
    for hop in range(1, max_iter + 1):
        hop_ = near_hop(frontier, src_edges, tgt_edges, src_labels, tgt_labels, least) if by_label else one_hop(frontier, src_edges, tgt_edges)
        fresh = hop_.join(seen, ["src", "tgt"], "left_anti")
        kept = checkpointed(score_pairs(fresh, src_labels, tgt_labels, scorer).where(F.col("score") >= threshold).withColumn("hop", F.lit(hop)))
        if kept.isEmpty():
            break
        out = kept if out is None else out.unionByName(kept)
        frontier = kept.select("src", "tgt")
        seen = seen.unionByName(frontier)
    return mappings.sparkSession.createDataFrame([], "src string, tgt string, score double, hop int") if out is None else out


def extended(mappings: DataFrame, additions: DataFrame) -> DataFrame:
    """(src, tgt, score): predictions with what extension adds to them."""
    return mappings.select("src", "tgt", "score").unionByName(additions.select("src", "tgt", "score"))
