"""Whole runs: prepared hierarchies to mapping sets, their extension, repair and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import align, align_vectors, bidirectional, mapping_sets
from ..operators.candidates import select_candidates
from ..operators.evaluate import best_row, evaluate
from ..operators.graph import extend, extended
from ..operators.repair import repair
from ..operators.scorers import Scorer, edit_scorer
from ..sources.config import Settings


def _finished(spark: SparkSession, path: str) -> bool:
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def resumable(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``, made and written by ``make`` only if it isn't there whole."""
    if not _finished(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def align_both(src: DataFrame, tgt: DataFrame, settings: Settings, limit: int, scorer: Scorer = edit_scorer, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(direction, src, tgt, score, rank) of two class_label tables at one candidate limit.

    The settings' mode says how candidates are scored: ``edit`` by the scorer with its largest label
    pair, ``learned`` by a trained scorer pooled as set, ``vectors`` by ``vectors`` ((iri, vec) of
    both hierarchies). An unknown mode, or one without what it needs, is an error."""
    common = {"nbest": settings.nbest, "string_match": settings.string_match}
    if settings.mode == "vectors" and vectors is None:
        raise ValueError("mode vectors needs the classes' vectors")
    if settings.mode == "learned" and scorer is edit_scorer:
        raise ValueError("mode learned needs a trained scorer")
    sides = []
    for a, b, turn in ((src, tgt, 1), (tgt, src, -1)):
        candidates = select_candidates(a, b, limit, cut=settings.cut)
        if settings.mode == "vectors":
            sides.append(align_vectors(candidates, a, b, *vectors[::turn], **common))
        elif settings.mode in ("edit", "learned"):
            edit = settings.mode == "edit"
            sides.append(align(candidates, a, b, scorer, pooling="max" if edit else settings.pooling, clamp_low=not edit, **common))
        else:
            raise ValueError(f"unknown mode: {settings.mode}")
    return bidirectional(*sides)


def run(spark: SparkSession, src: DataFrame, tgt: DataFrame, settings: Settings, folder: str, scorer: Scorer = edit_scorer, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(limit, set_type, src, tgt, score) over the candidate limits; finished ones are read back
    from ``folder``, under the settings' key."""
    out = None
    for limit in settings.candidate_limits:
        sets = resumable(spark, f"{folder}/{settings.key()}/map.{limit}", lambda n=limit: mapping_sets(align_both(src, tgt, settings, n, scorer, vectors)))
        sets = sets.select(F.lit(limit).alias("limit"), "set_type", "src", "tgt", "score")
        out = sets if out is None else out.unionByName(sets)
    return out


def validate_then_test(sets: DataFrame, val: DataFrame, test: DataFrame, val_ignored: DataFrame, test_ignored: DataFrame) -> DataFrame:
    """The best set and threshold on the validation mappings, evaluated on the test mappings."""
    best = best_row(evaluate(sets, val, val_ignored)).first()
    return evaluate(sets.where(F.col("set_type") == best["set_type"]), test, test_ignored, [best["threshold"]])


def by_setting(sets: DataFrame, reference: DataFrame, parts: DataFrame, ignored: DataFrame, at: list[float]) -> DataFrame:
    """Evaluation of (set_type, src, tgt, score) with the ignore list of either learning setting:
    all but the test mappings (``ss``, on the test mappings) or the validation mappings only (``us``,
    on all). ``parts`` is (src, tgt, split)."""
    part = lambda *names: parts.where(F.col("split").isin(*names)).select("src", "tgt")
    ss = evaluate(sets, part("test"), ignored.unionByName(part("val", "train")), at)
    us = evaluate(sets, reference, ignored.unionByName(part("val")), at)
    return ss.withColumn("setting", F.lit("ss")).unionByName(us.withColumn("setting", F.lit("us")))


def run_extension(mappings: DataFrame, src_edges: DataFrame, tgt_edges: DataFrame, src: DataFrame, tgt: DataFrame, settings: Settings, scorer: Scorer = edit_scorer) -> DataFrame:
    """(src, tgt, score): a mapping set with what extension adds to it."""
    return extended(mappings, extend(mappings, src_edges, tgt_edges, src, tgt, scorer, settings.extension_threshold, settings.extension_rounds))


def run_repair(mappings: DataFrame, src_edges: DataFrame, tgt_edges: DataFrame, reference: DataFrame, parts: DataFrame, ignored: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """A mapping set without conflicts among those of the repair threshold, and its evaluation there."""
    kept = repair(mappings.where(F.col("score") >= settings.repair_threshold), src_edges, tgt_edges)
    return kept, by_setting(kept.withColumn("set_type", F.lit("repaired")), reference, parts, ignored, [settings.repair_threshold])
