"""Evaluation of mapping sets: precision, recall, F1 over sets and thresholds in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import checkpointed

#: (start, end, parts): evenly spaced thresholds of the validation grid, ends included.
GRID = ((0.0, 0.8, 8), (0.9, 0.97, 7), (0.98, 1.0, 20))
SET_ORDER = ("combined", "src", "tgt")


def thresholds(grid: tuple[tuple[float, float, int], ...] = GRID) -> list[float]:
    return sorted({round(a + (b - a) * k / n, 6) for a, b, n in grid for k in range(n + 1)})


def unique_mappings(mappings: DataFrame, *by: str) -> DataFrame:
    """One row per pair (and ``by``), with its largest score."""
    return mappings.groupBy(*by, "src", "tgt").agg(F.max("score").alias("score"))


def scores(tp: Column, n_pred: Column, n_ref: Column, places: int = 3) -> list[Column]:
    """Precision, recall and F1; 0 where there is nothing to divide by."""
    p = F.when(n_pred > 0, tp / n_pred).otherwise(0.0)
    r = F.when(n_ref > 0, tp / n_ref).otherwise(0.0)
    f1 = F.when(tp > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return [F.round(p, places).alias("p"), F.round(r, places).alias("r"), F.round(f1, places).alias("f1")]


def evaluate(sets: DataFrame, reference: DataFrame, ignored: DataFrame | None = None, at: list[float] | None = None) -> DataFrame:
    """(set_type, threshold, n_mappings, n_ignored, p, r, f1) of (set_type, src, tgt, score).

    Pairs of a class with itself count as ignored. n_mappings counts what reaches the threshold
    without those; n_ignored counts those and ignored pairs among predictions and references
    (one in both counts twice). All thresholds come from one join and one aggregate: a pair counts
    for each threshold up to its score.
    """
    levels = thresholds() if at is None else at
    ref = reference.select("src", "tgt").distinct().withColumn("in_ref", F.lit(True))
    none = reference.sparkSession.createDataFrame([], "src string, tgt string")
    ign = (none if ignored is None else ignored.select("src", "tgt")).distinct().withColumn("in_ign", F.lit(True))
    ref = ref.join(ign, ["src", "tgt"], "left")
    totals = ref.agg(F.count(F.when(F.col("in_ign").isNull(), 1)).alias("n_ref"), F.count("in_ign").alias("ref_ign"))
    pred = unique_mappings(sets, "set_type").join(ref.select("src", "tgt", "in_ref"), ["src", "tgt"], "left").join(ign, ["src", "tgt"], "left")
    same = F.col("src") == F.col("tgt")
    grid = F.explode(F.array(*[F.lit(x) for x in levels])).alias("threshold")
    marked = pred.select("set_type", "score", same.alias("same"), F.col("in_ref").isNotNull().alias("hit"), F.col("in_ign").isNotNull().alias("skip"))
    # counts per score first: the grid multiplies distinct scores, not mappings
    counted = marked.groupBy("set_type", "score").agg(
        F.count(F.when(~F.col("same"), 1)).alias("n"), F.count(F.when(F.col("same"), 1)).alias("n_same"),
        F.count(F.when(~F.col("same") & F.col("skip"), 1)).alias("n_skip"), F.count(F.when(~F.col("same") & ~F.col("skip") & F.col("hit"), 1)).alias("tp"),
    )
    counted = checkpointed(counted)  # a row per set and score, so that predictions are worked out once
    sets_and_levels = counted.select("set_type").distinct().select("set_type", grid)
    summed = counted.join(F.broadcast(sets_and_levels), "set_type").where(F.col("score") >= F.col("threshold")).groupBy("set_type", "threshold").agg(  # a few rows
        *[F.sum(c).alias(c) for c in ("n", "n_same", "n_skip", "tp")]
    )
    full = sets_and_levels.join(summed, ["set_type", "threshold"], "left").na.fill(0).crossJoin(F.broadcast(totals))  # one row
    return full.select(
        "set_type", "threshold", F.col("n").alias("n_mappings"), (F.col("n_same") + F.col("n_skip") + F.col("ref_ign")).alias("n_ignored"),
        *scores(F.col("tp"), F.col("n") - F.col("n_skip"), F.col("n_ref")),
    )


def best_row(evaluation: DataFrame) -> DataFrame:
    """The row of the best rounded F1; of equals the lowest threshold, then combined, src, tgt."""
    order = F.array_position(F.array(*[F.lit(s) for s in SET_ORDER]), F.col("set_type"))
    key = F.struct(F.col("f1"), -F.col("threshold"), -order)
    return evaluation.agg(F.max_by(F.struct(*evaluation.columns), key).alias("x")).where("x is not null").select("x.*")


def string_match_rows(evaluation: DataFrame) -> DataFrame:
    """The rows of threshold 1: mappings that share a label."""
    return evaluation.where(F.col("threshold") == 1.0)


def long_form(evaluation: DataFrame) -> DataFrame:
    """(set_type, threshold, metric, value) for plots."""
    return evaluation.unpivot(["set_type", "threshold"], ["p", "r", "f1"], "metric", "value")


def report_lines(evaluation: DataFrame, latex: bool = False) -> DataFrame:
    """(set_type, threshold, line): rows for a report, plain or as rows of a LaTeX table."""
    three = lambda c: F.format_string("%.3f", F.col(c))
    cells = ["set_type", F.format_string("%.6f", F.col("threshold")), F.col("n_mappings").cast("string"), F.col("n_ignored").cast("string"), three("p"), three("r"), three("f1")]
    line = F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")) if latex else F.concat_ws("\t", *cells)
    return evaluation.select("set_type", "threshold", line.alias("line"))


def without_identity(mappings: DataFrame) -> DataFrame:
    """Mappings between different IRIs."""
    return mappings.where(F.col("src") != F.col("tgt"))
