"""Mixing sources to target weights by systematic sampling.

Each source's share of the words is its weight's; a target stops at ``max_repeat`` times its
source's size and the excess goes to the others by weight. Within a source every document has
the same expected number of copies, target / size. Documents stand in the order of (size,
doc_id), the expected copies are prefix-summed, one random offset is added, and a document is
emitted once for each integer boundary that its step crosses. As neighbours have like sizes,
the words taken come near the target.

Defined results: null text has size 0; null source is a source of its own, last in order;
a source of size 0 has target 0 and nothing is taken; rows that repeat a doc_id are rows of
their own, and of equal size and doc_id in any order (they have as many words); very long texts
are counted whole; empty tables give empty results; further columns are ignored by ``mix_report`` and
kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_rank, materialize, word_count

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SEED = 20


def _rates(sizes: DataFrame, weights: Sequence[int], max_repeat: int, seed: int) -> DataFrame:
    """A row per source: its size, target, expected copies of a document, offset, first rank.

    The targets are min(max_repeat * size, weight * level) for the one level at which they sum
    to all sizes. Each round takes the sources that stand above their limit at the current
    level as stopped and raises the level for the rest, from one aggregate row.
    """
    per = sizes.groupBy("_source").agg(F.sum("_size").alias("_source_size"), F.min("_rank").alias("_first"))
    per = per.withColumn("_last", F.col("_source").isNull()).withColumn("_key", F.coalesce("_source", F.lit("")))
    per = global_rank(per, ["_last", "_key"], "mix-sources", "_nth")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_nth") % len(weights)).cast("int") + 1)
    per = materialize(per.withColumn("_w", w), "mix-weights")
    cap = F.col("_source_size") * float(max_repeat)
    total = per.agg(F.sum("_source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        # at the first round (level 0) nothing stands above its limit but sources without words
        over = cap <= F.col("_w") * level
        row = per.agg(
            F.sum(over.cast("long")).alias("n"),
            F.sum(F.when(over, cap).otherwise(0.0)).alias("full"),
            F.sum(F.when(over, 0.0).otherwise(F.col("_w"))).alias("w"),
        ).first()
        if row["n"] is None or row["n"] == stopped or not row["w"]:
            break
        stopped, level = row["n"], max(level, (total - row["full"]) / row["w"])
    target = F.least(cap, F.col("_w") * F.lit(level))
    rate = F.when(F.col("_source_size") > 0, F.least(target / F.col("_source_size"), F.lit(float(max_repeat)))).otherwise(0.0)
    # a multiple of 2**-20, so that adding it to a large prefix sum stays exact
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_last").cast("string"), "_key")), 1, 5)
    offset = F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 20))
    return materialize(
        per.select("_last", "_key", F.col("_source_size"), target.alias("_target"), rate.alias("_rate"), offset.alias("_offset"), "_first"),
        "mix-rates",
    )


def mix_plan(docs: DataFrame, keep: Sequence[str] = (), weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """One row per document: ``_doc_id, _source, _size, _source_size, _target, _copies`` and the
    columns ``keep`` as ``_keep_i``.

    Words are counted once. Only sizes and ids are dealt by range: ranges of equal rows differ in
    bytes, as those of large documents come last. The columns ``keep`` meet the copies by row id.
    """
    kept = [f"_keep_{i}" for i in range(len(keep))]
    sized = docs.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)],
        F.col("doc_id").alias("_doc_id"),
        F.col("source").alias("_source"),
        word_count(F.col("text")).alias("_size"),
        F.monotonically_increasing_id().alias("_row"),
    )
    sized = materialize(sized, "mix-sized")
    placed = sized.drop(*kept).withColumn("_last", F.col("_source").isNull()).withColumn("_key", F.coalesce("_source", F.lit("")))
    ranked = global_rank(placed, ["_last", "_key", "_size", "_doc_id"], "mix-rank")
    rates = _rates(ranked.select("_source", "_size", "_rank"), weights, max_repeat, seed)
    nth = F.col("_rank") - F.col("_first")
    crossed = F.floor(F.col("_offset") + F.col("_rate") * (nth + 1)) - F.floor(F.col("_offset") + F.col("_rate") * nth)
    plan = ranked.join(rates, ["_last", "_key"]).select(
        "_row", "_doc_id", "_source", "_size", "_source_size", "_target", crossed.cast("long").alias("_copies"),
    )
    return sized.select("_row", *kept).join(plan.hint("merge"), "_row").drop("_row") if keep else plan.drop("_row")


def mix_report(docs: DataFrame, **kw) -> DataFrame:
    """Per document its size, its source's size and target, and the words the mix takes of it."""
    return mix_plan(docs, **kw).select(
        F.col("_doc_id").alias("doc_id"),
        F.col("_source").alias("source"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: each document as many times as its step crosses a boundary."""
    plan = mix_plan(docs, keep=docs.columns, **kw)
    copies = plan.withColumn("_one", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))))
    return copies.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(docs.columns)])
