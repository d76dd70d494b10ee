"""Exact dedup by distributed MSD radix partitioning.

Documents are split into groups by successive digits of their bytes until a group has one
document or its texts have ended. The first digit is the length in bytes with the first
``WIDTHS[0]`` bytes, the next ones are ever longer slices. Only documents in groups of two or
more go on to the next digit. Texts are equal when all their digits are: no digest is compared.

A level counts its groups with a map-side combine (a group of copies is one row per task, however
large it is), then joins the counts back to the rows; both sides of the join are read from
shuffles (a merge join at every size), so that adaptive execution can split a hot group. Groups are named by their smallest
row id, so keys stay short.

Defined results: null text counts as empty; the row with the largest doc_id stays (null below
any); of rows that repeat both text and doc_id exactly one stays; further columns are kept by
``dedup`` and ignored by ``dedup_report``; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of the first digit, and the factor from one digit to the next.
FIRST, FACTOR = 32, 16


def _digit(data: Column, start: int, width: int) -> Column:
    return F.substring(data, start + 1, width)


def equal_groups(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``_doc_id, _sha``, the columns ``keep`` as ``_keep_i``, ``_row``
    (its row id), ``_best`` (struct of doc_id and row id of the row that stays), ``_n`` (rows
    with the same text).

    Texts are shuffled once, to meet the counts of the first digit; rows alone in their group are
    done then, with their columns, and only the others are joined again.
    """
    kept = [f"_keep_{i}" for i in range(len(keep))]
    base = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col("doc_id").alias("_doc_id"),
        F.col("text").alias("_text"),
        *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept) if c != "text"],
    )
    data = F.coalesce(F.col("_text"), F.lit("")).cast("binary")
    keyed = base.withColumn("_len", F.octet_length(data)).withColumn("_d", _digit(data, 0, FIRST))
    shared = keyed.groupBy("_len", "_d").agg(F.count("*").alias("_c")).where("_c > 1")
    shared = materialize(shared.withColumn("_group", F.monotonically_increasing_id()).select("_len", "_d", "_group"), "radix-groups")
    # all rows once; without columns to keep, only texts that further digits are taken of stay
    further = F.col("_group").isNotNull() & (F.col("_len") > FIRST)
    text = F.col("_text") if "text" in keep else F.when(further, F.col("_text"))
    others = [k for c, k in zip(keep, kept) if c != "text"]
    rows = keyed.join(shared.hint("merge"), ["_len", "_d"], "left").select("_row", "_doc_id", *others, "_len", "_group", F.sha2(data, 256).alias("_sha"), text.alias("_text"))
    rows = materialize(rows, "radix-rows")
    grouped = rows.where("_group is not null")
    live = grouped.select("_row", "_doc_id", "_len", "_group", F.when(F.col("_len") > FIRST, data).alias("_data"))
    done = [live.where(F.col("_len") <= FIRST).select("_row", "_doc_id", "_group", F.lit(0).alias("_level"))]
    live, start, width, level = live.where(F.col("_len") > FIRST), FIRST, FIRST * FACTOR, 0
    while not live.isEmpty():
        level += 1
        cut = live.withColumn("_d", _digit(F.col("_data"), start, width))
        shared = cut.groupBy("_group", "_d").agg(F.count("*").alias("_c"), F.min("_row").alias("_next")).where("_c > 1")
        shared = materialize(shared.select("_group", "_d", "_next"), "radix-groups")
        start, width = start + width, width * FACTOR
        live = materialize(
            cut.join(shared.hint("merge"), ["_group", "_d"]).select(
                "_row", "_doc_id", "_len", F.col("_next").alias("_group"),
                F.when(F.col("_len") > start, F.col("_data")).alias("_data"),
            ),
            "radix-live",
        )
        done.append(live.where(F.col("_len") <= start).select("_row", "_doc_id", "_group", F.lit(level).alias("_level")))
        live = live.where(F.col("_len") > start)
    members = done[0]
    for d in done[1:]:
        members = members.unionByName(d)
    best = members.groupBy("_level", "_group").agg(F.max(F.struct("_doc_id", "_row")).alias("_best"), F.count("*").alias("_n"))
    best = materialize(best, "radix-best")
    found = materialize(members.join(best, ["_level", "_group"]).select("_row", "_best", "_n"), "radix-found")
    alone, one = F.struct(F.col("_doc_id"), F.col("_row")), F.lit(1).cast("long")
    columns = ["_row", "_doc_id", "_sha", *[F.col("_text" if c == "text" else k).alias(k) for c, k in zip(keep, kept)]]
    single = rows.where("_group is null").select(*columns, alone.alias("_best"), one.alias("_n"))
    joined = grouped.join(found, "_row", "left")
    return single.unionByName(joined.select(*columns, F.coalesce("_best", alone).alias("_best"), F.coalesce("_n", one).alias("_n")))


def dedup_report(docs: DataFrame) -> DataFrame:
    """Per document, dropped ones too: which row of its equals stays and how many there are."""
    return equal_groups(docs).select(
        F.col("_doc_id").alias("doc_id"),
        F.col("_best._doc_id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_best._row") == F.col("_row")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The documents without those equal to a kept one; all columns as they were."""
    cols = tuple(docs.columns)
    out = equal_groups(docs, keep=cols).where(F.col("_best._row") == F.col("_row"))
    return out.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(cols)])
