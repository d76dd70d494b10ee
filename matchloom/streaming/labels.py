"""Incremental matching: a stream of class labels against a prepared hierarchy (an extra)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_label


def match_stream(stream: DataFrame, target: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(src, tgt, ts) of new classes (iri, label, ts) that share a label with a target class.

    A stream-static join on the label, then one row per pair within the watermark."""
    known = target.select(F.col("iri").alias("tgt"), "label").distinct()
    rows = stream.withWatermark(time, late).select(F.col("iri").alias("src"), normalize_label(F.col("label")).alias("label"), F.col(time).alias("ts"))
    return rows.join(known, "label").select("src", "tgt", "ts").dropDuplicatesWithinWatermark(["src", "tgt"])
