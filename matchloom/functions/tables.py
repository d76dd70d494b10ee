"""Table helpers: dense indexes and checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dense_index(df: DataFrame, key: Sequence[str], by: Sequence[str] = (), name: str = "idx") -> DataFrame:
    """``df`` with 0, 1, 2, ... per ``by`` in the order of the MD5 of the columns ``key``.

    Rows are numbered within 4096 buckets of the hash in parallel; the starts of the buckets are
    a table of at most 4096 rows per value of ``by``.
    """
    code = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key]))
    coded = df.withColumn("_code", code).withColumn("_bucket", F.substring("_code", 1, 3))
    counts = coded.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*by, "_bucket").orderBy("_code", *key)
    numbered = coded.withColumn("_nth", F.row_number().over(inside) - 1)
    out = numbered.join(starts, [*by, "_bucket"]).withColumn(name, (F.col("_start") + F.col("_nth")).cast("long"))
    return out.drop("_code", "_bucket", "_start", "_nth")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of ``spark.checkpoint.dir``, else one of the
    warehouse; a temporary folder only in local mode, where all is one process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        own = tempfile.mkdtemp(prefix="matchloom-") if sc.master.split("[")[0] == "local" else spark.conf.get("spark.sql.warehouse.dir") + "/matchloom-checkpoints"
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is not in use."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ordered_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the distinct values of ``key`` with numbers that ascend with them."""
    return checkpointed(df.select(key).distinct().orderBy(key).withColumn(name, F.monotonically_increasing_id()))
