"""Helpers that the training-data operators share: shared tables, ranks, settings."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the cluster
    names one, else a folder of the warehouse; a temporary folder of our own only in local mode,
    where driver and executors are one process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        own = tempfile.mkdtemp(prefix="matchloom-") if sc.master.split("[")[0] == "local" else spark.conf.get("spark.sql.warehouse.dir") + "/matchloom-checkpoints"
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return sc.getCheckpointDir()


#: Per thread: lists for the paths written by ``materialize``, of callers that ask for them.
_asked = threading.local()


@contextmanager
def written_paths() -> Iterator[list[str]]:
    """Lists the paths that ``materialize`` writes meanwhile."""
    paths: list[str] = []
    before = getattr(_asked, "lists", [])
    _asked.lists = [*before, paths]
    try:
        yield paths
    finally:
        _asked.lists = before


def discard(spark: SparkSession, paths: list[str], still_used: DataFrame) -> None:
    """Delete tables of ``materialize`` that are of no more use, and take them off the list; those
    that ``still_used`` reads from stay."""
    used = still_used.inputFiles() if paths else []
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in list(paths):
        if not any(path.rpartition("/")[2] in f for f in used):
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
            paths.remove(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage, fixes row ids, gives the planner true sizes, and survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in getattr(_asked, "lists", []):
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of the rows that a Python worker gets at once (one row if it has more).
BATCH_BYTES = 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes: whole texts can be long, and a worker holds a batch at a
    time. All operators set the same bound, so plans of several may run in any order."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def word_count(text: Column) -> Column:
    """Number of words, as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def global_rank(df: DataFrame, order: Sequence[str], name: str, rank: str = "_rank") -> DataFrame:
    """``df`` with ``rank``: 0, 1, 2, ... in the order of the columns ``order``.

    Rows are dealt by range, sorted in each range and written once, with their place in the
    range; the counts of the ranges (one row per partition) give each range its start. No task
    holds more than a range, whatever a key's share is, as long as ``order`` tells rows apart.
    """
    slot = "_slot"
    placed = materialize(
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn(slot, F.monotonically_increasing_id()),
        name,
    )
    part = F.shiftright(F.col(slot), 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).collect()  # a row per partition
    start, at = {}, 0
    for r in sorted(counts, key=lambda r: r["_part"]):
        start[r["_part"]] = at
        at += r["_n"]
    starts = df.sparkSession.createDataFrame(list(start.items()) or [(0, 0)], "_part long, _start long")
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")  # a row per partition
        .withColumn(rank, F.col("_start") + F.col(slot).bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_start", slot)
    )
