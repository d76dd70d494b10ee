"""Corpus pipeline: documents to token ids, in five stages that each write a table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to
the folder that driver and executors share and reads it back as the next stage's docs. Columns
that a table has beyond those of ``documents`` go along unread.

language: texts without letters or without a likely language go.
exact: of equal texts the one with the largest doc_id stays.
near: of each group of near copies the document with the least doc_id stays.
mix: sources come to their target weights; a document is there as often as the mix takes it.
encode: every text's SentencePiece ids; the last stage's columns are doc_id, lang, source,
n_tokens and ids.

Null or empty texts go in the first stage; an empty table stays empty through all stages.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import langid, mixing, radix_dedup, simhash, spiece
from matchloom.llm.common import discard, materialize, written_paths

#: Per thread, so that runs at the same time keep apart: tables that each stage has left in the
#: shared folder, by the stage's place.
_run = threading.local()


def _left() -> dict[int, list[str]]:
    if not hasattr(_run, "left"):
        _run.left = {}
    return _run.left


def _stage(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what the stages before it have left: by then their rows are
    written and read again, unless docs still reads the tables."""

    @wraps(stage)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        place = [name for name, _ in STAGES].index(stage.__name__)
        for before, paths in _left().items():
            if before < place:
                discard(spark, paths, docs)
        with written_paths() as paths:
            out = stage(spark, docs, sf_dir)
        _left().setdefault(place, []).extend(paths)
        return out

    return staged


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return radix_dedup.dedup(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = spiece.encode(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: SQL cannot express the stages' models; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
