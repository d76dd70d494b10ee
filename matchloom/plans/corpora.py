"""The corpora of an alignment task as one call, and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import checkpointed
from ..operators import corpora as co
from ..operators.graph import depth
from ..sources.config import Settings

PARTS = ("train", "val", "test")
NAMES = ("src", "tgt", "merged", "full", *PARTS)


def within(labels: DataFrame, edges: DataFrame, settings: Settings) -> DataFrame:
    """The corpus of one hierarchy: synonyms, soft and hard non-synonyms."""
    known = checkpointed(co.synonyms(labels))
    deep = None if settings.depth_threshold is None else depth(edges, settings.depth_strategy)
    hard = co.hard_nonsynonyms(labels, edges, known, deep, settings.depth_threshold)
    return co.corpus(known, co.soft_nonsynonyms(labels, known, settings.sample_rate), hard)


def across(mappings: DataFrame, src: DataFrame, tgt: DataFrame, settings: Settings) -> DataFrame:
    """The corpus of a set of mappings: synonyms and soft non-synonyms."""
    known = checkpointed(co.cross_synonyms(mappings, src, tgt))
    return co.corpus(known, co.cross_soft_nonsynonyms(mappings, src, tgt, known, settings.sample_rate))


def assemble(src: DataFrame, tgt: DataFrame, src_edges: DataFrame, tgt_edges: DataFrame, reference: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """(a, b, kind) for each of ``NAMES``: either hierarchy's corpus, both merged, and those of all
    reference mappings and of their train, val and test parts."""
    shares = dict(zip(PARTS, (settings.train_share, settings.val_share, settings.test_share)))
    maps = checkpointed(co.split(reference.select("src", "tgt").distinct(), ["src", "tgt"], shares))
    out = {"src": checkpointed(within(src, src_edges, settings)), "tgt": checkpointed(within(tgt, tgt_edges, settings))}
    out |= {"merged": co.merge(out["src"], out["tgt"]), "full": across(maps, src, tgt, settings)}
    return out | {part: across(maps.where(F.col("split") == part), src, tgt, settings) for part in PARTS}


def save(corpora: dict[str, DataFrame], folder: str) -> None:
    """A Parquet folder for each corpus."""
    for name, pairs in corpora.items():
        pairs.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, names: tuple[str, ...] = NAMES) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
