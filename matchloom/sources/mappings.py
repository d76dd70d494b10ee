"""Mappings in files: TSV, alignment RDF, pipe-separated lines, and logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import abbreviate, expand
from ..model import MAPPING_TSV

_TSV = {"sep": "\t", "header": True, "quote": "", "nullValue": ""}


def read_mappings(spark: SparkSession, path: str, threshold: float = 0.0) -> DataFrame:
    """(src, tgt, score) of a TSV with header: unique pairs of ``threshold`` or more, each with its
    largest score. The words NULL, null and n/a are text."""
    rows = spark.read.options(**_TSV).schema(MAPPING_TSV).csv(path)
    rows = rows.select(F.col("Entity1").alias("src"), F.col("Entity2").alias("tgt"), F.col("Value").alias("score"))
    return rows.where(F.col("score") >= threshold).groupBy("src", "tgt").agg(F.max("score").alias("score"))


def read_last_scores(spark: SparkSession, path: str, threshold: float = 0.0) -> DataFrame:
    """As ``read_mappings``, but of repeated pairs the last line's score counts."""
    place = F.struct(F.input_file_name(), F.monotonically_increasing_id())
    rows = spark.read.options(**_TSV).schema(MAPPING_TSV).csv(path).withColumn("at", place).where(F.col("Value") >= threshold)
    return rows.groupBy(F.col("Entity1").alias("src"), F.col("Entity2").alias("tgt")).agg(F.max_by("Value", "at").alias("score"))


def write_mappings(mappings: DataFrame, path: str, value: float | None = None) -> None:
    """Write (src, tgt, score) as TSV with header; ``value`` stands for all scores if given."""
    score = F.col("score") if value is None else F.lit(value)
    mappings.select(F.col("src").alias("Entity1"), F.col("tgt").alias("Entity2"), score.alias("Value")).write.mode("overwrite").options(sep="\t", header=True, quote="").csv(path)


def write_label_pairs(pairs: DataFrame, path: str) -> None:
    """Write (sent1, sent2, label) as TSV."""
    pairs.select("sent1", "sent2", "label").write.mode("overwrite").options(sep="\t", header=True, quote="").csv(path)


RELATIONS = ("=", ">", "<")
_CELL = "entity1 struct<`_rdf:resource`: string>, entity2 struct<`_rdf:resource`: string>, measure struct<_VALUE: string>, relation struct<_VALUE: string>"


def read_rdf(spark: SparkSession, path: str) -> DataFrame:
    """(src, tgt, score, relation, legal) of the cells of an alignment: ``legal`` is true for the
    relations =, > and <, false for ?; cells with others are dropped."""
    # a schema that reads an element's text whether or not it has attributes
    cells = spark.read.format("xml").option("rowTag", "Cell").option("valueTag", "_VALUE").schema(_CELL).load(path)
    relation = F.trim("relation._VALUE")
    rows = cells.select(
        abbreviate(F.col("entity1.`_rdf:resource`")).alias("src"), abbreviate(F.col("entity2.`_rdf:resource`")).alias("tgt"),
        F.col("measure._VALUE").cast("double").alias("score"), relation.alias("relation"), relation.isin(*RELATIONS).alias("legal"),
    )
    return rows.where(F.col("legal") | (F.col("relation") == "?"))


def save_rdf_as_tsv(spark: SparkSession, path: str, out: str) -> None:
    """The legal and the other mappings of an alignment as two TSV folders."""
    rows = read_rdf(spark, path)
    write_mappings(rows.where("legal"), f"{out}_legal.tsv")
    write_mappings(rows.where("not legal"), f"{out}_illegal.tsv")


def pipe_lines(mappings: DataFrame) -> DataFrame:
    """(value): src|tgt|=|score|CLS with whole IRIs."""
    parts = [expand(F.col("src")), expand(F.col("tgt")), F.lit("="), F.col("score").cast("string"), F.lit("CLS")]
    return mappings.select(F.concat_ws("|", *parts).alias("value"))


def read_pipe(lines: DataFrame) -> DataFrame:
    """(src, tgt, relation, score) of lines (value) of exactly five fields; others are dropped."""
    parts = lines.select(F.split("value", r"\|").alias("p")).where(F.size("p") == 5)
    return parts.select(F.col("p")[0].alias("src"), F.col("p")[1].alias("tgt"), F.col("p")[2].alias("relation"), F.col("p")[3].cast("double").alias("score"))


#: The head and foot of an alignment document (fixed values of the format).
_RDF_HEAD = """<?xml version="1.0" encoding="utf-8"?>
<rdf:RDF xmlns="http://knowledgeweb.semanticweb.org/heterogeneity/alignment" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:xsd="http://www.w3.org/2001/XMLSchema#">
<Alignment><xml>yes</xml><level>0</level><type>??</type>"""
_RDF_FOOT = "</Alignment></rdf:RDF>"


def rdf_cells(mappings: DataFrame) -> DataFrame:
    """(value): a map element per (src, tgt, score) with whole IRIs; the relation is always =."""

    def escaped(c: str) -> F.Column:
        return F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))

    cell = '<map><Cell><entity1 rdf:resource="%s"/><entity2 rdf:resource="%s"/><measure rdf:datatype="http://www.w3.org/2001/XMLSchema#float">%s</measure><relation>=</relation></Cell></map>'
    return mappings.select(F.format_string(cell, escaped("src"), escaped("tgt"), F.col("score").cast("string")).alias("value"))


def write_rdf(mappings: DataFrame, path: str) -> None:
    """Write an alignment as one text file in a folder: whoever writes RDF wants one document, so
    its lines go to one task, which streams them."""
    spark = mappings.sparkSession
    line = lambda s, k: spark.createDataFrame([(k, s)], "k int, value string")
    rows = line(_RDF_HEAD, 0).unionByName(rdf_cells(mappings).select(F.lit(1).alias("k"), "value")).unionByName(line(_RDF_FOOT, 2))
    rows.coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)


def rdf_template(document: str) -> str:
    """An alignment document without its mappings."""
    return re.sub(r"\s*<map>.*</map>\s*", "\n", document, flags=re.S)


def read_repaired(spark: SparkSession, path: str) -> DataFrame:
    """(src, tgt, score) of a TSV without header and with whole IRIs, abbreviated."""
    rows = spark.read.options(sep="\t", header=False, quote="").schema(MAPPING_TSV).csv(path)
    return rows.select(abbreviate(F.col("Entity1")).alias("src"), abbreviate(F.col("Entity2")).alias("tgt"), F.col("Value").alias("score"))


#: A log line's mapping (a fixed pattern of the format).
_LOG = r"\[(SRC|TGT):.*Mapping: [(\[]'(.+)', '(.+)', (.+)[)\]]\]"


def read_log(lines: DataFrame, keep: int = 1) -> DataFrame:
    """(direction, src, tgt, score, rank) of log lines (value): the best ``keep`` per class of
    either direction by score as a number. A TGT line has the target class first."""
    part = lambda k: F.regexp_extract("value", _LOG, k)
    rows = lines.where(F.col("value").rlike(_LOG)).select(part(1).alias("direction"), part(2).alias("own"), part(3).alias("other"), part(4).cast("double").alias("score"))
    order = Window.partitionBy("direction", "own").orderBy(F.desc("score"), "other")
    kept = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    forward = F.col("direction") == "SRC"
    return kept.select("direction", F.when(forward, F.col("own")).otherwise(F.col("other")).alias("src"), F.when(forward, F.col("other")).otherwise(F.col("own")).alias("tgt"), "score", "rank")
