"""OWL files (RDF/XML) to class and edge tables, and bundles of prepared hierarchies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import Tokenizer, abbreviate, fold_labels, word_tokens
from ..model import ROOT
from ..operators.index import postings


def _schema(properties: Sequence[str]) -> T.StructType:
    # what a property holds is text, alone or with attributes such as a language
    text = T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_xml:lang", T.StringType())])
    parent = T.StructType([T.StructField("_rdf:resource", T.StringType())])
    fields = [T.StructField("_rdf:about", T.StringType()), T.StructField("rdfs:subClassOf", T.ArrayType(parent))]
    return T.StructType([*fields, *[T.StructField(p, T.ArrayType(text)) for p in properties]])


def read_owl(spark: SparkSession, path: str, onto: str, properties: Sequence[str] = ("rdfs:label",)) -> tuple[DataFrame, DataFrame]:
    """(classes, edges) of an OWL file.

    classes: onto, iri, labels (normalised, in the order of the properties, without repeats;
    empty for classes without); edges: onto, child, parent between named classes. IRIs are
    abbreviated where their namespace is known. Elements must have the prefixes owl, rdf and
    rdfs; restrictions and other unnamed parents are left out, as is the root.
    """
    raw = spark.read.format("xml").option("rowTag", "owl:Class").schema(_schema(properties)).load(path).where(F.col("`_rdf:about`").isNotNull())
    texts = [F.transform(F.col(f"`{p}`"), lambda x: x["_VALUE"]) for p in properties]
    classes = raw.select(F.lit(onto).alias("onto"), abbreviate(F.col("`_rdf:about`")).alias("iri"), fold_labels(texts).alias("labels"))
    classes = classes.where(F.col("iri") != ROOT).groupBy("onto", "iri").agg(F.flatten(F.collect_list("labels")).alias("labels")).withColumn("labels", F.array_distinct("labels"))
    up = F.explode(F.transform(F.col("`rdfs:subClassOf`"), lambda x: x["_rdf:resource"]))
    edges = raw.select(F.lit(onto).alias("onto"), F.col("`_rdf:about`").alias("child"), up.alias("parent"))
    edges = edges.where(F.col("parent").isNotNull() & (F.col("parent") != ROOT) & (F.col("child") != ROOT))
    return classes, edges.select("onto", abbreviate(F.col("child")).alias("child"), abbreviate(F.col("parent")).alias("parent")).distinct()


def class_labels(classes: DataFrame) -> DataFrame:
    """(onto, iri, label), a row per label; classes without labels have none."""
    return classes.select("onto", "iri", F.explode("labels").alias("label"))


@dataclass
class Bundle:
    """A prepared hierarchy: classes, edges and the inverted index of the labels."""

    classes: DataFrame
    edges: DataFrame
    index: DataFrame

    @classmethod
    def of(cls, classes: DataFrame, edges: DataFrame, tokenizer: Tokenizer = word_tokens, cut: int = 0) -> Bundle:
        return cls(classes, edges, postings(class_labels(classes), tokenizer, cut))

    def save(self, path: str) -> None:
        for name in ("classes", "edges", "index"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bundle | None:
        """The bundle of a folder; None if a table is missing."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for name in ("classes", "edges", "index"):
            done = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
            if not done.getFileSystem(conf).exists(done):
                return None
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in ("classes", "edges", "index")])
