"""Hierarchies made from the test tables, so that every stage has whole tables to run on.

Parts make two hierarchies, SRC of the even and TGT of the odd keys: a class is a name with a
brand, its labels are brand with name and type with name (turned round in TGT); its parent is the
name, whose parent is the name's last word. Suppliers (SRC) and customers (TGT) under nations
under regions make two more; every second supplier stands under its region as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_int, normalize_label


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of(side: str) -> str:
    return {"SRC": "obo:", "TGT": "ordo:"}[side]


def _parts(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where(F.col("p_partkey") % 2 == (0 if side == "SRC" else 1))
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return part.select(F.concat(F.lit(_of(side)), name, F.lit("."), F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))).alias("iri"), name.alias("name"), "p_brand", "p_type")


def class_annotations(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """(onto, iri, brand, kind): raw label properties, a row per part."""
    kind = F.concat_ws("_", "p_type", "name") if side == "SRC" else F.concat_ws("_", "name", "p_type")
    return _parts(spark, sf_dir, side).select(F.lit(side).alias("onto"), "iri", F.concat_ws("_", "p_brand", "name").alias("brand"), kind.alias("kind"))


def class_labels(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """(onto, iri, label)"""
    raw = class_annotations(spark, sf_dir, side)
    return raw.select("onto", "iri", F.explode(F.array("brand", "kind")).alias("text")).select("onto", "iri", normalize_label(F.col("text")).alias("label")).distinct()


def class_edges(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """(child, parent) of the parts' hierarchy."""
    parts = _parts(spark, sf_dir, side)
    up = F.concat(F.lit(_of(side)), F.col("name"))
    top = F.concat(F.lit(_of(side)), F.element_at(F.split("name", "_"), -1))
    return parts.select(F.col("iri").alias("child"), up.alias("parent")).unionByName(parts.select(up.alias("child"), top.alias("parent"))).distinct()


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, tgt, score): classes of the same name and brand."""
    s, t = class_labels(spark, sf_dir, "SRC").select("iri").distinct(), class_labels(spark, sf_dir, "TGT").select("iri").distinct()
    key = lambda c: F.substring_index(c, ":", -1)
    return s.select(F.col("iri").alias("src"), key("iri").alias("k")).join(t.select(F.col("iri").alias("tgt"), key("iri").alias("k")), "k").select("src", "tgt", F.lit(1.0).alias("score"))


def ignored(reference_: DataFrame) -> DataFrame:
    """An ignore list: the references whose hash divides by seven."""
    return reference_.where(hash_int("ignored", F.col("src"), F.col("tgt")) % 7 == 0).select("src", "tgt")


def _id(side: str, kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{_of(side)}{kind}."), F.col(key).cast("string"))


def place_edges(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """(child, parent) of suppliers or customers, nations and regions."""
    nation = table(spark, sf_dir, "nation")
    out = nation.select(_id(side, "n", "n_nationkey").alias("child"), _id(side, "r", "n_regionkey").alias("parent"))
    if side == "TGT":
        return out.unionByName(table(spark, sf_dir, "customer").select(_id(side, "c", "c_custkey").alias("child"), _id(side, "n", "c_nationkey").alias("parent")))
    supplier = table(spark, sf_dir, "supplier")
    out = out.unionByName(supplier.select(_id(side, "s", "s_suppkey").alias("child"), _id(side, "n", "s_nationkey").alias("parent")))
    second = supplier.where(F.col("s_suppkey") % 2 == 0).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return out.unionByName(second.select(_id(side, "s", "s_suppkey").alias("child"), _id(side, "r", "n_regionkey").alias("parent")))


def place_labels(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """(onto, iri, label): one label each; companies are named by their number."""
    leaf, name, key, kind = ("supplier", "s_name", "s_suppkey", "s") if side == "SRC" else ("customer", "c_name", "c_custkey", "c")
    rows = table(spark, sf_dir, leaf).select(_id(side, kind, key).alias("iri"), F.concat(F.lit("company "), F.substring_index(name, "#", -1)).alias("label"))
    rows = rows.unionByName(table(spark, sf_dir, "nation").select(_id(side, "n", "n_nationkey").alias("iri"), normalize_label(F.col("n_name")).alias("label")))
    rows = rows.unionByName(table(spark, sf_dir, "region").select(_id(side, "r", "r_regionkey").alias("iri"), normalize_label(F.col("r_name")).alias("label")))
    return rows.select(F.lit(side).alias("onto"), "iri", "label")


def place_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, tgt, score): mappings to extend, of the nations with even keys."""
    nation = table(spark, sf_dir, "nation").where(F.col("n_nationkey") % 2 == 0)
    return nation.select(_id("SRC", "n", "n_nationkey").alias("src"), _id("TGT", "n", "n_nationkey").alias("tgt"), F.lit(1.0).alias("score"))


def place_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, tgt, score): mappings with conflicts to repair: companies of the same number, and
    nations, of which every third is mapped to the next."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    same = s.join(c, F.col("s_suppkey") == F.col("c_custkey")).select(_id("SRC", "s", "s_suppkey").alias("src"), _id("TGT", "c", "c_custkey").alias("tgt"))
    n = table(spark, sf_dir, "nation").withColumn("other", (F.col("n_nationkey") + F.when(F.col("n_nationkey") % 3 == 0, 1).otherwise(0)) % 25)
    rows = same.unionByName(n.select(_id("SRC", "n", "n_nationkey").alias("src"), _id("TGT", "n", "other").alias("tgt")))
    return rows.withColumn("score", (F.lit(900) + hash_int("score", F.col("src"), F.col("tgt")) % 100) / 1000)
