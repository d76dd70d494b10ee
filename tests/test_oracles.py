from __future__ import annotations

import itertools
import os

import pytest
from pyspark.sql import functions as F

from matchloom.plans import oracles, queries
from tests.helpers import TABLES, duck, rows

SF = "/root/testdata/sf0.001"
#: Queries that need more pairs than the smallest tables give.
LARGER = {"finetune_ss": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_oracle(spark, name):
    sf_dir = LARGER.get(name, SF)
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), duck(sf_dir).execute(oracles.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["finetune_ss", "finetune_us"])
def test_fine_tuning_data_of_parts_with_every_type(spark, tmp_path, name):
    """Classes with every type have more synonyms than their siblings have other pairs: all of these are taken."""
    made = itertools.product(("hot bolt", "old ring", "blue ring", "large plate"), ("Brand#1", "Brand#2", "Brand#13"), ("SMALL", "LARGE", "PROMO", "STANDARD"), range(2))
    part = spark.createDataFrame([(k, *row[:3]) for k, row in enumerate(made)], "p_partkey long, p_name string, p_brand string, p_type string")
    for t in TABLES:
        part.write.parquet(f"{tmp_path}/part.parquet") if t == "part" else os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    kinds = {r["kind"]: r["n_pairs"] for r in queries.corpus_stats(spark, str(tmp_path)).collect()}
    assert 0 < kinds["hard"] < kinds["synonym"]
    got, want = queries.queries()[name](spark, str(tmp_path)).toPandas(), duck(str(tmp_path)).execute(oracles.oracle_sql()[name]).fetchdf()
    assert rows(got) == rows(want) and len(got) > 0


def test_learned_scorer_is_better_than_the_majority(spark):
    row = queries.train_lexical_scorer(spark, SF).first()
    pairs = queries.corpus_pairs(spark, SF)
    negative = pairs.where("label = 0").count() / pairs.count()
    assert row["accuracy"] > max(negative, 1 - negative)


def test_learned_alignment(spark):
    out = queries.align_learned(spark, SF)
    assert out.where("score <= 0 or score > 1").isEmpty()
    own = F.when(F.col("direction") == "SRC", F.col("src")).otherwise(F.col("tgt"))
    assert out.groupBy("direction", own).count().where("count > 1").isEmpty() and out.select("direction").distinct().count() == 2
