from __future__ import annotations

import hashlib
import threading

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as cp
from matchloom.llm import langid, mixing, spiece
from tests.llm.test_dedup import brute_groups, brute_print
from tests.llm.test_mixing import targets, words


def brute(rows, model):
    """The pipeline's rows over (doc_id, text, lang, source), stage by stage."""
    names, scores = model.predict([r[1] for r in rows])
    rows = [r for r, n, s in zip(rows, names, scores) if n != "und" and s >= langid.LEAST_SCORE]
    last = {}
    for r in rows:
        if r[1] not in last or last[r[1]][0] < r[0]:
            last[r[1]] = r
    rows = list(last.values())
    least = set(brute_groups({r[0]: brute_print(r[1]) for r in rows}).values())
    rows = [r for r in rows if r[0] in least]
    size: dict = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + words(r[1])
    target = targets(size)
    out = []
    sp = sentencepiece.SentencePieceProcessor(model_file=spiece.model_path())
    for source in size:
        key = f"{mixing.SEED}|{'true' if source is None else 'false'}|{source or ''}"
        u = int(hashlib.md5(key.encode()).hexdigest()[:5], 16) / 2**20
        rate = min(target[source] / size[source], 3.0)
        for n, r in enumerate(sorted((r for r in rows if r[3] == source), key=lambda r: (words(r[1]), r[0]))):
            out += [(r[0], r[2], r[3], tuple(sp.encode(r[1])))] * (int(u + rate * (n + 1)) - int(u + rate * n))
    return sorted(out)


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 250")
    odd = [(9001, None, "en", "src1", 0), (9002, "", "en", "src1", 0), (9003, "123 !!", "en", "src2", 6), (9004, "The of and that", None, "src3", 15), (9005, "the of and that", "en", "src3", 15)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("_row", F.lit("extra"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    got = sorted((r["doc_id"], r["lang"], r["source"], tuple(r["ids"])) for r in cp.run(spark, str(tmp_path)).collect())
    assert got == brute(rows, langid.train(docs))


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType, name
    assert [n for n, _ in cp.STAGES] == ["language", "exact", "near", "mix", "encode"]


def test_empty_documents(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).isEmpty()


def test_stages_delete_only_what_is_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    exact = cp.exact(spark, docs, "")
    n = exact.count()
    left = list(cp._left()[1])
    near = cp.near(spark, exact, "")  # reads the tables of the stage before, which is not written
    assert left and 0 < near.count() <= n and any(p in cp._left()[1] for p in left)
    again = cp.exact(spark, docs, "")  # no stage before it has left these
    assert near.count() <= n == again.count()
    other = threading.Thread(target=lambda: cp.mix(spark, docs, ""))
    other.start()
    other.join()
    assert again.count() == n  # another thread is another run
    cp.mix(spark, docs, "")  # reads none of them
    assert not any(p in cp._left()[1] for p in left)
