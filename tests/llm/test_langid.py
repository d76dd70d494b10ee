from __future__ import annotations

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from matchloom.llm import langid
from matchloom.llm.queries import queries

SF = "/root/testdata/sf0.01"


def brute_bits(texts: list[bytes], symbols: dict[int, int], size: int, contexts: set[bytes], line: bytes, order: int) -> float:
    """PPM with exclusion, byte by byte, from counts of whole texts; ``contexts`` are the kept."""

    def counts(c: bytes) -> dict[int, int]:
        out: dict[int, int] = {}
        for t in texts:
            for i in range(len(c), len(t)):
                if t[i - len(c) : i] == c:
                    out[symbols[t[i]]] = out.get(symbols[t[i]], 0) + 1
        return out

    def p(c: bytes, s: int) -> float:
        lower = (lambda x: p(c[1:], x)) if c else (lambda x: 1 / size)
        n = counts(c)
        if not n:
            return lower(s)
        total, kinds = sum(n.values()), len(n)
        rest = sum(lower(x) for x in range(size) if x not in n)
        escape = kinds / (total + kinds) if rest > 0 else 0.0
        return n[s] / total * (1 - escape) if s in n else escape * lower(s) / rest

    bits = 0.0
    for i, b in enumerate(line):
        c = b""
        for k in range(1, min(order, i) + 1):
            if line[i - k : i] not in contexts:
                break
            c = line[i - k : i]
        bits -= math.log2(p(c, symbols.get(b, 0)))
    return bits


def test_code_lengths_equal_brute_force():
    texts = {"a": [b" abracadabra ", b" abra "], "b": [b" banana band "]}
    order = 2
    model = langid.PPM(texts, order)
    all_ = [t for n in sorted(texts) for t in texts[n]]
    seen = sorted({b for t in all_ for b in t})
    symbols = {b: i + 1 for i, b in enumerate(seen)}
    met: dict[bytes, int] = {}
    for t in all_:
        for i in range(len(t)):
            for k in range(1, min(order, i) + 1):
                met[t[i - k : i]] = met.get(t[i - k : i], 0) + 1
    contexts = {c for c, n in met.items() if n > 1}
    lines = [b" abra ", b" bandana ", b" xyz ", b" "]
    got = model.lengths(lines)
    for row, line in zip(got, lines):
        for k, name in enumerate(sorted(texts)):
            assert math.isclose(row[k], brute_bits(texts[name], symbols, len(seen) + 1, contexts, line, order), rel_tol=1e-4)


def test_probabilities_sum_to_one():
    model = langid.PPM({"a": [b" the cat sat on the mat "], "b": [b" le chat est la "]})
    sums = np.exp2(-model.bits.astype(float)).reshape(-1, model.size, 2).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.predict_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_labels_of_held_out_rows_and_ids_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    wrong = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    get = lambda d: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict_report(d).collect())
    assert get(docs) == get(wrong)


def test_edge_texts(spark):
    rows = [(1, "the of and that with", "en"), (3, "le la des est dans pour", "fr")] * 3
    odd = [(100, None, "en"), (101, "", None), (102, "123 !!! — \U0001f600", "en"), (103, "THE OF AND THAT", None), (None, "des est", None), (104, "the of " * 100_000, None), (105, "日本語", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict_report(docs).where("doc_id is null or doc_id >= 100").collect()}
    assert [got[k]["lang_pred"] for k in (100, 101, 102)] == ["und"] * 3 and got[100]["score"] == 0
    assert got[103]["lang_pred"] == "en" and got[104]["lang_pred"] == "en" and got[None]["lang_pred"] == "fr"
    assert got[105]["lang_pred"] in ("en", "fr") and got[None]["held_out"] is False


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert langid.predict_report(docs).first()["lang_pred"] == "und"
    assert langid.predict_report(docs.limit(0)).isEmpty() and langid.keep_known(docs.limit(0)).isEmpty()


def test_keep_known_keeps_clean_documents_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("x"))
    out = langid.keep_known(docs)
    assert out.columns == docs.columns and out.count() >= 0.999 * docs.count()
    junk = docs.limit(5).withColumn("text", F.lit("12345 !!!"))
    assert langid.keep_known(docs.where("doc_id > 100").unionByName(junk)).where("text = '12345 !!!'").isEmpty()


def test_every_language_is_learned(spark):
    words = {f"l{k:02d}": " ".join(f"{a}{chr(97 + k % 26)}{b}{chr(97 + k // 26)}" for a in "bdkm" for b in "aeou") for k in range(40)}
    docs = spark.createDataFrame([(i, t, n) for n, t in words.items() for i in (1, 3)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == sorted(words) and len(model.shards) == 2
    assert model.predict([words[n] for n in words])[0] == list(words)


def test_close_languages_keep_their_documents(spark):
    text = "the of and that with which were from the of and that"
    docs = spark.createDataFrame([(1, text, n) for n in ("en", "en-GB", "en-US", "eng")] * 3, "doc_id long, text string, lang string")
    assert langid.predict_report(docs).first()["score"] < langid.LEAST_SCORE
    assert langid.keep_known(docs).count() == 12
    assert langid.keep_known(docs.withColumn("text", F.lit("日本語")), langid.train(docs)).isEmpty()


def test_the_query_equals_brute_force(spark, tmp_path):
    en, fr = ["the cat sat", "The dog, the end", "on the mat 12", "that hat"], ["le chat est", "la fin, le chien", "sur LE tapis", "des mots"]
    asked = ["the mat", "le tapis", "cat est", "zz qq", "x", None, "", "12!", "the the the the the the the the the the the the the the the the the the"]
    docs = [(i, t, lang) for i, (t, lang) in enumerate([*((t, "en") for t in en), *((t, "fr") for t in fr), *((t, None) for t in asked)])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries()["op2_language_id"](spark, str(tmp_path)).collect()}

    def line(t):
        words = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        return f" {' '.join(words)} ".encode() if words else b""

    held = {i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    texts = {n: [line(t) for i, t, lang in docs if lang == n and i not in held] for n in ("en", "fr")}
    assert all(texts.values()) and held & set(range(8))
    all_ = texts["en"] + texts["fr"]
    seen, met = sorted({b for t in all_ for b in t}), Counter(t[i - k : i] for t in all_ for i in range(len(t)) for k in range(1, min(langid.ORDER, i) + 1))
    symbols, contexts = {b: i + 1 for i, b in enumerate(seen)}, {c for c, n in met.items() if n > 1}
    for i, t, _ in docs:
        x, name, score = line(t), "und", 0.0
        if x:
            bits = {n: brute_bits(texts[n], symbols, len(seen) + 1, contexts, x, langid.ORDER) for n in texts}
            name = min(sorted(bits), key=bits.get)
            score = 1 / sum(2 ** ((bits[name] - b) * min(1, langid.EVIDENCE / len(x))) for b in bits.values())
        assert (got[i]["lang_pred"], got[i]["held_out"]) == (name, i in held) and math.isclose(got[i]["score"], score, abs_tol=1e-3), (t, got[i], name, score)
    assert len(got) == len(docs)


def test_training_holds_little_more_than_the_model():
    r = np.random.default_rng(7)
    words = [bytes(r.integers(97, 123, 5).astype(np.uint8)) for _ in range(4000)]
    texts = {n: [b" ".join(words[i] for i in r.integers(0, 4000, 8000))] for n in ("a", "b", "c", "d")}
    tracemalloc.start()
    model = langid.PPM(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.child) > 500_000 and peak < 8 * model.bits.nbytes
