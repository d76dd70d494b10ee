"""Every operator on documents reads a text of several MB whole."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from matchloom.llm import spiece, tokenout
from matchloom.llm.queries import queries

WORDS = 500_000
TAIL = ' token="abcd1234efgh" mail jane@host.org'
LONG = "the words " * (WORDS // 2) + TAIL  # 5 MB


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(1, LONG, "en", "s"), (3, LONG, "en", "s"), (4, "the words", "en", "s"), (5, None, None, None)]
    path = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def run(spark, folder, name):
    return {r["doc_id"]: r for r in queries()[name](spark, folder).collect()}


def test_sizes_languages_and_copies(spark, folder):
    assert run(spark, folder, "op1_mix_sources")[3]["size"] == WORDS + 3
    assert {i: r["lang_pred"] for i, r in run(spark, folder, "op2_language_id").items()} == {1: "en", 3: "en", 4: "en", 5: "und"}
    assert {i: (r["keep_id"], r["group_size"]) for i, r in run(spark, folder, "op6_exact_dedup").items()} == {1: (3, 2), 3: (3, 2), 4: (4, 1), 5: (5, 1)}
    prints = run(spark, folder, "op10_simhash_dedup")
    words = LONG.split()
    h = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in (0, 1)]
    ones = [sum(x >> j & 1 for x in h) for j in range(64)]
    got = int(prints[3]["fingerprint"], 16)
    assert all((got >> j & 1) == (n == 2) for j, n in enumerate(ones) if n != 1)  # where half the shingles have a bit, the tail decides
    assert prints[3]["component_id"] == 1


def test_tokens(spark, folder):
    own = np.array([*Tokenizer.from_file(tokenout.tokenizer_path()).encode(LONG, add_special_tokens=False).ids, 0], "<u4")
    row = run(spark, folder, "op3_token_ids")[3]
    assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (len(own), len(own), zlib.crc32(own.tobytes()))
    with open(spiece.model_path(), "rb") as f:
        other = np.array(spiece.codec(f.read()).other.encode(LONG), "<u4")
    row = run(spark, folder, "op5_sentencepiece")[1]
    assert (row["n_tokens"], row["ids_crc32"], row["parity"], row["round_trip"]) == (len(other), zlib.crc32(other.tobytes()), True, True)


def test_scans(spark, folder):
    at = LONG.index("token=")
    assert run(spark, folder, "op4_secret_scan")[1]["spans"] == f"assign:{at}:{at + 19}"
    at = LONG.index("jane")
    assert run(spark, folder, "op7_personal_data")[3]["spans"] == f"email:{at}:{at + 13}"
