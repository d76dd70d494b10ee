from __future__ import annotations

import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from matchloom.llm import spiece, tokenout
from matchloom.llm.queries import queries
from matchloom.llm.wordtable import WordTable

ODD = [
    "", "a", " ", "  a", "a  b", "\n\n x \n", "x y\x1cz\x85 q  r", "don't  we'll\t\t", "<|endoftext|> <s> </s> <unk>", "▁a ▁▁b", "日本 語\U0001f600 é",
    "a" * 3000, "  \n  ", "\x01", "0x<0x41>", "\r\n a\r\n", "x²y½3", "a_b.c,d-e", "×÷ªµ", "word " * 5000, "Ġa Ġ",
]
TEXT = st.text(st.sampled_from("ab1 .,'\n\téł▁$日²\U0001f600s "), max_size=60)


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def encoder():
    with open(tokenout.tokenizer_path(), "rb") as f:
        return tokenout.encoder(f.read())


def codec():
    with open(spiece.model_path(), "rb") as f:
        return spiece.codec(f.read())


def test_words_encode_as_whole_texts(plain):
    want = [x.ids for x in plain.encode_batch(ODD, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder().encode(ODD)] == want


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_any_text_encodes_as_whole(plain, text):
    assert np.frombuffer(encoder().encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_new_words_go_to_the_model_alone(plain):
    texts = ["some words hehewhouthwh Größe éàÿǅ 007 12345678901234567890", "x" * 3000 + " qqq" * 50, ""]
    want = [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    with open(tokenout.tokenizer_path(), "rb") as f:
        own = tokenout.Encoder(f.read(), added=True)
    own.tokenizer = SimpleNamespace(model=own.tokenizer.model)  # no regex, offsets or other part of the pipeline
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want


def test_pieces_that_the_pattern_cuts_further(plain):
    texts = [".'s", "a.'sb ''ll", "x2y", "日本2語'd .", " a²b½", "é'ré", "мир7 мир.", " 1a", "\u0345\u0301e", "ab'1"] * 2
    with open(tokenout.tokenizer_path(), "rb") as f:
        own = tokenout.Encoder(f.read())
    for some in (texts, texts[::-1], *([t] for t in texts)):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(some)] == [plain.encode(t, add_special_tokens=False).ids for t in some]


def test_letters_of_words_are_letters_to_the_library():
    letters = "".join(c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and tokenout.SINGLE.fullmatch(c) and not c.isdigit())
    assert len(letters) > 30_000
    assert len(pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str(letters)) == 1


def test_characters_of_bytes_are_the_librarys():
    got = "".join(map(chr, tokenout.CHARS.tolist()))
    assert len(set(got)) == 256 and set(got) == set(pre_tokenizers.ByteLevel.alphabet())
    text = "".join(map(chr, range(0x250))) + "\U0001f600\uffff\U000fffff"  # all bytes that UTF-8 has but a few of its first ones
    ((mapped, _),) = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text)
    assert "".join(got[b] for b in text.encode()) == mapped


def test_added_tokens_that_are_not_special_keep_their_ids():
    t = Tokenizer.from_file(tokenout.tokenizer_path())
    t.add_tokens(["zqx"])
    texts = ["a zqx b", "zqx", "azqxb zq x"]
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    for added in (True, False):
        assert [np.frombuffer(x, "<u4").tolist() for x in tokenout.Encoder(t.to_str().encode(), added).encode(texts)] == want


def test_a_full_table_still_encodes():
    table = WordTable(lambda words: [w.encode() for w in words], kept=2)
    assert table.ids([["a", "b"], ["c", "a"]]) == [b"ab", b"ca"] and not table.known
    assert table.ids([["a"]]) == [b"a"] and table.ids([["a", "d", "e", "a"], []]) == [b"adea", b""]
    assert list(table.known) == ["a"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=60), min_size=1, max_size=20), st.integers(1, 3))
def test_block_round_trip(docs, repeats):
    docs = docs * repeats * 4
    parts = [np.array(d, "<u4").tobytes() for d in docs]
    b = tokenout.Block(tokenout.Block.payload(parts, [None, *range(1, len(parts))], 5))
    assert b.ids().tobytes() == b"".join(parts) and b.null.tolist() == [1] + [0] * (len(parts) - 1)
    assert all(b.document(i).tobytes() == p for i, p in enumerate(parts))
    length = lambda x: 1 if x < 5 else length(b.left[x - 5]) + length(b.right[x - 5])
    assert b.sizes.tolist() == [length(5 + i) for i in range(len(b.left))]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=200), min_size=1, max_size=12), st.integers(1, 40))
def test_rules_are_made_until_no_pair_is_frequent(docs, repeats):
    parts = [np.array(d * repeats, "<u4").tobytes() for d in docs]
    b = tokenout.Block(tokenout.Block.payload(parts, list(range(len(parts))), 7))
    count = Counter()
    for x, y in zip(b.first_symbol[:-1].tolist(), b.first_symbol[1:].tolist()):
        own = b.symbols(x, y).tolist()
        count.update(zip(own, own[1:]))
    assert max(count.values(), default=0) < tokenout.LEAST and b.ids().tobytes() == b"".join(parts)


def test_rules_shorten_repeats_and_stay_in_documents(monkeypatch):
    docs = [[1, 2, 3, 4] * 200, [9, 9, 9, 9, 9, 9, 9], [1, 2] * 50]
    parts = [np.array(d, "<u4").tobytes() for d in docs]
    b = tokenout.Block(tokenout.Block.payload(parts, [0, 1, 2], 10))
    assert b.n_symbols < sum(map(len, docs)) / 20 and b.sizes.max() > 64
    assert b.document(2).tolist() == docs[2]
    wide = tokenout.Block(tokenout.Block.payload(parts, [0, 1, 2], 70_000))
    assert wide.width == 17 and wide.ids().tobytes() == b"".join(parts)
    with pytest.raises(ValueError):
        tokenout.Block(b"\0" * 32)


def test_a_block_with_more_symbols_than_sixteen_bits_hold():
    r = np.random.default_rng(4)
    ids = np.concatenate([np.arange(69_000), r.integers(0, 50, 30_000), np.tile(r.integers(0, 69_000, 400), 20)]).astype("<u4")
    b = tokenout.Block(tokenout.Block.payload([ids.tobytes()], [1], 70_000))
    assert b.ids().tobytes() == ids.tobytes() and len(b.left) > 100


@pytest.mark.parametrize("block", [tokenout.BLOCK_IDS, 50])
def test_files(spark, plain, monkeypatch, block):
    monkeypatch.setattr(tokenout, "BLOCK_IDS", block)
    r = random.Random(3)
    docs = [(i, r.choice(ODD + [None])) for i in range(200)] + [(7, "again"), (7, "again"), (None, "no id")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit("clash")).repartition(6)
    rows = sorted(tokenout.write_and_read(frame).collect(), key=lambda x: x["start"])
    assert len(rows) == len(docs)
    at = 0
    ids = {}
    for d, t in docs:
        x = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        ids.setdefault(d, []).append((len(x), zlib.crc32(x.tobytes())))
    for x in rows:
        assert x["start"] == at
        at += x["n_tokens"]
        ids[x["doc_id"]].remove((x["n_tokens"], x["ids_crc32"]))
    assert [x["doc_id"] is None for x in rows][0] and [x["doc_id"] for x in rows][1:] == sorted(d for d, _ in docs if d is not None)
    assert tokenout.write_and_read(frame.limit(0)).isEmpty()


def test_the_query_encodes_as_the_unmodified_tokenizer(spark, tmp_path):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ODD + ["end <|endoftext|> next", "<|endoftext|>", "a<|endoftext|><|endoftext|>b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in queries()["op3_token_ids"](spark, str(tmp_path)).collect()}
    want = [np.array([*own.encode(t, add_special_tokens=False).ids, 0], "<u4") for t in texts]
    assert got == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(want)}


def test_sentencepiece_parity():
    c = codec()
    ids = c.encode(ODD)
    assert all(c.parity(ODD, ids)) and c.model.by_letters
    assert c.decode(ids) == c.decode_by_library(ids) == [t.replace("▁", " ") for t in ODD]


def test_ids_that_differ_from_the_library_do_not_leave(monkeypatch):
    c = codec()
    monkeypatch.setattr(c, "encode", lambda texts: [np.array([1, 2], "<u4") for _ in texts])
    assert [x.tolist() for x in c.checked(ODD)] == c.other.encode(ODD)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_any_text_has_parity(text):
    c = codec()
    (ids,) = c.encode([text])
    assert c.parity([text], [ids]) == [True] and c.decode([ids])[0] == text.replace("▁", " ")


def field(number: int, value) -> bytes:
    def varint(n: int) -> bytes:
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + np.array(value, "<f4").tobytes()
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_unigram_model():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("▁ab", -1.0, 1), ("▁a", -2.0, 1), ("b", -2.5, 1), ("▁", -3.0, 1), ("a", -3.5, 1), ("c", -4.0, 1)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    data += field(2, field(3, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 1))
    c = spiece.Codec(data)
    assert isinstance(c.model.core(), models.Unigram) and c.model.trim
    texts = ["ab c", "  ab   ab ", "cab", "abba", "zz a", ""]
    assert all(c.parity(texts, c.encode(texts)))
    assert sentencepiece.SentencePieceProcessor(model_proto=data).vocab_size() == len(pieces)


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        spiece.Codec(field(1, field(1, b"<unk>") + field(3, 2)) + field(2, field(3, 3))).encode(["a"])


def test_encode_report_and_encode(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("_text", F.lit(1))
    rows = {r["doc_id"]: r for r in spiece.encode_report(docs).collect()}
    own = codec()
    for i, t in enumerate([*ODD, ""]):
        (x,) = own.encode([t])
        assert (rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (len(x), zlib.crc32(x.tobytes())) and rows[i]["parity"] and rows[i]["round_trip"]
    out = spiece.encode(docs)
    assert {r["doc_id"]: r["ids"] for r in out.collect()} == {i: own.other.encode(t) for i, t in enumerate([*ODD, ""])}
    assert spiece.encode_report(docs.limit(0)).isEmpty() and spiece.encode(docs.limit(0)).isEmpty()
