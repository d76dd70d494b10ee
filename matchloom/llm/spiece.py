"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here; from it come the normaliser (character map, dummy
prefix, extra white space), the metaspace marker, the piece scores and the byte fallback. Unigram
models become a Unigram model, BPE models a BPE model whose merges follow from the scores. Where
no piece goes over a cut between words, or between letters and others (checked against the
pieces), a text's parts are encoded once each and kept in a bounded table. Every text is also
encoded by the sentencepiece library; ``parity`` says whether both agree.

Defined results: null counts as empty; an empty text has no ids and decodes to itself; a text is
encoded whole, however long; merges of equal scores follow the model's own order; repeated rows are
encoded each; empty tables give empty results; further columns are ignored by ``encode_report`` and
kept by ``encode``.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches
from .tokenout import LATIN
from .wordtable import WordTable

MARK = "▁"
THREADS = 2
#: Parts in a batch of the library, which spreads it over its threads.
BATCH = 2048
#: Parts whose ids a worker keeps.
KEPT_WORDS = 300_000
#: Types of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def model_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; nested messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Model:
    """What a model file says: pieces with scores and types, normaliser, flags."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        normal: dict[int, int | bytes] = {}
        for field, value in wire_fields(data):
            if field == 1:
                p = dict(wire_fields(value))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(wire_fields(value))
            elif field == 3:
                normal = dict(wire_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normal.get(2, b"")
        self.dummy_prefix = bool(normal.get(3, 1))
        self.trim = bool(normal.get(4, 1))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        plain = [p for p, _, kind in self.pieces if kind in (NORMAL, USER)]
        #: whether words, each with the markers before it, are encoded apart from each other
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in plain)
        #: whether runs of Latin letters are encoded apart from what else a word has
        self.by_letters = self.by_word and not any(re.search(f"[{LATIN}][^{LATIN}]|[^{LATIN}{MARK}][{LATIN}]", p) for p in plain)

    def cuts(self) -> str | None:
        """A pattern of the parts that are encoded apart, with spaces for markers; None if texts are
        encoded whole. No piece goes over a cut, so neither merges nor the best path ever join
        its two sides."""
        if self.by_letters:
            return f" *[{LATIN}]+| *[^{LATIN} ]+| +"
        return " *[^ ]+| +" if self.by_word else None

    def merges(self) -> list[tuple[str, str]]:
        """All ways to join two pieces to a third, the highest score first."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        found = []
        for piece, i in ids.items():
            splits = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
            found += [((-self.pieces[i][1], i, ids[a], ids[b]), (a, b)) for a, b in splits]
        return [pair for _, pair in sorted(found)]

    def core(self):
        """The tokenizers model of the pieces."""
        from tokenizers import models

        if self.kind == UNIGRAM:
            return models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unknown, byte_fallback=self.byte_fallback)
        if self.kind != BPE:
            raise ValueError(f"pieces of kind {self.kind} are neither unigram nor BPE")
        vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        return models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)

    def normalizer(self):
        from tokenizers import Regex, normalizers

        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        return normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])

    def decoder(self):
        from tokenizers import decoders

        steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        return decoders.Sequence([*steps, *[decoders.Strip(" ", 1, 0)] * self.dummy_prefix])


class Codec:
    """Encodes and decodes batches of texts."""

    def __init__(self, data: bytes) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        from tokenizers import Tokenizer

        self.model = Model(data)
        self.words = Tokenizer(self.model.core())
        self.normalizer, self.decoder = self.model.normalizer(), self.model.decoder()
        self.data = data
        # the library spreads a batch over its threads
        self.table = WordTable(self._encode_parts, KEPT_WORDS)
        # what each id stands for: a byte piece its byte, a control piece nothing, others their text
        self.bytes = [self._meaning(*p) for p in self.model.pieces]
        cuts = self.model.cuts()
        self.split = re.compile(cuts).findall if cuts else lambda t: [t] * bool(t)

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"  # read at each call; a worker may have run others
        out = []
        for at in range(0, len(parts), BATCH):
            marked = [p.replace(" ", MARK) for p in parts[at : at + BATCH]]
            out += [array("I", x.ids).tobytes() for x in self.words.encode_batch_fast(marked, add_special_tokens=False)]
        return out

    def normalized(self, text: str) -> str:
        """The text that is encoded, with spaces for markers (the two are one to the model)."""
        m = self.model
        if text and (m.charsmap or m.trim):
            return self.normalizer.normalize_str(text).replace(MARK, " ")
        return (" " * m.dummy_prefix + text.replace(MARK, " ")) if text else ""

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        return [np.frombuffer(x, "<u4") for x in self.table.ids([self.split(self.normalized(t)) for t in texts])]

    @cached_property
    def other(self):
        """The sentencepiece library's processor, loaded where parity is asked for."""
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.data)

    def parity(self, texts: list[str], ids: list[np.ndarray]) -> list[bool]:
        """Whether the sentencepiece library has the same ids."""
        return [array("I", a).tobytes() == b.tobytes() for a, b in zip(self.other.encode(texts, num_threads=THREADS), ids)]

    def checked(self, texts: list[str]) -> list[np.ndarray]:
        """As ``encode``, held against the sentencepiece library: where they differ its ids count."""
        return [b if np.array_equal(a, b) else np.array(a, "<u4") for a, b in zip(self.other.encode(texts, num_threads=THREADS), self.encode(texts))]

    @staticmethod
    def _meaning(piece: str, _: float, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else piece.replace(MARK, " ").encode()

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of ids; bytes that are no UTF-8 become replacement characters."""
        out = [b"".join(map(self.bytes.__getitem__, x.tolist())).decode("utf-8", "replace") for x in ids]
        return [t[1:] if self.model.dummy_prefix and t[:1] == " " else t for t in out]

    def decode_by_library(self, ids: list[np.ndarray]) -> list[str]:
        """As ``decode``, by the tokenizers library (slower)."""
        return [self.decoder.decode([self.model.pieces[i][0] for i in x.tolist()]) if len(x) else "" for x in ids]


_CODECS: dict[int, Codec] = {}


def codec(data: bytes) -> Codec:
    """This process's codec of a model file."""
    key = zlib.crc32(data)
    if key not in _CODECS:
        _CODECS[key] = Codec(data)
    return _CODECS[key]


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _model_bytes(path: str | None) -> bytes:
    with open(path or model_path(), "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text as array<int>; a column of that name is replaced."""
    bounded_batches(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(_model_bytes(path))  # one model file

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            got = codec(data.value).checked(_texts(texts))
            flat = np.concatenate([np.empty(0, "<u4"), *got]).astype(np.int32)
            yield pa.ListArray.from_arrays(np.cumsum([0, *map(len, got)], dtype=np.int32), flat)

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != column], ids("text").alias(column))


def encode_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number and CRC-32 of its ids (little-endian unsigned 32-bit), whether the
    sentencepiece library agrees, whether the ids decode to the text."""
    bounded_batches(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(_model_bytes(path))  # one model file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, texts = codec(data.value), _texts(batch.column(1))
            ids = own.encode(texts)
            same = own.parity(texts, ids)
            back = [a == own.normalized(b)[own.model.dummy_prefix * bool(b) :] for a, b in zip(own.decode(ids), texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(same, pa.bool_()), pa.array(back, pa.bool_())],
                names=["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean")
