"""Language ID by prediction by partial matching (PPM).

Each language has a context tree over the bytes of its training texts, up to ``ORDER`` bytes
deep. Its statistics are frozen after training: a byte's probability after a context is its
share of the context's counts, and what the context has not seen shares the escape probability
(distinct bytes over counts plus distinct bytes) by the next shorter context without the bytes
already seen. A text's code length under a language is the sum over its bytes; the shortest
names the language. As the statistics are frozen, all probabilities of a context are worked out
once, and texts are scored by table look-up: a byte's code length is kept to 24 bits, and a text's
are summed in double precision.

Texts are lower-cased, and runs of ASCII characters other than letters become one space.

Training reads a bounded sample of labelled rows: per language whole texts, in the order of a hash
of doc_id, of ``TRAIN_ROWS`` rows at most and up to about ``TRAIN_BYTES`` bytes, of every language
(that many rows hold the bytes if texts have 300 on average; shorter ones make a smaller sample);
contexts seen once are left to shorter ones
and at most ``MAX_CONTEXTS`` are kept, the most frequent first. More than ``SHARD_LANGS`` languages
are dealt by name to models of that many, which share the alphabet and the number of contexts.
Only text and lang of rows that ``held_out`` does not mark are used; no prediction reads lang,
source or doc_id.

Defined results: ``und`` with score 0 for a null text, one without letters, or when nothing
could be learned; equal code lengths go to the first language by name; a null doc_id counts as
not held out; very long texts are scored whole, one at a time; rows that repeat are predicted each;
empty tables give empty results; further columns are ignored by the report and kept by
``keep_known``. ``score`` is the posterior of the predicted language under equal priors,
with the text's evidence scaled to that of ``EVIDENCE`` bytes where it has more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

ORDER = 4
TRAIN_BYTES, TRAIN_ROWS = 300_000, 1024
SHARD_LANGS = 32
MAX_CONTEXTS = 1 << 16
EVIDENCE = 64
#: Contexts whose code lengths are worked out at a time.
ROWS = 1024
SEED = 11
UNKNOWN = "und"
#: A text whose best language has less than this score is dropped by ``keep_known``, unless that
#: language's code is shorter than the background's (close languages share the score).
LEAST_SCORE = 0.3
_PLAIN = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _bytes(text: str | None) -> bytes:
    """What is scored of a text: nothing if it has no letters."""
    low = (text or "").lower()
    line = b" ".join(low.encode("utf-8", "replace").translate(_PLAIN).split())
    if not line or not (any(97 <= c <= 122 for c in line[:64]) or any(map(str.isalpha, low))):
        return b""
    return b" " + line + b" "


class PPM:
    """Context trees of several languages with frozen statistics.

    ``child[context * size + symbol]`` is the context one byte longer (0: none), ``bits`` the code
    length of a symbol after a context under each language. Context 0 is the empty one.
    """

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER, most: int = MAX_CONTEXTS, seen: np.ndarray | None = None) -> None:
        self.langs, self.order = sorted(texts), order
        data = np.frombuffer(b"".join(b"".join(texts[n]) for n in self.langs), np.uint8)
        lang = np.repeat(np.arange(len(self.langs)), [sum(map(len, texts[n])) for n in self.langs])
        sizes = np.array([len(t) for n in self.langs for t in texts[n]], np.int64)
        place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seen = np.unique(data) if seen is None else seen
        self.symbol = np.zeros(256, np.int32)  # 0: a byte never seen
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.size = size = len(seen) + 1
        sym = self.symbol[data].astype(np.int64)
        # contexts by depth; where: the positions whose context is still followed, at: their context
        parents, links = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        where, at, n = np.arange(len(sym)), np.zeros(len(sym), np.int64), 1
        short = np.int32 if len(sym) < 1 << 31 else np.int64
        members = [(where.astype(short), at.astype(short))]
        for depth in range(1, order + 1):
            ok = place[where] >= depth
            where, at = where[ok], at[ok]
            kinds, inverse, count = np.unique(at * size + sym[where - depth], return_inverse=True, return_counts=True)
            keep = count > 1
            if keep.sum() > most - n:
                keep &= count > np.sort(count)[-(most - n) - 1]
            if not keep.any():
                break
            name = np.where(keep, np.cumsum(keep) - 1 + n, 0)
            parents.append(kinds[keep] // size)
            links.append(kinds[keep])
            at = name[inverse]
            where, at = where[at > 0], at[at > 0]
            members.append((where.astype(short), at.astype(short)))
            n += int(keep.sum())
        self.child = np.zeros(n * size, np.int32)
        parent, link = np.concatenate(parents), np.concatenate(links)
        self.child[link[1:]] = np.arange(1, n)
        # level by level and some contexts at a time, so that the driver holds the shares of one level
        self.bits = np.empty((n * size, len(self.langs)), np.float32)
        above, up, first = np.empty(0), 0, 0
        for depth, (level, (where, at)) in enumerate(zip(parents, members)):
            by = np.argsort(at, kind="stable")
            where, at = where[by], at[by]
            shares = np.empty((len(level) if depth + 1 < len(parents) else 0, len(self.langs), size))
            for low in range(first, first + len(level), ROWS):
                high = min(low + ROWS, first + len(level))
                some = slice(*np.searchsorted(at, [low, high]))
                cell = ((at[some].astype(np.int64) - low) * len(self.langs) + lang[where[some]]) * size + sym[where[some]]
                c = np.bincount(cell, minlength=(high - low) * len(self.langs) * size).astype(float).reshape(high - low, len(self.langs), size)
                lower = above[parent[low:high] - up] if first else np.full_like(c, 1.0 / size)
                got = c > 0
                total, kinds = c.sum(-1, keepdims=True), got.sum(-1, keepdims=True)
                rest = np.where(got, 0.0, lower).sum(-1, keepdims=True)
                escape = np.where(rest > 0, kinds / np.maximum(total + kinds, 1), 0.0)
                share = c / np.maximum(total, 1) * (1 - escape)
                p = np.where(total > 0, np.where(got, share, escape * lower / np.where(rest > 0, rest, 1.0)), lower)
                self.bits[low * size : high * size] = -np.log2(p).transpose(0, 2, 1).reshape((high - low) * size, -1)
                if len(shares):
                    shares[low - first : high - first] = p
            above, up, first = shares, first, first + len(level)

    def lengths(self, lines: list[bytes]) -> np.ndarray:
        """Code lengths in bits, a row per line and a column per language; lines are not empty."""
        sizes = np.array([len(x) for x in lines], np.int64)
        starts = np.cumsum(sizes) - sizes
        sym = self.symbol[np.frombuffer(b"".join(lines), np.uint8)]
        place = np.arange(len(sym), dtype=np.int32) - np.repeat(starts, sizes).astype(np.int32)
        at, size = np.zeros(len(sym), np.int32), self.size
        where = np.flatnonzero(place >= 1)
        for depth in range(1, self.order + 1):
            found = self.child.take(at.take(where) * size + sym.take(where - depth))
            where, found = where[found > 0], found[found > 0]
            at[where] = found
            where = where[place.take(where) > depth]
        cost = self.bits.take(at * size + sym, axis=0)
        return np.add.reduceat(cost, starts, axis=0, dtype=np.float64)


class Model:
    """The languages' code lengths, in models of up to ``SHARD_LANGS`` languages, and a background:
    the share of each byte in all training texts, without contexts; one never seen costs as under
    equal shares, which is less than any language takes."""

    def __init__(self, texts: dict[str, list[bytes]]) -> None:
        self.langs = sorted(texts)
        counts = np.bincount(np.frombuffer(b"".join(b"".join(texts[n]) for n in self.langs), np.uint8), minlength=256)
        seen = np.flatnonzero(counts)
        self.background = np.full(256, np.log2(len(seen) + 1))
        self.background[seen] = -np.log2(counts[seen] / max(1, counts.sum()))
        names = [self.langs[at : at + SHARD_LANGS] for at in range(0, len(self.langs), SHARD_LANGS)]
        most = max(1, MAX_CONTEXTS // max(1, len(names)))
        self.shards = [PPM({n: texts[n] for n in some}, most=most, seen=seen) for some in names]

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Per text its language, the score, and whether the language's code is shorter than the background's."""
        names, scores, shorter = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        lines = [_bytes(t) for t in texts]
        todo = [i for i, x in enumerate(lines) if x and self.langs]
        while todo:  # about 256 KB at a time, or one text
            some, total = [], 0
            while todo and (not some or total < 1 << 18):
                some.append(todo.pop())
                total += len(lines[some[-1]])
            n = np.array([len(lines[i]) for i in some])
            bits = np.hstack([shard.lengths([lines[i] for i in some]) for shard in self.shards])
            plain = self.background.take(np.frombuffer(b"".join(lines[i] for i in some), np.uint8))
            shorter[some] = bits.min(axis=1) < np.add.reduceat(plain, np.cumsum(n) - n)
            bits = (bits - bits.min(axis=1, keepdims=True)) * np.minimum(1.0, EVIDENCE / n)[:, None]
            best = bits.argmin(axis=1)
            scores[some] = 1.0 / np.exp2(-bits).sum(axis=1)
            for i, b in zip(some, best):
                names[i] = self.langs[b]
        return names, scores, shorter

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        return self.judge(texts)[:2]


def sample(docs: DataFrame) -> dict[str, list[bytes]]:
    """The training texts of each language (see the module's bounds)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    langs = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row per language
    if not langs:
        return {}
    # rows that are likely to be wanted, then the first of them up to the bound
    sizes = docs.sparkSession.createDataFrame(langs, "lang string, n long")
    hash_ = F.xxhash64(F.lit(SEED), "doc_id")
    few = rows.join(F.broadcast(sizes), "lang").where(F.pmod(hash_, F.lit(1 << 30)) / float(1 << 30) < F.lit(float(TRAIN_ROWS)) / F.col("n"))
    order = Window.partitionBy("lang").orderBy("hash_", "text")
    few = few.select("lang", "text", hash_.alias("hash_")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= TRAIN_ROWS)
    before = F.coalesce(F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out: dict[str, list[bytes]] = {}
    for r in few.withColumn("before", before).where(F.col("before") < TRAIN_BYTES).orderBy("lang", "nth").select("lang", "text").collect():
        if line := _bytes(r["text"]):
            out.setdefault(r["lang"], []).append(line)
    return out


def train(docs: DataFrame) -> Model:
    return Model(sample(docs))


def _predictor(docs: DataFrame, model: Model):
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_CONTEXTS and SHARD_LANGS
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("shorter", T.BooleanType())])

    @F.arrow_udf(kind)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores, shorter = shared.value.judge(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(shorter)], names=["lang_pred", "score", "shorter"])

    return predict


def predict_report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    predict = _predictor(docs, model or train(docs))
    got = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("_p"))
    return got.select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def keep_known(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents that have a language: not ``und``, and a score of ``LEAST_SCORE`` or more or a
    code that is shorter than the background's."""
    predict = _predictor(docs, model or train(docs))
    got = docs.select(*[F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(docs.columns)], predict("text").alias("_p"))
    kept = got.where((F.col("_p.lang_pred") != UNKNOWN) & ((F.col("_p.score") >= LEAST_SCORE) | F.col("_p.shorter")))
    return kept.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(docs.columns)])
