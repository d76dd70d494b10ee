"""Token ids as binary files under Re-Pair grammar compression.

Texts are dealt by ranges of doc_id; the rows of a range are encoded in order, an end id follows
each document, and blocks of about ``BLOCK_IDS`` ids are compressed: in each round the pairs of
neighbours that are most frequent in the block become rules, ``RULES_A_ROUND`` at a time, and their
occurrences, from the left and never over the end of a document, become the rule's symbol. Rounds
go on until no pair of the block is there ``LEAST`` times (a rule takes twelve bytes and an
occurrence saves about two, so rarer pairs do not pay). A block stores its rules, the length each
expands to, its symbols, and where each document starts among symbols and among ids, so that a
document is decoded alone (``Block.document``) by expanding its own symbols only.

File format: a folder of Parquet files written by Spark (its commit protocol drops what lost
tasks left) with columns shard, block, n_ids, payload. A payload is a header of eight 32-bit
integers (magic, base of the rules' symbols, rules, symbols, documents, ids, bits a symbol,
zero), then the arrays left, right and expansion length of the rules (uint32), doc_id (int64),
null flags of doc_id (uint8), first symbol and first id of each document (uint32, one more entry
at the end), and the symbols: a plane of one bit each for every bit, the lowest first, a plane in
whole bytes. Shards and blocks ascend with doc_id.

Defined results: null text counts as empty (its one id is the end id); null doc_id comes first;
rows that repeat a doc_id are documents of their own, by a hash of the text within a shard; empty tables
give no files' rows; a text is encoded whole, and one longer than a block is a block of its own; further
columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, count, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

END = 0
MAGIC = 0x31475052
BLOCK_IDS = 1 << 20
#: Rules of a round, and the least count of a pair.
RULES_A_ROUND, LEAST = 4096, 8
KEPT_WORDS = 1_500_000
#: Characters of texts that are encoded at once (more where one text has more).
GROUP_CHARS = 1 << 22
#: White space as the vocabulary's pattern has it (fixed values: Unicode White_Space).
SPACE = r"\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Words with the space before them: cuts that the vocabulary's pattern makes in any text.
COARSE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Latin letters, and texts of nothing but these and ASCII; there the whole pattern is plain.
LATIN = "A-Za-z" + "-".join(map(chr, (0xC0, 0xD6))) + "-".join(map(chr, (0xD8, 0xF6))) + "-".join(map(chr, (0xF8, 0x24F)))
PLAIN = re.compile(rf"[ -~\t\n\r{LATIN}]*")
#: These, and Greek, Cyrillic, Hebrew, Arabic, kana, Han and Hangul letters that any version of Unicode has.
FIXED = ((0x391, 0x3A1), (0x3A3, 0x3CE), (0x400, 0x481), (0x48A, 0x513), (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x3041, 0x3094), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
LETTERS = LATIN + "".join(f"{chr(x)}-{chr(y)}" for x, y in FIXED)
#: Pieces that the whole pattern takes in one match.
SINGLE = re.compile(f" ?(?:[{LETTERS}]+|[0-9]+)")
#: Kinds of the bytes of such texts (other bytes than ASCII are letters there).
LETTER, DIGIT, QUOTE, OTHER, SPACE, BREAK = range(6)
KINDS = bytes(LETTER if x >= 128 or chr(x).isalpha() else DIGIT if chr(x).isdigit() else {"'": QUOTE, " ": SPACE, "\t": BREAK, "\n": BREAK, "\r": BREAK}.get(chr(x), OTHER) for x in range(256))


def _between(one: int, two: int) -> int:
    """Of the kinds of two neighbours: 1 where the pattern cuts in any case, 2 inside white space.
    A quote and the letters after it stay together, as they may be cut after the letters."""
    if two >= SPACE:
        return 2 if one >= SPACE else 1
    alike = one == two or {one, two} == {QUOTE, OTHER}
    return int(one == BREAK or not (alike or one == SPACE or (one, two) == (QUOTE, LETTER)))


BETWEEN = bytes(_between(x >> 3, x & 7) for x in range(256))
#: The character that stands for each byte in a byte-level vocabulary: printable ones for themselves.
CHARS = np.arange(256, dtype="<u4")
CHARS[[*range(33), *range(127, 161), 173]] = np.arange(256, 256 + 68)


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def _cuts(texts: list[str], data: bytes, bounds: np.ndarray) -> np.ndarray:
    """Where pieces start in ``data``, the texts in UTF-8 from ``bounds`` to ``bounds``."""
    kinds = np.frombuffer(data.translate(KINDS), np.uint8)
    cut = np.ones(len(kinds), np.uint8)
    cut[1:] = np.frombuffer((kinds[:-1] << 3 | kinds[1:]).tobytes().translate(BETWEEN), np.uint8)
    opens = np.zeros(len(kinds) + 1, bool)
    opens[bounds] = True
    # the last of a run of white space goes with what follows in the text
    run = np.flatnonzero(cut == 2)
    after = run + 1
    cut[run] = ~opens[after] & (kinds.take(after, mode="clip") < SPACE)
    cut |= opens[:-1]
    for i, t in enumerate(texts):
        if not (t.isascii() and t.isprintable() or PLAIN.fullmatch(t)):
            cut[bounds[i] : bounds[i + 1]] = 0
            sizes = [len(p.encode()) for p in COARSE.findall(t)]
            cut[bounds[i] + np.cumsum(sizes) - sizes] = 1
    return np.flatnonzero(cut)


class PieceTable:
    """Looks up the ids of pieces of text; what a batch has that is not known is encoded once.

    Pieces are told apart by Arrow, so that only the distinct ones of a batch are looked up one by
    one. The table keeps pieces until there are ``kept``: those met first, which the frequent ones
    are among. ``encode`` gives the ids of all its pieces in a row, and how many each has.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[array, list[int]]], kept: int) -> None:
        self.encode, self.kept = encode, kept
        self.known: dict[str, int] = {}  # a piece's number
        self.flat, self.first = np.empty(1 << 16, "<u4"), np.zeros(1 << 12, np.int64)  # the numbers' ids; where each starts, and the end

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The pieces' numbers; those of pieces that are not kept hold until the next call."""
        found = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        gaps = np.flatnonzero(found < 0)
        if len(gaps):
            new = [pieces[i] for i in gaps.tolist()]
            (ids, sizes), n = self.encode(new), len(self.known)
            ends = self.first[n] + np.cumsum(sizes)
            self.first, self.flat = _room(self.first, n, n + len(new) + 1), _room(self.flat, int(self.first[n]), int(ends[-1]))
            self.first[n + 1 : n + 1 + len(new)] = ends
            self.flat[self.first[n] : ends[-1]] = ids
            found[gaps] = n + np.arange(len(new))
            if n + len(new) <= self.kept:
                self.known.update(zip(new, count(n)))
        return found

    def ids(self, data: bytes, starts: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The ids of the pieces that begin at ``starts`` of ``data``, one run of bytes for each text."""
        if not len(starts):
            return [b""] * (len(bounds) - 1)
        edges = np.append(starts, len(data))
        pieces = pa.Array.from_buffers(pa.large_utf8(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        number, own = self._numbers(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pieces.indices.to_numpy()
        first = self.first[number]
        size = (self.first[number + 1] - first)[own]
        ends = np.cumsum(size)
        place = np.repeat(first[own] - ends + size, size)
        place += np.arange(len(place))
        out, edge = self.flat.take(place).tobytes(), 4 * np.append(0, ends)[np.searchsorted(starts, bounds)]
        return [out[x:y] for x, y in zip(edge.tolist(), edge[1:].tolist())]


def _room(held: np.ndarray, used: int, need: int) -> np.ndarray:
    """``held``, or a longer copy of its first ``used + 1`` entries if there is no room for ``need``."""
    if need <= len(held):
        return held
    out = np.empty(2 * need, held.dtype)
    out[: used + 1] = held[: used + 1]
    return out


class Encoder:
    """Encodes texts to bytes of little-endian unsigned 32-bit ids.

    A byte-level vocabulary without normaliser and prefix space never joins over the cuts that its
    pattern makes, so pieces between cuts are encoded once each, by the library's model alone where
    they are plain words, and kept in a bounded table; any other vocabulary gets whole texts. With ``added`` the added tokens of the file have their own
    ids, as the library has it: texts that hold one are encoded whole. Without, special ones are
    text like any other. ``array("I")`` is little-endian on Spark's platforms.
    """

    def __init__(self, data: bytes, added: bool = False) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(data.decode())
        pre = self.tokenizer.pre_tokenizer
        plain = isinstance(pre, pre_tokenizers.ByteLevel) and not pre.add_prefix_space and pre.use_regex and self.tokenizer.normalizer is None
        self.tokenizer.encode_special_tokens = plain or not added
        self.whole, held = None, [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if plain and added and held:
            self.whole, self.held = Tokenizer.from_str(data.decode()), re.compile("|".join(map(re.escape, held)))
        # pieces that may hold an added token need more of the library than its model
        bare = plain and all(added or t.special for t in self.tokenizer.get_added_tokens_decoder().values())
        self.plain, self.table = plain, PieceTable(self._pieces if bare else self._apart, KEPT_WORDS)

    def _apart(self, words: list[str]) -> tuple[array, list[int]]:
        got = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return array("I", chain.from_iterable(got)), list(map(len, got))

    def _pieces(self, words: list[str]) -> tuple[array, list[int]]:
        """Pieces of one match go to the library's model as the characters that stand for their bytes,
        which is what its pipeline comes to for them, without a regex and a table of offsets for each.
        Others may be cut further and take the pipeline."""
        others = [w for w in words if not SINGLE.fullmatch(w)]
        rest, sizes = self._apart(others) if others else (array("I"), [])
        rest_of, at_rest = dict(zip(others, sizes)), 0
        raw = [w.encode() for w in words]
        chars = CHARS[np.frombuffer(b"".join(raw), np.uint8)].tobytes().decode("utf-32-le")
        model, out, sizes, at = self.tokenizer.model, array("I"), [], 0
        for word, n in zip(words, map(len, raw)):
            size = rest_of.get(word)
            if size is None:
                ids = [x.id for x in model.tokenize(chars[at : at + n])]
            else:
                ids = rest[at_rest : at_rest + size]
                at_rest += size
            out.extend(ids)
            sizes.append(len(ids))
            at += n
        return out, sizes

    def encode(self, texts: list[str]) -> list[bytes]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # read at each call; a worker may have run others
        odd = [i for i, t in enumerate(texts) if self.held.search(t)] if self.whole else []
        cut = texts if not odd else ["" if self.held.search(t) else t for t in texts]
        raw = [t.encode() for t in cut]
        data, bounds = b"".join(raw), np.cumsum([0, *map(len, raw)])
        out = self.table.ids(data, _cuts(cut, data, bounds) if self.plain else np.unique(bounds[bounds < len(data)]), bounds)
        for i, x in zip(odd, self.whole.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False) if odd else []):
            out[i] = array("I", x.ids).tobytes()
        return out


_ENCODERS: dict[tuple[int, bool], Encoder] = {}


def encoder(data: bytes, added: bool = False) -> Encoder:
    """This process's encoder of a vocabulary file."""
    key = zlib.crc32(data), added
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(data, added)
    return _ENCODERS[key]


def repair(ids: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of ids under ``base``; ``ends`` are the places of each document's last id.

    Returns symbols, their ``ends``, and the left and right symbols of the rules; rule i is the
    symbol base + i.

    A pair of symbols that were there in the round before can only have lost places since, so each
    round counts just the places of pairs with a symbol new in the last one, or whose two sides were
    in frequent pairs then.
    """
    seen = np.zeros(base, bool)
    seen[ids] = True
    own = np.flatnonzero(seen)  # the block's ids get numbers without gaps, so that pairs stay short
    number = np.zeros(base, np.int32)
    number[own] = np.arange(len(own))
    seq, left, right = number[ids], np.empty(0, np.int64), np.empty(0, np.int64)
    opens = closes = np.ones(len(own), np.uint8)  # 2: a new symbol; 1: a side of a frequent pair
    while len(seq) > 1:
        top = len(own) + len(left)
        # a pair in one number, as short as the symbols allow
        pack, shift = (np.uint32, 16) if top < 1 << 16 else (np.uint64, 32)
        # mode "clip" (all are in bounds) saves numpy a slow pass over the indexes
        near = opens.take(seq[:-1], mode="clip")
        near += closes.take(seq[1:], mode="clip")
        near[ends[:-1]] = 0  # no pair goes over the end of a document
        near = np.flatnonzero(near >= 2)
        if not len(near):
            break
        one, two = seq.take(near, mode="clip"), seq.take(near + 1, mode="clip")
        pairs = (one.astype(pack) << pack(shift)) | two.astype(pack)
        pairs.sort()
        edge = np.flatnonzero(pairs[1:] != pairs[:-1]) + 1
        edge = np.concatenate([[0], edge, [len(pairs)]])
        count, kinds = np.diff(edge), pairs[edge[:-1]]
        often = np.flatnonzero(count >= LEAST)
        if not len(often):
            break
        opens, closes = np.zeros(top, np.uint8), np.zeros(top, np.uint8)
        opens[(kinds[often] >> pack(shift)).astype(np.int64)] = 1
        closes[(kinds[often] & pack((1 << shift) - 1)).astype(np.int64)] = 1
        often = often[np.lexsort((kinds[often], -count[often]))[:RULES_A_ROUND]]
        a, b = (kinds[often] >> pack(shift)).astype(np.int64), (kinds[often] & pack((1 << shift) - 1)).astype(np.int64)
        # a rule for each chosen (left, right), looked up over the symbols that are in one
        lefts, rights = np.unique(a), np.unique(b)
        row, col = np.zeros(top, np.int32), np.zeros(top, np.int32)
        row[lefts], col[rights] = np.arange(1, len(lefts) + 1) * (len(rights) + 1), np.arange(1, len(rights) + 1)
        table = np.zeros((len(lefts) + 1) * (len(rights) + 1), np.int32)
        table[row[a] + col[b]] = np.arange(top, top + len(a))
        rule = table.take(row.take(one, mode="clip") + col.take(two, mode="clip"), mode="clip")
        # of overlapping occurrences each second one goes, from the left
        hit = np.flatnonzero(rule != 0)
        at, rule = near.take(hit, mode="clip"), rule.take(hit, mode="clip")
        first = np.concatenate([[True], np.diff(at) > 1])
        begun = np.maximum.accumulate(np.where(first, at, 0))
        goes = (at - begun) & 1 == 0
        at = at.compress(goes)
        seq[at] = rule.compress(goes)
        ends = ends - np.searchsorted(at + 1, ends, side="right")
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq.compress(stay)
        left, right = np.concatenate([left, a]), np.concatenate([right, b])
        opens, closes = (np.concatenate([x, np.full(len(a), 2, np.uint8)]) for x in (opens, closes))
    symbol = np.concatenate([own, base + np.arange(len(left))])
    return symbol[seq], ends, symbol[left], symbol[right]


def expand(seq: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for: a rule's place is shared by its two sides, by their lengths."""
    size = np.concatenate([np.ones(base, np.int64), sizes])
    seq = seq.astype(np.int64)
    each = size[seq]
    at, out = np.cumsum(each) - each, np.empty(int(each.sum()), "<u4")
    while len(seq):
        plain = seq < base
        out[at.compress(plain)] = seq.compress(plain)
        seq, at = seq.compress(~plain) - base, at.compress(~plain)
        one, two = left[seq].astype(np.int64), right[seq].astype(np.int64)
        seq, at = np.concatenate([one, two]), np.concatenate([at, at + size[one]])
    return out


def expansion_lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule stands for; rules only use symbols before them."""
    size = np.ones(base + len(left), np.int64)
    pending = np.arange(len(left))
    done = np.concatenate([np.ones(base, bool), np.zeros(len(left), bool)])
    while len(pending):
        ready = done[left[pending]] & done[right[pending]]
        now = pending[ready]
        size[base + now] = size[left[now]] + size[right[now]]
        done[base + now] = True
        pending = pending[~ready]
    return size[base:]


class Block:
    """A block as written to and read from a payload."""

    def __init__(self, payload: bytes) -> None:
        head = np.frombuffer(payload, "<u4", 8)
        if head[0] != MAGIC:
            raise ValueError("not a block of token ids")
        _, self.base, rules, self.n_symbols, docs, self.n_ids, self.width, _ = map(int, head)
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.left, self.right, self.sizes = (take("<u4", rules) for _ in range(3))
        self.doc_ids, self.null = take("<i8", docs), take("u1", docs)
        self.first_symbol, self.first_id = take("<u4", docs + 1), take("<u4", docs + 1)
        self.planes = take("u1", self.width * ((self.n_symbols + 7) // 8)).reshape(self.width, -1)

    def symbols(self, start: int, end: int) -> np.ndarray:
        """The symbols from ``start`` to ``end``, read from their bits alone."""
        out, first = np.zeros(end - start, np.uint32), start // 8
        for j, plane in enumerate(self.planes[:, first : (end + 7) // 8]):
            out |= np.unpackbits(plane)[start - 8 * first : end - 8 * first].astype(np.uint32) << np.uint32(j)
        return out

    def ids(self) -> np.ndarray:
        return expand(self.symbols(0, self.n_symbols), self.left, self.right, self.sizes, self.base)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, from its own symbols."""
        own = self.symbols(int(self.first_symbol[i]), int(self.first_symbol[i + 1]))
        return expand(own, self.left, self.right, self.sizes, self.base)

    @staticmethod
    def payload(parts: list[bytes], doc_ids: list[int | None], base: int) -> bytes:
        """``parts``: each document's ids, the end id included."""
        sizes = np.array([len(p) // 4 for p in parts], np.int64)
        ids = np.frombuffer(b"".join(parts), "<u4")
        seq, ends, left, right = repair(ids, np.cumsum(sizes) - 1, base)
        width = (base + len(left) - 1).bit_length()
        seq = seq.astype(np.uint32)
        head = np.array([MAGIC, base, len(left), len(seq), len(parts), len(ids), width, 0], "<u4")
        arrays = [
            head, left.astype("<u4"), right.astype("<u4"), expansion_lengths(left, right, base).astype("<u4"),
            np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"),
            np.concatenate([[0], ends + 1]).astype("<u4"), np.concatenate([[0], np.cumsum(sizes)]).astype("<u4"),
            *(np.packbits((seq >> np.uint32(j)).astype(np.uint8) & 1) for j in range(width)),
        ]
        return b"".join(a.tobytes() for a in arrays)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    """doc_ids and texts of batches, some ``GROUP_CHARS`` characters at a time: the more texts, the
    fewer of their pieces are distinct."""
    doc_ids, texts, chars = [], [], 0
    for batch in batches:
        new = [t or "" for t in batch.column(1).to_pylist()]
        more = sum(map(len, new))
        if texts and chars + more > GROUP_CHARS:
            yield doc_ids, texts
            doc_ids, texts, chars = [], [], 0
        doc_ids, texts, chars = doc_ids + batch.column(0).to_pylist(), texts + new, chars + more
    if texts:
        yield doc_ids, texts


def write_blocks(docs: DataFrame, path: str | None = None, name: str = "token-ids", added: bool = False) -> DataFrame:
    """Encode and compress ``docs`` to files in the shared folder; the files' rows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(path or tokenizer_path(), "rb") as f:
        data = spark.sparkContext.broadcast(f.read())  # one vocabulary file
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, held, names, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, held, names, size
            payload = Block.payload(held, names, encoder(data.value, added).tokenizer.get_vocab_size())
            out = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "n_ids": pa.array([size], pa.int64()), "payload": pa.array([payload], pa.binary())})
            block, held, names, size = block + 1, [], [], 0
            return out

        for doc_ids, texts in _grouped(batches):
            for doc_id, ids in zip(doc_ids, encoder(data.value, added).encode(texts)):
                held.append(ids + end)
                names.append(doc_id)
                size += len(ids) // 4 + 1
                if size >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    # the row id parts rows that repeat a doc_id, without a look at the texts for the ranges' bounds
    dealt = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row")).repartitionByRange("doc_id", "_row")
    dealt = dealt.sortWithinPartitions("doc_id", F.xxhash64("text")).select("doc_id", "text")
    return materialize(dealt.mapInArrow(run, "shard int, block int, n_ids long, payload binary"), name)


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    spark: SparkSession = blocks.sparkSession
    at, shards = 0, []
    for r in sorted(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r["shard"]):  # a row per shard
        shards.append((r["shard"], at))
        at += r["n"]
    first = spark.createDataFrame(shards or [(0, 0)], "shard int, _first long")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", "n_ids").join(F.broadcast(first), "shard")  # a row per shard
    starts = materialize(starts.select("shard", "block", (F.col("_first") + F.coalesce(F.sum("n_ids").over(before), F.lit(0))).alias("_start")), "token-starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, payload in zip(*(c.to_pylist() for c in batch.columns)):
                b = Block(payload)
                data, edge = b.ids().tobytes(), b.first_id.astype(np.int64)
                n = len(b.doc_ids)
                crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(np.full(n, shard, np.int32)), "block": pa.array(np.full(n, block, np.int32)),
                    "doc_id": pa.array(b.doc_ids.astype(np.int64), mask=b.null.astype(bool)), "at": pa.array(edge[:-1]),
                    "n_tokens": pa.array(np.diff(edge)), "ids_crc32": pa.array(crc, pa.int64()),
                })

    bounded_batches(spark)
    rows = blocks.select("shard", "block", "payload").mapInArrow(run, "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["shard", "block"]).select("doc_id", (F.col("_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, path: str | None = None, added: bool = False) -> DataFrame:
    return read_blocks(write_blocks(docs, path, added=added))
