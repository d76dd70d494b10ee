"""SimHash near-dedup with BK-trees.

A text's fingerprint sums the bits of the XXH64 (seed 42) of its 3-word shingles. Fingerprints
link at ``RADIUS`` or fewer differing bits. Two that do agree in at least one of RADIUS + 1
blocks of bits, so each distinct fingerprint goes to the shards of its blocks' values; a shard
builds a BK-tree (children keyed by their Hamming distance to the parent) and each fingerprint
follows only the edges within the radius. The trees are routed to, not broadcast: all of them
together grow with the corpus. A shard emits one link per fingerprint to the least one that it
is tied to, not all pairs.

A shard of more than ``TREE`` distinct fingerprints is split by further bits: those it does not fix
yet are cut into RADIUS + 1 blocks again, and its fingerprints go to the smaller shards of these
blocks' values, whose trees find every link by the same argument. A shard that has fixed all but
log2(TREE) bits holds no more than ``TREE``, so the splitting ends, after six levels at most.

Defined results: null or empty text has fingerprint 0 and links like any other; whole texts are
hashed, in runs of 65,536 shingles, so a very long one costs time in proportion; ties need no
rule, the least doc_id names a component; rows that repeat a doc_id are rows of their own; a null
doc_id names a component only if it holds nothing else; empty tables give empty results; further
columns are kept by ``dedup`` and ignored by ``dedup_report``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import bounded_batches, materialize
from .components import connected_components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: The most fingerprints that a tree holds.
TREE = 512
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < SHINGLE:
        return xxh64_intdigest(line, SEED)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    ones, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for at in range(0, n, 1 << 16):
        stop = min(n, at + (1 << 16))
        h = np.array([xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(starts[at:stop], starts[at + SHINGLE : stop + SHINGLE])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64))


class BKTree:
    """A BK-tree over integers under the Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def search(self, value: int, radius: int) -> list[int]:
        """Indexes of the stored values within the radius, in any order."""
        found, stack = [], [0] if self.values else []
        values, children = self.values, self.children
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            if edges := children[at]:
                for k in range(d - radius, d + radius + 1):
                    if k in edges:
                        stack.append(edges[k])
        return found

    def add(self, value: int) -> int:
        """Store a value that is not stored yet; its index."""
        new, at = len(self.values), 0
        self.values.append(value)
        self.children.append({})
        while new:
            edges = self.children[at]
            d = (self.values[at] ^ value).bit_count()
            if d not in edges:
                edges[d] = new
                break
            at = edges[d]
        return new


def tree_links(values: Iterable[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that tie together the distinct values which chains of near pairs connect."""
    tree, root = BKTree(), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for v in values:
        near = tree.search(v, radius)
        root.append(i := tree.add(v))
        for j in near:
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    return [(tree.values[i], tree.values[top(i)]) for i in range(len(root)) if top(i) != i]


def _search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (mask, value, fp) sorted by shard; a shard may go on in the next batch."""
    held = np.empty((0, 3), np.int64)

    def links(rows: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
        out: list[tuple[int, int]] = []
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if y - x > 1:
                out += tree_links(rows[x:y, 2].view(np.uint64).tolist())
        both = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    for batch in batches:
        rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)])
        if not len(rows):
            continue
        edges = np.concatenate([[0], np.flatnonzero((np.diff(rows[:, :2], axis=0) != 0).any(axis=1)) + 1])
        yield links(rows, edges)
        held = rows[edges[-1] :].copy()  # the last shard may not be over
    if len(held):
        yield links(held, np.array([0, len(held)]))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _narrower(mask: int) -> list[int]:
    """``mask`` with one of RADIUS + 1 blocks of the bits that it leaves open."""
    free = [j for j in range(64) if not mask >> j & 1]
    cuts = [len(free) * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    return [mask | sum(1 << j for j in free[x:y]) for x, y in zip(cuts, cuts[1:])]


def _split(rows: DataFrame, masks: list[int]) -> DataFrame:
    """``rows`` (mask, fp) of shards that fix the bits of one of ``masks`` to the shards of their
    further blocks: (mask, value, fp)."""
    if len(masks) == 1:
        narrower = rows.select("fp", F.explode(F.array(*[F.lit(_signed(x)).cast("long") for x in _narrower(masks[0])])).alias("mask"))
        return narrower.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
    into = rows.sparkSession.createDataFrame([(_signed(m), [_signed(x) for x in _narrower(m)]) for m in masks], "mask long, into array<bigint>")
    narrower = rows.join(F.broadcast(into), "mask").select("fp", F.explode("into").alias("mask"))  # a row per mask, 729 at most
    return narrower.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) over distinct fingerprints ``fp`` that give their components at RADIUS."""
    rows, masks, out = prints.select(F.lit(0).cast("long").alias("mask"), "fp"), [0], None
    while True:
        routed = _split(rows, masks)
        shards = materialize(routed.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1"), "simhash-shards")
        small, hot = (shards.where(c).select("mask", "value") for c in (F.col("n") <= TREE, F.col("n") > TREE))
        trees = routed.join(small, ["mask", "value"]).select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
        found = trees.mapInArrow(_search_shards, "a long, b long")
        out = found if out is None else out.unionByName(found)
        masks = [r["mask"] & ((1 << 64) - 1) for r in hot.select("mask").distinct().collect()]
        if not masks:
            return out
        # shards of two masks may fix the same bits, so a fingerprint can come to one twice
        rows = materialize(routed.join(hot, ["mask", "value"]).select("mask", "fp").distinct(), "simhash-hot")


def groups(prints: DataFrame) -> DataFrame:
    """``prints`` (fp, id; id any orderable) to (fp, least): the least id of fp's component."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("id")), "simhash-distinct")
    parts = connected_components(links(distinct.select("fp")))
    named = distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))
    least = materialize(named.groupBy("component").agg(F.min("id").alias("least")), "simhash-least")
    return materialize(named.join(least, "component").select("fp", "least"), "simhash-groups")


def dedup_report(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint and the least doc_id of its group."""
    bounded_batches(docs.sparkSession)
    prints = materialize(docs.select("doc_id", _fingerprints("text").alias("fp")), "simhash-prints")
    named = groups(prints.select("fp", F.col("doc_id").alias("id")))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def dedup(docs: DataFrame) -> DataFrame:
    """One document of each group, the one of least doc_id; all columns as they were."""
    bounded_batches(docs.sparkSession)
    cols = [F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(docs.columns)]
    id_ = F.struct(F.col("doc_id"), F.monotonically_increasing_id().alias("row")).alias("_id")
    rows = materialize(docs.select(*cols, id_, _fingerprints("text").alias("fp")), "simhash-rows")
    stay = groups(rows.select("fp", F.col("_id").alias("id"))).select(F.col("least.row").alias("_row")).distinct()
    kept = rows.withColumn("_row", F.col("_id.row")).join(stay, "_row", "left_semi")
    return kept.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(docs.columns)])
