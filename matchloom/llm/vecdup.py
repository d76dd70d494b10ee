"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector is rotated into ``BITS`` dimensions by a seeded random matrix with orthonormal
columns; its code is the signs, its correction factor f the inner product of the rotated vector
with its code scaled to unit length. The code's inner product with another rotated vector over
f is an unbiased estimate of the cosine, with deviation sqrt((1 - f^2) / f^2 / (BITS - 1)).
Where the estimate plus ``CONFIDENCE`` deviations, taken either way round, reaches the threshold,
the cosine is computed again in double precision, and that alone decides.

Two passes find the pairs to estimate, so that vectors travel only where a near one is:

1. Codes (32 bytes) go to buckets of ``k`` of their bits, over several tables of other bits. In a
   bucket, codes that differ in more bits than a pair right at the threshold does are passed over;
   a large bucket is searched in smaller ones of further bits. What is near is tied to groups.
   A pair counts in the first table where it meets, so that a group comes out of few tables.
2. The vectors of the groups' members, and no others, are fetched; pairs in a group are estimated
   under confidence bounds, and computed exactly where the bounds ask for it.

``plan`` takes as many tables as find a pair right at the threshold with probability 1 - ``MISS``,
summed over the number of bits that the pair's codes may differ in (all tables draw from the same
code). Equal vectors are one vector with a weight, named by a 64-bit hash (a second hash tells
whether two share a name; then another seed is taken). A bucket of more than ``CHUNK`` codes and a
group of more than ``GROUP`` vectors are cut into chunks, each pair of chunks a cell of its own, so
that no task gets a whole hot one. A cell returns per vector its links' weight and one link to the
least vector it is tied to, not its pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing (0 links, a component of their own); vectors of different lengths never link;
rows that repeat vec_id or vector are rows of their own; a cosine right at the threshold links;
the least vec_id names a component, so ties need no rule; a null vec_id is ignored in naming a
component unless it is alone; very long vectors have codes of their length; empty tables give empty
results; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize
from .components import connected_components

THRESHOLD = 0.95
BITS = 256
CONFIDENCE = 4.0
MISS = 1e-4
#: Codes that a bucket has on average at most, and the least bits of a bucket.
BUCKET, LEAST_BITS = 1 << 18, 4
#: Codes of a cell at most; larger buckets are cut into chunks of half of it.
CHUNK = 1 << 19
#: Codes that are compared with one another in a cell; larger cells are searched by further bits, in
#: buckets of ``NARROW`` on average, with a miss of ``LOCAL_MISS``.
LOCAL, NARROW, LOCAL_MISS = 8192, 512, 0.01
#: Codes that are compared at once, vectors of a cell, and rows of small cells estimated at once.
BLOCK, GROUP, BATCH = 512, 512, 128
SEED = 8


@lru_cache(maxsize=8)
def rotation(size: int) -> np.ndarray:
    """A matrix of max(BITS, size) rows and ``size`` orthonormal columns."""
    rows = max(BITS, size)
    q, r = np.linalg.qr(np.random.default_rng([SEED, size]).standard_normal((rows, size)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, rotated vectors, signs (bool) and correction factors of rows that are valid."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    turned = unit @ rotation(x.shape[1]).T
    return unit, turned.astype(np.float32), turned >= 0, np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])


def _bits(size: int) -> int:
    """Bits of a code: whole words."""
    return (max(BITS, size) + 63) // 64 * 64


def packed(signs: np.ndarray) -> np.ndarray:
    """Signs as code words, the bits that fill the last word 0."""
    full = np.zeros((len(signs), _bits(signs.shape[1])), bool)
    full[:, : signs.shape[1]] = signs
    return np.packbits(full, axis=1, bitorder="little").view("<u8")


def bucket_keys(code: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The key of each code in each table (a row of bits each)."""
    out = np.zeros((len(code), len(bits)), np.int64)
    for t, row in enumerate(bits):
        for j, bit in enumerate(row.tolist()):
            out[:, t] |= (code[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)).astype(np.int64) << j
    return out


def _agree(total: int, differ: np.ndarray, k: int) -> np.ndarray:
    """Chance that k of ``total`` bits, drawn without return, are none of those that differ."""
    out = np.ones(len(differ))
    for i in range(k):
        out *= np.clip(total - differ - i, 0, None) / (total - i)
    return out


def local_tables(m: int) -> tuple[int, int]:
    """Bits and number of the further tables in a cell of ``m`` codes."""
    k = max(1, math.ceil(math.log2(m / NARROW)))
    return k, math.ceil(math.log(LOCAL_MISS) / math.log(1 - (1 - math.acos(THRESHOLD) / math.pi) ** k))


@lru_cache(maxsize=32)
def plan(n: int, size: int) -> tuple[np.ndarray, int]:
    """For ``n`` vectors of ``size`` components: a row of code bits for each table, and the most
    bits in which codes of a pair differ that is compared."""
    rows, k = max(BITS, size), max(LEAST_BITS, math.ceil(math.log2(max(n, 2) / BUCKET)))
    p, h = math.acos(THRESHOLD) / math.pi, np.arange(rows + 1)
    log = math.lgamma(rows + 1) - np.array([math.lgamma(x + 1) + math.lgamma(rows - x + 1) for x in h]) + h * math.log(p) + (rows - h) * math.log(1 - p)
    share = np.exp(log)
    limit = int(np.argmax(np.cumsum(share) >= 1 - MISS / 4))
    meet, m = _agree(rows, h, k), 2 * n / 2**k
    if m > LOCAL:
        further, times = local_tables(int(m))
        meet = meet * (1 - (1 - _agree(rows - k, h, further)) ** times)
    tables = next(t for t in count(1) if share[: limit + 1] @ (1 - meet[: limit + 1]) ** t + share[limit + 1 :].sum() <= MISS)
    rng = np.random.default_rng([SEED, size, k])
    return np.stack([rng.choice(rows, k, replace=False) for _ in range(tables)]), limit


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Per row the least row that links tie it to."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        if (a == b).all():
            return root
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root[root] != root).any():
            root = root[root]


class Groups:
    """Ties near codes of a cell to groups."""

    def __init__(self, code: np.ndarray, keys: np.ndarray, table: int, limit: int, side: np.ndarray | None) -> None:
        self.code, self.keys, self.table, self.limit, self.side = code, keys, table, limit, side
        self.parent = np.arange(len(code))

    def roots(self, i: np.ndarray) -> np.ndarray:
        out = self.parent[i]
        while (self.parent[out] != out).any():
            out = self.parent[out]
        return out

    def _done(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether two blocks are one group already, or met as a whole in a table before."""
        top = self.roots(a)
        if (top == top[0]).all() and (self.roots(b) == top[0]).all():
            return True
        before = self.keys[:, : self.table]
        first = before[a[0]]
        return bool(((before[a] == first).all(axis=0) & (before[b] == first).all(axis=0)).any())

    def _tie(self, a: np.ndarray, b: np.ndarray) -> None:
        differ = np.zeros((len(a), len(b)), np.uint16)
        for w in range(self.code.shape[1]):
            differ += np.bitwise_count(self.code[a, w][:, None] ^ self.code[b, w][None, :])
        i, j = np.nonzero(differ <= self.limit)
        x, y = a[i], b[j]
        new = x != y
        if self.side is not None:
            new &= self.side[x] != self.side[y]
        i, j, x, y = i[new], j[new], x[new], y[new]
        new = (self.keys[x] == self.keys[y]).argmax(axis=1) == self.table
        i, j = i[new], j[new]
        if not len(i):
            return
        nodes = np.concatenate([a, b])
        star = _stars(len(nodes), i, len(a) + j)
        for x, y in zip(nodes[star != np.arange(len(nodes))].tolist(), nodes[star[star != np.arange(len(nodes))]].tolist()):
            x, y = self.top(x), self.top(y)
            self.parent[max(x, y)] = min(x, y)

    def top(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return int(x)

    def compare(self, rows: np.ndarray) -> None:
        """Tie what is near among ``rows``. Rows that met before or are near come one after
        another, so that whole blocks are found done: a dense bucket costs little more than its
        rows."""
        order = np.lexsort((self.code[rows, 0], *self.keys[rows, : self.table].T[::-1])) if len(rows) > BLOCK else slice(None)
        rows = rows[order]
        blocks = [rows[at : at + BLOCK] for at in range(0, len(rows), BLOCK)]
        for k, a in enumerate(blocks):
            for b in blocks[k:]:
                if not (a is not b and self._done(a, b)):
                    self._tie(a, b)

    def search(self, size: int, used: Sequence[int]) -> np.ndarray:
        """The root of each row's group."""
        m = len(self.code)
        if m <= LOCAL:
            self.compare(np.arange(m))
        else:
            k, times = local_tables(m)
            rng = np.random.default_rng([SEED, size, self.table, k])
            free = np.setdiff1d(np.arange(max(BITS, size)), used)
            for _ in range(times):
                key = bucket_keys(self.code, rng.choice(free, k, replace=False)[None])[:, 0]
                order = np.argsort(key, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                    if len(rows) > 1:
                        self.compare(rows)
        return self.roots(np.arange(m))


def linked_pairs(vectors: np.ndarray, apart: np.ndarray, table: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j whose cosine reaches the threshold, that did not meet in a table before the
    rows' own, and that ``apart`` does not keep from each other."""
    unit, turned, signs, f = encode(vectors)
    scale = (math.sqrt(signs.shape[1]) * f)[:, None]
    estimate = (np.where(signs, np.float32(1), np.float32(-1)) @ turned.T) / scale
    upper = estimate + (CONFIDENCE * np.sqrt(np.maximum(1 - f * f, 0) / (f * f) / (signs.shape[1] - 1)))[:, None]
    i, j = np.nonzero(np.triu((np.minimum(upper, upper.T) >= THRESHOLD) & ~apart, 1))
    if not len(i):
        return i, j
    keys = bucket_keys(packed(signs), bits)
    new = (keys[i] == keys[j]).argmax(axis=1) == table[i]
    i, j = i[new], j[new]
    # the cosine itself: a plain sum in double precision
    exact = (unit[i] * unit[j]).sum(axis=1) >= THRESHOLD
    return i[exact], j[exact]


def _cells(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole cells (runs of equal ``keys``) with the cells' edges, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None

    def whole() -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        name = np.stack([rows[k].to_numpy() for k in keys], axis=1)
        return rows, np.concatenate([[0], np.flatnonzero((np.diff(name, axis=0) != 0).any(axis=1)) + 1, [len(name)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        name = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        cuts = np.flatnonzero((np.diff(name, axis=0) != 0).any(axis=1)) + 1
        if last is not None and (name[0] != last).any():
            yield whole()
            held.clear()
        if len(cuts):
            held.append(batch.slice(0, int(cuts[-1])))
            yield whole()
            held.clear()
        held.append(batch.slice(int(cuts[-1]) if len(cuts) else 0))
        last = name[-1]
    if held:
        yield whole()


def _words(rows: pa.Table, column: str, width: int) -> np.ndarray:
    """A column of codes of ``width`` words."""
    return np.frombuffer(b"".join(rows[column].to_pylist()), "<u8").reshape(-1, width)


CELL = ["size", "table", "key", "low", "high"]
GROUPED = ["table", "low", "high", "root", "low2", "high2"]


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors (v, size, vector) to their codes (v, size, code)."""
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes).tolist():
            rows = batch.filter(pa.array(sizes == size))
            code = packed(encode(np.asarray(rows.column("vector").flatten()).reshape(-1, size))[2])
            yield pa.RecordBatch.from_arrays([rows.column("v"), rows.column("size"), pa.array(list(map(bytes, code.view(np.uint8))), pa.binary())], names=["v", "size", "code"])


def _routed(n: int):
    """Codes to a row per table: size, table, key, v, code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                rows = pa.Table.from_batches([batch.filter(pa.array(sizes == size))])
                keys = bucket_keys(_words(rows, "code", _bits(size) // 64), plan(n, size)[0])
                for t in range(keys.shape[1]):
                    columns = [pa.array(np.full(len(keys), size, np.int32)), pa.array(np.full(len(keys), t, np.int32)), pa.array(keys[:, t]), rows["v"].combine_chunks(), rows["code"].combine_chunks()]
                    yield pa.RecordBatch.from_arrays(columns, names=["size", "table", "key", "v", "code"])

    return run


def _tied(n: int):
    """Cells of codes to the members of groups: table, low, high, root, v, chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in _cells(batches, CELL):
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if y - x < 2:
                    continue
                some = rows.slice(x, y - x)
                size, table, low, high = (some[c][0].as_py() for c in ("size", "table", "low", "high"))
                bits, limit = plan(n, size)
                code, v, chunk = _words(some, "code", _bits(size) // 64), some["v"].to_numpy(), some["chunk"].to_numpy()
                groups = Groups(code, bucket_keys(code, bits), table, limit, chunk if low != high else None)
                root = groups.search(size, bits[table])
                many = np.bincount(root, minlength=len(root))[root] > 1
                same = np.full(int(many.sum()), 1, np.int32)
                columns = [pa.array(same * table), pa.array(same * low), pa.array(same * high), pa.array(v[root[many]]), pa.array(v[many]), pa.array(chunk[many])]
                yield pa.RecordBatch.from_arrays(columns, names=["table", "low", "high", "root", "v", "chunk"])

    return run


def _linked(n: int):
    """Cells of vectors to (a, b, links): vector, a vector it is tied to, weight of its new links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
            size, cell = rows["size"][0].as_py(), np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            vectors = np.asarray(rows["vector"].combine_chunks().flatten()).reshape(-1, size)
            v, weight, table, chunk, chunk2, low, high, low2, high2 = (rows[c].to_numpy() for c in ("v", "weight", "table", "chunk", "chunk2", "low", "high", "low2", "high2"))
            apart = cell[:, None] != cell[None, :]
            # in a cell of two chunks only pairs of one and the other are new
            apart |= (low != high)[:, None] & (chunk[:, None] == chunk[None, :])
            apart |= (low2 != high2)[:, None] & (chunk2[:, None] == chunk2[None, :])
            i, j = linked_pairs(vectors, apart, table, plan(n, size)[0])
            links = np.zeros(len(v), np.int64)
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            root, got = _stars(len(v), i, j), np.flatnonzero(links)
            return pa.RecordBatch.from_pydict({"a": pa.array(v[got]), "b": pa.array(v[root[got]]), "links": pa.array(links[got])})

        for rows, edges in _cells(batches, GROUPED):
            sizes, at = rows["size"].to_numpy(), 0
            while at < len(edges) - 1:  # small cells of one length are solved together
                to = at + 1
                while to < len(edges) - 1 and edges[to + 1] - edges[at] <= BATCH and sizes[edges[to]] == sizes[edges[at]]:
                    to += 1
                if edges[to] - edges[at] > 1:
                    yield solve(rows.slice(int(edges[at]), int(edges[to] - edges[at])), edges[at : to + 1])
                at = to

    return run


def _chunked(rows: DataFrame, by: list[str], most: int, suffix: str = "") -> DataFrame:
    """``rows`` with ``chunk``, ``low`` and ``high`` (and a suffix): one cell for a key of up to
    ``most`` rows, else a cell for each pair of its chunks of about most / 2 rows."""
    hot = materialize(rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > most), "vec-hot")
    chunks = F.coalesce(F.ceil(2 * F.col("_n") / most), F.lit(1)).cast("int")
    cut = rows.join(hot, by, "left").withColumn("_chunks", chunks).withColumn(f"chunk{suffix}", F.pmod(F.xxhash64(F.lit(SEED), "v"), F.col("_chunks")).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    low, high = F.least(f"chunk{suffix}", "_other"), F.greatest(f"chunk{suffix}", "_other")
    return cut.withColumn(f"low{suffix}", low).withColumn(f"high{suffix}", high).drop("_n", "_chunks", "_other")


def _named(rows: DataFrame, seed: int) -> DataFrame:
    return rows.withColumn("v", F.xxhash64(F.lit(seed), "_e"))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    bounded_batches(vectors.sparkSession)
    e = F.col("_e")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").alias("_id"), F.col("embedding").alias("_e"))
    rows = rows.withColumn("_ok", F.coalesce(F.forall(e, finite) & F.exists(e, lambda x: x != 0), F.lit(False)))
    for seed in count(SEED):
        valid = _named(rows.where("_ok"), seed)
        check = F.xxhash64(F.lit(-1 - seed), "_e", F.size("_e"))
        names = valid.groupBy("v").agg(F.min("_id").alias("least"), F.count("*").alias("weight"), (F.min(check) == F.max(check)).alias("_one"))
        names = materialize(names, "vec-names")
        if names.where("not _one").isEmpty():  # no two vectors share a name
            break
    n = names.count()
    codes = valid.select("v", F.size("_e").alias("size"), e.alias("vector")).mapInArrow(_coded, "v long, size int, code binary")
    codes = materialize(codes.groupBy("v", "size").agg(F.first("code").alias("code")), "vec-codes")
    routed = codes.mapInArrow(_routed(n), "size int, table int, key long, v long, code binary")
    cells = _chunked(routed, ["size", "table", "key"], CHUNK)
    cells = cells.repartition(*CELL).sortWithinPartitions(*CELL)
    tied = materialize(cells.mapInArrow(_tied(n), "table int, low int, high int, root long, v long, chunk int"), "vec-tied")
    wanted = tied.select("v").distinct()
    fetched = valid.select("v", F.size("_e").alias("size"), e.alias("vector")).join(wanted, "v", "left_semi").groupBy("v", "size").agg(F.first("vector").alias("vector"))
    groups = _chunked(tied, ["table", "low", "high", "root"], GROUP, "2")
    groups = groups.join(fetched, "v").join(names.select("v", "weight"), "v").repartition(*GROUPED).sortWithinPartitions(*GROUPED)
    found = materialize(groups.mapInArrow(_linked(n), "a long, b long, links long"), "vec-links")
    links = found.groupBy(F.col("a").alias("v")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("a", "b")).select(F.col("node").alias("v"), "component")
    named = names.select("v", "least", "weight").join(links, "v", "left").join(parts, "v", "left").withColumn("component", F.coalesce("component", "v"))
    named = materialize(named, "vec-named")
    least = named.groupBy("component").agg(F.min("least").alias("name"))
    named = named.join(least, "component").select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "name")
    out = valid.select("_id", "v").join(named, "v").select("_id", "n_links", "name")
    out = out.unionByName(rows.where("not _ok").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("name")))
    return out.select(F.col("_id").alias("vec_id"), "n_links", F.col("name").alias("component_id"), F.col("_id").eqNullSafe(F.col("name")).alias("kept"))
