from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.llm import radix_dedup, simhash
from matchloom.llm.components import connected_components

SCHEMA = "doc_id long, text string"
LONG = "lorem ipsum dolor " * 4000


def check_exact(spark, docs):
    rows = radix_dedup.dedup_report(spark.createDataFrame(docs, SCHEMA).repartition(5)).collect()
    groups: dict = {}
    for d, t in docs:
        groups.setdefault(t or "", []).append(d)
    assert len(rows) == len(docs)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in rows:
        ids = by_sha[r["text_sha256"]]
        assert r["doc_id"] in ids and r["group_size"] == len(ids) and r["keep_id"] == max(i for i in ids if i is not None)
    assert sum(r["kept"] for r in rows) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])


def test_exact_groups(spark):
    base = [None, "", " ", "a", "A", "é", "é", "x" * 31, "x" * 32, "x" * 33, "x" * 544, "x" * 545, LONG, LONG + "a", LONG + "b", LONG[:-1] + "!"]
    check_exact(spark, [(i, t) for i, t in enumerate(base * 3 + ["only"])])


def test_exact_repeated_ids_and_hot_group(spark):
    check_exact(spark, [(i, "hot copy " * 20) for i in range(700)] + [(3, "hot copy " * 20)] * 2 + [(900 + i, f"hot copy {i}") for i in range(50)])


def test_exact_dedup_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, "", "w"), (5, LONG, "v"), (6, LONG, "u")], "doc_id long, text string, _row string").withColumn("_len", F.lit(1))
    out = radix_dedup.dedup(docs)
    assert out.columns == docs.columns and {r["doc_id"]: r["text"] for r in out.collect()} == {2: "a", 4: "", 6: LONG}
    assert radix_dedup.dedup(docs.limit(0)).isEmpty() and radix_dedup.dedup_report(docs.limit(0)).isEmpty()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("abé ", max_size=40), max_size=30))
def test_exact_any_texts(spark, texts):
    docs = list(enumerate(texts))
    if docs:
        check_exact(spark, docs)


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute_groups(prints):
    """Least id reachable over links of at most two bits."""
    out = {}
    for start in sorted(prints):
        if start in out:
            continue
        todo = [start]
        out[start] = start
        while todo:
            x = todo.pop()
            for y in prints:
                if y not in out and (prints[x] ^ prints[y]).bit_count() <= 2:
                    out[y] = start
                    todo.append(y)
    return out


def near_docs():
    r = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    out = [None, "", "   ", "One", "one two", "ONE two three", "a\x1cb c d", "x y z w", "ÉA b c"]
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(30, 300))]
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = "changed"
            out.append(" ".join(copy))
    return list(enumerate(out))


@pytest.mark.parametrize("limit", [simhash.TREE, 4])
def test_simhash_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "TREE", limit)  # 4: shards are split
    docs = near_docs()
    prints = {d: brute_print(t) for d, t in docs}
    want = brute_groups(prints)
    got = simhash.dedup_report(spark.createDataFrame(docs, SCHEMA).repartition(4)).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{prints[d]:016x}", want[d]) for d in prints}


def test_a_hot_shard_is_split_into_smaller_trees(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TREE", 16)
    sizes = []
    whole = simhash.materialize

    def seen(df, name):
        out = whole(df, name)
        if name == "simhash-shards":
            sizes.append({(r["mask"], r["value"]): r["n"] for r in out.collect()})
        return out

    monkeypatch.setattr(simhash, "materialize", seen)
    r = random.Random(9)
    low = r.sample(range(1 << 12), 700)  # all in one shard of the upper bits, and dense
    far = [r.getrandbits(64) for _ in range(300)]
    values = sorted({*(x | 5 << 50 for x in low), *(x << 20 for x in low[:200]), *far, *(x ^ 1 << r.randrange(64) for x in far[:50])})
    prints = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    parts = {x["node"]: x["component"] for x in connected_components(simhash.links(prints)).collect()}
    got = {}
    for v in values:
        s = v - (1 << 64) if v >> 63 else v
        got.setdefault(parts.get(s, s), set()).add(v)
    want = {}
    for v, least in brute_groups({v: v for v in values}).items():
        want.setdefault(least, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert len(sizes) > 2 and max(sizes[0].values()) > 16 and max(sizes[-1].values()) <= 16


def test_simhash_dedup(spark):
    docs = spark.createDataFrame([(d, t, "s") for d, t in near_docs()], "doc_id long, text string, fp string")
    want = set(brute_groups({d: brute_print(t) for d, t in near_docs()}).values())
    out = simhash.dedup(docs.union(docs))
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(want)
    assert simhash.dedup(docs.limit(0)).isEmpty() and simhash.dedup_report(docs.limit(0)).isEmpty()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=60, unique=True), st.integers(0, 8))
def test_tree_finds_all_within_the_radius(values, radius):
    tree = simhash.BKTree()
    for i, v in enumerate(values):
        assert sorted(tree.search(v, radius)) == [j for j, x in enumerate(values[:i]) if (x ^ v).bit_count() <= radius]
        tree.add(v)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=60, unique=True))
def test_tree_links_tie_what_is_near(values):
    parts = {v: v for v in values}

    def top(v):
        return v if parts[v] == v else top(parts[v])

    for a, b in simhash.tree_links(values):
        parts[max(top(a), top(b))] = min(top(a), top(b))
    want = brute_groups({v: v for v in values})
    assert {v: top(v) for v in values} == want


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(200, 400)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(70)] + [(7, 7), (9, 8), (9, 8)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    near: dict = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want: dict = {}
    for s in sorted(near):
        todo = [] if s in want else [s]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = s
                todo += near[x]
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()
