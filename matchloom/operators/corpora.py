"""Label-pair corpora for training: synonyms, soft and hard non-synonyms, splits.

Sampling orders rows by an MD5 of seed and key instead of drawing random numbers, so results
are the same in any run and engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import checkpointed, dense_index
from ..functions.text import hash_int

SEED = 888


def synonyms(labels: DataFrame) -> DataFrame:
    """(a, b): ordered pairs of different labels of one class, over all classes."""
    x = labels.select("onto", "iri", F.col("label").alias("a"))
    y = labels.select("onto", "iri", F.col("label").alias("b"))
    return x.join(y, ["onto", "iri"]).where("a <> b").select("a", "b").distinct()


def identity_synonyms(labels: DataFrame) -> DataFrame:
    """(a, a) of every label."""
    return labels.select(F.col("label").alias("a"), F.col("label").alias("b")).distinct()


def not_synonyms(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of different labels that are no synonyms in either order."""
    return pairs.where("a <> b").join(both_ways(known), ["a", "b"], "left_anti")


def both_ways(pairs: DataFrame) -> DataFrame:
    """(a, b) of pairs in either order; they are worked out once."""
    turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    return pairs.select(F.explode(F.array(F.struct("a", "b"), turned)).alias("_pair")).select("_pair.*").distinct()


def _other(idx: Column, n: Column, draw: Column) -> Column:
    """An index in 0..n-1 other than ``idx``."""
    return (idx + 1 + draw % (n - 1)) % n


def _nth_label(groups: DataFrame, key: str, name: str) -> DataFrame:
    """(key, labels): the sorted labels of each class."""
    return groups.groupBy(key).agg(F.sort_array(F.collect_set("label")).alias(name))


def soft_draws(labels: DataFrame, rate: int, seed: int = SEED) -> DataFrame:
    """(a, b): per class and label, ``rate`` draws of a label of another class, unchecked.

    Only classes with labels are drawn."""
    classes = checkpointed(dense_index(labels.select("iri").distinct(), ["iri"]))  # read three times
    n = classes.agg(F.count("*").alias("n"))
    rows = labels.select("iri", "label").join(classes, "iri").crossJoin(F.broadcast(n)).where("n > 1")  # one row
    rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(rate))))
    rows = rows.withColumn("other", _other(F.col("idx"), F.col("n"), hash_int(seed, F.col("label"), F.col("iri"), F.col("draw"))))
    drawn = classes.join(_nth_label(labels, "iri", "texts"), "iri").select(F.col("idx").alias("other"), "texts")
    at = hash_int(seed + 1, F.col("label"), F.col("iri"), F.col("draw")) % F.size("texts")
    return rows.join(drawn, "other").select(F.col("label").alias("a"), F.element_at("texts", (at + 1).cast("int")).alias("b"))


def soft_nonsynonyms(labels: DataFrame, known: DataFrame, rate: int = 10, seed: int = SEED) -> DataFrame:
    """(a, b): checked draws, in both orders."""
    return both_ways(not_synonyms(soft_draws(labels, rate, seed), known))


def hard_nonsynonyms(labels: DataFrame, edges: DataFrame, known: DataFrame, depth: DataFrame | None = None, depth_threshold: int | None = None) -> DataFrame:
    """(a, b): labels of different children of one parent, in both orders.

    With ``depth_threshold`` (0 counts) only parents up to that depth in ``depth`` (iri, depth)."""
    e = edges.select("parent", "child").distinct()
    if depth_threshold is not None:
        deep = depth.where(F.col("depth") <= depth_threshold).select(F.col("iri").alias("parent"))
        e = e.join(deep, "parent", "left_semi")
    x, y = e.select("parent", F.col("child").alias("c1")), e.select("parent", F.col("child").alias("c2"))
    siblings = x.join(y, "parent").where("c1 < c2").select("c1", "c2").distinct()
    one = labels.select(F.col("iri").alias("c1"), F.col("label").alias("a"))
    two = labels.select(F.col("iri").alias("c2"), F.col("label").alias("b"))
    return both_ways(not_synonyms(siblings.join(one, "c1").join(two, "c2").select("a", "b"), known))


def mapped_labels(mappings: DataFrame, src: DataFrame, tgt: DataFrame) -> DataFrame:
    """(src, tgt, a, b): label pairs of mapped classes."""
    one = src.select(F.col("iri").alias("src"), F.col("label").alias("a"))
    two = tgt.select(F.col("iri").alias("tgt"), F.col("label").alias("b"))
    return mappings.select("src", "tgt").join(one, "src").join(two, "tgt")


def cross_synonyms(mappings: DataFrame, src: DataFrame, tgt: DataFrame) -> DataFrame:
    """(a, b): labels of mapped classes, in both orders (equal labels included)."""
    return both_ways(mapped_labels(mappings, src, tgt))


def cross_soft_nonsynonyms(mappings: DataFrame, src: DataFrame, tgt: DataFrame, known: DataFrame, rate: int = 10, seed: int = SEED) -> DataFrame:
    """(a, b): a label of a mapped class with one of the opposite class of another mapping."""
    maps = checkpointed(dense_index(mappings.select("src", "tgt").distinct(), ["src", "tgt"]))  # read five times
    n = maps.agg(F.count("*").alias("n"))
    out = None
    for own, other, labels, texts in (("src", "tgt", src, tgt), ("tgt", "src", tgt, src)):
        rows = maps.crossJoin(F.broadcast(n)).where("n > 1").join(labels.select(F.col("iri").alias(own), "label"), own)  # one row
        rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(rate))))
        key = [F.col("label"), F.col("src"), F.col("tgt"), F.col("draw")]
        rows = rows.select("label", "src", "tgt", "draw", _other(F.col("idx"), F.col("n"), hash_int(seed, *key)).alias("nth"))
        drawn = maps.join(_nth_label(texts.select(F.col("iri").alias(other), "label"), other, "texts"), other).select(F.col("idx").alias("nth"), "texts")
        at = hash_int(seed + 1, *key) % F.size("texts")
        pairs = rows.join(drawn, "nth").select(F.col("label").alias("a"), F.element_at("texts", (at + 1).cast("int")).alias("b"))
        out = pairs if out is None else out.unionByName(pairs)
    return both_ways(not_synonyms(out, known))


def corpus(synonym: DataFrame, soft: DataFrame, hard: DataFrame | None = None) -> DataFrame:
    """(a, b, kind) of the parts of a corpus."""
    out = synonym.select("a", "b", F.lit("synonym").alias("kind")).unionByName(soft.select("a", "b", F.lit("soft").alias("kind")))
    return out if hard is None else out.unionByName(hard.select("a", "b", F.lit("hard").alias("kind")))


def merge(one: DataFrame, two: DataFrame, strict: bool = True) -> DataFrame:
    """Two corpora as one: pairs without repeats; non-synonyms that are synonyms of either go.

    Without ``strict`` only those that ``two`` adds are checked again."""
    known = one.unionByName(two).where("kind = 'synonym'").select("a", "b").distinct()
    negative = F.col("kind") != "synonym"
    pairs = one.where(negative).unionByName(two.where(negative)).distinct()
    checked = not_synonyms(pairs, known)
    if not strict:
        checked = checked.unionByName(one.where(negative)).distinct()
    return known.select("a", "b", F.lit("synonym").alias("kind")).unionByName(checked.select("a", "b", "kind"))


def corpus_stats(pairs: DataFrame) -> DataFrame:
    """(kind, n_pairs, n_labels)"""
    return pairs.groupBy("kind").agg(F.count("*").alias("n_pairs"), F.countDistinct("a").alias("n_labels"))


def label_rows(pairs: DataFrame) -> DataFrame:
    """(sent1, sent2, label) of corpus pairs, without repeats."""
    label = (F.col("kind") == "synonym").cast("int")
    return pairs.select(F.col("a").alias("sent1"), F.col("b").alias("sent2"), label.alias("label")).distinct()


def take(pairs: DataFrame, n: int, seed: int = SEED, fewer: bool = False) -> DataFrame:
    """``n`` of the pairs (a, b), the first by hash; if there are fewer, an error, or with ``fewer`` all."""
    salted = checkpointed(dense_index(pairs.select("a", "b", F.lit(seed).alias("_seed")), ["_seed", "a", "b"]))
    if not fewer and salted.count() < n:
        raise ValueError(f"fewer than {n} non-synonyms: lower the rate or sample more")
    return salted.where(F.col("idx") < n).select("a", "b")


def cross_label_data(pairs: DataFrame, soft_rate: int, seed: int = SEED, fewer: bool = False) -> DataFrame:
    """All synonyms of a corpus with ``soft_rate`` soft non-synonyms for each."""
    known = pairs.where("kind = 'synonym'").select("a", "b")
    soft = take(pairs.where("kind = 'soft'"), soft_rate * known.count(), seed, fewer)
    return label_rows(corpus(known, soft))


def intra_label_data(pairs: DataFrame, identity: DataFrame, soft_rate: int, hard_rate: int, val_ratio: float = 0.2, seed: int = SEED, fewer: bool = False) -> DataFrame:
    """(sent1, sent2, label, split): label data of a corpus without and with identity pairs.

    Splits are train and val over synonyms and their negatives, and train_ids and val_ids over
    identity pairs and theirs; ``val_ratio`` 0 leaves train and train_ids only."""
    out = None
    soft, hard = pairs.where("kind = 'soft'"), pairs.where("kind = 'hard'")
    for known, suffix, salt in ((pairs.where("kind = 'synonym'").select("a", "b"), "", 0), (identity, "_ids", 10)):
        n = known.count()
        rows = label_rows(corpus(known, take(soft, soft_rate * n, seed + salt, fewer), take(hard, hard_rate * n, seed + salt + 1, fewer)))
        cut = split(rows, ["sent1", "sent2", "label"], {"train" + suffix: 1 - val_ratio, "val" + suffix: val_ratio}, seed)
        out = cut if out is None else out.unionByName(cut)
    return out


def split(rows: DataFrame, key: list[str], shares: dict[str, float], seed: int = SEED) -> DataFrame:
    """``rows`` with ``split``: names by shares, which must sum to 1, of exact sizes.

    Each share but the last is cut off what is left, the rest rounded up; by hash order."""
    if abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares do not sum to 1")
    numbered = checkpointed(dense_index(rows.withColumn("_seed", F.lit(seed)), ["_seed", *key]).drop("_seed"))
    left, share, at, name = numbered.count(), 1.0, 0, F.lit(None).cast("string")
    for k, (part, s) in enumerate(shares.items()):
        last = k == len(shares) - 1
        n = left if last else left - math.ceil(round(left * (share - s) / share, 9))
        name = F.when(F.col("idx").between(at, at + n - 1), F.lit(part)).otherwise(name)
        left, share, at = left - n, share - s, at + n
    return numbered.withColumn("split", name).drop("idx")


def semi_supervised(intra: DataFrame, identity: DataFrame, cross: dict[str, DataFrame], soft_rate: int, hard_rate: int, cross_rate: int, seed: int = SEED, fewer: bool = False) -> DataFrame:
    """(split, sent1, sent2, label): train, train+ (with identity pairs), val, test; ``cross`` has
    the corpora of the train, val and test mappings. ``fewer``: see ``take``."""
    io = intra_label_data(intra, identity, soft_rate, hard_rate, 0.0, seed, fewer)
    data = {name: cross_label_data(c, cross_rate, seed, fewer) for name, c in cross.items()}
    plain = io.where("split = 'train'").drop("split").unionByName(data["train"])
    parts = {"train": plain, "train+": plain.unionByName(io.where("split = 'train_ids'").drop("split")), "val": data["val"], "test": data["test"]}
    return _splits(parts)


def unsupervised(intra: DataFrame, identity: DataFrame, cross: DataFrame, soft_rate: int, hard_rate: int, cross_rate: int, seed: int = SEED, fewer: bool = False) -> DataFrame:
    """(split, sent1, sent2, label): train, train+, val, val+ of one hierarchy's corpus, and all
    mappings as test. ``fewer``: see ``take``."""
    io = intra_label_data(intra, identity, soft_rate, hard_rate, 0.2, seed, fewer)
    part = lambda *names: io.where(F.col("split").isin(*names)).drop("split")
    parts = {"train": part("train"), "train+": part("train", "train_ids"), "val": part("val"), "val+": part("val", "val_ids"), "test": cross_label_data(cross, cross_rate, seed, fewer)}
    return _splits(parts)


def _splits(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, rows in parts.items():
        rows = rows.distinct().select(F.lit(name).alias("split"), "sent1", "sent2", "label")
        out = rows if out is None else out.unionByName(rows)
    return out


def conflicts(rows: DataFrame) -> DataFrame:
    """(split, sent1, sent2) that are both positive and negative in a split."""
    return rows.groupBy("split", "sent1", "sent2").agg(F.countDistinct("label").alias("n")).where("n > 1").drop("n")
