"""Column functions over labels, IRIs and vectors."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import NAMESPACES

Tokenizer = Callable[[Column], Column]


def normalize_label(text: Column) -> Column:
    """Lower case, underscores as spaces."""
    return F.lower(F.replace(text, F.lit("_"), F.lit(" ")))


def unique_texts(texts: Column) -> Column:
    """An array without repeats, nulls and empty texts, order kept."""
    return F.array_remove(F.array_compact(F.array_distinct(texts)), "")


def fold_labels(properties: Sequence[Column]) -> Column:
    """Label arrays of several properties as one, in the order of the properties."""
    whole = [F.coalesce(p, F.array().cast("array<string>")) for p in properties]
    return unique_texts(F.transform(F.concat(*whole), normalize_label))


def word_tokens(label: Column) -> Column:
    """Words of a normalised label, repeats kept."""
    return F.regexp_extract_all(label, F.lit("[a-z0-9#]+"), F.lit(0))


def char_ngrams(n: int) -> Tokenizer:
    """Sub-word pieces without a vocabulary: n characters at each place (shorter labels whole)."""

    def pieces(label: Column) -> Column:
        count = F.greatest(F.length(label) - n + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(label, i, F.lit(n)))

    return pieces


def wordpiece(vocabulary: Sequence[str], unknown: str = "[UNK]", mark: str = "##") -> Tokenizer:
    """Longest-piece-first tokenizer over a given vocabulary, in Arrow batches; each word of a batch
    is cut once."""
    known = frozenset(vocabulary)
    longest = max(map(len, known), default=0)

    def word(text: str) -> list[str]:
        out, at = [], 0
        while at < len(text):
            for end in range(min(len(text), at + longest), at, -1):
                piece = (mark if at else "") + text[at:end]
                if piece in known:
                    out.append(piece)
                    at = end
                    break
            else:
                return [unknown]
        return out

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def pieces(labels: pa.Array) -> pa.Array:
        split = [(s or "").split() for s in labels.to_pylist()]
        cut = {w: word(w) for w in {w for words in split for w in words}}
        return pa.array([[p for w in words for p in cut[w]] for words in split], pa.list_(pa.string()))

    return pieces


def abbreviate(iri: Column, namespaces: Mapping[str, str] = NAMESPACES) -> Column:
    """The longest known namespace of an IRI as its short form; others unchanged."""
    out = iri
    for full in sorted(namespaces, key=len):
        out = F.when(iri.startswith(full), F.concat(F.lit(namespaces[full]), F.substring(iri, F.lit(len(full) + 1), F.length(iri)))).otherwise(out)
    return out


def expand(short: Column, namespaces: Mapping[str, str] = NAMESPACES) -> Column:
    """The inverse of ``abbreviate``; a short form that is not known gives null."""
    out = F.lit(None).cast("string")
    for full, name in namespaces.items():
        out = F.when(short.startswith(name), F.concat(F.lit(full), F.substring(short, F.lit(len(name) + 1), F.length(short)))).otherwise(out)
    return out


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longer)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null if one is zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of an array of vectors over the places where ``mask`` is 1; null if nowhere."""
    n = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m)
    scaled = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    first = F.transform(F.element_at(vectors, 1), lambda _: F.lit(0.0))
    total = F.aggregate(scaled, first, lambda s, v: F.zip_with(s, v, lambda p, q: p + q))
    return F.when(n > 0, F.transform(total, lambda x: x / n))


def first_pool(vectors: Column) -> Column:
    """The first of an array of vectors."""
    return F.element_at(vectors, 1)


def clamp(score: Column, low: float = 0.01) -> Column:
    """Scores up to ``low`` are 0."""
    return F.when(score <= low, F.lit(0.0)).otherwise(score)


def hash_int(*parts: Column | str | int) -> Column:
    """A number from the first 8 hex digits of the MD5 of the parts: the same in any engine."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
