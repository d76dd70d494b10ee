"""Label pairs within an edit similarity, by signatures that such labels share, so that the work
follows labels and near pairs instead of all pairs.

No near pair is missed: texts at most one edit apart share the whole text or one of the texts with a
character left out, and of k + 1 parts of a text one is left whole by k edits, at most k places
away. What shares a signature is compared in full. A part that all texts share finds all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import edit_similarity

#: Below this similarity the parts of a text are too short to tell texts apart.
LEAST = 0.75
_EPS = 1e-6


def _shortest(n: Column, threshold: float) -> Column:
    return F.ceil(n * threshold - _EPS).cast("int")


def _longest(n: Column, threshold: float) -> Column:
    return F.floor(n / threshold + _EPS).cast("int")


def _edits(n: Column, threshold: float) -> Column:
    """Most edits between a text of ``n`` characters and any near one."""
    return F.floor(_longest(n, threshold) * (1 - threshold) + _EPS).cast("int")


def _left_out(text: Column) -> Column:
    """The text, and it without each of its characters."""
    n = F.length(text)
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)))
    return F.when(n > 0, F.array_distinct(F.concat(F.array(text), less))).otherwise(F.array(text))


def _keys(length: Column, part: Column, pieces: Column) -> Column:
    return F.transform(pieces, lambda p: F.struct(length.alias("length"), part.alias("part"), p.alias("piece")))


def _start(j: Column, n: Column, k: Column) -> Column:
    return F.floor(j * n / (k + 1)).cast("int")


def _own(text: Column, threshold: float) -> Column:
    """Signatures of a text by the edits that its length allows: itself, with a character left out,
    or its parts."""
    n = F.length(text)
    k = _edits(n, threshold)
    part = lambda j: F.substring(text, _start(j, n, k) + 1, _start(j + 1, n, k) - _start(j, n, k))
    parts = F.transform(F.sequence(F.lit(0), k), lambda j: F.struct(n.alias("length"), j.alias("part"), part(j).alias("piece")))
    whole = F.when(k == 0, F.array(text)).otherwise(_left_out(text))
    return F.when(k <= 1, _keys(F.lit(-1), F.lit(-1), whole)).otherwise(parts)


def _sought(text: Column, threshold: float) -> Column:
    """Signatures of the texts that may be near to this one."""
    m = F.length(text)
    low, high = _shortest(m, threshold), _longest(m, threshold)
    whole = F.when(_edits(F.least(high, m + 1), threshold) == 0, F.array(text)).otherwise(_left_out(text))
    none = _keys(F.lit(-1), F.lit(-1), F.filter(F.array(text), lambda _: F.lit(False)))

    def of_part(n: Column, j: Column) -> Column:
        k = _edits(n, threshold)
        at, size = _start(j, n, k), _start(j + 1, n, k) - _start(j, n, k)
        first, last = F.greatest(at - k, F.lit(0)), F.least(at + k, m - size)
        return F.when(first <= last, _keys(n, j, F.transform(F.sequence(first, last), lambda p: F.substring(text, p + 1, size)))).otherwise(none)

    def of_length(n: Column) -> Column:
        k = _edits(n, threshold)
        return F.when(k > 1, F.flatten(F.transform(F.sequence(F.lit(0), k), lambda j: of_part(n, j)))).otherwise(none)

    short = F.when(_edits(low, threshold) <= 1, _keys(F.lit(-1), F.lit(-1), whole)).otherwise(none)
    return F.array_distinct(F.concat(short, F.flatten(F.transform(F.sequence(low, high), of_length))))


def near_labels(one: DataFrame, two: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(by, a, b): the pairs of a label ``a`` of the one and ``b`` of the other table, equal in ``by``,
    whose edit similarity is ``threshold`` (``LEAST`` or more) at least. Null labels are near none."""
    if threshold < LEAST:
        raise ValueError(f"similarities below {LEAST} have no signatures")
    x = one.select(*by, "a").distinct().select(*by, "a", F.explode(_own(F.col("a"), threshold)).alias("_key"))
    y = two.select(*by, "b").distinct().select(*by, "b", F.explode(_sought(F.col("b"), threshold)).alias("_key"))
    return x.join(y, [*by, "_key"]).where(edit_similarity(F.col("a"), F.col("b")) >= threshold).select(*by, "a", "b").distinct()
