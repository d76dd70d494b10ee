"""Spans of patterns in texts, in DataFrame functions only.

A span is a struct (s, e, m): start and end in code points, the end exclusive, and the matched
text. A pattern's matches and the gaps between them come from the same expression, so starts
are running sums of lengths. Patterns must not match the empty string.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a separator inside a run, so that a run is one class of characters: loops over
#: groups would recurse in the regular-expression engine on long runs.
JOINT, NOT_JOINT = chr(0xE000), chr(0xE001)
BLOCK = 128
EMPTY = "array<struct<s:int,e:int,m:string>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once: a lambda's variable holds its value, while an
    expression inside a lambda is worked out again at each of its steps."""
    return F.transform(F.array(value), body)[0]


def _running(steps: Column, start: Column, keep: Callable[[Column], Column] | None) -> Column:
    """Struct (at, out): spans of ``steps`` (g, m: length of the gap, matched text) from ``start`` on,
    of those whose text ``keep`` holds for."""
    state = F.struct(start.alias("at"), F.array().cast(EMPTY).alias("out"))

    def step(a: Column, x: Column) -> Column:
        s, e = a["at"] + x["g"], a["at"] + x["g"] + F.length(x["m"])
        more = F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))))
        return F.struct(e.alias("at"), (more if keep is None else F.when(keep(x["m"]), more).otherwise(a["out"])).alias("out"))

    return F.aggregate(steps, state, step)


def find(text: Column, pattern: str | Column, where: Column | None = None, keep: Callable[[Column], Column] | None = None) -> Column:
    """All matches of ``pattern`` from the left that do not overlap, in time linear in the text and
    its matches. ``where`` is a cheap test that texts with a match pass; of the matches only those
    whose text ``keep`` holds for are returned. In a text marked by ``joined`` the matched texts
    hold the mark.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, regex, F.lit(0))
    # start of match i = lengths of gaps 0..i and matches 0..i-1; the gap after the last has no match
    gaps = F.transform(F.split(text, regex, -1), lambda g: F.length(g))

    def spans(steps: Column) -> Column:
        # an array grows by copying, so blocks of matches are summed apart: no long array grows by ones
        # (each taken by place: a slice would copy the whole array)
        last = F.size(steps) - 1
        block_of = lambda k: F.transform(F.sequence(k * BLOCK, F.least(k * BLOCK + BLOCK - 1, last)), lambda i: F.get(steps, i))
        blocks = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int")), block_of))
        state = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{EMPTY}>").alias("out"))

        def block(a: Column, x: Column) -> Column:
            return bound(_running(x, a["at"], keep), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out")))

        return F.coalesce(F.flatten(F.aggregate(blocks, state, block)["out"]), F.array().cast(EMPTY))

    steps = F.filter(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda x: x["m"].isNotNull())
    test = F.rlike(text, regex) if where is None else where
    return F.when(test, bound(steps, spans)).otherwise(F.array().cast(EMPTY))


def joined(text: Column, separators: str, side: str) -> Column:
    """``text`` with each single separator between two characters of ``side`` marked as JOINT."""
    return F.regexp_replace(F.translate(text, JOINT, NOT_JOINT), f"(?<=[{side}])[{separators}](?=[{side}])", JOINT)


PIECE = 1024


def around(text: Column, spans: Column, width: int, body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body`` of each span, the ``width`` characters before it and those after it.

    A text is cut into pieces once and a window taken from the two that it can lie in, so many spans
    in a long text cost time in proportion."""

    def each(pieces: Column) -> Column:
        def cut(start: Column, size: Column) -> Column:
            at = F.floor(start / PIECE).cast("int")
            two = F.concat(F.coalesce(F.get(pieces, at), F.lit("")), F.coalesce(F.get(pieces, at + 1), F.lit("")))
            return F.substring(two, start - at * PIECE + 1, size)

        return F.transform(spans, lambda x: body(x, cut(F.greatest(x["s"] - width, F.lit(0)), F.least(x["s"], F.lit(width))), cut(x["e"], F.lit(width))))

    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), each)


def labelled(spans: Sequence[tuple[str, Column]]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, joined by commas."""

    def tagged(nth: int, kind: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(nth).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))

    ordered = F.array_sort(F.concat(*[tagged(i, kind, c) for i, (kind, c) in enumerate(spans)]))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
