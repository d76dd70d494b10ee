"""Secret scan: fixed patterns, and the Shannon entropy of sliding windows per character class.

The base kinds (assign, access, hex) are patterns. The kind ``entropy`` adds candidates: runs of
``CANDIDATE`` characters, with letters and digits or with letters of both cases in like numbers, in
which some window of ``WINDOW`` characters, all of one class (hexadecimal or letters and digits of
one case, or base-64), has an entropy of at least the class's threshold. A window's entropy is
log2(W) - S / W where S sums c log2 c over its counts; sliding it by one character changes one
count up and one down, so S is kept by increments, in time linear in the run. A span goes from
the start of the first such window to the end of the last.

The allow list suppresses whole candidates (identifiers that look random but are public), and
spans that are no more than its words: what is left of them without the words is under
``WINDOW`` characters. Candidates that touch a base span are not added either.

All in DataFrame functions; a document is looked at alone, so nothing is shuffled.

Defined results: null text counts as empty; no spans give 0, the SHA-256 of the empty string,
and an empty string; spans of one start are ordered by kind as listed; very long texts and runs are
scanned whole, in time linear in their length and matches; rows that repeat are scanned each;
empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import bound, find, labelled

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORD = r"(?i:passw(?:or)?d|secret|token|api_?key)"
#: A run's pieces under the least length never match elsewhere, so lengths stand in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
LEAST_VALUE = 8
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Sums by increments are compared up to their rounding.
ROUNDING = 1e-9
#: Class of characters and least entropy in bits of a window that is all of that class.
CLASSES = (("[0-9a-f]", 3.0), ("[0-9A-F]", 3.0), ("[0-9a-z]", 3.5), ("[0-9A-Z]", 3.5), ("[A-Za-z0-9+/_=-]", 3.9))
#: A candidate without digits needs this share of each case: words joined by capitals have less.
CASE_SHARE = 0.3
#: Public identifiers, as whole candidates: UUIDs, runs of one or two characters, words with a number.
ALLOWED_RUNS = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^(.)\1+$",
    r"^[A-Za-z_/-]+[0-9]{1,4}$",
    r"^[0-9_/=+-]+$",
)
#: Counted-up alphabets and examples.
ALLOWED_WORDS = r"(?i)abcdefghij(?:klmnopqrstuvwxyz)?|0123456789(?:abcdef)?|qwertyuiop|example|placeholder|x{8,}"
#: The characters of candidates; a character's place here is its number.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _entropy_spans(text: Column, base: Column) -> Column:
    runs = find(text, CANDIDATE)

    def candidate(x: Column) -> Column:
        m, size = x["m"], F.length(x["m"])
        mixed = F.lit(True)
        for kind in ("A-Z", "a-z"):
            mixed = mixed & (F.length(F.regexp_replace(m, f"[^{kind}]", "")) >= size * CASE_SHARE)
        ok = m.rlike("[A-Za-z]") & (m.rlike("[0-9]") | mixed) & ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        for pattern in ALLOWED_RUNS:
            ok = ok & ~m.rlike(pattern)
        return ok

    # c log2 c for the counts 0..WINDOW; the number of each ASCII character; which classes it is in
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    number = F.array(*[F.lit(ALPHABET.find(chr(c)) + 1) for c in range(128)])
    member = [F.array(*[F.lit(bool(re.fullmatch(kind, c))) for c in ALPHABET]) for kind, _ in CLASSES]

    def windows(x: Column) -> Column:
        """(s, e, f) of the run's span, f under 0 if it has none."""
        codes = F.transform(F.split(x["m"], ""), lambda c: F.element_at(number, F.ascii(c) + 1))
        # each step: the character that comes, the one that goes (0: none yet), and how many have come
        pairs = bound(codes, lambda c: F.transform(c, lambda new, i: F.struct(new.alias("new"), F.when(i >= WINDOW, F.get(c, i - WINDOW)).otherwise(0).alias("old"), (i + 1).alias("i"))))
        start = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).alias("sum"),
            F.array(*[F.lit(0)] * len(CLASSES)).alias("run"), F.lit(-1).alias("first"), F.lit(-1).alias("last"),
        )

        def step(a: Column, p: Column) -> Column:
            new, old = p["new"], p["old"]
            c_out = F.when(old > 0, F.get(a["n"], old - 1)).otherwise(0)
            c_in = F.get(a["n"], new - 1) - F.when(new == old, 1).otherwise(0)
            less = F.when(old > 0, F.get(weight, c_out - 1) - F.get(weight, c_out)).otherwise(0.0)
            total = a["sum"] + less + F.get(weight, c_in + 1) - F.get(weight, c_in)
            counts = F.transform(a["n"], lambda n, k: F.when(k + 1 == new, n + 1).otherwise(n) - F.when(k + 1 == old, 1).otherwise(0))
            run = F.array(*[F.when(F.get(m, new - 1), F.get(a["run"], F.lit(k)) + 1).otherwise(0) for k, m in enumerate(member)])
            new_state = F.struct(counts.alias("n"), total.alias("sum"), run.alias("run"))

            def judged(b: Column) -> Column:
                bits, high = F.lit(math.log2(WINDOW)) - b["sum"] / WINDOW, F.lit(False)
                for k, (_, least) in enumerate(CLASSES):
                    high = high | ((F.get(b["run"], F.lit(k)) >= WINDOW) & (bits >= least - ROUNDING))
                first = F.when(high & (a["first"] < 0), p["i"] - WINDOW).otherwise(a["first"])
                return F.struct(b["n"].alias("n"), b["sum"].alias("sum"), b["run"].alias("run"), first.alias("first"), F.when(high, p["i"]).otherwise(a["last"]).alias("last"))

            return bound(new_state, judged)

        return bound(F.aggregate(pairs, start, step), lambda a: F.struct((x["s"] + a["first"]).alias("s"), (x["s"] + a["last"]).alias("e"), a["first"].alias("f"), F.substring(x["m"], a["first"] + 1, a["last"] - a["first"]).alias("m")))

    found = F.filter(F.transform(F.filter(runs, candidate), windows), lambda w: w["f"] >= 0)
    more = F.filter(found, lambda w: F.length(F.regexp_replace(w["m"], ALLOWED_WORDS, "")) >= WINDOW)
    return F.transform(more, lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e"), w["m"].alias("m")))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, _text, and the spans ``_assign, _access, _hex, _entropy``."""
    text = F.col("_text")
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text")).select(
        "doc_id", "_text",
        F.filter(find(text, ASSIGN, where=text.rlike(ASSIGN_WORD)), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= LEAST_VALUE).alias("_assign"),
        find(text, ACCESS, where=text.contains("AKIA")).alias("_access"),
        find(text, HEX).alias("_hex"),
    )
    return base.withColumn("_entropy", _entropy_spans(text, F.concat("_assign", "_access", "_hex")))


def scan_report(docs: DataFrame) -> DataFrame:
    """Per document the numbers of base spans, their hash, and all spans."""
    base = [("assign", F.col("_assign")), ("access", F.col("_access")), ("hex", F.col("_hex"))]
    return scan(docs).select(
        "doc_id",
        *[F.size(c).cast("long").alias(f"n_{kind}") for kind, c in base],
        F.sha2(labelled(base), 256).alias("base_sha256"),
        labelled([*base, ("entropy", F.col("_entropy"))]).alias("spans"),
    )
