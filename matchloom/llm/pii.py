"""Personal data: fixed patterns, and information-theoretic sanitisation of revealing terms.

The base kinds (email, ip, card, phone) are patterns. Their values are the protected entities.
The corpus says how strongly a term reveals one: with n documents, of which n_e have the entity,
n_t the term and n_et the entity with the term near it, the entity's information content is
IC = log2(n / n_e) and the pointwise mutual information is PMI = log2(n * n_et / (n_e * n_t)).
A term discloses the entity if

- PMI >= ``DISCLOSURE`` * IC: whoever reads the term lacks at most the rest of the entity's
  information; and
- the corpus has evidence for it: entity and term meet in w >= ``SUPPORT`` different windows, the
  texts of ``NEAR`` characters before and after it (copies of a passage are one; windows that differ
  on either side are two), and so many would meet by chance with a probability of at most ``CHANCE``
  over all pairs that the corpus has. By Chernoff's bound that asks
  w log2(w / x) - (w - x) log2 e >= log2(pairs / CHANCE) bits, with x = windows of the entity *
  n_t / n expected: the least evidence follows from the corpus, not from a constant.

Every occurrence of such a term as a whole word, in any document, is a span of kind ``term``;
``sanitize`` generalises a span to its kind's label, or removes it.

All in DataFrame functions. Every entity has its terms counted, over all documents. Only terms that
meet an entity in enough windows are counted in the corpus, as no other can disclose one: up to
``FEW_TERMS`` of them are sent to the documents, more of them meet the words of the corpus after
these are summed per task; the counts are the same.

Terms are runs of ``TERM`` letters and digits in lower case, of any length; a run that the edge of a
window cuts is no term.

Defined results: null text counts as empty; no spans give 0, the SHA-256 of the empty string, and
an empty string; spans of one start are ordered by kind as listed; a term's occurrence that touches
a base span is not added; very long texts are scanned whole, in time linear in their length and
matches; rows that repeat are scanned and counted each; a null doc_id is kept; empty tables give
empty results; further columns are ignored by the report and kept by ``sanitize``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .spans import EMPTY, JOINT, around, find, joined, labelled

#: A match starts where none of its run's characters stands before it, or where the last ended.
_RUN = r"(?:(?<![{0}])|\G)[{0}]++"
EMAIL = _RUN.format(rf"A-Za-z0-9._%+{JOINT}-") + rf"@[A-Za-z0-9-]++{JOINT}[A-Za-z0-9{JOINT}-]++"
IP = _RUN.format("0-9") + r"\.[0-9]++\.[0-9]++\.[0-9]++"
#: Runs of under 14 characters hold too few digits and never match elsewhere.
CARD = rf"[0-9{JOINT}]{{14,}}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{N}]+"
WORD_CHAR = r"[\p{L}\p{N}]"
NEAR = 60
SUPPORT = 2
DISCLOSURE = 0.8
#: Pairs of an entity and a term that chance would let pass, in the whole corpus.
CHANCE = 0.01
FEW_TERMS = 20_000


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Whether the digits pass the check: from the right, each second one doubled."""
    d = F.reverse(_digits(m))
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.when(i % 2 == 1, F.substring(d, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(d, i, F.lit(1)).cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _card(x: Column) -> Column:
    n = F.length(_digits(x["m"]))
    return F.when((n >= 14) & (n <= 19), _luhn(x["m"])).otherwise(False)


def _ip(x: Column) -> Column:
    def small(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(plain) <= 3, F.concat(F.lit("0"), plain).cast("int") <= 255).otherwise(False)

    return F.forall(F.split(x["m"], r"\."), small)


def _shown(found: Column, mark: str) -> Column:
    """Spans with the mark of ``joined`` in their texts turned into ``mark``."""
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.replace(x["m"], F.lit(JOINT), F.lit(mark)).alias("m")))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the base kinds in a text that is not null."""
    digit_runs = r"[0-9](?:[\x20-]?[0-9]){13}"
    return {
        "email": _shown(find(joined(text, ".", "A-Za-z0-9-"), EMAIL, where=text.contains("@")), "."),
        "ip": F.filter(find(text, IP, where=text.rlike(r"[0-9]\.[0-9]")), _ip),
        "card": F.filter(_shown(find(joined(text, r"\x20-", "0-9"), CARD, where=text.rlike(digit_runs)), ""), _card),
        "phone": F.filter(find(text, PHONE, where=text.contains("+")), lambda x: F.length(_digits(x["m"])).between(10, 15)),
    }


KINDS = ("email", "ip", "card", "phone")


def _entity(x: Column, before: Column, after: Column) -> Column:
    """The entity, its window and the distinct terms near it; one more character on either side
    tells whether the window's edge cuts a word."""
    left = F.when(F.length(before) > NEAR, F.regexp_replace(before, f"^{WORD_CHAR}+", "")).otherwise(before)
    right = F.when(F.length(after) > NEAR, F.regexp_replace(after, f"{WORD_CHAR}+$", "")).otherwise(after)
    # a window is both sides together: one that differs on either side is another text
    window = F.xxhash64(F.lower(before), F.lower(after))
    return F.struct(F.lower(x["m"]).alias("entity"), window.alias("window"), _words(F.concat_ws(" ", left, right)).alias("terms"))


def disclosing_terms(rows: DataFrame) -> DataFrame:
    """Terms that disclose an entity: (term), from ``rows`` with _row, _text and the base spans."""
    none = rows.sparkSession.createDataFrame([], "term string")
    base = F.concat(*[F.col(f"_{k}") for k in KINDS])
    # texts stay where they are: only windows' terms come out of a row
    near = rows.where(F.size(base) > 0).select("_row", F.explode(around(F.col("_text"), base, NEAR + 1, _entity)).alias("x"))
    near = materialize(near.select("_row", "x.*"), "pii-near")
    if near.isEmpty():
        return none
    pairs = near.select("_row", "entity", "window", F.explode("terms").alias("term"))
    windows = pairs.groupBy("entity", "term").agg(F.countDistinct("window").alias("w"), F.countDistinct("_row").alias("n_et"))
    met = materialize(windows, "pii-met")
    n, n_pairs = rows.count(), met.count()
    met = met.where(F.col("w") >= SUPPORT)
    wanted = materialize(met.select("term").distinct(), "pii-wanted")
    n_wanted = wanted.count()
    if not n_wanted:
        return none
    words = rows.select(F.explode(_words(F.col("_text"))).alias("term"))
    if n_wanted <= FEW_TERMS:
        words = words.join(F.broadcast(wanted), "term", "left_semi")  # FEW_TERMS words
    words = words.groupBy("term").agg(F.count("*").alias("n_t"))
    held = near.groupBy("entity").agg(F.countDistinct("_row").alias("n_e"), F.countDistinct("window").alias("w_e"))
    told = met.join(held, "entity").join(words, "term")
    ic = F.log2(F.lit(float(n)) / F.col("n_e"))
    pmi = F.log2(F.lit(float(n)) * F.col("n_et") / (F.col("n_e") * F.col("n_t").cast("double")))
    chance = F.col("w_e") * F.col("n_t") / F.lit(float(n))
    evidence = F.col("w") * F.log2(F.col("w") / chance) - (F.col("w") - chance) * math.log2(math.e)
    enough = (F.col("w") > chance) & (evidence >= math.log2(max(n_pairs, 1) / CHANCE))
    # an entity in every document has no information to disclose
    return materialize(told.where((ic > 0) & (pmi >= ic * DISCLOSURE) & enough).select("term").distinct(), "pii-terms")


def _words(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda t: F.lower(t)))


def scan(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id as _doc_id, _text, the columns ``keep`` as ``_keep_i``, the
    base spans ``_email, _ip, _card, _phone`` and the added ``_term``."""
    text = F.col("_text")
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col("doc_id").alias("_doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("_text"), *[F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)],
    )
    rows = materialize(rows.select("*", *[c.alias(f"_{k}") for k, c in base_spans(text).items()]), "pii-rows")
    terms = disclosing_terms(rows)
    if terms.isEmpty():
        return rows.withColumn("_term", F.array().cast(EMPTY))
    # the documents that have such a term, with their terms: a word list bounded by the text
    have = rows.select("_row", F.explode(_words(text)).alias("term")).join(terms, "term").groupBy("_row").agg(F.collect_set("term").alias("_terms"))
    have = materialize(have, "pii-have")
    base = F.concat(*[F.col(f"_{k}") for k in KINDS])
    word = find(text, TERM, keep=lambda m: F.array_contains("_terms", F.lower(m)))
    hit = F.filter(word, lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    out = rows.join(have, "_row", "left").withColumn("_term", F.when(F.col("_terms").isNotNull(), hit).otherwise(F.array().cast(EMPTY)))
    return out.drop("_terms")


def scan_report(docs: DataFrame) -> DataFrame:
    """Per document the numbers of base spans, their hash, and all spans."""
    base = [(k, F.col(f"_{k}")) for k in KINDS]
    return scan(docs).select(
        F.col("_doc_id").alias("doc_id"),
        *[F.size(c).cast("long").alias(f"n_{k}") for k, c in base],
        F.sha2(labelled(base), 256).alias("base_sha256"),
        labelled([*base, ("term", F.col("_term"))]).alias("spans"),
    )


def sanitize(docs: DataFrame, generalise: bool = True) -> DataFrame:
    """``docs`` with every span generalised to its kind's label, or removed; where spans overlap
    the one that starts first counts. Other columns are as they were; null texts stay null."""
    cols = tuple(docs.columns)

    def tagged(kind: str) -> Column:
        return F.transform(F.col(f"_{kind}"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{kind.upper()}]" if generalise else "").alias("label")))

    spans = F.array_sort(F.concat(*[tagged(k) for k in (*KINDS, "term")]))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(F.col("_text"), a["at"] + 1, x["s"] - a["at"])
        return F.when(x["s"] < a["at"], a).otherwise(F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(gap, x["label"])).alias("out")))

    done = F.aggregate(spans, state, step)
    clean = F.concat(F.array_join(done["out"], ""), F.substring(F.col("_text"), done["at"] + 1, F.length("_text")))
    out = scan(docs, keep=cols).withColumn("_clean", clean)
    return out.select(*[F.when(F.col(f"_keep_{i}").isNotNull(), F.col("_clean")).alias(c) if c == "text" else F.col(f"_keep_{i}").alias(c) for i, c in enumerate(cols)])
