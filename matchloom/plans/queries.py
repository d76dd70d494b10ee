"""The catalogue of queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import checkpointed, new_path
from ..functions.text import abbreviate, char_ngrams, expand, fold_labels, hash_int
from ..operators import align as al
from ..operators import corpora as co
from ..operators import evaluate as ev
from ..operators import graph as gr
from ..operators import repair as rp
from ..operators import scorers as sc
from ..operators.candidates import select_candidates
from ..operators.index import postings, token_weights
from ..sources import mappings as io
from ..sources import ontology as on
from ..sources.config import Settings
from . import corpora as cp
from . import fixtures as fx
from . import run as rn

LIMIT = 10
KEEP = 0.94
SOFT = 4
SIDES = ("SRC", "TGT")


def _sides(of: Callable[[str], DataFrame]) -> DataFrame:
    """A table of either hierarchy, with ``onto``."""
    one, two = (of(side).withColumn("onto", F.lit(side)) for side in SIDES)
    return one.unionByName(two)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return fx.class_labels(spark, d, "SRC").unionByName(fx.class_labels(spark, d, "TGT"))


def label_normalize(spark: SparkSession, d: str) -> DataFrame:
    raw = fx.class_annotations(spark, d, "SRC").unionByName(fx.class_annotations(spark, d, "TGT"))
    per = raw.groupBy("onto", "iri").agg(F.sort_array(F.collect_set("brand")).alias("b"), F.sort_array(F.collect_set("kind")).alias("k"))
    folded = per.select("onto", "iri", fold_labels([F.col("b"), F.col("k")]).alias("l"))
    return folded.select("onto", "iri", F.size("l").cast("long").alias("n_labels"), F.array_join("l", "|").alias("labels"))


def text_counts(spark: SparkSession, d: str) -> DataFrame:
    return label_normalize(spark, d).groupBy("onto").agg(F.count("*").alias("n_classes"), F.sum("n_labels").alias("n_labels"))


def token_index(spark: SparkSession, d: str) -> DataFrame:
    return postings(fx.class_labels(spark, d, "SRC").unionByName(fx.class_labels(spark, d, "TGT")))


def token_index_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return postings(_labels(spark, d), char_ngrams(3), cut=2)


def token_cf(spark: SparkSession, d: str) -> DataFrame:
    labels = fx.class_labels(spark, d, "SRC").unionByName(fx.class_labels(spark, d, "TGT"))
    n = labels.groupBy("onto").agg(F.countDistinct("iri").alias("n"))
    return token_weights(postings(labels), n).withColumn("weight", F.round("weight", 6))


def _candidates(spark: SparkSession, d: str, side: str = "SRC", idf: str = "cf", limit: int = LIMIT) -> DataFrame:
    other = "TGT" if side == "SRC" else "SRC"
    return select_candidates(fx.class_labels(spark, d, side), fx.class_labels(spark, d, other), limit, idf=idf)


def candidates_idf_topk(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d)


def candidates_df_topk(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d, idf="df")


def string_match_pairs(spark: SparkSession, d: str) -> DataFrame:
    s, t = fx.class_labels(spark, d, "SRC"), fx.class_labels(spark, d, "TGT")
    return al.string_matches(_candidates(spark, d), s, t)


def _edit(spark: SparkSession, d: str, side: str, string_match: bool = False, pooling: str = "max", nbest: int = 1) -> DataFrame:
    other = "TGT" if side == "SRC" else "SRC"
    a, b = fx.class_labels(spark, d, side), fx.class_labels(spark, d, other)
    return al.align(_candidates(spark, d, side), a, b, sc.edit_scorer, pooling, nbest, string_match, clamp_low=string_match)


def edit_sim_best(spark: SparkSession, d: str) -> DataFrame:
    return _edit(spark, d, "SRC")


def align_nbest(spark: SparkSession, d: str) -> DataFrame:
    return _edit(spark, d, "SRC", string_match=True, pooling="mean", nbest=3)


def align_bidirectional(spark: SparkSession, d: str) -> DataFrame:
    return al.bidirectional(_edit(spark, d, "SRC"), _edit(spark, d, "TGT"))


def align_combined(spark: SparkSession, d: str) -> DataFrame:
    return al.mapping_sets(align_bidirectional(spark, d))


def eval_prf(spark: SparkSession, d: str) -> DataFrame:
    ref = fx.reference(spark, d)
    return ev.evaluate(align_combined(spark, d), ref, fx.ignored(ref), [0.9])


def eval_threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    ref = fx.reference(spark, d)
    return ev.evaluate(align_combined(spark, d), ref, fx.ignored(ref))


def eval_best_hyper(spark: SparkSession, d: str) -> DataFrame:
    return ev.best_row(eval_threshold_grid(spark, d))


def eval_string_match(spark: SparkSession, d: str) -> DataFrame:
    return ev.string_match_rows(eval_threshold_grid(spark, d))


def eval_long(spark: SparkSession, d: str) -> DataFrame:
    return ev.long_form(eval_threshold_grid(spark, d))


def split_mappings(spark: SparkSession, d: str) -> DataFrame:
    return co.split(fx.reference(spark, d).select("src", "tgt"), ["src", "tgt"], {"train": 0.2, "val": 0.1, "test": 0.7})


def eval_ss_us_ignored(spark: SparkSession, d: str) -> DataFrame:
    """Test scores with the ignore lists of either learning setting: all but the test mappings
    (ss), or the validation mappings only (us)."""
    ref = fx.reference(spark, d)
    return rn.by_setting(align_combined(spark, d), ref, checkpointed(split_mappings(spark, d)), fx.ignored(ref), [0.9])


def mapping_identity_check(spark: SparkSession, d: str) -> DataFrame:
    """Mappings with both IRIs in one namespace, so that some are of a class with itself."""
    pairs = string_match_pairs(spark, d).select(F.substring_index("from_iri", ":", -1).alias("src"), F.substring_index("to_iri", ":", -1).alias("tgt"))
    kept = ev.without_identity(pairs).agg(F.count("*").alias("n_kept"))
    return pairs.agg(F.count("*").alias("n_all")).crossJoin(kept)  # one row each


def _depth(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    return _sides(lambda side: gr.depth(fx.place_edges(spark, d, side), strategy)).withColumn("depth", F.col("depth").cast("long"))


def class_depth_max(spark: SparkSession, d: str) -> DataFrame:
    return _depth(spark, d, "max")


def class_depth_min(spark: SparkSession, d: str) -> DataFrame:
    return _depth(spark, d, "min")


def hierarchy_max_depth(spark: SparkSession, d: str) -> DataFrame:
    return _sides(lambda side: gr.max_depth(fx.place_edges(spark, d, side))).withColumn("depth", F.col("depth").cast("long"))


def class_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return _sides(lambda side: gr.ancestors(fx.place_edges(spark, d, side)))


def synonym_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _sides(lambda side: co.synonyms(fx.class_labels(spark, d, side)))


def identity_synonyms(spark: SparkSession, d: str) -> DataFrame:
    return _sides(lambda side: co.identity_synonyms(fx.class_labels(spark, d, side)))


def _soft(spark: SparkSession, d: str, side: str) -> DataFrame:
    labels = fx.class_labels(spark, d, side)
    return co.soft_nonsynonyms(labels, co.synonyms(labels), SOFT)


def soft_negatives(spark: SparkSession, d: str) -> DataFrame:
    return _sides(lambda side: _soft(spark, d, side))


def _hard(spark: SparkSession, d: str, side: str) -> DataFrame:
    labels, edges = fx.class_labels(spark, d, side), fx.class_edges(spark, d, side)
    return co.hard_nonsynonyms(labels, edges, co.synonyms(labels))


def sibling_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    return _sides(lambda side: _hard(spark, d, side))


def hard_negatives_by_depth(spark: SparkSession, d: str) -> DataFrame:
    def hard(side: str) -> DataFrame:
        labels, edges = fx.place_labels(spark, d, side), fx.place_edges(spark, d, side)
        return co.hard_nonsynonyms(labels, edges, co.synonyms(labels), gr.depth(edges, "max"), 0)

    return _sides(hard)


def cross_synonyms(spark: SparkSession, d: str) -> DataFrame:
    return co.cross_synonyms(fx.reference(spark, d), fx.class_labels(spark, d, "SRC"), fx.class_labels(spark, d, "TGT"))


def _cross(spark: SparkSession, d: str, maps: DataFrame) -> DataFrame:
    s, t = (checkpointed(fx.class_labels(spark, d, side)) for side in SIDES)
    maps = checkpointed(maps)
    known = checkpointed(co.cross_synonyms(maps, s, t))
    return co.corpus(known, co.cross_soft_nonsynonyms(maps, s, t, known, SOFT))


def cross_soft_negatives(spark: SparkSession, d: str) -> DataFrame:
    return _cross(spark, d, fx.reference(spark, d)).where("kind = 'soft'").select("a", "b")


def _intra(spark: SparkSession, d: str, side: str) -> DataFrame:
    """The corpus of a side, stored, as those who read it do so several times."""
    labels, edges = checkpointed(fx.class_labels(spark, d, side)), fx.class_edges(spark, d, side)
    known = checkpointed(co.synonyms(labels))
    return checkpointed(co.corpus(known, co.soft_nonsynonyms(labels, known, SOFT), co.hard_nonsynonyms(labels, edges, known)))


def corpus_merge(spark: SparkSession, d: str) -> DataFrame:
    return co.merge(_intra(spark, d, "SRC"), _intra(spark, d, "TGT"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return co.corpus_stats(corpus_merge(spark, d))


def corpus_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _sides(lambda side: co.label_rows(_intra(spark, d, side)))


def corpora_stats(spark: SparkSession, d: str) -> DataFrame:
    """All corpora of a task as one call, saved and loaded: (corpus, kind, n_pairs, n_labels)."""
    labels, edges = ([f(spark, d, side) for side in SIDES] for f in (fx.class_labels, fx.class_edges))
    folder = new_path(spark, "corpora")
    cp.save(cp.assemble(*labels, *edges, fx.reference(spark, d), Settings(sample_rate=SOFT)), folder)
    out = None
    for name, pairs in cp.load(spark, folder).items():
        stats = co.corpus_stats(pairs).withColumn("corpus", F.lit(name))
        out = stats if out is None else out.unionByName(stats)
    return out


def _identity(spark: SparkSession, d: str) -> DataFrame:
    both = fx.class_labels(spark, d, "SRC").unionByName(fx.class_labels(spark, d, "TGT"))
    return checkpointed(co.identity_synonyms(both))


def finetune_us(spark: SparkSession, d: str) -> DataFrame:
    merged, cross = checkpointed(corpus_merge(spark, d)), checkpointed(_cross(spark, d, fx.reference(spark, d)))
    return co.unsupervised(merged, _identity(spark, d), cross, 1, 1, 1, fewer=True)


def finetune_ss(spark: SparkSession, d: str) -> DataFrame:
    merged, parts = checkpointed(corpus_merge(spark, d)), checkpointed(split_mappings(spark, d))
    cross = {name: checkpointed(_cross(spark, d, parts.where(F.col("split") == name))) for name in ("train", "val", "test")}
    return co.semi_supervised(merged, _identity(spark, d), cross, 1, 1, 1, fewer=True)


def finetune_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that are both positive and negative in a corpus whose siblings were not checked against
    the synonyms (labels that classes of one parent share)."""

    def unchecked(side: str) -> DataFrame:
        labels = fx.class_labels(spark, d, side)
        known = co.synonyms(labels)
        siblings = co.hard_nonsynonyms(labels, fx.class_edges(spark, d, side), known.limit(0))
        return co.conflicts(co.label_rows(co.corpus(known, siblings)).withColumn("split", F.lit("all")))

    return _sides(unchecked)


def embed_class_mean(spark: SparkSession, d: str) -> DataFrame:
    means = sc.class_vectors(fx.table(spark, d, "embeddings").select(F.col("label").alias("iri"), F.col("embedding").alias("vec")))
    return means.select(F.col("iri").alias("label"), F.posexplode("vec").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def embed_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest class vectors of each vector, by a search over all classes (a bounded
    number: more pairs than that are an error)."""
    e = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("iri"), F.col("embedding").alias("vec"), "label")
    means = checkpointed(sc.class_vectors(e.select(F.col("label").alias("iri"), "vec")))
    return al.nearest(e, means, 3, 1 << 33)


def _vectors(spark: SparkSession, d: str, side: str) -> DataFrame:
    return sc.class_vectors(sc.word_vectors(fx.class_labels(spark, d, side)))


def align_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Alignment by class vectors from both sides, labels first, the three best of each class."""
    labels = [fx.class_labels(spark, d, side) for side in SIDES]
    settings = Settings(mode="vectors", nbest=3)
    return rn.align_both(*labels, settings, LIMIT, vectors=tuple(_vectors(spark, d, side) for side in SIDES))


def extend_one_hop(spark: SparkSession, d: str) -> DataFrame:
    return _extend(spark, d, 1)


def extend_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    return _extend(spark, d, 50)


def _extend(spark: SparkSession, d: str, rounds: int) -> DataFrame:
    side = lambda f: [f(spark, d, x) for x in ("SRC", "TGT")]
    out = gr.extend(fx.place_seeds(spark, d), *side(fx.place_edges), *side(fx.place_labels), sc.edit_scorer, KEEP, rounds)
    return out.select("src", "tgt", "score")


def extended_set(spark: SparkSession, d: str) -> DataFrame:
    """The seeds with what extension adds to them."""
    side = lambda f: [f(spark, d, x) for x in SIDES]
    settings = Settings(extension_threshold=KEEP)
    return rn.run_extension(fx.place_seeds(spark, d), *side(fx.place_edges), *side(fx.place_labels), settings)


def repair_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    return rp.one_to_one(align_bidirectional(spark, d).select("src", "tgt", "score").distinct())


def repair_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return rp.conflicts(fx.place_mappings(spark, d), fx.place_edges(spark, d, "SRC"), fx.place_edges(spark, d, "TGT"))


def repair_disjoint(spark: SparkSession, d: str) -> DataFrame:
    return rp.repair(fx.place_mappings(spark, d), fx.place_edges(spark, d, "SRC"), fx.place_edges(spark, d, "TGT"))


def eval_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Test scores of the mappings before and after one-to-one repair."""
    before = checkpointed(align_bidirectional(spark, d).select("src", "tgt", "score").distinct())
    sets = before.withColumn("set_type", F.lit("all")).unionByName(rp.one_to_one(before).withColumn("set_type", F.lit("repaired")))
    ref = fx.reference(spark, d)
    return rn.by_setting(sets, ref, checkpointed(split_mappings(spark, d)), fx.ignored(ref), [0.9])


def eval_report(spark: SparkSession, d: str) -> DataFrame:
    return ev.report_lines(eval_prf(spark, d), latex=True)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """The reference with scores from 0.9 on."""
    return fx.reference(spark, d).withColumn("score", (F.lit(900) + hash_int("score", F.col("src"), F.col("tgt")) % 100) / 1000)


def mapping_tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Mappings written as TSV and read back from a threshold on."""
    path = new_path(spark, "mappings")
    io.write_mappings(_scored(spark, d), path)
    return io.read_mappings(spark, path, 0.95)


def mapping_rdf_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Pipe lines to an alignment document and back."""
    path = new_path(spark, "alignment")
    io.write_rdf(io.read_pipe(io.pipe_lines(_scored(spark, d))), path)
    return io.read_rdf(spark, path)


def mapping_log_best(spark: SparkSession, d: str) -> DataFrame:
    """The best mapping of each class of either side, from the lines of a log."""
    rows = _scored(spark, d)
    line = lambda side, own, other: F.format_string("[Time: 1.0][PID 1][" + side + ": %s][Class-idx: 1][Mapping: ('%s', '%s', %s)]", own, own, other, F.col("score").cast("string")).alias("value")
    return io.read_log(rows.select(line("SRC", F.col("src"), F.col("tgt"))).unionByName(rows.select(line("TGT", F.col("tgt"), F.col("src")))))


def mapping_repaired_tsv(spark: SparkSession, d: str) -> DataFrame:
    """A repair tool's output (no header, whole IRIs) read with abbreviated IRIs."""
    path = new_path(spark, "repaired")
    _scored(spark, d).select(expand(F.col("src")), expand(F.col("tgt")), "score").write.csv(path, sep="\t", header=False, quote="")
    return io.read_repaired(spark, path)


def label_pairs_tsv(spark: SparkSession, d: str) -> DataFrame:
    """Label pairs written as TSV and read back."""
    path = new_path(spark, "pairs")
    io.write_label_pairs(corpus_pairs(spark, d), path)
    return spark.read.options(sep="\t", header=True, quote="").schema("sent1 string, sent2 string, label int").csv(path)


def bundle_index(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index of prepared hierarchies, saved and loaded."""

    def loaded(side: str) -> DataFrame:
        classes = fx.class_labels(spark, d, side).groupBy("onto", "iri").agg(F.sort_array(F.collect_set("label")).alias("labels"))
        path = new_path(spark, "bundle")
        on.Bundle.of(classes, fx.class_edges(spark, d, side)).save(path)
        return on.Bundle.load(spark, path).index

    return loaded("SRC").unionByName(loaded("TGT"))


def mapping_pipe_format(spark: SparkSession, d: str) -> DataFrame:
    return io.pipe_lines(fx.reference(spark, d)).select(F.col("value").alias("line"))


def mapping_pipe_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = io.read_pipe(io.pipe_lines(fx.reference(spark, d)))
    return rows.select(abbreviate(F.col("src")).alias("src"), abbreviate(F.col("tgt")).alias("tgt"), "relation", "score")


def mapping_expand_iri(spark: SparkSession, d: str) -> DataFrame:
    return fx.reference(spark, d).select("src", expand(F.col("src")).alias("src_iri"), "tgt", expand(F.col("tgt")).alias("tgt_iri"))


def train_lexical_scorer(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of the learned scorer on the held-out pairs of a corpus."""
    rows = checkpointed(co.split(corpus_pairs(spark, d).drop("onto").distinct(), ["sent1", "sent2", "label"], {"train": 0.8, "val": 0.2}))
    return sc.accuracy(sc.train_scorer(rows.where("split = 'train'")), rows.where("split = 'val'"))


def align_learned(spark: SparkSession, d: str) -> DataFrame:
    """Alignment by the learned scorer from both sides, mean over label pairs."""
    a, b = fx.class_labels(spark, d, "SRC"), fx.class_labels(spark, d, "TGT")
    model = sc.train_scorer(corpus_pairs(spark, d).drop("onto").distinct())
    return rn.align_both(a, b, Settings(mode="learned"), LIMIT, sc.learned_scorer(model))


ALL = (
    label_normalize, text_counts, token_index, token_index_ngrams, token_cf, candidates_idf_topk, candidates_df_topk, string_match_pairs, edit_sim_best, align_nbest,
    align_bidirectional, align_combined, eval_prf, eval_threshold_grid, eval_best_hyper, eval_string_match, eval_long, split_mappings, eval_ss_us_ignored,
    mapping_identity_check, class_depth_max, class_depth_min, hierarchy_max_depth, class_ancestors, synonym_pairs, identity_synonyms, soft_negatives,
    sibling_hard_negatives, hard_negatives_by_depth, cross_synonyms, cross_soft_negatives, corpus_merge, corpus_stats, corpus_pairs, corpora_stats, finetune_us,
    finetune_ss, finetune_conflicts, embed_class_mean, embed_cosine_topk, align_embedding, extend_one_hop, extend_fixpoint, extended_set, repair_one_to_one,
    repair_conflicts, repair_disjoint, eval_repaired, eval_report, mapping_tsv_round_trip, mapping_rdf_round_trip, mapping_log_best, mapping_repaired_tsv,
    label_pairs_tsv, bundle_index, mapping_pipe_format, mapping_pipe_parse, mapping_expand_iri, train_lexical_scorer, align_learned,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}
