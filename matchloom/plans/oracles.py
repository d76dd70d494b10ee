"""DuckDB SQL for the catalogue of ``queries``, written on its own from the stages' definitions."""

from __future__ import annotations

# what all build on: classes, labels, edges and references of the parts
_BASE = """
parts AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'SRC' ELSE 'TGT' END AS onto, replace(p_name, ' ', '_') AS name, p_brand, p_type,
  CASE WHEN p_partkey % 2 = 0 THEN 'obo:' ELSE 'ordo:' END AS ns FROM part),
classed AS (SELECT *, ns || name || '.' || lower(replace(p_brand, '#', '')) AS iri FROM parts),
labels AS (
  SELECT DISTINCT onto, iri, replace(lower(t), '_', ' ') AS label FROM (
    SELECT onto, iri, p_brand || '_' || name AS t FROM classed
    UNION ALL SELECT onto, iri, CASE onto WHEN 'SRC' THEN p_type || '_' || name ELSE name || '_' || p_type END FROM classed)),
ref AS (SELECT DISTINCT s.iri AS src, t.iri AS tgt FROM classed s JOIN classed t ON s.onto = 'SRC' AND t.onto = 'TGT' AND s.name = t.name AND s.p_brand = t.p_brand),
ign AS (SELECT * FROM ref WHERE ('0x' || substr(md5(concat_ws('|', 'ignored', src, tgt)), 1, 8))::BIGINT % 7 = 0)"""

_TOKENS = """
tokens AS (SELECT onto, iri, unnest(regexp_extract_all(label, '[a-z0-9#]+')) AS token FROM labels),
posting AS (SELECT onto, token, iri, count(*) AS dtf FROM tokens GROUP BY ALL),
sizes AS (SELECT onto, count(DISTINCT iri) AS n FROM labels GROUP BY onto),
weights AS (SELECT onto, token, sum(dtf)::BIGINT AS cf, count(*) AS df FROM posting GROUP BY ALL)"""


def _candidates(idf: str = "cf") -> str:
    return f"""
hits AS (
  SELECT q.onto AS side, q.iri AS from_iri, p.iri AS to_iri, round(sum(q.dtf * p.dtf * log10(n / {idf})), 6) AS score
  FROM posting q JOIN posting p ON q.token = p.token AND q.onto <> p.onto JOIN weights w ON w.onto = p.onto AND w.token = p.token JOIN sizes z ON z.onto = p.onto
  GROUP BY ALL),
cands AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY side, from_iri ORDER BY score DESC, to_iri)::INT AS rank FROM hits QUALIFY rank <= 10)"""


_EDIT = """
pair_scores AS (
  SELECT c.side, c.from_iri, c.to_iri, c.rank, 1.0 - levenshtein(a.label, b.label) / greatest(length(a.label), length(b.label))::DOUBLE AS s
  FROM cands c JOIN labels a ON a.iri = c.from_iri JOIN labels b ON b.iri = c.to_iri),
edit AS MATERIALIZED (
  SELECT side, from_iri, to_iri, rank AS crank, round(max(s), 6) AS score, round(avg(s), 6) AS mean, max(s) = 1 AS same FROM pair_scores GROUP BY ALL),
bests AS (
  SELECT side AS direction, CASE side WHEN 'SRC' THEN from_iri ELSE to_iri END AS src, CASE side WHEN 'SRC' THEN to_iri ELSE from_iri END AS tgt, score,
    row_number() OVER (PARTITION BY side, from_iri ORDER BY score DESC, crank)::INT AS rank FROM edit WHERE score > 0 QUALIFY rank = 1)"""

_SETS = """
src_set AS (SELECT 'src' AS set_type, src, tgt, score FROM bests WHERE direction = 'SRC' QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, rank, tgt) = 1),
tgt_set AS (SELECT 'tgt' AS set_type, src, tgt, score FROM bests WHERE direction = 'TGT' QUALIFY row_number() OVER (PARTITION BY tgt ORDER BY score DESC, rank, src) = 1),
sets AS MATERIALIZED (FROM src_set UNION ALL FROM tgt_set UNION ALL
  SELECT DISTINCT 'combined', src, tgt, score FROM (FROM src_set UNION ALL FROM tgt_set))"""


def _evaluation(ref: str, ign: str, levels: str, name: str = "evaluation") -> str:
    """Counts by set membership, a threshold at a time."""
    return f"""
{name} AS (
  WITH preds AS (SELECT set_type, src, tgt, max(score) AS score FROM sets GROUP BY ALL), r AS (SELECT DISTINCT src, tgt FROM {ref}), i AS (SELECT DISTINCT src, tgt FROM {ign}),
  levels AS ({levels}), kinds AS (SELECT DISTINCT set_type FROM sets),
  n AS (
    SELECT k.set_type, l.threshold,
      (SELECT count(*) FROM preds p WHERE p.set_type = k.set_type AND p.score >= l.threshold AND p.src <> p.tgt) AS n_mappings,
      (SELECT count(*) FROM preds p WHERE p.set_type = k.set_type AND p.score >= l.threshold AND p.src = p.tgt) AS n_same,
      (SELECT count(*) FROM preds p SEMI JOIN i USING (src, tgt) WHERE p.set_type = k.set_type AND p.score >= l.threshold AND p.src <> p.tgt) AS n_skip,
      (SELECT count(*) FROM preds p SEMI JOIN r USING (src, tgt) ANTI JOIN i USING (src, tgt) WHERE p.set_type = k.set_type AND p.score >= l.threshold AND p.src <> p.tgt) AS tp,
      (SELECT count(*) FROM r ANTI JOIN i USING (src, tgt)) AS n_ref, (SELECT count(*) FROM r SEMI JOIN i USING (src, tgt)) AS ref_ign
    FROM kinds k, levels l),
  pr AS (SELECT *, CASE WHEN n_mappings - n_skip > 0 THEN tp / (n_mappings - n_skip) ELSE 0 END AS p0, CASE WHEN n_ref > 0 THEN tp / n_ref ELSE 0 END AS r0 FROM n)
  SELECT set_type, threshold, n_mappings, n_same + n_skip + ref_ign AS n_ignored, round(p0, 3) AS p, round(r0, 3) AS r,
    round(CASE WHEN tp > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END, 3) AS f1 FROM pr)"""


_GRID = """SELECT DISTINCT round(x, 6)::DOUBLE AS threshold FROM (
  SELECT 0.8::DOUBLE * i / 8 AS x FROM range(9) t(i) UNION ALL SELECT 0.9 + 0.07::DOUBLE * i / 7 FROM range(8) t(i) UNION ALL SELECT 0.98 + 0.02::DOUBLE * i / 20 FROM range(21) t(i))"""
_AT = "SELECT 0.9::DOUBLE AS threshold"


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",".join(parts) + "\n"


_ALIGN = (_BASE, _TOKENS, _candidates(), _EDIT)
_EVAL = (*_ALIGN, _SETS, _evaluation("ref", "ign", _GRID))

_SPLIT = """
numbered AS (SELECT src, tgt, row_number() OVER (ORDER BY md5(concat_ws('|', 888, src, tgt)), src, tgt) - 1 AS i, count(*) OVER () AS n FROM ref),
cuts AS (SELECT *, ceil(round(n * 0.8, 9)) AS later FROM numbered),
maps AS (SELECT src, tgt, CASE WHEN i < n - later THEN 'train' WHEN i < n - ceil(round(later * 0.7 / 0.8, 9)) THEN 'val' ELSE 'test' END AS split FROM cuts)"""

_PLACES = """
s_edges AS (
  SELECT 'obo:n.' || n_nationkey AS child, 'obo:r.' || n_regionkey AS parent FROM nation
  UNION SELECT 'obo:s.' || s_suppkey, 'obo:n.' || s_nationkey FROM supplier
  UNION SELECT 'obo:s.' || s_suppkey, 'obo:r.' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0),
t_edges AS (
  SELECT 'ordo:n.' || n_nationkey AS child, 'ordo:r.' || n_regionkey AS parent FROM nation
  UNION SELECT 'ordo:c.' || c_custkey, 'ordo:n.' || c_nationkey FROM customer),
place AS (
  SELECT 'obo:s.' || s_suppkey AS iri, 'company ' || split_part(s_name, '#', 2) AS label FROM supplier
  UNION ALL SELECT 'ordo:c.' || c_custkey, 'company ' || split_part(c_name, '#', 2) FROM customer
  UNION ALL SELECT ns || 'n.' || n_nationkey, replace(lower(n_name), '_', ' ') FROM nation, (VALUES ('obo:'), ('ordo:')) v(ns)
  UNION ALL SELECT ns || 'r.' || r_regionkey, replace(lower(r_name), '_', ' ') FROM region, (VALUES ('obo:'), ('ordo:')) v(ns))"""

_WAYS = """
edges AS (SELECT 'SRC' AS onto, child, parent FROM s_edges UNION ALL SELECT 'TGT', child, parent FROM t_edges),
nodes AS (SELECT onto, child AS iri FROM edges UNION SELECT onto, parent FROM edges),
ways AS (
  SELECT onto, iri, 0::BIGINT AS depth FROM nodes WHERE iri NOT IN (SELECT child FROM edges)
  UNION ALL SELECT e.onto, e.child, w.depth + 1 FROM ways w JOIN edges e ON e.parent = w.iri WHERE w.depth < 50)"""


def _depth(f: str) -> str:
    return _with(_PLACES, _WAYS, recursive=True) + f"SELECT onto, iri, {f}(depth) AS depth FROM ways GROUP BY onto, iri"


def _both(name: str, columns: str = "a, b") -> str:
    """The rows of a corpus part of either side."""
    return f"SELECT 'SRC' AS onto, {columns} FROM {name}1 UNION ALL SELECT 'TGT', {columns} FROM {name}2"


# corpora of one side: synonyms, checked draws, siblings
def _intra(side: str, k: str) -> str:
    return f"""
own{k} AS (SELECT iri, label FROM labels WHERE onto = '{side}'),
syn{k} AS (SELECT DISTINCT x.label AS a, y.label AS b FROM own{k} x JOIN own{k} y ON x.iri = y.iri AND x.label <> y.label),
idx{k} AS (SELECT iri, row_number() OVER (ORDER BY md5(iri), iri) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT iri FROM own{k})),
texts{k} AS (SELECT i, list(label ORDER BY label) AS l FROM own{k} JOIN idx{k} USING (iri) GROUP BY i),
draws{k} AS (
  SELECT label, iri, draw, (i + 1 + ('0x' || substr(md5(concat_ws('|', 888, label, iri, draw)), 1, 8))::BIGINT % (n - 1)) % n AS other
  FROM own{k} JOIN idx{k} USING (iri), range(1, 5) t(draw)),
drawn{k} AS (
  SELECT label AS a, l[('0x' || substr(md5(concat_ws('|', 889, label, iri, draw)), 1, 8))::BIGINT % len(l) + 1] AS b FROM draws{k} JOIN texts{k} ON i = other),
soft{k} AS (
  SELECT a, b FROM drawn{k} d WHERE a <> b AND NOT EXISTS (FROM syn{k} s WHERE (s.a = d.a AND s.b = d.b) OR (s.a = d.b AND s.b = d.a))
  UNION SELECT b, a FROM drawn{k} d WHERE a <> b AND NOT EXISTS (FROM syn{k} s WHERE (s.a = d.a AND s.b = d.b) OR (s.a = d.b AND s.b = d.a))),
up{k} AS (
  SELECT DISTINCT iri AS child, ns || name AS parent FROM classed WHERE onto = '{side}'
  UNION SELECT DISTINCT ns || name, ns || split_part(name, '_', -1) FROM classed WHERE onto = '{side}'),
sib{k} AS (
  SELECT DISTINCT p.label AS a, q.label AS b FROM up{k} x JOIN up{k} y ON x.parent = y.parent AND x.child <> y.child
  JOIN own{k} p ON p.iri = x.child JOIN own{k} q ON q.iri = y.child WHERE p.label <> q.label),
hard{k} AS (SELECT a, b FROM sib{k} ANTI JOIN syn{k} USING (a, b)),
corpus{k} AS (SELECT a, b, 'synonym' AS kind FROM syn{k} UNION ALL SELECT a, b, 'soft' FROM soft{k} UNION ALL SELECT a, b, 'hard' FROM hard{k})"""


_MERGED = """
together AS (FROM corpus1 UNION ALL FROM corpus2),
known AS (SELECT DISTINCT a, b FROM together WHERE kind = 'synonym'),
merged AS MATERIALIZED (
  SELECT a, b, 'synonym' AS kind FROM known
  UNION ALL SELECT a, b, kind FROM (SELECT DISTINCT * FROM together WHERE kind <> 'synonym' AND a <> b) ANTI JOIN known USING (a, b)),
ids AS (SELECT DISTINCT label AS a, label AS b FROM labels)"""


def _cross(maps: str, k: str) -> str:
    """Corpus of a mapping table: synonyms, and draws of another mapping's opposite class."""
    draw = lambda seed: f"('0x' || substr(md5(concat_ws('|', {seed}, label, src, tgt, draw)), 1, 8))::BIGINT"
    sides = " UNION ALL ".join(
        f"""SELECT label AS a, l[{draw(889)} % len(l) + 1] AS b FROM (
    SELECT label, src, tgt, draw, (i + 1 + {draw(888)} % (n - 1)) % n AS nth FROM m{k} JOIN labels ON iri = {own}, range(1, 5) t(draw) WHERE n > 1)
  JOIN (SELECT i, list(label ORDER BY label) AS l FROM m{k} JOIN labels ON iri = {other} GROUP BY i) ON i = nth"""
        for own, other in (("src", "tgt"), ("tgt", "src"))
    )
    return f"""
m{k} AS (SELECT src, tgt, row_number() OVER (ORDER BY md5(concat_ws('|', src, tgt)), src, tgt) - 1 AS i, count(*) OVER () AS n FROM {maps}),
one{k} AS (SELECT x.label AS a, y.label AS b FROM m{k} JOIN labels x ON x.iri = src JOIN labels y ON y.iri = tgt),
xsyn{k} AS (SELECT a, b FROM one{k} UNION SELECT b, a FROM one{k}),
xdrawn{k} AS ({sides}),
xgood{k} AS (SELECT a, b FROM xdrawn{k} ANTI JOIN xsyn{k} USING (a, b) WHERE a <> b),
xsoft{k} AS (SELECT a, b FROM xgood{k} UNION SELECT b, a FROM xgood{k}),
xdata{k} AS MATERIALIZED (
  SELECT a AS sent1, b AS sent2, 1 AS label FROM xsyn{k} UNION SELECT a, b, 0 FROM (
    SELECT a, b FROM xsoft{k} QUALIFY row_number() OVER (ORDER BY md5(concat_ws('|', 888, a, b)), a, b) <= (SELECT count(*) FROM xsyn{k})))"""


def _data(known: str, salt: int, ratio: float, suffix: str) -> str:
    """Label data of the merged corpus with as many soft and hard pairs as ``known`` has, split."""
    pick = lambda kind, seed: (
        f"SELECT a, b, 0 AS label FROM (SELECT a, b FROM merged WHERE kind = '{kind}' QUALIFY row_number() OVER (ORDER BY md5(concat_ws('|', {seed}, a, b)), a, b) <= (SELECT count(*) FROM {known}))"
    )
    return f"""
data{suffix} AS (SELECT a AS sent1, b AS sent2, 1 AS label FROM {known} UNION {pick("soft", 888 + salt)} UNION {pick("hard", 889 + salt)}),
cut{suffix} AS MATERIALIZED (
  SELECT sent1, sent2, label, row_number() OVER (ORDER BY md5(concat_ws('|', 888, sent1, sent2, label)), sent1, sent2, label) <= count(*) OVER () - ceil(round(count(*) OVER () * {ratio}, 9)) AS early FROM data{suffix})"""


_CORPORA = (_BASE, _intra("SRC", "1"), _intra("TGT", "2"), _MERGED)
_SYN = "(SELECT a, b FROM merged WHERE kind = 'synonym')"
_US = (*_CORPORA, _cross("ref", "0"), _data(_SYN, 0, 0.2, ""), _data("ids", 10, 0.2, "_ids"), """
us AS (
  SELECT 'train' AS split, sent1, sent2, label FROM cut WHERE early
  UNION SELECT 'train+', sent1, sent2, label FROM cut WHERE early UNION SELECT 'train+', sent1, sent2, label FROM cut_ids WHERE early
  UNION SELECT 'val', sent1, sent2, label FROM cut WHERE NOT early
  UNION SELECT 'val+', sent1, sent2, label FROM cut WHERE NOT early UNION SELECT 'val+', sent1, sent2, label FROM cut_ids WHERE NOT early
  UNION SELECT 'test', sent1, sent2, label FROM xdata0)""")  # fmt: skip
_SS = (
    *_CORPORA, _SPLIT, *[_cross(f"(SELECT src, tgt FROM maps WHERE split = '{s}')", f"_{s}") for s in ("train", "val", "test")],
    _data(_SYN, 0, 0.0, ""), _data("ids", 10, 0.0, "_ids"), """
ss AS (
  SELECT 'train' AS split, sent1, sent2, label FROM cut UNION SELECT 'train', * FROM xdata_train
  UNION SELECT 'train+', sent1, sent2, label FROM cut UNION SELECT 'train+', * FROM xdata_train UNION SELECT 'train+', sent1, sent2, label FROM cut_ids
  UNION SELECT 'val', * FROM xdata_val UNION SELECT 'test', * FROM xdata_test)""",
)

#: Mappings of the corpora over mappings, by the names of their parts.
_MAPS = {"ref": "_full"} | {f"(SELECT src, tgt FROM maps WHERE split = '{s}')": f"_{s}" for s in ("train", "val", "test")}

_HOP = """
  SELECT c.src, c.tgt, c.score FROM (
    SELECT h.src, h.tgt, CASE WHEN a.label = b.label THEN 1.0 ELSE round(1.0 - levenshtein(a.label, b.label) / greatest(length(a.label), length(b.label))::DOUBLE, 6) END AS score FROM (
      SELECT s.parent AS src, t.parent AS tgt FROM {0} m JOIN s_edges s ON s.child = m.src JOIN t_edges t ON t.child = m.tgt
      UNION ALL SELECT s.child, t.child FROM {0} m JOIN s_edges s ON s.parent = m.src JOIN t_edges t ON t.parent = m.tgt) h
    JOIN place a ON a.iri = h.src JOIN place b ON b.iri = h.tgt) c WHERE c.score >= 0.94"""
_SEEDS = "seeds AS (SELECT 'obo:n.' || n_nationkey AS src, 'ordo:n.' || n_nationkey AS tgt, 1.0::DOUBLE AS score FROM nation WHERE n_nationkey % 2 = 0)"

_CONFLICTS = """
maps AS (
  SELECT 'obo:s.' || s_suppkey AS src, 'ordo:c.' || c_custkey AS tgt FROM supplier JOIN customer ON s_suppkey = c_custkey
  UNION ALL SELECT 'obo:n.' || n_nationkey, 'ordo:n.' || (n_nationkey + (n_nationkey % 3 = 0)::INT) % 25 FROM nation),
s_up(iri, top) AS (SELECT child, child FROM s_edges UNION SELECT parent, parent FROM s_edges UNION SELECT u.iri, e.parent FROM s_up u JOIN s_edges e ON e.child = u.top),
t_up(iri, top) AS (SELECT child, child FROM t_edges UNION SELECT parent, parent FROM t_edges UNION SELECT u.iri, e.parent FROM t_up u JOIN t_edges e ON e.child = u.top),
under AS (SELECT u.iri, u.top, e.parent FROM t_up u JOIN t_edges e ON e.child = u.top)"""

_CONFLICTING = """
conflicting AS (SELECT DISTINCT x.src, x.tgt, y.src AS src2, y.tgt AS tgt2
  FROM maps x JOIN s_up u ON u.iri = x.src JOIN maps y ON y.src = u.top AND y.tgt <> x.tgt
  WHERE EXISTS (FROM under p JOIN under q ON p.parent = q.parent AND p.top <> q.top WHERE p.iri = x.tgt AND q.iri = y.tgt)
    AND NOT EXISTS (FROM t_up WHERE (iri = x.tgt AND top = y.tgt) OR (iri = y.tgt AND top = x.tgt)))"""

_UP = """
edges AS (SELECT 'SRC' AS onto, child, parent FROM s_edges UNION ALL SELECT 'TGT', child, parent FROM t_edges),
up(onto, iri, ancestor) AS (SELECT onto, child, parent FROM edges UNION SELECT u.onto, u.iri, e.parent FROM up u JOIN edges e ON e.onto = u.onto AND e.child = u.ancestor)"""

_SCORED = "scored AS (SELECT src, tgt, (900 + ('0x' || substr(md5(concat_ws('|', 'score', src, tgt)), 1, 8))::BIGINT % 100) / 1000::DOUBLE AS score FROM ref)"

# class vectors: words of a label by hash, mean over labels; labels first, then the cosine
_VECTORS = """
hashed AS (SELECT iri, label, ('0x' || substr(md5(concat_ws('|', 'word', w)), 1, 8))::BIGINT % 32 AS h FROM (SELECT iri, label, unnest(regexp_extract_all(label, '[a-z0-9#]+')) AS w FROM labels)),
counted AS (SELECT l.iri, l.label, k, count(h) AS n FROM labels l CROSS JOIN range(32) t(k) LEFT JOIN hashed x ON x.iri = l.iri AND x.label = l.label AND x.h = k GROUP BY ALL),
vecs AS MATERIALIZED (SELECT iri, list(x ORDER BY k) AS v FROM (SELECT iri, k, avg(n::DOUBLE) AS x FROM counted GROUP BY ALL) GROUP BY iri),
exact AS (SELECT side, from_iri, arg_min(to_iri, crank) AS to_iri FROM edit WHERE same GROUP BY ALL),
cosines AS (
  SELECT side, from_iri, to_iri, crank, list_cosine_similarity(q.v, t.v) AS c FROM edit ANTI JOIN exact USING (side, from_iri) JOIN vecs q ON q.iri = from_iri JOIN vecs t ON t.iri = to_iri),
vectored AS (
  SELECT side, from_iri, to_iri, 1.0::DOUBLE AS score, 1 AS rank FROM exact UNION ALL (
  SELECT side, from_iri, to_iri, round(c, 6) AS score, row_number() OVER (PARTITION BY side, from_iri ORDER BY round(c, 6) DESC, crank)::INT AS rank FROM cosines WHERE c > 0.01 QUALIFY rank <= 3))"""

_REPAIRED = """
every AS (SELECT DISTINCT src, tgt, score FROM bests),
sets AS MATERIALIZED (SELECT 'all' AS set_type, src, tgt, score FROM every UNION ALL SELECT 'repaired', src, tgt, score FROM (
  FROM every QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) = 1 AND row_number() OVER (PARTITION BY tgt ORDER BY score DESC, src) = 1))"""

SQL = {
    "label_normalize": _with(_BASE, """
raw AS (
  SELECT onto, iri, 0 AS place, p_brand || '_' || name AS t FROM classed
  UNION ALL SELECT onto, iri, 1, CASE onto WHEN 'SRC' THEN p_type || '_' || name ELSE name || '_' || p_type END FROM classed),
firsts AS (SELECT onto, iri, replace(lower(t), '_', ' ') AS label, min(place) AS place, min(t) AS t FROM raw GROUP BY ALL)""")
    + "SELECT onto, iri, count(*) AS n_labels, string_agg(label, '|' ORDER BY place, t) AS labels FROM firsts GROUP BY onto, iri",
    "text_counts": _with(_BASE) + "SELECT onto, count(DISTINCT iri) AS n_classes, count(*) AS n_labels FROM labels GROUP BY onto",
    "token_index": _with(_BASE, _TOKENS) + "FROM posting",
    "token_index_ngrams": _with(_BASE) + """SELECT onto, substr(label, i, 3) AS token, iri, count(*) AS dtf
FROM labels, range(1, 200) t(i) WHERE i <= greatest(length(label) - 2, 1) AND length(substr(label, i, 3)) > 2 GROUP BY ALL""",
    "token_cf": _with(_BASE, _TOKENS) + "SELECT onto, token, cf, df, round(log10(n / cf), 6) AS weight FROM weights JOIN sizes USING (onto)",
    "candidates_idf_topk": _with(*_ALIGN[:3]) + "SELECT from_iri, to_iri, score, rank FROM cands WHERE side = 'SRC'",
    "candidates_df_topk": _with(_BASE, _TOKENS, _candidates("df")) + "SELECT from_iri, to_iri, score, rank FROM cands WHERE side = 'SRC'",
    "string_match_pairs": _with(*_ALIGN) + "SELECT from_iri, to_iri, crank AS rank FROM edit WHERE same AND side = 'SRC'",
    "edit_sim_best": _with(*_ALIGN) + "SELECT src AS from_iri, tgt AS to_iri, score, rank FROM bests WHERE direction = 'SRC'",
    "align_nbest": _with(*_ALIGN, """
exact AS (SELECT from_iri, arg_min(to_iri, crank) AS to_iri FROM edit WHERE same AND side = 'SRC' GROUP BY from_iri),
clamped AS (SELECT from_iri, to_iri, crank, CASE WHEN mean <= 0.01 THEN 0 ELSE mean END AS score FROM edit ANTI JOIN exact USING (from_iri) WHERE side = 'SRC')""")
    + """SELECT from_iri, to_iri, 1.0::DOUBLE AS score, 1 AS rank FROM exact
UNION ALL (SELECT from_iri, to_iri, score, row_number() OVER (PARTITION BY from_iri ORDER BY score DESC, crank)::INT AS rank FROM clamped WHERE score > 0 QUALIFY rank <= 3)""",
    "align_bidirectional": _with(*_ALIGN) + "FROM bests",
    "align_combined": _with(*_ALIGN, _SETS) + "FROM sets",
    "eval_prf": _with(*_ALIGN, _SETS, _evaluation("ref", "ign", _AT)) + "FROM evaluation",
    "eval_threshold_grid": _with(*_EVAL) + "FROM evaluation",
    "eval_best_hyper": _with(*_EVAL) + "FROM evaluation ORDER BY f1 DESC, threshold, CASE set_type WHEN 'combined' THEN 0 WHEN 'src' THEN 1 ELSE 2 END LIMIT 1",
    "eval_string_match": _with(*_EVAL) + "FROM evaluation WHERE threshold = 1",
    "eval_long": _with(*_EVAL) + """SELECT set_type, threshold, 'p' AS metric, p AS value FROM evaluation
UNION ALL SELECT set_type, threshold, 'r', r FROM evaluation UNION ALL SELECT set_type, threshold, 'f1', f1 FROM evaluation""",
    "split_mappings": _with(_BASE, _SPLIT) + "FROM maps",
    "eval_ss_us_ignored": _with(
        *_ALIGN, _SETS, _SPLIT,
        _evaluation("(SELECT src, tgt FROM maps WHERE split = 'test')", "(FROM ign UNION ALL SELECT src, tgt FROM maps WHERE split <> 'test')", _AT, "ss"),
        _evaluation("ref", "(FROM ign UNION ALL SELECT src, tgt FROM maps WHERE split = 'val')", _AT, "us"),
    ) + "SELECT *, 'ss' AS setting FROM ss UNION ALL SELECT *, 'us' FROM us",
    "mapping_identity_check": _with(*_ALIGN) + "SELECT count(*) AS n_all, count(*) FILTER (split_part(from_iri, ':', -1) <> split_part(to_iri, ':', -1)) AS n_kept FROM edit WHERE same AND side = 'SRC'",
    "class_depth_max": _depth("max"),
    "class_depth_min": _depth("min"),
    "hierarchy_max_depth": _with(_PLACES, _WAYS, recursive=True) + "SELECT onto, max(depth) AS depth FROM ways GROUP BY onto",
    "class_ancestors": _with(_PLACES, _UP, recursive=True) + "FROM up",
    "synonym_pairs": _with(_BASE, _intra("SRC", "1"), _intra("TGT", "2")) + _both("syn"),
    "identity_synonyms": _with(_BASE) + "SELECT DISTINCT onto, label AS a, label AS b FROM labels",
    "soft_negatives": _with(_BASE, _intra("SRC", "1"), _intra("TGT", "2")) + _both("soft"),
    "sibling_hard_negatives": _with(_BASE, _intra("SRC", "1"), _intra("TGT", "2")) + _both("hard"),
    "hard_negatives_by_depth": _with(_PLACES, _WAYS, recursive=True) + """SELECT DISTINCT x.onto, p.label AS a, q.label AS b
FROM edges x JOIN edges y ON x.onto = y.onto AND x.parent = y.parent AND x.child <> y.child
JOIN place p ON p.iri = x.child JOIN place q ON q.iri = y.child WHERE p.label <> q.label AND x.parent IN (SELECT iri FROM ways GROUP BY iri HAVING max(depth) = 0)""",
    "cross_synonyms": _with(_BASE, _cross("ref", "0")) + "FROM xsyn0",
    "cross_soft_negatives": _with(_BASE, _cross("ref", "0")) + "FROM xsoft0",
    "corpus_merge": _with(*_CORPORA) + "FROM merged",
    "corpus_stats": _with(*_CORPORA) + "SELECT kind, count(*) AS n_pairs, count(DISTINCT a) AS n_labels FROM merged GROUP BY kind",
    "corpus_pairs": _with(_BASE, _intra("SRC", "1"), _intra("TGT", "2")) + "SELECT DISTINCT onto, a AS sent1, b AS sent2, (kind = 'synonym')::INT AS label FROM (" + _both("corpus", "a, b, kind") + ")",
    "label_pairs_tsv": _with(_BASE, _intra("SRC", "1"), _intra("TGT", "2")) + "SELECT a AS sent1, b AS sent2, positive::INT AS label FROM (SELECT DISTINCT onto, a, b, kind = 'synonym' AS positive FROM (" + _both("corpus", "a, b, kind") + "))",
    "corpora_stats": _with(*_CORPORA, _SPLIT, *[_cross(m, k) for m, k in _MAPS.items()]) + """SELECT corpus, kind, count(*) AS n_pairs, count(DISTINCT a) AS n_labels FROM (
  SELECT 'src' AS corpus, a, b, kind FROM corpus1 UNION ALL SELECT 'tgt', a, b, kind FROM corpus2 UNION ALL SELECT 'merged', a, b, kind FROM merged"""
    + "".join(f" UNION ALL SELECT '{k[1:]}', a, b, 'synonym' FROM xsyn{k} UNION ALL SELECT '{k[1:]}', a, b, 'soft' FROM xsoft{k}" for k in _MAPS.values()) + ") GROUP BY ALL",
    "finetune_us": _with(*_US) + "FROM us",
    "finetune_ss": _with(*_SS) + "FROM ss",
    "finetune_conflicts": _with(_BASE, _intra("SRC", "1"), _intra("TGT", "2")) + """SELECT 'SRC' AS onto, 'all' AS split, a AS sent1, b AS sent2 FROM syn1 JOIN sib1 USING (a, b)
UNION ALL SELECT 'TGT', 'all', a, b FROM syn2 JOIN sib2 USING (a, b)""",
    "embed_class_mean": "SELECT label, (pos - 1)::INT AS pos, round(avg(embedding[pos]::DOUBLE), 6) AS x FROM embeddings, range(1, 65) t(pos) GROUP BY ALL",
    "embed_cosine_topk": """WITH means AS (
  SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(embedding[pos]::DOUBLE) AS x FROM embeddings, range(1, 65) t(pos) GROUP BY ALL) GROUP BY label)
SELECT vec_id AS from_iri, m.label AS to_iri, round(list_cosine_similarity(embedding::DOUBLE[], m.v), 6) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, m.label)::INT AS rank
FROM embeddings CROSS JOIN means m WHERE round(list_cosine_similarity(embedding::DOUBLE[], m.v), 6) > 0 QUALIFY rank <= 3""",
    "align_embedding": _with(*_ALIGN, _VECTORS) + """SELECT side AS direction, CASE side WHEN 'SRC' THEN from_iri ELSE to_iri END AS src, CASE side WHEN 'SRC' THEN to_iri ELSE from_iri END AS tgt, score, rank FROM vectored""",
    "extend_one_hop": _with(_PLACES, _SEEDS) + f"SELECT DISTINCT * FROM ({_HOP.format('seeds')}) ANTI JOIN seeds USING (src, tgt)",
    "extend_fixpoint": _with(_PLACES, _SEEDS, f"ext(src, tgt, score) AS (SELECT * FROM seeds UNION {_HOP.format('ext')})", recursive=True) + "FROM ext ANTI JOIN seeds USING (src, tgt)",
    "extended_set": _with(_PLACES, _SEEDS, f"ext(src, tgt, score) AS (SELECT * FROM seeds UNION {_HOP.format('ext')})", recursive=True)
    + "SELECT src, tgt, score FROM seeds UNION ALL (FROM ext ANTI JOIN seeds USING (src, tgt))",
    "eval_repaired": _with(
        *_ALIGN, _REPAIRED, _SPLIT,
        _evaluation("(SELECT src, tgt FROM maps WHERE split = 'test')", "(FROM ign UNION ALL SELECT src, tgt FROM maps WHERE split <> 'test')", _AT, "ss"),
        _evaluation("ref", "(FROM ign UNION ALL SELECT src, tgt FROM maps WHERE split = 'val')", _AT, "us"),
    ) + "SELECT *, 'ss' AS setting FROM ss UNION ALL SELECT *, 'us' FROM us",
    "eval_report": _with(*_ALIGN, _SETS, _evaluation("ref", "ign", _AT)) + """SELECT set_type, threshold,
  concat_ws(' & ', set_type, format('{:.6f}', threshold), n_mappings, n_ignored, format('{:.3f}', p), format('{:.3f}', r), format('{:.3f}', f1)) || ' \\\\' AS line FROM evaluation""",
    "mapping_tsv_round_trip": _with(_BASE, _SCORED) + "FROM scored WHERE score >= 0.95",
    "mapping_rdf_round_trip": _with(_BASE, _SCORED) + "SELECT src, tgt, score, '=' AS relation, true AS legal FROM scored",
    "mapping_log_best": _with(_BASE, _SCORED) + """SELECT 'SRC' AS direction, src, tgt, score, 1 AS rank FROM scored QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) = 1
UNION ALL SELECT 'TGT', src, tgt, score, 1 FROM scored QUALIFY row_number() OVER (PARTITION BY tgt ORDER BY score DESC, src) = 1""",
    "mapping_repaired_tsv": _with(_BASE, _SCORED) + "FROM scored",
    "bundle_index": _with(_BASE, _TOKENS) + "FROM posting",
    "repair_one_to_one": _with(*_ALIGN) + """SELECT src, tgt, score FROM (SELECT DISTINCT src, tgt, score FROM bests)
QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) = 1 AND row_number() OVER (PARTITION BY tgt ORDER BY score DESC, src) = 1""",
    "repair_conflicts": _with(_PLACES, _CONFLICTS, _CONFLICTING, recursive=True) + "FROM conflicting",
    "repair_disjoint": _with(_PLACES, _CONFLICTS, _CONFLICTING, recursive=True) + """, scored AS (
  SELECT DISTINCT src, tgt, (900 + ('0x' || substr(md5(concat_ws('|', 'score', src, tgt)), 1, 8))::BIGINT % 100) / 1000::DOUBLE AS score FROM maps),
beaten AS (
  SELECT CASE WHEN a.score < b.score OR (a.score = b.score AND (a.src, a.tgt) > (b.src, b.tgt)) THEN {'src': a.src, 'tgt': a.tgt} ELSE {'src': b.src, 'tgt': b.tgt} END AS x
  FROM conflicting c JOIN scored a ON a.src = c.src AND a.tgt = c.tgt JOIN scored b ON b.src = c.src2 AND b.tgt = c.tgt2)
SELECT src, tgt, score FROM scored WHERE {'src': src, 'tgt': tgt} NOT IN (SELECT x FROM beaten)""",
    "mapping_pipe_format": _with(_BASE) + "SELECT replace(src, 'obo:', 'http://purl.obolibrary.org/obo/') || '|' || replace(tgt, 'ordo:', 'http://www.orpha.net/ORDO/') || '|=|1.0|CLS' AS line FROM ref",
    "mapping_pipe_parse": _with(_BASE) + "SELECT src, tgt, '=' AS relation, 1.0::DOUBLE AS score FROM ref",
    "mapping_expand_iri": _with(_BASE) + "SELECT src, replace(src, 'obo:', 'http://purl.obolibrary.org/obo/') AS src_iri, tgt, replace(tgt, 'ordo:', 'http://www.orpha.net/ORDO/') AS tgt_iri FROM ref",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
