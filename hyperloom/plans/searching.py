"""Plans over query sets, features, scoring arms, fallbacks, chain scores and the meta graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.operators import build, search

from . import standin as S
from .building import GROUND1, REPEAT
from .catalogue import plan
from .standin import sql

NAMES = [("C_MOTION", "MOTION"), ("C_FORM", "FORM"), ("C_LLM_UP", "LLM_TARGET::up")]
NEIGHBOURS = [("tion", "nation"), ("tion", "section"), ("und", "rund"), ("los", "que"), ("x", "the"), ("que", "quel")]


def queries(spark: SparkSession) -> DataFrame:
    return S.fixture(spark, "query_set")


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.type_reliability(S.edges(spark, sf_dir), S.frames(spark), S.constraints(spark))


def grams(rows: str, key: str, text: str) -> str:
    """SQL for the hashed vectors: key, b, w."""
    one = "CASE WHEN length(t) <= 1 THEN [t] ELSE list_transform(range(1, length(t) + 1), lambda i: substr(t, i::INT, 1)) END"
    two = "CASE WHEN length(t) <= 2 THEN [t] ELSE list_transform(range(1, length(t)), lambda i: substr(t, i::INT, 2)) END"
    counts = f"SELECT {key}, b, count(*)::DOUBLE AS c FROM (SELECT {key}, ('0x' || substr(md5(g), 30, 3))::INT % 512 AS b FROM (SELECT {key}, unnest(list_distinct(list_concat({one}, {two}))) AS g FROM (SELECT {key}, regexp_replace({text}, '\\s', '', 'g') AS t FROM {rows}) r0) r1 WHERE g <> '') r2 GROUP BY {key}, b"
    return f"SELECT {key}, b, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS w FROM ({counts}) r3"


KINDS = """kd AS (SELECT DISTINCT frame_id, cascade_id, ground, triggers, md5(concat_ws('|', frame_id, source_domain, target_domain, array_to_string(triggers, ','), array_to_string(ground, ','))) AS kind,
  least(1.0::DOUBLE, 0.5::DOUBLE * len(ground) + CASE WHEN cascade_id IS NOT NULL THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS struct,
  source_domain || '→' || target_domain || '：把' || target_domain || '比作' || source_domain || '，强调' || CASE WHEN len(ground) > 0 THEN array_to_string(ground, '、') ELSE '（未抽取到喻底）' END || '。触发词：' || array_to_string(triggers[1:5], '、') || '。' AS description FROM edges)"""
TEXTF = f"""{KINDS}, kv AS ({grams('kd', 'kind', 'description')}), qv AS ({grams('query_set', 'query_id', 'query_text')}),
sm AS (SELECT query_id, kind, sum(qv.w * kv.w) AS sem FROM qv JOIN kv ON qv.b = kv.b GROUP BY query_id, kind),
qf AS (SELECT DISTINCT q.query_id, t.frame_id, m.cascade_id FROM query_set q JOIN frame_trigger t ON instr(q.query_text, t.trigger) > 0 LEFT JOIN cascade_member m ON m.frame_id = t.frame_id),
tf AS (SELECT q.query_id, k.kind, coalesce(sm.sem, 0.0::DOUBLE) AS sem, k.struct, least(1.0::DOUBLE, 0.5::DOUBLE * len(list_filter(k.triggers, lambda x: instr(q.query_text, x) > 0))) AS clue, 1.0::DOUBLE AS type,
  CASE WHEN EXISTS (SELECT 1 FROM qf WHERE qf.query_id = q.query_id AND qf.frame_id = k.frame_id) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS same_frame,
  CASE WHEN EXISTS (SELECT 1 FROM qf WHERE qf.query_id = q.query_id AND qf.cascade_id = k.cascade_id) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS same_cascade,
  CASE WHEN len(k.ground) > 0 THEN len(list_filter(k.ground, lambda x: instr(q.query_text, x) > 0)) / len(k.ground)::DOUBLE ELSE 0.0::DOUBLE END AS ground
  FROM query_set q CROSS JOIN kd k LEFT JOIN sm ON sm.query_id = q.query_id AND sm.kind = k.kind)"""
ROUNDED = ", ".join(f"round({f}, 6) AS {f}" for f in search.FEATURES)


def rounded(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, *[F.round(f, 6).alias(f) for f in search.FEATURES])


@plan("text_features", sql(f"WITH {TEXTF} SELECT query_id::BIGINT AS query_id, kind, {ROUNDED} FROM tf"))
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.text_features(queries(spark), search.kinds(typed(spark, sf_dir)), S.frames(spark), S.members(spark))
    return rounded(rows, [F.col("query_id").cast("long").alias("query_id"), "kind"])


PAIRF = """pf AS (SELECT x.kind AS a, y.kind AS b, x.frame_id AS fa, coalesce((SELECT sum(u.w * v.w) FROM kv u JOIN kv v ON u.b = v.b WHERE u.kind = x.kind AND v.kind = y.kind), 0.0::DOUBLE) AS sem, y.struct, least(1.0::DOUBLE, 0.5::DOUBLE * len(list_intersect(x.triggers, y.triggers))) AS clue, 1.0::DOUBLE AS type,
  CASE WHEN x.frame_id = y.frame_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS same_frame, CASE WHEN x.cascade_id = y.cascade_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS same_cascade,
  len(list_intersect(x.ground, y.ground)) / greatest(1, len(list_distinct(list_concat(x.ground, y.ground))))::DOUBLE AS ground FROM kd x CROSS JOIN kd y)"""
STRONG = f"""{TEXTF}, {PAIRF}, st AS (SELECT qf.query_id, pf.b AS kind, {', '.join(f'max({f}) AS {f}' for f in search.FEATURES)} FROM (SELECT DISTINCT query_id, frame_id FROM qf) qf JOIN pf ON pf.fa = qf.frame_id GROUP BY qf.query_id, pf.b),
sf AS (SELECT * FROM st UNION ALL SELECT * FROM tf WHERE query_id NOT IN (SELECT query_id FROM st))"""


@plan("edge_pair_features", sql(f"WITH {TEXTF}, {PAIRF} SELECT a, b, {ROUNDED} FROM pf"))
def edge_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.pair_features(search.kinds(typed(spark, sf_dir))), ["a", "b"])


@plan("strongest_support", sql(f"WITH {STRONG} SELECT query_id::BIGINT AS query_id, kind, {ROUNDED} FROM sf"))
def strongest_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.strongest(queries(spark), search.kinds(typed(spark, sf_dir)), S.frames(spark), S.members(spark))
    return rounded(rows, [F.col("query_id").cast("long").alias("query_id"), "kind"])


_TOTAL = "2.9012::DOUBLE"
_HAND = "0.6911 * sem + 0.0195 * least(struct, 1) + 1.2543 * least(clue, 1) + 0.0487 * type + 0.1953 * same_frame + 0.1958 * same_cascade + 0.4965 * ground"
_BARE = "0.6911 * sem + 0.0195 * least(struct, 1) + 1.2543 * least(clue, 1) + 0.0487 * type + 0.4965 * ground"
_OLD = "0.35 * sem + 0.25 * least(struct, 1) + 0.2 * least(clue, 1) + 0.2 * type"
SCORED = f"""{STRONG}, ek AS (SELECT *, md5(concat_ws('|', frame_id, source_domain, target_domain, array_to_string(triggers, ','), array_to_string(ground, ','))) AS kind, CASE WHEN chunk_no % 3 = 0 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM edges),
sc AS (SELECT query_id, kind, ({_HAND}) / {_TOTAL} AS hand, ({_BARE}) / {_TOTAL} AS no_role, {_OLD} AS legacy FROM sf)"""


def doubted(edges: DataFrame) -> DataFrame:
    """Every third chunk's edges are worth half."""
    return edges.withColumn("reliability", F.when(F.col("chunk_no") % 3 == 0, 0.5).otherwise(1.0))


@plan("scoring_arms", sql(f"""WITH {SCORED} SELECT query_id::BIGINT AS query_id, chunk_id, arm, round(max(score), 6) AS score FROM (SELECT sc.query_id, ek.chunk_id, unnest(['hand', 'hand_reliable', 'legacy', 'legacy_reliable', 'no_role', 'no_role_reliable']) AS arm, unnest([hand, hand * factor, legacy, legacy * factor, no_role, no_role * factor]) AS score FROM ek JOIN sc ON sc.kind = ek.kind) x GROUP BY query_id, chunk_id, arm"""))
def scoring_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = doubted(typed(spark, sf_dir))
    features = search.strongest(queries(spark), search.kinds(edges), S.frames(spark), S.members(spark))
    return search.arms(features, edges).select(F.col("query_id").cast("long").alias("query_id"), "chunk_id", "arm", F.round("score", 6).alias("score"))


@plan("representative_edges", sql(f"WITH {SCORED} SELECT sf.query_id::BIGINT AS query_id, chunk_id, arg_min(edge_id, (-round(sem, 9), edge_id)) AS edge_id FROM ek JOIN sf ON sf.kind = ek.kind GROUP BY sf.query_id, chunk_id"))
def representative_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = typed(spark, sf_dir)
    features = search.strongest(queries(spark), search.kinds(edges), S.frames(spark), S.members(spark))
    return search.representatives(features, edges).select(F.col("query_id").cast("long").alias("query_id"), "chunk_id", "edge_id")


SETS = """f AS (SELECT * FROM (SELECT *, array_to_string(triggers, '，') AS query_text, row_number() OVER (PARTITION BY array_to_string(triggers, '，') ORDER BY chunk_no, edge_id) AS r FROM edges) x WHERE r = 1),
ff AS (SELECT frame_id, list_distinct(list(chunk_id)) AS own FROM edges GROUP BY frame_id), cc AS (SELECT cascade_id, list_distinct(list(chunk_id)) AS own FROM edges WHERE cascade_id IS NOT NULL GROUP BY cascade_id),
d AS (SELECT f.query_text, f.chunk_id, list_sort(list_filter(ff.own, lambda x: x <> f.chunk_id)) AS a, list_sort(list_filter(coalesce(cc.own, []), lambda x: x <> f.chunk_id)) AS b FROM f JOIN ff ON ff.frame_id = f.frame_id LEFT JOIN cc ON cc.cascade_id = f.cascade_id)"""


def ordered(edges: DataFrame) -> DataFrame:
    return edges.withColumn("ord", F.struct("chunk_no", "edge_id"))


def _sets(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    rows = search.query_sets(ordered(S.edges(spark, sf_dir))).where(F.col("family") == family)
    return rows.select("query_text", "own", F.size("gold").cast("long").alias("n_gold"), F.md5(F.array_join("gold", ",")).alias("gold_md5"))


@plan("anchored_gold", sql(f"WITH {SETS} SELECT query_text, chunk_id AS own, 1::BIGINT AS n_gold, md5(chunk_id) AS gold_md5 FROM f"))
def anchored_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir, "anchored")


@plan("deanchor_gold", sql(f"WITH {SETS} SELECT query_text, chunk_id AS own, len(g)::BIGINT AS n_gold, md5(array_to_string(g, ',')) AS gold_md5 FROM (SELECT *, CASE WHEN len(a) > 0 THEN a ELSE b END AS g FROM d) x WHERE len(g) > 0"))
def deanchor_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir, "deanchored")


@plan("deanchor_pool", sql(f"WITH {SETS} SELECT f.query_text, e.chunk_id FROM f JOIN edges e ON array_to_string(e.triggers, '，') = f.query_text WHERE e.chunk_id <> f.chunk_id GROUP BY f.query_text, e.chunk_id"))
def deanchor_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each query's triggers, without the one the query was made from."""
    edges = ordered(S.edges(spark, sf_dir))
    pool = edges.select(F.array_join("triggers", "，").alias("query_text"), "chunk_id").distinct()
    sets = search.query_sets(edges).where("family = 'anchored'")
    return search.without_own(pool, sets)


FALLBACK = f"""nm(cascade_id, name) AS (VALUES {', '.join(str(r) for r in NAMES)}),
ct AS (SELECT m.cascade_id, any_value(nm.name) || '：' || string_agg(s.source_domain || '→' || s.target_domain, '；' ORDER BY m.ord) AS description FROM cascade_member m JOIN frame_spec s ON s.frame_id = m.frame_id JOIN nm ON nm.cascade_id = m.cascade_id GROUP BY m.cascade_id),
cv AS ({grams('ct', 'cascade_id', 'description')}), qv AS ({grams('query_set', 'query_id', 'query_text')}),
top AS (SELECT * FROM (SELECT query_id, cascade_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(qv.w * cv.w), 9) DESC, cascade_id) AS r FROM qv JOIN cv ON qv.b = cv.b GROUP BY query_id, cascade_id) x WHERE r <= 2)"""


@plan("semantic_fallback", sql(f"WITH {FALLBACK} SELECT top.query_id::BIGINT AS query_id, e.chunk_id, round(sum((e.confidence + 0.3 * len(e.ground)) * CASE WHEN e.chunk_no % 3 = 0 THEN 0.75 ELSE 1 END)::DOUBLE, 6) AS score FROM top JOIN edges e ON e.cascade_id = top.cascade_id GROUP BY top.query_id, e.chunk_id"))
def semantic_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = search.cascade_texts(S.frames(spark), S.members(spark), S.rows_of(spark, NAMES, "cascade_id, name"))
    rows = search.semantic_fallback(queries(spark), texts, doubted(typed(spark, sf_dir)))
    return rows.select(F.col("query_id").cast("long").alias("query_id"), "chunk_id", F.round("score", 6).alias("score"))


def _second(text: str) -> str:
    """The second recursion under other names."""
    import re

    return re.sub(r"\b(e1|c1|whole|link|ext|k)\b", r"\1_b", text).replace("RECURSIVE ", "")


@plan("p3_chain_f1", sql(f"""WITH {GROUND1}, {_second(REPEAT)},
p AS (SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(chunk_nos, ',')::INT[])), ',') AS k, list_max(string_split(chunk_nos, ',')::INT[]) - list_min(string_split(chunk_nos, ',')::INT[]) AS span FROM ext),
g AS (SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(chunk_nos, ',')::INT[])), ',') AS k FROM ext_b),
pc AS (SELECT doc_id, k, count(*) AS p, sum(CASE WHEN span >= 60 THEN 1 ELSE 0 END) AS wide FROM p GROUP BY doc_id, k), gc AS (SELECT doc_id, k, count(*) AS g FROM g GROUP BY doc_id, k),
b AS (SELECT coalesce(pc.doc_id, gc.doc_id) AS doc_id, coalesce(p, 0) AS p, coalesce(g, 0) AS g, coalesce(wide, 0) AS wide FROM pc FULL JOIN gc ON pc.doc_id = gc.doc_id AND pc.k = gc.k),
s AS (SELECT doc_id, sum(p)::BIGINT AS n_pred, sum(g)::BIGINT AS n_gold, sum(least(p, g))::BIGINT AS hits, sum(wide)::BIGINT AS spurious FROM b GROUP BY doc_id),
t AS (SELECT *, CASE WHEN n_pred > 0 THEN hits / n_pred::DOUBLE WHEN n_gold = 0 THEN 1 ELSE 0 END AS pr, CASE WHEN n_gold > 0 THEN hits / n_gold::DOUBLE ELSE 1 END AS re FROM s)
SELECT doc_id, n_pred, n_gold, hits, spurious, round(pr, 6) AS "precision", round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0::DOUBLE END, 6) AS f1 FROM t""").replace("WITH ", "WITH RECURSIVE ", 1).replace(", RECURSIVE ", ", "))
def p3_chain_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains by one shared ground against those with more evidence, as if these were gold."""
    edges = S.edges(spark, sf_dir)
    out = search.chain_scores(build.extended(edges, 30), build.extended(edges, 30, repeat=True), gap=60)
    return out.select("doc_id", "n_pred", "n_gold", "hits", "spurious", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@plan("commonsense_path", sql(f"SELECT q.query_id::BIGINT AS query_id, c.chunk_id, count(DISTINCT n.neighbour) AS score FROM query_set q JOIN (VALUES {', '.join(str(r) for r in NEIGHBOURS)}) n(term, neighbour) ON length(n.term) >= 2 AND instr(q.query_text, n.term) > 0 JOIN ch c ON instr(c.text, n.neighbour) > 0 GROUP BY q.query_id, c.chunk_id"))
def commonsense_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.commonsense(queries(spark), S.rows_of(spark, NEIGHBOURS, "term, neighbour"), S.chunks(spark, sf_dir))
    return out.select(F.col("query_id").cast("long").alias("query_id"), "chunk_id", "score")


@plan("metagraph", sql("""WITH t AS (SELECT doc_id, chunk_id, edge_id, frame_id, unnest(triggers) AS trigger FROM edges), low AS (SELECT doc_id, chunk_id, 'trigger_of' AS rel FROM t UNION ALL SELECT doc_id, chunk_id, 'in_frame' FROM t)
SELECT 0 AS level, chunk_id AS scope, rel, count(*) AS n FROM low GROUP BY chunk_id, rel UNION ALL SELECT 1, doc_id, rel, count(*) FROM low GROUP BY doc_id, rel
UNION ALL SELECT 2, '', 'has_frame', count(*) FROM cascade_member WHERE frame_id IN (SELECT frame_id FROM edges)"""))
def metagraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.metagraph(S.edges(spark, sf_dir), S.members(spark)).groupBy("level", "scope", "rel").agg(F.count("*").alias("n"))
