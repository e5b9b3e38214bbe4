"""Plans over the building of a graph: channels, guards, chains, frames, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.operators import build, matching

from . import standin as S
from .catalogue import plan
from .folded import read
from .standin import sql


def joined(c: str):  # noqa: ANN201
    return F.array_join(c, ",").alias(c)


@plan("dictionary_hits", sql("SELECT i.item_id, c.chunk_id FROM ch c JOIN (SELECT item_id, text FROM benchmark) i ON instr(c.text, i.text) > 0"))
def dictionary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which whole benchmark passage, by the index of grams: the form for a dictionary that grows."""
    passages = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("pattern"))
    hits = matching.contained(S.chunks(spark, sf_dir), passages, ["chunk_id"], strategy="gram")
    return hits.join(passages, "pattern").select("item_id", "chunk_id")


@plan("trigger_channel", sql("SELECT chunk_id, frame_id, array_to_string(triggers, ',') AS triggers, low::BIGINT AS low, high::BIGINT AS high, round(conf, 6) AS conf FROM one"))
def trigger_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = build.trigger_channel(S.chunks(spark, sf_dir), S.frames(spark))
    return rows.select("chunk_id", "frame_id", joined("triggers"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), F.round("conf", 6).alias("conf"))


@plan("field_channel", sql("SELECT chunk_id, frame_id, triggers[1] AS word, low::BIGINT AS low, conf FROM two"))
def field_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.field_rows(spark, sf_dir).select("chunk_id", "frame_id", F.col("triggers")[0].alias("word"), F.col("spans")[0]["start"].cast("long").alias("low"), "conf")


@plan("incongruity", sql("SELECT t.chunk_id, t.pos::BIGINT AS pos, CASE WHEN t.field = d.dominant THEN 0.0::DOUBLE ELSE 0.6::DOUBLE END AS score FROM tagged t JOIN dom d ON d.chunk_id = t.chunk_id"))
def incongruity(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = build.words_of(S.chunks(spark, sf_dir)).join(S.rows_of(spark, S.FIELDS, "field, word"), "word")
    both = words.join(build.dominant_fields(words), "chunk_id", "left")
    return both.select("chunk_id", F.col("pos").cast("long").alias("pos"), build.incongruity(F.col("field"), F.col("dominant")).alias("score"))


DISCOVERED = "d AS (SELECT chunk_id, text, ws[1] AS source_domain, ws[2] AS target_domain, coalesce(ws[3], '') AS trigger, (chunk_no % 10) / 10.0::DOUBLE AS confidence FROM (SELECT *, string_split(text, ' ') AS ws FROM ch) x WHERE coalesce(ws[1], '') <> '' AND coalesce(ws[2], '') <> '')"
TYPED = "CASE WHEN source_domain LIKE '%of%' THEN 'FLUID' WHEN source_domain LIKE '%to%' OR source_domain LIKE '%is%' THEN 'PATH' WHEN source_domain LIKE '%der%' THEN 'BODY' ELSE 'GENERIC' END"
BOUND = f"""{DISCOVERED}, p AS (SELECT DISTINCT source_domain AS s, target_domain AS t, {TYPED} AS guess FROM d),
m AS (SELECT p.*, f.frame_id, f.ord, length(f.source_domain) AS ls, length(f.target_domain) AS lt, p.s = f.source_domain AS se, p.t = f.target_domain AS te, instr(p.t, f.target_domain) > 0 OR instr(f.target_domain, p.t) > 0 AS th
  FROM p JOIN frame_spec f ON (instr(p.s, f.source_domain) > 0 OR instr(f.source_domain, p.s) > 0) WHERE p.guess = 'GENERIC' OR f.source_type = 'GENERIC' OR p.guess = f.source_type),
r AS (SELECT s, t, frame_id, CASE WHEN se AND te THEN 1 WHEN se THEN 2 WHEN th THEN 3 ELSE 4 END AS step, row_number() OVER (PARTITION BY s, t ORDER BY CASE WHEN se AND te THEN 1 WHEN se THEN 2 WHEN th THEN 3 ELSE 4 END, CASE WHEN se THEN 0 ELSE -(ls + CASE WHEN th THEN lt ELSE 0 END) END, ord) AS nth FROM m),
b AS (SELECT p.s, p.t, coalesce(r.frame_id, 'F_LLM_' || left(md5(p.s || '|' || p.t), 8)) AS frame_id, coalesce(r.step, 5)::INTEGER AS step FROM p LEFT JOIN r ON r.s = p.s AND r.t = p.t AND r.nth = 1)"""


@plan("bind_frames", sql(f"WITH {BOUND} SELECT d.chunk_id, b.frame_id, b.step FROM d JOIN b ON b.s = d.source_domain AND b.t = d.target_domain"))
def bind_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.bind_frames(S.discovered(spark, sf_dir), S.frames(spark), S.RULES).select("chunk_id", "frame_id", F.col("step").cast("int").alias("step"))


@plan("open_channel", sql(f"WITH {DISCOVERED} SELECT chunk_id, (CASE WHEN trigger <> '' AND instr(text, trigger) > 0 THEN instr(text, trigger) ELSE instr(text, source_domain) END - 1)::BIGINT AS low FROM d WHERE confidence >= 0.5 AND (trigger <> '' AND instr(text, trigger) > 0 OR instr(text, source_domain) > 0)"))
def open_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = build.open_channel(S.chunks(spark, sf_dir), S.discovered(spark, sf_dir))
    return rows.select("chunk_id", F.array_min(F.transform("spans", lambda s: s["start"])).cast("long").alias("low"))


@plan("extracted_edges", sql("SELECT edge_id, chunk_id, frame_id, cascade_id, array_to_string(triggers, ',') AS triggers, array_to_string(ground, ',') AS ground, confidence, CASE WHEN len(triggers) = 1 THEN 'novel' ELSE 'conventional' END AS novelty, channel FROM edges"))
def extracted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.edges(spark, sf_dir).select("edge_id", "chunk_id", "frame_id", "cascade_id", joined("triggers"), joined("ground"), "confidence", "novelty", "channel")


@plan("refined_edges", sql("SELECT e.chunk_id, e.frame_id, e.channel, CASE WHEN l.toxic = 1 THEN 0.9::DOUBLE ELSE e.conf END AS conf FROM (SELECT * FROM one UNION ALL SELECT * FROM two) e JOIN labels l ON 'c' || l.doc_id = e.chunk_id WHERE l.quality = 1"))
def refined_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates a judge holds for figurative: good documents are, and toxic ones get a confidence of its own."""
    found = build.trigger_channel(S.chunks(spark, sf_dir), S.frames(spark)).unionByName(S.field_rows(spark, sf_dir))
    verdicts = read(spark, sf_dir, "labels").select(F.concat(F.lit("c"), F.col("doc_id")).alias("chunk_id"), (F.col("quality") == 1).alias("figurative"), F.when(F.col("toxic") == 1, 0.9).alias("judged"))
    return build.refined(found, verdicts, ["chunk_id"]).select("chunk_id", "frame_id", "channel", "conf")


#: Chains say each edge in turn whether it follows the last one taken: a recursion over the rows of a group.
CHAINS = """RECURSIVE e1 AS (SELECT edge_id, doc_id, chunk_id, chunk_no, frame_id, source_domain, target_domain, ground, triggers, confidence, row_number() OVER (PARTITION BY doc_id, frame_id, source_domain ORDER BY chunk_no, edge_id) AS rn FROM edges),
c1 AS (SELECT doc_id, frame_id, source_domain, rn, chunk_no AS last_no, ground AS last_ground, triggers AS last_triggers, [edge_id] AS ids FROM e1 WHERE rn = 1
  UNION ALL SELECT e1.doc_id, e1.frame_id, e1.source_domain, e1.rn, CASE WHEN ok THEN e1.chunk_no ELSE c1.last_no END, CASE WHEN ok THEN e1.ground ELSE last_ground END, CASE WHEN ok THEN e1.triggers ELSE last_triggers END, CASE WHEN ok THEN list_append(ids, e1.edge_id) ELSE ids END
  FROM c1 JOIN (SELECT * FROM e1) e1 ON e1.doc_id = c1.doc_id AND e1.frame_id = c1.frame_id AND e1.rn = c1.rn + 1, LATERAL (SELECT e1.chunk_no - c1.last_no < {gap} AND {more} AS ok) k),
whole AS (SELECT doc_id, frame_id, arg_max(ids, rn) AS ids FROM c1 GROUP BY doc_id, frame_id HAVING len(arg_max(ids, rn)) > 1),
link AS (SELECT h.doc_id, h.frame_id, e.* EXCLUDE (doc_id, frame_id) FROM (SELECT doc_id, frame_id, unnest(ids) AS edge_id FROM whole) h JOIN e1 e ON e.edge_id = h.edge_id),
ext AS (SELECT 'EXT_' || left(md5(frame_id || '|' || any_value(source_domain) || '|[''' || string_agg(chunk_id, ''', ''' ORDER BY chunk_id) || ''']'), 8) AS edge_id, doc_id, frame_id, any_value(source_domain) AS source_domain, any_value(ground) AS ground, count(*) AS n_links, round(max(confidence), 3) AS confidence, string_agg(chunk_no, ',' ORDER BY chunk_no, edge_id) AS chunk_nos,
  array_to_string(list_sort(list_distinct(flatten(list(triggers)))), ',') AS triggers FROM link GROUP BY doc_id, frame_id)"""
GROUND1 = CHAINS.format(gap=30, more="len(list_intersect(e1.ground, c1.last_ground)) >= 1")
REPEAT = CHAINS.format(gap=30, more="len(list_intersect(e1.ground, c1.last_ground)) >= 1 AND (len(list_intersect(e1.ground, c1.last_ground)) >= 2 OR len(list_intersect(e1.triggers, c1.last_triggers)) >= 1)")


def _extended(spark: SparkSession, sf_dir: str, repeat: bool) -> DataFrame:
    """Chunk numbers of one source lie some twenty apart, so chains here may bridge 30."""
    return build.extended(S.edges(spark, sf_dir), gap=30, repeat=repeat)


EXT_COLUMNS = "SELECT edge_id, doc_id, frame_id, n_links, confidence, chunk_nos, triggers FROM ext"


def _ext(rows: DataFrame) -> DataFrame:
    return rows.select("edge_id", "doc_id", "frame_id", F.size("chunk_nos").cast("long").alias("n_links"), "confidence", F.array_join("chunk_nos", ",").alias("chunk_nos"), joined("triggers"))


@plan("extended_edges", sql(f"WITH {GROUND1} {EXT_COLUMNS}").replace("WITH ", "WITH RECURSIVE ", 1).replace(", RECURSIVE ", ", "))
def extended_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ext(_extended(spark, sf_dir, False))


@plan("extended_edges_repeat", sql(f"WITH {REPEAT} {EXT_COLUMNS}").replace("WITH ", "WITH RECURSIVE ", 1).replace(", RECURSIVE ", ", "))
def extended_edges_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ext(_extended(spark, sf_dir, True))


@plan("verified_chains", sql(f"WITH {GROUND1} SELECT edge_id, doc_id FROM ext WHERE ascii(substr(doc_id, 4, 1)) % 2 = 0").replace("WITH ", "WITH RECURSIVE ", 1).replace(", RECURSIVE ", ", "))
def verified_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains with a judge's consent, which stands in for those of sources with an even first digit; the rest is unjudged or refused."""
    chains = _extended(spark, sf_dir, False)
    digit = F.ascii(F.substring("doc_id", 4, 1)) % 2
    verdicts = build.chain_key(chains).where(F.col("doc_id") != "src9").select("chain_key", (digit == 0).alias("continued"))
    return build.verified(chains, verdicts).select("edge_id", "doc_id")


ORPHANS = """o AS (SELECT frame_id, arg_min({column}, (chunk_no, edge_id)) AS key FROM edges WHERE frame_id NOT IN (SELECT frame_id FROM cascade_member) GROUP BY frame_id),
u AS (SELECT cascade_id, frame_id FROM cascade_member UNION SELECT 'C_{tag}_' || left(md5(key), 8), frame_id FROM o)
SELECT cascade_id, string_agg(frame_id, ',' ORDER BY frame_id) AS frame_ids FROM u GROUP BY cascade_id"""


def _orphans(rule: str):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cascades = S.members(spark).groupBy("cascade_id").agg(F.sort_array(F.collect_list("frame_id")).alias("frame_ids"))
        return build.orphan_cascades(S.edges(spark, sf_dir), cascades, rule).select("cascade_id", joined("frame_ids"))

    run.__module__ = __name__
    return run


for _rule, _tag in (("target", "ADHOC"), ("source", "ADHOC_SOURCE"), ("source_type", "ADHOC_SOURCE_TYPE")):
    plan(f"orphans_by_{_rule}", sql("WITH " + ORPHANS.format(column={"target": "target_domain", "source": "source_domain"}.get(_rule, _rule), tag=_tag)))(_orphans(_rule))


@plan("assembled_layers", sql("SELECT 'frame' AS layer, frame_id AS id, count(*) AS n FROM edges GROUP BY frame_id UNION ALL SELECT 'cascade', cascade_id, count(DISTINCT frame_id) FROM edges WHERE cascade_id IS NOT NULL GROUP BY cascade_id"))
def assembled_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, cascades = build.assembled(S.edges(spark, sf_dir), S.members(spark))
    return frames.select(F.lit("frame").alias("layer"), F.col("frame_id").alias("id"), F.size("edge_ids").cast("long").alias("n")).union(cascades.select(F.lit("cascade"), "cascade_id", F.size("frame_ids").cast("long")))


@plan("novel_frames", sql("SELECT 'F_NOVEL_' || left(md5(source_domain), 6) AS frame_id, 'NOVEL::' || source_domain AS name, string_agg(edge_id, ',' ORDER BY edge_id) AS edge_ids FROM edges WHERE frame_id IN ('F_PATH', 'F_BODY') GROUP BY source_domain"))
def novel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frames' edges stand in for edges without one."""
    edges = S.edges(spark, sf_dir).withColumn("frame_id", F.when(~F.col("frame_id").isin("F_PATH", "F_BODY"), F.col("frame_id")))
    return build.novel_frames(edges).select("frame_id", "name", joined("edge_ids"))


@plan("global_graph", sql("SELECT doc_id, count(*) AS n_edges, count(DISTINCT frame_id) AS n_frames, count(DISTINCT chunk_id) AS n_chunks FROM edges GROUP BY ROLLUP (doc_id)"))
def global_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graphs of all documents are one table; its size by document and in all."""
    return S.edges(spark, sf_dir).rollup("doc_id").agg(F.count("*").alias("n_edges"), F.count_distinct("frame_id").alias("n_frames"), F.count_distinct("chunk_id").alias("n_chunks"))


@plan("live_edges", sql("SELECT edge_id FROM edges WHERE chunk_no % 7 <> 0"))
def live_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    deprecated = F.when(F.col("chunk_no") % 7 == 0, True).when(F.col("chunk_no") % 7 == 1, False)
    return build.live(S.edges(spark, sf_dir).withColumn("deprecated", deprecated)).select("edge_id")


@plan("type_reliability", sql(f"""WITH {BOUND} SELECT d.chunk_id, CASE WHEN f.frame_id IS NULL THEN 0.5::DOUBLE WHEN EXISTS (SELECT 1 FROM type_constraint c WHERE c.source_type = f.source_type AND c.mapping_type = f.mapping_type) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS type_reliability,
  CASE WHEN f.frame_id IS NULL THEN 'fallback' ELSE 'ontology' END AS provenance FROM d JOIN b ON b.s = d.source_domain AND b.t = d.target_domain LEFT JOIN frame_spec f ON f.frame_id = b.frame_id"""))
def type_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = build.bind_frames(S.discovered(spark, sf_dir), S.frames(spark), S.RULES).join(S.frames(spark).select("frame_id", "source_type"), "frame_id", "left")
    return build.type_reliability(bound, S.frames(spark), S.constraints(spark)).select("chunk_id", "type_reliability", "provenance")
