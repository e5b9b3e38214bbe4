"""Plans over the operators that are folds, loops or vector arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.functions import text as fx
from hyperloom.operators import folds, graph, search

from .catalogue import plan
from .dialect import duck, parts_of, run
from .relational import sql_of


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CHAIN_SQL = """
WITH RECURSIVE e AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
c AS (SELECT conv_id, rn, turn AS last_turn, role AS last_role, [turn] AS chain FROM e WHERE rn = 1
  UNION ALL SELECT e.conv_id, e.rn, CASE WHEN e.turn - c.last_turn < 3 AND e.role = c.last_role THEN e.turn ELSE c.last_turn END,
    CASE WHEN e.turn - c.last_turn < 3 AND e.role = c.last_role THEN e.role ELSE c.last_role END,
    CASE WHEN e.turn - c.last_turn < 3 AND e.role = c.last_role THEN list_append(c.chain, e.turn) ELSE c.chain END
  FROM c JOIN e ON e.conv_id = c.conv_id AND e.rn = c.rn + 1)
SELECT conv_id, array_to_string(arg_max(chain, rn), ',') AS chain FROM c GROUP BY conv_id HAVING len(arg_max(chain, rn)) >= 2
"""


@plan("chain_link", CHAIN_SQL)
def chain_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").withColumn("ground", F.array("role"))
    out = folds.chain_link(turns, ["conv_id"], "turn", "ground")
    return out.select("conv_id", F.array_join(F.transform("chain", lambda x: x.cast("string")), ",").alias("chain"))


@plan("pack_context")
def pack_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    kind = F.when(F.col("lang") == "en", "edges").when(F.col("lang") == "fr", "entities").otherwise("chunks")
    return folds.pack(docs.withColumn("kind", kind), "source", "kind", "doc_id", "n_chars", 20_000, {"edges": 0.5, "entities": 0.3, "chunks": 0.2})


@plan("chunk_text")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.chunk_text(read(spark, sf_dir, "documents"), "doc_id", "text")


@plan("adaptive_threshold", duck("""SELECT query_id, n_decays, CASE n_decays WHEN 0 THEN 0.5E0 WHEN 1 THEN 0.4E0 WHEN 2 THEN 0.30000000000000004E0 WHEN 3 THEN 0.20000000000000004E0 WHEN 4 THEN 0.10000000000000003E0 ELSE 2.7755575615628914E-17 END AS threshold,
    CASE n_decays WHEN 0 THEN k0 WHEN 1 THEN k1 WHEN 2 THEN k2 WHEN 3 THEN k3 WHEN 4 THEN k4 ELSE k5 END AS n_selected, 'low' AS regime
  FROM (SELECT *, CASE WHEN k0 >= least(50, n) THEN 0 WHEN k1 >= least(50, n) THEN 1 WHEN k2 >= least(50, n) THEN 2 WHEN k3 >= least(50, n) THEN 3 WHEN k4 >= least(50, n) THEN 4 ELSE 5 END AS n_decays
    FROM (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE s >= 0.5) AS k0, count(*) FILTER (WHERE s >= 0.4) AS k1, count(*) FILTER (WHERE s >= 0.30000000000000004) AS k2, count(*) FILTER (WHERE s >= 0.20000000000000004) AS k3, count(*) FILTER (WHERE s >= 0.10000000000000003) AS k4, count(*) FILTER (WHERE s >= 2.7755575615628914E-17) AS k5 FROM (SELECT query_id, score / 10E0 AS s FROM lap) a GROUP BY query_id) b) c"""))
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.adaptive_threshold(run(spark, sf_dir, "SELECT query_id, score / 10E0 AS s FROM lap"), "query_id", "s", density=1.07)


@plan("cascade_ground")
def cascade_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages grouped by the beginnings of their grounds: a handful, each with a bounded set."""
    frames = run(spark, sf_dir, "SELECT split_part(frame_id, '/', 1) AS frame_id, count(*) AS support, array_sort(collect_set(substr(ground, 1, 2))) AS ground FROM wide_ground GROUP BY split_part(frame_id, '/', 1)")
    return folds.greedy_groups(frames, "frame_id", "support", "ground")


@plan("trigger_spans", "SELECT doc_id, 'tion' AS trigger, pos AS start, pos + 4 AS \"end\" FROM (SELECT doc_id, sum(len(part) + 4) OVER (PARTITION BY doc_id ORDER BY k) - 4 AS pos, k, n FROM (SELECT doc_id, unnest(string_split(text, 'tion')) AS part, unnest(range(len(string_split(text, 'tion')))) AS k, len(string_split(text, 'tion')) AS n FROM documents) a) b WHERE k < n - 1")
def trigger_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.spans_of_trigger(read(spark, sf_dir, "documents"), "doc_id", "text", F.lit("tion"))


@plan("hyperconv", duck("""SELECT i.node, round(0.5E0 * p.p_retailprice + 0.5E0 * (0.5E0 * (p.p_retailprice + avg(e.m))), 10) AS val FROM incidence i
    JOIN (SELECT edge, avg(p_retailprice) AS m FROM incidence JOIN part ON p_partkey = node GROUP BY edge) e ON e.edge = i.edge JOIN part p ON p.p_partkey = i.node GROUP BY i.node, p.p_retailprice"""))
def hyperconv(spark: SparkSession, sf_dir: str) -> DataFrame:
    inc = run(spark, sf_dir, "SELECT edge, node FROM incidence")
    features = inc.select("node").distinct().join(read(spark, sf_dir, "part"), F.col("node") == F.col("p_partkey")).select("node", F.lit(0).alias("dim"), F.col("p_retailprice").alias("val"))
    return graph.propagate(inc, features, layers=1).select("node", F.round("val", 10).alias("val"))


@plan("hyperconv_2layer")
def hyperconv_2layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    inc = run(spark, sf_dir, "SELECT edge, node FROM incidence")
    features = inc.select("node").distinct().join(read(spark, sf_dir, "part"), F.col("node") == F.col("p_partkey")).select("node", F.lit(0).alias("dim"), F.col("p_retailprice").alias("val"))
    return graph.propagate(inc, features, layers=2, alpha=0.8, leak=0.1).select("node", F.round("val", 4).alias("val"))


@plan("components")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(run(spark, sf_dir, "SELECT edge, node FROM incidence"))


@plan("hops", duck("""SELECT node, min(hop) AS hop FROM (SELECT min(node) AS node, 0 AS hop FROM incidence
    UNION ALL SELECT DISTINCT b.node, 1 FROM incidence a JOIN incidence b ON a.edge = b.edge WHERE a.node = (SELECT min(node) FROM incidence)
    UNION ALL SELECT DISTINCT d.node, 2 FROM incidence a JOIN incidence b ON a.edge = b.edge JOIN incidence c ON c.node = b.node JOIN incidence d ON d.edge = c.edge WHERE a.node = (SELECT min(node) FROM incidence)) x GROUP BY node"""))
def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    inc = run(spark, sf_dir, "SELECT edge, node FROM incidence")
    return graph.hops(inc, inc.agg(F.min("node")).first()[0], most=2)


@plan("ngram_embed_norm", """SELECT item_id, round(sqrt(sum(c * c)), 6) AS norm, count(*) AS n_buckets FROM (SELECT item_id, b, count(*) AS c FROM (SELECT item_id, ('0x' || substr(md5(g), 30, 3))::INT % 512 AS b FROM
  (SELECT DISTINCT item_id, g FROM (SELECT item_id, unnest(list_transform(range(1, length(t)), lambda i: substr(t, i::INT, 2))) AS g FROM (SELECT item_id, regexp_replace(text, '\\s', '', 'g') AS t FROM benchmark) a) b) c) d GROUP BY item_id, b) e GROUP BY item_id""")
def ngram_embed_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = read(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(fx.char_ngrams(F.col("text"), 2))).alias("g"))
    counts = grams.groupBy("item_id", fx.bucket(F.col("g")).alias("b")).agg(F.count("*").alias("c"))
    return counts.groupBy("item_id").agg(F.round(F.sqrt(F.sum(F.col("c") * F.col("c"))), 6).alias("norm"), F.count("*").alias("n_buckets"))


@plan("cosine_topk", """SELECT q, vec_id, rank FROM (SELECT a.vec_id AS q, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) x WHERE rank <= 5""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector whose id is divisible by 50 against all vectors."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5).select("q", "vec_id", "rank")


@plan("comembers", sql_of("comembers"))
def comembers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edge"), F.col("l_partkey").alias("node"))
    return graph.comembers(lines, parts_of(spark, sf_dir, "lineitem"))
