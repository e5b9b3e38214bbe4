"""Plans over reranking, stored artifacts, service hooks and writers, on stand-in rows of the tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.functions import text as fx
from hyperloom.operators import hooks, rerank
from hyperloom.sources import stores, writers

from .catalogue import plan
from .dialect import duck, run, run_dealt
from .folded import read

#: A pool per supplier: its lines, with numbers of theirs as scores.
POOL = """SELECT l_suppkey AS query, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS ord, l_quantity / 50E0 AS pure, l_discount * 10E0 AS closure, l_tax * 10E0 AS direct, (l_quantity + l_partkey % 37) / 90E0 AS graph,
  CASE l_partkey % 3 WHEN 0 THEN 'direct_answer' WHEN 1 THEN 'structural_explanation' ELSE 'thematic_neighbor' END AS role, (l_partkey % 11) / 10E0 AS confidence, (l_partkey % 101) / 100E0 AS anchor FROM lineitem"""

PEERS = f"""c AS (SELECT * FROM ({POOL}) x WHERE ord <= 300),
w0 AS (SELECT a.query, a.ord, b.ord AS o, b.graph AS g, CASE WHEN a.role = b.role THEN 1E0 ELSE 0.35E0 END * exp(-0.5E0 * (((b.pure - a.pure) / 0.04E0) * ((b.pure - a.pure) / 0.04E0) + ((b.closure - a.closure) / 0.1E0) * ((b.closure - a.closure) / 0.1E0) + ((b.direct - a.direct) / 0.12E0) * ((b.direct - a.direct) / 0.12E0))) AS w
  FROM c a JOIN c b ON a.query = b.query AND a.ord <> b.ord),
w1 AS (SELECT *, count(*) FILTER (WHERE w >= 1E-4) OVER (PARTITION BY query, ord) AS near, row_number() OVER (PARTITION BY query, ord, w >= 1E-4 ORDER BY o) AS rn FROM w0),
w AS (SELECT query, ord, g, CASE WHEN w >= 1E-4 THEN w ELSE 1E-4 END AS w FROM w1 WHERE w >= 1E-4 OR rn <= 3 - near),
m AS (SELECT query, ord, sum(w) AS sw, sum(w * w) AS sw2, sum(w * g) / sum(w) AS expected FROM w GROUP BY query, ord),
e AS (SELECT m.query, m.ord, any_value(expected) AS expected, any_value(sw * sw / sw2) AS effective, sqrt(sum(w.w * (g - expected) * (g - expected)) / any_value(sw) * (1 + 1 / greatest(1E0, any_value(sw * sw / sw2)))) AS uncertainty FROM m JOIN w ON w.query = m.query AND w.ord = m.ord GROUP BY m.query, m.ord)"""


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidates of each supplier's pool, as in the SQL. Suppliers are dealt to tasks, so that a task's memory does not grow with the table."""
    return run_dealt(spark, sf_dir, POOL, "lineitem", "l_suppkey").where(F.col("ord") <= rerank.MOST)


@plan("peer_expectation", f"WITH {PEERS} SELECT query, ord, round(expected, 6) AS expected, round(uncertainty, 6) AS uncertainty, round(effective, 6) AS effective FROM e")
def peer_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rerank.expectation(pools(spark, sf_dir))
    return out.select("query", F.col("ord").cast("long"), *[F.round(c, 6).alias(c) for c in ("expected", "uncertainty", "effective")])


@plan("rerank_final", f"""WITH {PEERS},
p AS (SELECT c.*, greatest(0E0, graph - expected - uncertainty) AS news, least(1E0, confidence * least(1E0, effective / 2.5E0)) AS trust, max(CASE WHEN role = 'direct_answer' THEN pure END) OVER (PARTITION BY c.query) AS front,
  greatest(0.05E0, least(1E0, avg(anchor) OVER (PARTITION BY c.query) + 2 * stddev_pop(anchor) OVER (PARTITION BY c.query))) AS bar FROM c JOIN e ON e.query = c.query AND e.ord = c.ord),
b AS (SELECT *, CASE role WHEN 'direct_answer' THEN least(0.02E0, news * trust * 0.5E0 * 0.35E0) WHEN 'structural_explanation' THEN least(0.045E0, news * trust * 0.5E0 * 0.7E0, CASE WHEN front > 0 THEN greatest(0E0, front - 0.005E0 - pure) ELSE 1E0 END)
    ELSE least(0.008E0, news * trust * 0.5E0 * 0.15E0, CASE WHEN front > 0 THEN greatest(0E0, front - 0.005E0 - pure) ELSE 1E0 END) END AS bonus,
  CASE WHEN anchor <= bar THEN 0E0 WHEN 0.2E0 - bar > 1E-12 THEN 0.1E0 * (3 - 2 * least(1E0, (anchor - bar) / (0.2E0 - bar))) * power(least(1E0, (anchor - bar) / (0.2E0 - bar)), 2) ELSE 0.1E0 END AS anchor_bonus FROM p)
SELECT query, ord, role, round(bonus, 6) AS bonus, round(anchor_bonus, 6) AS anchor_bonus, round(least(1E0, pure + bonus * 0.5E0 + anchor_bonus), 6) AS final FROM b""")
def rerank_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rerank.final_scores(pools(spark, sf_dir), omega=0.5)
    return out.select("query", F.col("ord").cast("long"), "role", *[F.round(c, 6).alias(c) for c in ("bonus", "anchor_bonus", "final")])


#: Orders as queries and candidates: classes of parts are nodes and tags, their line numbers hops and positions.
#: Queries are the orders whose key is divisible by 50; a query's pool is every order that holds one of its parts.
LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 23 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS once, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_discount) AS lone FROM lineitem) x WHERE once = 1 AND lone = 1"
NODES = f"SELECT l_orderkey AS query, l_partkey % 23 AS node, l_quantity AS weight, l_linenumber AS hop FROM ({LINES}) a WHERE l_orderkey % 50 = 0"
TAGS = f"SELECT l_orderkey AS candidate, l_partkey % 23 AS tag, l_linenumber AS position, (1 + l_discount) / 2E0 AS closure FROM ({LINES}) b"
POOLED = "SELECT DISTINCT a.l_orderkey AS query, b.l_orderkey AS candidate FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey WHERE a.l_orderkey % 50 = 0"
TOPOLOGY_SQL = f"""WITH n AS ({NODES}), t AS ({TAGS}), v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 23), pool AS ({POOLED}),
sim AS MATERIALIZED (SELECT a.vec_id AS node, b.vec_id AS tag, greatest(0E0, least(1E0, list_cosine_similarity(a.v, b.v))) AS s FROM v a JOIN v b ON true),
m AS (SELECT n.query, n.node, n.weight, n.hop, t.candidate, t.position, t.closure, n.node = t.tag AS exact, CASE WHEN n.node = t.tag THEN 1E0 ELSE sim.s END AS s FROM n JOIN pool ON pool.query = n.query JOIN t ON t.candidate = pool.candidate JOIN sim ON sim.node = n.node AND sim.tag = t.tag),
a0 AS (SELECT *, CASE WHEN exact THEN sqrt(closure) ELSE sqrt((s - 0.48E0) / 0.52E0 * closure) END AS quality FROM m WHERE exact OR s >= 0.48E0),
al AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, candidate, node ORDER BY exact DESC, quality DESC, position) AS rn FROM a0) x WHERE rn = 1),
tot AS (SELECT query, sum(weight) AS w, greatest(1, max(hop)) AS far FROM n GROUP BY query),
np AS (SELECT al.query, candidate, count(*) AS matched_nodes, sum(weight) / any_value(tot.w) AS nc, sum(weight * quality) / sum(weight) AS alignment, avg(closure) AS closure FROM al JOIN tot ON tot.query = al.query GROUP BY al.query, candidate),
ed AS (SELECT a.query, a.node AS source, b.node AS target, a.weight / 50E0 AS flow FROM n a JOIN n b ON a.query = b.query AND b.hop = a.hop + 1 WHERE a.weight / 50E0 >= 0.015E0),
f AS (SELECT query, sum(flow) AS f FROM ed GROUP BY query),
sp AS (SELECT candidate, greatest(1, max(position) - min(position)) AS span FROM t GROUP BY candidate),
e0 AS (SELECT ed.query, s.candidate, flow, exp(-abs(greatest(1, abs(g.hop - s.hop)) / tot.far::DOUBLE - abs(g.position - s.position) / span::DOUBLE) / 0.35E0) AS d, CASE WHEN g.position > s.position THEN 1E0 ELSE 0.25E0 END AS way, sqrt(s.quality * g.quality) AS q
  FROM ed JOIN al s ON s.query = ed.query AND s.node = ed.source JOIN al g ON g.query = ed.query AND g.node = ed.target AND g.candidate = s.candidate JOIN sp ON sp.candidate = s.candidate JOIN tot ON tot.query = ed.query WHERE s.position <> g.position),
ep AS (SELECT e0.query, candidate, count(*) AS matched_edges, sum(flow) / any_value(f.f) AS ec, sum(flow * d) / sum(flow) AS d, sum(flow * way) / sum(flow) AS way, sum(flow * q * d * way) / sum(flow) AS shape FROM e0 JOIN f ON f.query = e0.query GROUP BY e0.query, candidate)
SELECT pool.query, pool.candidate, coalesce(matched_nodes, 0)::BIGINT AS matched_nodes, coalesce(matched_edges, 0)::BIGINT AS matched_edges,
  round(CASE WHEN matched_edges > 0 THEN 0.18E0 * alignment + 0.22E0 * d + 0.18E0 * way + 0.42E0 * shape WHEN matched_nodes > 0 THEN sqrt(alignment * closure) ELSE 0E0 END, 6) AS score,
  round(CASE WHEN matched_edges > 0 THEN cbrt(nc * ec * closure) WHEN matched_nodes > 0 THEN least(0.2E0, sqrt(nc * closure)) ELSE 0E0 END, 6) AS reliability
FROM pool LEFT JOIN np ON np.query = pool.query AND np.candidate = pool.candidate LEFT JOIN ep ON ep.query = pool.query AND ep.candidate = pool.candidate"""


@plan("topology_match", TOPOLOGY_SQL)
def topology_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").where("vec_id < 23").select("vec_id", F.col("embedding").alias("vector"))
    nodes = run_dealt(spark, sf_dir, NODES, "lineitem", "l_orderkey").join(vectors, F.col("node") == F.col("vec_id")).drop("vec_id")
    tags = run_dealt(spark, sf_dir, TAGS, "lineitem", "l_orderkey").join(vectors, F.col("tag") == F.col("vec_id")).drop("vec_id")
    steps = nodes.select("query", F.col("node").alias("source"), (F.col("weight") / 50.0).alias("flow"), F.col("hop").alias("ord"))
    edges = steps.join(nodes.select("query", F.col("node").alias("target"), (F.col("hop") - 1).alias("ord")), ["query", "ord"])
    pool = run(spark, sf_dir, POOLED)
    out = rerank.topology(nodes, edges, tags, pool, few=True)  # 23 classes of parts
    return out.select("query", "candidate", "matched_nodes", "matched_edges", F.round("score", 6).alias("score"), F.round("reliability", 6).alias("reliability"))


@plan("artifact_arcs", "SELECT c_nationkey::BIGINT AS artifact_id, c_custkey + 1 AS source, c_custkey + 1 AS target, round(abs(c_acctbal), 2) AS weight FROM customer")
def artifact_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of each nation as a stored graph of loops, packed, checked and unpacked."""
    rows = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("artifact_id")).agg(F.sort_array(F.collect_list(F.struct((F.col("c_custkey") + 1).alias("id"), F.round(F.abs("c_acctbal"), 2).alias("w")))).alias("g"))
    upto = F.sequence(F.lit(0), F.size("g") - 1)
    text = F.to_json(F.struct(F.col("g.id").alias("node_ids"), F.sequence(F.lit(0), F.size("g")).alias("row_offsets"), upto.alias("targets"), F.col("g.w").alias("weights")))
    rows = rows.select("artifact_id", text.alias("text")).withColumn("checksum", F.sha2("text", 256))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            packed = []
            for t in frame["text"]:
                z = zlib.compressobj(wbits=31)
                packed.append(z.compress(t.encode()) + z.flush())
            yield pd.DataFrame({"artifact_id": frame["artifact_id"], "checksum": frame["checksum"], "payload": packed})

    packed = rows.mapInPandas(pack, "artifact_id long, checksum string, payload binary")
    return stores.arcs(stores.decoded(packed))


@plan("judged", "SELECT doc_id, CASE WHEN ascii(source) % 2 = 0 THEN upper(source) END AS verdict FROM documents")
def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's verdict on each source, asked once a source; null is a rejection."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    keys = docs.select("source").where("source is not null").distinct()
    told = hooks.called(keys, "source", lambda part: [s.upper() if ord(s[0]) % 2 == 0 else None for s in part], "string")
    return docs.join(told, "source", "left").select("doc_id", F.col("answer").alias("verdict"))


@plan("graph_transactions", "SELECT sum(n)::BIGINT AS n_statements FROM (SELECT count(*) AS n FROM customer UNION ALL SELECT count(*) FROM nation)")
def graph_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of customers and nations as transactions to a server that takes all."""
    one = F.format_string("MERGE (n:Customer {id: %d});", F.col("c_custkey"))
    two = F.format_string("MERGE (n:Nation {id: %d});", F.col("n_nationkey"))
    statements = read(spark, sf_dir, "customer").select(one.alias("statement")).union(read(spark, sf_dir, "nation").select(two.alias("statement")))
    return writers.transactions(statements, lambda part: None).agg(F.sum("n_statements").alias("n_statements"))


@plan("gold_queries", duck("SELECT q.query_id::BIGINT AS query_id, q.query_text, coalesce(g.gold, '') AS gold FROM query_set q LEFT JOIN (SELECT query_id, @JOINED(doc_id)@ AS gold FROM (SELECT DISTINCT f.query_id, h.doc_id FROM q_frame f JOIN hit h ON h.frame_id = f.frame_id) x GROUP BY query_id) g ON g.query_id = q.query_id"))
def gold_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = run(spark, sf_dir, "SELECT f.query_id, h.doc_id AS chunk_id FROM q_frame f JOIN hit h ON h.frame_id = f.frame_id")
    out = writers.gold_queries(run(spark, sf_dir, "SELECT query_id, query_text FROM query_set"), hits)
    return out.select(F.col("query_id").cast("long"), "query_text", F.array_join(F.transform("gold", lambda x: x.cast("string")), ",").alias("gold"))


@plan("equative_patterns")
def equative_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = fx.equative(F.col("text"), [" ist"], [" is", " est", " es", " was"], ["the", "of", "la", "le", "der", "die", "das", "el"])
    return docs.select("doc_id", found.alias("pattern")).where("pattern is not null")


@plan("sequence_states")
def sequence_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hooks.encode_sequences(read(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", "embedding", 64)
    return out.select("label", F.transform("state", lambda v: F.round(v, 6)).alias("state"))
