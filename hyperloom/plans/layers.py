"""Plans over the layered hypergraph: families of edges, its operator, reach, coherence, states of mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.operators import graph, search
from hyperloom.operators.lineage import cut

from . import standin as S
from .catalogue import plan
from .folded import read
from .searching import grams, queries
from .standin import sql

#: The kinds of edges: what repeats of a mapping share. The graph over them is the ontology's, whatever the number of documents.
DISTINCT = "m AS (SELECT key AS edge_id, * EXCLUDE (key) FROM (SELECT frame_id || ':' || array_to_string(triggers, '+') AS key, any_value(frame_id) AS frame_id, any_value(source_domain) AS source_domain, any_value(target_domain) AS target_domain, any_value(ground) AS ground, any_value(triggers) AS triggers, any_value(cascade_id) AS cascade_id FROM edges GROUP BY key) z)"
LAYERED = f"""{DISTINCT}, en AS (SELECT edge_id, frame_id, unnest(list_concat([source_domain, target_domain], ground)) AS node FROM m),
ly AS (SELECT 'mapping' AS family, edge_id AS edge, node FROM en UNION ALL SELECT DISTINCT 'frame', 'frame:' || frame_id, node FROM en UNION ALL SELECT DISTINCT 'frame', 'frame:' || frame_id, frame_id FROM en
  UNION ALL SELECT 'cascade', 'cascade:' || cascade_id, frame_id FROM cascade_member WHERE frame_id IN (SELECT frame_id FROM m) UNION ALL SELECT DISTINCT 'cascade', 'cascade:' || cascade_id, cascade_id FROM cascade_member WHERE frame_id IN (SELECT frame_id FROM m))"""


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws(":", "frame_id", F.array_join("triggers", "+"))
    return cut(S.edges(spark, sf_dir).select(key.alias("edge_id"), "frame_id", "source_domain", "target_domain", "ground", "triggers", "cascade_id").distinct())


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.layered(mappings(spark, sf_dir), S.members(spark))


@plan("layered_edges", sql(f"WITH {LAYERED} SELECT family, edge, node FROM ly"))
def layered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir)


@plan("layered_nodes", sql(f"WITH {LAYERED} SELECT node, count(*) AS degree FROM ly GROUP BY node"))
def layered_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).groupBy("node").agg(F.count("*").alias("degree"))


@plan("layered_operator", sql(f"""WITH {LAYERED}, h AS (SELECT DISTINCT edge, node FROM ly), dv AS (SELECT node, count(*) AS d FROM h GROUP BY node), de AS (SELECT edge, count(*) AS d FROM h GROUP BY edge),
s AS (SELECT a.node AS "row", b.node AS col, sum(0.9::DOUBLE / (dv.d * de.d)) AS s FROM h a JOIN h b ON a.edge = b.edge JOIN dv ON dv.node = a.node JOIN de ON de.edge = a.edge GROUP BY a.node, b.node)
SELECT "row", col, round(0.5 * (s + CASE WHEN "row" = col THEN 1 ELSE 0 END), 6) AS val FROM s"""))
def layered_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.operator(layered(spark, sf_dir), leak=0.1).select("row", "col", F.round("val", 6).alias("val"))


@plan("reachable_concepts", sql(f"""WITH RECURSIVE {DISTINCT}, en AS (SELECT DISTINCT edge_id, unnest(list_concat([source_domain, target_domain], ground)) AS node FROM m),
pair AS (SELECT DISTINCT a.edge_id AS x, b.edge_id AS y FROM en a JOIN en b ON a.node = b.node), rc AS (SELECT x, y FROM pair UNION SELECT rc.x, pair.y FROM rc JOIN pair ON rc.y = pair.x),
st AS (SELECT node AS start, edge_id FROM en UNION SELECT unnest(triggers), edge_id FROM m)
SELECT DISTINCT st.start, rc.y AS edge_id, unnest([m.source_domain, m.target_domain]) AS concept FROM st JOIN rc ON rc.x = st.edge_id JOIN m ON m.edge_id = rc.y""").replace("WITH ", "WITH RECURSIVE ", 1).replace(", RECURSIVE ", ", "))
def reachable_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(mappings(spark, sf_dir))


#: One round of means over the layered graph, from vectors of the nodes' names.
STATES = f"""{LAYERED}, nn AS (SELECT DISTINCT node FROM ly), x0 AS ({grams('nn', 'node', 'node')}),
eb AS (SELECT ly.edge, x0.b, sum(x0.w) AS s FROM ly JOIN x0 ON x0.node = ly.node GROUP BY ly.edge, x0.b), ec AS (SELECT edge, count(*) AS n FROM ly GROUP BY edge), nc AS (SELECT node, count(*) AS n FROM ly GROUP BY node),
got AS (SELECT ly.node, eb.b, sum(eb.s / ec.n) AS s FROM ly JOIN eb ON eb.edge = ly.edge JOIN ec ON ec.edge = ly.edge GROUP BY ly.node, eb.b),
x1 AS (SELECT got.node, got.b, 0.5 * (coalesce(x0.w, 0) + got.s / nc.n) AS v FROM got JOIN nc ON nc.node = got.node LEFT JOIN x0 ON x0.node = got.node AND x0.b = got.b)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse states: a node has a row for each bucket that reaches it."""
    inc = cut(layered(spark, sf_dir))
    start = search.embedded(inc.select("node").distinct(), "node", "node").select("node", F.col("bucket").alias("dim"), F.col("weight").alias("val"))
    arity, degree = inc.groupBy("edge").agg(F.count("*").alias("ne")), inc.groupBy("node").agg(F.count("*").alias("nv"))
    by_edge = inc.join(start, "node").groupBy("edge", "dim").agg(F.sum("val").alias("s")).join(arity, "edge").select("edge", "dim", (F.col("s") / F.col("ne")).alias("m"))
    got = inc.join(by_edge, "edge").groupBy("node", "dim").agg(F.sum("m").alias("s")).join(degree, "node").select("node", "dim", (F.col("s") / F.col("nv")).alias("got"))
    return got.join(start, ["node", "dim"], "left").select("node", "dim", (0.5 * (F.coalesce("val", F.lit(0.0)) + F.col("got"))).alias("val"))


@plan("coherence", sql(f"""WITH {STATES}, p AS (SELECT DISTINCT a.source_domain AS a, b.target_domain AS b FROM m a CROSS JOIN m b), nr AS (SELECT node, sqrt(sum(v * v)) AS n FROM x1 GROUP BY node),
d AS (SELECT p.a, p.b, sum(u.v * w.v) AS s FROM p JOIN x1 u ON u.node = p.a JOIN x1 w ON w.node = p.b AND w.b = u.b GROUP BY p.a, p.b)
SELECT p.a, p.b, round(coalesce(d.s / (na.n * nb.n), 0.0::DOUBLE), 6) AS coherence FROM p JOIN nr na ON na.node = p.a JOIN nr nb ON nb.node = p.b LEFT JOIN d ON d.a = p.a AND d.b = p.b"""))
def coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source domain with every target domain of the ontology: true mappings and strangers."""
    own = mappings(spark, sf_dir)
    pairs = own.select(F.col("source_domain").alias("a")).distinct().join(F.broadcast(own.select(F.col("target_domain").alias("b")).distinct()))  # domains of the ontology
    return graph.coherence(states(spark, sf_dir), pairs).select("a", "b", F.round("coherence", 6).alias("coherence"))


@plan("component_cosine", sql(f"""WITH RECURSIVE {STATES}, nr AS (SELECT node, sqrt(sum(v * v)) AS n FROM x1 GROUP BY node), pr AS (SELECT DISTINCT a.node AS x, b.node AS y FROM ly a JOIN ly b ON a.edge = b.edge), rc AS (SELECT x, y FROM pr UNION SELECT rc.x, pr.y FROM rc JOIN pr ON rc.y = pr.x),
d AS (SELECT rc.x, rc.y, coalesce(sum(u.v * w.v), 0) / any_value(na.n * nb.n) AS c FROM rc JOIN nr na ON na.node = rc.x JOIN nr nb ON nb.node = rc.y LEFT JOIN x1 u ON u.node = rc.x LEFT JOIN x1 w ON w.node = rc.y AND w.b = u.b WHERE rc.x < rc.y GROUP BY rc.x, rc.y)
SELECT round(avg(c), 6) AS mean, count(*) AS pairs FROM d""").replace("WITH ", "WITH RECURSIVE ", 1).replace(", RECURSIVE ", ", "))
def component_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = graph.components(layered(spark, sf_dir))
    return graph.within_component_cosine(parts, states(spark, sf_dir)).select(F.round("mean", 6).alias("mean"), "pairs")


@plan("graph_or_raw", sql(f"""WITH {STATES}, es AS (SELECT z.edge_id, x1.b, sum(x1.v) / any_value(z.n) AS v FROM (SELECT edge_id, node, count(*) OVER (PARTITION BY edge_id) AS n FROM en) z JOIN x1 ON x1.node = z.node GROUP BY z.edge_id, x1.b),
tv AS (SELECT m.edge_id, m.source_domain || '→' || m.target_domain AS t FROM m), rv AS ({grams('tv', 'edge_id', 't')}), qv AS ({grams('query_set', 'query_id', 'query_text')}),
c AS (SELECT 'graph' AS space, qv.query_id, es.edge_id, sum(qv.w * es.v) / any_value(nm.n) AS s FROM qv JOIN es ON es.b = qv.b JOIN (SELECT edge_id, sqrt(sum(v * v)) AS n FROM es GROUP BY edge_id) nm ON nm.edge_id = es.edge_id GROUP BY qv.query_id, es.edge_id
  UNION ALL SELECT 'raw', qv.query_id, rv.edge_id, sum(qv.w * rv.w) FROM qv JOIN rv ON rv.b = qv.b GROUP BY qv.query_id, rv.edge_id)
SELECT space, query_id::BIGINT AS query_id, edge_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY space, query_id ORDER BY round(s, 9) DESC, edge_id) AS r FROM c) x WHERE r <= 10"""))
def graph_or_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest mappings of each query in the graph's space and in the space of names."""
    from pyspark.sql import Window

    own = mappings(spark, sf_dir)
    q = search.embedded(queries(spark), "query_id", "query_text")
    e = graph.edge_states(states(spark, sf_dir), own)
    norm = e.groupBy("edge_id").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm"))
    in_graph = search.cosines(q, "query_id", e.join(norm, "edge_id").select("edge_id", F.col("dim").alias("bucket"), (F.col("val") / F.col("norm")).alias("weight")), "edge_id")
    raw = search.cosines(q, "query_id", search.embedded(own.select("edge_id", F.concat("source_domain", F.lit("→"), "target_domain").alias("t")), "edge_id", "t"), "edge_id")
    both = in_graph.withColumn("space", F.lit("graph")).union(raw.withColumn("space", F.lit("raw")))
    rank = F.row_number().over(Window.partitionBy("space", "query_id").orderBy(F.round("sem", 9).desc(), "edge_id"))
    return both.withColumn("rank", rank.cast("long")).where("rank <= 10").select("space", F.col("query_id").cast("long").alias("query_id"), "edge_id", "rank")


@plan("arc_weights", "SELECT a.o_orderkey, coalesce((SELECT sum(l_quantity) FROM lineitem WHERE l_orderkey = a.o_orderkey AND l_partkey = 1 + a.o_custkey % 50), 0)::DOUBLE AS weight FROM orders a")
def arc_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of arcs asked for, 0 where there is none: orders to parts."""
    asked = read(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_custkey") % 50).alias("part"))
    arcs = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("part")).agg(F.sum("l_quantity").alias("w"))
    return asked.join(arcs, ["o_orderkey", "part"], "left").select("o_orderkey", F.coalesce("w", F.lit(0.0)).alias("weight"))
