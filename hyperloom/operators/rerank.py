"""Reranking of a pool of candidates: topology against a query's graph, and scores relative to peers.

A pool is the first ``MOST`` candidates of a query, which is part of what the operators
mean; no step sees more than a pool in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyperloom.functions.text import cosine

# Fixed values of the scoring.
MOST = 300
SEMANTIC = 0.48
TEMPERATURE = 0.35
REVERSE = 0.25
LEAST_FLOW = 0.015
MOST_EDGES = 96
NODE_ONLY = 0.2
WIDTHS = {"pure": 0.04, "closure": 0.1, "direct": 0.12}
OTHER_ROLE = 0.35
LEAST_WEIGHT = 1e-4
LEAST_PEERS = 3
EFFECTIVE = 2.5
BONUS_CAP = 0.08
ROLE_CAPS = {"atomic_concept": (0.08, 1.0), "direct_answer": (0.02, 0.35), "structural_explanation": (0.045, 0.7), "thematic_neighbor": (0.008, 0.15)}
INNOVATION = 0.5
ANCHOR_FLOOR, ANCHOR_Z, ANCHOR_FULL, ANCHOR_CAP = 0.05, 2.0, 0.2, 0.1


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def align(nodes: DataFrame, tags: DataFrame, pool: DataFrame, threshold: float = SEMANTIC, few: bool = False) -> DataFrame:
    """Each query node's best tag in each candidate of its query's pool: the same id, else the most similar vector above the threshold.

    ``nodes``: query, node, weight, hop, vector. ``tags``: candidate, tag, position, closure,
    vector. ``pool``: query, candidate. A vector belongs to the id of its node or tag, so
    each pair of ids that meets is compared once. Ties go to the earlier position. ``few``: the
    caller knows that the ids are few, so their alike pairs are broadcast and what meets is not shuffled by them.
    """
    # a query's nodes go to its candidates in one row each, so the pool is shuffled once and not once a node
    packed = nodes.groupBy("query").agg(F.collect_list("node").alias("nodes"))
    met = packed.join(pool, "query").join(tags.drop("vector"), "candidate").withColumn("node", F.explode("nodes")).drop("nodes").withColumn("exact", F.col("node") == F.col("tag"))
    own, theirs = nodes.groupBy("node").agg(F.first("vector").alias("own")), tags.groupBy("tag").agg(F.first("vector").alias("theirs"))
    pairs = met.where("not exact").select("node", "tag").distinct().join(own, "node").join(theirs, "tag")
    alike = pairs.select("node", "tag", unit(cosine(F.col("own"), F.col("theirs"))).alias("s")).where(F.col("s") >= threshold)
    met = met.join(F.broadcast(alike) if few else alike, ["node", "tag"], "left").where("exact or s is not null").withColumn("s", F.when(F.col("exact"), 1.0).otherwise(F.col("s")))
    near = unit((F.col("s") - threshold) / (1 - threshold))
    met = met.withColumn("quality", F.when(F.col("exact"), F.sqrt("closure")).otherwise(F.sqrt(near * F.col("closure"))))
    best = F.max_by(F.struct("position", "quality", "closure"), F.struct("exact", "quality", -F.col("position")))
    return met.groupBy("query", "candidate", "node").agg(best.alias("b")).select("query", "candidate", "node", "b.*")


def topology(nodes: DataFrame, edges: DataFrame, tags: DataFrame, pool: DataFrame, provenance: DataFrame | None = None, few: bool = False) -> DataFrame:
    """query, candidate, counts, coverages and scores of a candidate's tags against the query's nodes and edges.

    ``edges``: query, source, target, flow, ord. ``provenance``: source, target, candidate,
    amount, which lessens an edge by the share the candidate itself contributed to it. ``few``: as in ``align``.
    """
    aligned = align(nodes, tags, pool, few=few)
    per_query = nodes.groupBy("query").agg(F.sum("weight").alias("all_weight"), F.greatest(F.max("hop"), F.lit(1)).alias("far"))
    node_part = (
        aligned.join(nodes.select("query", "node", "weight"), ["query", "node"])
        .groupBy("query", "candidate")
        .agg(F.count("*").alias("matched_nodes"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("quality")).alias("q"), F.avg("closure").alias("closure"))
        .join(per_query, "query")
        .select("query", "candidate", "matched_nodes", "closure", unit(F.col("w") / F.col("all_weight")).alias("node_coverage"), unit(F.col("q") / F.col("w")).alias("alignment"))
    )
    kept = edges.where(F.col("flow") >= LEAST_FLOW).withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy("ord"))).where(F.col("rn") <= MOST_EDGES)
    flows = kept.groupBy("query").agg(F.sum("flow").alias("all_flow"))
    spans = tags.groupBy("candidate").agg(F.greatest(F.max("position") - F.min("position"), F.lit(1)).alias("span"))

    def end(which: str) -> DataFrame:
        hops = nodes.select("query", "node", "hop")
        return aligned.join(hops, ["query", "node"]).select("query", "candidate", F.col("node").alias(which), F.struct("position", "quality", "hop").alias(which[0]))

    met = kept.join(end("source"), ["query", "source"]).join(end("target"), ["query", "candidate", "target"]).where("s.position <> t.position")
    met = met.join(spans, "candidate").join(per_query, "query")
    met = met.withColumn("free", F.lit(1.0)) if provenance is None else _independent(met, provenance)
    apart = F.greatest(F.abs(F.col("t.hop") - F.col("s.hop")), F.lit(1)) / F.col("far")
    along = F.abs(F.col("t.position") - F.col("s.position")) / F.col("span")
    met = met.withColumn("distance", F.exp(-F.abs(apart - along) / TEMPERATURE)).withColumn("way", F.when(F.col("t.position") > F.col("s.position"), 1.0).otherwise(REVERSE))
    met = met.withColumn("shape", unit(F.sqrt(F.col("s.quality") * F.col("t.quality")) * F.col("distance") * F.col("way") * F.col("free")))
    mass = [F.sum(F.col("flow") * F.col(c)).alias(c) for c in ("distance", "way", "shape")]
    edge_part = met.groupBy("query", "candidate").agg(F.count("*").alias("matched_edges"), F.sum("flow").alias("f"), *mass).join(flows, "query")
    edge_part = edge_part.select("query", "candidate", "matched_edges", unit(F.col("f") / F.col("all_flow")).alias("edge_coverage"), *[unit(F.col(c) / F.col("f")).alias(c) for c in ("distance", "way", "shape")])
    out = pool.join(node_part, ["query", "candidate"], "left").join(edge_part, ["query", "candidate"], "left").na.fill(0)
    by_edges = 0.18 * F.col("alignment") + 0.22 * F.col("distance") + 0.18 * F.col("way") + 0.42 * F.col("shape")
    three = F.cbrt(F.col("node_coverage") * F.col("edge_coverage") * F.col("closure"))
    two = F.least(F.lit(NODE_ONLY), F.sqrt(F.col("node_coverage") * F.col("closure")))
    some, nodes_only = F.col("matched_edges") > 0, F.col("matched_nodes") > 0
    return out.select(
        "*",
        F.when(some, unit(by_edges)).when(nodes_only, unit(F.sqrt(F.col("alignment") * F.col("closure")))).otherwise(0.0).alias("score"),
        F.when(some, unit(three)).when(nodes_only, unit(two)).otherwise(0.0).alias("reliability"),
    )


def _independent(met: DataFrame, provenance: DataFrame) -> DataFrame:
    """Adds ``free``: the share of an edge that others than the candidate contributed, 0.15 at least."""
    whole = provenance.groupBy("source", "target").agg(F.sum("amount").alias("whole"))
    own = provenance.groupBy("source", "target", "candidate").agg(F.sum("amount").alias("part"))
    met = met.join(whole, ["source", "target"], "left").join(own, ["source", "target", "candidate"], "left")
    share = F.greatest(unit(1 - F.coalesce(F.col("part"), F.lit(0.0)) / F.col("whole")), F.lit(0.15))
    return met.withColumn("free", F.when(F.col("whole") > 0, share).otherwise(1.0)).drop("whole", "part")


def expectation(candidates: DataFrame) -> DataFrame:
    """What a candidate's graph score should be, judged by its peers: query, ord and all columns, expected, uncertainty, effective.

    ``candidates``: query, ord, pure, closure, direct, graph, role. Only the first ``MOST`` of
    a query take part. Peers that weigh too little count only where fewer than
    ``LEAST_PEERS`` weigh enough; the first of them by ord then do, at the least weight.
    """
    top = candidates.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy("ord"))).where(F.col("rn") <= MOST)
    a = top.select("query", "ord", "pure", "closure", "direct", "graph", "role").alias("a")
    b = top.select("query", "ord", "rn", "pure", "closure", "direct", "graph", "role").alias("b")
    met = a.join(b, (F.col("a.query") == F.col("b.query")) & (F.col("a.ord") != F.col("b.ord")), "left")
    apart = sum(((F.col(f"b.{c}") - F.col(f"a.{c}")) / w) * ((F.col(f"b.{c}") - F.col(f"a.{c}")) / w) for c, w in WIDTHS.items())
    weight = F.when(F.col("a.role") == F.col("b.role"), 1.0).otherwise(OTHER_ROLE) * F.exp(-0.5 * apart)
    # scores are taken from the candidate's own, so that their squares do not cancel
    met = met.select("a.query", "a.ord", F.col("a.graph").alias("own"), "b.rn", weight.alias("w"), (F.col("b.graph") - F.col("a.graph")).alias("g"))
    near, w, g = F.col("w") >= LEAST_WEIGHT, F.col("w"), F.col("g")
    sums = {"n": F.when(near, 1).otherwise(0), "w": F.when(near, w).otherwise(0.0), "w2": F.when(near, w * w).otherwise(0.0), "wg": F.when(near, w * g).otherwise(0.0), "wg2": F.when(near, w * g * g).otherwise(0.0)}
    # with too few near peers, the first far ones are among the pool's first rows but for those near and itself
    firsts = [F.max(F.when((F.col("rn") == i) & ~near, g)).alias(f"far{i}") for i in range(1, 2 * LEAST_PEERS + 1)]
    got = met.groupBy("query", "ord").agg(F.first("own").alias("own"), *[F.sum(c).alias(k) for k, c in sums.items()], *firsts)
    far = F.array_compact(F.array(*[f"far{i}" for i in range(1, 2 * LEAST_PEERS + 1)]))
    got = got.withColumn("rest", F.slice(far, F.lit(1), F.greatest(LEAST_PEERS - F.col("n"), F.lit(0)).cast("int")))
    k = F.size("rest") * LEAST_WEIGHT
    more = lambda f: F.aggregate("rest", F.lit(0.0), lambda x, y: x + f(y)) * LEAST_WEIGHT
    got = got.select("query", "ord", "own", (w + k).alias("w"), (F.col("w2") + k * LEAST_WEIGHT).alias("w2"), (F.col("wg") + more(lambda y: y)).alias("wg"), (F.col("wg2") + more(lambda y: y * y)).alias("wg2"))
    some, off = w > 0, F.col("wg") / F.col("w")
    effective = F.when(F.col("w2") > 1e-12, w * w / F.col("w2")).otherwise(0.0)
    spread = F.when(some, F.greatest(F.col("wg2") / w - off * off, F.lit(0.0))).otherwise(0.0)
    found = got.select("query", "ord", F.when(some, F.col("own") + off).otherwise(F.col("own")).alias("expected"), F.sqrt(spread * (1 + 1 / F.greatest(effective, F.lit(1.0)))).alias("uncertainty"), effective.alias("effective"))
    return top.drop("rn").join(found, ["query", "ord"])


def final_scores(candidates: DataFrame, omega: Column | float = 1.0) -> DataFrame:
    """Adds bonus, anchor_bonus and final to ``candidates``, which also hold confidence and anchor.

    A candidate's bonus is its innovation over its peers, capped by its role and, unless it
    answers directly, kept below the best direct answer; ``omega`` gates it.
    """
    c = expectation(candidates)
    whole = Window.partitionBy("query")
    c = c.withColumn("front", F.max(F.when(F.col("role") == "direct_answer", F.col("pure"))).over(whole))
    c = c.withColumn("bar", F.greatest(F.lit(ANCHOR_FLOOR), F.least(F.lit(1.0), F.avg("anchor").over(whole) + ANCHOR_Z * F.stddev_pop("anchor").over(whole))))
    news = F.greatest(F.col("graph") - F.col("expected") - F.col("uncertainty"), F.lit(0.0))
    part = lambda i: F.coalesce(*[F.when(F.col("role") == r, F.lit(v[i])) for r, v in ROLE_CAPS.items()])
    asked = news * unit(F.col("confidence") * unit(F.col("effective") / EFFECTIVE)) * INNOVATION * part(1)
    bonus = F.least(asked, part(0), F.lit(BONUS_CAP))
    below = F.greatest(F.col("front") - 0.005 - F.col("pure"), F.lit(0.0))
    held = (F.col("front") > 0) & ~F.col("role").isin("direct_answer", "atomic_concept")
    c = c.withColumn("bonus", unit(F.when(held, F.least(bonus, below)).otherwise(bonus)))
    t = unit((F.col("anchor") - F.col("bar")) / (ANCHOR_FULL - F.col("bar")))
    rise = F.when(F.col("anchor") <= F.col("bar"), 0.0).when(ANCHOR_FULL - F.col("bar") > 1e-12, t * t * (3 - 2 * t)).otherwise(1.0)
    c = c.withColumn("anchor_bonus", ANCHOR_CAP * rise)
    gate = omega if isinstance(omega, Column) else F.lit(float(omega))
    return c.withColumn("final", unit(F.col("pure") + F.col("bonus") * gate + F.col("anchor_bonus"))).drop("front", "bar")
