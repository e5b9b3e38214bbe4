"""Hypergraph operators over an incidence table (edge, node): propagation, reach and components by loops of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def propagate(incidence: DataFrame, features: DataFrame, layers: int = 1, alpha: float = 0.5, leak: float = 0.0) -> DataFrame:
    """node, dim, val: means over an edge's members, then over a node's edges, with a residual; driven by the start if alpha < 1.

    One layer is two joins and two averages by key; both aggregate partially, so a node of very many edges is no hot spot.
    """
    start, x = features, features
    for _ in range(layers):
        by_edge = incidence.join(x, "node").groupBy("edge", "dim").agg(F.avg("val").alias("val"))
        spread = incidence.join(by_edge, "edge").groupBy("node", "dim").agg(F.avg("val").alias("got"))
        moved = x.join(spread, ["node", "dim"], "left").select("node", "dim", (0.5 * (F.col("val") + (1 - leak) * F.coalesce("got", F.lit(0.0)))).alias("val"))
        x = moved.join(start.withColumnRenamed("val", "was"), ["node", "dim"]).select("node", "dim", ((1 - alpha) * F.col("was") + alpha * F.col("val")).alias("val"))
    return x


def hops(incidence: DataFrame, source: int, most: int = 3) -> DataFrame:
    """node, hop: distance in shared edges from a node, up to ``most``."""
    reached = incidence.sparkSession.createDataFrame([(source, 0)], "node long, hop int")
    edge = front = None
    for hop in range(1, most + 1):
        front = reached.where(F.col("hop") == hop - 1)
        edge = incidence.join(front.select("node"), "node", "left_semi").select("edge").distinct()
        new = incidence.join(edge, "edge", "left_semi").select(F.col("node").cast("long")).distinct().join(reached, "node", "left_anti")
        reached = reached.union(new.withColumn("hop", F.lit(hop)))
    return reached


def components_of(pairs: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the graph whose edges are the columns a and b; loops name lone nodes.

    Alternating large and small stars until nothing changes, a logarithmic number of rounds whatever the graph's width. Minima are
    aggregated partially and cut off their aggregation, so that adaptive execution can split a node of very many edges in the joins.
    """
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    links = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        both = links.union(links.select("v", "u"))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        links = cut(small.where("u <> v").distinct())
        state = links.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if state == last:
            break
        last = state
    low = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(low, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def components(incidence: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable over shared edges, exact for a graph of any width."""
    hubs = incidence.groupBy("edge").agg(F.min("node").alias("b"))
    return components_of(incidence.join(hubs, "edge").select(F.col("node").alias("a"), "b"))


def layered(edges: DataFrame, members: DataFrame, cross: bool = True) -> DataFrame:
    """family, edge, node, of three kinds of hyperedges: a mapping's domains and grounds; a frame and the entities of its mappings; a cascade and its frames.

    ``cross`` False leaves out the two that lead across layers. Members repeat as an edge repeats them.
    """
    entities = F.concat(F.array("source_domain", "target_domain"), "ground")
    first = edges.select(F.lit("mapping").alias("family"), F.col("edge_id").alias("edge"), F.explode(entities).alias("node"))
    if not cross:
        return first
    own = edges.where("frame_id is not null").select("frame_id", F.explode(entities).alias("node")).distinct()
    frames = own.select(F.lit("frame").alias("family"), F.concat(F.lit("frame:"), "frame_id").alias("edge"), "node").union(own.select(F.lit("frame"), F.concat(F.lit("frame:"), "frame_id"), "frame_id").distinct())
    used = members.join(own.select("frame_id").distinct(), "frame_id")
    cascades = used.select(F.lit("cascade"), F.concat(F.lit("cascade:"), "cascade_id"), F.col("frame_id")).union(used.select(F.lit("cascade"), F.concat(F.lit("cascade:"), "cascade_id"), "cascade_id").distinct())
    return first.union(frames).union(cascades)


def operator(incidence: DataFrame, leak: float = 0.0) -> DataFrame:
    """row, col, val: the entries of 0.5 (I + (1 - leak) Dv^-1 H De^-1 H^T) over distinct members that are not 0.

    An edge of n members gives n squared entries, as the matrix does: for edges of bounded arity. Use ``propagate`` to apply it.
    """
    h = incidence.select("edge", "node").distinct()
    de, dv = h.groupBy("edge").agg(F.count("*").alias("de")), h.groupBy("node").agg(F.count("*").alias("dv"))
    a = h.join(de, "edge").select("edge", F.col("node").alias("row"), "de").join(dv.withColumnRenamed("node", "row"), "row")
    s = a.join(h.withColumnRenamed("node", "col"), "edge").groupBy("row", "col").agg(F.sum((1 - leak) / (F.col("dv") * F.col("de"))).alias("s"))
    return s.select("row", "col", (0.5 * (F.col("s") + F.when(F.col("row") == F.col("col"), 1.0).otherwise(0.0))).alias("val"))


def reachable(edges: DataFrame) -> DataFrame:
    """start, edge_id, concept: from each entity or trigger the mappings of its component, with their two domains.

    The index is kept as start to component and component to mapping, and joined for the starts asked; it is never written out for all.
    """
    entities = F.concat(F.array("source_domain", "target_domain"), "ground")
    touch = edges.select("edge_id", F.explode(entities).alias("node")).distinct()
    part = components_of(touch.select(F.concat(F.lit("n:"), "node").alias("a"), F.concat(F.lit("e:"), "edge_id").alias("b")))
    own = part.where(F.col("node").startswith("e:")).select(F.substring("node", 3, 1 << 30).alias("edge_id"), "component")
    starts = part.where(F.col("node").startswith("n:")).select(F.substring("node", 3, 1 << 30).alias("start"), "component")
    by_trigger = edges.select("edge_id", F.explode("triggers").alias("start")).distinct().join(own, "edge_id").select("start", "component")
    concepts = edges.select("edge_id", F.explode(F.array("source_domain", "target_domain")).alias("concept")).join(own, "edge_id").select("component", "edge_id", "concept")
    return starts.union(by_trigger).distinct().join(concepts, "component").select("start", "edge_id", "concept").distinct()


def within_component_cosine(parts: DataFrame, vectors: DataFrame) -> DataFrame:
    """mean, pairs: the mean cosine of all pairs of nodes of one component. parts: node, component; vectors: node, dim, val.

    The cosines of all pairs sum to half of what the squared sum of the unit vectors exceeds their number, so no pair is formed. Null vectors take no part.
    """
    norms = vectors.groupBy("node").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm")).where("norm >= 1e-9")
    unit = vectors.join(norms, "node").join(parts, "node").select("component", "node", "dim", (F.col("val") / F.col("norm")).alias("u"))
    sums = unit.groupBy("component", "dim").agg(F.sum("u").alias("s")).groupBy("component").agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    sizes = unit.groupBy("component").agg(F.count_distinct("node").alias("n"))
    both = sums.join(sizes, "component").select(((F.col("q") - F.col("n")) / 2).alias("cos"), (F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    total = F.sum("pairs")
    return both.agg((F.sum("cos") / F.when(total > 0, total)).alias("mean"), total.cast("long").alias("pairs"))


def coherence(states: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, coherence: the cosine of two nodes' states; 0 if either has none or is null. states: node, dim, val."""
    norms = states.groupBy("node").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm"))
    at = lambda side, v: states.select(F.col("node").alias(side), "dim", F.col("val").alias(v)).join(norms.select(F.col("node").alias(side), F.col("norm").alias(f"norm_{side}")), side)
    met = pairs.join(at("a", "x"), "a").join(at("b", "y"), ["b", "dim"])
    dots = met.groupBy("a", "b").agg((F.sum(F.col("x") * F.col("y")) / (F.first("norm_a") * F.first("norm_b"))).alias("c"), F.least(F.first("norm_a"), F.first("norm_b")).alias("least"))
    return pairs.join(dots, ["a", "b"], "left").select("a", "b", F.when(F.col("least") >= 1e-9, F.col("c")).otherwise(0.0).alias("coherence"))


def edge_states(states: DataFrame, edges: DataFrame) -> DataFrame:
    """edge_id, dim, val: the mean state of a mapping's members, repeated ones counted as often."""
    entities = F.concat(F.array("source_domain", "target_domain"), "ground")
    touch = edges.select("edge_id", F.explode(entities).alias("node"))
    size = touch.groupBy("edge_id").agg(F.count("*").alias("n"))
    return touch.join(states, "node").groupBy("edge_id", "dim").agg(F.sum("val").alias("s")).join(size, "edge_id").select("edge_id", "dim", (F.col("s") / F.col("n")).alias("val"))


def comembers(incidence: DataFrame, parts: int) -> DataFrame:
    """node, n_others: how many other nodes share an edge with each node that has any (incidence: edge, node; rows may repeat).

    Edges, then pairs of nodes, are dealt to ``parts`` tasks; let them grow with the rows, and no task's memory does.
    """
    inc = incidence.repartition(parts, "edge").distinct()
    met = inc.join(inc.withColumnRenamed("node", "other"), "edge").where("node <> other").select("node", "other")
    return met.repartition(parts, "node", "other").distinct().groupBy("node").agg(F.count("*").alias("n_others"))
