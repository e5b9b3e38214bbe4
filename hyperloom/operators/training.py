"""Training pairs of chunks and edges: what a chunk gave, and what it did not.

Negatives are drawn, not listed. The chunks of a group (a frame, say) lie on a ring by digest, cut into arcs of about ``ARC`` chunks and
numbered along each arc, so that no task holds a group. A draw names an arc and a number by its own digest and finds the chunk there by
an equal join, the one behind it if that is its own: no positive meets all edges of its frame, and all chunks are drawn alike. A draw whose
arc holds no other chunk gives none. Of a chunk with several edges of the group the one with the least digest is taken. Draws repeat
themselves from run to run and may take an edge twice, as draws with replacement do.

edges: edge_id, chunk_id, group. Rows with a null in any of them take no part; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARC = 1024
PER_POSITIVE = 3
FULL = 2.0**32


def digest(*parts: Column | str) -> Column:
    """A number below 2^32 that any engine gets from the same texts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def negatives(edges: DataFrame, per: int = PER_POSITIVE, seed: int = 42, arc: int = ARC) -> DataFrame:
    """positive, chunk_id, draw, edge_id: for each edge up to ``per`` edges of other chunks of its group."""
    rows = edges.select("edge_id", "chunk_id", "group").na.drop().distinct()
    ring = rows.select("group", "chunk_id").distinct().withColumn("place", digest("group", "chunk_id"))
    arcs = ring.groupBy("group").agg(F.ceil(F.count("*") / arc).alias("arcs"))
    cut = lambda df: df.join(arcs, "group").withColumn("arc", F.floor(F.col("place") * F.col("arcs") / FULL)).drop("arcs")
    up = Window.partitionBy("group", "arc").orderBy("place", "chunk_id")
    ring = cut(ring).withColumn("nth", F.row_number().over(up)).withColumn("after", F.lead("chunk_id").over(up))
    sizes = ring.groupBy("group", "arc").agg(F.count("*").alias("size"), F.max(F.when(F.col("nth") == 1, F.col("chunk_id"))).alias("first"))
    draws = rows.select("group", F.col("edge_id").alias("positive"), F.col("chunk_id").alias("own"), F.explode(F.sequence(F.lit(1), F.lit(per))).alias("draw"))
    mark = lambda what: digest(F.lit(f"{seed}{what}"), "positive", F.col("draw").cast("string"))
    draws = cut(draws.withColumn("place", mark(""))).join(sizes, ["group", "arc"]).withColumn("nth", (1 + mark("n") % F.col("size")).cast("int"))
    met = draws.join(ring.select("group", "arc", "nth", "chunk_id", "after"), ["group", "arc", "nth"])
    other = F.when(F.col("chunk_id") != F.col("own"), F.col("chunk_id")).otherwise(F.coalesce("after", "first"))
    taken = met.select("group", "positive", "own", "draw", other.alias("chunk_id")).where(F.col("chunk_id") != F.col("own"))
    least = digest(F.lit(str(seed)), "positive", F.col("draw").cast("string"), "edge_id")
    found = taken.join(rows, ["group", "chunk_id"]).groupBy("positive", "own", "draw").agg(F.min_by("edge_id", F.struct(least, "edge_id")).alias("edge_id"))
    return found.select("positive", F.col("own").alias("chunk_id"), "draw", "edge_id")


def chunk_pairs(edges: DataFrame, per: int = PER_POSITIVE, seed: int = 42, arc: int = ARC) -> DataFrame:
    """chunk_id, edge_id, label, origin: every edge with its chunk (1, produced) and the draws (0, drawn)."""
    good = edges.select("chunk_id", "edge_id", F.lit(1).alias("label"), F.lit("produced").alias("origin")).na.drop().distinct()
    bad = negatives(edges, per, seed, arc).select("chunk_id", "edge_id", F.lit(0).alias("label"), F.lit("drawn").alias("origin"))
    return good.unionByName(bad)


def weak_pairs(edges: DataFrame, rejected: DataFrame, per: int = PER_POSITIVE, seed: int = 42, arc: int = ARC) -> DataFrame:
    """As ``chunk_pairs``, but what a judge rejected in a chunk comes first as its negatives (origin rejected); draws only fill up.

    rejected: chunk_id, source_domain, target_domain. A chunk of n edges gets ``per`` times n negatives in all: of its rejections those with the least digests,
    under the id ``REF_`` and a digest of chunk and domains, then draws in order of edge and draw. Rejections in chunks without an edge say nothing.
    """
    pairs = chunk_pairs(edges, per, seed, arc)
    room = pairs.where("label = 1").groupBy("chunk_id").agg((F.count("*") * per).alias("room"))
    no = rejected.select("chunk_id", "source_domain", "target_domain").na.drop().distinct().join(room, "chunk_id")
    own = F.concat(F.lit("REF_"), F.substring(F.md5(F.concat_ws("|", "chunk_id", "source_domain", "target_domain")), 1, 8))
    order = Window.partitionBy("chunk_id").orderBy(digest(F.lit(str(seed)), "chunk_id", "source_domain", "target_domain"), "source_domain", "target_domain")
    no = no.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= F.col("room"))
    used = no.groupBy("chunk_id").agg(F.count("*").alias("used"))
    drawn = negatives(edges, per, seed, arc).join(room, "chunk_id").join(used, "chunk_id", "left")
    drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("chunk_id").orderBy("positive", "draw"))).where(F.col("nth") <= F.col("room") - F.coalesce("used", F.lit(0)))
    told = no.select("chunk_id", own.alias("edge_id"), F.lit(0).alias("label"), F.lit("rejected").alias("origin"))
    return pairs.where("label = 1").unionByName(told).unionByName(drawn.select("chunk_id", "edge_id", F.lit(0).alias("label"), F.lit("drawn").alias("origin")))


def chain_pairs(edges: DataFrame, gap: int = 3) -> DataFrame:
    """a, b, gap of every ordered pair of edges of one document, frame and source domain that lie nearer than ``gap`` chunks and share ground.

    edges: edge_id, doc_id, chunk_no, frame_id, source_domain, ground. Each edge meets only the chunks beside it, whatever its frame holds. Labels made of these
    pairs are given away by the features same_frame and ground, so they serve for comparison only.
    """
    cols = ["doc_id", "frame_id", "source_domain"]
    one = edges.select(*cols, F.col("edge_id").alias("a"), F.col("chunk_no").alias("at"), F.col("ground").alias("ground_a"))
    two = edges.select(*cols, F.col("edge_id").alias("b"), F.col("ground").alias("ground_b"), "chunk_no", F.explode(F.sequence(F.lit(1 - gap), F.lit(gap - 1))).alias("off"))
    two = two.withColumn("at", F.col("chunk_no") + F.col("off"))
    met = one.join(two, [*cols, "at"]).where((F.col("a") != F.col("b")) & F.arrays_overlap("ground_a", "ground_b"))
    return met.groupBy("a", "b").agg(F.min(F.abs("off")).alias("gap"))
