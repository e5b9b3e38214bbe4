"""Tag curves of candidates, and how well a query's seeds are anchored in them over stored arcs.

A curve is the tags of a candidate's file, each with how close the candidate's vector is to it. It stays rows, one per
(candidate, tag): chunk, position, tag, closure. A seed of a query touches a candidate by a tag of its own id, else by the tag most similar
to it from a threshold on. What a touch is worth is the product of the seed's mass, the tag's specificity (how little flows
into it over the stored arcs), its closure and the seed's rarity in the pool; touches add up as noisy-or, summed as logarithms.

Tables: pool: query, candidate. curves: candidate, file, tag, position, closure. seeds: query, seed, mass (bounded by what a query says,
so that seeds of all queries meet each tag once per pair of ids, not once per candidate). vectors: id, vector. inbound: tag, flow.
Nulls: rows without an id are left out; null masses and flows count 0; a vector that is null, of another length or zero is similar to nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyperloom.functions.text import cosine

from .vectors import BLOCK, likely

# Fixed values of the scoring.
THRESHOLD, DISCOUNT = 0.8, 0.7
SPECIFICITY_FLOOR, RARITY_FLOOR = 0.35, 0.15
SATURATION, FALLBACK_CAP = 2.0, 0.5
#: Vectors of a block where each vector goes to many blocks.
WIDE = 16_384


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))


def curves(candidates: DataFrame, chunks: DataFrame, file_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """candidate, file, tag, position, closure: candidates (candidate) with the tags of their file, each pair of a file and a tag once a row of ``file_tags``.

    chunks: candidate, file, vector. file_tags: file, tag, position (null: 0). tags: tag, vector. Candidates without a chunk or with a null vector have no curve,
    tags without a vector no place on one.
    """
    mine = candidates.select("candidate").where("candidate is not null").distinct().join(chunks.where("vector is not null"), "candidate").withColumnRenamed("vector", "own")
    marks = file_tags.select("file", "tag", F.coalesce("position", F.lit(0)).alias("position"))
    both = mine.join(marks, "file").join(tags.where("vector is not null").select("tag", F.col("vector").alias("theirs")), "tag")
    return both.select("candidate", "file", "tag", "position", unit(cosine(F.col("theirs"), F.col("own"))).alias("closure"))


def local_scores(pool: DataFrame, rows: DataFrame, domain: DataFrame) -> DataFrame:
    """query, candidate, anchor: tags of the query's local domain (query, tag) on the candidate's curve, over the most that any of the pool has; a score the pool brings (``anchor``) is kept if higher."""
    own = pool if "anchor" in pool.columns else pool.withColumn("anchor", F.lit(0.0))
    near = domain.select("query", "tag").distinct()
    hits = pool.select("query", "candidate").join(rows.select("candidate", "tag"), "candidate").join(near, ["query", "tag"]).groupBy("query", "candidate").agg(F.count("*").alias("hits"))
    most = hits.groupBy("query").agg(F.max("hits").alias("most"))
    out = own.join(hits, ["query", "candidate"], "left").join(most, "query", "left")
    return out.select("query", "candidate", F.greatest(F.coalesce("anchor", F.lit(0.0)), F.coalesce(F.col("hits") / F.col("most"), F.lit(0.0))).alias("anchor"))


def inbound(arcs: DataFrame) -> DataFrame:
    """tag, flow: what flows into each node over stored arcs (source, target, weight)."""
    return arcs.where("target is not null").groupBy(F.col("target").alias("tag")).agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("flow"))


def contacts(pool: DataFrame, rows: DataFrame, seeds: DataFrame, vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """query, candidate, seed, tag, exact, closure, mass: the tag by which each seed touches each candidate.

    A tag of the seed's id wins over any similar one; of equally similar tags the later on the curve counts.
    """
    told = _told(seeds)
    links = links_of(told, rows.select("tag").distinct(), vectors, threshold)
    # the pool meets the curves first: what a query's seeds link to, of which its candidates hold little, is never set against the whole pool
    return _best(pool.select("query", "candidate").distinct().join(rows, "candidate").join(told.join(links, "seed"), ["query", "tag"]))


def _told(seeds: DataFrame) -> DataFrame:
    return seeds.where("seed is not null").groupBy("query", "seed").agg(F.max(F.coalesce("mass", F.lit(0.0))).alias("mass"))


def links_of(told: DataFrame, tags: DataFrame, vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """seed, tag, similarity, exact: each seed with itself and with the tags alike."""
    known = vectors.where("vector is not null").groupBy("id").agg(F.first("vector").alias("vector"))
    ids = told.select("seed").distinct()
    left = ids.join(known.select(F.col("id").alias("seed"), F.col("vector").alias("own")), "seed").select(F.col("seed").alias("a"), "own")
    right = tags.join(known.select(F.col("id").alias("tag"), F.col("vector").alias("theirs")), "tag").select(F.col("tag").alias("b"), "theirs")
    # a stated set of seeds against all tags: each pair of ids once in blocks, and only those alike are kept
    near = likely(left, right, least=threshold, block=block).select(F.col("a").alias("seed"), F.col("b").alias("tag"), cosine(F.col("own"), F.col("theirs")).alias("similarity"))
    alike = near.where(F.col("similarity") >= threshold)
    same = ids.select("seed", F.col("seed").alias("tag"), F.lit(1.0).alias("similarity"), F.lit(True).alias("exact"))
    return same.unionByName(alike.withColumn("exact", F.lit(False)))


def _best(met: DataFrame) -> DataFrame:
    # as a rule the first tag of the seed's own id counts, and the last of those equally similar
    order = F.struct("exact", F.when(F.col("exact"), -F.col("position")).otherwise(F.lit(0)).alias("early"), "similarity", "position", "tag")
    kept = ["tag", "exact", "closure", "mass", *(c for c in met.columns if c == "flow")]
    best = met.groupBy("query", "candidate", "seed").agg(F.max_by(F.struct(*kept), order).alias("b"))
    return best.select("query", "candidate", "seed", "b.*")


def closed(rows: DataFrame, vectors: DataFrame, side: int) -> DataFrame:
    """rows with closure: how close the vector of ``own`` is to that of ``tag``; rows of which one has no vector are left out.

    Rows go to one of ``side`` times ``side`` blocks by their two ids, and each vector to the ``side`` blocks of its id, so no row carries a vector.
    Sums run from the first number to the last, as in ``cosine``.
    """
    spark, kind = rows.sparkSession, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    names = rows.columns
    # a vector with a null in it is similar to nothing, as an empty one
    whole = F.when(F.exists("vector", lambda v: v.isNull()), F.array().cast(vectors.schema["vector"].dataType)).otherwise(F.col("vector"))
    known = vectors.where("id is not null and vector is not null").groupBy("id").agg(F.first("vector").alias("vector")).select("id", whole.alias("vector"))
    at = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(side)).cast("int")
    every = spark.range(side).select(F.col("id").cast("int").alias("other"))
    mine = known.crossJoin(F.broadcast(every)).select(at("id").alias("x"), F.col("other").alias("y"), F.lit(True).alias("first"), "id", "vector")
    theirs = known.crossJoin(F.broadcast(every)).select(F.col("other").alias("x"), at("id").alias("y"), F.lit(False).alias("first"), "id", "vector")

    def table(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        part = part.sort_values("id")
        sizes = part["vector"].map(len).to_numpy(dtype="int64")
        numbers = np.zeros((sizes.max(initial=0), len(part)))
        for n in set(sizes.tolist()) - {0}:
            here = np.flatnonzero(sizes == n)
            numbers[:n, here] = np.stack(part["vector"].iloc[here].tolist()).astype("float64").T
        square = np.zeros(len(part))
        for line in numbers:
            square = square + line * line
        return part["id"].to_numpy(), sizes, numbers, square

    def run(part: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        (a, an, av, aa), (b, bn, bv, bb) = table(held[held["first"]]), table(held[~held["first"]])
        part = part[part["own"].isin(a) & part["tag"].isin(b)].reset_index(drop=True)
        i, j = np.searchsorted(a, part["own"].to_numpy()), np.searchsorted(b, part["tag"].to_numpy())
        out = np.zeros(len(part))
        for lo in range(0, len(part), 65_536):
            u, v = i[lo : lo + 65_536], j[lo : lo + 65_536]
            dot = np.zeros(len(u))
            with np.errstate(all="ignore"):
                for k in range(min(len(av), len(bv))):
                    dot = dot + av[k][u] * bv[k][v]
                norm = np.sqrt(aa[u] * bb[v])
                c = np.where((an[u] != bn[v]) | (norm == 0), 0.0, dot / norm)
            out[lo : lo + 65_536] = np.where(np.isnan(c), 1.0, np.clip(c, 0.0, 1.0))  # as ``unit`` has it
        return part[names].assign(closure=out)

    dealt = rows.withColumn("x", at("own")).withColumn("y", at("tag"))
    return dealt.groupBy("x", "y").cogroup(mine.unionByName(theirs).groupBy("x", "y")).applyInPandas(run, f"{kind}, closure double")


def contacts_of_places(pool: DataFrame, places: DataFrame, seeds: DataFrame, vectors: DataFrame, flows: DataFrame, threshold: float, parts: int) -> DataFrame:
    """As ``contacts``, with the flow of the tag, of curves that have no closure yet: places (candidate, tag, position, own), where ``own`` is the id of the candidate's vector.

    pool: distinct pairs, best dealt by query into ``parts``. Ids are whole numbers.

    Closures are found for the tags that a query's seeds can link to, and no others. Pool and places meet by candidate, all that follows by query, each in ``parts`` tasks.
    Of a query's links the pool carries a mask of 64 bits; most places that no seed links to are dropped by it before anything is shuffled.
    """
    told = _told(seeds)
    every = vectors.where("id is not null and vector is not null").select(F.col("id").alias("tag")).distinct()
    near = links_of(told, every, vectors, threshold, WIDE).join(flows.select("tag", "flow"), "tag", "left")
    links = told.join(near, "seed").repartition(parts, "query")
    bit = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(64)).cast("int")
    masks = links.groupBy("query").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit("tag"))).alias("mask"))
    met = pool.select("query", "candidate").join(masks, "query").repartition(parts, "candidate").join(places, "candidate")
    met = met.where(F.call_function("getbit", F.col("mask"), bit("tag")) == 1).select("query", "candidate", "tag", "position", "own")
    side = max(-(-vectors.count() // WIDE), math.ceil(math.sqrt(parts / 6)))
    # dealt by query, so contacts, sums and the pool's size are found where the rows are
    rows = closed(met, vectors, side).drop("own").repartition(parts, "query").withColumnRenamed("query", "q").withColumnRenamed("tag", "t")
    # a join by both columns would deal the rows anew, so the tag is left to a condition that is no key
    return _best(rows.join(links, (F.col("q") == F.col("query")) & (F.col("t") - F.col("tag") == 0)).drop("q", "t"))


def anchored(pool: DataFrame, rows: DataFrame, seeds: DataFrame, vectors: DataFrame, flows: DataFrame, most_flow: float | None = None, fallback: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """query, candidate, score, reliability, strength, contacted, exact, semantic, closure of every candidate of every pool.

    flows: tag, flow (see ``inbound``); ``most_flow``: the greatest flow, taken from the table if not given.
    """
    pool = pool.select("query", "candidate").distinct()
    return scored(pool, contacts(pool, rows, seeds, vectors, threshold), seeds, flows, most_flow, fallback)


def scored(pool: DataFrame, met: DataFrame, seeds: DataFrame, flows: DataFrame, most_flow: float | None = None, fallback: bool = False) -> DataFrame:
    """What ``anchored`` gives, of a pool of distinct pairs and its contacts."""
    sizes = pool.groupBy("query").agg(F.count("*").alias("size"))
    heaviest = seeds.groupBy("query").agg(F.max(F.greatest(F.coalesce("mass", F.lit(0.0)), F.lit(0.0))).alias("heaviest"))
    top = flows.agg(F.coalesce(F.max("flow"), F.lit(0.0)).alias("top")) if most_flow is None else flows.sparkSession.range(1).select(F.lit(most_flow).alias("top"))
    met = met if "flow" in met.columns else met.join(flows.select("tag", "flow"), "tag", "left")
    touched = F.count("*").over(Window.partitionBy("query", "seed"))
    full = met.withColumn("touched", touched).join(sizes, "query").join(heaviest, "query").join(F.broadcast(top))  # one row
    share = unit(F.coalesce("flow", F.lit(0.0)) / F.col("top"))
    specificity = F.when(F.col("top") > 0, F.greatest(F.lit(SPECIFICITY_FLOOR), 1 - F.sqrt(share))).otherwise(1.0)
    rarity = F.greatest(F.lit(RARITY_FLOOR), 1 - F.col("touched") / F.col("size"))
    mass = F.when(F.col("heaviest") > 0, unit(F.col("mass") / F.col("heaviest"))).otherwise(0.0)
    worth = unit(mass * specificity * F.col("closure") * rarity * F.when(F.col("exact"), 1.0).otherwise(DISCOUNT))
    # the pool's pairs go along as rows without a contact, so contacts that lie by query are summed where they are
    rows = full.select("query", "candidate", worth.alias("worth"), "exact", "closure", F.lit(1).alias("contact")).unionByName(pool.select("query", "candidate", F.lit(None).cast("double").alias("worth"), F.lit(None).cast("boolean").alias("exact"), F.lit(None).cast("double").alias("closure"), F.lit(None).cast("int").alias("contact")))
    out = rows.groupBy("query", "candidate").agg(
        F.sum(F.when(F.col("worth") < 1, F.log1p(-F.col("worth")))).alias("logs"), F.max("worth").alias("most"), F.count("contact").alias("contacted"), F.count_if("exact").alias("exact"), F.avg("closure").alias("closure"),
    )
    score = F.when(F.col("most") >= 1, 1.0).otherwise(unit(-F.expm1(F.col("logs"))))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = out.select("query", "candidate", F.coalesce(score, F.lit(0.0)).alias("score"), count("contacted").alias("contacted"), count("exact").alias("exact"), F.coalesce("closure", F.lit(0.0)).alias("closure"))
    trust = unit(F.sqrt(F.col("closure") * F.least(F.col("contacted") / SATURATION, F.lit(1.0))))
    trust = F.least(trust, F.lit(FALLBACK_CAP)) if fallback else trust
    out = out.withColumn("reliability", trust).withColumn("strength", unit(F.col("score") * F.col("reliability"))).withColumn("semantic", F.col("contacted") - F.col("exact"))
    return out.select("query", "candidate", "score", "reliability", "strength", "contacted", "exact", "semantic", "closure")

