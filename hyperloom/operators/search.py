"""Query sets, features of a query and an edge, scoring arms, pathways without triggers, and how chains compare with a gold set.

Edges are the table of ``build``; one edge stands for its first chunk. Scores of features repeat for edges of one frame with the
same triggers, so comparisons of edges with edges run over such kinds, whose number the ontology bounds, not over edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyperloom.functions import text as fx

from . import vectors

#: Learned shares of the seven features, and the four older weights by hand.
LEARNED = {"sem": 0.6911, "struct": 0.0195, "clue": 1.2543, "type": 0.0487, "same_frame": 0.1953, "same_cascade": 0.1958, "ground": 0.4965}
LEGACY = {"sem": 0.35, "struct": 0.25, "clue": 0.20, "type": 0.20}
HAND = {k: v / sum(LEARNED.values()) for k, v in LEARNED.items()}
FEATURES = list(LEARNED)


def described(source: Column, target: Column, ground: Column, triggers: Column) -> Column:
    """A mapping in words, for vectors and contexts; the wording is fixed, as vectors depend on it."""
    grounds = F.when(F.size(ground) > 0, F.array_join(ground, "、")).otherwise("（未抽取到喻底）")
    words = F.when(F.size(triggers) > 0, F.array_join(F.slice(triggers, 1, 5), "、")).otherwise("（无）")
    return F.concat(source, F.lit("→"), target, F.lit("：把"), target, F.lit("比作"), source, F.lit("，强调"), grounds, F.lit("。触发词："), words, F.lit("。"))


def embedded(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, bucket, weight: distinct one- and two-letter grams hashed to 512 buckets, counted, of length 1. A text without letters has no rows."""
    grams = F.array_distinct(F.concat(fx.char_ngrams(F.col(text), 1), fx.char_ngrams(F.col(text), 2)))
    counts = rows.select(key, F.explode(F.filter(grams, lambda g: F.length(g) > 0)).alias("g")).groupBy(key, fx.bucket(F.col("g")).alias("bucket")).agg(F.count("*").cast("double").alias("c"))
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return counts.join(norms, key).select(key, "bucket", (F.col("c") / F.col("norm")).alias("weight"))


def cosines(a: DataFrame, a_key: str, b: DataFrame, b_key: str) -> DataFrame:
    """a_key, b_key, sem of the vectors of ``embedded`` that share a bucket; others have 0 and no row."""
    both = a.select(a_key, "bucket", F.col("weight").alias("wa")).join(b.select(b_key, "bucket", F.col("weight").alias("wb")), "bucket")
    return both.groupBy(a_key, b_key).agg(F.sum(F.col("wa") * F.col("wb")).alias("sem"))


def kinds(edges: DataFrame) -> DataFrame:
    """kind and what edges of a kind share: frame, cascade, domains, ground, triggers, struct and type score, description."""
    own = ["frame_id", "cascade_id", "source_domain", "target_domain", "source_type", "type_reliability", "ground", "triggers"]
    rows = edges.select(*own).distinct()
    key = F.md5(F.concat_ws("|", F.coalesce("frame_id", F.lit("")), "source_domain", "target_domain", F.array_join("triggers", ","), F.array_join("ground", ",")))
    struct = F.least(F.lit(1.0), 0.5 * F.size("ground") + F.when(F.col("cascade_id").isNotNull(), 0.5).otherwise(0.0))
    return rows.select(key.alias("kind"), *own, struct.alias("struct"), described(F.col("source_domain"), F.col("target_domain"), F.col("ground"), F.col("triggers")).alias("description"))


def kind_of(edges: DataFrame) -> DataFrame:
    key = F.md5(F.concat_ws("|", F.coalesce("frame_id", F.lit("")), "source_domain", "target_domain", F.array_join("triggers", ","), F.array_join("ground", ",")))
    return edges.withColumn("kind", key)


def text_features(queries: DataFrame, cands: DataFrame, frames: DataFrame, members: DataFrame) -> DataFrame:
    """query_id, kind and the seven features of a query's text and each kind of edge (ground: the share of its grounds that the text holds).

    queries: query_id, query_text; as many as are asked at once, against kinds, whose number the ontology bounds.
    """
    sem = cosines(embedded(queries, "query_id", "query_text"), "query_id", embedded(cands, "kind", "description"), "kind")
    hit = queries.join(frames.select("frame_id", F.explode("triggers").alias("t")), F.contains("query_text", F.col("t"))).select("query_id", "frame_id").distinct()
    from .build import cascade_of

    own = hit.join(cascade_of(members), "frame_id", "left").groupBy("query_id").agg(F.collect_set("frame_id").alias("q_frames"), F.collect_set("cascade_id").alias("q_cascades"))
    none = F.array().cast("array<string>")
    asked = queries.join(own, "query_id", "left").withColumns({c: F.coalesce(c, none) for c in ("q_frames", "q_cascades")})
    rows = asked.join(F.broadcast(cands)).join(sem, ["query_id", "kind"], "left")  # kinds: bounded by the ontology
    inside = lambda words: F.size(F.filter(words, lambda w: F.contains(F.col("query_text"), w)))
    grounds = F.array_distinct("ground")
    return rows.select(
        "query_id", "kind", F.coalesce("sem", F.lit(0.0)).alias("sem"), "struct", F.least(F.lit(1.0), 0.5 * inside(F.col("triggers"))).alias("clue"), F.col("type_reliability").alias("type"),
        F.array_contains("q_frames", F.col("frame_id")).cast("double").alias("same_frame"), F.coalesce(F.array_contains("q_cascades", F.col("cascade_id")), F.lit(False)).cast("double").alias("same_cascade"),
        F.when(F.size(grounds) > 0, inside(grounds) / F.size(grounds)).otherwise(0.0).alias("ground"),
    )


def pair_features(cands: DataFrame) -> DataFrame:
    """a, b and the seven features of two kinds of edges (ground: Jaccard similarity)."""
    v = embedded(cands, "kind", "description")
    sem = cosines(v.withColumnRenamed("kind", "a"), "a", v.withColumnRenamed("kind", "b"), "b")
    x, y = (cands.select(*[F.col(c).alias(f"{p}_{c}") for c in ("kind", "frame_id", "cascade_id", "triggers", "ground", "struct", "type_reliability")]) for p in "xy")
    rows = x.join(F.broadcast(y)).join(sem, (F.col("a") == F.col("x_kind")) & (F.col("b") == F.col("y_kind")), "left")  # kinds: bounded by the ontology
    same = lambda c: F.coalesce(F.col(f"x_{c}") == F.col(f"y_{c}"), F.lit(False)).cast("double")
    return rows.select(
        F.col("x_kind").alias("a"), F.col("y_kind").alias("b"), F.coalesce("sem", F.lit(0.0)).alias("sem"), F.col("y_struct").alias("struct"), F.least(F.lit(1.0), 0.5 * F.size(F.array_intersect("x_triggers", "y_triggers"))).alias("clue"),
        F.col("y_type_reliability").alias("type"), same("frame_id").alias("same_frame"), same("cascade_id").alias("same_cascade"),
        (F.size(F.array_intersect("x_ground", "y_ground")) / F.greatest(F.lit(1), F.size(F.array_union("x_ground", "y_ground")))).alias("ground"),
    )


def strongest(queries: DataFrame, cands: DataFrame, frames: DataFrame, members: DataFrame) -> DataFrame:
    """query_id, kind, features: the greatest of each over the kinds of the frames a query names; a query without any is compared by its text."""
    hit = queries.join(frames.select("frame_id", F.explode("triggers").alias("t")), F.contains("query_text", F.col("t"))).select("query_id", "frame_id").distinct()
    own = hit.join(cands.select("frame_id", F.col("kind").alias("a")), "frame_id").select("query_id", "a")
    best = own.join(pair_features(cands), "a").groupBy("query_id", F.col("b").alias("kind")).agg(*[F.max(f).alias(f) for f in FEATURES])
    rest = text_features(queries, cands, frames, members).join(own.select("query_id").distinct(), "query_id", "left_anti")
    return best.unionByName(rest)


def hand_score(weights: dict[str, float]) -> Column:
    """The weighted sum of the features in their order; struct and clue count 1 at most."""
    out: Column = F.lit(0.0)
    for f in FEATURES:
        if weights.get(f):
            out = out + weights[f] * (F.least(F.col(f), F.lit(1.0)) if f in ("struct", "clue") else F.col(f))
    return out


def reliability_factor(edges: DataFrame, floor: float = 0.5) -> Column:
    """From ``floor`` to 1: what an edge is known to be worth, of what it says itself and what its frame's registration allows the lesser."""
    least = F.least(F.coalesce("reliability", F.lit(1.0)), F.when(F.col("provenance") == "fallback", 0.5).otherwise(1.0))
    return floor + (1 - floor) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), least))


def arms(features: DataFrame, edges: DataFrame, floor: float = 0.5, trained: Column | None = None) -> DataFrame:
    """query_id, chunk_id, arm, score: each scoring arm's best edge of a chunk, plain and discounted by reliability.

    features: by kind, of ``text_features`` or ``strongest``. One pass over the edges gives all arms. ``trained``: a learned score of the features, an arm of its own.
    """
    bare = {k: v for k, v in HAND.items() if k not in ("same_frame", "same_cascade")}
    said = {"hand": hand_score(HAND), "legacy": hand_score(LEGACY), "no_role": hand_score(bare)} | ({} if trained is None else {"trained": trained})
    scores = features.select("query_id", F.struct("kind", F.struct(*[c.alias(a) for a, c in said.items()]).alias("s")).alias("e"))
    by_query = scores.groupBy("query_id").agg(F.map_from_entries(F.collect_list("e")).alias("scores"))  # kinds: bounded by the ontology
    own = kind_of(edges).withColumn("factor", reliability_factor(edges, floor)).groupBy("chunk_id").agg(F.collect_set(F.struct("kind", "factor")).alias("own"))
    best = lambda a, f: F.array_max(F.transform("own", lambda e: F.col("scores")[e["kind"]][a] * (e["factor"] if f else 1.0)))
    each = F.array(*[F.struct(F.lit(a + tail).alias("arm"), best(a, tail).alias("score")) for a in said for tail in ("", "_reliable")])
    # a row of a chunk and a query has all its arms, so nothing is grouped by query
    return own.join(F.broadcast(by_query)).select("query_id", "chunk_id", F.explode(each).alias("a")).select("query_id", "chunk_id", "a.arm", "a.score").where("score is not null")


def representatives(features: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, chunk_id, edge_id: of each chunk the edge of the greatest sem, of equals the first."""
    rows = kind_of(edges).select("chunk_id", "edge_id", "kind").join(features.select("query_id", "kind", "sem"), "kind")
    return rows.groupBy("query_id", "chunk_id").agg(F.min_by("edge_id", F.struct(-F.round("sem", 9), F.col("edge_id"))).alias("edge_id"))


def query_sets(edges: DataFrame) -> DataFrame:
    """family, query_text, own (chunks left out of the pool), gold: one query for each distinct list of triggers, made from its first edge.

    anchored: the gold is the chunk of that edge. deanchored: the other chunks of its frame, else of its cascade; the query's own chunk is
    excluded, but not those of later edges with the same triggers. Queries without gold are left out. edges need ``ord``, their order.
    """
    text = F.array_join(F.array_distinct("triggers"), "，")
    first = edges.where(F.size("triggers") > 0).groupBy(text.alias("query_text")).agg(F.min(F.struct("ord", "chunk_id", "frame_id", "cascade_id")).alias("e"))
    first = first.select("query_text", F.col("e.chunk_id").alias("own"), "e.frame_id", "e.cascade_id")
    by = lambda c: edges.where(F.col(c).isNotNull()).groupBy(c).agg(F.collect_set("chunk_id").alias(f"by_{c}"))
    rows = first.join(by("frame_id"), "frame_id", "left").join(by("cascade_id"), "cascade_id", "left")
    none = F.array().cast("array<string>")
    rest = lambda c: F.array_sort(F.array_except(F.coalesce(c, none), F.array("own")))
    alt = F.when(F.size(rest("by_frame_id")) > 0, rest("by_frame_id")).otherwise(rest("by_cascade_id"))
    both = first.select(F.lit("anchored").alias("family"), "query_text", "own", F.array("own").alias("gold")).union(rows.select(F.lit("deanchored"), "query_text", "own", alt))
    return both.where(F.size("gold") > 0)


def cascade_texts(frames: DataFrame, members: DataFrame, names: DataFrame) -> DataFrame:
    """cascade_id, description: name and the domains of the first eight member frames."""
    rows = members.join(frames.select("frame_id", F.concat("source_domain", F.lit("→"), "target_domain").alias("bit")), "frame_id")
    bits = rows.groupBy("cascade_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("ord", "bit"))), 1, 8).alias("b"))
    return bits.join(names, "cascade_id").select("cascade_id", F.concat("name", F.lit("："), F.array_join("b.bit", "；")).alias("description"))


def semantic_fallback(queries: DataFrame, cascades: DataFrame, edges: DataFrame, most: int = 2) -> DataFrame:
    """query_id, chunk_id, score of queries that named no trigger: the edges of the ``most`` cascades nearest to the query's text.

    An edge counts its confidence and 0.3 for each ground, times its reliability factor. cascades: of ``cascade_texts``.
    """
    sem = cosines(embedded(queries, "query_id", "query_text"), "query_id", embedded(cascades, "cascade_id", "description"), "cascade_id").where("sem > 0")
    near = Window.partitionBy("query_id").orderBy(F.round("sem", 9).desc(), "cascade_id")
    top = sem.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= most)
    worth = (F.col("confidence") + 0.3 * F.size("ground")) * reliability_factor(edges)
    return edges.select("chunk_id", "cascade_id", worth.alias("worth")).join(top, "cascade_id").groupBy("query_id", "chunk_id").agg(F.sum("worth").alias("score"))


def without_own(ranked: DataFrame, sets: DataFrame, query: str = "query_text") -> DataFrame:
    """Ranked chunks without the one that produced the query."""
    return ranked.join(sets.select(query, F.col("own").alias("chunk_id")).distinct(), [query, "chunk_id"], "left_anti")


def chain_scores(found: DataFrame, gold: DataFrame, gap: int = 3) -> DataFrame:
    """doc_id, n_pred, n_gold, hits, precision, recall, f1, spurious: chains (doc_id, chunk_nos) are right if their sets of chunks are equal, each gold chain once.

    Without predictions precision is 1 if there is no gold either, else 0; without gold recall is 1. Spurious chains span ``gap`` chunks or more.
    """
    key = F.array_join(F.array_sort(F.array_distinct("chunk_nos")), ",")
    p = found.groupBy("doc_id", key.alias("k")).agg(F.count("*").alias("p"), F.sum((F.array_max("chunk_nos") - F.array_min("chunk_nos") >= gap).cast("long")).alias("wide"))
    g = gold.groupBy("doc_id", key.alias("k")).agg(F.count("*").alias("g"))
    rows = p.join(g, ["doc_id", "k"], "full").na.fill(0, ["p", "g", "wide"])
    sums = rows.groupBy("doc_id").agg(F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold"), F.sum(F.least("p", "g")).alias("hits"), F.sum("wide").alias("spurious"))
    precision = F.when(F.col("n_pred") > 0, F.col("hits") / F.col("n_pred")).when(F.col("n_gold") == 0, 1.0).otherwise(0.0)
    recall = F.when(F.col("n_gold") > 0, F.col("hits") / F.col("n_gold")).otherwise(1.0)
    both = sums.withColumn("precision", precision).withColumn("recall", recall)
    return both.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def commonsense(queries: DataFrame, neighbours: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, score: how many neighbours of the terms a question holds (of two letters or more) the chunk holds."""
    from .matching import contained

    terms = neighbours.where(F.length("term") >= 2)
    pool = queries.join(terms, F.contains("query_text", F.col("term"))).select("query_id", F.col("neighbour").alias("pattern")).where(F.length("pattern") > 0).distinct()
    return contained(chunks, pool.select("pattern"), ["chunk_id"]).join(pool, "pattern").groupBy("query_id", "chunk_id").agg(F.count("*").alias("score"))


def metagraph(edges: DataFrame, members: DataFrame) -> DataFrame:
    """level, scope, src, dst, rel: per chunk trigger to mapping to frame, once for each trigger; the same by document; cascade to frame over all."""
    mapping = F.col("edge_id")
    each = edges.select("doc_id", "chunk_id", mapping.alias("m"), "frame_id", F.explode("triggers").alias("t"))
    pair = F.array(F.struct(F.concat(F.lit("trig::"), "t").alias("src"), F.col("m").alias("dst"), F.lit("trigger_of").alias("rel")), F.struct(F.col("m").alias("src"), F.col("frame_id").alias("dst"), F.lit("in_frame").alias("rel")))
    low = each.select("doc_id", "chunk_id", F.explode(pair).alias("e")).where("e.dst is not null")
    top = members.join(edges.select("frame_id").distinct(), "frame_id").select(F.lit(2).alias("level"), F.lit("").alias("scope"), F.concat(F.lit("cas::"), "cascade_id").alias("src"), F.col("frame_id").alias("dst"), F.lit("has_frame").alias("rel"))
    return low.select(F.lit(0).alias("level"), F.col("chunk_id").alias("scope"), "e.*").union(low.select(F.lit(1), "doc_id", "e.*")).union(top)


def nearest(asked: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """q, key, s (cosine, six decimals), rank: of each asked vector the ``k`` most similar rows but its own, ties to the smaller key.

    Both sides are dealt into blocks of about ``block`` rows and each pair of blocks meets in
    one key, so no side is broadcast for its own sake and no task holds more than two blocks
    at once. What may be among a block's ``k`` best is measured exactly and goes on to the final ranking. Vectors that are null or hold a null or non-finite number take no part.
    """
    sound = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    mine, theirs = asked.where(sound).select(F.col(key).alias("a"), F.col(vector).alias("own")), rows.where(sound).select(F.col(key).alias("b"), F.col(vector).alias("theirs"))
    met = vectors.likely(mine, theirs, best=k, block=block)
    scored = met.select(F.col("a").alias("q"), F.col("b").alias(key), F.round(fx.cosine(F.col("own"), F.col("theirs")), 6).alias("s"))
    best = F.struct(-F.col("s"), F.col(key))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(best)))
    return ranked.where(F.col("rank") <= k).select("q", key, "s", "rank")
