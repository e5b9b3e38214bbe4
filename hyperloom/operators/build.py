"""From chunks to a layered graph: extraction by three channels, links across chunks, frames and cascades.

Tables and their columns:
chunks: doc_id, chunk_id, chunk_no, text. frames: frame_id, ord, source_domain, target_domain, mapping_type,
source_type, ground array, triggers array. constraints: source_type, mapping_type. stops: word, exempt array.
edges: edge_id, doc_id, chunk_id, chunk_no, frame_id, source_domain, target_domain, source_type, ground, triggers,
spans array of (start, end), confidence, novelty, reliability.
Ontologies (frames, constraints, stops, fields, markers) are assumed far smaller than the chunks; joins with them are
plain joins, which Spark broadcasts while they are small and shuffles when they are not.
"""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyperloom.functions.text import verbatim

from .matching import contained

GENERIC = "GENERIC"
SPANS = "array<struct<start:int,end:int>>"


def occurrences(text: Column, part: Column) -> Column:
    """All non-overlapping places of a string in a text: (start, end), from 0."""
    between = F.transform(F.split(text, verbatim(part), -1), F.length)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))

    def step(a: Column, gap: Column) -> Column:
        start = a["at"] + gap
        return F.struct((start + F.length(part)).alias("at"), F.concat(a["found"], F.array(F.struct(start.alias("start"), (start + F.length(part)).alias("end")))).alias("found"))

    folded = F.aggregate(F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0))), zero, step)
    return F.when(F.length(part) > 0, folded["found"]).otherwise(F.array().cast(SPANS))


def extent(text: Column, part: Column) -> list[Column]:
    """low, high: the start of a string's first place in a text and the end of its last, from 0."""
    last = F.length(text) - F.instr(F.reverse(text), F.reverse(part)) + 1
    return [(F.instr(text, part) - 1).alias("low"), last.cast("int").alias("high")]


def spanned(rows: DataFrame) -> DataFrame:
    """rows with the extent of their spans (low, high), where they bring none."""
    if "low" in rows.columns and "high" in rows.columns:
        return rows
    low, high = F.array_min(F.transform("spans", lambda s: s["start"])), F.array_max(F.transform("spans", lambda s: s["end"]))
    return rows.withColumn("low", low).withColumn("high", high)


def admitted(rows: DataFrame, constraints: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """Rows whose (source_type, mapping_type) is allowed and none of whose triggers is a stop word that does not exempt their source domain."""
    rows = rows.join(constraints.select("source_type", "mapping_type").distinct(), ["source_type", "mapping_type"], "left_semi")
    if stops is not None:
        bad = F.array_contains("triggers", F.col("word")) & ~F.array_contains("exempt", F.col("source_domain"))
        rows = rows.join(stops, bad, "left_anti")
    return rows


def trigger_channel(chunks: DataFrame, frames: DataFrame) -> DataFrame:
    """One candidate per chunk and frame with a trigger of the frame in the chunk; conf = 0.4 and 0.2 more per distinct trigger, 1 at most.

    Spans do not overlap; the extent (low, high) goes from the first place of a trigger to the end of its last, which may overlap the place before it.
    The extent is found without the spans, so a plan that asks for no spans does not look for them.
    """
    words = frames.select(F.explode("triggers").alias("pattern")).distinct()
    hits = contained(chunks.select("chunk_id", "text"), words, ["chunk_id"], with_text=True)
    owners = frames.select("frame_id", F.explode("triggers").alias("pattern")).distinct()
    places = hits.select("chunk_id", "pattern", occurrences(F.col("text"), F.col("pattern")).alias("places"), *extent(F.col("text"), F.col("pattern")))
    by_frame = places.join(owners, "pattern").groupBy("chunk_id", "frame_id").agg(
        F.sort_array(F.collect_set("pattern")).alias("triggers"), F.sort_array(F.flatten(F.collect_list("places"))).alias("spans"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    base = F.least(F.lit(1.0), 0.4 + 0.2 * F.size("triggers"))
    return by_frame.select("chunk_id", "frame_id", "triggers", "spans", base.alias("conf"), F.lit(1).alias("channel"), "low", "high")


def _starts(texts: pd.Series) -> pd.Series:
    """Where the words between blanks start in each text, from 0."""
    return texts.map(lambda t: None if t is None else list(accumulate([len(w) + 1 for w in t.split(" ")][:-1], initial=0)))


def words_of(chunks: DataFrame) -> DataFrame:
    """chunk_id, pos, word, start, end: the words between blanks, with their places. Each chunk's words are placed where the chunk is, so nothing is shuffled."""
    starts = F.pandas_udf(_starts, "array<int>")("text")
    rows = chunks.select("chunk_id", F.split("text", " ").alias("w"), starts.alias("s")).select("chunk_id", F.posexplode(F.arrays_zip("w", "s")).alias("pos", "x"))
    return rows.select("chunk_id", "pos", F.col("x.w").alias("word"), F.col("x.s").alias("start"), (F.col("x.s") + F.length("x.w")).alias("end"))


def dominant_fields(tagged: DataFrame) -> DataFrame:
    """chunk_id, dominant: the field of most words, of equals the one seen first."""
    counts = tagged.groupBy("chunk_id", "field").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return counts.groupBy("chunk_id").agg(F.max_by("field", F.struct("n", -F.col("first"))).alias("dominant"))


def incongruity(field: Column, dominant: Column) -> Column:
    """How far a word strays from what its chunk is about: 0 without a field or in the dominant one, 0.3 where nothing dominates, else 0.6."""
    return F.when(field.isNull(), 0.0).when(dominant.isNull(), 0.3).when(field == dominant, 0.0).otherwise(0.6)


def field_channel(chunks: DataFrame, fields: DataFrame, markers: DataFrame, bridges: DataFrame, near: int = 2) -> DataFrame:
    """Words of another field than their chunk's, as candidates: with a comparison marker within ``near`` words 0.5, else 0.45 if alone of its field.

    fields: word, field; bridges: field, frame_id. A field that dominates with two words or more is what the chunk is literally about.
    """
    # only words of a field and markers take part, so no more than they are shuffled
    words = words_of(chunks).join(fields, "word", "left").join(markers.select("word", F.lit(1).alias("marks")), "word", "left").where("field is not null or marks is not null")
    around = Window.partitionBy("chunk_id").orderBy("pos").rangeBetween(-near, near)
    words = words.withColumn("marked", F.coalesce(F.max("marks").over(around), F.lit(0)) > 0)
    own = Window.partitionBy("chunk_id", "field")
    tagged = words.where("field is not null and chunk_id is not null").withColumn("n_field", F.count("*").over(own)).withColumn("first", F.min("pos").over(own))
    most = F.max(F.struct("n_field", -F.col("first"), "field")).over(Window.partitionBy("chunk_id"))  # as ``dominant_fields``
    tagged = tagged.withColumn("dominant", most["field"])
    literal = (F.col("n_field") >= 2) & (F.col("field") == F.col("dominant"))
    strays = (incongruity(F.col("field"), F.col("dominant")) >= 0.6) & (F.col("n_field") <= 1)
    kept = tagged.where(~literal & (F.col("marked") | strays)).join(bridges, "field")
    return kept.select("chunk_id", "frame_id", F.array("word").alias("triggers"), F.array(F.struct("start", "end")).alias("spans"), F.when(F.col("marked"), 0.5).otherwise(0.45).alias("conf"), F.lit(2).alias("channel"), F.col("start").alias("low"), F.col("end").alias("high"))


def type_of(domain: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The type of the first rule of which a keyword occurs in the domain, else GENERIC."""
    out: Column = F.lit(GENERIC)
    for kind, words in reversed(rules):
        out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(domain, w)), F.lit(kind)).otherwise(out)
    return out


def bind_frames(candidates: DataFrame, frames: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """Each candidate domain pair with the frame it belongs to, and by which step; without one it gets a frame of its own.

    Steps: both domains equal; the source equal; source and target contain one another; the source does. Only frames of a coherent type count.
    candidates: source_domain, target_domain and what else they carry. bound: frame_id, step (1 to 5), known (a frame of the ontology).
    """
    pairs = candidates.select("source_domain", "target_domain").distinct().withColumn("guess", type_of(F.col("source_domain"), rules))
    f = frames.select("frame_id", "ord", F.col("source_domain").alias("fs"), F.col("target_domain").alias("ft"), F.col("source_type").alias("kind"))
    either = lambda a, b: F.contains(a, b) | F.contains(b, a)
    source_hit, target_hit = either(F.col("source_domain"), F.col("fs")), either(F.col("target_domain"), F.col("ft"))
    coherent = (F.col("guess") == GENERIC) | (F.col("kind") == GENERIC) | (F.col("guess") == F.col("kind"))
    met = pairs.join(f, source_hit & (F.length("fs") > 0) & (F.length("ft") > 0))
    exact = F.col("source_domain") == F.col("fs")
    step = F.when(exact & (F.col("target_domain") == F.col("ft")), 1).when(exact, 2).when(target_hit, 3).otherwise(4)
    score = F.length("fs") + F.when(target_hit, F.length("ft")).otherwise(0)
    met = met.where(coherent).withColumn("step", step).withColumn("rank", F.when(F.col("step") > 2, -score).otherwise(0))
    best = met.groupBy("source_domain", "target_domain").agg(F.min(F.struct("step", "rank", "ord", "frame_id")).alias("b"))
    own = F.concat(F.lit("F_LLM_"), F.substring(F.md5(F.concat_ws("|", "source_domain", "target_domain")), 1, 8))
    bound = pairs.join(best, ["source_domain", "target_domain"], "left").select("source_domain", "target_domain", F.coalesce("b.frame_id", own).alias("frame_id"), F.coalesce("b.step", F.lit(5)).alias("step"), F.col("b").isNotNull().alias("known"))
    return candidates.join(bound, ["source_domain", "target_domain"])


def open_channel(chunks: DataFrame, discovered: DataFrame, least: float = 0.5) -> DataFrame:
    """Discovered candidates (chunk_id, source_domain, target_domain, triggers, confidence) that can be located: by a trigger, else by the source domain's text."""
    found = discovered.where(F.col("confidence") >= least).join(chunks.select("chunk_id", "text"), "chunk_id")
    at = lambda words: F.flatten(F.transform(words, lambda w: occurrences(F.col("text"), w)))
    found = found.withColumn("spans", at(F.col("triggers")))
    found = found.withColumn("spans", F.when(F.size("spans") > 0, F.col("spans")).otherwise(occurrences(F.col("text"), F.col("source_domain"))))
    return found.where(F.size("spans") > 0).drop("text")


def refined(rows: DataFrame, verdicts: DataFrame | None, on: list[str]) -> DataFrame:
    """Three states: judged figurative (its confidence counts), judged literal (dropped), or, without a judge, as it is.

    verdicts: the columns of ``on``, figurative boolean, judged double. A pair the judge does not know is dropped, too; no judge is no rejection.
    """
    if verdicts is None:
        return rows
    return rows.join(verdicts, on).where("figurative").withColumn("conf", F.coalesce("judged", "conf")).drop("figurative", "judged")


def emitted(found: DataFrame, frames: DataFrame, chunks: DataFrame, constraints: DataFrame, stops: DataFrame | None, least: float = 0.35, cascades: DataFrame | None = None) -> DataFrame:
    """Candidates of all channels that pass the guards and the threshold, as edges; of those with one frame and extent in a chunk the first channel's stays.

    Of frames that share an id a candidate takes the one of its own domains (own_source, own_target), if it has such.
    """
    rows = spanned(found).join(frames.select("frame_id", "ord", "source_domain", "target_domain", "mapping_type", "source_type", "ground"), "frame_id")
    if "own_source" in rows.columns:
        rows = rows.where("own_source is null or own_source = source_domain and own_target = target_domain")
    rows = admitted(rows, constraints, stops)
    rows = rows.where(F.col("conf") >= least)
    first = Window.partitionBy("chunk_id", "frame_id", "low", "high").orderBy("channel", "ord", F.array_join("triggers", ","), "source_domain", "target_domain")
    rows = rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").join(chunks.select("chunk_id", "doc_id", "chunk_no"), "chunk_id")
    key = F.concat_ws("|", "chunk_id", "low", "high", "source_domain", "target_domain")
    edges = rows.select(
        F.concat(F.lit("L1_"), F.substring(F.md5(key), 1, 8)).alias("edge_id"), "doc_id", "chunk_id", "chunk_no", "frame_id", "source_domain", "target_domain", "source_type", "ground", "triggers", "spans", "low", "high",
        F.round("conf", 3).alias("confidence"), F.when(F.size("triggers") == 1, "novel").otherwise("conventional").alias("novelty"), F.lit(1.0).alias("reliability"), "channel",
    )
    return edges if cascades is None else edges.join(cascade_of(cascades), "frame_id", "left")


def cascade_of(members: DataFrame) -> DataFrame:
    """frame_id, cascade_id: of several cascades the last in their order (members: cascade_id, frame_id, ord)."""
    return members.groupBy("frame_id").agg(F.max_by("cascade_id", F.struct("ord", "cascade_id")).alias("cascade_id"))


def extended(edges: DataFrame, gap: int = 3, repeat: bool = False) -> DataFrame:
    """Chains across chunks: per document, frame and source domain the edges in chunk order, each nearer than ``gap`` chunks to the last taken and sharing ground with it.

    With ``repeat`` a link also needs a shared trigger or two shared grounds. A chain of two or more is one edge: union of grounds and triggers,
    greatest confidence, least reliability.
    """
    item = F.struct("chunk_no", "edge_id", "ground", "triggers", "chunk_id", "target_domain", "confidence", "reliability", "novelty", "source_type")
    groups = edges.groupBy("doc_id", "frame_id", "source_domain").agg(F.sort_array(F.collect_list(item)).alias("items")).where(F.size("items") > 1)

    def step(chain: Column, x: Column) -> Column:
        last = F.element_at(chain, -1)
        shared = F.size(F.array_intersect(x["ground"], last["ground"]))
        fits = (x["chunk_no"] - last["chunk_no"] < gap) & (shared >= 1)
        if repeat:
            fits &= (shared >= 2) | F.arrays_overlap(x["triggers"], last["triggers"])
        return F.when(fits, F.concat(chain, F.array(x))).otherwise(chain)

    chain = F.aggregate(F.slice("items", 2, F.size("items")), F.slice("items", 1, 1), step)
    rows = groups.select("doc_id", "frame_id", "source_domain", chain.alias("c")).where(F.size("c") > 1)
    ids = F.concat(F.lit("['"), F.array_join(F.array_sort("c.chunk_id"), "', '"), F.lit("']"))
    key = F.concat_ws("|", "frame_id", "source_domain", ids)
    first = F.element_at("c", 1)
    return rows.select(
        F.concat(F.lit("EXT_"), F.substring(F.md5(key), 1, 8)).alias("edge_id"), "doc_id", "frame_id", "source_domain", first["target_domain"].alias("target_domain"),
        F.array_sort(F.array_distinct(F.flatten("c.ground"))).alias("ground"), F.array_sort(F.array_distinct(F.flatten("c.triggers"))).alias("triggers"), F.col("c.chunk_id").alias("chunk_ids"), F.col("c.chunk_no").alias("chunk_nos"),
        F.round(F.array_max("c.confidence"), 3).alias("confidence"), F.array_min("c.reliability").alias("reliability"), first["novelty"].alias("novelty"), first["source_type"].alias("source_type"), F.lit(1.5).alias("layer"),
    )


def chain_key(edges: DataFrame) -> DataFrame:
    """With the key under which a judge's verdict on a chain is kept: document, source domain and the first four grounds in order."""
    return edges.withColumn("chain_key", F.concat_ws("|", "doc_id", "source_domain", F.array_join(F.slice(F.array_sort("ground"), 1, 4), "、")))


def verified(chains: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Chains the judge holds for continued; one it has not judged is dropped (verdicts: chain_key, continued)."""
    return chain_key(chains).join(verdicts.where("continued").select("chain_key").distinct(), "chain_key", "left_semi")


def assembled(edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames (frame_id, edge_ids) and cascades (cascade_id, frame_ids) of the edges, by look-up."""
    frames = edges.where("frame_id is not null").groupBy("frame_id").agg(F.sort_array(F.collect_list("edge_id")).alias("edge_ids"))
    cascades = frames.join(cascade_of(members), "frame_id").groupBy("cascade_id").agg(F.sort_array(F.collect_list("frame_id")).alias("frame_ids"))
    return frames, cascades


def orphan_cascades(edges: DataFrame, cascades: DataFrame, rule: str = "target") -> DataFrame:
    """Cascades with those that frames outside of all get: grouped by target, source or source_type of a frame's first edge, or by ground; ``none`` adds nothing.

    cascades: cascade_id, frame_ids. A group whose id exists is merged with it. Grounds are grouped greedily, see ``folds.greedy_groups``.
    """
    if rule == "none":
        return cascades
    taken = cascades.select(F.explode("frame_ids").alias("frame_id")).distinct()
    first = edges.where("frame_id is not null").groupBy("frame_id").agg(F.min(F.struct("chunk_no", "edge_id", "source_domain", "target_domain", "source_type", "ground")).alias("e"))
    orphans = first.join(taken, "frame_id", "left_anti").select("frame_id", "e.*")
    if rule == "ground":
        from .folds import greedy_groups

        groups = greedy_groups(orphans.withColumn("support", F.lit(0)), "frame_id", "support", "ground")
        groups = groups.select(F.concat(F.lit("G"), F.col("grp")).alias("key"), F.split("members", ",").alias("frame_ids"))
    elif rule in ("target", "source", "source_type"):
        column = F.col({"target": "target_domain", "source": "source_domain"}.get(rule, rule))
        groups = orphans.groupBy(F.when(F.coalesce(column, F.lit("")) == "", "未标注").otherwise(column).alias("key")).agg(F.sort_array(F.collect_list("frame_id")).alias("frame_ids"))
    else:
        raise ValueError(f"unknown rule {rule}")
    tag = "ADHOC" if rule == "target" else f"ADHOC_{rule.upper()}"
    new = groups.select(F.concat(F.lit(f"C_{tag}_"), F.substring(F.md5("key"), 1, 8)).alias("cascade_id"), "frame_ids")
    both = cascades.select("cascade_id", "frame_ids").union(new).groupBy("cascade_id")
    return both.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("frame_ids")))).alias("frame_ids"))


def novel_frames(edges: DataFrame) -> DataFrame:
    """A frame for the edges without one, by source domain: frame_id, name, edge_ids."""
    named = edges.where("frame_id is null").groupBy("source_domain").agg(F.sort_array(F.collect_list("edge_id")).alias("edge_ids"))
    return named.select(F.concat(F.lit("F_NOVEL_"), F.substring(F.md5("source_domain"), 1, 6)).alias("frame_id"), F.concat(F.lit("NOVEL::"), F.col("source_domain")).alias("name"), "edge_ids")


def live(edges: DataFrame) -> DataFrame:
    """Without the softly deleted."""
    return edges.where(~F.coalesce(F.col("deprecated"), F.lit(False)))


def type_reliability(edges: DataFrame, frames: DataFrame, constraints: DataFrame) -> DataFrame:
    """With type_reliability: 1 for a registered frame of an allowed type, 0.5 for a frame the ontology does not know, 0 without a frame or with a forbidden type; and provenance."""
    known = frames.select("frame_id", F.col("mapping_type").alias("own_mapping"), F.lit(True).alias("registered"))
    allowed = constraints.select("source_type", F.col("mapping_type").alias("own_mapping"), F.lit(True).alias("allowed")).distinct()
    rows = edges.join(known, "frame_id", "left").join(allowed, ["source_type", "own_mapping"], "left")
    value = F.when(F.col("frame_id").isNull(), 0.0).when(F.col("registered").isNull(), 0.5).when(F.col("allowed"), 1.0).otherwise(0.0)
    source = F.when(F.col("registered").isNull() & F.col("frame_id").isNotNull(), "fallback").otherwise("ontology")
    return rows.withColumn("type_reliability", value).withColumn("provenance", source).drop("registered", "allowed", "own_mapping")
