"""Upkeep of an ontology: pairs with histograms, canonical names, frames and cascades of the merged pairs.

Discoveries name one domain in many ways. A service proposes which names mean the same; names linked by proposals are one class, whatever the
order or direction of the proposals, and the class goes by its most frequent name. A merge that merges nothing is the trace of a service that failed
in silence, so the share of names left is part of the result. Histograms stay rows (pair, word, count) until the best few are taken,
which Spark does before it shuffles.

Tables: discovered: source_domain, target_domain, triggers array, ground array. proposals: name, same_as.
Nulls: discoveries without a source or target are left out, as are null or empty words and proposals with a null side; repeated proposals change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components_of

MOST_WORDS = 8
#: A trigger says too little if it is shorter than this or belongs to more pairs than that.
LEAST_LETTERS, MOST_PAIRS = 2, 3
IDLE_SHARE = 0.95
PAIR = ["source_domain", "target_domain"]


def named(discovered: DataFrame) -> DataFrame:
    return discovered.where("source_domain <> '' and target_domain <> ''")


def pairs(discovered: DataFrame) -> DataFrame:
    """source_domain, target_domain, n: how often each pair was found."""
    return named(discovered).groupBy(PAIR).agg(F.count("*").alias("n"))


def histogram(discovered: DataFrame, words: str) -> DataFrame:
    """source_domain, target_domain, word, n: how often each trigger (or ground) was found with a pair."""
    each = named(discovered).select(*PAIR, F.explode(words).alias("word")).where("word <> ''")
    return each.groupBy(*PAIR, "word").agg(F.count("*").alias("n"))


def classes(counts: DataFrame, proposals: DataFrame) -> DataFrame:
    """name, canonical: every name of ``counts`` (name, n) with the name of its class, itself if nothing was proposed.

    A class goes by its most frequent name, of equals the first by code point. Proposals may name what was never counted; it links all the same.
    """
    links = proposals.where("name is not null and same_as is not null").select(F.col("name").alias("a"), F.col("same_as").alias("b")).distinct()
    found = components_of(links)
    rows = counts.where("name is not null").groupBy("name").agg(F.sum("n").alias("n")).join(found, F.col("name") == F.col("node"), "left").withColumn("class", F.coalesce("component", "name"))
    best = rows.groupBy("class").agg(F.min(F.struct((-F.col("n")).alias("n"), "name")).alias("b"))
    return rows.join(best, "class").select("name", F.col("b.name").alias("canonical"))


def merge_rate(mapping: DataFrame, least: float = IDLE_SHARE) -> DataFrame:
    """n_names, n_classes, idle: whether at least that share of the names is left, so that merging has not worked. Without names it is not idle."""
    sums = mapping.agg(F.count_distinct("name").alias("n_names"), F.count_distinct("canonical").alias("n_classes"))
    return sums.withColumn("idle", (F.col("n_names") > 0) & (F.col("n_classes") >= F.col("n_names") * least))


def mapped(rows: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of pairs (and words) with canonical domains, their counts summed."""
    s, t = (m.select(F.col("name").alias(c), F.col("canonical").alias(f"own_{c}")) for m, c in ((sources, PAIR[0]), (targets, PAIR[1])))
    both = rows.join(s, PAIR[0], "left").join(t, PAIR[1], "left")
    own = [F.coalesce(F.col(f"own_{c}"), F.col(c)).alias(c) for c in PAIR]
    rest = [c for c in rows.columns if c not in (*PAIR, "n")]
    return both.select(*own, *rest, "n").groupBy(*PAIR, *rest).agg(F.sum("n").alias("n"))


def generic(words: DataFrame, least: int = LEAST_LETTERS, most: int = MOST_PAIRS) -> DataFrame:
    """word: triggers that are too short or belong to too many pairs."""
    spread = words.groupBy("word").agg(F.count("*").alias("pairs"))
    return spread.where((F.length("word") < least) | (F.col("pairs") > most)).select("word")


def top_words(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """source_domain, target_domain, words: each pair's most frequent words, of equals the first by code point."""
    nth = F.row_number().over(Window.partitionBy(PAIR).orderBy(F.desc("n"), "word"))
    best = words.withColumn("nth", nth).where(F.col("nth") <= most)
    return best.groupBy(PAIR).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "word"))), lambda x: x["word"]).alias("words"))


def stable_id(head: str, *parts: Column | str) -> Column:
    """A short label that is the same for the same parts; what it names is known by the parts themselves."""
    return F.concat(F.lit(head + "_"), F.substring(F.md5(F.concat_ws("||", *parts)), 1, 8))


def specs(discovered: DataFrame, sources: DataFrame, targets: DataFrame, kind: Column, generic_kind: str = "GENERIC", least: int = 1, most: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Frames and cascades of the merged pairs found at least ``least`` times.

    frames: frame_id, name, source_domain, target_domain, source_type, mapping_type, support, triggers, ground. A frame of known kind maps in a way
    of its own, ``DISCOVERED::kind_TO_target``. cascades: cascade_id, name, frame_id and its pair, a row per member: the frames of one target.
    ``kind``: the source's type, a column over source_domain.
    """
    support = mapped(pairs(discovered), sources, targets).where(F.col("n") >= least)
    triggers = mapped(histogram(discovered, "triggers"), sources, targets)
    triggers = top_words(triggers.join(generic(triggers), "word", "left_anti"), most).withColumnRenamed("words", "triggers")
    ground = top_words(mapped(histogram(discovered, "ground"), sources, targets), most).withColumnRenamed("words", "ground")
    none = F.array().cast("array<string>")
    frames = support.join(triggers, PAIR, "left").join(ground, PAIR, "left").withColumn("source_type", kind)
    way = F.when(F.col("source_type") == generic_kind, F.lit(generic_kind)).otherwise(F.concat(F.lit("DISCOVERED::"), "source_type", F.lit("_TO_"), "target_domain"))
    frames = frames.select(
        stable_id("F_LLM", *PAIR).alias("frame_id"), F.concat(F.lit("LLM::"), PAIR[0], F.lit("_IS_"), PAIR[1]).alias("name"), *PAIR, "source_type", way.alias("mapping_type"),
        F.col("n").alias("support"), F.coalesce("triggers", none).alias("triggers"), F.coalesce("ground", none).alias("ground"),
    )
    cascades = frames.select(stable_id("C_LLM", "target_domain").alias("cascade_id"), F.concat(F.lit("LLM_TARGET::"), "target_domain").alias("name"), "frame_id", *PAIR)
    return frames, cascades
