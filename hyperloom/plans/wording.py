"""Plans over words: segmentation by a dictionary, tags of words, vehicles of comparisons."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.operators import segmenting, tagging

from . import standin as S
from .catalogue import plan
from .folded import read

#: Particles and articles of the documents' languages, and endings of nouns: what the stand-in annotation goes by.
LINKS = ["of", "de", "von", "des"]
IDLE = ["the", "a", "la", "le", "les", "der", "die", "das", "el", "los", "ein", "un", "une"]
NOUNS = r"(tion|ment|heit|keit|ung|ción|eau|ing|eur)$"
CUES = tagging.Cues(markers=frozenset(S.MARKERS), links=frozenset(LINKS), idle=frozenset(IDLE), before=("like", "wie"))


def run_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: the documents with all blanks lost."""
    return read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[\x20\x09-\x0D]+", "").alias("text"))


@plan("segmented_words")
def segmented_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose blanks are lost, cut again by a dictionary of the 50,000 most frequent words of the corpus."""
    lexicon = segmenting.Lexicon.of(segmenting.counted(read(spark, sf_dir, "documents")))
    words = segmenting.segmented(run_on(spark, sf_dir), lexicon, key="doc_id")
    return words.select("doc_id", F.size("words").cast("long").alias("n_words"), F.sha2(F.array_join("words.word", "\n").cast("binary"), 256).alias("words_sha256"))


def annotated(said: DataFrame) -> DataFrame:
    """Sentences with tags by rule: particle (u), sign (w), number (m), name (nr), noun (n) or other (v); stands in for an annotated corpus."""

    def tag(w: Column, i: Column) -> Column:
        return (
            F.when(F.lower(w).isin(LINKS + IDLE), "u").when(~w.rlike(r"[\p{L}\p{N}]"), "w").when(w.rlike("[0-9]"), "m")
            .when(w.rlike(r"^\p{Lu}\p{Ll}") & (i > 0), "nr").when(F.lower(w).rlike(NOUNS), "n").otherwise("v")
        )

    return said.withColumn("tags", F.transform("words", tag))


def said(spark: SparkSession, sf_dir: str, holding: Collection[str] = ()) -> DataFrame:
    return tagging.sentences(S.chunks(spark, sf_dir), holding=holding)


def tagger(spark: SparkSession, sf_dir: str) -> tagging.Tagger:
    """Learned from the sentences of every other document, by a digest of the chunk."""
    return tagging.Tagger.learned(annotated(said(spark, sf_dir).where(F.crc32(F.col("chunk_id").cast("binary")) % 2 == 0)))


def tagged(spark: SparkSession, sf_dir: str, holding: Collection[str] = ()) -> DataFrame:
    return tagging.tagged(said(spark, sf_dir, holding), tagger(spark, sf_dir))


@plan("tagged_words")
def tagged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of every word of every document, half of which the model has not seen: counts and a digest by document."""
    rows = tagged(spark, sf_dir).select("chunk_id", F.struct("sent", F.array_join("tags", " ").alias("said")).alias("s"), F.size("tags").alias("n"), F.size(F.filter("tags", lambda t: t.startswith("n"))).alias("nouns"))
    per = rows.groupBy("chunk_id").agg(F.sum("n").alias("n_words"), F.sum("nouns").alias("n_nouns"), F.sort_array(F.collect_list("s")).alias("s"))
    return per.select("chunk_id", "n_words", "n_nouns", F.sha2(F.array_join("s.said", "\n").cast("binary"), 256).alias("tags_sha256"))


@plan("comparison_vehicles")
def comparison_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence without a marker has no vehicle, so it is not tagged."""
    return tagging.compared(tagged(spark, sf_dir, CUES.markers), CUES)


@plan("tagged_patterns")
def tagged_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker and vehicle of each sentence that compares, by tags; one without a marker does not."""
    return tagging.patterns(tagged(spark, sf_dir, CUES.markers.union(CUES.before)), CUES)


def heuristic(spark: SparkSession, sf_dir: str, generic: bool = False) -> DataFrame:
    """Discoveries without an outside service: vehicles bound to frames."""
    fields = S.rows_of(spark, S.FIELDS, "field, word")
    words = S.chunks(spark, sf_dir).select("chunk_id", F.posexplode(F.split("text", " ")).alias("pos", "word")).join(fields, "word").select("chunk_id", "pos", "field")
    return tagging.candidates(comparison_vehicles(spark, sf_dir), S.frames(spark), fields, S.rows_of(spark, S.BRIDGES, "field, frame_id"), tagging.literal_fields(words), [], CUES, generic)


@plan("heuristic_candidates")
def heuristic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = heuristic(spark, sf_dir, generic=True)
    return rows.select("chunk_id", "source_domain", "target_domain", F.array_join("ground", ",").alias("ground"), F.col("triggers")[0].alias("vehicle"), "confidence")
