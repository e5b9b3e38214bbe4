"""What is made of a language model's replies: tolerant parsing, keys, red lines, complete judgements, and names in a second language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_of(text: Column) -> Column:
    """The JSON text of a reply: all of it, else from the first to the last square bracket, else from the first to the last curly one; null if none of them parses."""
    bare = F.trim(text)

    def between(a: str, b: str) -> Column:
        first, tail = F.instr(bare, a), F.instr(F.reverse(bare), b)
        last = F.length(bare) - tail + 1
        return F.when((first > 0) & (tail > 0) & (last > first), F.substring(bare, first, last - first + 1))

    tries = [bare, between("[", "]"), between("{", "}")]
    return F.coalesce(*[F.when(F.try_parse_json(t).isNotNull(), t) for t in tries])


def key_number(key: Column) -> Column:
    """The number of a key such as 问题0, Q1 or 第2; null if there is none."""
    return F.regexp_replace(F.trim(key), r"^(问题|Q|q|第)\s*", "").try_cast("int")


def within_red_line(rows: DataFrame, text: str, banned: str) -> DataFrame:
    """Rows with a text that holds none of its banned strings; empty texts go, empty strings ban nothing."""
    hit = F.exists(banned, lambda b: (F.length(b) > 0) & F.contains(F.col(text), b))
    return rows.where((F.coalesce(F.col(text), F.lit("")) != "") & ~F.coalesce(hit, F.lit(False)))


def complete_judgements(asked: DataFrame, answers: DataFrame, question: str, candidate: str, verdict: str) -> DataFrame:
    """question, candidate, verdict for questions that miss no more than half of their candidates; a missing verdict counts 0.

    asked: every question with every candidate shown to it; answers to candidates that were not shown are ignored.
    """
    rows = asked.select(question, candidate).join(answers.select(question, candidate, verdict), [question, candidate], "left")
    missing = rows.groupBy(question).agg((2 * F.sum(F.col(verdict).isNull().cast("long")) > F.count("*")).alias("poor"))
    return rows.join(missing.where("not poor").select(question), question, "left_semi").select(question, candidate, F.coalesce(verdict, F.lit(0)).alias(verdict))


def bilingual(frames: DataFrame, curated: DataFrame, dictionary: DataFrame) -> DataFrame:
    """frame_id, name, alignment: a curated name of the domain pair, else one made of the dictionary's words for both domains, else unmapped.

    curated: source_domain, target_domain, en; dictionary: word, en.
    """
    rows = frames.select("frame_id", "source_domain", "target_domain").join(curated.withColumnRenamed("en", "known"), ["source_domain", "target_domain"], "left")
    for side in ("source", "target"):
        rows = rows.join(dictionary.select(F.col("word").alias(f"{side}_domain"), F.col("en").alias(side)), f"{side}_domain", "left")
    made = F.concat("source", F.lit(" IS "), "target")
    kind = F.when(F.col("known").isNotNull(), "curated").when(made.isNotNull(), "auto_gloss").otherwise("unmapped")
    return rows.select("frame_id", F.coalesce("known", made, F.lit("")).alias("name"), kind.alias("alignment"))
