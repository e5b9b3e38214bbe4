"""From raw documents to token ids: language, exact copies, near copies, mixture, pieces.

Each stage takes (spark, docs, sf_dir), works on all the rows its predecessor kept and, but
for the last, returns the columns of documents. ``run`` writes each stage as Parquet to
the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import chosen_path, crf, digest_tree, mixing, pieces
from hyperloom.llm.shared import landed, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what is written in a language the labels name; texts without letters or without a leading language go."""
    return crf.accepted(docs, crf.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each set of equal texts."""
    return digest_tree.survivors(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a shingle similarity of 0.8 or more."""
    return chosen_path.survivors(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks, none to three times."""
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens of each whole text."""
    return pieces.encode(docs, keep=("doc_id", "lang", "source")).withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))


STAGES = [("language", language), ("exact copies", exact_copies), ("near copies", near_copies), ("mixture", mixture), ("tokens", tokens)]

#: Language ID and near copies can't be said in SQL; tests run the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
