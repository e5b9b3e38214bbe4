"""Plans over corpus readers, segmentation, spectra and significance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.functions import text as fx
from hyperloom.operators import significance, spectra
from hyperloom.sources import readers

from .catalogue import plan
from .folded import read

#: The documents as a tagged file of two blocks each, the second without a sentence.
TAGGED = "concat('<metaphor><Sentence> ', text, ' & </Sentence><Label>', doc_id % 4, '</Label></metaphor><metaphor><Label>1</Label></metaphor>')"


@plan("labelled_blocks", rf"""WITH b AS (SELECT doc_id, unnest(regexp_extract_all({TAGGED}, '(?s)<metaphor>(.*?)</metaphor>', 1)) AS body FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, regexp_replace(regexp_extract(body, '(?s)<Sentence>(.*?)</Sentence>', 1), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS sentence, try_cast(regexp_extract(body, '(?s)<Label>(.*?)</Label>', 1) AS INTEGER) AS label FROM b)
SELECT doc_id, md5(sentence) AS sentence_md5, label FROM s WHERE sentence <> '' AND label IN (0, 1, 2)""")
def labelled_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "documents").select("doc_id", F.expr(TAGGED).alias("value"))
    return readers.labelled_blocks(files, keep=("doc_id",)).select("doc_id", F.md5("sentence").alias("sentence_md5"), "label")


@plan("token_runs", """WITH a AS (SELECT *, lag(event_type) OVER (ORDER BY event_id) AS was, row_number() OVER (ORDER BY event_id) AS rn FROM events),
b AS (SELECT *, sum(CASE WHEN rn = 1 OR was IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (ORDER BY event_id) - 1 AS run FROM a)
SELECT run::BIGINT AS run, arg_min(event_type, event_id) AS "index", arg_min(event_id, event_id)::VARCHAR AS sentence, max(CASE WHEN value > 50 THEN 1 ELSE 0 END)::INTEGER AS label, count(*) AS n_tokens FROM b GROUP BY run""")
def token_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "event_type", F.col("event_id").cast("string").alias("s"), F.when(F.col("value") > 50, 1).otherwise(0).alias("l"))
    return readers.token_runs(events, "event_id", "event_type", "s", "l")


@plan("segment", r"""WITH w AS (SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '(\p{Han})', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS words FROM documents)
SELECT doc_id, len(words)::BIGINT AS n_words, md5(array_to_string(words, '|')) AS words_md5 FROM w""")
def segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select("doc_id", fx.segments(F.col("text")).alias("words"))
    return words.select("doc_id", F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", "|")).alias("words_md5"))


@plan("rank_test", """WITH r AS (SELECT l_returnflag = 'R' AS a, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem),
t AS (SELECT sum(n * n * n - n)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY l_quantity)),
s AS (SELECT count(*) FILTER (a)::DOUBLE AS n1, count(*) FILTER (NOT a)::DOUBLE AS n2, sum(r::DOUBLE) FILTER (a) AS r1, any_value(ties) AS ties FROM r, t),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM s)
SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, round(u, 1) AS u, round((u - n1 * n2 / 2 - CASE WHEN u > n1 * n2 / 2 THEN 0.5 ELSE -0.5 END) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z,
  round(u / (n1 * n2), 6) AS auc, round(2 * u / (n1 * n2) - 1, 6) AS cliff FROM u""")
def rank_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = significance.mann_whitney(read(spark, sf_dir, "lineitem"), "l_quantity", F.col("l_returnflag") == "R")
    return out.select("n1", "n2", F.round("u", 1).alias("u"), *[F.round(c, 6).alias(c) for c in ("z", "auc", "cliff")])


def _incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edge"), F.col("l_partkey").alias("node")).distinct()


@plan("fixed_point")
def fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.lit(0).alias("dim"), F.col("p_retailprice").alias("val"))
    return spectra.fixed_point(_incidence(spark, sf_dir), start)


@plan("spectral_report")
def spectral_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.radius(_incidence(spark, sf_dir))
