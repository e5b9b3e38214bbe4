"""Plans over replies of language models, on stand-in replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.operators import replies

from . import standin as S
from .catalogue import plan
from .dialect import duck, run
from .folded import read
from .standin import sql


@plan("reply_json", """SELECT event_id, CASE WHEN event_id % 3 < 2 THEN (props->>'k')::VARCHAR END AS k FROM events""")
def reply_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare objects, objects among words, and broken ones."""
    e = read(spark, sf_dir, "events")
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("Sure: "), "props", F.lit(" as asked."))).otherwise(F.concat(F.lit("{"), "props"))
    return e.select("event_id", F.get_json_object(replies.json_of(text), "$.k").alias("k"))


@plan("reply_keys", "SELECT event_id, CASE WHEN user_id % 4 < 3 THEN user_id::INTEGER END AS n FROM events")
def reply_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = read(spark, sf_dir, "events"), F.col("user_id") % 4
    key = F.when(kind == 0, F.concat(F.lit("问题 "), "user_id")).when(kind == 1, F.concat(F.lit(" Q"), "user_id")).when(kind == 2, F.col("user_id").cast("string")).otherwise(F.concat(F.lit("no"), "user_id"))
    return e.select("event_id", replies.key_number(key).alias("n"))


@plan("red_line", sql("""SELECT i.item_id FROM benchmark i JOIN frame_spec s ON s.ord = i.item_id % 8 + 1 WHERE instr(i.text, s.source_domain) = 0 AND instr(i.text, s.target_domain) = 0
  AND NOT EXISTS (SELECT 1 FROM frame_trigger t WHERE t.frame_id = s.frame_id AND instr(i.text, t.trigger) > 0)"""))
def red_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as rewritten questions, which may not name what they were made from."""
    banned = S.frames(spark).select("ord", F.concat("triggers", F.array("source_domain", "target_domain")).alias("banned"))
    rows = read(spark, sf_dir, "benchmark").withColumn("ord", (F.col("item_id") % 8 + 1).cast("int")).join(banned, "ord")
    return replies.within_red_line(rows, "text", "banned").select("item_id")


@plan("complete_judgements", """WITH q AS (SELECT DISTINCT user_id FROM events), c AS (SELECT DISTINCT event_type FROM events), a AS (SELECT user_id, event_type, max(CASE WHEN value > 200 THEN 1 ELSE 0 END)::INTEGER AS v FROM events WHERE value > 150 GROUP BY ALL),
r AS (SELECT q.user_id, c.event_type, a.v, count(*) OVER (PARTITION BY q.user_id) AS n, count(a.v) OVER (PARTITION BY q.user_id) AS got FROM q CROSS JOIN c LEFT JOIN a ON a.user_id = q.user_id AND a.event_type = c.event_type)
SELECT user_id, event_type, coalesce(v, 0)::INTEGER AS v FROM r WHERE 2 * (n - got) <= n""")
def complete_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as questions, event types as candidates (a handful), events of a high value as a judge's answers."""
    e = read(spark, sf_dir, "events")
    asked = e.select("user_id").distinct().join(F.broadcast(e.select("event_type").distinct()))  # a handful of types
    answers = e.where("value > 150").groupBy("user_id", "event_type").agg(F.max((F.col("value") > 200).cast("int")).alias("v"))
    return replies.complete_judgements(asked, answers, "user_id", "event_type", "v")


#: A dictionary of half the first words and all third words, and curated names for pairs that several documents begin with.
DICTIONARY = "SELECT word, concat('EN:', word) AS en FROM (SELECT g1 AS word FROM wide_pair UNION SELECT s FROM wide_pair WHERE substr(md5(s), 1, 1) < '8') x WHERE word <> ''"
CURATED = "SELECT source_domain, target_domain, concat(source_domain, '_', target_domain) AS en FROM wide_spec WHERE support >= 2"
NAMES = f"""SELECT s.frame_id, coalesce(c.en, a.en || ' IS ' || b.en, '') AS name, CASE WHEN c.en IS NOT NULL THEN 'curated' WHEN a.en IS NOT NULL AND b.en IS NOT NULL THEN 'auto_gloss' ELSE 'unmapped' END AS alignment
  FROM wide_spec s LEFT JOIN ({CURATED}) c ON c.source_domain = s.source_domain AND c.target_domain = s.target_domain LEFT JOIN ({DICTIONARY}) a ON a.word = s.source_domain LEFT JOIN ({DICTIONARY}) b ON b.word = s.target_domain"""


@plan("bilingual_names", duck(NAMES))
def bilingual_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.bilingual(run(spark, sf_dir, "SELECT * FROM wide_spec"), run(spark, sf_dir, CURATED), run(spark, sf_dir, DICTIONARY))


@plan("bilingual_coverage", duck(f"SELECT alignment, count(*) AS n FROM ({NAMES}) x GROUP BY alignment"))
def bilingual_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilingual_names(spark, sf_dir).groupBy("alignment").agg(F.count("*").alias("n"))
