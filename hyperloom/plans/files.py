"""Plans over corpus files and graph documents, on lines made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.sources import files

from . import standin as S
from .catalogue import plan
from .folded import read
from .standin import sql


@plan("csv_samples", "SELECT event_id, trim(event_type || ', ' || props) AS text, (user_id % 3)::INTEGER AS label, user_id % 3 > 0 AS figurative FROM events WHERE user_id % 4 <> 3")
def csv_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as CSV rows: an id, a quoted text with a comma, a label; every fourth user's label is no label."""
    e = read(spark, sf_dir, "events")
    body = F.replace(F.concat(F.col("event_type"), F.lit(", "), F.col("props")), F.lit('"'), F.lit('""'))
    label = F.when(F.col("user_id") % 4 == 3, F.lit("x")).otherwise((F.col("user_id") % 3).cast("string"))
    lines = e.select("event_id", F.concat(F.col("event_id").cast("string"), F.lit(',"'), body, F.lit('",'), label).alias("value"))
    return files.labelled_lines(lines, keep=("event_id",))


@plan("essays", r"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(replace(text, '. ', chr(10) || chr(10)), '\n[\x20\x09]*\n')) AS part FROM documents),
t AS (SELECT doc_id, regexp_replace(part, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body FROM p)
SELECT doc_id, md5(body) AS body_md5, left(split_part(body, chr(10), 1), 24) AS title FROM t WHERE length(body) > 200""")
def essays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sentences end in blank lines."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.replace(F.col("text"), F.lit(". "), F.lit("\n\n")).alias("value"))
    return files.essays(docs, keep=("doc_id",)).select("doc_id", F.md5("body").alias("body_md5"), "title")


@plan("titled_reports", "SELECT doc_id FROM documents WHERE contains(text, 'thatin') ORDER BY doc_id LIMIT 20")
def titled_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the first twenty whose title holds a word."""
    return files.first_titled(read(spark, sf_dir, "documents"), 20, "doc_id", "text", "thatin").select("doc_id")


@plan("concept_dump", "SELECT 'MN_' || p_partkey AS id, coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, CASE WHEN p_size % 3 = 0 THEN p_type END, '') AS source_domain, p_name AS target_domain FROM part")
def concept_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    rows = parts.select(F.col("p_partkey").alias("nth"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("source_cn"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("source"), F.col("p_name").alias("target"))
    return files.concept_dump(rows)


@plan("graph_statements", sql(r"""WITH n AS (SELECT unnest(list_concat([source_domain, target_domain], ground)) AS name FROM edges)
SELECT 0 AS phase, count(DISTINCT name) AS n FROM n UNION ALL SELECT 1, (SELECT count(DISTINCT edge_id) + count(DISTINCT chunk_id) + count(DISTINCT frame_id) FROM edges) + (SELECT count(DISTINCT cascade_id) FROM cascade_member WHERE frame_id IN (SELECT frame_id FROM edges))
UNION ALL SELECT 2, (SELECT count(DISTINCT edge_id) * 3 + count(DISTINCT (edge_id, chunk_id)) FROM edges) + (SELECT count(DISTINCT (edge_id, g)) FROM (SELECT edge_id, unnest(ground) AS g FROM edges) x) + (SELECT count(*) FROM cascade_member WHERE frame_id IN (SELECT frame_id FROM edges))"""))
def graph_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.graph_statements(S.edges(spark, sf_dir), S.members(spark)).groupBy("phase").agg(F.count("*").alias("n"))


@plan("graph_json", sql("""SELECT 'edges' AS part, edge_id AS id, len(ground)::INTEGER AS n FROM edges UNION ALL SELECT 'frames', frame_id, count(*)::INTEGER FROM edges GROUP BY frame_id
UNION ALL SELECT 'cascades', cascade_id, count(*)::INTEGER FROM cascade_member WHERE frame_id IN (SELECT frame_id FROM edges) GROUP BY cascade_id"""))
def graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document of the graph says of its members, read back from its text."""
    rows = files.graph_json(S.edges(spark, sf_dir), S.members(spark))
    read_back = F.from_json("document", "ground array<string>, member_mapping_ids array<string>, member_frame_ids array<string>")
    n = F.size(F.coalesce(F.col("d.ground"), F.col("d.member_mapping_ids"), F.col("d.member_frame_ids")))
    return rows.withColumn("d", read_back).select("part", "id", n.alias("n"))
