"""Plans over training pairs: chunks with what they gave and what they did not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.operators import training

from . import standin as S
from .catalogue import plan
from .standin import sql

ARC = 256
HEX = "('0x' || substr(md5({}), 1, 8))::BIGINT"
#: Draws by arc and number; ``arcs`` and numbers are those of the chunks of a frame by digest.
DRAWN = f"""r AS (SELECT DISTINCT edge_id, chunk_id, frame_id FROM edges), ring AS (SELECT frame_id, chunk_id, {HEX.format("frame_id || '|' || chunk_id")} AS place FROM (SELECT DISTINCT frame_id, chunk_id FROM r) x),
n AS (SELECT frame_id, ceil(count(*) / {ARC}) AS arcs FROM ring GROUP BY frame_id), placed AS (SELECT ring.*, floor(place * arcs / 4294967296) AS arc FROM ring JOIN n ON n.frame_id = ring.frame_id),
spots AS (SELECT *, row_number() OVER (PARTITION BY frame_id, arc ORDER BY place, chunk_id) AS nth, count(*) OVER (PARTITION BY frame_id, arc) AS size FROM placed),
draws AS (SELECT r.frame_id, r.edge_id AS positive, r.chunk_id AS own, i AS draw, floor({HEX.format("'42|' || r.edge_id || '|' || i")} * arcs / 4294967296) AS arc, {HEX.format("'42n|' || r.edge_id || '|' || i")} AS turn FROM r JOIN n ON n.frame_id = r.frame_id, range(1, 4) g(i)),
taken AS (SELECT d.frame_id, d.positive, d.own, d.draw, arg_min(s.chunk_id, (s.nth - 1 - d.turn % s.size + s.size) % s.size) AS chunk_id FROM draws d JOIN spots s ON s.frame_id = d.frame_id AND s.arc = d.arc AND s.chunk_id <> d.own GROUP BY ALL),
drawn AS (SELECT t.positive, t.own AS chunk_id, t.draw, arg_min(r.edge_id, ({HEX.format("'42|' || t.positive || '|' || t.draw || '|' || r.edge_id")}, r.edge_id)) AS edge_id FROM taken t JOIN r ON r.frame_id = t.frame_id AND r.chunk_id = t.chunk_id GROUP BY t.positive, t.own, t.draw)"""


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.edges(spark, sf_dir).withColumn("group", F.col("frame_id"))


@plan("train_pairs", sql(f"WITH {DRAWN} SELECT chunk_id, edge_id, 1 AS label, 'produced' AS origin FROM r UNION ALL SELECT chunk_id, edge_id, 0, 'drawn' FROM drawn"))
def train_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge with its chunk, and three drawn edges of its frame from other chunks."""
    return training.chunk_pairs(grouped(spark, sf_dir), arc=ARC)


@plan("weak_pairs", sql(f"""WITH {DRAWN}, room AS (SELECT chunk_id, 3 * count(*) AS room FROM (SELECT DISTINCT chunk_id, edge_id FROM r) x GROUP BY chunk_id),
no AS (SELECT chunk_id, source_domain, target_domain FROM (SELECT chunk_id, ws[1] AS source_domain, ws[2] AS target_domain FROM (SELECT chunk_id, string_split(text, ' ') AS ws FROM ch WHERE length(text) % 3 = 0) x WHERE coalesce(ws[1], '') <> '' AND coalesce(ws[2], '') <> ''
  UNION SELECT chunk_id, ws[2], ws[1] FROM (SELECT chunk_id, string_split(text, ' ') AS ws FROM ch WHERE length(text) % 3 = 0) x WHERE coalesce(ws[1], '') <> '' AND coalesce(ws[2], '') <> '') y JOIN room USING (chunk_id)
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY {HEX.format("'42|' || chunk_id || '|' || source_domain || '|' || target_domain")}, source_domain, target_domain) <= room),
used AS (SELECT chunk_id, count(*) AS used FROM no GROUP BY chunk_id)
SELECT chunk_id, edge_id, 1 AS label, 'produced' AS origin FROM r UNION ALL SELECT chunk_id, 'REF_' || left(md5(chunk_id || '|' || source_domain || '|' || target_domain), 8), 0, 'rejected' FROM no
UNION ALL SELECT chunk_id, edge_id, 0, 'drawn' FROM (SELECT d.chunk_id, d.edge_id, row_number() OVER (PARTITION BY d.chunk_id ORDER BY positive, draw) AS nth, room - coalesce(used, 0) AS left_over FROM drawn d JOIN room ON room.chunk_id = d.chunk_id LEFT JOIN used ON used.chunk_id = d.chunk_id) x WHERE nth <= left_over"""))
def weak_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As train_pairs; a judge rejected the first two words, either way round, of each text whose length is divisible by three."""
    found = S.discovered(spark, sf_dir).join(S.chunks(spark, sf_dir).where(F.length("text") % 3 == 0).select("chunk_id"), "chunk_id")
    rejected = found.select("chunk_id", "source_domain", "target_domain").union(found.select("chunk_id", "target_domain", "source_domain"))
    return training.weak_pairs(grouped(spark, sf_dir), rejected, arc=ARC)


@plan("chain_training_pairs", sql("SELECT a.edge_id AS a, b.edge_id AS b, min(abs(a.chunk_no - b.chunk_no))::INTEGER AS gap FROM edges a JOIN edges b ON a.doc_id = b.doc_id AND a.frame_id = b.frame_id AND a.source_domain = b.source_domain AND a.edge_id <> b.edge_id AND abs(a.chunk_no - b.chunk_no) < 30 WHERE len(list_intersect(a.ground, b.ground)) > 0 GROUP BY a.edge_id, b.edge_id"))
def chain_training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs on one chain; chunk numbers of one source lie some twenty apart, so they may bridge 30."""
    return training.chain_pairs(S.edges(spark, sf_dir), gap=30).select("a", "b", F.col("gap").cast("int").alias("gap"))
