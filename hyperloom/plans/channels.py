"""Plans over extraction by three channels, and the passes that ask for what the channels need."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.operators import extraction, lineage
from hyperloom.operators.requests import Log

from . import standin as S
from .building import BOUND, joined
from .catalogue import plan
from .standin import sql
from .wording import heuristic

#: Discoveries located and bound, then the edges of all channels; ``judge`` is what a verdict does to the first two.
THREE = """three AS (SELECT d.chunk_id, b.frame_id, [d.trigger] AS triggers, instr(d.text, x.t) - 1 AS low, length(d.text) - length(string_split(d.text, x.t)[-1]) AS high, d.confidence AS conf, 3 AS channel, b.step, d.source_domain, d.target_domain
  FROM d JOIN b ON b.s = d.source_domain AND b.t = d.target_domain, LATERAL (SELECT CASE WHEN d.trigger <> '' AND instr(d.text, d.trigger) > 0 THEN d.trigger ELSE d.source_domain END AS t) x
  WHERE d.confidence >= 0.5 AND instr(d.text, x.t) > 0),
own AS (SELECT DISTINCT frame_id, source_domain, target_domain FROM three WHERE step = 5),
every_frame AS (SELECT s.frame_id, s.ord, s.source_domain, s.target_domain, s.mapping_type, s.source_type, g.ground FROM frame_spec s JOIN ground_of g ON g.frame_id = s.frame_id
  UNION ALL SELECT frame_id, 1073741824, source_domain, target_domain, 'structural', 'GENERIC', CAST([] AS VARCHAR[]) FROM own),
found AS (SELECT chunk_id, frame_id, triggers, low, high, {conf} AS conf, channel FROM (SELECT * FROM one UNION ALL SELECT * FROM two) f JOIN ch USING (chunk_id) WHERE {keep}
  UNION ALL SELECT chunk_id, frame_id, triggers, low, high, conf, channel FROM three),
ranked AS (SELECT f.*, s.source_domain, s.target_domain, s.source_type, s.ground, row_number() OVER (PARTITION BY f.chunk_id, f.frame_id, f.low, f.high ORDER BY f.channel, s.ord, array_to_string(f.triggers, ',')) AS nth
  FROM found f JOIN every_frame s ON s.frame_id = f.frame_id
  WHERE ((s.source_type, s.mapping_type) IN (SELECT (source_type, mapping_type) FROM type_constraint) OR s.source_type = 'GENERIC' AND s.mapping_type = 'structural') AND f.conf >= 0.35
    AND NOT EXISTS (SELECT 1 FROM stop_word x WHERE list_contains(f.triggers, x.word) AND x.exempt <> s.source_domain))
SELECT 'L1_' || left(md5(concat_ws('|', r.chunk_id, r.low::BIGINT, r.high::BIGINT, r.source_domain, r.target_domain)), 8) AS edge_id, r.chunk_id, r.frame_id, m.cascade_id, r.source_domain, r.target_domain, r.low::BIGINT AS low, r.high::BIGINT AS high,
  array_to_string(r.triggers, ',') AS triggers, array_to_string(r.ground, ',') AS ground, round(r.conf, 3) AS confidence, CASE WHEN len(r.triggers) = 1 THEN 'novel' ELSE 'conventional' END AS novelty, r.channel
FROM ranked r LEFT JOIN cascade_member m ON m.frame_id = r.frame_id WHERE r.nth = 1"""


def shown(edges: DataFrame) -> DataFrame:
    places = [F.col(c).cast("long").alias(c) for c in ("low", "high")]
    return edges.select("edge_id", "chunk_id", "frame_id", "cascade_id", "source_domain", "target_domain", *places, joined("triggers"), joined("ground"), "confidence", "novelty", "channel")


def parts(spark: SparkSession) -> tuple[DataFrame, ...]:
    return S.rows_of(spark, S.FIELDS, "field, word"), S.rows_of(spark, [(m,) for m in S.MARKERS], "word"), S.rows_of(spark, S.BRIDGES, "field, frame_id")


def edges(spark: SparkSession, sf_dir: str, discovered: DataFrame | None, verdicts: DataFrame | None = None) -> DataFrame:
    return extraction.extracted(S.chunks(spark, sf_dir), S.frames(spark), S.constraints(spark), S.stops(spark), *parts(spark), discovered, S.RULES, verdicts, S.members(spark))


@plan("three_channel_edges", sql(f"WITH {BOUND}, " + THREE.format(conf="conf", keep="true")))
def three_channel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of all channels; the third has a discovery per chunk, see ``standin.discovered``."""
    return shown(edges(spark, sf_dir, S.discovered(spark, sf_dir)))


@plan("heuristic_edges")
def heuristic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of all channels; the third has the vehicles of comparisons, found by tags."""
    return shown(edges(spark, sf_dir, heuristic(spark, sf_dir, generic=True)))


def discover(texts: Sequence[str]) -> list[list[dict]]:
    """Stands in for a service: a text's first two words are the domains, the third a trigger, its length gives the confidence."""
    out = []
    for t in texts:
        w = [*t.split(" "), "", "", ""][:3]
        out.append([{"source_domain": w[0], "target_domain": w[1], "ground": [], "triggers": [w[2]], "confidence": len(t) % 10 / 10.0}] if w[0] and w[1] else [])
    return out


def judge(requests: Sequence[str]) -> list[dict | None]:
    """Stands in for a service: by a text's length literal (null), figurative with a confidence of its own, or figurative."""
    import json

    sizes = [len(json.loads(r)["text"]) % 3 for r in requests]
    return [None if n == 0 else {"figurative": True, "confidence": 0.9 if n == 1 else None} for n in sizes]


@plan("requested_edges", sql(f"WITH {BOUND}, ".replace("(chunk_no % 10) / 10.0::DOUBLE", "(length(text) % 10) / 10.0::DOUBLE") + THREE.format(conf="CASE WHEN length(text) % 3 = 1 THEN 0.9::DOUBLE ELSE conf END", keep="length(text) % 3 <> 0")))
def requested_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after both passes of requests, whose logs are in the shared folder."""
    base = f"{lineage.folder(spark)}/requests-{uuid.uuid4().hex}"
    logs = [Log(spark, f"{base}/{name}", "stand-in") for name in ("discoveries", "verdicts")]
    found, verdicts = extraction.prefetched(S.chunks(spark, sf_dir).where("text is not null"), S.frames(spark), *parts(spark), discover, judge, *logs)
    return shown(edges(spark, sf_dir, found, verdicts))
