"""Edges by all three channels, and the two passes that ask outside services for what the channels need.

Pass one asks for discoveries of every chunk. The candidates of the first two channels, and nothing else, then say which
(chunk, frame) pairs need a verdict; pass two asks for those. Answers are kept in request logs, so a pass that broke goes on
where it stopped, and a finished one asks nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import build, lineage
from .requests import Log, digest_of

COLUMNS = ["chunk_id", "frame_id", "triggers", "spans", "conf", "channel", "low", "high"]
DISCOVERY = "array<struct<source_domain:string,target_domain:string,ground:array<string>,triggers:array<string>,confidence:double>>"
VERDICT = "struct<figurative:boolean,confidence:double>"


def known_candidates(chunks: DataFrame, frames: DataFrame, fields: DataFrame, markers: DataFrame, bridges: DataFrame) -> DataFrame:
    """What the trigger and field channels find: their candidates need a judge, if there is one."""
    one, two = build.trigger_channel(chunks, frames), build.field_channel(chunks, fields, markers, bridges)
    return one.select(COLUMNS).unionByName(two.select(COLUMNS))


def open_candidates(chunks: DataFrame, discovered: DataFrame, frames: DataFrame, rules: list[tuple[str, list[str]]], least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Located discoveries bound to frames, and the frames of their own that those get which no frame of the ontology takes.

    Ids of such frames are short, so two pairs of domains can share one. The id then stands for both, and a discovery says which is its own (own_source, own_target).
    """
    found = build.bind_frames(build.open_channel(chunks, discovered, least), frames, rules)
    grounds = found if "ground" in found.columns else found.withColumn("ground", F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    own = grounds.where("not known").groupBy("frame_id", "source_domain", "target_domain").agg(F.coalesce(F.min("ground"), none).alias("ground"))
    own = own.select("frame_id", F.lit(2**30).alias("ord"), "source_domain", "target_domain", F.lit("structural").alias("mapping_type"), F.lit(build.GENERIC).alias("source_type"), "ground")
    mine = [F.when(~F.col("known"), F.col(f"{c}_domain")).alias(f"own_{c}") for c in ("source", "target")]
    return build.spanned(found).select("chunk_id", "frame_id", "triggers", "spans", F.col("confidence").alias("conf"), F.lit(3).alias("channel"), "low", "high", *mine), own


def extracted(
    chunks: DataFrame, frames: DataFrame, constraints: DataFrame, stops: DataFrame | None, fields: DataFrame, markers: DataFrame, bridges: DataFrame,
    discovered: DataFrame | None = None, rules: Sequence[tuple[str, list[str]]] = (), verdicts: DataFrame | None = None, cascades: DataFrame | None = None, least: float = 0.35, open_least: float = 0.5,
) -> DataFrame:
    """Edges of the three channels. Verdicts judge the candidates of the first two; discoveries come judged and have a threshold of their own.

    Of candidates with one frame and extent in a chunk the first channel's stays. Types of discoveries without a frame are generic, which is always allowed.
    """
    found = build.refined(known_candidates(chunks, frames, fields, markers, bridges), verdicts, ["chunk_id", "frame_id"])
    names = ["frame_id", "ord", "source_domain", "target_domain", "mapping_type", "source_type", "ground"]
    all_frames = frames.select(names)
    if discovered is not None:
        three, own = open_candidates(chunks, discovered, frames, list(rules), open_least)
        found, all_frames = found.unionByName(three, allowMissingColumns=True), all_frames.unionByName(own)
    allowed = constraints.select("source_type", "mapping_type").union(constraints.sparkSession.sql(f"SELECT '{build.GENERIC}', 'structural'"))
    return build.emitted(found, all_frames, chunks, allowed, stops, least, cascades)


def prefetched(
    chunks: DataFrame, frames: DataFrame, fields: DataFrame, markers: DataFrame, bridges: DataFrame,
    discover: Callable[[Sequence[str]], Sequence[object]], judge: Callable[[Sequence[str]], Sequence[object]], discoveries: Log, verdicts: Log,
) -> tuple[DataFrame, DataFrame]:
    """Both passes: discovered (chunk_id, source_domain, ..., confidence) and verdicts (chunk_id, frame_id, figurative, judged).

    ``discover`` gets texts, ``judge`` gets JSON of text, source and target domain; equal requests are made once. A null verdict says literal.
    """
    texts = chunks.select("chunk_id", F.col("text").alias("request"))
    discoveries.ask(texts.select("request"), discover, DISCOVERY)
    # answers meet their chunks and pairs by digests, so no text is shuffled for that
    said = lambda rows, log, answer: rows.withColumn("digest", digest_of(F.col("request"))).drop("request").join(log.rows(answer).select("digest", "answer"), "digest")
    found = said(texts, discoveries, DISCOVERY).select("chunk_id", F.explode("answer").alias("d")).select("chunk_id", "d.*")
    pairs = lineage.cut(known_candidates(chunks, frames, fields, markers, bridges).select("chunk_id", "frame_id").distinct())
    asked = pairs.join(frames.select("frame_id", "source_domain", "target_domain"), "frame_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    asked = asked.select("chunk_id", "frame_id", F.to_json(F.struct("text", "source_domain", "target_domain")).alias("request"))
    verdicts.ask(asked.select("request"), judge, VERDICT)
    judged = said(asked, verdicts, VERDICT)
    return found, judged.select("chunk_id", "frame_id", F.coalesce("answer.figurative", F.lit(False)).alias("figurative"), F.col("answer.confidence").alias("judged"))
