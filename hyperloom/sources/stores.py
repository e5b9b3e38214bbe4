"""Readers of SQLite files and of checked graph artifacts."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, key: str = "rowid", parts: int = 8, rows: int = 10_000) -> DataFrame:
    """A table of an SQLite file, read in ranges of an integer key, each range a task of its own.

    ``path`` must be a file every executor can open; it is opened read-only. Names are
    quoted; ``schema`` is the DDL of the columns to read.
    """
    names = spark.createDataFrame([], schema).columns
    quoted = lambda n: '"' + n.replace('"', '""') + '"'
    place = quoted(key) if key != "rowid" else key
    source = f"file:{path}?mode=ro"
    with sqlite3.connect(source, uri=True) as con:
        low, high = con.execute(f"SELECT min({place}), max({place}) FROM {quoted(table)}").fetchone()
    if low is None:
        return spark.createDataFrame([], schema)
    step = max(1, -(-(high - low + 1) // parts))
    ask = f"SELECT {', '.join(map(quoted, names))} FROM {quoted(table)} WHERE {place} >= ? AND {place} < ? ORDER BY {place}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with sqlite3.connect(source, uri=True) as own:
            for frame in frames:
                for i in frame["id"].tolist():
                    cursor = own.execute(ask, (low + i * step, low + (i + 1) * step))
                    while got := cursor.fetchmany(rows):
                        yield pd.DataFrame(got, columns=names)

    return spark.range(0, parts, 1, parts).mapInPandas(run, schema)


def floats(blob: Column) -> Column:
    """Little-endian 32-bit floats of a blob as an array; null where its length is not a multiple of four or a number is not finite."""

    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> np.ndarray | None:
            if b is None or len(b) % 4:
                return None
            v = np.frombuffer(b, "<f4")
            return v if np.isfinite(v).all() else None

        return blobs.map(one)

    return decode(blob)


ARTIFACT = "struct<node_ids:array<bigint>,row_offsets:array<bigint>,targets:array<bigint>,weights:array<double>>"
FIELDS = ("node_ids", "row_offsets", "targets", "weights")
LARGEST = 512 * 1024 * 1024


def problem_of(text: bool, whole: bool, ids: np.ndarray | None, offsets: np.ndarray | None, targets: np.ndarray | None, weights: np.ndarray | None) -> str | None:
    """The first thing that is wrong with a graph. An array with nulls comes as one of floats, its nulls as what is no number."""
    if not text:
        return "not a gzip text"
    if not whole:
        return "checksum differs"
    if any(v is None for v in (ids, offsets, targets, weights)):
        return "a field is missing"
    n = len(ids)
    if not np.all(ids > 0):
        return "ids are not positive"
    if len(np.unique(ids)) != n:
        return "ids repeat"
    if len(offsets) != n + 1 or offsets[0] != 0 or offsets[-1] != len(targets):
        return "offsets do not span the rows"
    if np.any(offsets[1:] < offsets[:-1]):
        return "offsets fall"
    if len(targets) != len(weights):
        return "targets and weights differ in number"
    if not np.all((targets >= 0) & (targets < n)):
        return "a target is out of bounds"
    if not np.all(np.isfinite(weights.astype("float64")) & (weights.astype("float64") >= 0)):
        return "a weight is not finite or negative"
    return None


def decoded(artifacts: DataFrame, largest: int = LARGEST) -> DataFrame:
    """artifact_id, graph, problem: gzip-compressed JSON graphs, each with the first problem found or null.

    ``artifacts``: artifact_id, checksum (lowercase sha256 of the text), payload. ``graph`` holds
    sparse rows: ``row_offsets`` cut ``targets`` and ``weights`` into one row per node.
    """

    def inflate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        def one(b: bytes | None) -> str | None:
            if b is None:
                return None
            try:
                d = zlib.decompressobj(31)
                raw = d.decompress(b, largest + 1)
                return raw.decode() if d.eof and len(raw) <= largest else None
            except (zlib.error, UnicodeDecodeError):
                return None

        for frame in frames:
            yield pd.DataFrame({"artifact_id": frame["artifact_id"], "checksum": frame["checksum"], "json": frame["payload"].map(one)})

    kind = artifacts.schema["artifact_id"].dataType.simpleString()
    rows = artifacts.select("artifact_id", "checksum", "payload").mapInPandas(inflate, f"artifact_id {kind}, checksum string, json string")
    whole = F.sha2(F.col("json").cast("binary"), 256).eqNullSafe(F.col("checksum"))
    rows = rows.select("artifact_id", F.col("json").isNotNull().alias("text"), whole.alias("whole"), F.from_json("json", ARTIFACT).alias("graph"))

    def checked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [problem_of(*row) for row in zip(*(frame[c] for c in ("text", "whole", *FIELDS)), strict=True)]
            yield frame[["artifact_id", *FIELDS]].assign(problem=found)

    # each array goes once through the checks; expressions over the parsed graph parsed it again within their lambdas
    types = "node_ids array<bigint>, row_offsets array<bigint>, targets array<bigint>, weights array<double>"
    rows = rows.select("artifact_id", "text", "whole", *[F.col(f"graph.{c}").alias(c) for c in FIELDS])
    rows = rows.mapInPandas(checked, f"artifact_id {kind}, {types}, problem string")
    return rows.select("artifact_id", F.when(F.col("problem").isNull(), F.struct(*FIELDS)).alias("graph"), "problem")


def arcs(graphs: DataFrame) -> DataFrame:
    """artifact_id, source, target, weight of every stored arc of the graphs without a problem."""
    types = graphs.schema["artifact_id"].dataType.simpleString()

    def unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, ids, offsets, targets, weights in zip(*(frame[c] for c in ("artifact_id", *FIELDS)), strict=True):
                source = np.repeat(ids, np.diff(offsets))
                for at in range(0, len(source), 100_000):
                    cut = slice(at, at + 100_000)
                    yield pd.DataFrame({"artifact_id": key, "source": source[cut], "target": ids[targets[cut]], "weight": weights[cut]})

    # a copy of the graph beside each arc would grow with the square of its size
    g = graphs.where("problem is null").select("artifact_id", *[F.col(f"graph.{c}").alias(c) for c in FIELDS])
    return g.mapInPandas(unpacked, f"artifact_id {types}, source long, target long, weight double")
