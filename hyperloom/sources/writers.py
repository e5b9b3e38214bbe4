"""Writers: statements to a property-graph server in transactions, and a release folder."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.operators.hooks import http_call

BATCH = 200
Post = Callable[[list[str]], object]


def outcome(told: dict) -> list[list]:
    """Rows of each statement of a transaction; what the server reports as errors is raised, as none of it was kept."""
    if faults := [f"{e.get('code')}: {e.get('message')}" for e in told.get("errors") or ()]:
        raise RuntimeError("; ".join(faults))
    return [part["data"] for part in told.get("results", ()) if "data" in part]


def http_poster(url: str, user: str, password: str, database: str = "neo4j", timeout: float = 60.0) -> Post:
    """A ``call`` that posts statements as one transaction, once: a retry could post it twice, so the caller decides on it."""
    wrap = lambda statements: {"statements": [{"statement": s} for s in statements]}
    login = base64.b64encode(f"{user}:{password}".encode()).decode()
    return http_call(f"{url.rstrip('/')}/db/{database}/tx/commit", wrap, outcome, {"Authorization": f"Basic {login}"}, tries=1, timeout=timeout)


def transactions(statements: DataFrame, post: Post, schema_statements: list[str] = (), size: int = BATCH) -> DataFrame:
    """One row per transaction posted: n_statements. Schema statements go first, from the driver, each in a transaction of its own.

    Statements (column ``statement``) must be idempotent, as a lost task posts its batches again;
    a trailing semicolon is cut. Order between partitions is not kept: post nodes before edges.
    """
    bare = lambda s: s.strip().removesuffix(";")
    for s in schema_statements:
        post([bare(s)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[str] = []
        for frame in frames:
            waiting += map(bare, frame["statement"])
            while len(waiting) >= size:
                post(waiting[:size])
                yield pd.DataFrame({"n_statements": [size]})
                waiting = waiting[size:]
        if waiting:
            post(waiting)
            yield pd.DataFrame({"n_statements": [len(waiting)]})

    return statements.where("statement is not null").select("statement").mapInPandas(run, "n_statements long")


def release(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes each table as JSON lines below ``folder`` and returns a manifest, which it writes too: name, n_rows, columns."""
    parts = []
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
        back = df.sparkSession.read.schema(df.schema).json(f"{folder}/{name}")
        parts.append(back.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(",".join(df.columns)).alias("columns")))
    manifest = parts[0]
    for p in parts[1:]:
        manifest = manifest.union(p)
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def gold_queries(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, query_text, gold: the queries with the sorted ids of the chunks that answer them; a query without any has an empty list."""
    gold = hits.groupBy("query_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("found"))
    out = queries.join(gold, "query_id", "left")
    return out.select("query_id", "query_text", F.coalesce("found", F.array().cast(gold.schema["found"].dataType)).alias("gold"))
