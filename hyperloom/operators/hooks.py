"""Calls to outside services (embedders, extractors, judges) as cached, batched maps, and a recurrent encoder."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class FatalReply(RuntimeError):
    """A reply after which no retry and no stand-in is allowed: refused credentials, exhausted quota, wrong count."""


def missing(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct keys the cache does not know. A cached null is a known answer."""
    return keys.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")


def called(keys: DataFrame, key: str, call: Callable[[Sequence[str]], Sequence[object]], answer: str, batch: int = 32) -> DataFrame:
    """key, answer of every row: ``call`` gets up to ``batch`` keys and must give as many answers; null means judged and rejected.

    ``answer`` is the DDL type of an answer. What ``call`` raises ends the query; nothing
    is replaced silently. ``keys`` should be distinct.
    """
    kind = keys.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = frame[key].tolist()
            got: list[object] = []
            for at in range(0, len(asked), batch):
                part = asked[at : at + batch]
                reply = list(call(part))
                if len(reply) != len(part):
                    raise FatalReply(f"{len(part)} keys got {len(reply)} answers")
                got += reply
            yield pd.DataFrame({key: asked, "answer": pd.Series(got, dtype=object)})

    return keys.select(key).mapInPandas(run, f"{key} {kind}, answer {answer}")


def through_cache(rows: DataFrame, key: str, cache_path: str, call: Callable[[Sequence[str]], Sequence[object]], answer: str, batch: int = 32) -> DataFrame:
    """``rows`` with the answers to their keys; only keys the Parquet cache lacks are called for, and they are appended to it.

    Answers are kept when their job commits, so split very large key sets over several calls:
    a later call asks only for what earlier ones did not finish.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, answer {answer}"
    spark.createDataFrame([], schema).write.mode("append").parquet(cache_path)
    known = spark.read.schema(schema).parquet(cache_path)
    called(missing(rows, known, key), key, call, answer, batch).write.mode("append").parquet(cache_path)
    return rows.join(spark.read.schema(schema).parquet(cache_path), key, "left")


FATAL = (401, 402, 403)


def http_call(url: str, wrap: Callable[[Sequence[str]], object], unwrap: Callable[[object], Sequence[object]], headers: dict[str, str] | None = None, tries: int = 3, pause: float = 1.0, timeout: float = 60.0) -> Callable[[Sequence[str]], Sequence[object]]:
    """A ``call`` that posts ``wrap(keys)`` as JSON and gives ``unwrap`` of the JSON reply.

    Refused credentials and exhausted quotas are fatal at once; other failures are tried again
    after a growing pause, then raised.
    """

    def call(part: Sequence[str]) -> Sequence[object]:
        asked = urllib.request.Request(url, json.dumps(wrap(part)).encode(), {"Content-Type": "application/json"} | (headers or {}))
        for left in reversed(range(tries)):
            try:
                with urllib.request.urlopen(asked, timeout=timeout) as reply:
                    return unwrap(json.load(reply))
            except urllib.error.HTTPError as e:
                if e.code in FATAL:
                    raise FatalReply(f"the service answered {e.code}") from e
                if not left:
                    raise
            except OSError:
                if not left:
                    raise
            time.sleep(pause * (tries - left))
        raise ValueError("tries must be positive")

    return call


def http_embedder(url: str, model: str, key: str = "", **options) -> Callable[[Sequence[str]], Sequence[object]]:
    """A ``call`` to an embedding service: posts model and input, takes the vectors in the order of their index."""
    vectors = lambda told: [d["embedding"] for d in sorted(told["data"], key=lambda d: d["index"])]
    return http_call(url, lambda part: {"model": model, "input": list(part)}, vectors, {"Authorization": f"Bearer {key}"} if key else None, **options)


def encode_sequences(rows: DataFrame, group: str, order: str, vector: str, dim: int, seed: int = 1) -> DataFrame:
    """group, state: the last state of an untrained gated recurrent unit that reads a group's vectors in order.

    The weights are normal with a deviation of 1/sqrt(dim), drawn from ``seed`` and the same
    in every task; biases are zero. A group is one sequence, so it is one task's by nature.
    """
    kind = rows.schema[group].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        draw = np.random.default_rng(seed)
        wz, uz, wr, ur, wh, uh = (draw.normal(0, 1 / np.sqrt(dim), (dim, dim)) for _ in range(6))
        squash = lambda v: 1 / (1 + np.exp(-v))
        state = np.zeros(dim)
        for x in frame.sort_values(order, kind="stable")[vector]:
            x = np.asarray(x, dtype=float)
            keep, reset = squash(x @ wz + state @ uz), squash(x @ wr + state @ ur)
            state = (1 - keep) * state + keep * np.tanh(x @ wh + (reset * state) @ uh)
        return pd.DataFrame({group: [frame[group].iloc[0]], "state": [state.tolist()]})

    return rows.select(group, order, vector).groupBy(group).applyInPandas(run, f"{group} {kind}, state array<double>")
