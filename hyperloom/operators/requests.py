"""A log of requests to outside services that survives what breaks a pass.

A pass asks only for keys the log lacks: distinct keys, less those the log has, by an anti join on a digest. What is missing is
written once, in the order of a slot that the digest gives; consecutive slots make rounds of up to ``round_size`` keys. Each round is one Spark
job that reads its slots, appends its answers to the log and commits when it ends, so a pass that breaks, or a driver that dies, loses the round at work and nothing before it. In a round a task makes at most
``batches_per_task`` calls of ``batch`` keys: an executor lost in mid-task asks that task's keys again, and no others.
``lost`` says how many keys a broken pass had sent at most without keeping the answers.

An answer may be null: asked, and judged so. A key without a row was never asked. The log holds the name of the model that
answered; answers of other models are not taken (``strict`` raises if there are any). A batch of which every answer is
empty is asked again, once whole and once in halves, as an outage looks like that.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .hooks import FatalReply


#: Keys are dealt to so many slots; a round takes whole ones.
SLOTS = 65_536


class OtherModel(RuntimeError):
    """The log was written by another model than the one in use."""


def dropped(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def digest_of(request: Column) -> Column:
    return F.unhex(F.sha2(request.cast("binary"), 256))


def rounds_of(sizes: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """first slot, last slot, keys of each round: consecutive slots with no more than ``most`` keys together, or a single one that has more."""
    out: list[tuple[int, int, int]] = []
    for slot in sorted(sizes):
        if out and out[-1][2] + sizes[slot] <= most:
            out[-1] = (out[-1][0], slot, out[-1][2] + sizes[slot])
        else:
            out.append((slot, slot, sizes[slot]))
    return out


def empty(answer: object) -> bool:
    return answer is None or hasattr(answer, "__len__") and len(answer) == 0


def careful(call: Callable[[Sequence[str]], Sequence[object]], keys: Sequence[str]) -> list[object]:
    """The answers of one batch; a wholly empty one of several keys is asked again, then in halves."""

    def asked(part: Sequence[str]) -> list[object]:
        reply = list(call(part))
        if len(reply) != len(part):
            raise FatalReply(f"{len(part)} keys got {len(reply)} answers")
        return reply

    reply = asked(keys)
    if len(keys) > 1 and all(map(empty, reply)):
        reply = asked(keys)
        if all(map(empty, reply)):
            half = len(keys) // 2
            reply = asked(keys[:half]) + asked(keys[half:])
    return reply


class Log:
    def __init__(self, spark: SparkSession, path: str, model: str, batch: int = 20, batches_per_task: int = 10, round_size: int = 20_000, strict: bool = False):
        self.spark, self.path, self.model, self.strict = spark, path.rstrip("/"), model, strict
        self.batch, self.batches_per_task, self.round_size = batch, batches_per_task, round_size
        self.lost = 0

    def _schema(self, answer: str) -> str:
        return f"digest binary, request string, model string, answer {answer}, asked_at timestamp"

    def _kept(self, answer: str) -> DataFrame | None:
        """All rows of the log; None if nothing was ever kept."""
        try:
            return self.spark.read.schema(self._schema(answer)).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def rows(self, answer: str) -> DataFrame:
        """request, digest, answer of this model: of keys answered twice the later answer."""
        kept = self._kept(answer)
        all_rows = self.spark.createDataFrame([], self._schema(answer)) if kept is None else kept
        if self.strict and (other := all_rows.where(F.col("model") != self.model).select("model").first()):
            raise OtherModel(f"the log at {self.path} holds answers of {other.model}, not of {self.model}")
        mine = all_rows.where(F.col("model") == self.model)
        return mine.groupBy("digest").agg(F.max_by("request", "asked_at").alias("request"), F.max_by(F.struct("answer"), "asked_at").alias("a")).select("digest", "request", F.col("a.answer").alias("answer"))

    def _open(self, keys: DataFrame, answer: str) -> DataFrame:
        """request, digest of the keys that were never asked, as often as they come. Without a log nothing is joined."""
        request = F.col(keys.columns[0])
        rows = keys.where(request.isNotNull()).select(request.alias("request")).withColumn("digest", digest_of(F.col("request")))
        return rows if self._kept(answer) is None else rows.join(self.rows(answer).select("digest"), "digest", "left_anti")

    def missing(self, keys: DataFrame, answer: str) -> DataFrame:
        """request, digest of the keys that were never asked. A null key is none."""
        return self._open(keys, answer).select("request", "digest").distinct()

    def ask(self, keys: DataFrame, call: Callable[[Sequence[str]], Sequence[object]], answer: str) -> None:
        """Asks for what is missing; ``rows`` then has an answer to every key. What ``call`` raises ends the pass."""
        todo = f"{self.path}.open-{uuid.uuid4().hex}"
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        slot = F.pmod(F.xxhash64("digest"), F.lit(SLOTS)).cast("int")
        dealt = self._open(keys, answer).withColumn("slot", slot).withColumn("part", F.floor(F.col("slot") * parts / SLOTS).cast("int"))
        # the requests, which may be long, are shuffled once: equal ones meet where they are written
        once = dealt.repartition(parts, "part").groupBy("part", "slot", "digest").agg(F.first("request").alias("request"))
        try:
            once.sortWithinPartitions("part", "slot").write.partitionBy("part").parquet(todo)
            kept = self.spark.read.schema("slot int, digest binary, request string, part int").parquet(todo)
            sizes = Counter({r.slot: r["count"] for r in kept.groupBy("slot").count().collect()})
            for first, last, n in rounds_of(sizes, self.round_size):
                here = F.col("slot").between(first, last) & F.col("part").between(first * parts // SLOTS, last * parts // SLOTS)
                self.lost = n
                self._ask(kept.where(here), call, answer, n)
                self.lost = 0
        finally:
            dropped(self.spark, todo)

    def answered(self, keys: DataFrame, call: Callable[[Sequence[str]], Sequence[object]], answer: str) -> DataFrame:
        """request, answer of every key, see ``ask``."""
        self.ask(keys, call, answer)
        request = F.col(keys.columns[0])
        wanted = keys.where(request.isNotNull()).select(digest_of(request).alias("digest")).distinct()
        return wanted.join(self.rows(answer), "digest").select("request", "answer")

    def _ask(self, part: DataFrame, call: Callable[[Sequence[str]], Sequence[object]], answer: str, size: int) -> None:
        batch, model = self.batch, self.model

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:  # one table of answers for the batches of a frame, as each table costs a conversion
                requests, answers, times = frame["request"].tolist(), [], []
                for lo in range(0, len(requests), batch):
                    some = requests[lo : lo + batch]
                    answers += careful(call, some)
                    times += [pd.Timestamp.now("UTC")] * len(some)
                yield pd.DataFrame({"digest": frame["digest"], "request": requests, "model": model, "answer": pd.Series(answers, dtype=object), "asked_at": times})

        tasks = -(-size // (self.batch * self.batches_per_task))
        dealt = part.select("digest", "request").repartition(tasks, "digest")
        dealt.mapInPandas(run, self._schema(answer)).write.mode("append").parquet(self.path)


def discovery_file(spark: SparkSession, path: str) -> DataFrame:
    """request, answer of a cache file that is one JSON object from text to a list of discoveries."""
    item = "array<struct<source_domain:string,target_domain:string,ground:array<string>,triggers:array<string>,confidence:double>>"
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{item}>")).alias("request", "answer"))


def verdict_file(spark: SparkSession, path: str) -> DataFrame:
    """text, source_domain, target_domain, figurative, confidence, ground of a cache file: a JSON list of pairs, key (three strings) and verdict; a null verdict says literal."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("pair"))
    both = pairs.select(F.from_json("pair", "array<string>").alias("p")).select(F.from_json(F.get("p", F.lit(0)), "array<string>").alias("k"), F.from_json(F.get("p", F.lit(1)), "is_metaphor boolean, confidence double, ground array<string>").alias("v"))
    key = lambda i: F.get("k", F.lit(i))
    return both.select(key(0).alias("text"), key(1).alias("source_domain"), key(2).alias("target_domain"), F.coalesce("v.is_metaphor", F.lit(False)).alias("figurative"), F.col("v.confidence").alias("confidence"), "v.ground")


def from_file(log: Log, rows: DataFrame) -> None:
    """Puts the request and answer of a cache file into a log, as answers of its model."""
    rows.select(digest_of(F.col("request")).alias("digest"), "request", F.lit(log.model).alias("model"), "answer", F.current_timestamp().alias("asked_at")).write.mode("append").parquet(log.path)
