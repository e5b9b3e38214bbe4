"""Exact dedup by a tree-merge of sorted digest runs.

Every task sorts its documents by digest into a run: one entry per text, with the best
row and the number of rows seen. Tasks are the leaves of a tree in which ``FAN`` nodes
meet in one, round by round, until a single run is left. A run is stored as consecutive
slices of the digests' range, one row each, so that in a round a node's runs are
exchanged slice by slice: the slices of one range go to one task, which merges them in
a single multiway pass and keeps, per text, the smallest identifier (most code points,
then smallest id) and the sum of the counts. There are so many slices that one holds
about ``SLICE`` entries, so the last rounds are as parallel as the first and memory is bounded.
A text of a third of all rows is one entry per run, so no task ever reads its copies.

Entries are merged only if the digest, the normalised length and a second, unrelated hash
agree; that is the verification at every level. Back at the rows, texts of more than a
thousandth of them (fewer than a thousand texts) are looked up in a broadcast table, the others by a join.

Texts are equal when identical after deleting white space; they are digested whole, however
long. Null text is empty. Of rows that agree in text and id, one is kept. Null ids sort after
all others; ids may have any type that sorts. An empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BLANKS, cut, ship

FAN = 16
#: Rows of a run at most; a task of more makes several.
RUN = 200_000
#: Entries of a slice, about.
SLICE = 20_000
#: Texts of more than this share of all rows are joined by broadcast: fewer than 1,000.
HOT = 1_000

#: digest, check, norm_bytes, short (minus the code points), no_id, doc_id, row, n: sorted, the first of a text is the one to keep.
Entry = tuple


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_points of the original text, digest, and the check that verifies it."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("n_points"), normalised(F.col(text)).alias("norm"))
    return rows.select("doc_id", "n_points", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"), F.xxhash64("norm").alias("check"), F.octet_length("norm").alias("norm_bytes"))


def combined(entries: Iterable[Entry]) -> Iterator[Entry]:
    """Of sorted entries one per text, if the digest, the check and the length agree: the first, with the sum of the counts."""
    held, n = None, 0
    for e in entries:
        if held is not None and e[:3] == held[:3]:
            n += e[7]
            continue
        if held is not None:
            yield (*held[:7], n)
        held, n = e, e[7]
    if held is not None:
        yield (*held[:7], n)


def sliced(run: Iterable[Entry], slices: int) -> Iterator[tuple[int, bytes]]:
    """A run as consecutive slices of the digests' range."""
    part: list[Entry] = []
    now = 0
    for e in run:
        at = int.from_bytes(e[0][:4], "big") * slices >> 32
        if at != now and part:
            yield now, pickle.dumps(part, protocol=5)
            part = []
        now = at
        part.append(e)
    if part:
        yield now, pickle.dumps(part, protocol=5)


SLICES = "node int, slice int, run binary"


def boxed(out: Iterable[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for node, at, run in out:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([at], pa.int32()), pa.array([run], pa.binary())], ["node", "slice", "run"])


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    """The slices of each node and range, which arrive side by side."""
    key, held = None, []
    for batch in batches:
        for node, at, run in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if key != (node, at):
                if held:
                    yield *key, held
                key, held = (node, at), []
            held.append(run)
    if held:
        yield *key, held


def merged(rows: DataFrame) -> DataFrame:
    """One entry per distinct text of the rows of ``digests`` numbered by ``row``: digest, check, norm_bytes, keep_id, keep_row, n."""
    ship(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType
    total, lanes = rows.agg(F.count("*"), F.coalesce(F.max(F.shiftright("row", 33)), F.lit(0)) + 1).first()
    rounds = []
    while not rounds or lanes > 1:
        lanes = -(-lanes // FAN)
        rounds.append(max(1, -(-total // (lanes * SLICE))))  # slices of each node's run after this round

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Entry] = []

        def run() -> Iterator[pa.RecordBatch]:
            node = (held[0][6] >> 33) // FAN if held else 0  # a row's number begins with the task that wrote it
            held.sort(key=lambda e: e[:7])
            yield from boxed((node, at, x) for at, x in sliced(combined(held), rounds[0]))
            held.clear()

        for batch in batches:
            held.extend((*e, 1) for e in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            if len(held) >= RUN:
                yield from run()
        yield from run()

    def merging(slices: int):  # noqa: ANN202
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for node, _, runs in by_group(batches):
                whole = combined(heapq.merge(*map(pickle.loads, runs)))
                yield from boxed((node // FAN, at, x) for at, x in sliced(whole, slices))

        return merge

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, runs in by_group(batches):
            whole = list(combined(heapq.merge(*map(pickle.loads, runs))))
            cols = list(zip(*whole, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[5], arrow_kind), pa.array(cols[6], pa.int64()), pa.array(cols[7], pa.int64())], ["digest", "check", "norm_bytes", "keep_id", "keep_row", "n"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(kind)
    entries = rows.select("digest", "check", "norm_bytes", (-F.col("n_points")).alias("short"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    exchange = lambda runs: runs.repartition("node", "slice").sortWithinPartitions("node", "slice")
    runs = exchange(entries.mapInArrow(sorted_runs, SLICES))
    for slices in rounds[1:]:
        runs = exchange(runs.mapInArrow(merging(slices), SLICES))
    return runs.mapInArrow(last, f"digest binary, check long, norm_bytes int, keep_id {kind.simpleString()}, keep_row long, n long")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = cut(digests(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()))  # written once, so the numbers stay
    key = ["digest", "check", "norm_bytes"]
    groups = cut(merged(rows).where("n > 1"))
    hot = F.broadcast(groups.where(F.col("n") * HOT > rows.count()))  # fewer than HOT rows
    many = rows.join(hot, key)
    few = rows.join(hot.select(*key), key, "left_anti").join(groups, key, "left")
    out = many.select(*few.columns).union(few)
    lone = F.col("n").isNull()
    return out.select(
        "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (lone | (F.col("keep_row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows that stay, one per distinct text, with all their columns.

    The kept row is found by id and text together, so rows that share an id but not a
    text are told apart; of wholly repeated rows one stays.
    """
    id_key = lambda c: F.coalesce(c.cast("string"), F.lit("none")).alias("id_key")
    verdict = dedup(docs, doc_id, text).where("kept").select(id_key(F.col("doc_id")), F.col("text_sha256").alias("sha"))
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("whole"), id_key(F.col(doc_id)), F.sha2(normalised(F.col(text)).cast("binary"), 256).alias("sha"), F.coalesce(F.length(text), F.lit(0)).alias("n_points"))
    nth = F.row_number().over(Window.partitionBy("id_key", "sha").orderBy(F.col("n_points").desc()))
    return whole.join(verdict, ["id_key", "sha"]).withColumn("nth", nth).where("nth = 1").select("whole.*")
