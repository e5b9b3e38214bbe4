"""Nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample (``SAMPLE`` vectors by hash of the id): each node
splits its vectors among ``BRANCH`` centres until ``LEAF`` or fewer are left. Every vector
of the table is then sent down to the nearest leaf. A query walks the tree through a
priority queue of nodes ordered by their centres' distance, and visits the leaves in
the order they come out. How many leaves it takes is calibrated: on the sample, visits
are widened until the recall against brute force reaches ``RECALL``; a query also goes
on until its leaves hold enough rows to fill its answer.

The tree is bounded by the sample, so it goes along with the tasks; vectors and queries
meet by leaf. A leaf with more than ``BLOCK`` vectors or queries is dealt over a grid of
blocks, so a leaf with a third of all rows is searched by many tasks. Each task keeps
the best ``k`` of its block, and the answers are merged per query.

Distances are computed from the original components in double precision. What is so
large or so small that its square leaves the range of numbers is first scaled by a power of
two, which changes no digit.

Vectors that are null, zero, of another length than most (there is no distance to those),
or that hold null or non-finite components take no part, neither do rows without an id,
which an answer could not name. Of rows that repeat an id, the one with the smallest
vector, component by component, stands for all. Ties go to the smaller id. If fewer than
``k`` candidates exist, all are returned; an empty table gives an empty result; columns that
are not named are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import landed, ship

SAMPLE = 16_384
BRANCH = 8
LEAF = 64
BLOCK = 8_192
RECALL = 0.95
MOST_TRIED = 256


def usable(v: Column) -> Column:
    d = lambda x: x.cast("double")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(d(x)) & (F.abs(d(x)) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


class Tree:
    """Nodes in arrays: centre, children (empty for a leaf), leaf number."""

    def __init__(self, sample: np.ndarray):
        self.centres: list[np.ndarray] = [sample.mean(0)]
        self.children: list[list[int]] = [[]]
        self.leaf: list[int] = [-1]
        self.leaves = 0
        self.split(0, sample)

    def split(self, node: int, own: np.ndarray) -> None:
        if len(own) <= LEAF or (own == own[0]).all():
            self.leaf[node] = self.leaves
            self.leaves += 1
            return
        centres = own[np.linspace(0, len(own) - 1, min(BRANCH, len(own))).astype(int)]
        for _ in range(8):
            near = nearest(own, centres)
            centres = np.array([own[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        near = nearest(own, centres)
        parts = [c for c in range(len(centres)) if (near == c).any()]
        if len(parts) < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
            return
        for c in parts:
            self.centres.append(centres[c])
            self.children.append([])
            self.leaf.append(-1)
            self.children[node].append(len(self.centres) - 1)
        for child, c in zip(list(self.children[node]), parts, strict=True):
            self.split(child, own[near == c])

    def ready(self) -> Tree:
        self.stacked = [np.array([self.centres[c] for c in kids]) if kids else None for kids in self.children]
        return self

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            near = nearest(x[rows], self.stacked[node])
            todo += [(kid, rows[near == c]) for c, kid in enumerate(self.children[node]) if (near == c).any()]
        return out

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                yield self.leaf[node]
                continue
            for d, kid in zip(((self.stacked[node] - q) ** 2).sum(1).tolist(), kids, strict=True):
                heapq.heappush(queue, (d, kid))

    def visits(self, q: np.ndarray, least: int, held: np.ndarray, wanted: int) -> list[int]:
        out, rows = [], 0
        for leaf in self.walk(q):
            if held[leaf]:
                out.append(leaf)
                rows += held[leaf]
            if len(out) >= least and rows >= wanted:
                break
        return out


def scale_of(most: float) -> float:
    """A power of two to divide by: 1 unless squares of components up to ``most`` leave the range of doubles."""
    return 1.0 if 1e-100 < most < 1e100 else 2.0 ** math.frexp(most)[1] if most else 1.0


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * (x @ centres.T)).argmin(1)


def calibrated(tree: Tree, sample: np.ndarray, k: int, recall: float = RECALL) -> tuple[int, float]:
    """The least number of leaf visits that reaches the recall on the sample, doubling, and the recall there."""
    leaf = tree.assign(sample)
    tried = np.linspace(0, len(sample) - 1, min(MOST_TRIED, len(sample))).astype(int)
    truth, order = [], []
    for i in tried:
        d = ((sample - sample[i]) ** 2).sum(1)
        d[i] = np.inf
        truth.append(np.argsort(d, kind="stable")[: min(k, len(sample) - 1)])
        order.append({b: n for n, b in enumerate(tree.walk(sample[i]))})
    depth = np.sort(np.array([order[n][leaf[j]] for n, t in enumerate(truth) for j in t]))
    if not len(depth):
        return 1, 1.0
    n = 1
    while n < tree.leaves and np.searchsorted(depth, n) / len(depth) < recall:
        n = max(n + 1, n * 5 // 4)
    n = min(n, tree.leaves)
    return n, float(np.searchsorted(depth, n) / len(depth))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> pa.Table:
    """The k nearest of each query within a block of distinct ids: exact distances of all that could be among them."""
    near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    unit = scale_of(max(np.abs(x).max(initial=0.0), np.abs(q).max(initial=0.0)))
    q, x = q / unit, x / unit
    norms = (x**2).sum(1)
    slack = 4 * (x.shape[1] + 8) * np.finfo(float).eps  # twice the relative error of a sum of as many products
    for lo in range(0, len(q), 256):
        part = q[lo : lo + 256]
        own_norms = (part**2).sum(1)
        rough = own_norms[:, None] + norms[None, :] - 2 * (part @ x.T)
        for row, own, norm, me in zip(rough, part, own_norms, q_ids[lo : lo + 256], strict=True):
            other = ids != me
            may = np.flatnonzero(other)
            if len(may) > k:  # what may be among the k nearest once the cancellation of large norms is allowed for
                wrong = slack * (norm + norms)
                edge = np.partition((row + wrong)[other], k - 1)[k - 1]
                may = np.flatnonzero(other & (row - wrong <= edge))
            d = np.sqrt(((x[may] - own) ** 2).sum(1)) * unit
            at = np.lexsort((ids[may], d))[:k]
            near.append((np.full(len(at), me), ids[may][at], d[at]))
    cols = [np.concatenate(c) for c in zip(*near, strict=True)] if near else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})


def search(vectors: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    most = F.max(F.array_max(F.transform("v", F.abs)))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), most.alias("most")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, unit = sizes[0].d, scale_of(sizes[0].most)
    rows = rows.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))  # before the tree, so leaves, blocks and counts hold distinct ids
    rows = landed(rows, "vectors")
    picked = rows.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample).toPandas()
    known = np.array(picked["v"].tolist()) / unit
    tree = Tree(known).ready()
    least, _ = calibrated(tree, known, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.assign(matrix(batch.column(1), dim) / unit)
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), *batch.columns], ["leaf", "vec_id", "v"])

    placed = landed(rows.select("vec_id", "v").mapInArrow(assign, "leaf int, vec_id long, v array<double>"), "placed")
    held = np.zeros(tree.leaves, dtype=np.int64)
    for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # one row per leaf
        held[r.leaf] = r.n

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(leaf, i, v) for i, v in zip(frame["vec_id"], frame["v"], strict=True) for leaf in tree.visits(np.asarray(v) / unit, least, held, k + 1)]
            yield pd.DataFrame(out, columns=["leaf", "query_id", "q"])

    asked = rows.where(F.col("vec_id") % every == 0).mapInPandas(walk, "leaf int, query_id long, q array<double>")
    asking = {r.leaf: r.n for r in asked.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one row per leaf
    tall = [int(max(1, -(-n // BLOCK))) for n in held]
    wide = [max(1, -(-asking.get(i, 0) // BLOCK)) for i in range(tree.leaves)]
    of = lambda sizes: F.element_at(F.array(*[F.lit(x) for x in sizes]), F.col("leaf") + 1)
    many = of(tall) if max(tall) > 1 else F.lit(1)
    broad = of(wide) if max(wide) > 1 else F.lit(1)
    span = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = placed.withColumn("i", F.pmod(F.xxhash64("vec_id"), many).cast("int")).withColumn("j", span(broad))
    right = asked.withColumn("j", F.pmod(F.xxhash64("query_id"), broad).cast("int")).withColumn("i", span(many))

    def meet(own: pa.Table, queries: pa.Table) -> pa.Table:
        if not own.num_rows or not queries.num_rows:
            return best(np.zeros((0, dim)), np.zeros(0, np.int64), np.zeros((0, dim)), np.zeros(0, np.int64), k)
        return best(matrix(queries["q"], dim), queries["query_id"].to_numpy(), matrix(own["v"], dim), own["vec_id"].to_numpy(), k)

    keys = ["leaf", "i", "j"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
