"""Pairs of vectors that may be near, found in blocks: each pair of blocks is one product of matrices, and only pairs that may count leave it.

The product sums in another order than the measure that decides, so pairs are kept with some slack and measured exactly afterwards.
Vectors are all compared; no pair that counts is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
ROWS = 256
#: More than rounding to six decimals and another order of sums can move a cosine.
SLACK = 4e-6


def cosines(own: list, theirs: list) -> np.ndarray:
    """All cosines of two lists of vectors: 0 for other lengths or zero vectors, not a number where a vector holds what is none."""
    out = np.zeros((len(own), len(theirs)))
    left, right = np.array([len(v) for v in own]), np.array([len(v) for v in theirs])
    for n in set(left.tolist()) & set(right.tolist()):
        i, j = np.flatnonzero(left == n), np.flatnonzero(right == n)
        a, b = (np.array([x[k] for k in at], dtype="float64").reshape(len(at), n) for x, at in ((own, i), (theirs, j)))
        with np.errstate(all="ignore"):
            norm = np.sqrt(np.outer((a * a).sum(1), (b * b).sum(1)))
            out[np.ix_(i, j)] = np.where(norm == 0, 0.0, (a @ b.T) / norm)
    return out


def likely(asked: DataFrame, rows: DataFrame, least: float | None = None, best: int | None = None, block: int = BLOCK) -> DataFrame:
    """a, own, b, theirs: of asked (a, own) and rows (b, theirs) the pairs of different ids whose cosine may be ``least`` or more, or among the ``best`` of a block, ties to the smaller id; and the block.

    Each side is dealt into blocks of about ``block`` rows. Of equal vectors of a block only so many can be among the best, so copies do not multiply.
    """
    sizes = asked.count(), rows.count()
    across, down = (max(1, -(-n // block)) for n in sizes)
    down = max(down, min(sizes[1], rows.sparkSession.sparkContext.defaultParallelism))
    mine = asked.select("a", "own", F.pmod(F.hash("a"), F.lit(across)).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(max(down, 1) - 1))).alias("y"))
    other = rows.select("b", "theirs", F.pmod(F.hash("b"), F.lit(max(down, 1))).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("x"))
    kind = lambda df, c: df.schema[c].dataType.simpleString()

    def first_of_equal(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("b")
        return part[part.groupby(part["theirs"].map(lambda v: np.asarray(v).tobytes())).cumcount() <= best]

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        two = (first_of_equal(two) if best else two).reset_index(drop=True)
        vectors, ids = two["theirs"].tolist(), two["b"].to_numpy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(one) if len(two) else 0, ROWS):
            part = one.iloc[at : at + ROWS]
            s = cosines(part["own"].tolist(), vectors)
            itself = part["a"].to_numpy()[:, None] == ids[None, :]
            if best is None:
                bar = least - SLACK
            else:
                known = np.where(itself | np.isnan(s), -np.inf, s)
                bar = np.partition(known, max(0, s.shape[1] - best), axis=1)[:, max(0, s.shape[1] - best), None] - SLACK
            i, j = np.nonzero(~itself & ((s >= bar) | ~np.isfinite(s)))
            found.append((i + at, j))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.empty(0, "int64") for k in (0, 1))
        return pd.DataFrame({"a": one["a"].to_numpy()[i], "own": one["own"].to_numpy()[i], "b": ids[j], "theirs": two["theirs"].to_numpy()[j], "block": two["y"].to_numpy()[j]})

    schema = f"a {kind(asked, 'a')}, own {kind(asked, 'own')}, b {kind(rows, 'b')}, theirs {kind(rows, 'theirs')}, block int"
    return mine.groupBy("x", "y").cogroup(other.groupBy("x", "y")).applyInPandas(run, schema)
