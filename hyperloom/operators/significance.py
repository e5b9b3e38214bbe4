"""Rank tests over distributed samples and the tail probabilities they need."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks are summed in so many pieces, each by its own task; the result does not depend on it.
PIECES = 64


def rank_sums(df: DataFrame, value: str, first: Column) -> DataFrame:
    """One row: n1, n2, r1 (rank sum of the rows where ``first`` holds, ties at their mean) and ties (sum of t**3 - t).

    Equal values are counted before anything is ordered. Cut points part the values among
    tasks; a running sum over one row per piece joins them. Null values take no part.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.sum(F.when(first, 1).otherwise(0)).alias("a"), F.count("*").alias("n"))
    cuts = counts.agg(F.percentile_approx("v", [i / PIECES for i in range(1, PIECES)])).first()[0] or []
    piece = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col("v"))) if cuts else F.lit(0)
    counts = counts.withColumn("piece", piece)
    line = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy("piece").agg(F.sum("n").alias("n")).select("piece", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("start"))
    inside = Window.partitionBy("piece").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("below", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(starts), "piece")  # PIECES rows at most
    n = F.col("n").cast("double")
    rank = F.col("start") + F.col("below") + (n + 1) / 2
    return ranked.agg(F.sum("a").alias("n1"), F.sum(F.col("n") - F.col("a")).alias("n2"), F.sum(F.col("a") * rank).alias("r1"), F.sum(n * n * n - n).alias("ties"))


def mann_whitney(df: DataFrame, value: str, first: Column) -> DataFrame:
    """One row: u, z (tie and continuity corrected; null without variance), auc, cliff."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    every = n1 + n2
    out = rank_sums(df, value, first).withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    spread = n1 * n2 / 12 * ((every + 1) - F.col("ties") / F.when(every > 1, every * (every - 1)))
    off = F.col("u") - n1 * n2 / 2
    z = (off - F.when(off > 0, 0.5).otherwise(-0.5)) / F.sqrt(F.when(spread > 0, spread))
    auc = F.col("u") / F.when(n1 * n2 > 0, n1 * n2)
    return out.select("n1", "n2", "u", z.alias("z"), auc.alias("auc"), (2 * auc - 1).alias("cliff"))


def normal_tails(z: float) -> float:
    """Both tails of the normal law beyond ``z``."""
    return math.erfc(abs(z) / math.sqrt(2))


def student_tails(t: float, df: float) -> float:
    """Both tails of Student's law beyond ``t``.

    With t = sqrt(df) tan(a) the density becomes a power of cos(a), smooth enough for a
    Gauss-Legendre rule; what lies beyond twelve deviations is below double precision.
    """
    if df <= 0 or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    angle = math.atan(abs(t) / math.sqrt(df))
    top = min(math.pi / 2, angle + 12 / math.sqrt(df))
    at, weight = np.polynomial.legendre.leggauss(200)
    a = angle + (at + 1) * (top - angle) / 2
    scale = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - math.log(math.pi) / 2
    with np.errstate(divide="ignore"):
        density = np.exp(scale + (df - 1) * np.log(np.cos(a)))
    return float(min(1.0, 2 * (weight * density).sum() * (top - angle) / 2))


def sign_tails(wins: int, n: int) -> float:
    """Exact two-sided probability of a fair coin being at least as far from half as ``wins`` of ``n``."""
    if n <= 0:
        return math.nan
    k, total = max(wins, n - wins), 0.0
    while k <= n:
        term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
        total += term
        if term < total * 1e-18:
            break
        k += 1
    return min(1.0, 2 * total)
