"""What repeated propagation tends to: its fixed point and its spectral radius, by loops of joins; no matrix is ever dense."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import propagate
from .lineage import cut


class NotConverged(RuntimeError):
    """A loop that reached its most rounds before its tolerance; nothing half done is returned."""


def fixed_point(incidence: DataFrame, features: DataFrame, alpha: float = 0.5, near: float = 1e-6, rounds: int = 1000) -> DataFrame:
    """node, dim, val: the solution of x = (1 - alpha) start + alpha M x, where M is one layer of ``propagate``.

    The loop ends when one more application moves no value by more than ``near`` times the largest start, and returns what that application gives. M is half
    the identity and half an average over edges, whose spectrum lies between 0 and 1, so that of I - alpha M lies between 1 - alpha and 1 - alpha / 2:
    Chebyshev steps for these bounds shrink the error tenfold a round at alpha 0.5, where applying M alone halves it.
    """
    features, incidence = cut(features), cut(incidence)  # every round reads them again
    largest = features.agg(F.max(F.abs("val"))).first()[0] or 0.0
    chebyshev = 0 < alpha < 1
    middle, half = (1 - 0.75 * alpha, 0.25 * alpha) if chebyshev else (1.0, 0.0)
    rho = half / middle
    keep, take = 0.0, 1 / middle  # the share of the last step that goes on, and that of what an application moves
    x, step = features, F.lit(0.0)
    for _ in range(rounds):
        layer = propagate(incidence, x.select("node", "dim", "val"), 1, alpha=1.0)
        start = features.withColumnRenamed("val", "was")
        rows = layer.join(start, ["node", "dim"]).select("node", "dim", ((1 - alpha) * F.col("was") + alpha * F.col("val")).alias("new"))
        rows = rows.join(x.select("node", "dim", "val", step.alias("step")), ["node", "dim"]).withColumn("step", keep * F.col("step") + take * (F.col("new") - F.col("val")))
        rows = cut(rows)
        moved = rows.agg(F.max(F.abs(F.col("new") - F.col("val")))).first()[0] or 0.0
        if moved <= near * largest:
            return rows.select("node", "dim", F.col("new").alias("val"))
        x, step = rows.select("node", "dim", (F.col("val") + F.col("step")).alias("val"), "step"), F.col("step")
        if chebyshev:
            last, rho = rho, 1 / (2 * middle / half - rho)
            keep, take = rho * last, 2 * rho / half
    raise NotConverged(f"values still move by {moved} after {rounds} rounds")


def radius(incidence: DataFrame, leak: float = 0.0, near: float = 1e-6, rounds: int = 1000) -> DataFrame:
    """rho, least_row, greatest_row: spectral radius of one layer, and the bounds its row sums give it.

    Power iteration on features that start at 1, so the first layer gives the row sums themselves. The entries are never negative, and no node that shares an
    edge has a value of 0, so the least and the greatest quotient of two rounds bound the radius from both sides: the loop ends when they agree.
    """
    ones = incidence.select("node").distinct().select("node", F.lit(0).alias("dim"), F.lit(1.0).alias("val"))
    rows = x = cut(propagate(incidence, ones, 1, alpha=1.0, leak=leak))
    was = cut(ones)
    for _ in range(rounds):
        both = x.join(was.withColumnRenamed("val", "was"), ["node", "dim"]).agg(F.min(F.col("val") / F.col("was")), F.max(F.col("val") / F.col("was")), F.max("val")).first()
        low, high, most = both
        if low is None or high - low <= near * high:
            return rows.agg(F.lit(((low or 0.0) + (high or 0.0)) / 2).alias("rho"), F.min("val").alias("least_row"), F.max("val").alias("greatest_row"))
        was = cut(x.withColumn("val", F.col("val") / most))
        x = cut(propagate(incidence, was, 1, alpha=1.0, leak=leak))
    raise NotConverged(f"the radius lies between {low} and {high} after {rounds} rounds")
