"""A logistic ranker: scaled features, balanced classes, mini-batch steps, early stop.

Means, deviations, class weights and the loss after each epoch cover all rows and are sums that Spark makes. The steps of an epoch
follow one another, so they are taken where the weights are, over at most ``MOST`` rows: those with the smallest digests of
their key, all of them in a smaller table. Batches go by the digest of epoch and key, so that a run repeats itself.

Rows with a null feature, label or key are left out. Without rows, or with fewer than two, the weights are zero. A feature that does not vary is
divided by 1. Labels above one half are positive.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.functions.text import sigmoid

from .lineage import cut

MOST = 100_000
EPOCHS, BATCH, RATE, PATIENCE, DECAY = 50, 32, 0.1, 10, 1e-4
LEAST_DEVIATION, LEAST_GAIN, TINY = 1e-8, 1e-6, 1e-9
SEED, SPREAD = 42, 0.01


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Ranker:
    features: tuple[str, ...]
    w: np.ndarray
    b: float
    mu: np.ndarray
    sd: np.ndarray
    history: list[float] = field(default_factory=list)

    def chance(self) -> Column:
        """The probability of a row, as a column."""
        z: Column = F.lit(float(self.b))
        for f, w, m, s in zip(self.features, self.w.tolist(), self.mu.tolist(), self.sd.tolist(), strict=True):
            z = z + (F.col(f) - m) / s * w
        return sigmoid(z)

    def weights(self) -> dict[str, float]:
        return {f: round(float(v), 4) for f, v in zip(self.features, self.w, strict=True)}

    def as_dict(self) -> dict:
        return {"w": self.w.tolist(), "b": float(self.b), "mu": self.mu.tolist(), "sd": self.sd.tolist()}

    @classmethod
    def of(cls, features: Sequence[str], said: dict) -> Ranker:
        return cls(tuple(features), np.array(said["w"], dtype=float), float(said["b"]), np.array(said["mu"], dtype=float), np.array(said["sd"], dtype=float))


def order(keys: list[str], epoch: int) -> np.ndarray:
    """The rows of an epoch in order of their digest."""
    return np.lexsort((np.array(keys, dtype=object), np.array([zlib.crc32(f"{epoch}:{k}".encode()) for k in keys])))


def fit(rows: DataFrame, features: Sequence[str], label: str, key: str, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, patience: int = PATIENCE, decay: float = DECAY, most: int = MOST) -> Ranker:
    names, n_features = tuple(features), len(features)
    light = rows.select(F.col(key).cast("string").alias("_key"), (F.col(label).cast("double") > 0.5).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in names]).na.drop()
    light = cut(light)  # every epoch reads these few columns again
    sums = light.agg(F.count("*").alias("n"), F.sum("_y").alias("pos"), *[F.avg(f).alias(f"m_{f}") for f in names], *[F.stddev_pop(f).alias(f"s_{f}") for f in names]).first()
    mu = np.array([sums[f"m_{f}"] or 0.0 for f in names])
    sd = np.array([sums[f"s_{f}"] or 0.0 for f in names])
    sd[sd < LEAST_DEVIATION] = 1.0
    out = Ranker(names, np.zeros(n_features), 0.0, mu, sd)
    if sums.n < 2:
        return out
    pos, neg = max(1.0, sums.pos), max(1.0, sums.n - sums.pos)
    w_pos, w_neg = (pos + neg) / (2 * pos), (pos + neg) / (2 * neg)
    taken = light.orderBy(F.xxhash64("_key"), "_key", *names).limit(most).toPandas()  # at most ``most`` rows of a few numbers
    x, y, keys = (taken[list(names)].to_numpy() - mu) / sd, taken["_y"].to_numpy(), taken["_key"].tolist()
    weight = np.where(y > 0.5, w_pos, w_neg)
    out.w = np.random.default_rng(SEED).normal(0, SPREAD, n_features)
    best, kept, waited = float("inf"), (out.w.copy(), 0.0), 0
    for epoch in range(epochs):
        by = order(keys, epoch)
        for lo in range(0, len(by), batch):
            at = by[lo : lo + batch]
            g = (squash(x[at] @ out.w + out.b) - y[at]) * weight[at]
            out.w = out.w - rate * (x[at].T @ g / len(at) + decay * out.w)
            out.b -= rate * g.sum() / len(at)
        p = out.chance()
        bits = F.col("_y") * F.log(p + TINY) + (1 - F.col("_y")) * F.log(1 - p + TINY)
        loss = -light.agg(F.avg(F.when(F.col("_y") > 0.5, w_pos).otherwise(w_neg) * bits)).first()[0]
        out.history.append(loss)
        if loss < best - LEAST_GAIN:
            best, kept, waited = loss, (out.w.copy(), out.b), 0
        else:
            waited += 1
            if waited >= patience:
                break
    out.w, out.b = kept
    return out


def scored(rows: DataFrame, ranker: Ranker, name: str = "score") -> DataFrame:
    return rows.withColumn(name, ranker.chance())
