"""Toxicity by class-conditional Kneser-Ney models of letters.

Two models read the words of a text letter by letter, each letter after up to ``ORDER - 1``
before it in its word: one was counted on toxic documents, one on ordinary ones.
Both discount their own counts and give the rest to the same lower orders, which are
Kneser-Ney continuation counts over the words of both classes; an expression too rare
for either model is thus judged by shared counts and speaks for neither.

A word's evidence is its log-likelihood under the toxic model minus that under the
ordinary one, in all and per letter. A document's evidence is length-normalised: the
mean over its words, the mean of what exceeds ``CLEAR`` nats, which ordinary words do not
cancel, and the strongest words, which a long text does not dilute. A
logistic curve, fitted on labelled documents that the models were not counted on, turns
it into a score from 0 to 1.

Learned from a bounded sample, ``per_class`` labelled documents of either class outside
the held-out fold (the smallest hashes of the id), three in four for counts, the rest for the
curve. There each class weighs as much as all its labelled rows outside that fold, sampled or
not, so the share of toxic documents the curve expects is the labels' own at any table size. Scoring reads every whole text; each distinct word is scored once per task.

Null and empty texts have no words and get the curve's value at no evidence. If a class
has no labelled rows, every score is 0. Null ids and repeated rows each give a row;
repeated labels of one document count once, as toxic if any says so; an empty table
gives an empty result; columns that are not named are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold, letter_words, ship, windows

ORDER = 6
DISCOUNT = 0.75
PER_CLASS = 3000
REMEMBER = 400_000
CUT = 0.3
CLEAR = 2.0


class Models:
    """The two models over shared lower orders. ``counts``: (word, ordinary count, toxic count)."""

    def __init__(self, counts: list[tuple[str, int, int]], order: int = ORDER):
        self.order = order
        top: list[dict[str, float]] = [defaultdict(float), defaultdict(float)]
        lower: dict[str, set[str]] = defaultdict(set)
        for word, *by_class in counts:
            w = f"^{word}$"
            for i in range(1, len(w)):
                gram = w[max(0, i + 1 - order) : i + 1]
                for k in (0, 1):
                    if by_class[k]:
                        top[k][gram] += by_class[k]
                for j in range(1, len(gram)):
                    lower[gram[j:]].add(gram[j - 1])
        self.top = [dict(t) for t in top]
        self.total: list[dict[str, float]] = [defaultdict(float), defaultdict(float)]
        self.kinds: list[dict[str, int]] = [defaultdict(int), defaultdict(int)]
        for k in (0, 1):
            for gram, n in self.top[k].items():
                self.total[k][gram[:-1]] += n
                self.kinds[k][gram[:-1]] += 1
        self.cont = {g: len(before) for g, before in lower.items()}
        self.cont_total: dict[str, int] = defaultdict(int)
        self.cont_kinds: dict[str, int] = defaultdict(int)
        for g, n in self.cont.items():
            self.cont_total[g[:-1]] += n
            self.cont_kinds[g[:-1]] += 1
        self.total, self.kinds = [dict(t) for t in self.total], [dict(t) for t in self.kinds]
        self.cont_total, self.cont_kinds = dict(self.cont_total), dict(self.cont_kinds)
        self.even = 1.0 / (self.cont_kinds.get("", 0) + 1)
        self.seen: dict[str, float] = {}
        self.ratios: dict[str, float] = {}

    def shared(self, gram: str) -> float:
        """Continuation probability of the last letter after the ones before it."""
        p = self.even
        for j in range(len(gram) - 1, -1, -1):
            h = gram[j:-1]
            n = self.cont_total.get(h)
            if n:
                p = (max(self.cont.get(gram[j:], 0) - DISCOUNT, 0.0) + DISCOUNT * self.cont_kinds[h] * p) / n
        return p

    def likelihood(self, k: int, gram: str, below: float) -> float:
        n = self.total[k].get(gram[:-1])
        if not n:
            return below
        return (max(self.top[k].get(gram, 0.0) - DISCOUNT, 0.0) + DISCOUNT * self.kinds[k][gram[:-1]] * below) / n

    def ratio(self, gram: str) -> float:
        """Toxic minus ordinary log-likelihood of a letter after the ones before it; 0 where neither model has seen those."""
        out = 0.0
        if gram[:-1] in self.total[0] or gram[:-1] in self.total[1]:
            below = self.shared(gram[1:])
            out = math.log(self.likelihood(1, gram, below) / self.likelihood(0, gram, below))
        if len(self.ratios) >= REMEMBER:
            self.ratios.clear()
        self.ratios[gram] = out
        return out

    def evidence(self, word: str) -> float:
        """Toxic minus ordinary log-likelihood of a word."""
        w, n, known, out = f"^{word}$", self.order, self.ratios.get, 0.0
        for i in range(2, len(w) + 1):
            gram = w[i - n if i > n else 0 : i]
            out += r if (r := known(gram)) is not None else self.ratio(gram)
        if len(self.seen) >= REMEMBER:
            self.seen.clear()
        self.seen[word] = out
        return out

    def describe(self, text: str | None) -> list[float]:
        """A document's evidence: mean per word, strongest word in all and per letter, mean of the strongest three, length, clear evidence per word and in all."""
        words = [w for part in windows(text.lower()) for w in letter_words(part)] if text else []
        if not words:
            return [0.0] * 7
        each = self.seen.get
        values = [v if (v := each(w)) is not None else self.evidence(w) for w in words]
        best = heapq.nlargest(3, set(zip(values, words, strict=True)))
        rate = max(v / (len(w) + 1) for v, w in best)
        clear = sum(v - CLEAR for v in values if v > CLEAR)
        return [sum(values) / len(values), best[0][0], rate, sum(v for v, _ in best) / 3, math.log1p(len(words)), clear / len(words), math.log1p(clear)]


def curve(x: np.ndarray, y: np.ndarray, of_class: tuple[float, float] = (1.0, 1.0), rounds: int = 60, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps: centres, scales and weights (the last is the constant). A row of class k stands for ``of_class[k]`` rows."""
    n = np.where(y > 0, of_class[1], of_class[0])
    n = n * (len(n) / n.sum())
    mid, span = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.hstack([(x - mid) / span, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    keep = ridge * np.ones(len(w)) * len(x) / 100
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (n * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(keep), z.T @ (n * (y - p)) - keep * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mid, span, w


def labelled(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """All labelled ids outside the held-out fold: own_id, own_label."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & (fold(F.col(doc_id)) != 2))
    return rows.groupBy(F.col(doc_id).alias("own_id")).agg(F.max(label).alias("own_label"))


def samples(rows: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled ids of each class: id, label, half (0: three in four, for counts; 1: for the curve)."""
    rows = rows.withColumn("h", F.xxhash64(F.col("own_id").cast("string")))
    picked = [rows.where(F.col("own_label") == k).orderBy("h", "own_id").limit(per_class) for k in (0, 1)]
    return picked[0].unionByName(picked[1]).withColumn("half", (F.pmod(F.col("h"), F.lit(4)) == 0).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> dict | None:
    spark = docs.sparkSession
    ship(docs.sparkSession)
    known = labelled(labels, doc_id, label)
    picked = samples(known, per_class).toPandas()  # at most 2 * per_class rows
    if picked["own_label"].nunique() < 2:
        return None
    there, taken = dict(known.groupBy("own_label").count().collect()), picked["own_label"].value_counts()
    of_class = (there[0] / int(taken[0]), there[1] / int(taken[1]))  # 1 and 1 where nothing was cut
    ids = spark.createDataFrame(picked[["own_id", "own_label", "half"]].astype({"own_id": "int64", "own_label": "int32", "half": "int32"}))
    rows = docs.select(F.col(doc_id).alias("own_id"), F.col(text).alias("text")).join(F.broadcast(ids), "own_id")  # 2 * per_class ids

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            count: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for t, k in zip(frame["text"], frame["own_label"], strict=True):
                for w in (w for part in windows(t.lower()) for w in letter_words(part)) if isinstance(t, str) else ():
                    count[w][k] += 1
            yield pd.DataFrame([(w, *n) for w, n in count.items()], columns=["word", "n0", "n1"])

    counted = rows.where("half = 0").mapInPandas(words, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    counts = sorted(zip(counted["word"], counted["n0"].astype(int), counted["n1"].astype(int), strict=True))
    del counted
    shipped = spark.sparkContext.broadcast(counts)  # the words of at most per_class documents

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = models_of(shipped.value)
        for frame in frames:
            x = [models.describe(t if isinstance(t, str) else None) for t in frame["text"]]
            yield pd.DataFrame({"own_id": frame["own_id"], "y": frame["own_label"], "x": x})

    described = rows.where("half = 1").mapInPandas(describe, "own_id long, y int, x array<double>").toPandas().sort_values("own_id")
    if described["y"].nunique() < 2:
        return None
    return {"counts": shipped, "curve": curve(np.array(described["x"].tolist()), described["y"].to_numpy(dtype=float), of_class)}


_MODELS: dict[str, Models] = {}


def models_of(counts: list[tuple[str, int, int]]) -> Models:
    """One pair of models per worker process, known by what they were counted from."""
    key = hashlib.sha256(repr(counts).encode()).hexdigest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Models(counts)
    return _MODELS[key]


def score(docs: DataFrame, model: dict | None, doc_id: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), (fold(F.col(doc_id)) == 2).alias("held_out"), F.col(text).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = models_of(model["counts"].value) if model else None
        for frame in frames:
            out = np.zeros(len(frame))
            if models and len(frame):
                mid, span, w = model["curve"]
                x = np.array([models.describe(t if isinstance(t, str) else None) for t in frame["text"]])
                out = 1 / (1 + np.exp(-np.clip((x - mid) / span @ w[:-1] + w[-1], -30, 30)))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "score": out, "predicted": (out >= cut).astype(np.int32)})

    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
