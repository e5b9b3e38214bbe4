"""Replicates that sum over parts of the hashes' range, against every replicate worked out row by row."""

from statistics import mean, stdev

import pytest
from pyspark.sql import functions as F

from hyperloom.operators import inference


def won(rows):
    """Concordant pairs within strata over all such pairs. rows: stratum, value, positive."""
    above = pairs = 0.0
    for s in {r[0] for r in rows}:
        p, q = [v for t, v, y in rows if t == s and y], [v for t, v, y in rows if t == s and not y]
        above += sum((a > b) + (a == b) / 2 for a in p for b in q)
        pairs += len(p) * len(q)
    return above / pairs


def test_permutation_gives_each_stratum_its_smallest_hashes(spark):
    """Strata that are null are strata, too."""
    rows = [(i, None if i % 3 == 0 else f"s{i % 3}", float(i * 7 % 19), i % 4 == 0) for i in range(150)]
    df = spark.createDataFrame(rows, "k long, s string, v double, y boolean")
    hashes = df.select("k", *[F.xxhash64("k", F.lit(r), F.lit(1)).alias(f"r{r}") for r in range(1, 31)]).collect()
    observed, above = won([(s, v, y) for _, s, v, y in rows]), 0
    for r in range(1, 31):
        h, dealt = {x.k: x[f"r{r}"] for x in hashes}, []
        for t in {s for _, s, _, _ in rows}:
            own = sorted((h[k], k, v) for k, s, v, _ in rows if s == t)
            n_pos = sum(y for _, s, _, y in rows if s == t)
            dealt += [(t, v, i < n_pos) for i, (_, _, v) in enumerate(own)]
        above += won(dealt) >= observed
    out = inference.stratified_permutation(df, "k", "v", "y", ["s"], 30).first()
    assert (out.auc, out.n, out.p) == (observed, 30, (above + 1) / 31)


def test_stratified_z_sorts_no_stratum(spark):
    rows = [(i, ("a", "b", None)[i % 3], float(i * 5 % 17)) for i in range(60)] + [(100, "lone", 4.0), (101, "same", 2.0), (102, "same", 2.0), (103, "a", None)]
    df = spark.createDataFrame(rows, "i int, s string, v double")
    out = inference.stratified_z(df, "v", "s")
    assert "Window" not in out._jdf.queryExecution().toString()
    every = [v for _, _, v in rows if v is not None]
    want = {}
    for i, s, v in rows:
        own = [w for _, t, w in rows if t == s and w is not None]
        spread = (stdev(own) if len(own) > 1 else 0) or stdev(every)
        want[i] = None if v is None else pytest.approx((v - mean(own)) / spread)
    assert {r.i: r.z for r in out.collect()} == want
