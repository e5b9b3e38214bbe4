"""Curves and anchors against plain Python, all four factors."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hyperloom.operators import anchors
from hyperloom.plans import stored


def cos(a, b):
    n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)) if a and b and len(a) == len(b) else 0
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0


def clip(x):
    return max(0.0, min(1.0, x))


def plain(pool, curve, seeds, vectors, flows, fallback):
    """One query's candidates: pool ids, curve id -> ordered tags (tag, closure), seeds (id, mass)."""
    touches = {}
    for c in pool:
        touches[c] = []
        for s, mass in seeds:
            own = [t for t in curve.get(c, []) if t[0] == s]
            if own:
                touches[c].append((s, s, True, own[0][1], mass))
                continue
            best = None
            for tag, closure in curve.get(c, []):
                sim = cos(vectors.get(s), vectors.get(tag))
                if sim >= anchors.THRESHOLD and (best is None or sim >= best[0]):
                    best = (sim, tag, closure)
            if best:
                touches[c].append((s, best[1], False, best[2], mass))
    count = defaultdict(int)
    for ts in touches.values():
        for t in ts:
            count[t[0]] += 1
    heavy, top = max((max(0.0, m) for _, m in seeds), default=0.0), max(flows.values(), default=0.0)
    out = {}
    for c, ts in touches.items():
        free, close = 1.0, 0.0
        for s, tag, exact, closure, mass in ts:
            specific = max(0.35, 1 - math.sqrt(clip(flows.get(tag, 0.0) / top))) if top > 0 else 1.0
            rare = max(0.15, 1 - count[s] / len(pool))
            free *= 1 - clip((clip(mass / heavy) if heavy > 0 else 0) * specific * closure * rare * (1 if exact else 0.7))
            close += closure
        n = len(ts)
        mean = close / n if n else 0.0
        trust = clip(math.sqrt(mean * min(n / 2.0, 1.0)))
        trust = min(trust, 0.5) if fallback else trust
        out[c] = (clip(1 - free), trust, clip(clip(1 - free) * trust), n, sum(t[2] for t in ts), n - sum(t[2] for t in ts), mean)
    return out


@pytest.mark.parametrize("fallback", [False, True])
def test_anchors_equal_plain_python(spark, fallback):
    rng = random.Random(5 + fallback)
    vectors = {i: [rng.choice([0.0, 1.0, 1.0, 0.5]) for _ in range(3)] for i in range(1, 14)}
    vectors[13] = [1.0]
    own = {c: [rng.random() for _ in range(3)] for c in range(100, 112)}
    marks = {c: rng.sample(range(1, 14), rng.randint(0, 6)) for c in range(100, 112)}
    chunks = spark.createDataFrame([(c, c + 1000, v) for c, v in own.items()] + [(999, 5, None)], "candidate int, file int, vector array<double>")
    files = spark.createDataFrame([(c + 1000, t, p) for c, ts in marks.items() for p, t in enumerate(ts)], "file int, tag int, position int")
    tags = spark.createDataFrame([(i, v) for i, v in vectors.items()] + [(50, None)], "tag int, vector array<double>")
    wanted = spark.createDataFrame([(c,) for c in [*own, 999, None, 100]], "candidate int")
    curves = anchors.curves(wanted, chunks, files, tags)
    curve = defaultdict(list)
    for r in sorted(curves.collect(), key=lambda r: r.position):
        assert r.closure == pytest.approx(clip(cos(vectors[r.tag], own[r.candidate])))
        curve[r.candidate].append((r.tag, r.closure))
    assert {c: [t for t, _ in ts] for c, ts in curve.items()} == {c: ts for c, ts in marks.items() if ts}
    pools = {1: list(range(100, 112)), 2: [101, 103, 105], 3: [100, 777]}
    seeds = {1: [(i, float(i)) for i in (1, 2, 3, 9)], 2: [(4, 0.0), (13, 2.0)], 3: [(99, 1.0)]}
    flows = {i: rng.random() * 4 for i in range(1, 10)}
    arcs = spark.createDataFrame([(0, t, f / 2) for t, f in flows.items()] * 2 + [(0, None, 9.0)], "source int, target int, weight double")
    pool = spark.createDataFrame([(q, c) for q, cs in pools.items() for c in cs] + [(1, 100)], "query int, candidate int")
    told = spark.createDataFrame([(q, s, m) for q, ss in seeds.items() for s, m in ss] + [(1, None, 3.0)], "query int, seed int, mass double")
    out = anchors.anchored(pool, curves, told, tags.withColumnRenamed("tag", "id"), anchors.inbound(arcs), fallback=fallback)
    got = {(r.query, r.candidate): tuple(r)[2:] for r in out.collect()}
    want = {(q, c): v for q in pools for c, v in plain(pools[q], curve, seeds[q], vectors, flows, fallback).items()}
    assert got.keys() == want.keys() and sum(v[3] > 0 for v in want.values()) > 5 and sum(v[5] for v in want.values()) > 0
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k
    assert anchors.anchored(pool, curves, told.limit(0), tags.withColumnRenamed("tag", "id"), anchors.inbound(arcs)).agg({"score": "max"}).first()[0] == 0


def test_local_scores(spark):
    curves = spark.createDataFrame([(1, 5), (1, 6), (2, 6), (3, 9)], "candidate int, tag int")
    pool = spark.createDataFrame([(7, 1, 0.1), (7, 2, 0.9), (7, 3, None), (8, 3, 0.2)], "query int, candidate int, anchor double")
    domain = spark.createDataFrame([(7, 5), (7, 6), (7, 6), (8, 1)], "query int, tag int")
    got = {(r.query, r.candidate): r.anchor for r in anchors.local_scores(pool, curves, domain).collect()}
    assert got == {(7, 1): 1.0, (7, 2): 0.9, (7, 3): 0.0, (8, 3): 0.2}
    assert {r.anchor for r in anchors.local_scores(pool.drop("anchor"), curves, domain).collect()} == {1.0, 0.5, 0.0}


def test_contacts_of_places_are_those_of_curves(spark):
    draw = random.Random(5)
    vector = lambda i: None if i == 3 else [draw.gauss(0, 1) for _ in range(2 if i == 4 else 3)] if i != 5 else [0.0, None, 1.0]
    vectors = spark.createDataFrame([(i, vector(i)) for i in range(12)], "id long, vector array<double>").localCheckpoint()
    own = {c: draw.randrange(14) for c in range(30)}  # of two ids there is no vector
    places = spark.createDataFrame([(c, t, draw.randrange(4), own[c]) for c in own for t in draw.sample(range(14), 4)], "candidate long, tag long, position int, own long")
    pool = spark.createDataFrame([(q, c) for q in range(6) for c in draw.sample(range(30), 12)], "query long, candidate long")
    seeds = spark.createDataFrame([(q, s, draw.choice([None, 1.0, 2.5])) for q in range(6) for s in draw.sample(range(14), 3)] + [(1, None, 2.0)], "query long, seed long, mass double")
    flows = spark.createDataFrame([(t, float(t)) for t in range(1, 10)], "tag long, flow double")
    chunks = places.select("candidate", F.col("candidate").alias("file"), "own").distinct().join(vectors.withColumnRenamed("id", "own"), "own").drop("own")
    curves = anchors.curves(chunks.select("candidate"), chunks, places.select(F.col("candidate").alias("file"), "tag", "position"), vectors.withColumnRenamed("id", "tag"))
    want = anchors.anchored(pool, curves, seeds, vectors, flows, threshold=0.3)
    met = anchors.contacts_of_places(pool, places, seeds, vectors, flows, 0.3, 3)
    got = anchors.scored(pool, met, seeds, flows)
    shown = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert shown(got) == shown(want) and len({r[2] for r in shown(got)}) > 10


def test_stored_anchors_deals_its_rows_few_times(spark, tiny):
    plan = stored.stored_anchors(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange hashpartitioning") <= 40  # once 49, of which several held a vector in each row
