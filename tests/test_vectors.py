import math
import random

import pytest

from hyperloom.operators import anchors, search, vectors


def cosine(a, b):
    if len(a) != len(b) or not any(a) or not any(b):
        return 0.0
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(1)
    out = [(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    out += [(i, out[i % 3][1]) for i in range(120, 180)]  # copies, more than are asked for
    return out + [(180, [0.0] * 8), (181, [1.0, 2.0]), (182, [-1.0] * 8)]


@pytest.mark.parametrize("block", [16, 4096])
def test_nearest_equals_all_pairs(spark, rows, block):
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted((r.q, r["rank"], r.id) for r in search.nearest(df.where("id % 9 = 0"), df, "id", "v", 5, block).collect())
    want = []
    for q, v in rows:
        if q % 9 == 0:
            near = sorted((-round(cosine(v, w), 6), i) for i, w in rows if i != q)[:5]
            want += [(q, n + 1, i) for n, (_, i) in enumerate(near)]
    assert got == sorted(want)


def test_only_pairs_that_may_count_leave_a_block(spark, rows):
    df = spark.createDataFrame(rows, "id long, v array<double>")
    a, b = df.selectExpr("id as a", "v as own"), df.selectExpr("id as b", "v as theirs")
    got = {(r.a, r.b) for r in vectors.likely(a, b, least=0.6).select("a", "b").collect()}
    assert got == {(i, j) for i, v in rows for j, w in rows if i != j and cosine(v, w) >= 0.6}
    assert vectors.likely(a, b, best=2, block=10**6).where("a = 0").count() <= 3 * 8  # copies do not multiply


def test_seeds_meet_no_tag_in_a_nested_loop(spark):
    pool = spark.createDataFrame([(1, 2)], "query long, candidate long")
    curve = spark.createDataFrame([(2, 2, 5, 0, 0.5)], "candidate long, file long, tag long, position int, closure double")
    seeds = spark.createDataFrame([(1, 4, 1.0)], "query long, seed long, mass double")
    known = spark.createDataFrame([(4, [1.0, 0.1]), (5, [1.0, 0.0]), (6, None)], "id long, vector array<double>")
    df = anchors.contacts(pool, curve, seeds, known)
    assert [(r.seed, r.tag, r.exact) for r in df.collect()] == [(4, 5, False)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT (seed" not in plan and "aggregate(zip_with" not in "".join(x for x in plan.split("\n") if "Join" in x)
