"""Training pairs against a plain reading of the ring, and what must hold of any draw."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hyperloom.operators import training


def digest(*parts):
    return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:8], 16)


def plain_draws(rows, per, seed, arc):
    rows = {r for r in rows if None not in r}
    groups = defaultdict(set)
    for _, c, g in rows:
        groups[g].add(c)
    out = []
    for (e, own, g), i in itertools.product(sorted(rows), range(1, per + 1)):
        arcs = -(-len(groups[g]) // arc)
        u = digest(str(seed), e, str(i))
        here = [c for _, c in sorted((digest(g, c), c) for c in groups[g] if digest(g, c) * arcs // 2**32 == u * arcs // 2**32)]
        turn = digest(f"{seed}n", e, str(i)) % max(1, len(here))
        chunk = next((c for c in here[turn:] + here[:turn] if c != own), None)
        if chunk:
            found = min((digest(str(seed), e, str(i), x), x) for x, c, h in rows if c == chunk and h == g)
            out.append((e, own, i, found[1]))
    return Counter(out)


def edges(n, chunks, groups, seed=2):
    rng = random.Random(seed)
    return [(f"e{i}", f"c{rng.randrange(chunks)}", rng.choice(groups)) for i in range(n)] + [("e0", None, "a"), ("x", "c1", None), ("lone", "c9999", "lonely")]


@pytest.mark.parametrize("arc", [3, 1000])
def test_draws_equal_a_plain_ring(spark, arc):
    rows = edges(150, 40, "aab")
    df = spark.createDataFrame([*rows, rows[0]], "edge_id string, chunk_id string, group string")
    got = training.negatives(df, per=4, seed=7, arc=arc).collect()
    assert Counter((r.positive, r.chunk_id, r.draw, r.edge_id) for r in got) == plain_draws(rows, 4, 7, arc)


def test_what_holds_of_draws(spark):
    rows = edges(2000, 900, "aaaab", 5)
    home = {e: c for e, c, _ in rows if c}
    df = spark.createDataFrame(rows, "edge_id string, chunk_id string, group string")
    got = training.negatives(df).collect()
    assert all(home[r.edge_id] != r.chunk_id == home[r.positive] for r in got) and not any(r.positive == "lone" for r in got)
    assert len(got) == 3 * sum(1 for e, c, g in rows if c and g and e != "lone")
    assert max(Counter(r.edge_id for r in got).values()) < 28, "draws spread over the group"


def test_rejections_come_first(spark):
    rows = [(f"e{i}", f"c{i // 2}", "a") for i in range(12)]
    df = spark.createDataFrame(rows, "edge_id string, chunk_id string, group string")
    no = [("c0", f"s{i}", "t") for i in range(9)] + [("c1", "s", "t"), ("c1", "s", "t"), ("c1", None, "t"), ("elsewhere", "s", "t")]
    out = training.weak_pairs(df, spark.createDataFrame(no, "chunk_id string, source_domain string, target_domain string")).collect()
    per = Counter((r.chunk_id, r.origin) for r in out)
    assert per["c0", "rejected"] == 6 and ("c0", "drawn") not in per and per["c1", "rejected"] == 1 and per["c1", "drawn"] == 5 and per["c2", "drawn"] == 6
    assert all(r.label == (r.origin == "produced") for r in out) and sum(r.label for r in out) == 12
    ref = "REF_" + hashlib.md5(b"c1|s|t").hexdigest()[:8]
    assert [r.edge_id for r in out if r.chunk_id == "c1" and r.origin == "rejected"] == [ref]


def test_chain_pairs(spark):
    rng = random.Random(4)
    rows = [(f"e{i}", f"d{i % 3}", rng.randrange(12), rng.choice("FG"), "s", rng.sample("xyz", rng.randint(0, 2))) for i in range(60)]
    df = spark.createDataFrame(rows, "edge_id string, doc_id string, chunk_no int, frame_id string, source_domain string, ground array<string>")
    want = {(a[0], b[0]): abs(a[2] - b[2]) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and a[3] == b[3] and abs(a[2] - b[2]) < 3 and set(a[5]) & set(b[5])}
    assert {(r.a, r.b): r.gap for r in training.chain_pairs(df).collect()} == want and want
    assert training.chunk_pairs(df.withColumn("chunk_id", F.col("doc_id")).withColumn("group", F.col("frame_id")).limit(0)).count() == 0
