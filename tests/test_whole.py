"""Plans read whole tables: brute force over the smallest ones, independent of the SQL twins."""

import math
from collections import defaultdict

import pytest

from hyperloom.plans import catalogue


def rows(spark, tiny, name, *columns):
    return [tuple(r) for r in catalogue.queries()[name](spark, tiny).select(*columns).collect()]


@pytest.fixture(scope="module")
def members(spark, tiny):
    """Order to its parts, over all line items."""
    out = defaultdict(set)
    for r in spark.read.parquet(f"{tiny}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        out[r[0]].add(r[1])
    return out


def around(members):
    out = defaultdict(set)
    for parts in members.values():
        for p in parts:
            out[p] |= parts
    return out


def mean(values):
    values = list(values)
    return sum(values) / len(values)


def test_graph_counts_take_every_edge(spark, tiny, members):
    pairs = {(e, n) for e, parts in members.items() for n in parts}
    degree = defaultdict(int)
    for _, n in pairs:
        degree[n] += 1
    assert sorted(rows(spark, tiny, "incidence", "edge", "node")) == sorted(pairs)
    assert rows(spark, tiny, "graph_density", "total", "n_nodes") == [(len(pairs), len(degree))]
    assert rows(spark, tiny, "graph_health", "n_edges", "n_nodes", "max_degree") == [(len(members), len(degree), max(degree.values()))]
    near = around(members)
    assert dict(rows(spark, tiny, "comembers", "node", "n_others")) == {n: len(x) - 1 for n, x in near.items() if len(x) > 1}
    assert dict(rows(spark, tiny, "operator_rowsum", "node", "rowsum")) == pytest.approx(dict.fromkeys(degree, 1.0))


def test_graph_loops_take_every_edge(spark, tiny, members):
    near = around(members)
    low, reach = {}, {}
    for n in sorted(near):
        front = [] if n in low else [n]
        while front:
            x = front.pop()
            if x not in low:
                low[x] = n
                front += near[x]
    assert dict(rows(spark, tiny, "components", "node", "component")) == low
    first = min(near)
    for hop, front in enumerate(({first}, near[first], {y for x in near[first] for y in near[x]})):
        reach |= {x: hop for x in front if x not in reach}
    assert dict(rows(spark, tiny, "hops", "node", "hop")) == reach


def test_graph_means_take_every_edge(spark, tiny, members):
    price = {r[0]: r[1] for r in spark.read.parquet(f"{tiny}/part.parquet").select("p_partkey", "p_retailprice").collect()}
    of_edge = {e: mean(price[n] for n in parts) for e, parts in members.items()}
    edges = defaultdict(list)
    for e, parts in members.items():
        for n in parts:
            edges[n].append(e)
    assert dict(rows(spark, tiny, "node_edge_mean", "edge", "mean_price")) == pytest.approx(of_edge, abs=1e-5)
    spread = {n: 0.5 * price[n] + 0.25 * (price[n] + mean(of_edge[e] for e in es)) for n, es in edges.items()}
    assert dict(rows(spark, tiny, "hyperconv", "node", "val")) == pytest.approx(spread)
    x = {n: price[n] for n in edges}
    for _ in range(2):
        got = {e: mean(x[n] for n in parts) for e, parts in members.items()}
        x = {n: 0.2 * price[n] + 0.8 * 0.5 * (x[n] + 0.9 * mean(got[e] for e in es)) for n, es in edges.items()}
    assert dict(rows(spark, tiny, "hyperconv_2layer", "node", "val")) == pytest.approx(x, abs=1e-3)


def test_anchors_hear_every_document(spark):
    sf = "/root/testdata/sf0.01"
    want = defaultdict(float)
    for doc, frame, confidence in rows(spark, sf, "l1_edges", "doc_id", "frame_id", "confidence"):
        want[frame] -= math.log(1 - 0.5 * confidence)
    assert dict(rows(spark, sf, "anchors", "frame_id", "strength")) == pytest.approx(dict(want), abs=1e-5)


def test_literal_path_asks_the_whole_passage(spark, tmp_path):
    passage = "the opening of a passage that runs well past its first sixty characters, and its end"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, f"before {passage} after"), (2, passage[:70]), (3, "other")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(spark, tmp_path, "literal_path", "item_id", "doc_id") == [(1, 1)]


def test_resampling_runs_all_replicates(spark):
    ((p,),) = rows(spark, "/root/testdata/sf0.01", "permutation_p", "p")
    assert p * 1001 == pytest.approx(round(p * 1001), abs=1e-3)  # of 1,000 permutations and the rows as they are
    ((lo, hi),) = rows(spark, "/root/testdata/sf0.01", "bootstrap_ci", "lo", "hi")
    quality = [r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()]
    share = mean(quality)
    half = 1.96 * math.sqrt(share * (1 - share) / len(quality))
    assert lo == pytest.approx(share - half, abs=0.006) and hi == pytest.approx(share + half, abs=0.006)


@pytest.mark.parametrize("name", ["permutation_p", "bootstrap_ci"])
def test_replicates_are_not_broadcast(spark, name):
    """The planner took the replicates of a table for as many rows as the table has, and sent them all through the driver."""
    from hyperloom.plans import catalogue

    df = catalogue.queries()[name](spark, "/root/testdata/sf0.01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    rows = plan.split("\n")
    for at, line in enumerate(rows):
        if "BroadcastExchange" in line:
            depth = line.index("BroadcastExchange")
            below = next((j for j in range(at + 1, len(rows)) if rows[j][: depth + 1].strip(" :|+-")), len(rows))
            assert not any("explode(" in x or "[i#" in x for x in rows[at + 1 : below]), rows[at:below]


def test_numbered_equals_a_window_over_all(spark):
    from hyperloom.operators import inference

    df = spark.range(0, 5000, 1, 7).selectExpr("(id * 7919) % 5003 as x").repartition(5)
    got = sorted((r.x, r.k) for r in inference.numbered(df, "x").collect())
    assert [k for _, k in got] == list(range(5000))


def test_comembers_deals_its_rows(spark, tiny):
    """edges and pairs lay in as many partitions whatever the table's size."""
    from hyperloom.operators import graph

    inc = spark.createDataFrame([(1, 5), (1, 6), (1, 6), (2, 6), (2, 7), (3, 8), (None, 9), (4, None), (4, 5)], "edge int, node int")
    out = graph.comembers(inc, 13)
    assert sorted(map(tuple, out.collect())) == [(5, 1), (6, 2), (7, 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count(", 13") == 3
