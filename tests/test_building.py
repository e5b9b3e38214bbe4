"""Building, matching, layers and tests against plain Python."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hyperloom.operators import build, graph, inference, matching, search, spectra


def test_both_ways_of_matching_agree(spark):
    texts = [(1, "the river runs to the sea"), (2, "no"), (3, ""), (4, None), (5, "x" * 2000 + "needle in a long text" + "y" * 1500), (6, "aaaa")]
    words = ["river", "to", "needle in a long text", "aa", "", "absent pattern of some length", "x" * 600 + "y"]
    t, p = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in words], "pattern string")
    want = {(i, w) for i, x in texts for w in words if w and x and w in x}
    for strategy in ("loop", "gram"):
        assert sorted(tuple(r) for r in matching.contained(t, p, ["id"], strategy=strategy).collect()) == sorted(want)


def test_occurrences_do_not_overlap(spark):
    rows = spark.createDataFrame([("abcab", "ab"), ("aaaa", "aa"), ("x.y.", "."), ("x", ""), ("", "a")], "t string, p string")
    got = [[tuple(s) for s in r[0]] for r in rows.select(build.occurrences(F.col("t"), F.col("p"))).collect()]
    assert got == [[(0, 2), (3, 5)], [(0, 2), (2, 4)], [(1, 2), (3, 4)], [], []]


def test_words_are_placed_without_a_shuffle(spark):
    texts = ["the tree  of life", "", " lead", None, "déjà 𝒳 vu ", "one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string").select(F.concat(F.lit("c"), "chunk_id").alias("chunk_id"), "text")
    out = build.words_of(rows)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = []
    for i, t in enumerate(texts):
        at = 0
        for pos, w in enumerate((t or "").split(" ") if t is not None else []):
            want.append((f"c{i}", pos, w, at, at + len(w)))
            at += len(w) + 1
    assert [tuple(r) for r in out.orderBy("chunk_id", "pos").collect()] == want


def test_a_marker_counts_by_its_distance_in_words(spark):
    """Words of no field between them are left out before the distance is taken."""
    texts = ["as x x river", "as x river", "river x x as lake", "river lake river x as"]
    rows = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    fields = spark.createDataFrame([("WATER", "river"), ("STILL", "lake")], "field string, word string")
    out = build.field_channel(rows, fields, spark.createDataFrame([("as",)], "word string"), spark.createDataFrame([("WATER", "F1"), ("STILL", "F2")], "field string, frame_id string"))
    got = sorted((r.chunk_id, r.triggers[0], r.low, r.high, r.conf) for r in out.collect())
    assert got == [("c1", "river", 5, 10, 0.5), ("c2", "lake", 13, 17, 0.5), ("c3", "lake", 6, 10, 0.45)]


def edge(i, no, ground, triggers=("t",), frame="F", source="s"):
    return (f"e{i}", "d", f"d_c{no}", no, frame, source, "t", "X", list(ground), list(triggers), 0.4 + i / 10, 1.0, "novel")


EDGE = "edge_id string, doc_id string, chunk_id string, chunk_no int, frame_id string, source_domain string, target_domain string, source_type string, ground array<string>, triggers array<string>, confidence double, reliability double, novelty string"


def test_chains(spark):
    link = lambda es, **kw: [tuple(r) for r in build.extended(spark.createDataFrame(es, EDGE), **kw).select("chunk_nos", "ground", "confidence").collect()]
    assert link([edge(0, 0, "ab"), edge(1, 1, "bc")]) == [([0, 1], ["a", "b", "c"], 0.5)]
    assert link([edge(0, 0, "ab"), edge(1, 9, "bc")]) == [] and link([edge(0, 0, "a"), edge(1, 1, "c")]) == []
    assert link([edge(0, 0, "a"), edge(1, 1, "c"), edge(2, 2, "a")]) == [([0, 2], ["a"], 0.6)]  # what does not fit is passed over
    assert link([edge(0, 0, "ab", ["u"]), edge(1, 1, "b", ["v"])], repeat=True) == [] and len(link([edge(0, 0, "ab", ["u"]), edge(1, 1, "b", ["u"])], repeat=True)) == 1
    got = build.extended(spark.createDataFrame([edge(0, 0, "a"), edge(1, 1, "a")], EDGE)).first()
    import hashlib

    assert got.edge_id == "EXT_" + hashlib.md5(b"F|s|['d_c0', 'd_c1']").hexdigest()[:8] and got.layer == 1.5


def test_a_judge_has_three_answers(spark):
    rows = spark.createDataFrame([(1, 0.4), (2, 0.4), (3, 0.4)], "k int, conf double")
    verdicts = spark.createDataFrame([(1, True, 0.9), (2, False, None)], "k int, figurative boolean, judged double")
    assert [tuple(r) for r in build.refined(rows, verdicts, ["k"]).collect()] == [(1, 0.9)] and build.refined(rows, None, ["k"]).count() == 3


def test_components_of_a_wide_graph(spark):
    path = [(i, i) for i in range(200)] + [(i, i + 1) for i in range(200)]  # 201 nodes in a row
    random.Random(1).shuffle(path)
    got = graph.components(spark.createDataFrame([*path, (900, 500), (901, 501)], "edge long, node long")).collect()
    assert {r.node: r.component for r in got} == {**dict.fromkeys(range(201), 0), 500: 500, 501: 501}


def test_radius_and_fixed_point_converge_or_say_so(spark):
    inc = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3)], "edge long, node long")
    assert spectra.radius(inc).first().rho == pytest.approx(1.0, abs=1e-6)
    start = spark.createDataFrame([(1, 0, 1.0), (2, 0, 0.0), (3, 0, 0.0)], "node long, dim int, val double")
    with pytest.raises(spectra.NotConverged):
        spectra.fixed_point(inc, start, rounds=2)
    m = {(r.row, r.col): r.val for r in graph.operator(inc).collect()}
    x = {r.node: r.val for r in spectra.fixed_point(inc, start, near=1e-3).collect()}
    assert all(x[i] == pytest.approx(0.5 * (i == 1) + 0.5 * sum(m.get((i, j), 0) * x[j] for j in x), abs=2e-3) for i in x)


def test_fixed_point_is_reached_in_few_rounds(spark):
    rng = random.Random(8)
    links = sorted({(e, rng.randrange(40)) for e in range(60) for _ in range(4)} | {(100, n) for n in range(30, 38)})
    inc = spark.createDataFrame(links, "edge long, node long")
    start = {n: rng.uniform(-5, 10) for n in range(42)}  # the last have no edge
    x = {r.node: r.val for r in spectra.fixed_point(inc, spark.createDataFrame([(n, 0, v) for n, v in start.items()], "node long, dim int, val double"), near=1e-6, rounds=10).collect()}
    members = {e: [n for f, n in links if f == e] for e, _ in links}
    want = dict(start)
    for _ in range(60):
        means = {e: math.fsum(want[n] for n in ns) / len(ns) for e, ns in members.items()}
        got = {n: [means[e] for e, m in links if m == n] for n in start}
        want = {n: 0.5 * start[n] + 0.25 * (want[n] + (math.fsum(g) / len(g) if g else 0.0)) for n, g in got.items()}
    assert x == {n: pytest.approx(v, abs=2e-5) for n, v in want.items()}


def test_component_cosine_forms_no_pairs_but_counts_them(spark):
    rng = random.Random(3)
    vs = {n: [rng.gauss(0, 1) for _ in range(4)] for n in range(7)} | {9: [0.0] * 4}
    parts = {n: n % 2 for n in vs}
    cos = [sum(a * b for a, b in zip(vs[i], vs[j], strict=True)) / math.hypot(*vs[i]) / math.hypot(*vs[j]) for i, j in itertools.combinations(range(7), 2) if parts[i] == parts[j]]
    got = graph.within_component_cosine(spark.createDataFrame(list(parts.items()), "node long, component long"), spark.createDataFrame([(n, d, float(x)) for n, v in vs.items() for d, x in enumerate(v)], "node long, dim int, val double")).first()
    assert got.mean == pytest.approx(sum(cos) / len(cos)) and got.pairs == len(cos)


def test_chain_scores(spark):
    chains = lambda rows: spark.createDataFrame(rows, "doc_id string, chunk_nos array<int>")
    out = search.chain_scores(chains([("a", [2, 1]), ("a", [1, 5]), ("c", [1, 2])]), chains([("a", [1, 2]), ("a", [7, 8]), ("b", [1, 2])])).collect()
    got = {r.doc_id: (r.n_pred, r.n_gold, r.hits, r.precision, r.recall, r.f1, r.spurious) for r in out}
    assert got == {"a": (2, 2, 1, 0.5, 0.5, 0.5, 1), "b": (0, 1, 0, 0.0, 0.0, 0.0, 0), "c": (1, 0, 0, 0.0, 1.0, 0.0, 0)}


def ranks(xs):
    return [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]


def auc(p, q):
    return sum((a > b) + 0.5 * (a == b) for a in p for b in q) / (len(p) * len(q))


def test_signed_ranks_and_exact_tests(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(6), rng.randrange(6)) for _ in range(60)]
    d = [a - b for a, b in pairs if a != b]
    r = ranks([abs(x) for x in d])
    n, w = len(d), sum(k for k, x in zip(r, d, strict=True) if x > 0)
    var = n * (n + 1) * (2 * n + 1) / 24 - sum(c**3 - c for c in Counter(map(abs, d)).values()) / 48
    z = (w - n * (n + 1) / 4 - (0.5 if w > n * (n + 1) / 4 else -0.5)) / math.sqrt(var)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "a double, b double")
    got = inference.wilcoxon(df, "a", "b").first()
    assert (got.n, got.w_plus) == (n, w) and got.z == pytest.approx(z) and got.p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-6)
    wins, m = sum(a > b for a, b in pairs), n
    k = min(wins, m - wins)
    exact = min(1.0, 2 * sum(math.comb(m, i) for i in range(k + 1)) / 2**m)
    assert inference.sign_test(df, "a", "b").first().p == pytest.approx(exact)
    assert inference.wilcoxon(df.limit(0), "a", "b").first().z is None
    both = spark.createDataFrame([(True, False)] * 9 + [(False, True)] * 2 + [(True, True)] * 5, "a boolean, b boolean")
    assert inference.mcnemar(both, "a", "b").first().p == pytest.approx(2 * sum(math.comb(11, i) for i in range(3)) / 2**11)
    assert inference.mcnemar(both.where("a = b"), "a", "b").first().p == 1


def test_conditional_auc_and_its_permutation(spark):
    rng = random.Random(6)
    rows = [(i, i % 4, float(rng.randrange(5) + (2 if i % 3 == 0 else 0)), i % 3 == 0) for i in range(120)] + [(500, 9, 1.0, True)]
    by = {s: ([v for _, t, v, y in rows if t == s and y], [v for _, t, v, y in rows if t == s and not y]) for s in range(4)}
    want = sum(auc(p, q) * len(p) * len(q) for p, q in by.values()) / sum(len(p) * len(q) for p, q in by.values())
    df = spark.createDataFrame(rows, "k long, s int, v double, y boolean")
    got = inference.conditional_auc(df, "v", "y", ["s"]).first()
    assert got.auc == pytest.approx(want) and (got.strata, got.informative) == (5, 4)
    out = inference.stratified_permutation(df, "k", "v", "y", ["s"], 100).first()
    assert out.auc == pytest.approx(want) and out.n == 100 and out.p < 0.05
    flat = inference.stratified_permutation(df.withColumn("v", F.pmod(F.xxhash64("k"), F.lit(7)).cast("double")), "k", "v", "y", ["s"], 100).first()
    assert 0.01 < flat.p


def test_bootstrap_draws_pairs(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(i, rng.gauss(1, 1), rng.gauss(0, 1)) for i in range(300)], "k long, a double, b double")
    out = inference.bootstrap_difference(df, "k", "a", "b", replicates=400).first()
    d = [r.a - r.b for r in df.collect()]
    mean = sum(d) / len(d)
    half = 1.96 * math.sqrt(sum((x - mean) ** 2 for x in d)) / len(d)
    assert out.difference == pytest.approx(mean) and out.low == pytest.approx(mean - half, abs=0.05) and out.high == pytest.approx(mean + half, abs=0.05)


def test_extent_ends_at_the_last_place_also_where_places_overlap(spark):
    chunks = spark.createDataFrame([("d", "c1", 1, "a thathat b"), ("d", "c2", 2, "that"), ("d", "c3", 3, None)], "doc_id string, chunk_id string, chunk_no int, text string")
    frames = spark.createDataFrame([("F", ["that"])], "frame_id string, triggers array<string>")
    got = build.trigger_channel(chunks, frames)
    rows = {r.chunk_id: (r.low, r.high, [(s.start, s.end) for s in r.spans]) for r in got.collect()}
    assert rows == {"c1": (2, 9, [(2, 6)]), "c2": (0, 4, [(0, 4)])}
    lean = got.select("chunk_id", "low", "high")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in lean  # spans nobody asks for are not looked for
