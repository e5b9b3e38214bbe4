"""Folds, graph loops and expressions against hand-worked cases, and the plans at the smallest scale."""

import duckdb
import pytest
from pyspark.sql import functions as F

from hyperloom.functions import text as fx
from hyperloom.operators import folds, graph
from hyperloom.plans import catalogue


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_expressions(spark):
    gm = lambda *v: one(spark, fx.geometric_mean([F.lit(float(x)) for x in v]))
    assert gm(1, 1, 1) == pytest.approx(1) and gm(1, 0, 1) == pytest.approx(0.1)
    ent = lambda v: one(spark, fx.entropy(F.lit(v) if v else F.array().cast("array<int>")))
    assert ent([]) == 0 and ent([3]) == 0.5 and ent([1, 1]) == pytest.approx(1) and ent([9, 1]) < ent([5, 5])
    assert one(spark, fx.char_ngrams(F.lit("a bc"), 2)) == ["ab", "bc"] and one(spark, fx.char_ngrams(F.lit("a"), 2)) == ["a"]
    assert one(spark, fx.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0)))) == 0 and one(spark, fx.sigmoid(F.lit(0.0))) == 0.5


def test_chain_skips_what_does_not_fit(spark):
    rows = [("f", 0, ["a"]), ("f", 1, ["z"]), ("f", 2, ["a", "b"]), ("f", 4, ["b"]), ("f", 13, ["b"]), ("g", 0, ["a"]), ("g", 9, ["a"])]
    out = folds.chain_link(spark.createDataFrame(rows, "frame string, at long, ground array<string>"), ["frame"], "at", "ground").collect()
    assert [(r.frame, [getattr(x, "at", x) for x in r.chain]) for r in out] == [("f", [0, 2, 4])]


def test_budget_carries_over(spark):
    rows = [("q", "edges", 1, 1), ("q", "entities", 1, 3), ("q", "chunks", 1, 500), ("p", "chunks", 1, 2000), ("p", "chunks", 2, 10)]
    out = folds.pack(spark.createDataFrame(rows, "q string, kind string, r int, size int"), "q", "kind", "r", "size", 1000, {"edges": 0.5, "entities": 0.3, "chunks": 0.2})
    got = {r.q: (r.n_edges, r.n_entities, r.n_chunks) for r in out.collect()}
    assert got == {"q": (1, 1, 1), "p": (0, 0, 1)}


def test_threshold_falls_until_enough(spark):
    rows = [("q", s) for s in (0.9, 0.5, 0.45, 0.3, 0.0)]
    got = folds.adaptive_threshold(spark.createDataFrame(rows, "q string, s double"), "q", "s", 1.0, least=3).first()
    assert (got.n_decays, got.n_selected, got.regime) == (1, 3, "low")
    assert folds.adaptive_threshold(spark.createDataFrame(rows, "q string, s double"), "q", "s", 9.0, least=3, most=2).first().n_selected == 2


def test_graph(spark):
    inc = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 7), (3, 8)], "edge long, node long")
    assert {r.node: r.component for r in graph.components(inc).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert {r.node: r.hop for r in graph.hops(inc, 1).collect()} == {1: 0, 2: 1, 3: 2}
    same = inc.select("node").distinct().select("node", F.lit(0).alias("dim"), F.lit(2.0).alias("val"))
    assert {r.val for r in graph.propagate(inc, same, layers=3).collect()} == {2.0}


def test_chunks_hold_all_text(spark):
    text = "\n".join("x" * 90 for _ in range(30))
    out = folds.chunk_text(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").orderBy("chunk").collect()
    assert all(len(r.chunk_text) <= 650 for r in out) and sum(r.chunk_text.count("x") for r in out) >= 2700


def test_long_chunks_are_cut(spark):
    def cut(c):
        out = []
        while len(c) > 800:
            out.append(c[:500])
            c = c[450:]
        return out + [c]

    texts = ["".join(chr(97 + i * i % 26) for i in range(n)) for n in (799, 800, 801, 1250, 1251, 3000, 40_000)]
    out = folds.chunk_text(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t").orderBy("id", "chunk").collect()
    for i, t in enumerate(texts):
        assert [(r.chunk, r.chunk_text) for r in out if r.id == i] == list(enumerate(cut(t)[:40]))


def test_plans_agree_with_sql(spark, tiny):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    sql = catalogue.oracle_sql()
    for name in ("cross_domain", "l1_edges", "rrf", "graph_health", "omega", "chain_link", "holm"):
        mine = catalogue.queries()[name](spark, tiny)
        want = con.sql(sql[name])
        assert sorted(mine.columns) == sorted(want.columns) and mine.count() == len(want.fetchall())
