import math

import duckdb
import pytest
from pyspark.sql import functions as F

from hyperloom.functions import text as fx
from hyperloom.operators import significance, spectra
from hyperloom.plans import catalogue
from hyperloom.sources import readers

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["labelled_blocks", "token_runs", "segment", "rank_test"])
def test_plans_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalogue.queries()[name](spark, SF)
    want = con.execute(catalogue.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in want.fetchall())))


def test_runs_cross_chunks(spark, monkeypatch):
    monkeypatch.setattr(readers, "CHUNK", 3)
    rows = [(i, x, f"s{i}", i % 2) for i, x in zip([0, 1, 2, 3, 4, 8, 9, 30], ["a", "a", None, None, "b", "b", "a", "a"])]
    out = readers.token_runs(spark.createDataFrame(rows, "p long, i string, s string, l int"), "p", "i", "s", "l").orderBy("run").collect()
    assert [(r["index"], r.sentence, r.n_tokens) for r in out] == [("a", "s0", 2), (None, "s2", 2), ("b", "s4", 2), ("a", "s9", 2)]


def test_blocks_drop_what_is_broken(spark):
    text = "<metaphor><Sentence> a & b\n</Sentence><Label> 2 </Label></metaphor><metaphor><Sentence>c</Sentence><Label>7</Label></metaphor><metaphor><Sentence>d</Sentence><Label>x</Label></metaphor>"
    assert [tuple(r) for r in readers.labelled_blocks(spark.createDataFrame([(text,), (None,), ("",)], "value string")).collect()] == [("a & b", 2)]


def test_segments(spark):
    assert spark.createDataFrame([("the 泥潭 x1, y",), (None,)], "t string").select(fx.segments(F.col("t")).alias("w")).collect() == [(["the", "泥", "潭", "x1", "y"],), ([],)]


def test_tails():
    assert significance.normal_tails(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert significance.student_tails(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert significance.student_tails(1.0, 1) == pytest.approx(0.5, abs=1e-9)
    assert significance.student_tails(1.96, 1e6) == pytest.approx(significance.normal_tails(1.96), abs=1e-5)
    assert significance.sign_tails(8, 10) == pytest.approx(2 * (45 + 10 + 1) / 1024)
    assert significance.sign_tails(5, 10) == 1.0 and math.isnan(significance.sign_tails(0, 0))


def test_rank_test_of_ties_and_nothing(spark):
    rows = spark.createDataFrame([(1.0, 1), (2.0, 1), (2.0, 0), (None, 0)], "v double, g int")
    out = significance.mann_whitney(rows, "v", F.col("g") == 1).first()
    assert (out.u, out.auc) == (0.5, 0.25)
    assert significance.mann_whitney(rows.where("false"), "v", F.col("g") == 1).first().z is None


def test_spectra(spark):
    incidence = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3)], "edge long, node long")
    start = spark.createDataFrame([(1, 0, 1.0), (2, 0, 0.0), (3, 0, 0.0)], "node long, dim int, val double")
    x = {r.node: r.val for r in spectra.fixed_point(incidence, start, near=1e-4).collect()}
    layer = [[0.75, 0.25, 0.0], [0.125, 0.75, 0.125], [0.0, 0.25, 0.75]]
    for i, row in enumerate(layer):
        assert x[i + 1] == pytest.approx(0.5 * (i == 0) + 0.5 * sum(a * x[j + 1] for j, a in enumerate(row)), abs=2e-4)
    out = spectra.radius(incidence).first()
    assert (out.rho, out.least_row, out.greatest_row) == pytest.approx((1.0, 1.0, 1.0))
