"""Cases that once broke: quotes by the thousand, vectors that are null, counts in the hundreds of millions."""

import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from hyperloom.operators import build, inference, search
from hyperloom.plans import catalogue
from hyperloom.sources import files


def test_quotes_by_the_thousand(spark):
    many = '"' + 'say ""no"", ' * 5000 + 'end"'
    rows = [(1, f"1,{many},1"), (2, '2,"a, ""b"", c",0'), (3, "3,plain, with comma,2"), (4, "4,x,9"), (5, "id,text,label"), (6, '6,"open, 1'), (7, '7,"",1'), (8, None)]
    got = {r.i: (r.text, r.label) for r in files.labelled_lines(spark.createDataFrame(rows, "i int, value string"), keep=("i",)).collect()}
    assert got == {1: ('say "no", ' * 5000 + "end", 1), 2: ('a, "b", c', 0), 3: ("plain, with comma", 2)}


def test_vectors_without_numbers_take_no_part(spark):
    rows = [(1, None), (2, [1.0, 0.0]), (3, [0.9, 0.1]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = [(r.q, r.id, r["rank"]) for r in search.nearest(df, df, "id", "v", 1).orderBy("q").collect()]
    assert got == [(2, 3, 1), (3, 2, 1), (7, 3, 1)]


@pytest.mark.parametrize("k,n", [(0, 0), (0, 5), (3, 5), (20, 60), (17, 40), (480, 1000), (49_700, 100_000), (16, 1000), (1000, 16_000)])
def test_sign_test_is_exact(spark, k, n):
    got = spark.createDataFrame([(k, n)], "k long, n long").select(inference.two_sided(F.col("k"), F.col("n")).alias("p")).first().p
    if n == 0:
        assert got is None
    else:
        want = min(1.0, float(2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n)) if n <= 1000 else None
        terms = [math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(min(k, n - k) + 1)]
        assert got == pytest.approx(want if want is not None else min(1.0, 2 * math.fsum(terms)), rel=1e-7)


def test_sign_test_of_very_many(spark):
    n = 2_000_000_000
    k = n // 2 - round(1.5 * math.sqrt(n) / 2)
    got = spark.createDataFrame([(k, n)], "k long, n long").select(inference.two_sided(F.col("k"), F.col("n")).alias("p")).first().p
    assert got == pytest.approx(math.erfc(1.5 / math.sqrt(2)), rel=1e-4)


def test_triggers_hold_any_signs(spark):
    rows = [(i, t, p) for i, (t, p) in enumerate([("a\\Eb\\E c", "\\E"), ("x.*y x.*y", ".*"), ("\\Q\\E\\Q", "\\Q"), ("(a)(a)", "(a)"), ("none", "\\E\\"), ("aaaa", "aa"), ("text", "")])]
    df = spark.createDataFrame(rows, "i int, t string, p string")
    got = {r.i: [(s.start, s.end) for s in r.s] for r in df.select("i", build.occurrences(F.col("t"), F.col("p")).alias("s")).collect()}
    want = {i: [(m.start(), m.end()) for m in re.finditer(re.escape(p), t)] if p else [] for i, t, p in rows}
    assert got == want


@pytest.mark.parametrize("name", ["graph_json", "live_edges", "representative_edges"])
def test_edges_of_triggers_that_overlap_themselves(spark, tmp_path, name):
    texts = ["a thathat b", "thathathat is the nation", "that", "nothing was said", None]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = Counter(con.execute(catalogue.oracle_sql()[name]).fetchall())
    assert want and Counter(tuple(r) for r in catalogue.queries()[name](spark, str(tmp_path)).collect()) == want


def test_frames_that_share_a_short_id_keep_their_own_domains(spark, tmp_path):
    pairs = [("b567", "k68"), ("k81", "b339"), ("b353", "k3"), ("b818", "a47818"), ("b1", "k1")]  # the first two have one id, and so have the next two
    rows = [(10 * i + 5 + j, f"{s} {t} x{j} {s}", "en", "s", 9) for i, (s, t) in enumerate(pairs) for j in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.queries()["three_channel_edges"](spark, str(tmp_path)).collect()
    own = {f"c{r[0]}": tuple(r[1].split(" ")[:2]) for r in rows}
    assert {r.chunk_id: (r.source_domain, r.target_domain) for r in got} == own and len(got) == len(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    sql = con.execute(catalogue.oracle_sql()["three_channel_edges"])
    names = [d[0] for d in sql.description]
    told = Counter(tuple(v for n, v in zip(names, r) if n not in ("edge_id", "source_domain", "target_domain")) for r in sql.fetchall())
    assert told == Counter(tuple(v for n, v in r.asDict().items() if n not in ("edge_id", "source_domain", "target_domain")) for r in got)  # of pairs that share an id the SQL may name either
