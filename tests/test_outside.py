"""Store readers, writers, service hooks, comparison mining and the recurrent encoder on small hand-worked cases."""

import gzip
import hashlib
import json
import sqlite3
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.functions import text as fx
from hyperloom.operators import hooks, rerank
from hyperloom.plans import catalogue
from hyperloom.sources import stores, writers


def test_sqlite_ranges(spark, tmp_path):
    path = tmp_path / "store.db"
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE tags (id INTEGER PRIMARY KEY, name TEXT, vec BLOB)")
        con.executemany("INSERT INTO tags VALUES (?, ?, ?)", [(i * 7, f"t{i}", np.array([i, 1], "<f4").tobytes() if i % 5 else b"xyz") for i in range(1, 60)])
        con.execute("CREATE TABLE none (id INTEGER PRIMARY KEY)")
    got = stores.sqlite_table(spark, str(path), "tags", "id long, name string, vec binary", key="id", parts=5, rows=3)
    rows = {r.id: (r.name, r.v) for r in got.select("id", "name", stores.floats(F.col("vec")).alias("v")).collect()}
    assert len(rows) == 59 and rows[7] == ("t1", [1.0, 1.0]) and rows[35] == ("t5", None)
    assert stores.sqlite_table(spark, str(path), "none", "id long").count() == 0


def artifact(name, graph, spoil=False):
    raw = json.dumps(graph).encode() if isinstance(graph, dict) else graph
    return name, hashlib.sha256(raw + b"!" * spoil).hexdigest(), gzip.compress(raw)


def test_artifacts_are_checked(spark):
    good = {"node_ids": [5, 9], "row_offsets": [0, 2, 2], "targets": [1, 0], "weights": [0.5, 2.0]}
    cases = {
        "good": (good, None), "ids": (good | {"node_ids": [5, 0]}, "ids are not positive"), "twice": (good | {"node_ids": [5, 5]}, "ids repeat"),
        "short": (good | {"row_offsets": [0, 2]}, "offsets do not span the rows"), "fall": (good | {"row_offsets": [0, 3, 2]}, "offsets fall"), "none": (good | {"row_offsets": []}, "offsets do not span the rows"),
        "number": (good | {"weights": [1.0]}, "targets and weights differ in number"), "bounds": (good | {"targets": [2, 0]}, "a target is out of bounds"),
        "weight": (good | {"weights": [-1.0, 1.0]}, "a weight is not finite or negative"), "missing": ({"node_ids": [1]}, "a field is missing"),
    }
    rows = [artifact(k, g) for k, (g, _) in cases.items()] + [artifact("sum", good, spoil=True), ("plain", "", b"no gzip"), ("null", None, None)]
    out = stores.decoded(spark.createDataFrame(rows, "artifact_id string, checksum string, payload binary"))
    found = {r.artifact_id: r.problem for r in out.collect()}
    assert found == {k: p for k, (_, p) in cases.items()} | {"sum": "checksum differs", "plain": "not a gzip text", "null": "not a gzip text"}
    assert sorted(map(tuple, stores.arcs(out).collect())) == [("good", 5, 5, 2.0), ("good", 5, 9, 0.5)]


def test_cache_is_asked_first(spark, tmp_path):
    log, cache = tmp_path / "log", str(tmp_path / "cache")

    def call(part):
        with open(log, "a") as f:
            f.writelines(p + "\n" for p in part)
        return [p.upper() if p != "b" else None for p in part]

    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k string")
    for _ in range(2):
        out = hooks.through_cache(rows, "k", cache, call, "string")
        assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", "A"), ("a", "A"), ("b", None), (None, None)], key=str)
    assert sorted(log.read_text().split()) == ["a", "b"]
    with pytest.raises(Exception, match="2 keys got 1 answers"):
        hooks.called(rows.where("k is not null").distinct().coalesce(1), "k", lambda part: part[:1], "string").collect()


def test_transactions(spark, tmp_path):
    log = tmp_path / "log"

    def post(part):
        with open(log, "a") as f:
            f.write(json.dumps(part) + "\n")

    statements = spark.range(0, 25, 1, 1).select(F.format_string("MERGE (n {id: %d});", "id").alias("statement"))
    out = writers.transactions(statements, post, ["CREATE CONSTRAINT a;", "CREATE INDEX b;"], size=10)
    assert sorted(r.n_statements for r in out.collect()) == [5, 10, 10]
    posted = [json.loads(x) for x in log.read_text().splitlines()]
    assert [len(p) for p in posted] == [1, 1, 10, 10, 5] and posted[0] == ["CREATE CONSTRAINT a"] and posted[2][0] == "MERGE (n {id: 0})"


@pytest.fixture
def server():
    """A service on this machine: vectors of text lengths, and graph transactions; it fails once and refuses one key."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization", ""), body))
            code = 401 if "wrong" in self.headers.get("Authorization", "") else 503 if self.path == "/embed" and len(seen) == 1 else 200
            told = {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body.get("input", []))))]}
            if self.path.startswith("/db/"):
                bad = [{"code": "Syntax", "message": x["statement"]} for x in body["statements"] if "BAD" in x["statement"]]
                told = {"errors": bad, "results": [{"data": []} for _ in body["statements"]]}
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(told).encode())

    running = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_port}", seen
    running.shutdown()


def test_services_over_http(spark, server):
    url, seen = server
    keys = spark.createDataFrame([("a",), ("bcd",), ("",)], "k string").coalesce(1)
    out = hooks.called(keys, "k", hooks.http_embedder(f"{url}/embed", "m", pause=0.01), "array<double>", batch=2)
    assert {r.k: r.answer for r in out.collect()} == {"a": [1.0], "bcd": [3.0], "": [0.0]}
    assert [len(b["input"]) for _, _, b in seen] == [2, 2, 1]  # the first failed and was asked again
    before = len(seen)
    with pytest.raises(hooks.FatalReply, match="401"):
        hooks.http_embedder(f"{url}/embed", "m", "wrong")(["a"])
    assert len(seen) == before + 1
    statements = spark.range(0, 5, 1, 1).select(F.format_string("MERGE (n {id: %d});", "id").alias("statement"))
    done = writers.transactions(statements, writers.http_poster(url, "me", "word"), ["CREATE INDEX a;"], size=3)
    assert [r.n_statements for r in done.collect()] == [3, 2] and {p for p, _, _ in seen[before + 1 :]} == {"/db/neo4j/tx/commit"}
    with pytest.raises(RuntimeError, match="Syntax"):
        writers.http_poster(url, "me", "word")(["BAD"])


def test_release(spark, tmp_path):
    queries = spark.createDataFrame([(1, "q"), (2, "r")], "query_id int, query_text string")
    gold = writers.gold_queries(queries, spark.createDataFrame([(1, 8), (1, 3), (1, 8)], "query_id int, chunk_id int"))
    assert {r.query_id: r.gold for r in gold.collect()} == {1: [3, 8], 2: []}
    manifest = writers.release({"queries": gold, "docs": queries.limit(0)}, str(tmp_path / "out"))
    assert sorted(map(tuple, manifest.collect())) == [("docs", 0, "query_id,query_text"), ("queries", 2, "query_id,query_text,gold")]


def test_equative(spark):
    cases = {"Life is like a river of hope today": "is like river", "The wall stood, snow soft likewise": None, "stone hard as ever": "stone hard as ever", "she is the  calm sea": "is calm sea", "": None}
    out = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", fx.equative(F.col("t"), [" as ever"], [" is ", " is like "], ["a", "the", "of"]).alias("p")).collect()
    tidy = lambda p: " ".join(p.split()) if p else None
    assert {r.t: tidy(r.p) for r in out if r.t is not None} == cases and [r.p for r in out if r.t is None] == [None]


def test_sequence_states(spark):
    rng = np.random.default_rng(5)
    rows = [(g, i, rng.normal(size=3).tolist()) for g in "ab" for i in range(4)]
    out = {r.g: r.state for r in hooks.encode_sequences(spark.createDataFrame(rows, "g string, i int, v array<double>"), "g", "i", "v", 3, seed=2).collect()}
    draw = np.random.default_rng(2)
    w = [draw.normal(0, 3**-0.5, (3, 3)) for _ in range(6)]
    for g in "ab":
        h = np.zeros(3)
        for _, _, v in sorted(r for r in rows if r[0] == g):
            z, q = 1 / (1 + np.exp(-(v @ w[0] + h @ w[1]))), 1 / (1 + np.exp(-(v @ w[2] + h @ w[3])))
            h = (1 - z) * h + z * np.tanh(v @ w[4] + (q * h) @ w[5])
        assert out[g] == pytest.approx(h.tolist())


def test_lone_candidate_expects_itself(spark):
    row = spark.createDataFrame([(1, 1, 0.5, 0.5, 0.5, 0.4, "direct_answer", 1.0, 0.3)], "query int, ord int, pure double, closure double, direct double, graph double, role string, confidence double, anchor double")
    out = rerank.final_scores(row).first()
    assert (out.expected, out.uncertainty, out.bonus) == (0.4, 0.0, 0.0) and out.final == pytest.approx(0.5)


def test_provenance_lessens_own_edges(spark):
    nodes = spark.createDataFrame([(1, 10, 1.0, 0, [1.0]), (1, 11, 1.0, 1, [1.0])], "query int, node int, weight double, hop int, vector array<double>")
    edges = spark.createDataFrame([(1, 10, 11, 1.0, 0)], "query int, source int, target int, flow double, ord int")
    tags = spark.createDataFrame([(7, 10, 0, 1.0, [1.0]), (7, 11, 1, 1.0, [1.0])], "candidate int, tag int, position int, closure double, vector array<double>")
    pool = spark.createDataFrame([(1, 7), (1, 8)], "query int, candidate int")
    made = spark.createDataFrame([(10, 11, 7, 3.0), (10, 11, 9, 1.0)], "source int, target int, candidate int, amount double")
    whole = {r.candidate: r for r in rerank.topology(nodes, edges, tags, pool).collect()}
    less = {r.candidate: r for r in rerank.topology(nodes, edges, tags, pool, made).collect()}
    assert whole[7].shape == pytest.approx(1) and less[7].shape == pytest.approx(0.25) and whole[8].score == 0


@pytest.mark.parametrize("name", ["peer_expectation", "rerank_final", "artifact_arcs", "judged", "gold_queries"])
def test_plans(spark, tiny, name):
    con = duckdb.connect()
    for t in ("documents", "customer", "nation", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    df = catalogue.queries()[name](spark, tiny)
    order = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(order)} FROM ({catalogue.oracle_sql()[name]}) x").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*order).collect()))) == sorted(map(repr, want))


def test_arcs_leave_the_graph_behind(spark):
    """A graph was copied beside each of its arcs."""
    graph = ([10, 20, 30], [0, 2, 2, 3], [1, 2, 0], [0.5, 1.5, 2.0])
    kind = "artifact_id long, graph struct<node_ids:array<bigint>,row_offsets:array<bigint>,targets:array<bigint>,weights:array<double>>, problem string"
    df = stores.arcs(spark.createDataFrame([(1, graph, None), (2, graph, "broken"), (3, ([], [0], [], []), None)], kind))
    assert sorted(map(tuple, df.collect())) == [(1, 10, 20, 0.5), (1, 10, 30, 1.5), (1, 30, 10, 2.0)]
    assert "explode(" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["peer_expectation", "rerank_final"])
def test_pools_are_dealt_by_supplier(spark, tiny, name):
    """the lines lay in as many partitions whatever the table's size, and whole pools were ranked twice."""
    from hyperloom.plans import dialect

    df = catalogue.queries()[name](spark, tiny)
    parts = dialect.parts_of(spark, tiny, "lineitem")
    assert "hashpartitioning(l_suppkey" in df._jdf.queryExecution().executedPlan().toString() and f", {parts}), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    assert parts == max(spark.sparkContext.defaultParallelism, -(-spark.read.parquet(f"{tiny}/lineitem.parquet").count() // dialect.ROWS_A_TASK))


def test_topology_does_not_shuffle_by_ids(spark, tiny):
    """each meeting of a node and a tag was shuffled by their ids, and lines were shuffled once for each window."""
    plan = catalogue.queries()["topology_match"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if " Exchange hashpartitioning(node" in line and ", tag" in line]
    assert all("Aggregate" in line or "ENSURE" in line for line in dealt) and "hashpartitioning(l_orderkey" in plan and "REPARTITION_BY_NUM" in plan
