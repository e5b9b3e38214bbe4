"""SQLite shards and the graph server's writer: whole tables, broken rows, failed tasks and writes that are started again."""

import json
import sqlite3
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.sources import connectors

SCHEMA = "id long, name string, vec array<float>"


def read(spark, path, schema=SCHEMA, **options):
    return connectors.registered(spark).read.format("sqlite_shards").schema(schema).options(path=str(path), table="t", key="id", **options).load()


def write(df, path, mode="append"):
    connectors.registered(df.sparkSession)
    df.write.format("sqlite_shards").mode(mode).options(path=str(path), table="t", key="id").save()


def test_shards_round_trip(spark, tmp_path):
    df = spark.range(1000).selectExpr("id * 37 - 500 AS id", "if(id % 9 = 0, null, concat('é', id)) AS name", "array(float(id), float(0.5)) AS vec").repartition(4)
    write(df, tmp_path)
    assert len(list(tmp_path.glob("*.db"))) == 4 and not list(tmp_path.glob(".*"))
    back = read(spark, tmp_path, rows="70")
    assert back.rdd.getNumPartitions() >= 1000 // 70
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert back.select("name").where("id = 37 * 10 - 500").first().name == "é10"
    write(df.limit(3), tmp_path, "overwrite")
    assert read(spark, tmp_path).count() == 3
    write(df.limit(0), tmp_path / "none")
    assert read(spark, tmp_path / "none").count() == 0


def test_bounds_make_fewer_ranges(spark, tmp_path):
    write(spark.range(100).selectExpr("id", "string(id) AS name", "array(float(id)) AS vec").coalesce(1), tmp_path)
    rows = read(spark, tmp_path, rows="10", low="41", high="43")
    assert sorted(r.id for r in rows.collect()) == [41, 42, 43] and rows.rdd.getNumPartitions() == 1
    assert sorted(r.id for r in read(spark, tmp_path, low="98").where("name <> '98'").collect()) == [99]
    assert read(spark, tmp_path, low="5", high="4").count() == 0


def broken_file(path):
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name, vec)")
        good = np.array([1, 2], "<f4").tobytes()
        con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(1, "a", good), (2, "b", b"xyz"), (3, 7, good), (4, None, None), (5, "c", np.array([1, np.nan], "<f4").tobytes()), (9, "d", good[:4])])
        con.execute("INSERT INTO t VALUES (6, CAST(x'ff61' AS TEXT), ?)", (good,))


def test_broken_rows(spark, tmp_path):
    broken_file(tmp_path / "one.db")
    assert [r.id for r in read(spark, tmp_path / "one.db", dimension="2").orderBy("id").collect()] == [1, 4]
    told = {r.id: r._problem for r in read(spark, tmp_path, SCHEMA + ", _problem string", broken="report").collect()}
    assert told == {1: None, 2: "vec: not a vector", 3: "name: not a text", 4: None, 5: "vec: a number of the vector is not finite", 6: "name: not UTF-8", 9: None}
    with pytest.raises(Exception, match="not a vector"):
        read(spark, tmp_path, broken="fail").collect()
    ids = spark.createDataFrame([(9,), (1,), (1,), (77,), (None,), (2,)], "id long")
    assert sorted(r.id for r in connectors.looked_up(ids, "id", str(tmp_path / "one.db"), "t", SCHEMA, batch=2).collect()) == [1, 9]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    write(spark.range(5).selectExpr("id"), tmp_path)
    before = sorted(tmp_path.iterdir())
    bad = spark.range(0, 100, 1, 4).selectExpr("if(id = 77, cast(raise_error('torn') as bigint), id) AS id")
    with pytest.raises(Exception, match="torn"):
        write(bad, tmp_path)
    assert sorted(tmp_path.iterdir()) == before and read(spark, tmp_path, "id long").count() == 5


class Server(BaseHTTPRequestHandler):
    def do_POST(self):
        said = [s["statement"] for s in json.loads(self.rfile.read(int(self.headers["Content-Length"])))["statements"]]
        refused = self.server.refuses is not None and self.server.refuses in said
        if not refused:
            self.server.got.append(said)
        body = json.dumps({"results": [{"data": []} for _ in said], "errors": [{"code": "X", "message": "refused"}] if refused else []}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    s.got, s.refuses = [], None
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def statements(spark, tiny):
    """A graph of the given nations and customers."""
    n, c = spark.read.parquet(f"{tiny}/nation.parquet"), spark.read.parquet(f"{tiny}/customer.parquet")
    make = lambda df, phase, *e: df.select(F.lit(phase).alias("phase"), F.format_string(*e).alias("statement"))
    rows = make(n, "domains", "MERGE (:Nation {id: %d});", "n_nationkey").union(make(c, "nodes", "MERGE (:Customer {id: %d});", "c_custkey")).union(make(c, "relations", "MATCH %d IN %d", "c_custkey", "c_nationkey"))
    return rows.union(spark.createDataFrame([("schema", "CREATE CONSTRAINT a"), ("schema", "CREATE CONSTRAINT b"), ("nodes", None)], "phase string, statement string"))


def test_phases_arrive_in_order_and_once(spark, tiny, tmp_path, server):
    url = f"http://127.0.0.1:{server.server_port}"
    rows = statements(spark, tiny)
    told = connectors.post_graph(rows, url, str(tmp_path), batch=20)
    want = Counter(r.statement.removesuffix(";") for r in rows.collect() if r.statement)
    assert Counter(s for part in server.got for s in part) == want
    kinds = [{"CREA": 0, "MERGE (:N": 1, "MERGE (:C": 2, "MATC": 3}[next(k for k in ("CREA", "MERGE (:N", "MERGE (:C", "MATC") if part[0].startswith(k))] for part in server.got]
    assert kinds == sorted(kinds) and all(len(p) <= 20 for p in server.got) and [len(p) for p in server.got[:2]] == [1, 1]
    assert [told[p]["statements"] for p in connectors.PHASES] == [2, 25, 150, 150] and all(t["perhaps_twice"] == 0 for t in told.values())
    again = connectors.post_graph(rows, url, str(tmp_path), batch=20)
    assert sum(t["skipped"] for t in again.values()) == 327 and Counter(s for part in server.got for s in part) == want


def test_a_broken_write_goes_on_and_says_what_it_may_have_repeated(spark, tiny, tmp_path, server):
    url, rows = f"http://127.0.0.1:{server.server_port}", statements(spark, tiny)
    server.refuses = "MERGE (:Customer {id: 77})"
    with pytest.raises(Exception, match="refused"):
        connectors.post_graph(rows, url, str(tmp_path), batch=5)
    first = Counter(s for part in server.got for s in part)
    assert not any(s.startswith("MATCH") for s in first), "relations wait for all nodes"
    server.refuses = None
    told = connectors.post_graph(rows, url, str(tmp_path), batch=5)
    assert set(Counter(s for part in server.got for s in part).values()) == {1}
    assert told["nodes"]["skipped"] > 0 and 0 < told["nodes"]["perhaps_twice"] <= 5 and told["nodes"]["statements"] + told["nodes"]["skipped"] == 150
