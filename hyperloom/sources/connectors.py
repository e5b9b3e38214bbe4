"""Data sources of the library's own: SQLite shards, read by key ranges and written shard by shard, and a graph server.

``sqlite_shards``: a folder of SQLite files that hold the same table. Reading deals ranges of an integer key to tasks, of
``rows`` rows each by the key's index, whatever gaps the keys have. A cell that does not fit its column breaks its row:
``broken`` says whether such rows are skipped (``skip``, as one bad row must not end a batch), kept with nulls and a text in the
column ``_problem`` (``report``), or end the query (``fail``). Blobs read as ``array<float>`` are little-endian 32-bit
floats, all finite, ``dimension`` of them if that is given. ``low`` and ``high`` bound the key. They are options and not filters
that Spark pushes, as Spark 4.1.2 keeps what it pushed for later queries of the same DataFrame and gives them too few rows.
Writing: each task fills a shard under a name of its own attempt and moves it into place when it is whole; the commit removes
what is left of attempts that failed, an abort everything this write made. Each shard has an index on the key.

``graph_http``: statements to a property-graph server, in transactions of ``batch``. A lost task cannot know whether its last
transaction arrived, so each leaves an intent before it is posted and a receipt after: a retry skips what has a receipt
and posts the rest, and counts what had an intent only as perhaps posted twice. ``post_graph`` writes schema, domains,
nodes and relations one after the other, each a write that ends before the next begins.

Paths must be folders that every executor can open, such as a mounted share; receipts go through Arrow's file systems.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

PROBLEM = "_problem"
ROWS_AT_ONCE = 5_000
LOW, HIGH = -(2**63), 2**63 - 1


def local(path: str) -> str:
    """The path of a folder on a mounted file system."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"SQLite files need a mounted folder, not {path}")
    return unquote(parts.path) if parts.scheme else path


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    con.text_factory = bytes  # a text that is no UTF-8 breaks its row, not the cursor
    return con


class Misfit(ValueError):
    """A cell that does not fit its column."""


def fitted(value: object, kind: T.DataType, dimension: int | None) -> object:
    """A cell as its column wants it."""
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, bytes) or len(value) % 4 or dimension and len(value) != 4 * dimension:
            raise Misfit("not a vector")
        v = np.frombuffer(value, "<f4")
        if not np.isfinite(v).all():
            raise Misfit("a number of the vector is not finite")
        return v
    if isinstance(kind, T.StringType):
        if not isinstance(value, bytes):
            raise Misfit("not a text")
        try:
            return value.decode()
        except UnicodeDecodeError as e:
            raise Misfit("not UTF-8") from e
    if isinstance(kind, T.BinaryType) and isinstance(value, bytes):
        return value
    if isinstance(kind, T.IntegralType) and isinstance(value, int):
        if not -(2 ** (8 * _BYTES[type(kind)] - 1)) <= value < 2 ** (8 * _BYTES[type(kind)] - 1):
            raise Misfit("out of range")
        return value
    if isinstance(kind, T.FractionalType) and isinstance(value, (int, float)) and math.isfinite(value):
        return float(value)
    raise Misfit(f"not a {kind.simpleString()}")


_BYTES = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8}


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    return {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "double": pa.float64(), "float": pa.float32()}[kind.simpleString()]


@dataclass
class Range(InputPartition):
    shard: str
    low: int
    high: int  # ends included


class ShardReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.table, self.key = schema, options["table"], options["key"]
        self.folder = local(options["path"])
        self.rows = int(options.get("rows", 50_000))
        self.broken = options.get("broken", "skip")
        self.dimension = int(options["dimension"]) if "dimension" in options else None
        if self.broken not in ("skip", "report", "fail"):
            raise ValueError("broken must be skip, report or fail")
        self.low, self.high, self.wanted = int(options.get("low", LOW)), int(options.get("high", HIGH)), None

    def partitions(self) -> list[Range]:
        out, key, table = [], quoted(self.key), quoted(self.table)
        single = os.path.isfile(self.folder)
        names = [self.folder] if single else sorted(os.path.join(self.folder, n) for n in os.listdir(self.folder) if n.endswith(".db"))
        for shard in names:
            with opened(shard) as con:
                low = self.low
                while low <= self.high:
                    ahead = con.execute(f"SELECT {key} FROM {table} WHERE {key} >= ? AND {key} <= ? ORDER BY {key} LIMIT 1 OFFSET ?", (low, self.high, self.rows - 1)).fetchone()
                    top = ahead[0] if ahead and isinstance(ahead[0], int) else self.high
                    out.append(Range(shard, low, top))
                    low = top + 1
        return out or [Range("", 0, -1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.shard:
            return
        fields = [f for f in self.schema if f.name != PROBLEM]
        report = any(f.name == PROBLEM for f in self.schema)
        shape = pa.schema([pa.field(f.name, pa.string() if f.name == PROBLEM else arrow_type(f.dataType)) for f in self.schema])
        ask = f"SELECT {', '.join(quoted(f.name) for f in fields)} FROM {quoted(self.table)} WHERE {quoted(self.key)} BETWEEN ? AND ?"
        bounds: list = [partition.low, partition.high]
        if self.wanted is not None:
            mine = [w for w in self.wanted if partition.low <= w <= partition.high]
            ask += f" AND {quoted(self.key)} IN (SELECT value FROM json_each(?))"
            bounds.append(json.dumps(mine))
        with opened(partition.shard) as con:
            cursor = con.execute(f"{ask} ORDER BY {quoted(self.key)}", bounds)
            while got := cursor.fetchmany(ROWS_AT_ONCE):
                kept: dict[str, list] = {f.name: [] for f in self.schema}
                for row in got:
                    cells, problem = [], None
                    for value, f in zip(row, fields, strict=True):
                        try:
                            cells.append(fitted(value, f.dataType, self.dimension))
                        except Misfit as e:
                            cells.append(None)
                            problem = problem or f"{f.name}: {e}"
                    if problem and self.broken == "fail":
                        raise Misfit(f"{partition.shard}: {problem}")
                    if problem and self.broken == "skip":
                        continue
                    for f, c in zip(fields, cells, strict=True):
                        kept[f.name].append(c)
                    if report:
                        kept[PROBLEM].append(problem)
                yield pa.RecordBatch.from_arrays([pa.array(kept[f.name], type=f.type) for f in shape], schema=shape)


@dataclass
class Shard(WriterCommitMessage):
    name: str
    rows: int


def stored(value: object) -> object:
    return np.asarray(value, dtype="<f4").tobytes() if isinstance(value, (list, np.ndarray)) else bytes(value) if isinstance(value, bytearray) else value


class ShardWriter(DataSourceWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.names, self.table, self.key = schema.names, options["table"], options["key"]
        self.folder, self.overwrite, self.run = local(options["path"]), overwrite, uuid.uuid4().hex[:12]

    def write(self, rows: Iterator) -> Shard:
        from pyspark import TaskContext

        task = TaskContext.get()
        os.makedirs(self.folder, exist_ok=True)
        name = f"shard-{self.run}-{task.partitionId():05d}.db"
        own = os.path.join(self.folder, f".{name}.{task.taskAttemptId()}")
        n = 0
        columns = ", ".join(map(quoted, self.names))
        with sqlite3.connect(own) as con:
            con.execute("PRAGMA journal_mode = OFF")
            con.execute(f"CREATE TABLE {quoted(self.table)} ({columns})")
            put = f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * len(self.names))})"
            part: list[tuple] = []
            for row in rows:
                part.append(tuple(map(stored, row)))
                if len(part) == ROWS_AT_ONCE:
                    con.executemany(put, part)
                    n += len(part)
                    part = []
            con.executemany(put, part)
            n += len(part)
            con.execute(f"CREATE INDEX by_key ON {quoted(self.table)} ({quoted(self.key)})")
        con.close()
        os.replace(own, os.path.join(self.folder, name))  # a second attempt of the task puts the same rows under the same name
        return Shard(name, n)

    def _clear(self, keep: set[str], mine: bool) -> None:
        for n in os.listdir(self.folder) if os.path.isdir(self.folder) else []:
            ours = self.run in n
            if n not in keep and (ours if mine else ours or self.overwrite and n.endswith(".db")):
                os.unlink(os.path.join(self.folder, n))

    def commit(self, messages: list) -> None:
        self._clear({m.name for m in messages if m is not None}, mine=False)

    def abort(self, messages: list) -> None:
        self._clear(set(), mine=True)


class SqliteShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_shards"

    def reader(self, schema: T.StructType) -> ShardReader:
        return ShardReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(schema, self.options, overwrite)


def looked_up(ids: DataFrame, key: str, path: str, table: str, schema: str, batch: int = 500, broken: str = "skip", dimension: int | None = None) -> DataFrame:
    """Rows of a single SQLite file whose key is among ``ids``, asked in batches of ``batch`` ids by each task; equal ids are asked once."""
    import pandas as pd

    shape = T.StructType.fromDDL(schema)
    options = {"path": path, "table": table, "key": key, "broken": broken} | ({"dimension": str(dimension)} if dimension else {})

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            wanted = frame[key].tolist()
            for lo in range(0, len(wanted), batch):
                reader = ShardReader(shape, options)
                reader.wanted = sorted(wanted[lo : lo + batch])
                for got in reader.read(Range(local(path), LOW, HIGH)):
                    yield pd.DataFrame({c: got.column(c).to_pandas() for c in shape.names})

    return ids.select(F.col(key).cast("long").alias(key)).where(F.col(key).isNotNull()).distinct().mapInPandas(run, schema)


@dataclass
class Posted(WriterCommitMessage):
    statements: int
    transactions: int
    skipped: int
    perhaps_twice: int


class StatementWriter(DataSourceWriter):
    def __init__(self, schema: T.StructType, options: dict):
        self.at = schema.names.index("statement")
        self.options, self.batch = dict(options), int(options.get("batch", 200))
        self.receipts = options["receipts"].rstrip("/")

    def _files(self):  # noqa: ANN202
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.receipts if "://" in self.receipts or self.receipts.startswith("file:") else f"file://{os.path.abspath(self.receipts)}")
        system.create_dir(path)
        return system, path

    def write(self, rows: Iterator) -> Posted:
        from pyarrow import fs
        from pyspark import TaskContext

        from .writers import http_poster

        o = self.options
        post = http_poster(o["url"], o.get("user", "neo4j"), o.get("password", ""), o.get("database", "neo4j"))
        system, path = self._files()
        part = TaskContext.get().partitionId()
        told = Posted(0, 0, 0, 0)

        def sent(n: int, statements: list[str]) -> None:
            name = f"{path}/{part:05d}-{n:06d}-{hashlib.sha256(json.dumps(statements).encode()).hexdigest()[:24]}"
            there = {i.base_name.rsplit(".", 1)[1] for i in system.get_file_info([f"{name}.intent", f"{name}.receipt"]) if i.type != fs.FileType.NotFound}
            if "receipt" in there:
                told.skipped += len(statements)
                return
            told.perhaps_twice += len(statements) if "intent" in there else 0
            system.open_output_stream(f"{name}.intent").close()
            post(statements)
            system.open_output_stream(f"{name}.receipt").close()
            told.statements += len(statements)
            told.transactions += 1

        waiting: list[str] = []
        n = 0
        for row in rows:
            if row[self.at] is not None:
                waiting.append(row[self.at].strip().removesuffix(";"))
            if len(waiting) == self.batch:
                sent(n, waiting)
                waiting, n = [], n + 1
        if waiting:
            sent(n, waiting)
        return told

    def commit(self, messages: list) -> None:
        total = {k: sum(getattr(m, k) for m in messages if m is not None) for k in ("statements", "transactions", "skipped", "perhaps_twice")}
        system, path = self._files()
        with system.open_output_stream(f"{path}/manifest.json") as out:
            out.write(json.dumps(total).encode())

    def abort(self, messages: list) -> None:
        """What was posted is on the server, and its receipts stay, so that another write with the same receipts goes on from there."""


class GraphServer(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graph_http"

    def writer(self, schema: T.StructType, overwrite: bool) -> StatementWriter:
        return StatementWriter(schema, self.options)


def registered(spark: SparkSession) -> SparkSession:
    """Makes both sources known to a session."""
    spark.dataSource.register(SqliteShards)
    spark.dataSource.register(GraphServer)
    return spark


PHASES = ("schema", "domains", "nodes", "relations")


def post_graph(statements: DataFrame, url: str, receipts: str, user: str = "neo4j", password: str = "", database: str = "neo4j", batch: int = 200, parts: int = 8) -> dict[str, dict[str, int]]:
    """Posts statements (phase, statement) phase by phase; schema statements one to a transaction, as servers refuse them beside data.

    Returns what each phase posted, skipped and perhaps posted twice. Statements are dealt by digest and sorted within tasks, so a write
    that is started again finds the receipts of the one that broke.
    """
    registered(statements.sparkSession)
    told = {}
    for phase in PHASES:
        rows = statements.where(F.col("phase") == phase).select("statement").where("statement is not null").distinct()
        dealt = rows.repartition(1 if phase == "schema" else parts, F.xxhash64("statement")).sortWithinPartitions("statement")
        where = f"{receipts.rstrip('/')}/{phase}"
        size = 1 if phase == "schema" else batch
        dealt.write.format("graph_http").mode("append").options(url=url, user=user, password=password, database=database, batch=size, receipts=where).save()
        told[phase] = json.loads(statements.sparkSession.read.text(f"{where}/manifest.json", wholetext=True).first().value)
    return told
