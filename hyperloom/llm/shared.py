"""Helpers that several training-data operators use."""

from __future__ import annotations

import re
import tempfile
import unicodedata
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators understand it: blank and the five ASCII controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: A word: a run of anything else. The same text works in Java, RE2 and Python.
WORD = r"[^\x20\x09-\x0D]+"


#: Numerals that are word characters but no digits, such as fractions, circled and Roman ones; Unicode has them in its first two planes only.
NUMERALS = frozenset(c for c in map(chr, range(0x20000)) if unicodedata.category(c) in ("No", "Nl"))
_WORD_LETTERS = re.compile(r"[^\W\d_]+")
_NO_NUMERALS = dict.fromkeys(map(ord, NUMERALS), " ")


def letter_words(text: str) -> list[str]:
    """Runs of letters (Unicode categories L*), in order."""
    if not text.isascii() and not NUMERALS.isdisjoint(text):
        text = text.translate(_NO_NUMERALS)
    return _WORD_LETTERS.findall(text)


def windows(text: str, size: int = 1_000_000) -> Iterator[str]:
    """A text in pieces of about ``size`` characters that end before a blank, so that no word is cut; without blanks, of ``size``."""
    lo = 0
    while len(text) - lo > size:
        cut_at = text.rfind(" ", lo + 1, lo + size)
        cut_at = lo + size if cut_at < 0 else cut_at
        yield text[lo:cut_at]
        lo = cut_at
    if lo < len(text) or not lo:
        yield text[lo:]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local master, as in tests, may fall back on a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="hyperloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows go to the shared checkpoint folder, from which they can be read again after a loss."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def landed(df: DataFrame, what: str) -> DataFrame:
    """As ``cut``, but as a Parquet table, which is smaller on disk and can be pruned by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once per application, so that tasks can import them."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        top = Path(__file__).parents[1]
        file = Path(tempfile.mkdtemp(prefix="hyperloom-")) / "hyperloom_modules.zip"
        with zipfile.ZipFile(file, "w") as out:
            for p in sorted(top.rglob("*.py")):
                out.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(file))


def fold(doc_id: Column) -> Column:
    """The contract's fold of a row: crc32 of the id as text, modulo 4; fold 2 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def hex_slice(text: Column, digits: int) -> Column:
    """The first hex digits of the md5 of a string, as a number; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def runs_of(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Splits a sorted stream into frames of whole groups, many groups in each: only a group at the end of a batch waits for the next."""
    rest = None
    for frame in frames:
        if not len(frame):
            continue
        whole = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        changed = np.zeros(len(whole) - 1, dtype=bool)
        for k in keys:
            v = whole[k].to_numpy()
            changed |= v[1:] != v[:-1]
        at = np.flatnonzero(changed)
        if len(at):
            yield whole.iloc[: at[-1] + 1].reset_index(drop=True)
            whole = whole.iloc[at[-1] + 1 :].reset_index(drop=True)
        rest = whole
    if rest is not None:
        yield rest


def bounds_of(frame: pd.DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    """Where each group of a sorted frame begins and ends."""
    changed = np.zeros(max(0, len(frame) - 1), dtype=bool)
    for k in keys:
        v = frame[k].to_numpy()
        changed |= v[1:] != v[:-1]
    at = [0, *(np.flatnonzero(changed) + 1).tolist(), len(frame)]
    return list(zip(at[:-1], at[1:], strict=True))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the graph whose edges are the columns a and b; loops name lone nodes.

    Alternating large and small stars; every step aggregates by partial minimum and
    joins, so a node of very many edges is no hot spot.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = cut(pairs)
    last = None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        # the minima are cut off their aggregation, so that adaptive execution can split a node of very many edges in the join
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        near = large.join(low, "u")
        small = near.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        pairs = cut(small.where("u <> v").distinct())
        state = pairs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if state == last:
            break
        last = state
    low = pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(low, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
