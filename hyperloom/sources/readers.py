"""Readers of labelled corpora whose formats Spark has no source for. Each turns rows of raw text or tokens into rows of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions that one task puts in order.
CHUNK = 65_536
EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def labelled_blocks(files: DataFrame, text: str = "value", keep: tuple[str, ...] = (), block: str = "metaphor", sentence: str = "Sentence", label: str = "Label", labels: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """The columns of ``keep``, sentence, label: one row per complete block of a tagged text.

    The text need not be well-formed XML (bare ampersands occur), so blocks are found by
    pattern. Blocks without a sentence or with a label that is not one of ``labels`` go;
    null texts have no blocks.
    """
    bodies = files.select(*keep, F.explode(F.regexp_extract_all(F.col(text), F.lit(f"(?s)<{block}>(.*?)</{block}>"), F.lit(1))).alias("body"))
    inner = lambda tag: F.regexp_replace(F.regexp_extract("body", f"(?s)<{tag}>(.*?)</{tag}>", 1), EDGES, "")
    found = bodies.select(*keep, inner(sentence).alias("sentence"), inner(label).try_cast("int").alias("label"))
    return found.where((F.col("sentence") != "") & F.col("label").isin(*labels))


def token_runs(tokens: DataFrame, position: str, index: str, sentence: str, label: str) -> DataFrame:
    """run (from 0), index, sentence, label (greatest), n_tokens: one row per run of consecutive tokens with the same index.

    The order is that of ``position``, a number. Chunks of positions are ordered by tasks of
    their own; only one row per chunk meets in one task. Null is an index like any other.
    """
    p = F.col(position).cast("long")
    t = tokens.select(p.alias("p"), F.floor(p / CHUNK).alias("chunk"), F.struct(F.col(index).alias("i")).alias("i"), F.col(sentence).alias("sentence"), F.col(label).alias("label"))
    inside = Window.partitionBy("chunk").orderBy("p")
    ends = t.groupBy("chunk").agg(F.max_by("i", "p").alias("end"))
    line = Window.orderBy("chunk")
    ends = ends.select("chunk", F.lag("end").over(line).alias("before"))
    t = t.join(ends, "chunk").withColumn("was", F.coalesce(F.lag("i").over(inside), F.col("before")))
    t = t.withColumn("begins", F.when(F.col("was").isNull() | ~F.col("was").eqNullSafe(F.col("i")), 1).otherwise(0))
    sums = t.groupBy("chunk").agg(F.sum("begins").alias("n"))
    sums = sums.select("chunk", F.coalesce(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    t = t.join(sums, "chunk").withColumn("run", F.col("earlier") + F.sum("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return t.groupBy("run").agg(F.min_by("i", "p")["i"].alias("index"), F.min_by("sentence", "p").alias("sentence"), F.max("label").alias("label"), F.count("*").alias("n_tokens"))
