"""Mixing sources to target weights by systematic sampling.

Target words per source: sources share all words by weight, a source takes at most
``most`` times its own words, and what is above goes to the others by weight until
none is above. That is a water level: in the order of cap over weight, the sources
below the level are capped and the rest share what is left.

Within a source every document has the same expected number of copies, target over
size. Documents are ordered by word count and, within nearly equal counts, by a hash
of the id; the expected copies are summed along that order from one random offset
per source, and a document is emitted once per whole number its interval crosses.
The order by word count spreads the sample evenly over lengths, so the words taken
come within about one document of the target.

The sum is two-level: rows are ranked inside (source, length bucket, salt), the
piles' counts are summed per bucket and per source. A source with a third of all
rows is ranked by as many tasks as it has piles. Length buckets are exact below 1,024
words and 1/512 of the octave above, so their number grows only with the logarithm of
the longest text.

Null or wordless texts have size 0 and are still ranked; null is a source of its own,
last in order. Null ids sort first, repeated rows count separately, an empty table
gives an empty result and extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, cut, hex_slice

SALTS = 64
MOST = 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_bucket(size: Column) -> Column:
    """Grows with the size; exact below 1,024."""
    e = F.length(F.bin(size)) - 10
    return F.when(size < 1024, size).otherwise(e * 512 + F.floor(size / F.pow(F.lit(2.0), e))).cast("long")


def targets(sizes: DataFrame, most: int = MOST, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size -> with weight and target. One row per source meets in one task."""
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", (F.col("source_size") * most).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    before, whole = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("left", F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("open_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("capped", F.col("cap") * F.col("open_weight") <= F.col("left") * F.col("weight"))
    rest = Window.partitionBy()
    level = F.sum(F.col("source_size").cast("double")).over(rest) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(rest), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(rest)
    return s.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight") / open_weight).alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """The source's one random offset, from 0 to below 1; the same in every run."""
    return hex_slice(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))), 8) / F.lit(4294967296.0)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken and the columns named in ``keep``."""
    # words are counted once a row: a projection would repeat the count wherever the size is used
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), *[F.col(c).alias(f"kept_{c}") for c in keep], F.explode(F.array(n_words(F.col(text)))).alias("size"))
    light = cut(rows.select("doc_id", "source", "size"))
    rows = rows if keep else light
    known = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # so that null joins with null
    salt = hex_slice(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 2) % SALTS

    def placed_in(df: DataFrame) -> DataFrame:
        return df.withColumn("known", known).withColumn("bucket", length_bucket(F.col("size"))).withColumn("salt", salt)

    rows = placed_in(rows)
    piles = placed_in(light).groupBy("known", "bucket", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.first("source").alias("source"))
    buckets = piles.groupBy("known", "bucket").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.first("source").alias("source"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    piles = piles.select("known", "bucket", "salt", F.coalesce(F.sum("n").over(upto(Window.partitionBy("known", "bucket").orderBy("salt"))), F.lit(0)).alias("in_bucket"))
    per_source = buckets.groupBy("known").agg(F.sum("words").alias("source_size"), F.first("source").alias("source"))
    aims = targets(per_source.select("source", "source_size"), most).withColumn("known", known).drop("source")
    buckets = buckets.select("known", "bucket", F.coalesce(F.sum("n").over(upto(Window.partitionBy("known").orderBy("bucket"))), F.lit(0)).alias("in_source"))
    starts = piles.join(buckets, ["known", "bucket"]).join(aims, "known")

    line = Window.partitionBy("known", "bucket", "salt").orderBy("doc_id", "size")
    placed = rows.withColumn("line", F.row_number().over(line)).join(starts, ["known", "bucket", "salt"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = placed.withColumn("rate", rate).withColumn("nth", (F.col("in_source") + F.col("in_bucket") + F.col("line")).cast("double")).withColumn("u", offset(F.col("source"), seed))
    copies = F.floor(F.col("rate") * F.col("nth") + F.col("u")) - F.floor(F.col("rate") * (F.col("nth") - 1.0) + F.col("u"))
    placed = placed.withColumn("copies", copies.cast("long"))
    return placed.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"kept_{c}").alias(c) for c in keep if c not in ("doc_id", "source")])


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixed corpus itself: each document as often as the mix takes it, with the columns of the input."""
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"), F.struct(*[F.col(c) for c in docs.columns]).alias("whole"))
    mixed = mix(whole, most=most, seed=seed, keep=("whole",)).where("copies > 0")
    return mixed.select("whole", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("whole.*")
