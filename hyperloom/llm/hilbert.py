"""Sharding by a Hilbert curve over metadata.

Each document becomes a point: every metadata dimension is quantised to the same
number of bits, a stateless function of the row, so no dictionary has to be built
or shipped. The point's index on the Hilbert curve orders the documents, and the
order is cut into runs. A run then spans a compact box of the metadata space, and a
reader that filters on any of the dimensions can skip whole shards by their zone map.

Order inside one cell of the curve is by a salt and then by id, so that a cell with a
third of all rows is ranked by many tasks. The only rows that meet in one task are
one count per cell, of which there are at most 2**(bits * dimensions).

Laws: ``rows`` (row counts of two shards differ by one at most) or ``bytes`` (a cut
falls within one document of its ideal place).

Null metadata is level 0. Null text has size 1 and crc 0. Null ids and repeated rows
are kept, each with a slot of its own. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, hex_slice

BITS = 5
SALTS = 256


def level_of_text(value: Column, bits: int = BITS) -> Column:
    """A category's level: equal values share a level, so equality filters prune."""
    return F.when(value.isNull(), F.lit(0)).otherwise(hex_slice(value.cast("string"), 6) % (1 << bits)).cast("int")


def level_of_number(value: Column, bits: int = BITS) -> Column:
    """A magnitude's level: twice its binary logarithm, rounded down, so ranges prune."""
    v = F.greatest(F.coalesce(value.cast("long"), F.lit(0)), F.lit(0)) + F.lit(1)
    power = F.length(F.bin(v)) - 1
    half = F.when(power > 0, F.pmod(F.floor(v / F.pow(F.lit(2.0), power - 1)), F.lit(2))).otherwise(F.lit(0))
    return F.least(power * 2 + half, F.lit((1 << bits) - 1)).cast("int")


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` mentions it: an expression would be repeated at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def curve_index(levels: list[Column], bits: int = BITS) -> Column:
    """Index of a cell on the Hilbert curve of ``len(levels)`` dimensions.

    The levels are folded bit by bit, highest first: each bit's reflection and
    exchange of axes is applied to the lower bits, then the Gray code of the axes is
    undone and their bits are interleaved.
    """
    n = len(levels)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])
    point = F.array(*[x.cast("int") for x in levels])

    def turn(p: Column, step: Column) -> Column:
        first, own, low = F.get(p, F.lit(0)), F.get(p, step["i"]), step["q"] - 1
        differ = first.bitwiseXOR(own).bitwiseAND(low)
        reflect = own.bitwiseAND(step["q"]) != 0
        return F.transform(
            p,
            lambda v, j: F.when(reflect & (j == 0), v.bitwiseXOR(low)).when(~reflect & (step["i"] != 0) & ((j == 0) | (j == step["i"])), v.bitwiseXOR(differ)).otherwise(v),
        )

    # axes to transposed Gray code: each axis takes the exclusive or of all before it
    def gray_of(turned: Column) -> Column:
        return F.transform(turned, lambda _, j: F.aggregate(F.slice(turned, F.lit(1), j + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))

    tops = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])

    def fixed(gray: Column) -> Column:
        fix = F.aggregate(tops, F.lit(0), lambda t, q: F.when(F.element_at(gray, -1).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return named(fix, lambda f: F.transform(gray, lambda v: v.bitwiseXOR(f).cast("long")))

    spots = F.array(*[F.struct(F.lit(float(1 << b)).alias("p"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])

    def woven(axes: Column) -> Column:
        return F.aggregate(spots, F.lit(0).cast("long"), lambda a, s: a * 2 + F.pmod(F.floor(F.get(axes, s["i"]) / s["p"]), F.lit(2)).cast("long"))

    return named(named(named(F.aggregate(steps, point, turn), gray_of), fixed), woven)


def shards(docs: DataFrame, n_shards: int = 8, law: str = "rows", doc_id: str = "doc_id", text: str = "text", categories: tuple[str, ...] = ("source", "lang"), numbers: tuple[str, ...] = ("n_chars",), bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, curve and the levels, one row per input row."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law}")
    names = [*categories, *numbers]
    levels = [level_of_text(F.col(c), bits) for c in categories] + [level_of_number(F.col(c), bits) for c in numbers]
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    points = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"), *[v.alias(f"level_{c}") for v, c in zip(levels, names, strict=True)])
    points = cut(points.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SALTS)).cast("int")))
    place = [f"level_{c}" for c in names]  # a cell of the curve, whose index is worked out once a cell

    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    piles = points.groupBy(*place, "salt").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    own = upto(Window.partitionBy(*place).orderBy("salt"))
    piles = piles.select(*place, "salt", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"{c}_in") for c in "nb"])
    every = Window.orderBy("curve")  # one row per cell of the curve, whatever the number of documents
    cells = points.groupBy(*place).agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    cells = cells.withColumn("curve", curve_index([F.col(c) for c in place], bits))
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.select(*place, "curve", *[F.coalesce(F.sum(c).over(upto(every)), F.lit(0)).alias(f"{c}_before") for c in "nb"], *[F.sum(c).over(whole).alias(f"{c}_all") for c in "nb"])
    starts = piles.join(F.broadcast(cells), place)  # at most 2**(bits * dimensions) rows

    line = Window.partitionBy(*place, "salt").orderBy("doc_id", "text_crc32", "size")
    placed = points.withColumn("n_line", F.row_number().over(line) - 1)
    if law == "bytes":
        placed = placed.withColumn("b_line", F.coalesce(F.sum("size").over(upto(line)), F.lit(0)))
    placed = placed.join(starts, [*place, "salt"])
    rank = (F.col("n_before") + F.col("n_in") + F.col("n_line")).cast("long")
    k = F.lit(n_shards).cast("long")
    if law == "rows":
        placed = placed.withColumn("rank", rank).withColumn("shard", F.expr(f"(rank * {n_shards}L) div n_all").cast("int"))
        slot = F.expr(f"rank - ((shard * n_all + {n_shards - 1}L) div {n_shards}L)")
    else:
        placed = placed.withColumn("rank", rank).withColumn("at", F.col("b_before") + F.col("b_in") + F.col("b_line"))
        placed = placed.withColumn("shard", F.least(k - 1, F.expr(f"(at * {n_shards}L) div b_all")).cast("int"))
        firsts = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))  # one row per shard
        placed = placed.join(F.broadcast(firsts), "shard")
        slot = F.col("rank") - F.col("first_rank")
    return placed.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", slot.cast("long").alias("slot"), "curve", *place)


def zone_map(assigned: DataFrame) -> DataFrame:
    """Per shard its rows, bytes and the least and greatest level of each dimension: what a reader prunes by."""
    levels = [c for c in assigned.columns if c.startswith("level_")]
    return assigned.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"), *[f(c).alias(f"{n}_{c[6:]}") for c in levels for n, f in (("min", F.min), ("max", F.max))])
