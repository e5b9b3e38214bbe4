"""Tests on paired, stratified and resampled values. Ranks come from counts per distinct value, so no window spans the table.

Replicates resample by hash weights: a row's weight in a replicate is drawn from the hash of both, so one pass over the rows
gives all replicates, without positions, joins or collected rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

PIECES = 256
#: Rows up to which a table of a place and a value is broadcast (8 MB).
SMALL = 500_000


def p_normal(z: Column) -> Column:
    """Two-sided, by the complementary error function in Chebyshev form; its error is below 2e-7."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = 1 / (1 + 0.5 * x)
    terms = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly: Column = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def value_ranks(rows: DataFrame, value: str, within: list[str]) -> DataFrame:
    """within, value, n, rank: average ranks of distinct values, from their counts. Values are summed over pieces of their range, pieces over each other."""
    counts = rows.groupBy(*within, value).agg(F.count("*").alias("n"))
    low = counts.groupBy(*within).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300))
    if within:
        placed = counts.join(low, within)
    else:
        placed = counts.join(F.broadcast(low))  # one row
    placed = placed.withColumn("_piece", F.least(F.lit(PIECES - 1), F.floor((F.col(value) - F.col("_lo")) / width * PIECES)).cast("int"))
    sums = placed.groupBy(*within, "_piece").agg(F.sum("n").alias("_all"))
    upto = Window.partitionBy(*within).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # PIECES rows of a stratum
    starts = sums.select(*within, "_piece", F.coalesce(F.sum("_all").over(upto), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*within, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("_start")
    return placed.join(starts, [*within, "_piece"]).withColumn("_below", below).select(*within, value, "n", (F.col("_below") + (F.col("n") + 1) / 2.0).alias("rank"))


def wilcoxon(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n (differences that are not 0), w_plus, z, p: paired signed ranks, normal approximation with ties and continuity corrected; z is null below two differences."""
    d = pairs.select((F.col(a) - F.col(b)).alias("d")).where("d is not null and d <> 0").select(F.abs("d").alias("size"), (F.col("d") > 0).cast("int").alias("up"))
    ranks = value_ranks(d, "size", [])
    ups = d.groupBy("size").agg(F.sum("up").alias("ups"))
    sums = ranks.join(ups, "size").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("rank") * F.col("ups")).alias("w_plus"), F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    n = F.col("n").cast("double")
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = F.when((n >= 2) & (var > 0), (F.col("w_plus") - mean - F.when(F.col("w_plus") > mean, 0.5).otherwise(-0.5)) / F.sqrt(var))
    return sums.select("n", "w_plus", z.alias("z")).withColumn("p", p_normal(F.col("z")))


def sign_test(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """wins, n, p: the exact binomial test; null without differences. n may be large, see ``two_sided``."""
    sums = pairs.agg(F.sum((F.col(a) > F.col(b)).cast("long")).alias("wins"), F.sum((F.col(a) != F.col(b)).cast("long")).alias("n"))
    return sums.withColumn("p", two_sided(F.col("wins"), F.col("n")))


def two_sided(k: Column, n: Column) -> Column:
    """Exact two-sided binomial p at one half. The tail's terms follow from one another, from 1 at its largest, and end when they are negligible: after some multiple of the root of n."""
    low = F.least(k, n - k)
    upto = lambda m: F.when(m > 0, F.sequence(F.lit(1).cast("long"), m)).otherwise(F.array().cast("array<bigint>"))
    # ln of the largest term, C(n, low) / 2^n: factor by factor if there are few, else by Stirling's series about the mean
    few = F.aggregate(upto(F.least(low, F.lit(16).cast("long"))), -n * F.lit(math.log(2.0)), lambda s, i: s + F.log((n - low + i) / i))
    rest = lambda x: 1 / (12.0 * x) - 1 / (360.0 * x * x * x) + 1 / (1260.0 * x * x * x * x * x)
    nd, ld, hd = (c.cast("double") for c in (n, low, n - low))
    off = (2 * ld - nd) / nd
    many = -nd * ((1 + off) / 2 * F.log1p(off) + (1 - off) / 2 * F.log1p(-off)) + F.log(nd / (2 * math.pi * ld * hd)) / 2 + rest(nd) - rest(ld) - rest(hd)
    first = F.when(low <= 16, few).otherwise(many)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("all"))
    step = lambda s, j: F.struct((s["term"] * (low - j + 1) / (n - low + j)).alias("term"), (s["all"] + s["term"] * (low - j + 1) / (n - low + j)).alias("all"))
    tail = F.aggregate(upto(F.least(low, (64 + 12 * F.sqrt(nd)).cast("long"))), start, step)
    return F.when(n > 0, F.least(F.lit(1.0), 2 * F.exp(first + F.log(tail["all"]))))


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """only_a, only_b, p: of two yes-or-no outcomes per row, the exact test of those in which they differ."""
    sums = pairs.agg(F.sum((F.col(a) & ~F.col(b)).cast("long")).alias("only_a"), F.sum((~F.col(a) & F.col(b)).cast("long")).alias("only_b"))
    return sums.withColumn("p", F.coalesce(two_sided(F.col("only_a"), F.col("only_a") + F.col("only_b")), F.lit(1.0)))


def point_biserial(rows: DataFrame, value: str, positive: str) -> DataFrame:
    """n, r, t: the correlation of a value with a yes-or-no column, and its t statistic with n - 2 degrees of freedom."""
    one = rows.select(F.col(value).cast("double").alias("v"), F.col(positive).cast("double").alias("y")).where("v is not null and y is not null")
    sums = one.agg(F.count("*").alias("n"), F.corr("v", "y").alias("r"))
    return sums.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))


def conditional_auc(rows: DataFrame, value: str, positive: str, strata: list[str]) -> DataFrame:
    """auc, pairs, strata, informative: concordant pairs within strata over all such pairs, ties by half; null if no stratum has both outcomes."""
    return _conditional(rows.select(*strata, F.col(value).alias("v"), F.col(positive).alias("y"), F.lit(1).alias("w")), strata, []).drop("nothing")


def _conditional(rows: DataFrame, strata: list[str], also: list[str]) -> DataFrame:
    """The same of weighted rows (v, y, w), apart for each value of ``also``. Ranks are sums of weights below a value within a stratum."""
    counts = rows.groupBy(*also, *strata, "v").agg(F.sum(F.when(F.col("y"), F.col("w")).otherwise(0)).alias("p"), F.sum(F.when(~F.col("y"), F.col("w")).otherwise(0)).alias("q"))
    below = Window.partitionBy(*also, *strata).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("p") * (F.coalesce(F.sum("q").over(below), F.lit(0)) + F.col("q") / 2.0)
    layers = counts.withColumn("won", won).groupBy(*also, *strata).agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    live = layers.where("p + q > 0")
    pairs = F.sum(F.col("p") * F.col("q"))
    both = (F.col("p") > 0) & (F.col("q") > 0)
    return live.groupBy(*also).agg((F.sum("won") / F.when(pairs > 0, pairs)).alias("auc"), pairs.cast("long").alias("pairs"), F.count("*").alias("strata"), F.sum(both.cast("long")).alias("informative"))


def draws(key: Column, seed: int) -> Column:
    """A uniform number from 0 to 1 for each key and seed."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


#: Parts of the range of hashes that a stratum's threshold is sought in.
PARTS = 128


def stratified_permutation(rows: DataFrame, key: str, value: str, positive: str, strata: list[str], replicates: int = 4000, seed: int = 1) -> DataFrame:
    """auc, p, n: the conditional AUC against labels shuffled within strata. A stratum keeps its number of positives: the smallest hashes of a replicate get them.

    A value's mean rank in its stratum is the same in all replicates, so a replicate is a sum of ranks over its positives: summed over whole parts of the
    hashes' range, and row by row only in the part that holds a stratum's threshold. No replicate is sorted.
    """
    base = rows.select(*strata, F.col(key).alias("k"), F.col(value).alias("v"), F.col(positive).alias("y"), F.lit(1).alias("w"))
    known = _conditional(base, strata, []).select(F.col("auc").alias("observed"))
    # one column for the stratum, null ones included; a null value ranks below all
    named = base.select(F.to_json(F.struct(*strata)).alias("s"), "k", "y", F.coalesce(F.col("v").cast("double"), F.lit(float("-inf"))).alias("v"))
    ranks = value_ranks(named, "v", ["s"]).select("s", "v", "rank")
    ranked = cut(named.join(ranks, ["s", "v"]).select("s", "k", "rank"))  # both passes read it
    sizes = cut(named.groupBy("s").agg(F.coalesce(F.sum(F.col("y").cast("long")), F.lit(0)).alias("n_pos"), F.count("*").alias("size")))
    h = F.xxhash64("k", "rep", F.lit(seed))
    part = F.shiftright(h, 64 - (PARTS.bit_length() - 1))
    sums = replicated(ranked, replicates, "rep").groupBy("rep", "s", part.alias("part")).agg(F.count("*").alias("n"), F.sum("rank").alias("r"))
    upto = Window.partitionBy("rep", "s").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # PARTS rows
    sums = cut(sums.withColumn("to", F.sum("n").over(upto)).join(sizes, "s").where(F.col("to") - F.col("n") < F.col("n_pos")).select("rep", "s", "part", "r", (F.col("n_pos") - F.col("to") + F.col("n")).alias("need"), (F.col("to") <= F.col("n_pos")).alias("whole")))
    ends = sums.where("not whole").groupBy("s").agg(F.sort_array(F.collect_list(F.struct("rep", "part", "need"))).alias("ends"))
    few = sizes.count() * replicates <= SMALL
    met = ranked.join(ends.hint("broadcast") if few else ends, "s").select("s", "k", "rank", F.explode("ends").alias("e")).select("s", "k", "rank", F.col("e.rep").alias("rep"), "e.part", "e.need")
    order = Window.partitionBy("rep", "s").orderBy("h", "k")  # one part of PARTS
    last = met.where(part == F.col("part")).withColumn("h", h).withColumn("nth", F.row_number().over(order)).where("nth <= need")
    won = sums.where("whole").select("rep", "s", "r").union(last.select("rep", "s", F.col("rank"))).groupBy("rep").agg(F.sum("r").alias("r"))
    p, q = F.col("n_pos").cast("double"), (F.col("size") - F.col("n_pos")).cast("double")
    full = sizes.agg(F.sum(p * q).alias("pairs"), F.sum(p * (p + 1) / 2).alias("least"))
    null = won.join(F.broadcast(full)).where("pairs > 0").select(((F.col("r") - F.col("least")) / F.col("pairs")).alias("auc"))
    sums = null.join(F.broadcast(known)).agg(F.first("observed").alias("auc"), F.count("*").alias("n"), F.sum((F.col("auc") >= F.col("observed")).cast("long")).alias("above"))
    return sums.select("auc", ((F.col("above") + 1) / (F.col("n") + 1)).alias("p"), "n")


def stratified_z(rows: DataFrame, value: str, stratum: str) -> DataFrame:
    """rows with z: a value's distance from the mean of its stratum in deviations of it, of all rows' where the stratum has none. Only sums of strata meet, so no task holds a stratum."""
    of = cut(rows.groupBy(F.col(stratum).alias("_s")).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_d")))
    every = rows.agg(F.stddev_samp(value).alias("_all"))
    met = rows.join(of.hint("broadcast") if of.count() <= SMALL else of, F.col(stratum).eqNullSafe(F.col("_s"))).join(F.broadcast(every))  # one row
    spread = F.coalesce(F.nullif("_d", F.lit(0.0)), F.col("_all"))
    return met.withColumn("z", (F.col(value) - F.col("_m")) / F.nullif(spread, F.lit(0.0))).drop("_s", "_m", "_d", "_all")


def poisson(u: Column, most: int = 8) -> Column:
    """A Poisson number of mean 1 from a uniform one: how often a bootstrap draws a row."""
    cuts, total, term = [], 0.0, math.exp(-1.0)
    for k in range(most):
        total += term
        cuts.append(total)
        term /= k + 1
    out: Column = F.lit(0)
    for c in cuts:
        out = out + (u >= c).cast("int")
    return out


def bootstrap_difference(pairs: DataFrame, key: str, a: str, b: str, group: str | None = None, replicates: int = 2000, seed: int = 1) -> DataFrame:
    """difference, low, high: mean of a minus b over pairs, and the 2.5 and 97.5 percentiles over replicates; groups are drawn whole if ``group`` is named.

    Every draw is a Poisson weight by hash of the row's (or group's) key, so pairs stay pairs. The rows of a replicate are summed before anything is shuffled.
    """
    unit = F.col(group or key).cast("string")
    d = pairs.select(unit.alias("u"), (F.col(a) - F.col(b)).alias("d")).groupBy("u").agg(F.sum("d").alias("s"), F.count("d").alias("n"))
    weight = poisson(F.pmod(F.xxhash64("u", "rep", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    each = d.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight)
    means = each.groupBy("rep").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return d.agg((F.sum("s") / F.sum("n")).alias("difference")).join(ends)  # one row each


def size_matched_null(sets: DataFrame, vocabulary: DataFrame, live: DataFrame, replicates: int = 200, seed: int = 1) -> DataFrame:
    """k, n, real, random: by size of a row's set, how often it meets its document's live domains, and how often a random set of that size does.

    sets: row_id, doc_id, domains; vocabulary: domain; live: doc_id, domain. The vocabulary is an ontology's, so its draws are formed once for each replicate and shared:
    the k smallest hashes of a replicate and row are a random set of k.
    """
    rows = sets.select("row_id", "doc_id", "domains", F.size("domains").alias("k"))
    owned = live.groupBy("doc_id").agg(F.collect_set("domain").alias("own"))
    rows = rows.join(owned, "doc_id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    words = vocabulary.select("domain").distinct().agg(F.sort_array(F.collect_list("domain")).alias("all"))  # an ontology's domains
    each = rows.join(F.broadcast(words)).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = F.slice(F.array_sort(F.transform("all", lambda w: F.struct(F.xxhash64(w, F.col("row_id"), F.col("rep"), F.lit(seed)).alias("h"), w.alias("w")))), F.lit(1), F.greatest(F.col("k"), F.lit(1)))
    chance = F.when(F.col("k") > 0, F.arrays_overlap(F.transform(drawn, lambda x: x["w"]), F.col("own"))).otherwise(False)
    hits = each.groupBy("k").agg((F.count("*") / replicates).cast("long").alias("n"), F.avg(F.arrays_overlap("domains", "own").cast("double")).alias("real"), F.avg(chance.cast("double")).alias("random"))
    return hits


def within_rank_correlation(rows: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """group, n, rho: the rank correlation of two values inside each group."""
    ra = value_ranks(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, [group]).select(group, a, F.col("rank").alias("ra"))
    rb = value_ranks(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()), b, [group]).select(group, b, F.col("rank").alias("rb"))
    both = rows.select(group, a, b).join(ra, [group, a]).join(rb, [group, b])
    return both.groupBy(group).agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"))


def numbered(rows: DataFrame, key: str, name: str = "k") -> DataFrame:
    """rows with their place in the order of ``key``, from 0: numbered within pieces of the keys' range, pieces one after the other, so that no task holds them all."""
    cuts = rows.agg(F.percentile_approx(key, [i / PIECES for i in range(1, PIECES)])).first()[0] or []
    piece = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(key))) if cuts else F.lit(0)
    rows = rows.withColumn("_piece", piece)
    upto = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # PIECES rows
    starts = rows.groupBy("_piece").agg(F.count("*").alias("_n")).select("_piece", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_piece").orderBy(key)) - 1
    return rows.withColumn("_in", inside).join(F.broadcast(starts), "_piece").withColumn(name, F.col("_start") + F.col("_in")).drop("_piece", "_in", "_start")


def replicated(rows: DataFrame, runs: int, name: str = "i") -> DataFrame:
    """Each row once for each run from 1. The rows are dealt out before, as the planner takes them for no more than they were."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism * 4, 32)).withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(runs))))


def bootstrap_means(rows: DataFrame, key: str, value: str, runs: int) -> DataFrame:
    """i, m: the mean of the values drawn in each run. Draw k of run i takes the value in place md5(i|k) modulo the number of rows, in the order of ``key``."""
    told = numbered(rows.select(key, value), key).select("k", value)
    n = rows.count()
    draws = replicated(told.select("k"), runs).select("i", (F.conv(F.substring(F.md5(F.concat_ws("|", "i", "k")), 1, 7), 16, 10).cast("long") % max(n, 1)).alias("k"))
    # the hints keep the planner, which takes the draws for a few rows, from broadcasting them
    return draws.join(told.hint("broadcast") if n <= SMALL else told.hint("shuffle_hash"), "k").groupBy("i").agg(F.avg(value).alias("m"))


def permuted_differences(rows: DataFrame, values: DataFrame, key: str, label: str, value: str, runs: int) -> DataFrame:
    """i, m: the difference of the values' means between labels 1 and 0 in each run, in which the rows in the order of md5(i|key) get the values in the order of ``key``.

    Only rows of another label than 0 meet their values; the sums of label 0 are what remains of all.
    """
    told = numbered(values.select(key, value), key).select((F.col("k") + 1).alias("k"), value)
    order = Window.partitionBy("i").orderBy("_h", key)
    dealt = replicated(rows.select(key, label), runs).select("i", key, label, F.unhex(F.md5(F.concat_ws("|", "i", key))).alias("_h"))
    dealt = dealt.withColumn("k", F.row_number().over(order).cast("long")).select("i", label, "k")
    n = values.count()
    met = dealt.where(~F.col(label).eqNullSafe(F.lit(0))).join(told.hint("broadcast") if n <= SMALL else told.hint("shuffle_hash"), "k")
    one = F.col(label) == 1
    known = F.col(value).isNotNull()
    sums = met.groupBy("i").agg(
        F.sum(F.when(one, F.col(value))).alias("s1"), F.count(F.when(one, F.col(value))).alias("n1"), F.coalesce(F.sum(value), F.lit(0)).alias("s"), F.count(value).alias("n"),
    )
    full = values.agg(F.coalesce(F.sum(F.when(known, F.col(value))), F.lit(0)).alias("all_s"), F.count(value).alias("all_n"))
    every = rows.sparkSession.range(1, runs + 1).select(F.col("id").cast("int").alias("i")).join(sums, "i", "left").join(F.broadcast(full))  # one row
    none = lambda c: F.coalesce(c, F.lit(0))
    mean = lambda s, n: s.cast("double") / F.when(n > 0, n)
    return every.select("i", (mean(F.col("s1"), F.col("n1")) - mean(F.col("all_s") - none("s"), F.col("all_n") - none("n"))).alias("m"))
