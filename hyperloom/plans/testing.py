"""Plans over paired, stratified and resampled tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.operators import inference

from .catalogue import plan
from .folded import read
from .relational import sql_of

#: Each order's first two lines, paired.
PAIRS = "SELECT a.l_orderkey AS k, a.l_quantity AS a, b.l_quantity AS b, a.l_returnflag AS flag, a.l_partkey AS part FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").where("l_linenumber in (1, 2)")
    own = lines.where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("a"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part"))
    return own.join(lines.where("l_linenumber = 2").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("b")), "k")


@plan("wilcoxon", f"""WITH p AS ({PAIRS}), d AS (SELECT abs(a - b) AS s, a > b AS up FROM p WHERE a <> b),
r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM d),
t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS c FROM d GROUP BY s) x),
w AS (SELECT count(*) AS n, sum(r) FILTER (up) AS w_plus, any_value(ties) AS ties FROM r, t)
SELECT n, round(w_plus, 1) AS w_plus, round((w_plus - n * (n + 1) / 4.0::DOUBLE - CASE WHEN w_plus > n * (n + 1) / 4.0::DOUBLE THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM w""")
def wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.wilcoxon(pairs(spark, sf_dir), "a", "b").select("n", F.round("w_plus", 1).alias("w_plus"), F.round("z", 6).alias("z"))


@plan("sign_test", f"""WITH p AS ({PAIRS}), s AS (SELECT count(*) FILTER (a > b) AS wins, count(*) FILTER (a <> b) AS n FROM p)
SELECT wins, n, round(least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM range(0, 100000) x(i) WHERE i <= least(wins, n - wins))), 6) AS p FROM s""")
def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.sign_test(pairs(spark, sf_dir), "a", "b").select("wins", "n", F.round("p", 6).alias("p"))


@plan("mcnemar_exact", """WITH s AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS only_a, count(*) FILTER (quality = 0 AND toxic = 1) AS only_b FROM labels)
SELECT only_a, only_b, round(least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))) FROM range(0, 100000) x(i) WHERE i <= least(only_a, only_b))), 6) AS p FROM s""")
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return inference.mcnemar(rows, "a", "b").select("only_a", "only_b", F.round("p", 6).alias("p"))


@plan("point_biserial", """WITH s AS (SELECT count(*) AS n, corr(d.n_chars::DOUBLE, l.quality::DOUBLE) AS r FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT n, round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t FROM s""")
def point_biserial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    return inference.point_biserial(rows, "n_chars", "quality").select("n", F.round("r", 6).alias("r"), F.round("t", 6).alias("t"))


STRATA = "SELECT l_partkey % 7 AS s, l_suppkey % 3 AS s2, l_quantity AS v, l_returnflag = 'R' AS y FROM lineitem"


@plan("cond_auc", f"""WITH r AS ({STRATA}), k AS (SELECT s, s2, y, rank() OVER (PARTITION BY s, s2 ORDER BY v) + (count(*) OVER (PARTITION BY s, s2, v) - 1) / 2.0::DOUBLE AS r FROM r),
g AS (SELECT s, s2, count(*) FILTER (y)::DOUBLE AS p, count(*) FILTER (NOT y)::DOUBLE AS q, sum(r) FILTER (y) AS rp FROM k GROUP BY s, s2)
SELECT round(sum(CASE WHEN p * q > 0 THEN rp - p * (p + 1) / 2 END) / sum(p * q), 6) AS auc, sum(p * q)::BIGINT AS pairs, count(*) AS strata, count(*) FILTER (p > 0 AND q > 0) AS informative FROM g""")
def cond_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 7).alias("s"), (F.col("l_suppkey") % 3).alias("s2"), F.col("l_quantity").alias("v"), (F.col("l_returnflag") == "R").alias("y"))
    return inference.conditional_auc(rows, "v", "y", ["s", "s2"]).select(F.round("auc", 6).alias("auc"), "pairs", "strata", F.col("informative").cast("long").alias("informative"))


@plan("stratified_permutation")
def stratified_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.col("n_chars").alias("v"), (F.col("quality") == 1).alias("y"), "lang")
    return inference.stratified_permutation(rows, "doc_id", "v", "y", ["lang"], 200)


@plan("paired_bootstrap")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.bootstrap_difference(pairs(spark, sf_dir), "k", "a", "b", group="part")


@plan("size_matched_null")
def size_matched_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types stand in for domains: each user's set against the type its group of users spends most on."""
    events = read(spark, sf_dir, "events")
    sets = events.groupBy(F.col("user_id").alias("row_id"), (F.col("user_id") % 10).alias("doc_id")).agg(F.collect_set(F.when(F.col("value") > 150, F.col("event_type"))).alias("domains"))
    spent = events.groupBy((F.col("user_id") % 10).alias("doc_id"), "event_type").agg(F.sum("value").alias("spent"))
    live = spent.groupBy("doc_id").agg(F.max_by("event_type", F.struct("spent", "event_type")).alias("domain"))
    return inference.size_matched_null(sets, events.select(F.col("event_type").alias("domain")), live)


@plan("within_rank_correlation", """WITH r AS (SELECT l_returnflag AS g, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS a,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem)
SELECT g, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY g""")
def within_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), "l_quantity", "l_extendedprice")
    return inference.within_rank_correlation(rows, "g", "l_quantity", "l_extendedprice").select("g", "n", F.round("rho", 6).alias("rho"))


@plan("morphology", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type), u AS (SELECT user_id, sum(n)::DOUBLE AS total, sum(n * n)::DOUBLE AS squares, list_sort(list(n)) AS ns FROM c GROUP BY user_id)
SELECT user_id, round(squares / (total * total), 6) AS hhi, round((ln(total) - list_sum(list_transform(ns, lambda n: n * ln(n))) / total) / ln(2), 6) AS entropy FROM u""")
def morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a user's events spread over types: concentration from whole counts, entropy summed in the order of the counts."""
    counts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    users = counts.groupBy("user_id").agg(F.sum("n").cast("double").alias("total"), F.sum(F.col("n") * F.col("n")).cast("double").alias("squares"), F.sort_array(F.collect_list("n")).alias("ns"))
    spread = F.aggregate("ns", F.lit(0.0), lambda s, n: s + n * F.log(n.cast("double")))
    return users.select("user_id", F.round(F.col("squares") / (F.col("total") * F.col("total")), 6).alias("hhi"), F.round((F.log("total") - spread / F.col("total")) / F.log(F.lit(2.0)), 6).alias("entropy"))


@plan("bootstrap_ci", sql_of("bootstrap_ci"))
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle 95% of 2,000 resampled means of the quality labels."""
    means = inference.bootstrap_means(read(spark, sf_dir, "labels"), "doc_id", "quality", 2000).select(F.round("m", 9).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))


@plan("permutation_p", sql_of("permutation_p"))
def permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic and other documents by length, against 1,000 permutations."""
    rows = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    sized = rows.join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    mean = lambda y: F.avg(F.when(F.col("toxic") == y, F.col("n_chars")))
    told = sized.agg((mean(1) - mean(0)).alias("t"))
    runs = inference.permuted_differences(rows, sized.select("doc_id", "n_chars"), "doc_id", "toxic", "n_chars", 1000).join(F.broadcast(told))  # one row
    beyond = F.sum(F.when(F.abs("m") >= F.abs("t"), 1).otherwise(0))
    return runs.agg(F.round((1 + beyond) / (1.0 + F.count("*")), 6).alias("p"))


@plan("stratified_z", sql_of("stratified_z"))
def stratified_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by value, against those of their type."""
    return inference.stratified_z(read(spark, sf_dir, "events"), "value", "event_type").select("event_id", F.round("z", 4).alias("z"))
