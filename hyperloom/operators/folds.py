"""Order-dependent operators, as folds over sorted arrays: one shuffle to bring a group together, then built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyperloom.functions.text import verbatim


def chain_link(edges: DataFrame, group: list[str], order: str, ground: str, gap: int = 3) -> DataFrame:
    """Per group, the chain of edges in which each is nearer than ``gap`` to the last one accepted and shares ground with it.

    An edge that does not fit is skipped and the chain goes on; groups of fewer than two accepted edges give no chain.
    """
    item = F.struct(F.col(order).alias("at"), F.col(ground).alias("ground"))
    rows = edges.groupBy(*group).agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.slice("items", 1, 1)

    def step(chain: Column, x: Column) -> Column:
        last = F.element_at(chain, -1)
        fits = (x["at"] - last["at"] < gap) & (F.size(F.array_intersect(x["ground"], last["ground"])) >= 1)
        return F.when(fits, F.concat(chain, F.array(x))).otherwise(chain)

    chain = F.aggregate(F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0))), start, step)
    return rows.select(*group, F.transform(chain, lambda x: x["at"]).alias("chain")).where(F.size("chain") >= 2)


def _taking(quota: Column):  # noqa: ANN202
    def step(a: Column, x: Column) -> Column:
        more = F.struct((a["used"] + x["size"]).alias("used"), (a["n"] + 1).alias("n"))
        return F.when(a["used"] + x["size"] <= quota, more).otherwise(a)

    return step


def pack(ranked: DataFrame, query: str, kind: str, rank: str, size: str, budget: int, shares: dict[str, float]) -> DataFrame:
    """Greedy packing per query: kinds in the given order, each with its share and what the ones before left; too large items are skipped."""
    item = lambda k: F.sort_array(F.collect_list(F.when(F.col(kind) == k, F.struct(F.col(rank).alias("rank"), F.col(size).cast("long").alias("size")))))
    rows = ranked.groupBy(query).agg(*[item(k).alias(f"items_{k}") for k in shares])
    left: Column = F.lit(0).cast("long")
    out = [F.col(query)]
    for k, share in shares.items():
        quota = F.lit(int(budget * share)).cast("long") + left
        zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("n"))
        acc = F.aggregate(f"items_{k}", zero, _taking(quota))
        rows = rows.withColumn(f"acc_{k}", acc).withColumn(f"left_{k}", quota - F.col(f"acc_{k}.used"))
        left = F.col(f"left_{k}")
        out += [F.col(f"acc_{k}.n").alias(f"n_{k}"), F.col(f"acc_{k}.used").alias(f"used_{k}")]
    return rows.select(*out)


def chunk_text(docs: DataFrame, doc_id: str, text: str, limit: int = 500, carry: int = 50, most: int = 40) -> DataFrame:
    """Lines packed greedily into chunks of ``limit`` characters, each beginning with the last ``carry`` of the one before.

    A chunk of over 1.6 ``limit`` then gives pieces of ``limit``, each ``limit - carry`` after the one before, while more than that is left. Only then the first ``most`` count.
    """
    stride, long = limit - carry, limit * 8 // 5
    acc = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, line: Column) -> Column:
        full = (F.length(a["open"]) > 0) & (F.length(a["open"]) + F.length(line) + 1 > limit)
        tail = F.substring(a["open"], F.greatest(F.length(a["open"]) - carry + 1, F.lit(1)), F.lit(carry))
        joined = F.when(F.length(a["open"]) > 0, F.concat(a["open"], F.lit("\n"), line)).otherwise(line)
        return F.when(full, F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), F.concat(tail, line).alias("open"))).otherwise(F.struct(a["done"].alias("done"), joined.alias("open")))

    folded = F.aggregate(F.filter(F.split(F.col(text), "\n"), lambda x: F.length(x) > 0), acc, step, lambda a: F.when(F.length(a["open"]) > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))

    def pieces(c: Column) -> Column:
        cuts = F.greatest(F.ceil((F.length(c) - long) / stride), F.lit(0)).cast("int")
        at = lambda i: i * stride + 1
        return F.transform(F.sequence(F.lit(0), cuts), lambda i: F.when(i < cuts, F.substring(c, at(i), F.lit(limit))).otherwise(F.substring(c, at(i), F.length(c))))

    return docs.select(F.col(doc_id), F.posexplode(F.slice(F.flatten(F.transform(folded, pieces)), 1, most)).alias("chunk", "chunk_text"))


#: The falling thresholds: 0.5 less 0.1 again and again, in double precision.
THRESHOLDS = [0.5, 0.4, 0.30000000000000004, 0.20000000000000004, 0.10000000000000003, 2.7755575615628914e-17]


def adaptive_threshold(scored: DataFrame, query: str, score: str, density: float, least: int = 50, most: int = 150) -> DataFrame:
    """Per query the first threshold that keeps enough candidates, and how many it keeps; dense graphs cap the number."""
    kept = [F.sum((F.col(score) >= t).cast("long")).alias(f"k{i}") for i, t in enumerate(THRESHOLDS)]
    rows = scored.groupBy(query).agg(F.count("*").alias("n"), *kept)
    want = F.least(F.lit(least), F.col("n"))
    pick: Column = F.lit(len(THRESHOLDS) - 1)
    for i in range(len(THRESHOLDS) - 2, -1, -1):
        pick = F.when(F.col(f"k{i}") >= want, F.lit(i)).otherwise(pick)
    regime = "low" if density <= 2.35 else "mid" if density <= 5 else "high"
    n_kept = F.element_at(F.array(*[F.col(f"k{i}") for i in range(len(THRESHOLDS))]), pick + 1)
    n_kept = F.least(n_kept, F.lit(most)) if regime == "high" else n_kept
    return rows.select(query, pick.alias("n_decays"), F.element_at(F.array(*[F.lit(t) for t in THRESHOLDS]), pick + 1).alias("threshold"), n_kept.alias("n_selected"), F.lit(regime).alias("regime"))


def greedy_groups(frames: DataFrame, frame_id: str, support: str, ground: str, least: float = 0.34) -> DataFrame:
    """Greedy grouping by Jaccard similarity with the group's running union, strongest support first. Ontologies are small: one array."""
    item = F.struct((-F.col(support)).alias("s"), F.col(frame_id).alias("id"), F.col(ground).alias("ground"))
    rows = frames.agg(F.sort_array(F.collect_list(item)).alias("items"))
    kind = "array<struct<ids:array<string>,all:array<string>>>"

    def step(groups: Column, x: Column) -> Column:
        sims = F.transform(groups, lambda g: F.size(F.array_intersect(g["all"], x["ground"])) / F.greatest(F.lit(1), F.size(F.array_union(g["all"], x["ground"]))))
        best = F.array_max(sims)
        at = F.array_position(sims, best)
        own = F.array(F.struct(F.array(x["id"]).alias("ids"), x["ground"].alias("all")))
        grown = F.transform(groups, lambda g, i: F.when(i + 1 == at, F.struct(F.concat(g["ids"], F.array(x["id"])).alias("ids"), F.array_union(g["all"], x["ground"]).alias("all"))).otherwise(g))
        return F.when(best >= least, grown).otherwise(F.concat(groups, own))

    groups = F.aggregate("items", F.array().cast(kind), step)
    return rows.select(F.posexplode(groups).alias("grp", "g")).select("grp", F.array_join(F.array_sort("g.ids"), ",").alias("members"))


def spans_of_trigger(docs: DataFrame, doc_id: str, text: str, trigger: Column) -> DataFrame:
    """All non-overlapping occurrences with their offsets, from the lengths of what lies between them."""
    between = F.split(F.col(text), verbatim(trigger), -1)
    rows = docs.select(F.col(doc_id), trigger.alias("trigger"), F.posexplode(F.transform(between, F.length)).alias("nth", "chars"), F.size(between).alias("parts"))
    before = Window.partitionBy(doc_id, "trigger").orderBy("nth")
    start = F.sum("chars").over(before) + F.col("nth") * F.length("trigger")
    return rows.withColumn("start", start.cast("long")).where(F.col("nth") < F.col("parts") - 1).select(doc_id, "trigger", "start", (F.col("start") + F.length("trigger")).alias("end"))
