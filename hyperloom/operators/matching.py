"""Which texts contain which patterns: a nested loop for a handful of patterns, an index of grams for a dictionary that grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of grams: a pattern is looked for by its first characters, of the greatest of these lengths it has.
GRAMS = (16, 8, 4, 2, 1)
WINDOW = 512
#: Patterns up to which every text is compared with all.
FEW = 64


def contained(texts: DataFrame, patterns: DataFrame, keep: list[str], text: str = "text", pattern: str = "pattern", strategy: str | None = None, with_text: bool = False) -> DataFrame:
    """keep (which must tell the texts apart), pattern (``with_text``: and the text): once for each text and distinct pattern that occurs in it. Empty patterns match nothing.

    ``loop`` compares every text with every pattern, which are broadcast; ``gram`` joins the grams of the texts with the first gram of each pattern,
    and compares only what meets: while the dictionary is small enough to be broadcast no gram is shuffled. By default up to ``FEW`` patterns are looped over.
    """
    words = patterns.select(F.col(pattern).alias("pattern")).where(F.length("pattern") > 0).distinct()
    if strategy is None:
        strategy = "loop" if words.limit(FEW + 1).count() <= FEW else "gram"
    rows = texts.select(*keep, F.col(text).alias("_text"))
    out = [*keep, "pattern", *([F.col("_text").alias(text)] if with_text else [])]
    if strategy == "loop":
        return rows.join(F.broadcast(words), F.contains("_text", F.col("pattern"))).select(*out)
    size = F.lit(GRAMS[-1])
    for n in reversed(GRAMS):
        size = F.when(F.length("pattern") >= n, n).otherwise(size)
    keyed = words.withColumn("size", size).withColumn("gram", F.substring(F.col("pattern"), F.lit(1), F.col("size")))
    present = [r["size"] for r in keyed.select("size").distinct().collect()]  # as many rows as there are lengths
    if not present:
        return rows.withColumn("pattern", F.lit("")).select(*out).limit(0)

    # a place in a text is found by counting characters from its start, so long texts are first cut into windows
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.length("_text") - 1, F.lit(0)) / WINDOW).cast("int"))
    windows = rows.select(*keep, F.explode(F.transform(starts, lambda i: F.substring(F.col("_text"), i * WINDOW + 1, F.lit(WINDOW + GRAMS[0] - 1)))).alias("_part"))

    def grams(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.least(F.length("_part"), F.lit(WINDOW))), lambda i: F.substring(F.col("_part"), i, F.lit(n)))

    each = windows.select(*keep, F.explode(F.flatten(F.array(*map(grams, present)))).alias("gram"))
    likely = each.join(keyed.select("gram", "pattern"), "gram").select(*keep, "pattern").distinct()
    return rows.join(likely, keep).where(F.contains("_text", F.col("pattern"))).select(*out)
