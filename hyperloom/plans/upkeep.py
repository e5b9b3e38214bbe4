"""Plans over the upkeep of an ontology and over the ranker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.operators import build, canon, lineage, ranking, search

from . import searching
from . import standin as S
from .building import TYPED
from .catalogue import plan
from .folded import read
from .searching import doubted, typed
from .standin import sql

#: A discovery per document: domains, two triggers and two grounds are its first six words. Names that differ by case and signs only mean the same.
FOUND = """d AS (SELECT ws[1] AS source_domain, ws[2] AS target_domain, [coalesce(ws[3], ''), coalesce(ws[4], '')] AS triggers, [coalesce(ws[5], ''), coalesce(ws[6], '')] AS ground FROM (SELECT string_split(text, ' ') AS ws FROM documents) x WHERE ws[1] <> '' AND ws[2] <> ''),
cs AS (SELECT name, first_value(name) OVER (PARTITION BY class ORDER BY n DESC, name) AS canonical FROM (SELECT source_domain AS name, count(*) AS n, coalesce(nullif(lower(regexp_replace(source_domain, '[^\\p{L}]', '', 'g')), ''), source_domain) AS class FROM d GROUP BY source_domain) x),
ct AS (SELECT name, first_value(name) OVER (PARTITION BY class ORDER BY n DESC, name) AS canonical FROM (SELECT target_domain AS name, count(*) AS n, coalesce(nullif(lower(regexp_replace(target_domain, '[^\\p{L}]', '', 'g')), ''), target_domain) AS class FROM d GROUP BY target_domain) x)"""


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("text", " ")
    word = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit(""))
    return read(spark, sf_dir, "documents").select(word(0).alias("source_domain"), word(1).alias("target_domain"), F.array(word(2), word(3)).alias("triggers"), F.array(word(4), word(5)).alias("ground"))


def mapping(rows: DataFrame, side: str) -> DataFrame:
    """The canonical names of one side; each name is proposed to be the same as its letters in lower case."""
    counts = canon.pairs(rows).select(F.col(side).alias("name"), "n")
    letters = F.nullif(F.lower(F.regexp_replace("name", r"[^\p{L}]", "")), F.lit(""))
    return canon.classes(counts, counts.select("name", F.concat(F.lit("\0"), letters).alias("same_as")))


@plan("canonical_domains", f"WITH {FOUND} SELECT 'source' AS side, name, canonical FROM cs UNION ALL SELECT 'target', name, canonical FROM ct")
def canonical_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = discovered(spark, sf_dir)
    one = lambda side: mapping(rows, f"{side}_domain").select(F.lit(side).alias("side"), "name", "canonical")
    return one("source").union(one("target"))


@plan("merge_alarm", f"WITH {FOUND} SELECT count(DISTINCT name) AS n_names, count(DISTINCT canonical) AS n_classes, count(DISTINCT canonical) >= 0.95 * count(DISTINCT name) AS idle FROM cs")
def merge_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.merge_rate(mapping(discovered(spark, sf_dir), "source_domain"))


SPECS = f"""WITH {FOUND}, m AS (SELECT cs.canonical AS source_domain, ct.canonical AS target_domain, triggers, ground FROM d JOIN cs ON cs.name = d.source_domain JOIN ct ON ct.name = d.target_domain),
tw AS (SELECT source_domain, target_domain, word, count(*) AS n FROM (SELECT source_domain, target_domain, unnest(triggers) AS word FROM m) x WHERE word <> '' GROUP BY ALL),
gw AS (SELECT source_domain, target_domain, word, count(*) AS n FROM (SELECT source_domain, target_domain, unnest(ground) AS word FROM m) x WHERE word <> '' GROUP BY ALL),
bad AS (SELECT word FROM tw GROUP BY word HAVING length(word) < 2 OR count(*) > 3),
t8 AS (SELECT source_domain, target_domain, string_agg(word, ',' ORDER BY n DESC, word) AS words FROM (SELECT *, row_number() OVER (PARTITION BY source_domain, target_domain ORDER BY n DESC, word) AS nth FROM tw WHERE word NOT IN (SELECT word FROM bad)) x WHERE nth <= 8 GROUP BY ALL),
g8 AS (SELECT source_domain, target_domain, string_agg(word, ',' ORDER BY n DESC, word) AS words FROM (SELECT *, row_number() OVER (PARTITION BY source_domain, target_domain ORDER BY n DESC, word) AS nth FROM gw) x WHERE nth <= 8 GROUP BY ALL),
p AS (SELECT source_domain, target_domain, count(*) AS support, {TYPED} AS source_type FROM m GROUP BY ALL)
SELECT 'F_LLM_' || left(md5(p.source_domain || '||' || p.target_domain), 8) AS frame_id, 'C_LLM_' || left(md5(p.target_domain), 8) AS cascade_id, p.source_domain, p.target_domain, source_type,
  CASE WHEN source_type = 'GENERIC' THEN 'GENERIC' ELSE 'DISCOVERED::' || source_type || '_TO_' || p.target_domain END AS mapping_type, support, coalesce(t8.words, '') AS triggers, coalesce(g8.words, '') AS ground
FROM p LEFT JOIN t8 ON t8.source_domain = p.source_domain AND t8.target_domain = p.target_domain LEFT JOIN g8 ON g8.source_domain = p.source_domain AND g8.target_domain = p.target_domain"""


@plan("ontology_specs", SPECS)
def ontology_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and cascades of the discoveries once their domains have canonical names."""
    rows = discovered(spark, sf_dir)
    frames, cascades = canon.specs(rows, mapping(rows, "source_domain"), mapping(rows, "target_domain"), build.type_of(F.col("source_domain"), S.RULES))
    both = frames.join(cascades.select("cascade_id", *canon.PAIR), canon.PAIR)
    return both.select("frame_id", "cascade_id", *canon.PAIR, "source_type", "mapping_type", "support", F.array_join("triggers", ",").alias("triggers"), F.array_join("ground", ",").alias("ground"))


@plan("pair_histograms", f"WITH {FOUND} SELECT source_domain, target_domain, word, count(*) AS n FROM (SELECT source_domain, target_domain, unnest(triggers) AS word FROM d) x WHERE word <> '' GROUP BY ALL")
def pair_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.histogram(discovered(spark, sf_dir), "triggers")


FEATURES = ("f1", "f2", "f3")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label, f1 to f3: documents with a label of quality, and three numbers of their text."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    odd = F.length(F.regexp_replace("text", "[^%#$&*]", "")) / F.length("text")
    return docs.join(labels, "doc_id").select("doc_id", F.col("quality").cast("double").alias("label"), F.log1p("n_chars").alias("f1"), F.size(F.split("text", "\n")).cast("double").alias("f2"), odd.alias("f3"))


@plan("ranker_scores")
def ranker_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranker learned from all labelled documents, and what it says of each."""
    rows = judged(spark, sf_dir)
    return ranking.scored(rows, ranking.fit(rows, FEATURES, "label", "doc_id")).select("doc_id", F.round("score", 4).alias("score"))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, kind, the seven features, label: a kind of edges is right for a query that hits its frame."""
    edges = typed(spark, sf_dir)
    kinds, asked = search.kinds(edges), searching.queries(spark)
    features = search.strongest(asked, kinds, S.frames(spark), S.members(spark))
    words = S.frames(spark).select("frame_id", F.explode("triggers").alias("word"))
    hit = asked.join(words, F.contains(F.col("query_text"), F.col("word"))).select("query_id", "frame_id").distinct()
    own = kinds.join(hit, "frame_id").select("query_id", "kind").distinct().withColumn("label", F.lit(1.0))
    return lineage.cut(features.join(own, ["query_id", "kind"], "left").withColumn("label", F.coalesce("label", F.lit(0.0))))


@plan("trained_arm")
def trained_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk's best edge by the trained ranker, plain and discounted by reliability, beside the other arms."""
    rows = training_rows(spark, sf_dir)
    ranker = ranking.fit(rows.withColumn("key", F.concat_ws("|", "query_id", F.xxhash64("kind"))), search.FEATURES, "label", "key")
    out = search.arms(rows, doubted(typed(spark, sf_dir)), trained=ranker.chance())
    return out.select(F.col("query_id").cast("long").alias("query_id"), "chunk_id", "arm", F.round("score", 4).alias("score"))
