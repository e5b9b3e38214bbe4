"""Stand-in graph tables from the test tables: documents as chunks, their source as the document, and the small ontology of the dialect.

Spark builds them with the operators; ``SQL`` says the same in plain SQL, written apart from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.operators import build

from .dialect import FIXTURE, _literal
from .folded import read

#: Keywords of source types, first rule first.
RULES = [("FLUID", ["of"]), ("PATH", ["to", "is"]), ("BODY", ["der"])]
FIELDS = [("ROUTE", "to"), ("ROUTE", "from"), ("HOUSE", "den"), ("HOUSE", "des"), ("STAGE", "was"), ("STAGE", "que"), ("STAGE", "und")]
BRIDGES = [("ROUTE", "F_PATH"), ("HOUSE", "F_HOME"), ("STAGE", "F_BODY")]
MARKERS = ["is", "as", "ist", "est"]


def rows_of(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A table of literals, whose size the planner knows."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)} AS t({columns})")


def fixture(spark: SparkSession, name: str) -> DataFrame:
    head = next(h for h in FIXTURE if h.startswith(name + "("))
    return rows_of(spark, FIXTURE[head], head.split("(")[1].rstrip(")"))


def frames(spark: SparkSession) -> DataFrame:
    words = fixture(spark, "frame_trigger").groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("ord", "trigger"))).alias("t"))
    ground = fixture(spark, "frame_ground").groupBy("frame_id").agg(F.sort_array(F.collect_list("ground")).alias("ground"))
    rows = fixture(spark, "frame_spec").join(words, "frame_id", "left").join(ground, "frame_id", "left")
    none = F.array().cast("array<string>")
    return rows.withColumn("triggers", F.coalesce("t.trigger", none)).withColumn("ground", F.coalesce("ground", none)).drop("t")


def constraints(spark: SparkSession) -> DataFrame:
    return fixture(spark, "type_constraint")


def stops(spark: SparkSession) -> DataFrame:
    return fixture(spark, "stop_word").withColumn("exempt", F.array("exempt"))


def members(spark: SparkSession) -> DataFrame:
    return fixture(spark, "cascade_member")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("doc_id"), F.concat(F.lit("c"), F.col("doc_id")).alias("chunk_id"), F.col("doc_id").cast("int").alias("chunk_no"), "text")


def field_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.field_channel(chunks(spark, sf_dir), rows_of(spark, FIELDS, "field, word"), rows_of(spark, [(m,) for m in MARKERS], "word"), rows_of(spark, BRIDGES, "field, frame_id"))


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A discovery per chunk: its first two words are the domains, the third a trigger, and the number of its chunk gives the confidence."""
    w = F.split("text", " ")
    word = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit(""))
    rows = chunks(spark, sf_dir).select("chunk_id", word(0).alias("source_domain"), word(1).alias("target_domain"), F.array(word(2)).alias("triggers"), ((F.col("chunk_no") % 10) / F.lit(10.0)).alias("confidence"))
    return rows.where("source_domain <> '' and target_domain <> ''")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the first two channels, with their cascade."""
    found = build.trigger_channel(chunks(spark, sf_dir), frames(spark)).unionByName(field_rows(spark, sf_dir))
    return build.emitted(found, frames(spark), chunks(spark, sf_dir), constraints(spark), stops(spark), cascades=members(spark))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + str(v) + "'" for v in r) + ")" for r in rows)


#: Common tables of the plain SQL, each after those it needs.
SQL = {
    "ch": "SELECT source AS doc_id, 'c' || doc_id AS chunk_id, doc_id::INT AS chunk_no, text FROM documents",
    "ground_of": "SELECT s.frame_id, coalesce(list(g.ground ORDER BY g.ground) FILTER (g.ground IS NOT NULL), []) AS ground FROM frame_spec s LEFT JOIN frame_ground g ON g.frame_id = s.frame_id GROUP BY s.frame_id",
    "one": """SELECT c.chunk_id, t.frame_id, list(t.trigger ORDER BY t.trigger) AS triggers, min(instr(c.text, t.trigger)) - 1 AS low, max(length(c.text) - instr(reverse(c.text), reverse(t.trigger)) + 1) AS high,
        least(1.0::DOUBLE, 0.4::DOUBLE + 0.2::DOUBLE * count(*)) AS conf, 1 AS channel FROM ch c JOIN frame_trigger t ON instr(c.text, t.trigger) > 0 GROUP BY c.chunk_id, t.frame_id""",
    "w": "SELECT *, coalesce(sum(len(word) + 1) OVER (PARTITION BY chunk_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT chunk_id, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS pos FROM ch) x",
    "fw": f"SELECT * FROM (VALUES {_values(FIELDS)}) t(field, word)",
    "tagged": f"""SELECT * FROM (SELECT w.*, fw.field, max(CASE WHEN w.word IN ({', '.join(repr(m) for m in MARKERS)}) THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS marked,
        count(*) OVER (PARTITION BY chunk_id, field) AS same FROM w LEFT JOIN fw ON fw.word = w.word) x WHERE field IS NOT NULL""",
    "dom": "SELECT chunk_id, field AS dominant FROM (SELECT chunk_id, field, row_number() OVER (PARTITION BY chunk_id ORDER BY count(*) DESC, min(pos)) AS r FROM tagged GROUP BY chunk_id, field) x WHERE r = 1",
    "two": f"""SELECT t.chunk_id, b.frame_id, [t.word] AS triggers, t.start AS low, t.start + length(t.word) AS high, CASE WHEN marked = 1 THEN 0.5::DOUBLE ELSE 0.45::DOUBLE END AS conf, 2 AS channel
        FROM tagged t JOIN dom ON dom.chunk_id = t.chunk_id JOIN (VALUES {_values(BRIDGES)}) b(field, frame_id) ON b.field = t.field
        WHERE NOT (same >= 2 AND t.field = dominant) AND (marked = 1 OR (t.field <> dominant AND same = 1))""",
    "edges": """SELECT 'L1_' || left(md5(concat_ws('|', chunk_id, low::BIGINT, high::BIGINT, source_domain, target_domain)), 8) AS edge_id, * FROM (
        SELECT f.*, c.doc_id, c.chunk_no, s.source_domain, s.target_domain, s.source_type, s.ord, g.ground, m.cascade_id, round(f.conf, 3) AS confidence,
            row_number() OVER (PARTITION BY f.chunk_id, f.frame_id, f.low, f.high ORDER BY f.channel, f.triggers) AS nth
        FROM (SELECT * FROM one UNION ALL SELECT * FROM two) f JOIN ch c ON c.chunk_id = f.chunk_id JOIN frame_spec s ON s.frame_id = f.frame_id JOIN ground_of g ON g.frame_id = f.frame_id LEFT JOIN cascade_member m ON m.frame_id = f.frame_id
        WHERE (s.source_type, s.mapping_type) IN (SELECT (source_type, mapping_type) FROM type_constraint) AND f.conf >= 0.35
          AND NOT EXISTS (SELECT 1 FROM stop_word x WHERE list_contains(f.triggers, x.word) AND x.exempt <> s.source_domain)) y WHERE nth = 1""",
}


def sql(text: str) -> str:
    """The text with the fixtures and tables it needs in front."""
    import re

    from . import dialect

    need: list[str] = []
    heads = {h.split("(")[0]: h for h in FIXTURE}

    def visit(t: str) -> None:
        for name in [*SQL, *heads]:
            if name not in need and re.search(rf"(FROM|JOIN|,)\s+{name}\b", t):
                if name in SQL:
                    visit(SQL[name])
                need.append(name)

    visit(text)
    parts = [f"{n} AS ({SQL[n]})" if n in SQL else dialect.fixture(heads[n]) for n in need]
    body = re.sub(r"^\s*WITH\s+", "", text) if re.match(r"\s*WITH\s", text) else None
    if not parts:
        return text
    return f"WITH {', '.join(parts)}, {body}" if body else f"WITH {', '.join(parts)} {text}"
