"""One relational text for two engines: the few places where their SQL differs are written as marks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: The ontology of the plans: fixed rows, the same in both engines. Domains and triggers are frequent words of the documents.
FIXTURE = {
    "frame_spec(frame_id, ord, source_domain, target_domain, mapping_type, source_type, support)": [
        ("F_FLOW", 1, "of the", "tion", "structural", "FLUID", 5), ("F_PATH", 2, "to", "was", "orientational", "PATH", 3), ("F_BODY", 3, "der", "und", "ontological", "BODY", 2),
        ("F_HOME", 4, "que", "los", "structural", "SPACE", 4), ("F_RISE", 5, "is", "tion", "orientational", "PATH", 1), ("F_LIGHT", 6, "de", "ment", "structural", "LIGHT", 2),
        ("F_SELF", 7, "le", "le", "structural", "GENERIC", 1), ("F_ORPHAN", 8, "en", "was", "ontological", "BODY", 1),
    ],
    "frame_trigger(frame_id, trigger, ord)": [
        ("F_FLOW", "tion", 1), ("F_FLOW", "ing", 2), ("F_PATH", "was", 1), ("F_PATH", "with", 2), ("F_BODY", "und", 1), ("F_BODY", "ung", 2), ("F_HOME", "los", 1), ("F_HOME", "ción", 2),
        ("F_RISE", "tion", 1), ("F_RISE", "that", 2), ("F_LIGHT", "ment", 1), ("F_LIGHT", "eau", 2), ("F_SELF", "le", 1), ("F_ORPHAN", "eux", 1),
    ],
    "frame_ground(frame_id, ground)": [("F_FLOW", "move"), ("F_FLOW", "mass"), ("F_PATH", "move"), ("F_PATH", "aim"), ("F_BODY", "form"), ("F_HOME", "form"), ("F_HOME", "mass"), ("F_RISE", "move"), ("F_LIGHT", "see"), ("F_ORPHAN", "form")],
    "cascade_member(cascade_id, frame_id, ord)": [("C_MOTION", "F_FLOW", 1), ("C_MOTION", "F_PATH", 2), ("C_FORM", "F_BODY", 1), ("C_FORM", "F_HOME", 2), ("C_LLM_UP", "F_RISE", 1), ("C_LLM_UP", "F_LIGHT", 2)],
    "type_constraint(source_type, mapping_type)": [("FLUID", "structural"), ("PATH", "orientational"), ("BODY", "ontological"), ("SPACE", "structural"), ("LIGHT", "ontological"), ("GENERIC", "structural")],
    "stop_word(word, exempt)": [("that", "is"), ("with", "de"), ("ing", "of the")],
    "query_set(query_id, query_text)": [(1, "tion and with"), (2, "und der"), (3, "los que"), (4, "nothing"), (5, "ment tion was")],
}


def _literal(v: object) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def fixture(head: str) -> str:
    name, columns = re.match(r"(\w+)\((.*)\)", head).groups()
    rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in FIXTURE[head])
    return f"{name} AS (SELECT * FROM (VALUES {rows}) AS t({columns}))"


#: Relations many plans start from. Edges: one per document and admissible frame, with the triggers found in it.
SHARED = {
    "hit": "SELECT d.doc_id, t.frame_id, t.trigger, t.ord FROM documents d JOIN frame_trigger t ON contains(d.text, t.trigger)",
    "edge": """SELECT 'L1_' || substr(md5(concat(doc_id, '|', f.frame_id)), 1, 8) AS edge_id, h.doc_id, f.frame_id, f.ord, f.source_domain, f.target_domain, f.source_type, m.cascade_id,
        h.n_triggers, round(least(1.0E0, 0.4E0 + 0.2E0 * h.n_triggers), 3) AS confidence, (SELECT count(*) FROM frame_ground g WHERE g.frame_id = f.frame_id) AS n_ground
        FROM (SELECT doc_id, frame_id, count(*) AS n_triggers FROM hit GROUP BY doc_id, frame_id) h
        JOIN frame_spec f ON f.frame_id = h.frame_id LEFT JOIN cascade_member m ON m.frame_id = f.frame_id
        WHERE EXISTS (SELECT 1 FROM type_constraint c WHERE c.source_type = f.source_type AND c.mapping_type = f.mapping_type)""",
    "beside": "SELECT e.*, e.doc_id + o.o AS spot FROM edge e CROSS JOIN (SELECT -2 AS o UNION ALL SELECT -1 UNION ALL SELECT 0 UNION ALL SELECT 1 UNION ALL SELECT 2) o",  # edges that lie at most two documents from a spot
    # an ontology that grows with the documents: a frame for each pair of first words, with the words behind them as grounds and triggers
    "wide_pair": "SELECT * FROM (SELECT doc_id, lang, source, split_part(text, ' ', 1) AS s, split_part(text, ' ', 2) AS t, split_part(text, ' ', 3) AS g1, split_part(text, ' ', 4) AS g2, split_part(text, ' ', 5) AS w1, split_part(text, ' ', 6) AS w2 FROM documents WHERE text IS NOT NULL) x WHERE s <> '' AND t <> ''",
    "wide_spec": """SELECT concat('F_', substr(md5(concat(s, '||', t)), 1, 16)) AS frame_id, min(doc_id) AS ord, s AS source_domain, t AS target_domain, CASE min(lang) WHEN 'en' THEN 'structural' WHEN 'de' THEN 'ontological' ELSE 'orientational' END AS mapping_type,
        CASE min(lang) WHEN 'en' THEN 'FLUID' WHEN 'de' THEN 'BODY' WHEN 'fr' THEN 'PATH' ELSE 'GENERIC' END AS source_type, count(*) AS support FROM wide_pair GROUP BY s, t""",
    "wide_word": "SELECT concat('F_', substr(md5(concat(s, '||', t)), 1, 16)) AS frame_id, g1, g2, w1, w2, lang, source FROM wide_pair",
    "wide_trigger": "SELECT frame_id, w1 AS trigger FROM wide_word WHERE w1 <> '' UNION SELECT frame_id, w2 FROM wide_word WHERE w2 <> ''",
    "wide_ground": "SELECT DISTINCT concat(coalesce(lang, ''), '/', coalesce(source, '')) AS frame_id, g1 AS ground FROM wide_word WHERE g1 <> ''",
    "wide_member": "SELECT concat(CASE WHEN substr(md5(target_domain), 1, 1) < '8' THEN 'C_LLM_' ELSE 'C_' END, target_domain) AS cascade_id, frame_id, ord FROM wide_spec WHERE source_type <> 'GENERIC'",
    "wide_asked": "SELECT g1 AS s, g2 AS t, count(*) AS n FROM wide_pair WHERE g1 <> '' AND g2 <> '' GROUP BY g1, g2",
    "wide_q_word": "SELECT item_id AS query_id, split_part(text, ' ', 1) AS word FROM benchmark UNION SELECT item_id, split_part(text, ' ', 2) FROM benchmark UNION SELECT item_id, split_part(text, ' ', 3) FROM benchmark UNION SELECT item_id, split_part(text, ' ', 4) FROM benchmark",
    "wide_q_frame": "SELECT DISTINCT q.query_id, t.frame_id FROM wide_q_word q JOIN wide_trigger t ON t.trigger = q.word",
    "wide_q_reach": """SELECT DISTINCT x.query_id, d.domain FROM (SELECT query_id, frame_id FROM wide_q_frame UNION SELECT c.query_id, m.frame_id FROM (SELECT DISTINCT q.query_id, m.cascade_id FROM wide_q_frame q JOIN wide_member m ON m.frame_id = q.frame_id) c JOIN wide_member m ON m.cascade_id = c.cascade_id) x
        JOIN (SELECT frame_id, target_domain AS domain FROM wide_spec UNION SELECT frame_id, source_domain FROM wide_spec) d ON d.frame_id = x.frame_id""",
    "word": "@WORDS@",
    "incidence": "SELECT DISTINCT l_orderkey AS edge, l_partkey AS node FROM lineitem",
    "q_frame": "SELECT DISTINCT q.query_id, t.frame_id FROM query_set q JOIN frame_trigger t ON contains(q.query_text, t.trigger)",
    "q_reach": """SELECT DISTINCT q.query_id, d.domain FROM q_frame q
        JOIN (SELECT frame_id, frame_id AS other FROM frame_spec UNION SELECT a.frame_id, b.frame_id FROM cascade_member a JOIN cascade_member b ON a.cascade_id = b.cascade_id) x ON x.frame_id = q.frame_id
        JOIN (SELECT frame_id, target_domain AS domain FROM frame_spec UNION SELECT frame_id, source_domain FROM frame_spec) d ON d.frame_id = x.other""",
    "lap": "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT r.query_id, e.doc_id, round(sum(e.confidence + 0.3E0 * e.n_ground), 6) AS score FROM (SELECT DISTINCT query_id, domain FROM q_reach) r JOIN edge e ON e.target_domain = r.domain GROUP BY r.query_id, e.doc_id) s",
}


def _needed(text: str) -> list[str]:
    """Names of the fixtures and shared relations a text uses, before the ones that use them."""
    out: list[str] = []

    def visit(t: str) -> None:
        for name in [*SHARED, *(h.split("(")[0] for h in FIXTURE)]:
            if re.search(rf"\b{name}\b", t) and name not in out:
                if name in SHARED:
                    visit(SHARED[name])
                out.append(name)

    visit(text)
    return out


def full(text: str) -> str:
    """The text with the common tables it names in front."""
    heads = {h.split("(")[0]: h for h in FIXTURE}
    parts = [fixture(heads[n]) if n in heads else f"{n} AS ({SHARED[n]})" for n in _needed(text)]
    return f"WITH {', '.join(parts)} {text}" if parts else text


def duck(text: str) -> str:
    text = full(text)
    text = text.replace("@WORDS@", "SELECT doc_id, lang, unnest(range(len(ws)))::INT AS pos, unnest(ws) AS word FROM (SELECT doc_id, lang, string_split(text, ' ') AS ws FROM documents) x")
    text = re.sub(r"@SERIES\((\w+)\)@", r"(SELECT unnest(range(1, \1 + 1)) AS i)", text)
    text = re.sub(r"@PERCENTILE\((.*?);(.*?)\)@", r"quantile_cont(\1, \2)", text)
    text = re.sub(r"@HEX\((.*?);(\d+);(\d+)\)@", r"('0x' || substr(md5(\1), \2, \3))::BIGINT", text)
    text = re.sub(r"@DAYS\((.*?);(.*?)\)@", r"datediff('day', \1, \2)", text)
    text = re.sub(r"@JOINED\((.*?)\)@", r"string_agg(\1, ',' ORDER BY \1)", text)
    return text


def sparked(text: str) -> str:
    text = full(text)
    text = text.replace("@WORDS@", "SELECT doc_id, lang, w.pos AS pos, w.col AS word FROM documents LATERAL VIEW posexplode(split(text, ' ')) w AS pos, col")
    text = re.sub(r"@SERIES\((\w+)\)@", r"(SELECT explode(sequence(1, \1)) AS i)", text)
    text = re.sub(r"@PERCENTILE\((.*?);(.*?)\)@", r"percentile(\1, \2)", text)
    text = re.sub(r"@HEX\((.*?);(\d+);(\d+)\)@", r"cast(conv(substr(md5(\1), \2, \3), 16, 10) AS BIGINT)", text)
    text = re.sub(r"@DAYS\((.*?);(.*?)\)@", r"datediff(\2, \1)", text)
    text = re.sub(r"@JOINED\((.*?)\)@", r"array_join(sort_array(collect_list(\1)), ',')", text)
    return text


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    text = sparked(text)
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(text)


#: Rows of a table that one task gets where they are dealt by a key.
ROWS_A_TASK = 250_000


def parts_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    """So many partitions that tasks don't grow with the table (its rows are counted in the files' footers)."""
    return max(spark.sparkContext.defaultParallelism, -(-spark.read.parquet(f"{sf_dir}/{name}.parquet").count() // ROWS_A_TASK))


def run_dealt(spark: SparkSession, sf_dir: str, text: str, name: str, key: str) -> DataFrame:
    """``run`` with a table dealt by a key before anything else, so windows and joins by that key neither shuffle it again nor hold more of it when it grows."""
    hint = f"/*+ REPARTITION({parts_of(spark, sf_dir, name)}, {key}) */"
    return run(spark, sf_dir, re.sub(rf"FROM {name}\b", f"FROM (SELECT {hint} * FROM {name}) {name}", text))
