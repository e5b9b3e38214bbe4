"""Odd rows that every operator has to take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, n int, node string, digest string, curve string, leaf int, score string, whole string, id string"
LONG = " ".join(f"word{i % 977} and more" for i in range(20_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again.", "en", "a"),
    (2, "The quick  brown fox jumps over\tthe lazy dog again.", "en", "b"),
    (2, "The quick  brown fox jumps over\tthe lazy dog again.", "en", "b"),
    (3, "", "fr", "a"),
    (4, None, "de", None),
    (5, None, None, "c"),
    (None, "no id at all here", "en", "a"),
    (None, None, None, None),
    (6, LONG, "en", "a"),
    (7, LONG, "es", "b"),
    (8, " \t\n\r\x0b\x0c", "en", "b"),
    (9, "héé ñ \U0001f600 ▁ <|im_end|> \\ %%%", None, "a"),
    (10, "\x00\x01 zero", "en", "ü"),
]


def frame(spark, rows=ROWS):
    full = [(*r, None if r[1] is None else len(r[1]), "x", 1, "x", "x", "x", 1, "x", "x", "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA)
