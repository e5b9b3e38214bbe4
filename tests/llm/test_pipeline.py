"""The pipeline stage by stage, and as a whole."""

from collections import Counter

import corpus_pipeline
from hyperloom.llm import pieces

from .edge import frame


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows, columns = docs.collect(), docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for n, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, tiny)
        if n < 4:
            assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    codec = pieces.Codec(pieces.piece_table())
    texts = {r.doc_id: r.text for r in rows}
    for r in docs.collect():
        assert codec.decode(r.ids) == texts[r.doc_id] and r.n_tokens == len(r.ids)
    whole = corpus_pipeline.run(spark, tiny)
    assert Counter((r.doc_id, r.n_tokens) for r in whole.collect()) == Counter((r.doc_id, r.n_tokens) for r in docs.collect())


def test_stages_take_odd_rows(spark, tiny):
    for _, f in corpus_pipeline.STAGES:
        f(spark, frame(spark), tiny).collect()
        assert f(spark, frame(spark, []), tiny).count() == 0


def test_language_stage_keeps_clean_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, tiny).collect()}
    assert kept == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
