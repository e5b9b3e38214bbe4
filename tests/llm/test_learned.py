"""Language ID, toxicity, pieces and nearest neighbours, against brute force or held-out rows."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from hyperloom.llm import crf, kmeans_tree, pieces, toxicity
from hyperloom.llm.shared import letter_words, windows

from .edge import ROWS, frame

IDS = Counter(r[0] for r in ROWS)


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    lengths = np.array([3, 0, 1, 4])
    emit, step = rng.random((8, 2)) + 0.1, rng.random((2, 2)) + 0.1
    post, _ = crf.Chain(lengths).forward_backward(emit, step)
    at = 0
    for n in lengths:
        want = np.zeros((n, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            p = math.prod(emit[at + t, g] for t, g in enumerate(path)) * math.prod(step[a, b] for a, b in itertools.pairwise(path))
            for t, g in enumerate(path):
                want[t, g] += p
        if n:
            assert np.allclose(post[at : at + n], want / want.sum(1, keepdims=True))
        at += n


def test_language(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = crf.fit(docs)
    out = {r.doc_id: r for r in crf.predict(docs, model).collect()}
    rows = docs.collect()
    assert all(out[r.doc_id].held_out == held(r.doc_id) for r in rows)
    mine = [r for r in rows if held(r.doc_id)]
    assert sum(out[r.doc_id].lang_pred == r.lang for r in mine) >= 0.95 * len(mine)
    odd = crf.predict(frame(spark), model).collect()
    assert Counter(r.doc_id for r in odd) == IDS and {r.lang_pred for r in odd if r.doc_id in (3, 4, 8)} == {"und"}
    assert all(0 <= r.score <= 1 for r in odd)
    assert crf.predict(frame(spark, []), model).count() == 0
    assert {r.lang_pred for r in crf.predict(frame(spark), crf.fit(frame(spark, []))).collect()} == {"und"}
    crf.fit(frame(spark))


def test_code_switched_words(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").toPandas()
    model = crf.train(docs["text"].tolist(), docs["lang"].tolist())
    parts = {g: letter_words(docs[docs["lang"] == g]["text"].iloc[0])[:30] for g in ("en", "de")}
    (post,) = crf.Labeller(model).label([" ".join(parts["en"] + parts["de"])])
    names = np.array(model["langs"])[post.argmax(1)]
    assert (names[:30] == "en").mean() > 0.9 and (names[30:] == "de").mean() > 0.9


def test_letters():
    assert letter_words("½ ² ① 12 Ⅳ 〇") == [] and letter_words("a½b ab_dé 漢字 x2y") == ["a", "b", "ab", "dé", "漢字", "x", "y"]
    text = "ab cd  " * 30
    assert "".join(windows(text, 10)) == text and all(w.strip() for w in windows(text, 10))
    assert list(windows("", 10)) == [""] and "".join(windows("x" * 35, 10)) == "x" * 35


def test_numerals_are_no_language(spark, tiny):
    model = crf.fit(spark.read.parquet(f"{tiny}/documents.parquet"))
    out = crf.predict(spark.createDataFrame([(1, "½ ² ① 12"), (2, "Ⅳ_7"), (3, "the ½")], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred == "und" for r in out} == {1: True, 2: True, 3: False}
    assert [r.score for r in out if r.doc_id < 3] == [0.0, 0.0]


def test_long_texts_are_several_chains(spark, tiny, monkeypatch):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").toPandas()
    labeller = crf.Labeller(crf.train(docs["text"].tolist(), docs["lang"].tolist()))
    whole = labeller.documents(docs["text"].tolist())
    monkeypatch.setattr(crf, "CHAIN", 7)
    cut = labeller.documents(docs["text"].tolist())
    assert sum(a == b for a, b in zip(whole[0], cut[0], strict=True)) >= 0.98 * len(docs) and max(abs(a - b) for a, b in zip(whole[1], cut[1], strict=True)) < 0.3
    assert len(crf.evenly("word " * 40_000).split()) == crf.STRETCHES * crf.STRETCH


def test_dirty_language_columns(spark):
    rows = [(i, "the same words " * 3, f"x{i}") for i in range(300)] + [(1000 + i, "el perro come pan", "es") for i in range(40)] + [(2000 + i, "the dog eats bread", "en") for i in range(40)]
    assert {"en", "es"} <= set(crf.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["langs"])


def test_kneser_ney_by_hand():
    m = toxicity.Models([("ab", 2, 0), ("ac", 0, 1)], order=2)
    # continuation counts: a, b, c and $ follow 1, 1, 1 and 2 different letters
    assert m.shared("b") == pytest.approx((1 - 0.75 + 0.75 * 4 / 5) / 5)
    assert m.likelihood(0, "ab", m.shared("b")) == pytest.approx((2 - 0.75 + 0.75 * m.shared("b")) / 2)
    assert m.likelihood(0, "zb", 0.5) == 0.5
    assert m.evidence("ac") > 0 > m.evidence("ab") and m.ratio("qz") == 0
    for k, h in ((0, "a"), (1, "a")):
        assert sum(m.likelihood(k, h + c, m.shared(c)) for c in "abc$?") == pytest.approx(1)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    y = [(out[r.doc_id], r.toxic) for r in labels.collect() if held(r.doc_id)]
    assert all(o.held_out and o.predicted == (o.score >= 0.3) for o, _ in y)
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a, p in y if p for b, q in y if not q]
    assert sum(pairs) / len(pairs) > 0.85
    odd = toxicity.score(frame(spark), model).collect()
    assert Counter(r.doc_id for r in odd) == IDS and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(frame(spark, []), model).count() == 0
    assert {r.score for r in toxicity.score(frame(spark), toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


def test_toxicity_keeps_the_class_shares_when_a_class_is_cut(spark):
    docs = spark.range(8000).selectExpr("id AS doc_id", "'the same words in each' AS text")
    labels = spark.range(8000).selectExpr("id AS doc_id", "int(id % 10 = 0) AS toxic")
    model = toxicity.fit(docs, labels, per_class=400)
    (share,) = {r.score for r in toxicity.score(docs, model).collect()}
    assert 0.07 < share < 0.14  # one in ten is toxic, though the sample has as many of either


def plain_viterbi(codec, s):
    """Every piece at every place, whole text at once."""
    words = {p: (i, v) for p, i, v in pieces.piece_table()["words"]}
    s = s.replace(pieces.MARK, pieces.OWN_MARK).replace(" ", pieces.MARK)
    best, how = [0.0] + [-math.inf] * len(s), [None] * (len(s) + 1)
    for e in range(1, len(s) + 1):
        for a in range(max(0, e - 20), e):
            if (x := words.get(s[a:e])) and best[a] + x[1] > best[e]:
                best[e], how[e] = best[a] + x[1], (a, [x[0]])
        if s[e - 1] not in words:
            raw = codec.utf8(s[e - 1])
            if best[e - 1] + codec.spelled * len(raw) > best[e]:
                best[e], how[e] = best[e - 1] + codec.spelled * len(raw), (e - 1, [codec.raw[b] for b in raw])
    out, e = [], len(s)
    while e:
        e, ids = how[e]
        out = ids + out
    return out


def test_pieces(spark, tiny, monkeypatch):
    codec = pieces.Codec(pieces.piece_table())
    texts = [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").limit(60).collect()] + ["a  b\n\n c ", " ", "\n", "▁ x▁▁ y", "\U0001f600é\x00", "    indented\t\tcode"]
    texts += ["漢字かな交じり文 " * 30, "x" * 300 + " " * 90 + "y", "\U0001f600" * 70, "Привет мир, это проверка", "aé\u0301ß \ud7ff end", "q" * 64 + " " + "q" * 65]
    for t in texts:
        assert codec.encode(t) == plain_viterbi(codec, " " + t)
        assert codec.decode(codec.encode(t)) == t
    want = [codec.encode(t) for t in texts]
    for name, value in (("CELLS", 70), ("REMEMBER", 3), ("WINDOW", 40), ("SIDE_BY_SIDE", 5)):
        with monkeypatch.context() as m:  # neither memory nor windows change an id
            m.setattr(pieces, name, value)
            other = pieces.Codec(pieces.piece_table())
            assert [np.frombuffer(x, dtype=np.int32).tolist() for x in other.packed_all(texts)] == want


def test_pieces_take_odd_rows(spark):
    rows = frame(spark)
    out = pieces.decode(pieces.encode(rows), keep=("doc_id", "ids")).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((i, t) for i, t, *_ in ROWS)
    assert pieces.encode(frame(spark, [])).count() == 0


def test_nearest(spark, tiny):
    data = spark.read.parquet(f"{tiny}/embeddings.parquet").union(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id + 100000", "embedding", "label"))
    out = kmeans_tree.search(data, k=10, every=10).collect()
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in data.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hit = n = 0
    for q in ids[ids % 10 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        want = [(d[i], ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert mine == sorted(mine, key=lambda m: (m[2], m[1]))
        near = dict((i, v) for v, i in want)
        assert all(abs(m[2] - near[m[1]]) < 1e-12 for m in mine if m[1] in near)
        hit += sum(m[1] in near for m in mine)
        n += 10
    assert hit / n >= 0.9


def test_nearest_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [2.0, 0.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [0.0, 0.0]), (100, [5.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, leaf int, score int")
    out = sorted(tuple(r) for r in kmeans_tree.search(df).collect())
    assert out == [(0, 1, 1, 0.0), (0, 2, 6, 1.0), (0, 3, 100, 4.0), (100, 1, 6, 3.0), (100, 2, 0, 4.0), (100, 3, 1, 4.0)]
    assert kmeans_tree.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1.0, 1e200, 1e-200, 1e307])
def test_nearest_of_large_and_small_components(spark, size):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=3) / 8 * size]) for i in range(30)]
    out = kmeans_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=10, every=10).collect()
    for q in (0, 10, 20):
        x = np.array([v for _, v in rows]) / size
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.argsort(d) if i != q][:10]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in out if r.query_id == q)
        assert [m[1] for m in mine] == want and np.allclose([m[2] / size for m in mine], d[want], rtol=1e-12)


def test_nearest_of_norms_far_above_the_distances():
    rng = np.random.default_rng(9)
    x = 1e6 + rng.normal(size=(400, 16)) * 1e-6
    ids = rng.permutation(400)
    out = kmeans_tree.best(x[:5], ids[:5], x, ids, 10).to_pydict()
    for q in range(5):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [ids[i] for i in np.lexsort((ids, d)) if i != q][:10]
        assert [v for i, v in zip(out["query_id"], out["vec_id"], strict=True) if i == ids[q]] == want


def test_blocks_of_a_hot_leaf(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "BLOCK", 7)
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    out = kmeans_tree.search(df, k=3, every=20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in out] == [(0, 1, 0.0), (0, 2, 0.0), (0, 3, 0.0), (20, 0, 0.0), (20, 1, 0.0), (20, 2, 0.0), (40, 0, 0.0), (40, 1, 0.0), (40, 2, 0.0)]


def test_nearest_of_repeated_ids(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    rows = points + [(i, [x + 0.001 * j for x in v]) for i, v in points[1:3] for j in range(1, 31)] + points
    monkeypatch.setattr(kmeans_tree, "LEAF", 200)  # one leaf
    out = kmeans_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, every=20)
    own = {i: np.array(min(v for j, v in rows if j == i)) for i, _ in points}
    want = {(q, i) for q in (0, 20, 40) for i in sorted((i for i in own if i != q), key=lambda i: ((own[i] - own[q]) ** 2).sum())[:5]}
    assert sorted((r.query_id, r["rank"]) for r in out.collect()) == [(q, n) for q in (0, 20, 40) for n in range(1, 6)]
    assert {(r.query_id, r.vec_id) for r in out.collect()} == want
