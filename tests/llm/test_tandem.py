"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.llm import queries, tandem

from .edge import ROWS, frame


def plain_runs(w, least=6, exponent=4):
    """Every period, every stretch of words that keeps it, smallest period first."""
    x = np.unique(np.array(w, dtype=object), return_inverse=True)[1] if len(w) else np.zeros(0, dtype=int)
    n, out, seen = len(w), [], set()
    for q in range(1, n // exponent + 1):
        same = np.diff(np.concatenate([[0], (x[q:] == x[:-q]).astype(np.int8), [0]]))
        for i, j in zip(np.flatnonzero(same > 0).tolist(), np.flatnonzero(same < 0).tolist(), strict=True):
            size = j - i + q
            if size >= max(least, exponent * q) and (i, size) not in seen:
                seen.add((i, size))
                out.append((i, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text, tail=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if tail and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    said = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest(said), digest(kept))


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (4, 3)])
def test_runs_of_small_alphabets(least, exponent):
    rng = random.Random(exponent)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 6)):
            k, n = rng.choice([1, 2, 2, 3, 20]), rng.randint(0, rng.choice([5, 30, 80, 200]))
            w = [rng.randint(1, k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, n) if a + (i - a) % p < n]
                w[rng.randrange(len(w))] = 1
            docs.append(w)
        got = list(zip(*(x.tolist() for x in tandem.runs(docs, least, exponent)), strict=True))
        assert got == [(d, *r) for d, w in enumerate(docs) for r in plain_runs(w, least, exponent)]


def test_suffixes_and_blocks():
    rng = random.Random(3)
    w = [rng.randint(1, 3) for _ in range(300)]
    s = tandem.Suffixes(np.array([*w, 0]), np.zeros(301, dtype=np.int64))
    order = sorted(range(301), key=lambda i: [*w, 0][i:])
    assert s.order.tolist() == order
    size = lambda a, b: next((k for k in range(300 - max(a, b) + 1) if [*w, 0][a + k] != [*w, 0][b + k]), 0)
    assert s.lcp.tolist()[1:] == [size(a, b) for a, b in zip(order, order[1:], strict=False)]
    longest = tandem.longest_before(s)
    assert longest.tolist()[:300] == [max((size(i, j) for j in range(i)), default=0) for i in range(300)]


def test_long_repetitions():
    """Texts of one word or two said over and over: no step is quadratic in them."""
    n = 200_000
    assert [x.tolist() for x in tandem.runs([[1] * n, [1, 2] * n])] == [[0, 1], [0, 0], [n, 2 * n], [1, 2]]


def test_query_equals_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    want = Counter(plain(r.doc_id, r.text) for r in docs.collect())
    out = queries.op13_tandem_runs(spark, tiny).drop("n_dropped")
    got = out.collect()
    assert Counter(map(tuple, got)) == want and sum(r.n_runs > 0 for r in got) > 5
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_odd_rows(spark):
    for tail in (False, True):
        got = tandem.periodic(frame(spark), tail=tail).drop("n_dropped").collect()
        short = [(i, t) for i, t, *_ in ROWS if len(t or "") < 1000]
        assert Counter(tuple(r) for r in got if r.doc_id not in (6, 7)) == Counter(plain(i, t, tail) for i, t in short)
        assert tail or [(r.n_runs, r.start, r.length, r.period) for r in got if r.doc_id in (6, 7)] == [(1, 0, 60_000, 3 * 977)] * 2
    assert tandem.periodic(frame(spark, [])).count() == 0
    named = frame(spark).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert tandem.periodic(named).count() == len(ROWS)


def test_collapsed(spark):
    rows = [(1, "a b a b a b a b c", "", ""), (2, None, "", ""), (3, "x  y", "", ""), (4, "no no no no no no", "", "")]
    assert {r.doc_id: r.text for r in tandem.collapsed(frame(spark, rows)).collect()} == {1: "a b c", 2: None, 3: "x  y", 4: "no"}
