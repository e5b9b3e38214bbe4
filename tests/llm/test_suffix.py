"""Repeated strings against a table of all windows, and the sort against sorted()."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest

from hyperloom.llm import suffix_dedup as sd

from .edge import ROWS, frame


def plain(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(raw[p : p + 200] for _, raw in texts for p in range(len(raw) - 199))
    out = Counter()
    for i, raw in texts:
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for p in range(len(raw) - 199):
            if seen[raw[p : p + 200]] > 1:
                gone[p : p + 200] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(raw)]).sum())
        kept = bytes(np.frombuffer(raw, dtype=np.uint8)[~gone[: len(raw)]])
        out[(i, len(raw), int(gone[: len(raw)].sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.removed(df).collect())


@pytest.mark.parametrize("many", [sd.MANY, 3])
def test_documents(spark, tiny, monkeypatch, many):
    monkeypatch.setattr(sd, "MANY", many)
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage, brief = word(420), word(170)
    extra = [(90_000 + i, word(rng.integers(0, 300)) + passage[rng.integers(0, 120) : rng.integers(250, 420)] + word(40)) for i in range(30)]
    extra += [(91_000 + i, word(150) + brief + word(150)) for i in range(20)]
    extra += [(92_000, "r" * 500 + "x" + "ab" * 220), (92_001, "ab" * 150), (92_002, passage), (92_003, passage), (92_003, passage)]
    docs = docs.union(spark.createDataFrame(extra, "doc_id long, text string"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    mine = got(docs)
    assert mine == want, list((mine - want).items())[:3] + list((want - mine).items())[:3]


def test_odd_rows(spark):
    assert got(frame(spark)) == plain([(i, t) for i, t, *_ in ROWS])
    assert sd.removed(frame(spark, [])).count() == 0


def test_deep_shallow_sorts():
    rng = np.random.default_rng(4)
    raw = bytes(rng.choice(list(b"ab"), 3000)) + b"ab" * 300 + b"a" * 400 + os.urandom(300)
    raw = raw + raw[:900] + b"\x00" * 64
    at = rng.permutation(len(raw) - 200)
    group = at % 3
    order, lcp = sd.deep_shallow(raw, at, group)
    want = sorted(range(len(at)), key=lambda i: (group[i], raw[at[i] : at[i] + 200]))
    assert [raw[p : p + 200] for p in order] == [raw[at[i] : at[i] + 200] for i in want]
    for n in range(1, len(order)):
        if order[n] % 3 == order[n - 1] % 3:
            a, b = raw[order[n] : order[n] + 200], raw[order[n - 1] : order[n - 1] + 200]
            true = len(os.path.commonprefix([a, b]))
            assert lcp[n] == (true if true >= sd.SHALLOW else true // 8 * 8)


def test_stretches_partition_the_windows():
    raw = os.urandom(700) + b"z" * 450 + os.urandom(200)
    anchor, first, last = sd.stretches(raw)
    assert first[0] == 0 and last[-1] == len(raw) - 200 and (first[1:] == last[:-1] + 1).all() and (last - first).max() <= 100
    assert len(sd.stretches(b"x" * 199)[0]) == 0
