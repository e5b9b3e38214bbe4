"""The Jaccard join against brute force, and its parts."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hyperloom.llm import chosen_path, shared

from .edge import ROWS, frame


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def plain(rows):
    """class_id, copy_of, n_links, n_linked_docs per id, from all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    index = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            index[x].add(i)
    near = {i: set() for i in sets}
    for i, s in sets.items():
        both = Counter(j for x in s for j in index[x])
        near[i] = {j for j, c in both.items() if j != i and c * 5 >= 4 * (len(s) + len(sets[j]) - c)}
    out, done = {}, set()
    for i in sorted(sets):
        if i in done:
            continue
        todo, part = [i], {i}
        while todo:
            for j in near[todo.pop()] - part:
                part.add(j)
                todo.append(j)
        done |= part
        for j in part:
            other = {k for k in near[j] if sets[k] != sets[j]}
            out[j] = (i, min([k for k in near[j] if sets[k] == sets[j]] + [j]), len({sets[k] for k in other}), len(other))
    return out


@pytest.mark.parametrize("small,block", [(32, 256), (4, 5)])
def test_join_equals_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(chosen_path, "SMALL", small)
    monkeypatch.setattr(chosen_path, "BLOCK", block)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base = " ".join(f"w{i}" for i in range(120)).split()
    extra = []
    for i in range(40):  # one group of near copies
        w = list(base)
        w[(i * 3) % 120] = f"x{i}"
        extra.append((50_000 + i, " ".join(w)))
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    out = chosen_path.join(docs).collect()
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.class_id, r.copy_of, r.n_links, r.n_linked_docs) for r in out}
    assert len(out) == len(want) and got == want


def test_odd_rows(spark):
    out = chosen_path.join(frame(spark)).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in ROWS)
    got = {r.doc_id: r.class_id for r in out}
    assert got[1] == got[2] == 1 and got[7] == 6 and got[3] == 3 and got[4] == 4 and got[None] is None
    assert {r.doc_id: r.n_links for r in out}[6] == 0 and Counter(r.copy_of for r in out)[6] == 2
    left = chosen_path.survivors(frame(spark))
    assert left.columns == frame(spark).columns
    assert Counter(r.doc_id for r in left.collect()) == Counter({1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 8: 1, 9: 1, 10: 1, None: 2})
    assert chosen_path.join(frame(spark, [])).count() == 0


def test_rows_are_told_apart_by_text_where_ids_repeat(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near = one.replace("a59", "c")
    rows = [(1, one), (1, two), (1, two), (2, near), (3, two), (None, one), (None, two + " x"), (None, "quite another text of its own"), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = Counter((r.doc_id, r.class_id, r.copy_of, r.n_links, r.n_linked_docs) for r in chosen_path.join(df).collect())
    assert out == Counter([(1, 1, 1, 1, 1), (1, 1, 1, 1, 1), (1, 1, 1, 1, 1), (2, 1, 2, 1, 2), (3, 1, 1, 1, 1), (None, 1, 1, 1, 1), (None, 1, None, 1, 3), (None, None, None, 0, 0), (None, None, None, 0, 0), (None, None, None, 0, 0)])
    left = Counter(tuple(r) for r in chosen_path.survivors(df).collect())
    assert left == Counter([(1, one), (1, two), (None, "quite another text of its own"), (None, None), (None, None)])
    words = spark.createDataFrame([("x", one), ("b", near), (None, "z")], "doc_id string, text string")
    assert {r.doc_id: r.class_id for r in chosen_path.join(words).collect()} == {"x": "b", "b": "b", None: None}
    assert sorted(r.doc_id or "" for r in chosen_path.survivors(words).collect()) == ["", "b"]


def test_runs_repeat_until_the_recall(spark, monkeypatch):
    assert chosen_path.recall_of(0, 0, 4) == 1 and chosen_path.recall_of(10, 40, 4) == 1
    p, n = 0.6, 4
    assert abs(chosen_path.recall_of(100_000, round(100_000 * p * n / (1 - (1 - p) ** n)), n) - (1 - (1 - p) ** n)) < 1e-4
    rng = np.random.default_rng(7)
    rows = []
    for g in range(60):  # pairs a little above the threshold
        w = [f"g{g}w{i}" for i in range(100)]
        rows.append((2 * g, " ".join(w)))
        for i in rng.choice(95, 2, replace=False):
            w[i] = f"other{g}_{i}"
        rows.append((2 * g + 1, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(chosen_path, "RUNS", 2)
    monkeypatch.setattr(chosen_path, "SMALL", 1)
    kept = df.select("doc_id", chosen_path.digest_of(df["text"]), "text")
    every = shared.landed(kept.mapInArrow(chosen_path.sketches, "doc_id long, h binary, n int, cls binary, sig binary"), "s")
    from pyspark.sql import functions as F

    reps = shared.landed(every.select("cls", "n", F.struct(F.lit(False).alias("none"), "doc_id", "h").alias("low"), F.lit(1).cast("long").alias("copies"), "sig", F.monotonically_increasing_id().alias("rep")), "r")
    found, reached, runs = chosen_path.found_until(reps, kept.select(chosen_path.id_key(F.col("doc_id")), "h", "text"), 0.999)
    true = sum(1 for v in plain(rows).values() if v[2])
    assert runs > 2 and reached >= 0.999 and found.select("rep").distinct().count() >= 0.98 * true > 50


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {n: n for e in edges for n in e}
    for _ in range(len(low)):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert got == low


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    x = chosen_path.mixed(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    agree = np.mean([(chosen_path.minhashes(x[a : a + 900]) == chosen_path.minhashes(x[a + 100 : a + 1000])).mean() for a in range(0, 3000, 150)])
    assert abs(agree - 0.8) < 0.03
