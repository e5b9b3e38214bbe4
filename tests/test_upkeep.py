"""The ranker against a NumPy replica, canonical names and frames against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.operators import canon, ranking, search
from hyperloom.plans import upkeep


def replica(keys, x, y, epochs=50, batch=32, rate=0.1, patience=10, decay=1e-4):
    """The rule in plain NumPy: all rows, batches by the digest of epoch and key."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    mu, sd = x.mean(0), x.std(0)
    sd[sd < 1e-8] = 1.0
    xs = (x - mu) / sd
    pos, neg = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    sw = np.where(y > 0.5, (pos + neg) / (2 * pos), (pos + neg) / (2 * neg))
    w, b = np.random.default_rng(42).normal(0, 0.01, x.shape[1]), 0.0
    best, kept, wait, history = float("inf"), (w.copy(), 0.0), 0, []
    for ep in range(epochs):
        idx = sorted(range(len(y)), key=lambda i: (zlib.crc32(f"{ep}:{keys[i]}".encode()), keys[i]))
        for s in range(0, len(idx), batch):
            bi = idx[s : s + batch]
            g = (sig(xs[bi] @ w + b) - y[bi]) * sw[bi]
            gw, gb = xs[bi].T @ g / len(bi) + decay * w, g.sum() / len(bi)
            w, b = w - rate * gw, b - rate * gb
        p = sig(xs @ w + b)
        loss = float(-(sw * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).mean())
        history.append(loss)
        if loss < best - 1e-6:
            best, kept, wait = loss, (w.copy(), b), 0
        else:
            wait += 1
            if wait >= patience:
                break
    return *kept, mu, sd, history


def test_ranker_equals_the_replica(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=300), rng.normal(5, 20, size=300), np.full(300, 2.0)])
    y = (x[:, 0] + rng.normal(size=300) > 1).astype(float)
    rows = [(f"k{i}", *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, ("gone", None, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 0.0)], "key string, a double, b double, c double, y double").repartition(5)
    got = ranking.fit(df, ("a", "b", "c"), "y", "key")
    w, b, mu, sd, history = replica([r[0] for r in rows], x, y)
    assert got.w == pytest.approx(w, abs=1e-9) and got.b == pytest.approx(b, abs=1e-9) and got.mu == pytest.approx(mu) and got.sd == pytest.approx(sd)
    assert got.history == pytest.approx(history) and got.sd[2] == 1.0
    p = {r.key: r.score for r in ranking.scored(df.where("a is not null and key is not null"), got).collect()}
    assert p == pytest.approx({r[0]: 1 / (1 + np.exp(-((np.array(r[1:4]) - mu) / sd @ w + b))) for r in rows})
    again = ranking.Ranker.of(("a", "b", "c"), got.as_dict())
    assert again.weights() == got.weights()
    assert ranking.fit(df.limit(0), ("a", "b", "c"), "y", "key").w.tolist() == [0, 0, 0]


def test_ranker_stops_early_and_takes_a_bounded_part(spark):
    rng = random.Random(1)
    rows = [(str(i), float(i % 2), float(rng.random() < 0.5)) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, a double, y double")
    assert len(ranking.fit(df, ("a",), "y", "key", epochs=60, patience=3).history) < 60
    part = ranking.fit(df, ("a",), "y", "key", epochs=2, most=50)
    assert part.mu[0] == pytest.approx(0.5) and len(part.history) == 2  # scale and loss are those of all rows


def test_ranker_query(spark, tiny):
    rows = upkeep.judged(spark, tiny).collect()
    x, y = np.array([[r.f1, r.f2, r.f3] for r in rows]), np.array([r.label for r in rows])
    w, b, mu, sd, _ = replica([str(r.doc_id) for r in rows], x, y)
    want = {r.doc_id: round(float(1 / (1 + np.exp(-((v - mu) / sd @ w + b)))), 4) for r, v in zip(rows, x, strict=True)}
    assert {r.doc_id: r.score for r in upkeep.ranker_scores(spark, tiny).collect()} == pytest.approx(want, abs=1.1e-4)


def test_trained_arm_puts_right_kinds_first(spark, tiny):
    rows = upkeep.training_rows(spark, tiny)
    key = F.concat_ws("|", "query_id", F.xxhash64("kind"))
    ranker = ranking.fit(rows.withColumn("key", key), search.FEATURES, "label", "key")
    both = [(r.label, r.score) for r in ranking.scored(rows, ranker).collect()]
    right, wrong = [s for t, s in both if t], [s for t, s in both if not t]
    assert right and wrong
    assert np.mean([(a > b) + 0.5 * (a == b) for a in right for b in wrong]) > 0.9
    arms = {r.arm for r in upkeep.trained_arm(spark, tiny).select("arm").distinct().collect()}
    assert arms == {a + t for a in ("hand", "legacy", "no_role", "trained") for t in ("", "_reliable")}


def plain_classes(counts, links):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            up[top(a)] = top(b)
    groups = defaultdict(list)
    for n in counts:
        groups[top(n)].append(n)
    return {n: min(g, key=lambda x: (-counts[x], x)) for g in groups.values() for n in g}


def test_classes_alarm_and_specs(spark):
    rng = random.Random(9)
    names = [f"n{i}" for i in range(30)]
    rows = [(rng.choice(names), rng.choice(names[:6]), [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(3)], [rng.choice(["x", "y", "z", "", None])]) for _ in range(400)]
    rows += [(None, "n1", ["q"], []), ("", "n1", ["q"], []), ("n2", None, ["q"], [])]
    links = [(rng.choice(names), rng.choice([*names, "elsewhere"])) for _ in range(14)] + [(None, "n1"), ("n3", None), ("n4", "n4")]
    found = spark.createDataFrame(rows, "source_domain string, target_domain string, triggers array<string>, ground array<string>")
    proposals = spark.createDataFrame([*links, *links], "name string, same_as string")
    good = [r for r in rows if r[0] and r[1]]
    maps = []
    for side in (0, 1):
        counts = Counter(r[side] for r in good)
        table = canon.classes(canon.pairs(found).select(F.col(canon.PAIR[side]).alias("name"), "n"), proposals)
        maps.append(plain_classes(counts, links))
        assert {r.name: r.canonical for r in table.collect()} == maps[side]
        rate = canon.merge_rate(table).first()
        assert (rate.n_names, rate.n_classes, rate.idle) == (len(counts), len(set(maps[side].values())), len(set(maps[side].values())) >= 0.95 * len(counts))
    tables = [spark.createDataFrame(list(m.items()), "name string, canonical string") for m in maps]
    words, grounds, support = defaultdict(Counter), defaultdict(Counter), Counter()
    for s, t, ws, gs in good:
        pair = (maps[0][s], maps[1][t])
        support[pair] += 1
        words[pair].update(w for w in ws if w)
        grounds[pair].update(g for g in gs if g)
    spread = Counter(w for c in words.values() for w in c)
    bad = {w for w, n in spread.items() if len(w) < 2 or n > 12}
    best = lambda c, drop=(): [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0])) if w not in drop][:2]
    triggers = canon.mapped(canon.histogram(found, "triggers"), *tables)
    assert {r.word for r in canon.generic(triggers, most=12).collect()} == bad
    frames, cascades = canon.specs(found, *tables, F.when(F.col("source_domain") < "n2", "LOW").otherwise("GENERIC"), least=3, most=2)
    got = {(r.source_domain, r.target_domain): r for r in frames.collect()}
    assert got.keys() == {p for p, n in support.items() if n >= 3}
    usual = {w for w, n in spread.items() if len(w) < 2 or n > 3}
    for p, r in got.items():
        assert (r.support, r.triggers, r.ground) == (support[p], best(words[p], usual), best(grounds[p]))
        assert r.mapping_type == (f"DISCOVERED::LOW_TO_{p[1]}" if p[0] < "n2" else "GENERIC")
        assert r.frame_id == "F_LLM_" + hashlib.md5("||".join(p).encode()).hexdigest()[:8]
    assert Counter(r.cascade_id for r in cascades.collect()) == Counter("C_LLM_" + hashlib.md5(t.encode()).hexdigest()[:8] for _, t in got)


def test_a_merge_that_merged_nothing_is_told(spark):
    same = spark.createDataFrame([(f"n{i}", f"n{i}") for i in range(20)], "name string, canonical string")
    assert canon.merge_rate(same).first().idle
    assert not canon.merge_rate(same.withColumn("canonical", F.when(F.col("name") < "n15", "n0").otherwise(F.col("name")))).first().idle
    assert not canon.merge_rate(same.limit(0)).first().idle
