"""Repair against a search over all edits."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from hyperloom.llm import dial, queries

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit) and the roles said, least by cost, then by letters: every edit at every place is tried."""

    @lru_cache(None)
    def best(i, q, inserts):
        found = []
        if i == len(rows) and q in (0, 3):
            found.append((0, "", ()))
        here = [("user", "u"), ("assistant", "a")]
        if inserts < 3:
            for role, x in here:
                if (q, x) in STEP and (rest := best(i, STEP[q, x], inserts + 1)):
                    found.append((2 + rest[0], "I" + rest[1], ((i, role, True), *rest[2])))
        if i < len(rows):
            role, fault = rows[i]
            if rest := best(i + 1, q, 0):
                found.append((3 + rest[0], "D" + rest[1], rest[2]))
            if fault not in (1, 2):
                more = int(fault == 3)
                if (q, role[:1]) in STEP and (rest := best(i + 1, STEP[q, role[:1]], 0)):
                    found.append((more + rest[0], "K" + rest[1], ((i, role, False), *rest[2])))
                for new, x in here:
                    if (q, x) in STEP and (rest := best(i + 1, STEP[q, x], 0)):
                        found.append((2 + more + rest[0], "R" + rest[1], ((i, new, False), *rest[2])))
        return min(found, default=None, key=lambda f: (f[0], f[1]))

    out = best(0, 0, 0)
    best.cache_clear()
    return out


def plain(conversation):
    """What the contract asks of one conversation's rows (turn, role, text), damaged already."""
    rows = sorted(conversation, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(BLANKS)
        faults.append(1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3)
        seen.add((role, text))
    cost, audit, said = cheapest([(r[1], f) for r, f in zip(rows, faults, strict=True)])
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    whole = "\n".join(f"{role}:" if new else f"{role}:{rows[i][2]}" for i, role, new in said)
    return (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest())


def plain_damage(rows):
    out = []
    for c, turn, role, text in rows:
        space = lambda x: " " if x is None else x
        way, role, text = zlib.crc32(f"{space(c)}:{space(turn)}".encode()) % 20, space(role), space(text)
        if way == 1:
            text = ""
        if way == 2:
            text = re.sub("[.!?]", "", text)
        if way == 4:
            role = "user"
        out += [(c, turn, role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return out


def expected(rows, ids):
    by = defaultdict(list)
    for c, *rest in rows:
        by[c].append(tuple(rest))
    return {c: plain(by[c]) if c in by else (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for c in ids}


def made(n, seed, most=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, most)):
            rows.append((c if c else None, rng.choice([t, t, t, None, 2 * t]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(["Yes.", "no", "Why? ", "\t", "", None, f"Word {t}!", "é \U0001f600."])))
    return rows


def test_distances_and_walks():
    rng = random.Random(8)
    for _ in range(1500):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 7))]
        light = [(r[:1], f) for r, f in rows]
        dist = dial.distances(light, dial.ENDS)
        steps, end = dial.walk(light, dist, 0, True)
        cost, audit, _ = cheapest(rows)
        assert (dist[0][0], "".join(s[1] for s in steps)) == (cost, audit) and end in (0, 3)


@pytest.mark.parametrize("segment", [4096, 2])
def test_repair(spark, monkeypatch, segment):
    monkeypatch.setattr(dial, "SEGMENT", segment)
    rows = made(60, segment)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, seg int")
    out = dial.repaired(dial.damaged(df), df).collect()
    want = expected(plain_damage(rows), {r[0] for r in rows})
    assert {r.conv_id: tuple(r)[1:] for r in out} == want and len(out) == len(want)
    assert out[0].asDict().keys() == dict.fromkeys("conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()).keys()
    edits = defaultdict(list)
    for r in dial.turns(dial.damaged(df)).collect():
        edits[r.conv_id].append((r.seg, r.n, r.k, r.edit, r.role, r.text))
    for c, es in edits.items():
        assert "".join(e[3] for e in sorted(es)) == want[c][6]
        whole = "\n".join(f"{e[4]}:{e[5]}" for e in sorted(es, key=lambda e: e[:3]) if e[3] != "D")
        assert hashlib.sha256(whole.encode()).hexdigest() == want[c][7]


def test_one_long_conversation_spreads(spark):
    """A conversation of many rows goes in segments over several tasks; the queue over all of it at once gives the same."""
    rng = random.Random(1)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice([f"a{t}.", f"b{t}", " "])) for t in range(9000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = dial.repaired(df.repartition(8)).collect()
    faults = [1 if r[3] == " " else 0 if r[3].endswith(".") else 3 for r in rows]
    whole = [(r[2][0], f) for r, f in zip(rows, faults, strict=True)]
    dist = dial.distances(whole, dial.ENDS)
    assert got.cost == dist[0][0] and got.audit == "".join(s[1] for s in dial.walk(whole, dist, 0, True)[0])
    assert got.blank == faults.count(1) and got.illegal == dial.crossed(whole)


def test_query(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op11_dial_repair(spark, tiny).collect()
    assert {r.conv_id: tuple(r)[1:] for r in out} == expected(plain_damage(rows), {r[0] for r in rows})


def test_odd_rows(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert dial.repaired(spark.createDataFrame([], schema)).count() == 0
    rows = [("a", 1, "user", "hi."), ("a", 1, "user", "hi."), ("a", None, None, None), (None, None, None, None), ("n", 0, "assistant", "x" * 300_000)]
    df = spark.createDataFrame(rows, schema)
    want = expected([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], {"a", None, "n"})
    assert {r.conv_id: tuple(r)[1:] for r in dial.repaired(df).collect()} == want
    copies = df.where("conv_id = 'a'").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(5000)))).drop("i")
    (got,) = dial.repaired(copies).collect()
    assert (got.duplicate, got.blank) == (9999, 5000) and Counter(got.audit) == {"D": 14999, "K": 1, "I": 1}
