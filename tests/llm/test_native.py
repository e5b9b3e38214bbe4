"""Hilbert shards, systematic mixing, digest tree and chat formatting."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hyperloom.llm import chat, digest_tree, hilbert, mixing

from .edge import ROWS, frame

BLANK = re.compile(r"[\x20\x09-\x0D]")


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (3, 3)])
def test_curve_visits_every_cell_by_unit_steps(spark, dims, bits):
    side = 1 << bits
    cells = spark.createDataFrame(list(itertools.product(range(side), repeat=dims)), ", ".join(f"x{i} int" for i in range(dims)))
    out = cells.withColumn("h", hilbert.curve_index([F.col(f"x{i}") for i in range(dims)], bits)).orderBy("h").collect()
    assert [r.h for r in out] == list(range(side**dims))
    assert all(sum(abs(a[i] - b[i]) for i in range(dims)) == 1 for a, b in itertools.pairwise(out))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, law):
    out = hilbert.shards(frame(spark), 3, law).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    per = defaultdict(list)
    for r in out:
        per[r.shard].append(r)
    for rs in per.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    if law == "rows":
        assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    runs = sorted((min(r.curve for r in rs), max(r.curve for r in rs)) for rs in per.values())
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(runs))
    assert hilbert.shards(frame(spark, []), 3, law).count() == 0


def test_byte_law_is_near_equal(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    out = hilbert.shards(docs, 4, "bytes").groupBy("shard").agg(F.sum("size").alias("b"), F.max("size").alias("m")).collect()
    mean = sum(r.b for r in out) / 4
    assert len(out) == 4 and all(abs(r.b - mean) <= max(x.m for x in out) for r in out)
    zones = hilbert.zone_map(hilbert.shards(docs, 4)).collect()
    assert sum(r.n_rows for r in zones) == docs.count()


def test_mix(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    a, b = mixing.mix(docs).collect(), mixing.mix(docs.repartition(5)).collect()
    assert sorted(a) == sorted(b)
    got, aim, most = Counter(), {}, Counter()
    for r in a:
        got[r.source] += r.taken
        aim[r.source] = r.target
        most[r.source] = max(most[r.source], r["size"])
        assert r.taken <= 3 * r["size"]
    assert all(abs(got[s] - aim[s]) <= 3 * most[s] for s in aim)
    assert abs(sum(aim.values()) - sum(r["size"] for r in a)) < 1e-6


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 100), ("c", 100), (None, 0)], "source string, source_size long")
    out = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert out["a"] == 3 and out[None] == 0 and out["b"] == pytest.approx(198 * 2 / 5) and out["c"] == pytest.approx(198 * 3 / 5)


def test_mix_odd_rows(spark):
    out = mixing.mix(frame(spark)).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((i, count(t)) for i, t, *_ in ROWS)
    assert mixing.mix(frame(spark, [])).count() == 0
    taken = {(r.doc_id, r.source): r.copies for r in out if r.doc_id not in (None, 2)}
    sampled = Counter(r.doc_id for r in mixing.sample(frame(spark)).collect())
    assert all(sampled[i] == n for (i, _), n in taken.items())
    assert mixing.sample(frame(spark)).columns == frame(spark).columns


def test_dedup(spark):
    out = digest_tree.dedup(frame(spark)).collect()
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), i is None, i))
    want = Counter()
    for norm, rs in groups.items():
        keep = min(rs, key=lambda r: (r[0], r[1], r[2] or 0))
        for r in rs:
            want[(r[2], keep[2], len(rs), hashlib.sha256(norm.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    kept = [r for r in out if r.kept]
    assert len(kept) == len(groups) and {r.text_sha256 for r in kept} == {hashlib.sha256(g.encode()).hexdigest() for g in groups}
    left = digest_tree.survivors(frame(spark))
    assert left.columns == frame(spark).columns and left.count() == len(groups)
    assert digest_tree.dedup(frame(spark, [])).count() == 0


def test_runs_merge_in_rounds(spark, monkeypatch):
    for name, value in (("FAN", 2), ("RUN", 7), ("SLICE", 3), ("HOT", 4)):
        monkeypatch.setattr(digest_tree, name, value)
    rows = [(i if i % 11 else None, f"t{i % 17}" if i % 3 else "hot " * (i % 2 + 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    numbered = digest_tree.cut(digest_tree.digests(df).withColumn("row", F.monotonically_increasing_id()))
    got = Counter((r.keep_id, r.n) for r in digest_tree.merged(numbered).collect())
    groups = defaultdict(list)
    for i, t in rows:
        groups[BLANK.sub("", t)].append((-len(t), i is None, i or 0))
    assert got == Counter((None if min(g)[1] else min(g)[2], len(g)) for g in groups.values())
    out = digest_tree.dedup(df).collect()
    assert sum(r.kept for r in out) == len(groups) and Counter(r.group_size for r in out) == Counter(len(g) for g in groups.values() for _ in g)
    ids = spark.createDataFrame([("b", "x y"), ("a", "xy"), ("c", "x  y"), (None, "z")], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.keep_id or "", r.kept) for r in digest_tree.dedup(ids).collect()) == [("", "", True), ("a", "c", False), ("b", "c", False), ("c", "c", True)]


def test_entries_that_fail_the_check_are_not_merged():
    e = [(b"d", 1, 5, -3, False, 1, 0, 1), (b"d", 1, 5, -2, False, 2, 1, 4), (b"d", 2, 5, -9, False, 3, 2, 1), (b"d", 2, 6, -9, False, 4, 3, 1)]
    assert [(x[5], x[7]) for x in digest_tree.combined(e)] == [(1, 5), (3, 1), (4, 1)]


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "system", "be \\ nice <|"), (1, 1, "user", "<\\|im_end|>\n"), (1, 2, "assistant", "a<|im_end|>\nb"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "tool\n<x", "t"),
        (2, 0, "user", "only"), (2, 1, "user", "only"), (3, None, None, "x"), (3, 1, "assistant", "ñ\U0001f600\\"), (None, 0, "assistant", "y"), (4, 0, "assistant", "<|im_start|>user\n\\\\"), (4, 0, "assistant", "<|im_start|>user\n\\\\"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    out = {r.conv_id: r for r in chat.read_back(chat.examples(df)).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for c, rs in by.items():
        rs.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rs)
        loss = "".join(r[3] or "" for r in rs if r[2] == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256) == (len(rs), hashlib.sha256(said.encode()).hexdigest())
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    each = chat.examples(df).where("conv_id = 1").orderBy("example").collect()
    assert len(each) == 3 and each[2].loss_start == each[2].loss_end and each[0].formatted[each[0].loss_start : each[0].loss_end] == "a<\\|im_end|>\nb"
    assert chat.read_back(chat.examples(df.limit(0))).count() == 0
