"""The tagger against all paths, and the vehicles of comparisons against a plain reading of the rule."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.operators import tagging
from hyperloom.plans import standin as S
from hyperloom.plans import channels, wording

CUES = tagging.Cues(markers=frozenset({"is", "like"}), links=frozenset({"of"}), idle=frozenset({"the", "a"}), before=("ago",))


def made(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        words = [rng.choice(["the", "house", "houses", "run", "runs", "of", "is", "Rome", "7", "."]) for _ in range(rng.randint(1, 6))]
        rows.append((words, [{"the": "u", "of": "u", "is": "v", "Rome": "nr", "7": "m", ".": "w"}.get(w, "n" if w.startswith("h") else rng.choice("vn")) for w in words]))
    return rows


def test_counts_and_best_paths(spark):
    rows = made()
    tagger = tagging.Tagger.learned(spark.createDataFrame(rows, "words array<string>, tags array<string>"))
    by_tag = Counter(t for _, ts in rows for t in ts)
    steps, first = Counter(), Counter(ts[0] for _, ts in rows)
    for _, ts in rows:
        steps.update(itertools.pairwise(ts))
    at = {t: i for i, t in enumerate(tagger.tags)}
    assert tagger.tags == sorted(by_tag)
    import math

    for a, b in itertools.product(tagger.tags, repeat=2):
        assert tagger.step[at[a], at[b]] == pytest.approx(math.log((steps[a, b] + 0.1) / sum(steps[a, x] + 0.1 for x in tagger.tags)))
    assert tagger.first[at["u"]] == pytest.approx(math.log((first["u"] + 0.1) / (len(rows) + 0.1 * len(tagger.tags))))
    said = [["the", "house", "is", "Rome"], ["houseling", "runs"], [], ["of"], ["7", "zzz", "the", "."]]
    for words, tags in zip(said, tagger.tag(said), strict=True):
        if words:
            best = max(tagging.log_chance(tagger, words, p) for p in itertools.product(tagger.tags, repeat=len(words)))
            assert tagging.log_chance(tagger, words, tags) == pytest.approx(best)
        else:
            assert tags == []


def test_unknown_words_go_by_their_ending(spark):
    rows = [([f"x{i}tion", f"y{i}ly"], ["n", "v"]) for i in range(40)]
    tagger = tagging.Tagger.learned(spark.createDataFrame(rows, "words array<string>, tags array<string>"))
    assert tagger.tag([["motion"], ["slowly", "nation"]]) == [["n"], ["v", "n"]]


@pytest.mark.parametrize(
    "said,want",
    [
        ("Time/n is/v money/n", "money"),
        ("He/r is/v the/u rock/n of/u our/r team/n", "team"),
        ("He/r is/v the/u best/a friend/n", None),
        ("She/r is/v ,/w a/u star/n", None),
        ("It/r is/v like/v fire/n", "fire"),
        ("It/r is/v a/u b/n star/n", None),
        ("life/n is/v the/u big/m wide/q stage/n", "stage"),
        ("life/n is/v r/r r/r r/r r/r r/r stage/n", "stage"),
        ("life/n is/v r/r r/r r/r r/r r/r r/r stage/n", None),
        ("is/v", None),
    ],
)
def test_vehicles(said, want):
    words, tags = zip(*(x.rsplit("/", 1) for x in said.split(" ")), strict=True)
    found = [words[v] for _, v in tagging.vehicles(words, tags, CUES)]
    assert found == ([want] if want else [])


def test_patterns():
    read = lambda s: tagging.pattern(*zip(*(x.rsplit("/", 1) for x in s.split(" ")), strict=True), CUES)
    assert read("he/r is/v the/u old/m iron/n horse/n now/d") == "is iron horse"
    assert read("stone/n age/n ago/d life/n is/v war/n") == "stone age ago"
    assert read("ago/d life/n is/v war/n") == "is war"
    assert read("life/n is/v like/v war/n") == "like war"
    assert read("life/n runs/v") is None


def plain_sentences(text):
    for sent, part in enumerate(re.split(r"(?<=[.!?。！？\n])", text or "")):
        words = re.findall(r"[^\W]+|[^\w\s]", part)
        if words:
            yield sent, words


def plain_vehicles(words, tags, cues):
    for i, w in enumerate(words):
        if w in cues.markers:
            nouns, after = [], False
            for v, t in list(zip(words, tags, strict=True))[i + 1 : i + 7]:
                if v in cues.markers or not re.search(r"[^\W_]", v):
                    break
                if v in cues.links | cues.idle or t == "u":
                    after |= v in cues.links or t == "u"
                    continue
                if t[0] in "rmqupcey":
                    continue
                if t[0] not in "nil" or len(v) < 2:
                    break
                nouns.append((v, t, after))
                after = False
            if nouns:
                yield w, *([n for n in nouns if n[2]][-1:] or nouns)[0][:2]


def test_queries_equal_a_plain_reading(spark, tiny):
    tagger = wording.tagger(spark, tiny)
    words_of, want, digests = defaultdict(list), Counter(), {}
    for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect():
        for sent, words in plain_sentences(r.text):
            words_of[f"c{r.doc_id}"].append((sent, words))
    for chunk, sents in words_of.items():
        tags = [tagger.tag([w])[0] for _, w in sents]  # one sentence at a time: batches change nothing
        digests[chunk] = (sum(len(w) for _, w in sents), hashlib.sha256("\n".join(map(" ".join, tags)).encode()).hexdigest())
        for (sent, words), ts in zip(sents, tags, strict=True):
            want.update((chunk, sent, *v) for v in plain_vehicles(words, ts, wording.CUES))
    assert {r.chunk_id: (r.n_words, r.tags_sha256) for r in wording.tagged_words(spark, tiny).collect()} == digests
    assert Counter(map(tuple, wording.comparison_vehicles(spark, tiny).collect())) == want and len(want) > 20


def test_tags_of_documents_never_seen(spark, tiny):
    """Held-out sentences: the model agrees with the annotation."""
    unseen = wording.said(spark, tiny).where(F.crc32(F.col("chunk_id").cast("binary")) % 2 == 1)
    both = tagging.tagged(wording.annotated(unseen).withColumnRenamed("tags", "true"), wording.tagger(spark, tiny))
    r = both.select(F.explode(F.arrays_zip("true", "tags")).alias("p")).agg(F.avg((F.col("p.true") == F.col("p.tags")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    assert r.a > 0.9 and r.n > 5000


def test_candidates_by_hand(spark):
    found = spark.createDataFrame([("c1", 0, "is", "tion", "n"), ("c2", 0, "is", "den", "n"), ("c3", 0, "is", "Rome", "nr"), ("c4", 0, "is", "boat", "n"), ("c5", 0, "is", "fire", "n"), ("c6", 0, "is", "den", "n")], "chunk_id string, sent int, marker string, vehicle string, flag string")
    fields = S.rows_of(spark, S.FIELDS, "field, word")
    literal = spark.createDataFrame([("c6", "HOUSE")], "chunk_id string, field string")
    args = (found, S.frames(spark), fields, S.rows_of(spark, S.BRIDGES, "field, frame_id"), literal, ["fire"], wording.CUES)
    got = {r.chunk_id: (r.source_domain, r.target_domain) for r in tagging.candidates(*args).collect()}
    assert got == {"c1": ("of the", "tion"), "c2": ("que", "los")}
    got = {r.chunk_id: (r.source_domain, r.target_domain) for r in tagging.candidates(*args, generic=True).collect()}
    assert got == {"c1": ("of the", "tion"), "c2": ("que", "los"), "c4": ("boat", tagging.PENDING)}


def test_vehicles_become_edges(spark, tiny):
    """Each discovery that can be located is an edge of the third channel, unless an earlier one has its frame and extent."""
    edges = channels.heuristic_edges(spark, tiny).collect()
    texts = {f"c{r.doc_id}": r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    found = {(r.chunk_id, r.vehicle) for r in wording.heuristic_candidates(spark, tiny).collect()}
    third = {(e.chunk_id, e.triggers): e for e in edges if e.channel == 3}
    assert third and third.keys() <= found
    for (chunk, vehicle), e in third.items():
        places = [m.start() for m in re.finditer(re.escape(vehicle), texts[chunk])]
        assert (e.low, e.high) == (places[0], places[-1] + len(vehicle)) and e.confidence == 0.5 and e.frame_id
    assert {e.channel for e in edges} == {1, 2, 3}


def test_sure_words_cut_sentences():
    """words that no neighbour can change take no step, and the rest is tagged as over all paths."""
    words = [("a", "u", 500), ("b", "n", 500), ("c", "n", 400), ("c", "v", 60), ("d", "v", 90), ("d", "u", 90)]
    likely = {("n", "v"), ("v", "u"), ("u", "n"), (None, "n"), ("u", "u")}
    tagger = tagging.Tagger(words, [(x, y, 2000 if (x, y) in likely else 3) for x, y in itertools.product([None, "n", "u", "v"], "nuv")], [])
    _, sure = tagger._sure(np.array([tagger.emission(w) for w in "abcd"]))
    assert sure.tolist() == [True, True, False, False]
    rng = random.Random(2)
    for _ in range(40):
        said = [rng.choice("abcdd") for _ in range(rng.randint(1, 7))]
        best = max(tagging.log_chance(tagger, said, p) for p in itertools.product(tagger.tags, repeat=len(said)))
        assert tagging.log_chance(tagger, said, tagger.tag([said])[0]) == pytest.approx(best)


def test_sentences_that_hold_a_word(spark):
    """only sentences with a marker are tagged where others have no result."""
    rows = spark.createDataFrame([("c", "This is it. Isis was. éis? (is) now.\nas_ if. like, so! it's .")], "chunk_id string, text string")
    whole = tagging.sentences(rows).collect()
    kept = tagging.sentences(rows, holding={"is", "as", "like", "'"}).collect()
    assert {r.sent for r in kept} == {r.sent for r in whole if {"is", "as", "like", "'"} & set(r.words)} and 0 < len(kept) < len(whole)
