"""Segmentation against a plain lattice search."""

import collections
import hashlib
import itertools
import math
import random
import re

import pytest

from hyperloom.operators import segmenting
from hyperloom.plans import wording


def plain(words, total, text, unknown):
    """The route of greatest log frequency from each place on, longer next words first among equals."""
    out = []
    for m in re.finditer(r"\w+|[^\w\s]", text or ""):
        b = m.group()
        n = len(b)
        value, to = [0.0] * (n + 1), [0] * n
        longest = max(map(len, words), default=1)
        for i in range(n - 1, -1, -1):
            ways = [(p + value[j], j) for j in range(i + 1, min(n, i + longest) + 1) if (p := words.get(b[i:j])) is not None]
            if b[i] not in words:
                ways.append((-total + value[i + 1], i + 1))
            value[i], to[i] = max(ways)
        i = run = 0
        while i < n:
            if b[i : to[i]] in words:
                out += unknown(b[run:i]) + [b[i : to[i]]]
                run = to[i]
            i = to[i]
        out += unknown(b[run:n])
    return out


def scores(lexicon):
    return dict(zip(lexicon.words, lexicon.score.tolist(), strict=True)), lexicon.total


@pytest.mark.parametrize("letters", ["abcde", "天地玄黄宇宙", "aé\U0001f600b"])
def test_routes_equal_a_plain_lattice(letters):
    rng = random.Random(len(letters))
    for _ in range(150):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 12))})
        lexicon = segmenting.Lexicon(words, [rng.randint(1, 9) for _ in words])
        texts = ["".join(rng.choice(letters + "x9 .\n") for _ in range(rng.randint(0, 30))) for _ in range(4)] + [None, "", "  "]
        assert lexicon.segment(texts) == [plain(*scores(lexicon), t, lexicon.unknown) for t in texts]


def test_unknown_runs_take_the_best_path():
    lexicon = segmenting.Lexicon(["天地", "玄黄色", "人", "大地"], [5, 3, 2, 4])
    say = lambda t, x: lexicon.letters[t][0].get(x, lexicon.letters[t][1])
    for run in ("天色", "人天黄地", "色色色", "地"):
        best = -math.inf
        for tags in itertools.product(range(4), repeat=len(run)):
            if tags[0] in (0, 3) and tags[-1] in (2, 3) and all(b in segmenting.FOLLOW[a] for a, b in itertools.pairwise(tags)):
                best = max(best, lexicon.first[tags[0]] + sum(lexicon.moves[a][b] for a, b in itertools.pairwise(tags)) + sum(map(say, tags, run)))
        cut = lexicon.unknown(run)
        tags = [t for w in cut for t in ([3] if len(w) == 1 else [0, *[1] * (len(w) - 2), 2])]
        got = lexicon.first[tags[0]] + sum(lexicon.moves[a][b] for a, b in itertools.pairwise(tags)) + sum(map(say, tags, run))
        assert "".join(cut) == run and (len(run) == 1 or got == pytest.approx(best))
    assert lexicon.unknown("abc12") == ["abc12"] and lexicon.unknown("") == []


def test_places_and_odd_rows(spark):
    lexicon = segmenting.Lexicon(["to", "day", "today"], [3, 3, 9])
    rows = [(1, "today to\tday!", "x"), (2, None, "x"), (2, "", "x"), (None, "xto", "x")]
    out = segmenting.segmented(spark.createDataFrame(rows, "chunk_id int, text string, words string"), lexicon).collect()
    assert [(r.chunk_id, [tuple(w) for w in r.words]) for r in out] == [(1, [("today", 0, 5), ("to", 6, 8), ("day", 9, 12), ("!", 12, 13)]), (2, []), (2, []), (None, [("x", 0, 1), ("to", 1, 3)])]
    with pytest.raises(ValueError):
        segmenting.Lexicon(["a"] * (segmenting.MOST_WORDS + 1), [1] * (segmenting.MOST_WORDS + 1))
    long = segmenting.Lexicon(["ab"], [1]).segment(["ab" * 200_000])
    assert len(long[0]) == 200_000


def test_query_equals_brute_force_and_finds_the_lost_blanks(spark, tiny):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    counts = collections.Counter(w for t in texts.values() for w in split(t) if re.fullmatch(r"\w+", w))
    kept = dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:50_000])
    total = math.log(sum(kept.values()))
    lexicon = segmenting.Lexicon(list(kept), list(kept.values()))
    words = {w: math.log(c) - total for w, c in kept.items()}
    right = said = there = 0
    want = {}
    for d, t in texts.items():
        if len(t or "") > 4000:  # the plain search is slow; the longer ones are read by the query all the same
            continue
        cut = plain(words, total, "".join(split(t)), lexicon.unknown)
        want[d] = (len(cut), hashlib.sha256("\n".join(cut).encode()).hexdigest())
        ends = lambda ws: set(itertools.accumulate(map(len, ws)))
        own, found = ends(split(t)), ends(cut)
        right, said, there = right + len(own & found), said + len(found), there + len(own)
    got = {r.doc_id: (r.n_words, r.words_sha256) for r in wording.segmented_words(spark, tiny).collect()}
    assert got.keys() == texts.keys() and {d: got[d] for d in want} == want
    assert right / there > 0.85 and right / said > 0.6
