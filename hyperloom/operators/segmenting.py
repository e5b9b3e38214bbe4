"""Words of texts written without blanks: a dictionary as a trie in arrays, the lattice of its words, the most probable route.

Every place of a text follows the trie at once, a letter a step, so the lattice of a whole batch takes as many array
operations as the longest word has letters. The route with the greatest sum of log frequencies is found from the
end of a block to its start; of equal routes the one with the longer next word is taken. Letters that no word covers
have frequency 1. Runs of such letters go to a model of word positions (begin, middle, end, single), whose
counts come from the dictionary's own words, and whose best path cuts the run; runs of Latin letters and digits stay whole.

A dictionary is an input that every task holds: at most ``MOST_WORDS`` words, beyond which ``Lexicon.of`` raises.
Null texts have no words; blanks separate words and are none; other signs are words of their own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_WORDS = 500_000
LETTERS_AT_ONCE = 200_000
BEGIN, MIDDLE, END, SINGLE = range(4)
#: What may follow each position in a word.
FOLLOW = {BEGIN: (MIDDLE, END), MIDDLE: (MIDDLE, END), END: (BEGIN, SINGLE), SINGLE: (BEGIN, SINGLE)}
_BLOCK = re.compile(r"\w+|[^\w\s]")
_PLAIN = re.compile(r"[A-Za-z0-9À-ɏ]+")
_NONE = -1e9


class Trie:
    """Nodes in order of depth; an arc is found by halving in the sorted array of (node, letter)."""

    def __init__(self, words: list[str]):
        codes = [np.frombuffer(w.encode("utf-32-le"), dtype=np.uint32).astype(np.int64) for w in words]
        sizes = np.array([len(c) for c in codes], dtype=np.int64)
        self.depth = int(sizes.max()) if len(sizes) else 0
        node = np.zeros(len(words), dtype=np.int64)
        arcs, targets, total = [], [], 1
        self.word = np.full(1, -1, dtype=np.int64)
        for d in range(self.depth):
            live = np.flatnonzero(sizes > d)
            key = node[live] << 21 | np.array([codes[i][d] for i in live.tolist()], dtype=np.int64)
            fresh, which = np.unique(key, return_inverse=True)
            arcs.append(fresh)
            targets.append(np.arange(total, total + len(fresh)))
            node[live] = total + which
            self.word = np.concatenate([self.word, np.full(len(fresh), -1, dtype=np.int64)])
            ended = live[sizes[live] == d + 1]
            self.word[node[ended]] = ended
            total += len(fresh)
        self.arcs = np.concatenate(arcs) if arcs else np.zeros(0, dtype=np.int64)
        by = np.argsort(self.arcs)
        self.arcs, self.targets = self.arcs[by], (np.concatenate(targets) if targets else self.arcs)[by]

    def lattice(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, length and number of every word at every place; 0 among the letters ends a block."""
        at = np.flatnonzero(letters > 0)
        node = np.zeros(len(at), dtype=np.int64)
        starts, lengths, words = [], [], []
        for d in range(self.depth):
            inside = at + d < len(letters)
            at, node = at[inside], node[inside]
            key = node << 21 | letters[at + d]
            slot = np.searchsorted(self.arcs, key)
            there = (slot < len(self.arcs)) & (self.arcs[np.minimum(slot, len(self.arcs) - 1)] == key)
            at, node = at[there], self.targets[slot[there]]
            if not len(at):
                break
            word = self.word[node]
            ended = word >= 0
            starts.append(at[ended])
            lengths.append(np.full(int(ended.sum()), d + 1))
            words.append(word[ended])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
        return cat(starts), cat(lengths), cat(words)


class Lexicon:
    """Words with frequencies, their trie, and the counts of letters by position in a word."""

    def __init__(self, words: list[str], counts: list[int]):
        if len(words) > MOST_WORDS:
            raise ValueError(f"a dictionary of {len(words)} words; every task holds it, and {MOST_WORDS} is the most")
        kept = {w: c for w, c in sorted(zip(words, counts, strict=True)) if w and c > 0}
        self.words, self.trie = list(kept), Trie(list(kept))
        self.total = math.log(max(1, sum(kept.values())))
        self.score = np.log(np.array(list(kept.values()), dtype=np.float64)) - self.total
        self._learn(kept)

    @classmethod
    def of(cls, table: DataFrame, word: str = "word", count: str = "n") -> Lexicon:
        """From a table, of which at most one row more than is allowed is fetched."""
        rows = table.where(F.col(word).isNotNull() & (F.col(count) > 0)).select(word, count).limit(MOST_WORDS + 1).toPandas()
        return cls(rows[word].tolist(), rows[count].tolist())

    def _learn(self, kept: dict[str, int]) -> None:
        seen = [{} for _ in range(4)]
        moves = np.ones((4, 4)) * 1e-3
        for w, c in kept.items():
            tags = [SINGLE] if len(w) == 1 else [BEGIN, *[MIDDLE] * (len(w) - 2), END]
            for x, t in zip(w, tags, strict=True):
                seen[t][x] = seen[t].get(x, 0) + c
            for a, b in zip(tags[:-1], tags[1:], strict=True):
                moves[a, b] += c
        singles = sum(c for w, c in kept.items() if len(w) == 1)
        longer = sum(kept.values()) - singles
        for a in (END, SINGLE):  # what follows a word is a word
            moves[a, BEGIN] += longer
            moves[a, SINGLE] += singles
        self.moves = {a: {b: math.log(moves[a, b] / sum(moves[a, x] for x in FOLLOW[a])) for b in FOLLOW[a]} for a in FOLLOW}
        self.first = {BEGIN: math.log((longer + 1) / (longer + singles + 2)), SINGLE: math.log((singles + 1) / (longer + singles + 2))}
        kinds = len({x for s in seen for x in s}) + 1
        self.letters = [({x: math.log((c + 0.5) / (sum(s.values()) + 0.5 * kinds)) for x, c in s.items()}, math.log(0.5 / (sum(s.values()) + 0.5 * kinds))) for s in seen]

    def unknown(self, run: str) -> list[str]:
        """A run of letters no word covers, cut by the best path of positions."""
        if len(run) < 2 or _PLAIN.fullmatch(run):
            return [run] if run else []
        say = lambda t, x: self.letters[t][0].get(x, self.letters[t][1])
        best = {t: self.first.get(t, _NONE) + say(t, run[0]) for t in range(4)}
        back: list[dict[int, int]] = []
        for x in run[1:]:
            came = {t: max((a for a in FOLLOW if t in FOLLOW[a]), key=lambda a, t=t: best[a] + self.moves[a][t]) for t in range(4)}
            best = {t: best[a] + self.moves[a][t] + say(t, x) for t, a in came.items()}
            back.append(came)
        tag = max((END, SINGLE), key=lambda t: best[t])
        tags = [tag]
        for came in reversed(back):
            tags.append(came[tags[-1]])
        out, start = [], 0
        for i, t in enumerate(reversed(tags)):
            if t in (END, SINGLE):
                out.append(run[start : i + 1])
                start = i + 1
        return out

    def routes(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        """Per text the words of its best route: start and end, from 0."""
        blocks = [(d, m.start(), m.end()) for d, t in enumerate(texts) if t for m in _BLOCK.finditer(t)]
        letters = np.frombuffer("\0".join(texts[d][a:b] for d, a, b in blocks).encode("utf-32-le") + b"\0\0\0\0", dtype=np.uint32).astype(np.int64)
        start, size, word = self.trie.lattice(letters)
        by = np.lexsort((size, start))
        start, size = start[by].tolist(), size[by].tolist()
        score = self.score[word[by]].tolist() if len(by) else []
        heads = np.searchsorted(np.array(start, dtype=np.int64), np.arange(len(letters) + 1)).tolist()
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        lone, base = -self.total, 0
        for d, a, b in blocks:
            n = b - a
            value, hop = [0.0] * (n + 1), [1] * n
            for i in range(n - 1, -1, -1):
                best, step, lo, hi = None, 1, heads[base + i], heads[base + i + 1]
                if lo == hi or size[lo] > 1:  # the letter is no word: it counts as one of frequency 1
                    best = lone + value[i + 1]
                for e in range(lo, hi):
                    v = score[e] + value[i + size[e]]
                    if best is None or v >= best:
                        best, step = v, size[e]
                value[i], hop[i] = best, step
            i, run = 0, 0  # run: where letters began that are no words
            text, mine = texts[d], out[d]
            while i < n:
                if hop[i] > 1 or heads[base + i] < heads[base + i + 1] and size[heads[base + i]] == 1:
                    self._cut(text, a + run, a + i, mine)
                    mine.append((a + i, a + i + hop[i]))
                    run = i + hop[i]
                i += hop[i]
            self._cut(text, a + run, b, mine)
            base += n + 1
        return out

    def _cut(self, text: str, lo: int, hi: int, out: list[tuple[int, int]]) -> None:
        for w in self.unknown(text[lo:hi]):
            out.append((lo, lo + len(w)))
            lo += len(w)

    def segment(self, texts: list[str | None]) -> list[list[str]]:
        return [[t[a:b] for a, b in r] if t else [] for t, r in zip(texts, self.routes(texts), strict=True)]


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t or "") > LETTERS_AT_ONCE:
            yield lo, i
            lo, size = i, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


def segmented(chunks: DataFrame, lexicon: Lexicon, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """key, words: array of (word, start, end) in order, places from 0."""
    held = chunks.sparkSession.sparkContext.broadcast(lexicon)  # at most MOST_WORDS words
    kind = chunks.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t if isinstance(t, str) else None for t in frame["text"]]
            for lo, hi in _parts(texts):
                words = [[{"word": t[a:b], "start": a, "end": b} for a, b in r] for t, r in zip(texts[lo:hi], held.value.routes(texts[lo:hi]), strict=True)]
                yield pd.DataFrame({"key": frame["key"].iloc[lo:hi].to_numpy(), "words": words})

    rows = chunks.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, words array<struct<word:string,start:int,end:int>>").withColumnRenamed("key", key)


def counted(chunks: DataFrame, text: str = "text", most: int = 50_000) -> DataFrame:
    """word, n: the ``most`` most frequent words between blanks, of equals the first by code point; a dictionary for texts whose blanks are lost."""
    words = chunks.select(F.explode(F.split(text, r"[\x20\x09-\x0D]+")).alias("word")).where(F.col("word").rlike(r"^[\p{L}\p{N}_]+$"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)
