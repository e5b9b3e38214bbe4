"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

A square is a stretch of words said twice in a row; a run is a stretch of smallest period q
that no neighbouring word extends. The method finds the vocabulary of squares first and
then where each occurs:

1. Lempel-Ziv blocks. Each block is the longest stretch that begins earlier, too. A square's
   leftmost occurrence touches a block's end, so common extensions to both sides of block
   ends, for every period a block allows, give a set of squares that covers all others.
2. Suffix-link walks. From a square at i the walk drops its first word and asks whether the
   rest can be followed by that word in the suffix tree; as long as it can, the next square
   is marked. The tree is the sorted suffixes with their common prefixes: a node is an
   interval of ranks, a suffix link the interval of the suffix one word on.
3. Every suffix in a marked interval is a square's place. Places of one period that follow
   each other without a gap are a run.

All steps are array operations over many documents at once (``WORDS_AT_ONCE`` words, or one
document): suffixes sort by doubling, only groups still tied being sorted again; minima over
intervals come from a table over blocks of 32 ranks. Memory grows with the words of one
document, about 100 bytes a word. Squares whose half is itself a repetition are left out, as
their run has a smaller period and is found by it.

Null texts have no words; null ids are read as the empty text where an id's digest is asked
for; repeated rows give a row each; an empty table gives an empty result; other columns are
ignored. Of runs with equal exponent the first by start, then by period, is the greatest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship

WORDS_AT_ONCE = 300_000
BLOCK = 32
FAR = np.int32(2**31 - 1)
#: The bounds of a run as the contract has them: words, and lengths of its period.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4


class Minima:
    """Minima over intervals of an array, ends included, by prefix and suffix minima of blocks and a table over whole blocks."""

    def __init__(self, values: np.ndarray):
        n = -(-len(values) // BLOCK) or 1
        self.values = np.full(n * BLOCK, FAR, dtype=np.int32)
        self.values[: len(values)] = values
        blocks = self.values.reshape(n, BLOCK)
        self.before = np.minimum.accumulate(blocks, axis=1).ravel()
        self.behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        levels = [blocks.min(axis=1)]
        while 2 << (len(levels) - 1) <= n:
            half, last = 1 << (len(levels) - 1), levels[-1]
            wide = last.copy()
            wide[: n - half] = np.minimum(last[: n - half], last[half:])
            levels.append(wide)
        self.levels = np.vstack(levels)

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        first, last = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.behind[lo], self.before[hi])
        wide = np.flatnonzero(last - first > 1)
        if len(wide):
            span = last[wide] - first[wide] - 1
            j = np.frexp(span.astype(np.float64))[1] - 1
            inner = np.minimum(self.levels[j, first[wide] + 1], self.levels[j, last[wide] - (1 << j)])
            out[wide] = np.minimum(out[wide], inner)
        near = np.flatnonzero(first == last)
        if len(near):
            at, end = lo[near].copy(), hi[near]
            least = self.values[at]
            while (open_ := np.flatnonzero(at < end)).size:
                at[open_] += 1
                least[open_] = np.minimum(least[open_], self.values[at[open_]])
            out[near] = least
        return out


class Suffixes:
    """Sorted suffixes of documents that each end with a mark of their own: order, rank and common prefix with the suffix before."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        n = len(words)
        self.words, self.n = words, n
        key = doc.astype(np.int64) * (int(words.max()) + 1 if n else 1) + words
        order = np.argsort(key, kind="stable").astype(np.int32)
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        lcp = np.where(fresh, 0, FAR).astype(np.int32)  # FAR: still tied
        rank = np.empty(n, dtype=np.int32)
        heads = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), 0))
        rank[order] = heads
        h = 1
        while True:
            tied = ~fresh
            tied[:-1] |= ~fresh[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            group, mine = heads[at], order[at]
            ahead = rank[mine + h]
            by = np.argsort(group.astype(np.int64) * n + ahead, kind="stable")
            order[at] = mine[by]
            ahead = ahead[by]
            split = np.flatnonzero((group[1:] == group[:-1]) & (ahead[1:] != ahead[:-1])) + 1  # groups keep their places
            least = Minima(lcp)
            lcp[at[split]] = h + least(ahead[split - 1] + 1, ahead[split])
            fresh[at[split]] = True
            heads = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), 0))
            rank[order[at]] = heads[at]
            h *= 2
        self.order, self.rank, self.lcp = order, rank, lcp
        self.least = Minima(lcp)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words two different suffixes share."""
        ra, rb = self.rank[a], self.rank[b]
        return self.least(np.minimum(ra, rb) + 1, np.maximum(ra, rb))

    def interval(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranks, ends included, of the suffixes that share the first ``size`` words of a suffix."""
        return self._reach(self.rank[at].astype(np.int64), size, -1), self._reach(self.rank[at].astype(np.int64), size, 1)

    def _reach(self, start: np.ndarray, size: np.ndarray, way: int) -> np.ndarray:
        lo, hi = np.zeros(len(start), dtype=np.int64), (start if way < 0 else self.n - 1 - start).copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_] + 1) // 2
            at = start[open_]
            good = self.least(at - mid + 1, at) >= size[open_] if way < 0 else self.least(at + 1, at + mid) >= size[open_]
            lo[open_] = np.where(good, mid, lo[open_])
            hi[open_] = np.where(good, hi[open_], mid - 1)
        return start + way * lo

    def nearest_smaller(self, way: int) -> tuple[np.ndarray, np.ndarray]:
        """Per rank the next rank on one side whose suffix begins earlier, and the words shared with it (0 if there is none)."""
        n, s = self.n, self.order
        if way < 0:
            step, shared = np.arange(-1, n - 1, dtype=np.int64), self.lcp.astype(np.int64)
        else:
            step, shared = np.arange(1, n + 1, dtype=np.int64), np.append(self.lcp[1:], 0).astype(np.int64)
        inside = lambda p: (p >= 0) & (p < n)
        open_ = np.flatnonzero(inside(step) & (shared > 0))
        while len(open_):
            p = step[open_]
            worse = s[p] > s[open_]
            open_, p = open_[worse], p[worse]
            if not len(open_):
                break
            far, least = step[p], np.minimum(shared[open_], shared[p])  # read before writing: all jump at once
            step[open_], shared[open_] = far, least
            open_ = open_[inside(far) & (least > 0)]
        shared[~inside(step)] = 0
        return step, shared


def longest_before(suffixes: Suffixes) -> np.ndarray:
    """Per position the length of the longest stretch there that also begins earlier."""
    best = np.maximum(suffixes.nearest_smaller(-1)[1], suffixes.nearest_smaller(1)[1])
    out = np.empty(suffixes.n, dtype=np.int64)
    out[suffixes.order] = best
    return out


def blocks_of(longest: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lempel-Ziv blocks of each document: start, length, and the length of the block after (0 after the last)."""
    hops = longest.tolist()
    at, of = [], []
    for d, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        while lo < hi:
            at.append(lo)
            of.append(d)
            lo += hops[lo] or 1
    h, d = np.array(at, dtype=np.int64), np.array(of, dtype=np.int64)
    size = np.maximum(longest[h], 1) if len(h) else h
    size = np.minimum(size, ends[d] - h) if len(h) else size
    after = np.zeros_like(size)
    if len(h) > 1:
        after[:-1] = np.where(d[1:] == d[:-1], size[1:], 0)
    return h, size, after


def _ranges(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n[i]-1 for each i."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def covering_squares(suffixes: Suffixes, starts: np.ndarray, ends: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Squares (start, half) that hold the leftmost occurrence of every square's rotations; halves of at most a document's length over ``exponent``."""
    w = suffixes.words
    h, size, after = blocks_of(longest_before(suffixes), starts, ends)
    if not len(h):
        return h, h
    d = np.searchsorted(starts, h, side="right") - 1
    most = (ends[d] - starts[d]) // exponent
    found_at, found_k = [], []
    for inner in (True, False):
        n = np.minimum(size if inner else size + after, most)
        begin, end = np.repeat(starts[d], n), np.repeat(ends[d], n)
        k = _ranges(n) + 1
        a = np.repeat(h + size if inner else h, n)  # the block's end, or its start
        left = a - k if inner else a  # both copies are read from left and left + k
        right = left + k
        keep = (left >= begin) & (right < end)
        keep[keep] = w[left[keep]] == w[right[keep]]
        left, right, k, begin = left[keep], right[keep], k[keep], begin[keep]
        ahead = suffixes.common(left, right)
        back = common_before(suffixes, left, right, begin)
        good = ahead + back >= k
        left, back, k = left[good], back[good], k[good]
        found_at.append(np.maximum(left - back, left - k + 1))
        found_k.append(k)
    at, k = np.concatenate(found_at), np.concatenate(found_k)
    if not len(at):
        return at, k
    pair = np.unique(np.stack([at, k]), axis=1)
    return pair[0], pair[1]


def common_before(suffixes: Suffixes, left: np.ndarray, right: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How many words just before left and right agree, inside the document that begins at ``begin``."""
    w, out = suffixes.words, np.zeros(len(left), dtype=np.int64)
    some = np.flatnonzero(left > begin)
    some = some[w[left[some] - 1] == w[right[some] - 1]]
    lo, hi = np.ones(len(some), dtype=np.int64), (left - begin)[some].astype(np.int64)
    a, b = left[some], right[some]
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_] + 1) // 2
        good = suffixes.common(a[open_] - mid, b[open_] - mid) >= mid
        lo[open_] = np.where(good, mid, lo[open_])
        hi[open_] = np.where(good, hi[open_], mid - 1)
    out[some] = lo
    return out


def smallest_factors(most: int) -> np.ndarray:
    """The smallest prime factor of each number up to ``most``."""
    out = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if out[p] == p:
            part = out[p * p :: p]
            part[part == np.arange(p * p, most + 1, p)] = p
    return out


def primitive(suffixes: Suffixes, at: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the half of a square is no repetition itself: no prime factor of its length shortens its period."""
    good = np.ones(len(at), dtype=bool)
    if not len(at):
        return good
    factor, rest = smallest_factors(int(k.max())), k.copy()
    while (open_ := np.flatnonzero(good & (rest > 1))).size:
        p = factor[rest[open_]]
        period = k[open_] // p
        good[open_] = suffixes.common(at[open_], at[open_] + period) < k[open_] - period
        rest[open_] //= p
    return good


def vocabulary(suffixes: Suffixes, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The interval of ranks (low, high) and the half of every square that suffix-link walks reach from the given ones."""
    w, n = suffixes.words, suffixes.n
    seen: np.ndarray = np.zeros(0, dtype=np.int64)
    lows, highs, halves = [], [], []
    while len(at):
        # along one occurrence a walk is a row of rotations, as far as both copies agree; a full turn returns to its start
        turn = np.minimum(suffixes.common(at, at + k) - k, k - 1) + 1
        i, half = np.repeat(at, turn) + _ranges(turn), np.repeat(k, turn)
        ends = np.cumsum(turn) - 1
        low, high = suffixes.interval(i, 2 * half)
        key = half * n + low
        last = np.zeros(len(i), dtype=bool)
        last[ends] = turn < k  # not yet a full turn: the walk goes on elsewhere
        _, first = np.unique(key, return_index=True)
        new = first[~np.isin(key[first], seen, assume_unique=False)]
        lows.append(low[new])
        highs.append(high[new])
        halves.append(half[new])
        known = seen
        seen = np.union1d(seen, key[new])
        # a suffix link from the end of each row, then the branch with the dropped word
        e = np.flatnonzero(last & ~np.isin(key, known))
        j, half, word = i[e], half[e], w[i[e]]
        lo, hi = suffixes.interval(j + 1, 2 * half - 1)
        a, b = lo.copy(), hi.copy()
        while (open_ := np.flatnonzero(a < b)).size:  # the first suffix of the interval whose next word is not smaller
            mid = (a[open_] + b[open_]) // 2
            less = w[suffixes.order[mid] + 2 * half[open_] - 1] < word[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
        there = w[suffixes.order[a] + 2 * half - 1] == word
        at, k = suffixes.order[a[there]].astype(np.int64), half[there]
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    return cat(lows), cat(highs), cat(halves)


def runs(documents: list[list[int]], least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """document, start, length and period of every run of at least ``least`` words and ``exponent`` (2 or more) periods, by document, start, period."""
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    if not int(sizes.sum()):
        return none, none, none, none
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    words = np.zeros(int((sizes + 1).sum()), dtype=np.int64)  # 0 ends a document
    for lo, d in zip(starts.tolist(), documents, strict=True):
        words[lo : lo + len(d)] = d
    doc = np.repeat(np.arange(len(sizes)), sizes + 1)
    suffixes = Suffixes(words, doc)
    at, k = covering_squares(suffixes, starts, ends, exponent)
    good = primitive(suffixes, at, k)
    low, high, half = vocabulary(suffixes, at[good], k[good])
    n = high - low + 1
    place, period = suffixes.order[np.repeat(low, n) + _ranges(n)].astype(np.int64), np.repeat(half, n)
    by = np.lexsort((place, period))
    place, period = place[by], period[by]
    if not len(place):
        return none, none, none, none
    fresh = np.ones(len(place), dtype=bool)
    fresh[1:] = (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(place)) - 1
    start, q = place[head], period[head]
    length = place[tail] + 2 * q - start
    long = length >= np.maximum(least, exponent * q)
    start, length, q = start[long], length[long], q[long]
    d = doc[start]
    by = np.lexsort((q, start))
    return d[by], (start - starts[d])[by], length[by], q[by]


def damaged(words: list, doc_id: str) -> list:
    """The words with the tail that the contract makes periodic, for one id in ten."""
    h, n = zlib.crc32(doc_id.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turn = words[a : a + p]
    return words[:a] + (turn * (-(-(n - a) // p)))[: n - a]


def _described(ids: list, texts: list[list[bytes]], found: tuple[np.ndarray, ...]) -> pd.DataFrame:
    by_doc: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for d, *run in zip(*(x.tolist() for x in found), strict=True):
        by_doc[d].append(tuple(run))
    rows = []
    for d, (i, words) in enumerate(zip(ids, texts, strict=True)):
        mine = by_doc.get(d, [])
        top = None
        kept = words
        if mine:
            for r in mine:  # ordered by start, then period: only a greater exponent replaces
                if top is None or r[1] * top[2] > top[1] * r[2]:
                    top = r
            drop = np.zeros(len(words) + 1, dtype=np.int64)
            for s, m, q in mine:
                drop[s + q] += 1
                drop[s + m] -= 1
            gone = np.cumsum(drop)[:-1] > 0
            kept = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
        said = "".join(f"{s},{m},{q}\n" for s, m, q in mine)
        rows.append((i, len(mine), *(top or (None, None, None)), top and 1000 * top[1] // top[2], hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), len(words) - len(kept)))
    out = pd.DataFrame(rows, columns=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_dropped"])
    return out.astype({c: "Int64" for c in ("n_runs", "start", "length", "period", "exponent_milli", "n_dropped")})


def _batches(frames: Iterator[pd.DataFrame], tail: bool) -> Iterator[tuple[list, list[list[bytes]]]]:
    for frame in frames:
        ids, texts, size = [], [], 0
        for i, key, t in zip(frame["doc_id"], frame["key"], frame["text"], strict=True):
            words = t.encode().split() if isinstance(t, str) else []
            words = damaged(words, key) if tail else words
            if texts and size + len(words) > WORDS_AT_ONCE:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(words)
            size += len(words)
        if ids:
            yield ids, texts


def numbered(texts: list[list[bytes]]) -> list[list[int]]:
    """Words as numbers from 1."""
    up = count(1)
    table: dict[bytes, int] = defaultdict(lambda: next(up))
    return [list(map(table.__getitem__, words)) for words in texts]


def periodic(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tail: bool = False, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> DataFrame:
    """Per document its runs: doc_id, n_runs, the greatest one (start, length, period, exponent_milli), digests of all runs and of the words that stay, n_dropped.

    A word goes if a run holds it after the run's first period. ``tail`` reads the texts with the contract's periodic tails.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in _batches(frames, tail):
            yield _described(ids, texts, runs(numbered(texts), least, exponent))

    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_dropped long")


def collapsed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> DataFrame:
    """doc_id, text: the words that stay, joined by blanks; a text without runs, or null, is as it was."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.lit("").alias("key"), F.col(text).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = list(frame["text"])
            at = 0
            for _, texts in _batches(iter([frame]), False):
                d, s, m, q = runs(numbered(texts), least, exponent)
                for x in np.unique(d).tolist():
                    drop = np.zeros(len(texts[x]), dtype=bool)
                    for a, b, c in zip(s[d == x].tolist(), m[d == x].tolist(), q[d == x].tolist(), strict=True):
                        drop[a + c : a + b] = True
                    out[at + x] = b" ".join(w for w, g in zip(texts[x], drop.tolist(), strict=True) if not g).decode()
                at += len(texts)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": out})

    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, text string")
