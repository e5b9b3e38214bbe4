"""Removal of repeated strings by suffix sorting: a shallow multikey quicksort, then blind tries.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts somewhere else.
Such a string is a suffix of its document cut to ``LENGTH``; two are equal if and only if
they are neighbours with a common prefix that long in the sorted order of all suffixes.

Sorting all suffixes of a corpus at once would move ``LENGTH`` times the corpus, so the
sort is dealt by content. In every window of ``LENGTH`` bytes the smallest hash of its
strings of ``GRAM`` bytes is the window's anchor, so equal windows have equal anchors, and
the windows of one anchor form one stretch of text (some 2% of positions are anchors).
Equal stretches need no sorting: their windows repeat. Of the rest, only stretches that
share an anchor with another can hold repeated windows. Those are cut in two by what
their windows have in common beside the anchor, dealt by that content, and sorted.

Each group's suffixes are split by their next eight bytes, over and over, down to
``SHALLOW`` bytes (multikey quicksort on wide characters, all groups of a task at once);
what still agrees is ordered by a blind trie, which descends on branching bytes alone
and compares each new suffix with one leaf.

A task folds equal stretches before they are dealt, so a passage in a third of all
documents is one row per task. A content group of more than ``MANY`` stretches, which
share long strings but not whole windows, is dealt once more, window by window.

Null text is empty. Documents are told apart by id and text; wholly repeated rows are
documents of their own, whose strings therefore repeat. Null ids are allowed. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounds_of, landed, runs_of, ship

LENGTH = 200
GRAM = 100
SHALLOW = 32
MANY = 20_000
#: Bytes of stretches sorted at once.
BUFFER = 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on, by doubling."""
    unit = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    unit ^= unit >> np.uint64(32)
    out, size, power = unit, 1, int(_ODD)
    for bit in f"{k:b}"[1:]:
        out = out[: len(out) - size] * np.uint64(power) + out[size:]
        size, power = size * 2, power * power % 2**64
        if bit == "1":
            out = out[:-1] * _ODD + unit[size : size + len(out) - 1]
            size, power = size + 1, power * int(_ODD) % 2**64
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[: len(x) - size], x[size:]), size * 2
    more = width - size
    return np.minimum(x[: len(x) - more], x[more:]) if more else x


def stretches(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window start of each maximal run of windows with one anchor.

    A window's anchor is the leftmost of its smallest hashes, so it moves on behind each
    window that begins with its own; equal windows have it at the same distance.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(raw) < length:
        return none.astype(np.uint64), none, none
    h = gram_hashes(np.frombuffer(raw, dtype=np.uint8), gram)
    low = sliding_min(h, length - gram + 1)
    moves = (low[1:] != low[:-1]) | (h[: len(low) - 1] == low[:-1])
    first = np.concatenate([[0], np.flatnonzero(moves) + 1])
    last = np.concatenate([first[1:] - 1, [len(low) - 1]])
    return low[first], first, last


def merged_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, sorted; touching spans become one."""
    order = np.argsort(start, kind="stable")
    start, top = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > top[:-1]])
    at = np.flatnonzero(new)
    return start[at], top[np.concatenate([at[1:] - 1, [len(top) - 1]])]


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings of equal length."""
    if a == b:
        return len(a)
    return len(a) - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


class BlindTrie:
    """Orders suffixes that share a long prefix. A node keeps the depth it branches at; its edges, one byte each."""

    def __init__(self, buffer: bytes, length: int):
        self.buffer, self.length = buffer, length
        self.root: list | None = None

    def add(self, at: int) -> None:
        mine = self.buffer[at : at + self.length]
        if self.root is None:
            self.root = [self.length, [at]]
            return
        node = self.root
        while node[0] < self.length:  # blind: only branching bytes are looked at
            edges = node[1]
            node = edges.get(mine[node[0]]) or next(iter(edges.values()))
        other = self.buffer[node[1][0] : node[1][0] + self.length]
        depth = common(mine, other)
        if depth == self.length:
            node[1].append(at)
            return
        parent, node = None, self.root
        while node[0] < depth:
            parent, node = node, node[1][mine[node[0]]]
        leaf = [self.length, [at]]
        if node[0] == depth:
            node[1][mine[depth]] = leaf
            return
        split = [depth, {mine[depth]: leaf, other[depth]: node}]
        if parent is None:
            self.root = split
        else:
            parent[1][mine[parent[0]]] = split

    def ordered(self) -> Iterator[tuple[int, int]]:
        """Suffixes in order, each with the length it shares with the one before."""
        todo = [(self.root, 0)]
        while todo:
            node, shared = todo.pop()
            if node[0] == self.length:
                for n, at in enumerate(node[1]):
                    yield at, self.length if n else shared
            else:
                kids = sorted(node[1].items())
                todo += [(kid, node[0] if n else shared) for n, (_, kid) in reversed(list(enumerate(kids)))]


def deep_shallow(buffer: bytes, at: np.ndarray, group: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes cut to ``length`` in order within their groups, and what each shares with the one before in its group.

    Shared lengths below ``shallow`` are rounded down to eights: only the deep part needs them exactly.
    """
    data = np.frombuffer(buffer, dtype=np.uint8)
    order = np.lexsort((at, group))
    at, run = at[order], group[order]
    lcp = np.zeros(len(at), dtype=np.int64)
    run = np.cumsum(np.concatenate([[0], run[1:] != run[:-1]]))
    where = np.arange(len(at))  # places of the suffixes that are not settled yet
    for depth in range(0, min(shallow, length), 8):
        if not len(where):
            break
        word = np.ascontiguousarray(data[at[where][:, None] + np.arange(depth, depth + 8)]).view(">u8").ravel()
        order = np.lexsort((word, run))
        at[where], word = at[where][order], word[order]
        same = np.concatenate([[False], run[1:] == run[:-1]])
        equal = same & np.concatenate([[False], word[1:] == word[:-1]])
        lcp[where[same & ~equal]] = depth
        run = np.cumsum(~equal)
        open_ = equal | np.concatenate([equal[1:], [False]])
        where, run = where[open_], run[open_]
    if len(where):
        cuts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])).tolist() + [len(where)]
        places = at[where].tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            lo = where[a]
            if b - a == 2:
                p, q = places[a], places[a + 1]
                x, y = buffer[p : p + length], buffer[q : q + length]
                at[lo], at[lo + 1] = (p, q) if x <= y else (q, p)
                lcp[lo + 1] = common(x, y)
                continue
            trie = BlindTrie(buffer, length)
            for p in places[a:b]:
                trie.add(p)
            for n, (p, shared) in enumerate(trie.ordered()):
                at[lo + n] = p
                if n:
                    lcp[lo + n] = shared
    return at, lcp


def repeated(buffer: bytes, at: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The suffixes whose first ``length`` bytes another one of the group has too."""
    at, lcp = deep_shallow(buffer, at, group, length)
    same = lcp >= length
    return at[same | np.concatenate([same[1:], [False]])]


def text_key(doc_id: Column, text: Column) -> list[Column]:
    return [F.coalesce(doc_id.cast("long"), F.lit(0)).alias("k1"), F.xxhash64(doc_id.isNull(), text).alias("k2")]


ANCHORS = "anchor long, stretch long, k1 long, k2 long, place long, n int"


def anchored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches of each document, equal ones of a batch folded (n = 2); what folding shows to repeat goes along as spans (n = 0)."""
    import xxhash

    for frame in frames:
        anchor, stretch, doc, first, last = [], [], [], [], []
        for d, raw in enumerate(frame["raw"]):
            a, s, e = stretches(raw)
            if len(a):
                anchor.append(a)
                stretch.append(np.array([xxhash.xxh3_64_intdigest(raw[x : y + LENGTH]) for x, y in zip(s.tolist(), e.tolist(), strict=True)], dtype=np.uint64))
                doc.append(np.full(len(a), d))
                first.append(s)
                last.append(e)
        if not anchor:
            continue
        anchor, stretch, doc, first, last = map(np.concatenate, (anchor, stretch, doc, first, last))
        order = np.lexsort((stretch, anchor))
        new = np.concatenate([[True], (anchor[order][1:] != anchor[order][:-1]) | (stretch[order][1:] != stretch[order][:-1])])
        size = np.diff(np.concatenate([np.flatnonzero(new), [len(order)]]))
        one = order[new]
        twice = np.zeros(len(order), dtype=bool)
        twice[order] = np.repeat(size > 1, size)
        k1, k2 = frame["k1"].to_numpy(), frame["k2"].to_numpy()
        yield pd.DataFrame({"anchor": anchor[one].view(np.int64), "stretch": stretch[one].view(np.int64), "k1": k1[doc[one]], "k2": k2[doc[one]], "place": first[one] * 1024 + (last[one] - first[one]), "n": np.minimum(size, 2)})
        if twice.any():
            own, s, e = doc[twice], first[twice], last[twice] + LENGTH
            shift = own * 2**33
            s, e = merged_spans(s + shift, e + shift)
            own = s >> 33
            yield pd.DataFrame({"anchor": k2[own] ^ s, "stretch": 0, "k1": k1[own], "k2": k2[own], "place": (s - (own << 33) << 32) + (e - (own << 33)), "n": 0})


FOUND = "kind int, k1 long, k2 long, a long, b long, anchor long, alone boolean"


def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans of stretches that repeat (kind 0: from a to b); stretches to be sorted (kind 1: windows a to b)."""
    for frame in runs_of(frames, ["anchor"]):
        known = frame["n"].to_numpy() == 0
        place, k1, k2 = frame["place"].to_numpy(), frame["k1"].to_numpy(), frame["k2"].to_numpy()
        if known.any():
            p = place[known]
            yield pd.DataFrame({"kind": 0, "k1": k1[known], "k2": k2[known], "a": p >> 32, "b": p & 0xFFFFFFFF, "anchor": 0, "alone": False})
        frame, place, k1, k2 = frame[~known], place[~known], k1[~known], k2[~known]
        if not len(frame):
            continue
        anchor, stretch, n = (frame[c].to_numpy() for c in ("anchor", "stretch", "n"))
        new_a = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new_s = new_a | np.concatenate([[True], stretch[1:] != stretch[:-1]])
        at = np.flatnonzero(new_s)
        total = np.add.reduceat(n, at)
        first, last = place >> 10, (place >> 10) + (place & 1023)
        twice = np.repeat(total > 1, np.diff(np.concatenate([at, [len(n)]]))) & (n == 1)
        yield pd.DataFrame({"kind": 0, "k1": k1[twice], "k2": k2[twice], "a": first[twice], "b": last[twice] + LENGTH, "anchor": 0, "alone": False})
        group = np.cumsum(new_a)[at] - 1
        kinds, alone = np.bincount(group), np.bincount(group, weights=total == 1)
        sort = (kinds[group] > 1) & (alone[group] > 0)
        pick = at[sort]
        yield pd.DataFrame({"kind": 1, "k1": k1[pick], "k2": k2[pick], "a": first[pick], "b": last[pick], "anchor": anchor[pick], "alone": (total == 1)[sort]})


PARTS = "content long, k1 long, k2 long, a long, alone boolean, raw binary"


def parted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each stretch in two: windows that begin in the half before the anchor and those after, dealt by what all of a half share."""
    import xxhash

    half = (LENGTH - GRAM) // 2
    for frame in frames:
        out = []
        for raw, k1, k2, todo in zip(frame["raw"], frame["k1"], frame["k2"], frame["todo"], strict=True):
            for t in todo:
                a, b, anchor = t["a"], t["b"], t["anchor"]
                part = raw[a : b + LENGTH]
                # the anchor lies in all windows: at or after the last start, and ends where the first window does at the latest
                h = gram_hashes(np.frombuffer(part, dtype=np.uint8), GRAM).view(np.int64)
                for spot in np.flatnonzero(h[b - a : LENGTH - GRAM + 1] == anchor)[:1].tolist():
                    spot += b - a  # of the anchor, within the stretch
                    left = min(b - a, max(-1, spot - half))  # windows that begin at least half a margin before it
                    if left >= 0:
                        out.append((xxhash.xxh3_64_intdigest(part[spot - half : spot + GRAM]) ^ 1, k1, k2, a, t["alone"], part[: left + LENGTH]))
                    if left < b - a:
                        right = left + 1
                        out.append((xxhash.xxh3_64_intdigest(part[spot : spot + GRAM + half]), k1, k2, a + right, t["alone"], part[right:]))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        content = np.array(cols[0], dtype=np.uint64).view(np.int64)
        yield pd.DataFrame({"content": content, "k1": np.array(cols[1], dtype=np.int64), "k2": np.array(cols[2], dtype=np.int64), "a": np.array(cols[3], dtype=np.int64), "alone": np.array(cols[4], dtype=bool), "raw": list(cols[5])})


SPANS = "k1 long, k2 long, a long, b long"


def sorted_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans of the windows that repeat within a content group, by suffix sorting."""
    for frame in runs_of(frames, ["content"]):
        size = frame["raw"].str.len().to_numpy()
        whole = np.cumsum(size)
        lo = 0
        for _, hi in bounds_of(frame, ["content"]):
            if hi < len(frame) and whole[hi - 1] - (whole[lo - 1] if lo else 0) < BUFFER:
                continue
            yield spans_of(frame.iloc[lo:hi])
            lo = hi


def spans_of(part: pd.DataFrame) -> pd.DataFrame:
    raws = part["raw"].tolist()
    size = np.array([len(r) for r in raws])
    start = np.cumsum(size) - size
    windows = size - LENGTH + 1
    owner = np.repeat(np.arange(len(raws)), windows)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + start[owner]
    content = part["content"].to_numpy()
    group = np.cumsum(np.concatenate([[0], content[1:] != content[:-1]]))[owner]
    hit = np.sort(repeated(b"".join(raws), at, group))
    own = np.searchsorted(start, hit, side="right") - 1
    alone = part["alone"].to_numpy()[own]
    hit, own = hit[alone], own[alone]
    if not len(hit):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("k1", "k2", "a", "b")})
    gap = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(own) > 0)])
    first, last = hit[gap], hit[np.concatenate([np.flatnonzero(gap)[1:] - 1, [len(hit) - 1]])]
    own = own[gap]
    base = part["a"].to_numpy()[own] - start[own]
    return pd.DataFrame({"k1": part["k1"].to_numpy()[own], "k2": part["k2"].to_numpy()[own], "a": first + base, "b": last + base + LENGTH})


def single_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    for frame in frames:
        out = [(xxhash.xxh3_64_intdigest(r[i : i + LENGTH]), k1, k2, a + i, alone, r[i : i + LENGTH]) for r, k1, k2, a, alone in zip(frame["raw"], frame["k1"], frame["k2"], frame["a"], frame["alone"], strict=True) for i in range(len(r) - LENGTH + 1)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        yield pd.DataFrame({"content": np.array(cols[0], dtype=np.uint64).view(np.int64), "k1": np.array(cols[1], dtype=np.int64), "k2": np.array(cols[2], dtype=np.int64), "a": np.array(cols[3], dtype=np.int64), "alone": np.array(cols[4], dtype=bool), "raw": list(cols[5])})


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """k1, k2 (see ``text_key``), a, b: byte spans, possibly overlapping, that repeated strings cover."""
    ship(docs.sparkSession)
    raw = docs.select(*text_key(F.col(doc_id), F.col(text)), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw")).where(F.octet_length("raw") >= LENGTH)
    dealt = raw.mapInPandas(anchored, ANCHORS).repartition("anchor").sortWithinPartitions("anchor", "stretch", "n")
    found = landed(dealt.mapInPandas(compared, FOUND), "stretches")
    todo = found.where("kind = 1").groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b", "anchor", "alone")).alias("todo"))
    parts = raw.join(todo, ["k1", "k2"]).select("raw", "k1", "k2", "todo").mapInPandas(parted, PARTS)
    parts = landed(parts, "parts")
    sizes = parts.groupBy("content").agg(F.count("*").alias("m"), F.max("alone").alias("lone")).where("m > 1 and lone").select("content", "m")
    parts = parts.join(sizes, "content")
    by_content = lambda df: df.repartition("content").sortWithinPartitions("content", "k1", "k2", "a").select(*[c.split()[0] for c in PARTS.split(", ")]).mapInPandas(sorted_parts, SPANS)
    out = by_content(parts.where(f"m <= {MANY}"))
    huge = parts.where(f"m > {MANY}")
    if not huge.isEmpty():
        each = huge.select(*[c.split()[0] for c in PARTS.split(", ")]).mapInPandas(single_windows, PARTS)
        equal = each.groupBy("content", "raw").agg(F.count("*").alias("m")).where("m > 1")
        out = out.union(each.join(equal, ["content", "raw"]).where("alone").select("k1", "k2", "a", (F.col("a") + LENGTH).alias("b")))
    return found.where("kind = 0").select("k1", "k2", "a", "b").union(out)


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that remain)."""
    found = spans(docs, doc_id, text).groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), *text_key(F.col(doc_id), F.col(text)), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    rows = rows.join(found, ["k1", "k2"], "left").select("doc_id", "raw", "spans")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for raw, own in zip(frame["raw"], frame["spans"], strict=True):
                gone, n, kept = 0, 0, raw
                if own is not None and len(own):
                    a, b = merged_spans(np.array([x["a"] for x in own]), np.array([x["b"] for x in own]))
                    gone, n = int((b - a).sum()), len(a)
                    kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
                out.append((len(raw), gone, n, hashlib.sha256(kept).hexdigest(), kept))
            cols = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            cols.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield cols

    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
