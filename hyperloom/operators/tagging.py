"""Tags of words by a hidden Markov model, and what comparisons liken things to, by tag.

Counts come from annotated sentences by grouping in Spark: words by tag, steps from tag to tag, and endings of
rare words by tag, which stand for words never seen (the chance of a tag given the ending is smoothed from the shorter
ending to the longer). What the driver fetches is bounded: ``MOST_TAGS`` tags (more raise an error), the ``MOST_WORDS`` most
frequent words and ``MOST_ENDINGS`` endings; a word beyond them is tagged by its ending. The sentences are read once for all counts.
Words whose tag no neighbour can change are tagged at once; Viterbi runs over all stretches of other words of a batch side by side,
a word a step. Python sees each different word of a batch once. Of equal paths the tag first by name is taken.

Sentences: words array, tags array of the same size. Null or empty arrays have no tags.
"""

from __future__ import annotations

import math
import re
from collections.abc import Collection, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_TAGS, MOST_WORDS, MOST_ENDINGS = 64, 200_000, 50_000
ENDING = 5
#: A word is rare, and says something about unknown ones, up to so many times.
RARE = 10
WORDS_AT_ONCE = 200_000
REMEMBER = 300_000


def sentences(chunks: DataFrame, key: str = "chunk_id", text: str = "text", holding: Collection[str] = ()) -> DataFrame:
    """key, sent, words: sentences end at a stop, a question or exclamation mark or a line break; signs are words.

    With ``holding``, only the sentences that hold one of these words (or signs).
    """
    rows = chunks.select(F.col(key), F.posexplode(F.split(text, r"(?<=[.!?。！？\n])")).alias("sent", "said")).where(F.col("said").rlike(r"\S"))
    if holding:
        rows = rows.where(F.col("said").rlike(_holds(holding)))
    return rows.select(key, "sent", F.regexp_extract_all("said", F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)).alias("words"))


def _holds(words: Collection[str]) -> str:
    """An expression for texts that hold one of the words, as ``sentences`` cuts them; found by the first letter, then by what lies around."""
    letters = "".join(sorted({re.escape(w[0]) for w in words}))
    return rf"(?=[{letters}])(?:{'|'.join(rf'(?<![\p{{L}}\p{{N}}_]){re.escape(w)}(?![\p{{L}}\p{{N}}_])' if w[0].isalnum() or w[0] == '_' else re.escape(w) for w in sorted(words))})"


class Tagger:
    def __init__(self, words: list[tuple[str, str, int]], steps: list[tuple[str | None, str, int]], endings: list[tuple[str, str, int]]):
        """words: word, tag, count; steps: tag before (null at the start), tag, count; endings: ending, tag, count."""
        self.tags = sorted({t for _, t, _ in words} | {t for _, t, _ in steps})
        at = {t: i for i, t in enumerate(self.tags)}
        n = len(self.tags)
        of_tag = np.zeros(n)
        table: dict[str, np.ndarray] = {}
        for w, t, c in words:
            table.setdefault(w, np.zeros(n))[at[t]] += c
            of_tag[at[t]] += c
        of_tag += 1e-9  # after the whole numbers, so that their order does not matter
        self.share = np.log(of_tag / of_tag.sum()) if n else np.zeros(0)
        with np.errstate(divide="ignore"):
            self.known = {w: np.maximum(np.log(v / of_tag), -60.0) for w, v in table.items()}
        moves, first = np.ones((n, n)) * 0.1, np.ones(n) * 0.1
        for a, b, c in steps:
            if a is None:
                first[at[b]] += c
            else:
                moves[at[a], at[b]] += c
        self.step = np.log(moves / moves.sum(1, keepdims=True))
        self.first = np.log(first / first.sum())
        self.endings: dict[str, np.ndarray] = {}
        for e, t, c in endings:
            self.endings.setdefault(e, np.zeros(n))[at[t]] += c
        self._reset()

    @classmethod
    def learned(cls, annotated: DataFrame) -> Tagger:
        """From sentences with words and tags."""
        # one pass over the sentences: each word with its tag and the tag before it
        before = F.concat(F.array(F.lit(None).cast("string")), "tags")
        zipped = F.arrays_zip(F.coalesce("words", F.array().cast("array<string>")).alias("word"), F.col("tags").alias("tag"), before.alias("before"))
        triples = annotated.select(F.explode(zipped).alias("p")).where("p.tag is not null").groupBy("p.word", "p.tag", "p.before").agg(F.count("*").alias("n"))
        uses = triples.groupBy("word").agg(F.collect_list(F.struct("tag", "before", "n")).alias("uses"), F.sum("n").alias("total")).persist()
        each = lambda df: df.select("word", F.inline("uses"))
        fetch = lambda df: [tuple(r) for r in df.collect()]  # noqa: E731 - bounded as said above
        try:
            steps = fetch(each(uses).groupBy("before", "tag").agg(F.sum("n").alias("n")).limit(MOST_TAGS * (MOST_TAGS + 1) + 1))
            if len({t for _, t, _ in steps}) > MOST_TAGS or len(steps) > MOST_TAGS * (MOST_TAGS + 1):
                raise ValueError(f"more than {MOST_TAGS} tags")
            known = uses.where("word is not null")
            words = each(known.orderBy(F.desc("total"), "word").limit(MOST_WORDS)).groupBy("word", "tag").agg(F.sum("n").alias("n"))
            sizes = F.explode(F.sequence(F.lit(0), F.least(F.lit(ENDING), F.length("word"))))
            rare = each(known.where(F.col("total") <= RARE)).select("word", "tag", "n", sizes.alias("k")).select(F.when(F.col("k") == 0, "").otherwise(F.right(F.lower("word"), F.col("k"))).alias("ending"), "tag", "n")
            endings = rare.groupBy("ending", "tag").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ending", "tag").limit(MOST_ENDINGS)
            return cls(fetch(words), steps, fetch(endings))
        finally:
            uses.unpersist()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.of_ending: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def emission(self, word: str) -> np.ndarray:
        """Log chance of a word given each tag; of unknown words up to a constant."""
        if (row := self.known.get(word)) is not None:
            return row
        return self._unknown(self._ending(word))

    def _ending(self, word: str) -> str:
        """The longest ending that was seen, as were all shorter ones."""
        low, k = word.lower(), 0
        while k < min(ENDING, len(low)) and low[len(low) - k - 1 :] in self.endings:
            k += 1
        return low[len(low) - k :]

    def _unknown(self, ending: str) -> np.ndarray:
        chance = np.exp(self.share)
        for k in range(len(ending) + 1):
            seen = self.endings.get(ending[len(ending) - k :])
            if seen is not None:
                weight = seen.sum() / (seen.sum() + 2.0)
                chance = weight * seen / seen.sum() + (1 - weight) * chance
        return np.maximum(np.log(np.maximum(chance, 1e-12)) - self.share, -60.0)

    def numbers(self, words: Sequence[str]) -> list[int]:
        out = []
        for w in words:
            i = self.index.get(w)
            if i is None:
                # unknown words of one ending share a row
                end = None if w in self.known else self._ending(w)
                i = None if end is None else self.of_ending.get(end)
                if i is None:
                    i = len(self.rows)
                    self.rows.append(self.known[w] if end is None else self._unknown(end))
                    if end is not None:
                        self.of_ending[end] = i
                self.index[w] = i
            out.append(i)
        return out

    def tag(self, said: Sequence[Sequence[str]]) -> list[list[str]]:
        """The best tags of each sentence."""
        return self.tag_lists(pa.array([list(s) for s in said], pa.list_(pa.string()))).to_pylist()

    def tag_lists(self, said: pa.ListArray) -> pa.ListArray:
        """The best tags of each sentence; none for null."""
        sizes = said.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        words = said.flatten().dictionary_encode("encode")
        out, lo = np.zeros(len(words), dtype=np.int32), 0
        if len(self.index) > REMEMBER:
            self._reset()
        if len(words):
            used, at = np.unique(self.numbers(words.dictionary.to_pylist()), return_inverse=True)
            table, flat = np.array([self.rows[i] for i in used.tolist()]), at[words.indices.to_numpy()]
        while lo < len(sizes) and len(words):
            start = ends[lo] - sizes[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, start + WORDS_AT_ONCE, side="right")))
            out[start : ends[hi - 1]] = self._best(table, flat[start : ends[hi - 1]], sizes[lo:hi])
            lo = hi
        names = pa.array(self.tags, pa.string()).take(pa.array(out))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), names)

    def _sure(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest tag of each row of emissions, and whether every best path takes it, whatever stands before and behind.

        That is so where it leads any other tag by more than the steps to it and from it can cost against the steps to and from the other.
        """
        gain = (self.step[:, None, :] - self.step[:, :, None]).max(0)  # [k, a]: the most that a step to a is likelier than one to k
        gain = np.maximum(gain, self.first[None, :] - self.first[:, None]) + (self.step[None] - self.step[:, None]).max(2)
        top = table.argmax(1)
        lead = table[np.arange(len(table)), top][:, None] - table - gain[top]
        lead[np.arange(len(table)), top] = np.inf
        return top, (lead > 1e-3).all(1)

    def _best(self, table: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The tags' numbers on the best paths of sentences that lie one behind the other; flat: a row of the table for each word.

        Words whose tag is sure cut the sentences; the rest are short stretches between them, whose paths are sought side by side.
        """
        top, sure = self._sure(table)
        out = top[flat]
        open_ = np.flatnonzero(~sure[flat])
        if not len(open_):
            return out
        begins, closes = np.zeros(len(flat), dtype=bool), np.zeros(len(flat), dtype=bool)
        ends = np.cumsum(sizes)[sizes > 0]
        begins[ends - sizes[sizes > 0]], closes[ends - 1] = True, True
        new = np.flatnonzero(np.concatenate([[True], np.diff(open_) != 1]) | begins[open_])
        starts, lengths = open_[new], np.diff(np.concatenate([new, [len(open_)]]))
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        last = starts + lengths - 1
        live = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left").tolist()
        by_tag, step, back = np.ascontiguousarray(table.T), self.step[:, :, None], self.step.T
        entry = np.where(begins[starts], self.first[:, None], back[:, out[starts - 1]])
        scores = [entry + by_tag[:, flat[starts]]]
        for t in range(1, len(live)):
            m = live[t]
            scores.append((scores[-1][:, None, :m] + step).max(0) + by_tag[:, flat[starts[:m] + t]])
        # a tag before is sought on the best path alone, from the sure tag behind the stretch or the end of the sentence
        follows = np.where(closes[last][:, None], 0.0, back[out[np.minimum(last + 1, len(out) - 1)]])
        best = np.zeros(len(starts), dtype=np.int64)
        for t in range(len(live) - 1, -1, -1):
            m, more = live[t], live[t + 1] if t + 1 < len(live) else 0
            best[:more] = (scores[t][:, :more].T + back[best[:more]]).argmax(1)
            best[more:m] = (scores[t][:, more:].T + follows[more:m]).argmax(1)
            out[starts[:m] + t] = best[:m]
        return out


def tagged(said: DataFrame, tagger: Tagger) -> DataFrame:
    """The rows with tags, an array as long as words. Only the words go to Python."""
    held = said.sparkSession.sparkContext.broadcast(tagger)  # bounded as Tagger.learned says

    @F.arrow_udf("array<string>")
    def tags(words: pa.Array) -> pa.Array:
        return held.value.tag_lists(words)

    return said.withColumn("tags", tags("words"))


@dataclass(frozen=True)
class Cues:
    """What a comparison is known by. ``links`` are particles after which a noun counts more (the tree *of* life)."""

    markers: frozenset[str]
    links: frozenset[str] = frozenset()
    idle: frozenset[str] = frozenset()
    particle: tuple[str, ...] = ("u",)
    function: tuple[str, ...] = ("r", "m", "q", "u", "p", "c", "e", "y")
    noun: tuple[str, ...] = ("n", "i", "l")
    proper: tuple[str, ...] = ("nr", "ns", "nt", "nz")
    window: int = 6
    least: int = 2
    before: tuple[str, ...] = field(default=())


def vehicles(words: Sequence[str], tags: Sequence[str], cues: Cues) -> list[tuple[int, int]]:
    """Marker and vehicle, as places of words, for each marker that has one.

    Behind a marker particles and function words are passed over; nouns are candidates; anything else, a sign or the next marker ends the search.
    The last noun that follows a linking particle is the vehicle, else the first noun.
    """
    out = []
    for at, word in enumerate(words):
        if word not in cues.markers:
            continue
        plain: int | None = None
        linked: int | None = None
        link = False
        for j in range(at + 1, min(at + 1 + cues.window, len(words))):
            w, t = words[j], tags[j]
            if w in cues.markers or not any(c.isalnum() for c in w):
                break
            if w in cues.links or w in cues.idle or t.startswith(cues.particle):
                link = link or w in cues.links or t.startswith(cues.particle)
            elif t.startswith(cues.noun) and len(w) >= cues.least and not t.startswith(cues.function):
                if link:
                    linked = j
                elif plain is None:
                    plain = j
                link = False
            elif not t.startswith(cues.function):
                break
        found = plain if linked is None else linked
        if found is not None:
            out.append((at, found))
    return out


def pattern(words: Sequence[str], tags: Sequence[str], cues: Cues) -> str | None:
    """A comparison's marker with its vehicle as one string: markers that follow their vehicle first, then the longest that precedes one.

    A vehicle is up to two nouns right before its marker, or up to three in a row after it, function words at the front passed over.
    """
    noun = [t.startswith(cues.noun) for t in tags]
    for m in cues.before:
        if m in words:
            at = lo = list(words).index(m)
            while lo and noun[lo - 1] and at - lo < 2:
                lo -= 1
            if lo < at:
                return " ".join([*words[lo:at], m])
    for m in sorted(cues.markers, key=lambda m: (-len(m), m)):
        if m in words:
            lo = list(words).index(m) + 1
            at = lo
            while lo < len(words) and (words[lo] in cues.idle or words[lo] in cues.links or tags[lo].startswith(cues.function)) and not noun[lo]:
                lo += 1
            hi = lo
            while hi < len(words) and noun[hi] and hi - lo < 3:
                hi += 1
            if hi > lo and at:
                return " ".join([m, *words[lo:hi]])
    return None


def compared(said: DataFrame, cues: Cues, key: str = "chunk_id") -> DataFrame:
    """key, sent, marker, vehicle, flag (the vehicle's tag) of tagged sentences."""
    kind = said.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(k, s, w[m], w[v], t[v]) for k, s, w, t in zip(frame[key], frame["sent"], frame["words"], frame["tags"], strict=True) for m, v in vehicles(w, t, cues)]
            yield pd.DataFrame(out, columns=[key, "sent", "marker", "vehicle", "flag"])

    return said.select(key, "sent", "words", "tags").mapInPandas(run, f"{key} {kind}, sent int, marker string, vehicle string, flag string")


def patterns(said: DataFrame, cues: Cues, key: str = "chunk_id") -> DataFrame:
    """key, sent, pattern of the tagged sentences that have one."""
    kind = said.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(k, s, pattern(w, t, cues)) for k, s, w, t in zip(frame[key], frame["sent"], frame["words"], frame["tags"], strict=True)]
            yield pd.DataFrame([f for f in found if f[2]], columns=[key, "sent", "pattern"])

    return said.select(key, "sent", "words", "tags").mapInPandas(run, f"{key} {kind}, sent int, pattern string")


PENDING = "(pending)"


def candidates(found: DataFrame, frames: DataFrame, fields: DataFrame, bridges: DataFrame, literal: DataFrame, plain_words: list[str], cues: Cues, generic: bool = False, confidence: float = 0.5) -> DataFrame:
    """Vehicles as discoveries for the open channel: chunk_id, source_domain, target_domain, ground, triggers, confidence.

    A vehicle belongs to the first frame that has it as trigger or ground, else to the frame its field bridges to. One that no frame takes is
    left out, or, with ``generic``, is a source of its own unless it is a name. Words of everyday use (``plain_words``) count only in a frame
    of triggers or grounds or by their field. ``literal``: chunk_id, field of which a chunk has so much that its words are meant literally.
    """
    terms = frames.select("ord", "frame_id", F.explode(F.array_union("triggers", "ground")).alias("vehicle"))
    owner = terms.groupBy("vehicle").agg(F.min_by("frame_id", F.struct("ord", "frame_id")).alias("own_frame"))
    across = fields.join(bridges, "field").groupBy(F.col("word").alias("vehicle")).agg(F.min("field").alias("field"), F.min_by(F.col("frame_id"), "field").alias("field_frame"))
    rows = found.select("chunk_id", "vehicle", "flag").distinct().join(owner, "vehicle", "left").join(across, "vehicle", "left")
    rows = rows.join(literal.select("chunk_id", "field", F.lit(True).alias("meant")), ["chunk_id", "field"], "left").where("meant is null")
    f = frames.select(F.col("frame_id").alias("f"), "source_domain", "target_domain", "ground")
    rows = rows.withColumn("f", F.coalesce("own_frame", "field_frame")).join(f, "f", "left")
    bound: Column = F.col("source_domain").isNotNull()
    name = F.lit(False)
    for p in cues.proper:
        name = name | F.col("flag").startswith(p)
    keep = bound | (F.lit(generic) & ~name & ~F.col("vehicle").isin(plain_words or [""]))
    none = F.array().cast("array<string>")
    return rows.where(keep).select(
        "chunk_id", F.coalesce("source_domain", "vehicle").alias("source_domain"), F.coalesce("target_domain", F.lit(PENDING)).alias("target_domain"),
        F.coalesce("ground", none).alias("ground"), F.array("vehicle").alias("triggers"), F.lit(confidence).alias("confidence"),
    )


def literal_fields(words: DataFrame, least: int = 2) -> DataFrame:
    """chunk_id, field: the field that dominates a chunk with at least ``least`` words (words: chunk_id, pos, field)."""
    from .build import dominant_fields

    counts = words.groupBy("chunk_id", "field").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.join(dominant_fields(words), "chunk_id").where(F.col("field") == F.col("dominant")).select("chunk_id", "field")


def log_chance(tagger: Tagger, words: Sequence[str], tags: Sequence[str]) -> float:
    """Of a sentence with given tags."""
    at = [tagger.tags.index(t) for t in tags]
    total = sum(tagger.emission(w)[t] for w, t in zip(words, at, strict=True))
    return (tagger.first[at[0]] if at else 0.0) + total + math.fsum(tagger.step[a, b] for a, b in zip(at[:-1], at[1:], strict=True))
