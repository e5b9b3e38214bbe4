"""Language ID by a linear-chain conditional random field over the words of a text.

Every word is labelled with a language. Its score for a language is the sum of the
weights of its features (prefixes, suffixes, letter n-grams, and membership in each
language's lexicon of frequent words); a learned matrix scores the step from one
word's language to the next. Forward-backward gives each word's distribution over
languages in the light of the whole text, so a text that switches languages is
followed word by word. A document's language is the one with the most words, by sum
of those distributions, and its score is their mean.

Training: a bounded sample of labelled documents, at most ``per_language`` of each language
(the smallest hashes of id and text), spliced into sequences of one to three stretches, so
that switches are seen and the transitions are learned; gradient steps on the
conditional likelihood. The model is as large as the sample allows and does not grow
with the corpus; prediction reads every whole text.

Texts that are null or without letters (numerals such as fractions, circled and Roman
numbers are none) are ``und`` with score 0, as is everything if nothing could be learned.
Null ids and repeated rows each give a row; an empty table gives an empty result; columns
that are not named are ignored. Of languages with equal sums the first by name is taken.
A text is read whole, however long, in chains of ``CHAIN`` words at most: a longer text is
several chains, whose words count alike, so no task works through it word by word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fold, letter_words, ship, windows

PER_LANGUAGE = 300
LEXICON = 400
WORDS_AT_ONCE = 400_000
REMEMBER = 400_000
CHAIN = 2_000
LANGUAGES = 64
#: Stretches of ``STRETCH`` words a sampled text gives at most, evenly spaced: with ``LANGUAGES`` and ``per_language`` the bound of what goes to the driver.
STRETCHES, STRETCH = 200, 25


def features(word: str) -> list[str]:
    """Pairs and triples of letters, those at the ends marked as affixes, and the affixes of three letters."""
    w = f"^{word}$"
    n = len(w)
    return [w[i : i + 2] for i in range(n - 1)] + [w[i : i + 3] for i in range(n - 2)] + [w[:4], w[-4:]]


class Chain:
    """Batched forward-backward. Positions are stored time-major over sequences sorted by length, so every step is one slice."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        sizes = lengths[self.order]
        steps = int(sizes[0]) if len(sizes) else 0
        self.live = np.searchsorted(-sizes, -np.arange(steps), side="left")  # sequences longer than t
        self.at = np.concatenate([[0], np.cumsum(self.live)])
        rank = np.empty(len(lengths), dtype=np.int64)
        rank[self.order] = np.arange(len(lengths))
        starts = np.cumsum(lengths) - lengths
        t = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
        self.seq = np.repeat(rank, lengths)
        self.place = self.at[t] + self.seq  # of each position in reading order

    def forward_backward(self, emit: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """emit: exponentiated scores in reading order. Posteriors in reading order, and expected transitions."""
        x = np.empty_like(emit)
        x[self.place] = emit
        a, live, at = np.empty_like(x), self.live, self.at
        for t, m in enumerate(live):
            cur = x[at[t] : at[t] + m] if t == 0 else (a[at[t - 1] : at[t - 1] + m] @ step) * x[at[t] : at[t] + m]
            a[at[t] : at[t] + m] = cur / cur.sum(1, keepdims=True)
        moves = np.zeros_like(step)
        post = np.empty_like(x)
        back = None
        for t in range(len(live) - 1, -1, -1):
            m = live[t]
            own = a[at[t] : at[t] + m]
            b = np.ones_like(own)
            if t + 1 < len(live):
                k = live[t + 1]
                ahead = x[at[t + 1] : at[t + 1] + k] * back
                joint = own[:k].T[:, None, :] * step[:, :, None] * ahead.T[None, :, :]
                if self.count_moves:
                    moves += (joint / joint.sum((0, 1))).sum(2)
                b[:k] = ahead @ step.T
                b[:k] /= b[:k].sum(1, keepdims=True)
            p = own * b
            post[at[t] : at[t] + m] = p / p.sum(1, keepdims=True)
            back = b
        return post[self.place], moves

    count_moves = False


def train(texts: list[str], langs: list[str], seed: int = 7, sequences: int = 4000, epochs: int = 6) -> dict | None:
    """Weights of features and transitions from labelled texts."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    words = [[letter_words(t.lower()), names.index(g)] for t, g in zip(texts, langs, strict=True)]
    pools: list[list[list[str]]] = [[] for _ in names]
    for ws, g in words:
        pools[g] += [ws[i : i + STRETCH] for i in range(0, len(ws), STRETCH)]
    tongues = [g for g in range(len(names)) if pools[g]]
    if not tongues:
        return None
    counts = [Counter(w for ws, g in words if g == k for w in ws) for k in range(len(names))]
    lexicons = [{w for w, _ in c.most_common(LEXICON)} for c in counts]
    seqs, gold = [], []
    for _ in range(sequences):
        seq, lab = [], []
        for _ in range(rng.integers(1, 4)):
            g = tongues[rng.integers(len(tongues))]
            part = pools[g][rng.integers(len(pools[g]))]
            part = part[: rng.integers(1, len(part) + 1)]
            seq += part
            lab += [g] * len(part)
        seqs.append(seq)
        gold.append(lab)

    def described(w: str) -> list[str]:
        return features(w) + [f"l{g}" for g, lex in enumerate(lexicons) if w in lex]

    vocab = {w: i for i, w in enumerate(dict.fromkeys(w for s in seqs for w in s))}
    ids: dict[str, int] = {}
    of_word = [np.array([ids.setdefault(f, len(ids)) for f in described(w)]) for w in vocab]
    n, s = len(ids), len(names)
    weight, step = np.zeros((n, s)), np.zeros((s, s))
    seen_w, seen_s = np.full((n, s), 1e-2), np.full((s, s), 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(seqs))
        for lo in range(0, len(order), 200):
            part = order[lo : lo + 200]
            lengths = np.array([len(seqs[i]) for i in part])
            use = np.array([vocab[w] for i in part for w in seqs[i]])
            types, which = np.unique(use, return_inverse=True)
            feats = [of_word[t] for t in types]
            flat = np.concatenate(feats)
            sizes = np.array([len(f) for f in feats])
            scores = np.add.reduceat(weight[flat], np.cumsum(sizes) - sizes)[which]
            emit = np.exp(scores - scores.max(1, keepdims=True)) + 1e-30
            chain = Chain(lengths)
            chain.count_moves = True
            post, moves = chain.forward_backward(emit, np.exp(step))
            lab = np.concatenate([gold[i] for i in part])
            grad = -post
            grad[np.arange(len(lab)), lab] += 1
            by_type = np.zeros((len(types), s))
            np.add.at(by_type, which, grad)
            g_w = np.zeros((n, s))
            np.add.at(g_w, flat, np.repeat(by_type, sizes, axis=0))
            g_w = g_w / len(part) - 1e-4 * weight
            seen = np.zeros((s, s))
            inner = np.ones(len(lab), dtype=bool)
            inner[np.cumsum(lengths) - lengths] = False
            np.add.at(seen, (lab[np.flatnonzero(inner) - 1], lab[inner]), 1)
            g_s = (seen - moves) / len(part) - 1e-3 * step
            seen_w += g_w**2
            seen_s += g_s**2
            weight += 0.3 * g_w / np.sqrt(seen_w)
            step += 0.3 * g_s / np.sqrt(seen_s)
    strong = np.abs(weight).max(1) > 1e-3
    kept = {f: i for f, i in ids.items() if strong[i]}
    return {"langs": names, "features": {f: k for k, f in enumerate(kept)}, "weights": weight[list(kept.values())], "step": step, "lexicons": lexicons}


class Labeller:
    def __init__(self, model: dict):
        self.model, self.s = model, len(model["langs"])
        self.step = np.exp(model["step"])
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, self.s))

    def add(self, fresh: list[str]) -> None:
        """Emission rows of words not seen before."""
        get, lexicons = self.model["features"].get, list(enumerate(self.model["lexicons"]))
        flat: list[int] = []
        starts = []
        for word in fresh:
            starts.append(len(flat))
            flat += [k for f in features(word) if (k := get(f)) is not None]
            for g, lex in lexicons:
                if word in lex and (k := get(f"l{g}")) is not None:
                    flat.append(k)
        sums = np.vstack([np.zeros((1, self.s)), np.cumsum(self.model["weights"][flat], axis=0)])
        total = sums[np.array([*starts[1:], len(flat)])] - sums[starts]
        rows = np.exp(np.maximum(total - total.max(1, keepdims=True), -60.0))
        self.table = np.vstack([self.table, rows])

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Indices of all words in reading order, and the number of words per text."""
        if len(self.index) > REMEMBER:
            self.reset()
        index, flat, lengths, fresh = self.index, [], [], []
        for t in texts:
            before = len(flat)
            for part in windows(t.lower()) if t else ():
                for w in letter_words(part):
                    i = index.get(w)
                    if i is None:
                        i = index[w] = len(index)
                        fresh.append(w)
                    flat.append(i)
            lengths.append(len(flat) - before)
        if fresh:
            self.add(fresh)
        return np.array(flat, dtype=np.int64), np.array(lengths, dtype=np.int64)

    def posteriors(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each word's distribution, texts cut into chains of ``CHAIN`` words."""
        n = -(-lengths // CHAIN)
        size = np.full(int(n.sum()), CHAIN, dtype=np.int64)
        some = lengths > 0
        size[np.cumsum(n)[some] - 1] = (lengths - (n - 1) * CHAIN)[some]
        return Chain(size).forward_backward(self.table[flat], self.step)[0]

    def label(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Per text, in order: the words' distributions."""
        flat, lengths = self.words(texts)
        post = self.posteriors(flat, lengths)
        bounds = np.cumsum(lengths) - lengths
        yield from (post[b : b + m] for b, m in zip(bounds, lengths, strict=True))

    def documents(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        flat, lengths = self.words(texts)
        sums = np.zeros((len(texts), self.s))
        if len(flat):
            post = self.posteriors(flat, lengths)
            some = np.flatnonzero(lengths)
            sums[some] = np.add.reduceat(post, (np.cumsum(lengths) - lengths)[some])
        best = sums.argmax(1)
        mean = sums[np.arange(len(texts)), best] / np.maximum(lengths, 1)
        names = self.model["langs"]
        return [names[b] if m else "und" for b, m in zip(best, lengths, strict=True)], np.clip(mean, 0.0, 1.0).tolist()


def evenly(text: str) -> str:
    """The words of at most ``STRETCHES`` stretches of a text."""
    ws = [w for part in windows(text.lower()) for w in letter_words(part)]
    if len(ws) > STRETCHES * STRETCH:
        starts = np.linspace(0, len(ws) - STRETCH, STRETCHES).astype(int).tolist()
        ws = [w for a in starts for w in ws[a : a + STRETCH]]
    return " ".join(ws)


def sample(docs: DataFrame, per_language: int, doc_id: str, text: str, lang: str) -> pd.DataFrame:
    """At most ``per_language`` labelled documents of each of the ``LANGUAGES`` most frequent languages outside the held-out fold, by hash of the id.

    A column with more values than that is dirty: the rare ones have too few documents to learn from.
    A text of more than ``STRETCHES`` stretches of words gives that many, evenly spaced over all of it.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(F.col(doc_id)) != 2)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("h"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    shares = F.broadcast(counts.withColumn("share", F.least(F.lit(1.0), 2.0 * per_language / F.col("n"))))  # at most LANGUAGES rows
    likely = rows.join(shares, "lang").where(F.col("h") <= (F.col("share") * 2 - 1) * float(2**63))  # about twice as many as are taken
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    picked = likely.withColumn("nth", nth).where(F.col("nth") <= per_language)

    def thinned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(text=[evenly(t) for t in frame["text"]])

    return picked.select("text", "lang").mapInPandas(thinned, "text string, lang string").toPandas().sort_values(["lang", "text"])  # at most LANGUAGES * per_language rows


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict | None:
    rows = sample(docs, per_language, doc_id, text, lang)
    return train(rows["text"].tolist(), rows["lang"].tolist())


def parts_of(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Stretches of a batch that hold about ``WORDS_AT_ONCE`` words at most, or one text."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > WORDS_AT_ONCE * 5:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def accepted(docs: DataFrame, model: dict | None, least: float = 0.4, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is in one of the learned languages: not ``und``, and a score of at least ``least``."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model) if model else None
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for lo, hi in parts_of(texts):
                names, scores = labeller.documents(texts[lo:hi]) if labeller else (["und"] * (hi - lo), [0.0] * (hi - lo))
                yield batch.slice(lo, hi - lo).filter(pa.array([g != "und" and s >= least for g, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: dict | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), (fold(F.col(doc_id)) == 2).alias("held_out"), F.col(text).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(model) if model else None
        for frame in frames:
            texts = [t if isinstance(t, str) else None for t in frame["text"]]
            for lo, hi in parts_of(texts):
                names, scores = labeller.documents(texts[lo:hi]) if labeller else (["und"] * (hi - lo), [0.0] * (hi - lo))
                part = frame.iloc[lo:hi]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "held_out": part["held_out"].to_numpy(), "lang_pred": names, "score": scores})

    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
