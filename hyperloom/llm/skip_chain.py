"""Personal data by a skip-chain conditional random field over the numbers and addresses of a text.

Base: four fixed patterns (e-mail, ip, card, phone) with their checks; their spans always stay.
They are found in linear time: an address grows from its ``@`` to the left, a number only from
the first digit of a row of digits.

The field adds mentions the patterns miss: a phone number said again without its prefix, a card
number with other separators, an address with ``(at)``. Its sites are the tokens of a text that
hold a digit or an at-sign; words without either are never part of a span, so they carry the
label O and only serve as context. Neighbouring sites share a chain potential, by whether they
are near; distant sites that repeat each other (equal letters and digits) or are similar (equal
last seven digits) share a skip potential. Links of a group of like sites run from one to the next, so
they grow with the sites, not their pairs. Loopy belief propagation over all links of a document
gives each site's distribution; a site that overlaps no base span is added if one kind has at
least ``SURE``.

Learning needs no labels: base spans are the labels of their sites, which are held at them, other
sites are O. To learn what repeats them, each sampled document gets altered mentions of its
own items (labelled with their kind) and as many altered mentions of made-up items (labelled O), so
an odd form alone is no evidence, but an odd form that repeats a known item is. The sample is
bounded: ``SAMPLE`` documents with base spans and ``SAMPLE`` with other sites only, those with the smallest hashes, ``SITES`` sites of each
with ``AROUND`` characters around; prediction reads every whole text.

Null texts are empty and have no spans; null ids and repeated rows give a row each; an empty
table gives an empty result; columns that are not named are ignored; a text is read whole,
however long, and takes memory by its sites. Of two kinds with equal probability neither is sure.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
O, LABELS = 4, 5  # noqa: E741
SAMPLE, SITES, AROUND = 1500, 24, 40
SURE = 0.9
NEAR = 40
HELD = 15.0
#: Where base spans are likely; only the sample is drawn by it.
HINT = r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z0-9]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9]([\x20-]?[0-9]){13}|\+[0-9]"
CHAIN_NEAR, CHAIN_FAR, SAME, ALIKE = range(4)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]+(?:(?:\.|\x20\.\x20|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?)[A-Za-z0-9-]+)+", re.IGNORECASE)
_NUMBER = re.compile(r"(?<![^\W_])\+?\(?[0-9]+(?:[\x20().,_/\[\]-]{1,3}[0-9]+)*(?![^\W_])")
_SPOKEN = re.compile(r"[(\[](?:at|dot)[)\]]", re.IGNORECASE)
_ODD = re.compile(r"[^a-z0-9]+")
_NO_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _addresses(text: str, domain: re.Pattern, base: bool) -> Iterator[tuple[int, int]]:
    """Matches of local part and domain: from each domain back to where the local part or the match before ends."""
    last = 0
    for m in domain.finditer(text):
        at = m.start()
        while at > last and text[at - 1] in _LOCAL:
            at -= 1
        if at < m.start():
            yield at, m.end()
            last = m.end()
        elif not base:
            last = m.start()


def base_spans(text: str | None) -> list[Span]:
    """The spans of the fixed patterns, by start, then kind."""
    if not text:
        return []
    out = [(a, EMAIL, b) for a, b in _addresses(text, _DOMAIN, True)] if "@" in text else []
    out += [(m.start(), IP, m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), CARD, m.end()))
    if "+" in text:
        out += [(m.start(), PHONE, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


def said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def sites(text: str) -> list[tuple[int, int, bool]]:
    """Tokens with a digit or an at-sign: start, end, whether it is an address; in order, without overlap."""
    found = [(a, b, True) for a, b in _addresses(text, _AT, False)] if "@" in text or "(at)" in text.lower() or "[at]" in text.lower() else []
    if not found:
        return [(m.start(), m.end(), False) for m in _NUMBER.finditer(text)]
    at, numbers = 0, []
    for m in _NUMBER.finditer(text):
        while at < len(found) and found[at][1] <= m.start():
            at += 1
        if at == len(found) or m.end() <= found[at][0]:
            numbers.append((m.start(), m.end(), False))
    return sorted(found + numbers)


def described(text: str, a: int, b: int, address: bool) -> tuple[list[str], str, str]:
    """A site's features, the key of what it repeats and the key of what it is similar to (empty: of nothing)."""
    s = text[a:b]
    before = text[max(0, a - 24) : a].split()
    word = [f"w:{_ODD.sub('', before[-1].lower())[:12]}"] if before else []
    feats = ["any", *word]
    if address:
        form = "spoken" if _SPOKEN.search(s) else "blank" if " " in s else "plain"
        return [*feats, "e", f"e:{form}"], "e" + _ODD.sub("", _SPOKEN.sub("", s).lower()), ""
    digits = _NO_DIGIT.sub("", s)
    groups = _NO_DIGIT.split(s.strip("+("))
    n = min(len(digits), 21)
    marks = "".join(sorted(set(_NO_DIGIT.findall(s))))[:8]
    feats += ["n", f"n:{n}", f"g:{min(len(groups), 7)}", f"m:{marks}", f"p:{s[0] == '+'}"]
    if 14 <= n <= 19:
        feats.append(f"l:{luhn(digits)}")
    if len(groups) == 4 and all(map(_small, groups)):
        feats.append("quad")
    return feats, "n" + digits if n > 3 else "", digits[-7:] if n >= 7 else ""


class Graph:
    """Sites of many documents with their links."""

    def __init__(self) -> None:
        self.feats: list[list[str]] = []
        self.base: list[int] = []
        self.place: list[tuple[int, int, int]] = []
        self.links: list[tuple[int, int, int]] = []

    def add(self, doc: int, text: str, base: list[Span]) -> None:
        last = None
        same: dict[str, int] = {}
        alike: dict[str, tuple[int, str]] = {}
        at = reach = 0
        for a, b, address in sites(text):
            while at < len(base) and base[at][2] <= a:
                at += 1
            i, kind = len(self.base), O
            for x in range(at, len(base)):
                if base[x][0] >= b:
                    break
                if base[x][2] > a:
                    kind = base[x][1]
                    break
            feats, key, tail = described(text, a, b, address)
            self.feats.append(feats)
            self.base.append(kind)
            self.place.append((doc, a, b))
            if last is not None:
                self.links.append((last, i, CHAIN_NEAR if a - reach <= NEAR else CHAIN_FAR))
            if key:
                if key in same:
                    self.links.append((same[key], i, SAME))
                same[key] = i
            if tail:
                if tail in alike and alike[tail][1] != key:
                    self.links.append((alike[tail][0], i, ALIKE))
                alike[tail] = (i, key)
            last, reach = i, b


def held(base: list[int]) -> np.ndarray:
    """Potentials that hold the sites of base spans at their kind."""
    out, kind = np.zeros((len(base), LABELS)), np.array(base)
    known = np.flatnonzero(kind < O)
    out[known, kind[known]] = HELD
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Beliefs:
    """Loopy belief propagation: all messages at once, half of each old one kept, until they rest or ``rounds`` are over."""

    def __init__(self, n: int, links: list[tuple[int, int, int]]):
        arr = np.array(links, dtype=np.int64).reshape(-1, 3)
        self.n, self.u, self.v, self.kind = n, arr[:, 0], arr[:, 1], arr[:, 2]
        self.m = len(arr)
        self.source = np.concatenate([self.u, self.v])
        self.target = np.concatenate([self.v, self.u])
        self.back = np.concatenate([np.arange(self.m, 2 * self.m), np.arange(self.m)])
        self.messages = np.zeros((2 * self.m, LABELS))

    def run(self, unary: np.ndarray, pair: np.ndarray, rounds: int = 40, rest: float = 1e-4) -> np.ndarray:
        """Each site's distribution. pair: potentials by kind of link, label of its first and of its second site."""
        theta = np.concatenate([pair[self.kind], pair[self.kind].transpose(0, 2, 1)])
        for _ in range(rounds if self.m else 0):
            total = self.total(unary)
            new = _log_sum((total[self.source] - self.messages[self.back])[:, :, None] + theta, 1)
            new -= _log_sum(new, 1)[:, None]
            new = 0.5 * (new + self.messages)
            moved = np.abs(new - self.messages).max()
            self.messages = new
            if moved < rest:
                break
        total = self.total(unary)
        return np.exp(total - _log_sum(total, 1)[:, None])

    def total(self, unary: np.ndarray) -> np.ndarray:
        out = unary.copy()
        for y in range(LABELS):
            out[:, y] += np.bincount(self.target, self.messages[:, y], self.n)
        return out

    def pairs(self, unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """The joint distribution of each link's two labels."""
        total = self.total(unary)
        m = self.m
        joint = (total[self.u] - self.messages[m:])[:, :, None] + (total[self.v] - self.messages[:m])[:, None, :] + pair[self.kind]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        return joint / joint.sum((1, 2), keepdims=True)


def altered(kind: int, item: str, rng: random.Random) -> str:
    """An item said in a way the fixed patterns do not take."""
    digits = _NO_DIGIT.sub("", item)
    if kind == EMAIL:
        local, host = item.split("@", 1)
        at = rng.choice([" (at) ", "(at)", " [at] ", " @ "])
        return local + at + (host.replace(".", rng.choice([" (dot) ", "[dot]", "."])))
    if kind == IP:
        return rng.choice(["-", " . ", "[.]", "_"]).join(item.split("."))
    if kind == CARD:
        return rng.choice([".", "_", "/"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    local = digits[-10:]
    return rng.choice([f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}", f"{local[3:6]}-{local[6:]}", local])


def made_up(kind: int, item: str, rng: random.Random) -> str:
    """An item of the same form with other letters or digits."""
    if kind == EMAIL:
        return re.sub("[A-Za-z]", lambda m: rng.choice("abcdefghijklmnopqrstuvwxyz"), item)
    return re.sub("[0-9]", lambda m: rng.choice("0123456789"), item)


def _lesson(parts: list[str], rng: random.Random) -> tuple[Graph, list[int]]:
    """A sampled document's sites and labels, with altered mentions behind them."""
    text = " … ".join(parts)
    base = base_spans(text)
    words = [w for p in parts for w in p.split() if w.isalpha()] or ["and"]
    add: list[tuple[str, int]] = []
    for a, k, b in base:
        if rng.random() < 0.7:
            add.append((altered(k, text[a:b], rng), k))
        if rng.random() < 0.7:
            add.append((altered(k, made_up(k, text[a:b], rng), rng), O))
    rng.shuffle(add)
    own: dict[tuple[int, int], int] = {}
    for mention, k in add:
        text += " … " + rng.choice(words) + " "
        own[(len(text), len(text) + len(mention))] = k
        text += mention + " " + rng.choice(words)
    g = Graph()
    g.add(0, text, base_spans(text))
    gold = []
    for (_, a, b), kind in zip(g.place, g.base, strict=True):
        hit = next((k for (lo, hi), k in own.items() if a < hi and lo < b), None)
        gold.append(kind if kind < O or hit is None else hit)
    return g, gold


def train(documents: list[list[str]], seed: int = 5, epochs: int = 150) -> dict | None:
    """Potentials from the surroundings of the sites of sampled documents."""
    rng = random.Random(seed)
    feats: list[list[str]] = []
    links: list[tuple[int, int, int]] = []
    gold: list[int] = []
    known: list[int] = []
    for parts in documents:
        g, labels = _lesson(parts, rng)
        links += [(u + len(gold), v + len(gold), k) for u, v, k in g.links]
        feats += g.feats
        known += g.base
        gold += labels
    if not gold:
        return None
    ids: dict[str, int] = {}
    rows = [[ids.setdefault(f, len(ids)) for f in fs] for fs in feats]
    flat = np.array([f for r in rows for f in r])
    sizes = np.array([len(r) for r in rows])
    owner, lab, n = np.repeat(np.arange(len(rows)), sizes), np.array(gold), len(rows)
    true = np.eye(LABELS)[lab]
    weight, pair = np.zeros((len(ids), LABELS)), np.zeros((4, LABELS, LABELS))
    seen_w, seen_p = np.full_like(weight, 1e-2), np.full_like(pair, 1e-2)
    field = Beliefs(n, links)
    for _ in range(epochs):
        unary = held(known)
        np.add.at(unary, owner, weight[flat])
        grad = true - field.run(unary, pair, rounds=8)
        g_w = np.zeros_like(weight)
        np.add.at(g_w, flat, grad[owner])
        g_w = g_w / n * 50 - 1e-3 * weight
        seen_w += g_w**2
        weight += 0.5 * g_w / np.sqrt(seen_w)
        if field.m:
            g_p = np.zeros_like(pair)
            np.add.at(g_p, field.kind, true[field.u][:, :, None] * true[field.v][:, None, :] - field.pairs(unary, pair))
            g_p = g_p / n * 50 - 1e-3 * pair
            seen_p += g_p**2
            pair += 0.5 * g_p / np.sqrt(seen_p)
    return {"ids": ids, "weight": weight, "pair": pair}


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> dict | None:
    """Learns from a bounded sample: ``sample`` documents with base spans and as many with other sites only."""
    ship(docs.sparkSession)
    rows = docs.where(F.col(text).rlike("[0-9@]")).select(F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("h"), F.col(text).rlike(HINT).alias("hint"), F.col(text).alias("text"))
    shares = {r.hint: min(1.0, 3 * sample / r.n) for r in rows.groupBy("hint").agg(F.count("*").alias("n")).collect()}  # two rows
    likely = [F.when(F.col("hint") == F.lit(hint), F.col("h") <= F.lit((2 * share - 1) * float(2**63))) for hint, share in shares.items()]
    rows = rows.where(F.coalesce(F.lit(None).cast("boolean"), *likely, F.lit(False)))  # about three times as many as are taken

    def surroundings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for h, t in zip(frame["h"].tolist(), frame["text"], strict=True):
                base = base_spans(t)
                found = [(a, b) for a, _, b in base[:SITES]] or [(a, b) for a, b, _ in sites(t)[:SITES]]
                if found:
                    out.append((bool(base), h, [t[max(0, a - AROUND) : min(b, a + 80) + AROUND] for a, b in found]))
            yield pd.DataFrame(out, columns=["have", "h", "parts"])

    parts = rows.mapInPandas(surroundings, "have boolean, h long, parts array<string>")
    nth = F.row_number().over(Window.partitionBy("have").orderBy("h", "parts"))
    picked = parts.withColumn("nth", nth).where(F.col("nth") <= sample).orderBy("have", "h", "parts").select("parts").toPandas()["parts"]  # at most 2 * sample rows of SITES stretches
    return train([list(p) for p in picked])


class Finder:
    def __init__(self, model: dict):
        self.ids, self.pair = model["ids"], model["pair"]
        self.weight = np.vstack([model["weight"], np.zeros((1, LABELS))])

    def posteriors(self, g: Graph) -> np.ndarray:
        rows = [[self.ids.get(f, len(self.ids)) for f in fs] for fs in g.feats]
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        flat = np.array([f for r in rows for f in r], dtype=np.int64)
        unary = np.add.reduceat(self.weight[flat], np.cumsum(sizes) - sizes) + held(g.base)
        return Beliefs(len(rows), g.links).run(unary, self.pair)

    def added(self, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
        """Per text the spans that the field adds to the base ones."""
        out: list[list[Span]] = [[] for _ in texts]
        g = Graph()
        for d, (t, base) in enumerate(zip(texts, bases, strict=True)):
            if t:
                g.add(d, t, base)
        if not g.base:
            return out
        p = self.posteriors(g)
        kind = p.argmax(1)
        sure = np.flatnonzero((kind < O) & (p.max(1) >= SURE) & (np.array(g.base) == O))
        for i in sure.tolist():
            d, a, b = g.place[i]
            out[d].append((a, int(kind[i]), b))
        return out


def find(docs: DataFrame, model: dict | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added ones), n_added."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(model) if model else None
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame["text"]]
            bases = [base_spans(t) for t in texts]
            more = finder.added(texts, bases) if finder else [[] for _ in texts]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"],
                **{f"n_{name}": [sum(s[1] == k for s in b) for b in bases] for k, name in enumerate(KINDS)},
                "base_sha256": [hashlib.sha256(said(b).encode()).hexdigest() for b in bases],
                "spans": [said(sorted(b + m)) for b, m in zip(bases, more, strict=True)],
                "n_added": [len(m) for m in more],
            })

    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
