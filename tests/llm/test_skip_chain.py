"""Base patterns against the plain expressions, belief propagation against enumeration, added spans against planted mentions."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.llm import queries, skip_chain

from .edge import ROWS, frame

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for k, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = [True, k != 1 or all(int(p) <= 255 for p in m.group().split(".")), 14 <= len(digits) <= 19 and plain_luhn(digits), 10 <= len(digits) <= 15][k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def said(spans):
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans_equal_the_plain_expressions():
    rng = random.Random(4)
    bits = ["a@b.c", "@", ".", "x.y@", "d-e.f", "+1", "(555)", "-", " ", "4111 1111 1111 1111", "1.2.3.4", "300.1.1.1", "0", "99", "é", "%", "5", "\n", "+49 30 1234567", "@@", "a@b", "..", "12345678"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert skip_chain.base_spans(text) == plain_spans(text), text


def test_patterns_are_linear():
    for part in ("a", "a.", "1", "1.", "1 ", "+", "a@", "a@b.", "(", "1(", "+1 ", "1a"):
        text = part * 200_000
        base = skip_chain.base_spans(text)
        skip_chain.Graph().add(0, text, base)


def test_beliefs_of_a_tree_are_exact():
    rng = np.random.default_rng(2)
    links = [(0, 1, 0), (1, 2, 1), (1, 3, 2), (3, 4, 3)]
    unary, pair = rng.normal(size=(5, 5)), rng.normal(size=(4, 5, 5))
    field = skip_chain.Beliefs(5, links)
    got = field.run(unary, pair, rounds=200, rest=1e-12)
    want, joint = np.zeros((5, 5)), np.zeros((4, 5, 5))
    for y in itertools.product(range(5), repeat=5):
        p = np.exp(sum(unary[i, y[i]] for i in range(5)) + sum(pair[k, y[u], y[v]] for u, v, k in links))
        for i in range(5):
            want[i, y[i]] += p
        for e, (u, v, _) in enumerate(links):
            joint[e, y[u], y[v]] += p
    assert got == pytest.approx(want / want.sum(1, keepdims=True), abs=1e-6)
    assert field.pairs(unary, pair) == pytest.approx(joint / joint.sum((1, 2), keepdims=True), abs=1e-6)


def planted(n=240, seed=3):
    """Documents that say an item again in another form, and others that say a made-up one."""
    rng = random.Random(seed)
    words = "the house of rain was read and seen by many over time".split()
    digits = lambda m: "".join(rng.choice("0123456789") for _ in range(m))
    rows, truth = [], {}
    for i in range(n):
        k = i % 4
        item = [f"{rng.choice(words)}.{digits(2)}@mail{digits(1)}.example.com", ".".join(str(rng.randint(1, 255)) for _ in range(4)), "", f"+1 ({digits(3)}) 555-{digits(4)}"][k]
        if k == 2:
            item = next(c for c in ("4" + digits(15) for _ in itertools.count()) if plain_luhn(c))
        again = skip_chain.altered(k, item if i % 3 else skip_chain.made_up(k, item, rng), rng)
        filler = " ".join(rng.choice(words) for _ in range(30))
        text = f"{filler} {item} {filler} {again} {filler}"
        if len(plain_spans(text)) == 1:
            rows.append((i, text, "en", "a"))
            truth[i] = [said([(text.rindex(again), k, text.rindex(again) + len(again))])] if i % 3 else []
    return rows, truth


def test_added_spans(spark):
    rows, truth = planted()
    docs = frame(spark, rows)
    out = {r.doc_id: r for r in skip_chain.find(docs, skip_chain.fit(docs)).collect()}
    right = wrong = 0
    for i, text, *_ in rows:
        more = set(out[i].spans.split(",")) - set(said(plain_spans(text)).split(","))
        right += more == set(truth[i]) != set()
        wrong += len(more - set(truth[i]))
    assert right >= 0.8 * sum(map(bool, truth.values())) and wrong <= 3


def test_query(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    out = queries.op12_skip_chain_pii(spark, tiny)
    assert out.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = Counter()
    for r in docs:
        base = plain_spans(r.text)
        want[(r.doc_id, *(sum(k == x for _, x, _ in base) for k in range(4)), hashlib.sha256(said(base).encode()).hexdigest())] += 1
    got = out.collect()
    assert Counter(tuple(r)[:6] for r in got) == want
    texts = {r.doc_id: r.text for r in docs}
    for r in got:
        assert set(said(plain_spans(texts[r.doc_id])).split(",")) <= set(r.spans.split(","))
    assert sum(r.n_added for r in got) <= 2, "clean text is left alone"


def test_odd_rows(spark):
    rows = [*ROWS, (11, "mail x@y.zz or +1 (377) 555-0271 or 1.2.3.4", "en", "a"), (11, "mail x@y.zz or +1 (377) 555-0271 or 1.2.3.4", "en", "a")]
    for docs in (frame(spark, rows), frame(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))):
        out = skip_chain.find(docs, skip_chain.fit(docs)).collect()
        assert Counter(r.base_sha256 for r in out) == Counter(hashlib.sha256(said(plain_spans(t)).encode()).hexdigest() for _, t, *_ in rows)
    none = frame(spark, [])
    assert skip_chain.fit(none) is None and skip_chain.find(none, None).count() == 0
    assert skip_chain.find(frame(spark), None).count() == len(ROWS)
