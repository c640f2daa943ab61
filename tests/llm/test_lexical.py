"""Ranked search against scoring every document, and its defined cases."""

import math
import random
import re
from collections import Counter

from mensura.llm import lexical
from mensura.llm.lexical import Block, search, terms

KIND = "doc_id long, text string, score string, Rank string"
ITEMS = "item_id long, text string, rank string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def plain(rows, items, top=10):
    docs = [(i, Counter(plain_terms(t)), len(plain_terms(t))) for i, t in rows]
    n_docs, n_terms = sum(n > 0 for *_, n in docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(plain_terms(t))
    out = []
    for item, wants in wanted.items():
        scored = []
        for i, counts, n in docs:
            score = 0
            for t in wants & counts.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * (10 + 90 * n * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top])]
    return sorted(map(str, out))


def check(spark, rows, items, **settings):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], KIND).repartition(3)
    wanted = spark.createDataFrame([(i, t, "z") for i, t in items], ITEMS)
    got = search(docs, wanted, **settings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(rows, items)


def test_random_texts(spark, monkeypatch):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(draw.choices(words, [1 / (i + 1) for i in range(60)], k=n))
    rows = [(i, text(draw.randint(1, 40))) for i in range(400)]
    rows += [(500 + i, rows[7][1]) for i in range(60)]  # copies: more ties than places
    items = [(i, text(draw.randint(1, 25))) for i in range(12)] + [(100, " ".join(words) + " " + " ".join(f"v{i}" for i in range(80)))]
    check(spark, rows, items)
    check(spark, rows, items, terms_a_block=40)  # several blocks of items
    monkeypatch.setattr(lexical, "AT_ONCE", 1)
    monkeypatch.setattr(lexical.postings, "__defaults__", ("doc_id", "text", 16, 1 << 20))
    check(spark, rows, items)


def test_more_terms_than_a_mask_has_bits(spark):
    words = [f"t{i}" for i in range(150)]
    rows = [(i, " ".join(words[i % 40 : i % 40 + 100 - i])) for i in range(60)]
    check(spark, rows, [(1, " ".join(words)), (2, " ".join(words[::-1]))])


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " -- \n"), (4, "Élan É élan"), (5, "a_b A"), (5, "a b"), (5, "a b"), (None, "a b"), (6, "x" * 5000 + " a"), (7, "b " * 30_000)]
    items = [(1, None), (2, ""), (3, "a"), (3, "élan b"), (None, "A!"), (4, "nowhere"), (5, "a a a")]
    check(spark, rows, items)
    check(spark, [(1, "same"), (2, "same")], [(1, "same")])  # in all documents: a weight near zero
    check(spark, [], [(1, "a")])
    check(spark, [(1, "a")], [])
    check(spark, [(1, None)], [(1, "a")])


def test_terms():
    for text in ("Ab_c-d9É", "\x7f x y", "", None, "A{b}c~D", "ǅ ΑΣ"):
        assert [t.decode() for t in terms(None if text is None else text.encode())] == plain_terms(text)


def test_masks_are_left_when_safe():
    """The best document's mask comes first; others whose greatest score is below are never scored, and none is lost."""
    import numpy as np

    at, tf = [], []
    for t in range(3):
        at.append(np.arange(t * 100, 400, dtype=np.int32))
        tf.append(np.ones(400 - t * 100, np.int64))
    row = {"at": np.concatenate(at).tobytes(), "tf": np.concatenate(tf).tobytes(), "terms": [0, 1, 2], "ends": np.cumsum([len(a) for a in at]).tolist(), "lengths": [5] * 400}
    block = Block(row, 400, 2000)
    everything = block.best({0: 10, 1: 100, 2: 1000}, 0, 400)
    assert len(everything) == 400
    top = block.best({0: 10, 1: 100, 2: 1000}, 0, 10)
    assert {s for s, _ in top} == {max(s for s, _ in everything)} and {d for _, d in top} == set(range(200, 400))
    assert block.best({0: 10, 1: 100, 2: 1000}, top[0][0] + 1, 10) == []
