import math
import re
import zlib
from collections import Counter

import pytest

import numpy as np

from mensura.llm.lm import END, MU, Automaton, Tokens, lm_scores


def read(rows):
    docs = []
    for k, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        docs.append((k, zlib.crc32(str("" if k is None else k).encode()) % 7 == 2, [*re.findall(r"[^\x20\x09-\x0D]+", low), None]))
    return docs


def brute(rows, mu=MU):
    """Counts and probabilities as the module states them, token by token, from the formula alone."""
    docs, order = read(rows), len(mu) + 1
    grams = Counter()
    for _, held, t in docs:
        if not held:
            padded = [None, *t]
            for k in range(1, order + 1):
                grams.update(tuple(padded[i : i + k]) for i in range(k == 1, len(padded) - k + 1))
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)

    def p(h, w):
        if not h:
            return (grams[w,] + 1) / (n + v + 1)
        m = mu[len(h) - 1]
        return (grams[*h, w] + m * p(h[1:], w)) / (grams[h] + m)

    out = []
    for k, held, t in docs:
        padded = (None, *t)
        score = sum(math.log10(p(padded[max(0, i - order + 1) : i], w)) for i, w in enumerate(padded) if i)
        out.append((k, held, len(t), sum(grams[w,] > 0 for w in t), n, sum(math.log10(p((), w)) for w in t), score))
    return out, (grams, p)


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize(("mu", "sizes"), [(MU, {}), (MU, {"block": 40_000, "hash_range": 9_000}), ((5.0, 2.0, 0.5), {"block": 90_000, "hash_range": 9_000, "most_ranges": 2, "part": 999}), ((20.0,), {})])
def test_against_brute_force(spark, mu, sizes):
    """Orders two to four; blocks, ranges and parts of any size give the same scores."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want, _ = brute([(r["doc_id"], r["text"]) for r in docs.collect()], mu)
    same(lm_scores(docs, mu=mu, **sizes).collect(), want)


def test_probabilities_sum_to_one():
    _, (grams, p) = brute([(i, t) for i, t in enumerate(["a b a c", "b b a", "c", "a b d", "b a"])])
    words = [g[0] for g in grams if len(g) == 1]
    for h in [(), *(g for g in grams if len(g) < 3 and (len(g) == 1 or g[-1] is not None))]:
        assert sum(p(h, w) for w in words) + p(h, "unseen") == pytest.approx(1)


def test_failure_arcs():
    """The automaton walked by hand: arcs where there are some, else failure arcs, one after another."""
    texts, mu = [b"a b c a b d", b"b c a b c", b"c c", b"a q b c"], (3.0, 1.0, 0.5)
    train = np.array([True, True, True, False])
    t = Tokens(texts, 4)
    totals = [t.unsort(k, t.counts(k, train).astype(float)) for k in range(4)]
    n, v = int(totals[0].sum()), int((totals[0] > 0).sum())
    model = Automaton(t, totals, n, v, mu)
    arcs = {}
    for key, place in zip(model.arcs.keys.tolist(), model.arcs.places.tolist(), strict=True):
        if key >= 0:
            arcs[key >> 32, key & 0xFFFFFFFF] = model.weights[place], model.targets[place]
    failed = 0
    for span in (1, 2, 3, 100):
        for doc, got in enumerate(model.traverse(t, span)):
            state, total = model.root_to[END], 0.0
            for w in t.tokens[t.starts[doc] : t.starts[doc] + t.lengths[doc]].tolist():
                while state and (state, w) not in arcs:
                    total, state, failed = total + model.fail[state], model.fail_to[state], failed + 1
                weight, state = arcs[state, w] if state else (model.root[w], model.root_to[w])
                total += weight
            assert got == pytest.approx(total)
    assert failed >= 8
    want, _ = brute([(k, x.decode()) for k, x in zip((0, 1, 2, 3), texts, strict=True)], mu)  # checksums of 0 to 3
    held = [r[1] for r in want]
    t2 = np.array([not h for h in held])
    totals = [t.unsort(k, t.counts(k, t2).astype(float)) for k in range(4)]
    model = Automaton(t, totals, int(totals[0].sum()), int((totals[0] > 0).sum()), mu)
    assert model.traverse(t).tolist() == pytest.approx([r[6] for r in want])


def test_repeated_rows_spread(spark):
    """A row repeated many times fills blocks like any other rows; results are those of brute force."""
    rows = [(7, "same words here and there again")] * 3000 + [(i, f"row {i} has words of its own {i % 7}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    same(lm_scores(df, block=5000, hash_range=2000).collect(), brute(rows)[0])


def test_held_out_beats_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm_scores(docs).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r["s"] > r["b"]


def test_corners(spark):
    rows = [(1, None, 0), (1, None, 0), (2**62 + 1, "b a", 1), (None, "A a\x1cb É", 1), (5, "x " * 50000, 2), (7, "a x a", 3), (8, "A", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    same(lm_scores(df).collect(), brute([r[:2] for r in rows])[0])
    assert lm_scores(df.limit(0)).count() == 0
