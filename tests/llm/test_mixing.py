"""Mixing against repeated sharing done plainly, and its defined cases."""

import hashlib
import re
from collections import Counter

import pytest

from mensura.llm.mixing import MAX_EPOCHS, SEED, mix_sources

KIND = "doc_id long, text string, source string, size string, target string"


def plain_targets(total):
    order = sorted((s for s in total if s is not None)) + [s for s in total if s is None]
    weight, target, open_ = {s: i % 3 + 1 for i, s in enumerate(order)}, {}, set(total)
    while True:
        budget = sum(total.values()) - sum(target.values())
        share = {s: budget * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > MAX_EPOCHS * total[s]}
        target |= {s: float(MAX_EPOCHS * total[s]) for s in over} if over else share
        open_ -= over
        if not over:
            return target


def check(spark, rows):
    got = mix_sources(spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], KIND).repartition(3)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    target = plain_targets(total)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, size(t)) for i, t, s in rows)
    taken = Counter()
    for r in got:
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= MAX_EPOCHS * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in total)
    for s in total:  # the fractional repetition goes to the first in the seeded order
        rank = lambda r: hashlib.md5(f"{'' if r['doc_id'] is None else r['doc_id']}:{SEED}".encode()).hexdigest()
        left = round(target[s]) - (int(target[s] / total[s]) if total[s] else 0) * total[s]
        for r in sorted((r for r in got if r["source"] == s), key=lambda r: (rank(r), r["size"], -r["more"])):  # equal rows are interchangeable
            assert r["more"] == max(0, min(r["size"], left))
            left -= r["size"]


def test_hot_source_and_clamped_ones(spark):
    hot = [(i, "w " * (1 + i % 7), "a") for i in range(600)]
    check(spark, hot + [(1000 + i, "w w w", "b") for i in range(5)] + [(2000, "w " * 40, "c"), (2001, "w", "d"), (2002, "w", None)])


def test_defined_cases(spark):
    check(spark, [(1, None, "a"), (2, "", "a"), (3, "x y", "b"), (3, "x y", "b"), (4, "z " * 9, None), (None, "q r s", "c"), (5, "  w", "Z"), (6, None, "empty")])


def test_nothing_to_share(spark):
    assert [r["taken"] for r in mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()] == [0, 0]
    assert mix_sources(spark.createDataFrame([], KIND)).count() == 0


def test_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    runs = [sorted(map(tuple, mix_sources(d).select("doc_id", "taken").collect())) for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1]
