"""Exact dedup against a plain grouping, and its defined cases."""

import hashlib
import re

import xxhash

from mensura.llm.exact_dedup import exact_dedup

KIND = "doc_id long, text string, keep_id string, Salt string, size string"


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], KIND).repartition(3)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup(docs).collect())
    groups, want = {}, []
    for n, (i, t) in enumerate(rows):
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0, xxhash.xxh64((t or "").encode(), seed=42).intdigest() - 2**63 ^ -(2**63), n))
    for n, (i, t) in enumerate(rows):
        first = min(groups[bare(t)])
        want.append((i is None, i or 0, None if first[1] else first[2], len(groups[bare(t)]), n == first[4], hashlib.sha256(bare(t).encode()).hexdigest()))
    assert got == sorted(want)
    assert sum(g[4] for g in got) == len(groups)  # of each group one row


def test_hot_group_and_its_neighbours(spark):
    hot = [(i, "a b  c" if i % 3 else "ab c") for i in range(400)]  # one group, two lengths
    near = [(1000 + i, "x" * 70 + f"{i:03d}") for i in range(100)]  # same length and prefix, other texts
    check(spark, hot + near + [(2000, "abd"), (2001, "y" * 5_000), (2002, " y" * 5_000)])


def test_defined_cases(spark):
    check(spark, [(5, "a b"), (5, "a  b"), (6, "ab"), (7, "a b")])
    check(spark, [(5, "c d e"), (5, "cd  e"), (5, "cde"), (5, "c d e")])
    check(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "\u00a0"), (5, "é"), (5, "é"), (6, "e\u0301"), (7, "w x"), (8, "wx"), (9, "w x"), (11, "q"), (12, "q "), (13, "k 1")])


def test_null_ids(spark):
    got = exact_dedup(spark.createDataFrame([(None, "one"), (4, "one"), (None, "two")], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in got) == [("4", "4", 2, True), ("None", "4", 2, False), ("None", "None", 1, True)]


def test_empty(spark):
    out = exact_dedup(spark.createDataFrame([], KIND))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "content"] and out.count() == 0
