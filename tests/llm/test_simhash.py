"""SimHash against brute force; the index against all pairs."""

import numpy as np
import pytest
import xxhash

from mensura.llm.hamming import forest_of, gray_rank
from mensura.llm.simhash import fingerprint, near_links, op1_simhash, simhash_components

SF = "/root/testdata/sf0.001"


def plain_print(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, most=2):
    """Smallest member index reachable for each print, over all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", ["", None, "One", "A b", "a\x1cb c d", "ÄB c D e", "x " * 700 + "y z", "a b c"])
def test_fingerprint(text):
    assert fingerprint(text) == plain_print(text)


@pytest.mark.parametrize("shape", ["random", "ball", "two balls"])
def test_index_against_all_pairs(shape):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    prints = set()
    while len(prints) < 400:
        bits = {"random": 64, "ball": 3, "two balls": 3}[shape]
        p = int(rng.integers(0, 2**63)) if bits == 64 else centre
        for b in rng.choice(64, size=rng.integers(0, bits + 1) if bits < 64 else 0, replace=False):
            p ^= 1 << int(b)
        prints.add(p ^ (0xFFFF0 if shape == "two balls" and rng.random() < 0.5 else 0))
    values = np.array(sorted(prints), np.uint64)
    values = values[np.argsort(gray_rank(values))]
    a, b = forest_of(values, [np.zeros(len(values), np.int64)], 2)
    where = {int(v): i for i, v in enumerate(values)}
    root = np.arange(len(values))
    for x, y in zip(a, b, strict=True):
        root[where[int(x)]] = where[int(y)]
    assert list(root) == classes([int(v) for v in values])


@pytest.mark.parametrize("hot", [8192, 8])
def test_routes(spark, hot):
    rng = np.random.default_rng(3)
    prints = {0, 2**63}
    for _ in range(60):
        c = int(rng.integers(0, 2**63))
        for _ in range(6):
            p = c
            for b in rng.choice(64, size=rng.integers(0, 4), replace=False):
                p ^= 1 << int(b)
            prints.add(p)
    prints = sorted(prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    links = near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), hot=hot).collect()
    at = {p: i for i, p in enumerate(signed)}
    root = list(range(len(prints)))
    for _ in range(len(prints)):
        for a, b in links:
            i, j = at[a], at[b]
            root[i] = root[j] = min(root[i], root[j])
    assert root == classes(prints)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    prints = [plain_print(t) for t in docs["text"]]
    order = np.argsort(docs["doc_id"].to_numpy())
    ids, prints = docs["doc_id"].to_numpy()[order], [prints[i] for i in order]
    want = {int(i): (f"{p:016x}", int(ids[c])) for i, p, c in zip(ids, prints, classes(prints), strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op1_simhash(spark, SF).collect()}
    assert got == want


def test_corners(spark):
    rows = [(5, None, "x"), (3, "", "y"), (3, "", "y"), (None, "a b c d", "z"), (9, "A b  C\td", None), (7, "w " * 20000, "x")]
    out = simhash_components(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in out)
    assert got == [(False, 3, 3), (False, 3, 3), (False, 5, 3), (False, 7, 7), (False, 9, 9), (True, None, 9)]
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_giant_component(spark, monkeypatch):
    """4,096 distinct fingerprints hang together, with copies of some; others stand alone."""
    from mensura.llm import simhash

    rows = [(10_000 - i, i) for i in range(4096)] + [(20_000 + i, i) for i in range(0, 4096, 5)]
    rows += [(30_000 + i, ((i * 0x9E3779B97F4A7C15) % 2**62) | 1 << 60) for i in range(1, 200)]
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, doc_id, text: prints)
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(prints).collect()}
    assert all(got[i] == 10_000 - 4095 for i, fp in rows if fp < 4096)
    assert sum(got[i] == i for i, fp in rows if fp >= 4096) > 150
