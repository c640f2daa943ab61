"""Vector codes against plain Lloyd rounds over whole numbers, and their defined cases."""

import math

import numpy as np
import pytest

from mensura.llm.vector_codes import ENTRIES, PLACES, ROUNDS, Forest, Walk, choices, totals, vector_codes

KIND = "vec_id long, embedding array<float>, label int, code string, Salt string"


def plain(rows):
    """rows: (id, vector, label), whole ones only -> {id: (code, error)} and the codebooks as nested lists, by loops and Python's integers."""
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows]
    width = len(whole[0][1]) // PLACES
    part = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0], r[1]))[:ENTRIES]
    books = [[part(v, p) for _, v, _ in first] for p in range(PLACES)]

    def nearest(p, x):
        return min(range(len(books[p])), key=lambda e: (sum((a - b) ** 2 for a, b in zip(x, books[p][e], strict=True)), e))

    for _ in range(ROUNDS):
        for p in range(PLACES):
            groups = {}
            for _, v, _ in whole:
                groups.setdefault(nearest(p, part(v, p)), []).append(part(v, p))
            for e, members in groups.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = []
    for i, v, label in whole:
        code = [nearest(p, part(v, p)) for p in range(PLACES)]
        out.append((i, label, "".join(f"{c:02x}" for c in code), sum((a - b) ** 2 for p in range(PLACES) for a, b in zip(part(v, p), books[p][code[p]], strict=True))))
    return out, books


def check(spark, rows, dropped=(), leaf=2):
    docs = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in [*rows, *dropped]], KIND).repartition(3)
    out, codebook = vector_codes(docs, leaf=leaf)
    got = sorted((str(r["vec_id"]), str(r["label"]), r["code"], r["error"], r["label_error"]) for r in out.collect())
    want, books = plain(rows)
    by_label = {}
    for _, label, _, error in want:
        by_label[label] = by_label.get(label, 0) + error
    assert got == sorted((str(i), str(label), code, error, by_label[label]) for i, label, code, error in want)
    assert codebook.tolist() == books


def vectors(n, width=2, seed=0, spread=0.2):
    rng = np.random.default_rng(seed)
    return [[float(x) for x in rng.normal(0, spread, PLACES * width).astype(np.float32)] for _ in range(n)]


def test_hot_vectors_and_labels(spark):
    many = vectors(150)
    rows = [(i, v, i % 3 if i % 7 else None) for i, v in enumerate(many)]
    check(spark, rows + [(1000 + i, many[5], 1) for i in range(200)])  # a vector that most rows share


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    few = vectors(7, width=1)
    dropped = [(1, None, 0), (2, few[0][:-1] + [None], 0), (3, few[0][:-1] + [nan], 0), (4, few[0][:-1] + [inf], None), (5, [], 1), (6, few[0][:8], 1), (7, few[0] * 2, 1)]
    check(spark, [(10 + i, v, None) for i, v in enumerate(few)] + [(10, few[3], 5), (10, few[3], 5), (None, few[1], 5)], dropped)  # fewer vectors than entries; ids repeat
    check(spark, [(i, [1.0] * PLACES, 0) for i in range(70)])  # all entries are equal: the lowest index
    check(spark, [(i, [float(i % 5) - 2.001] * PLACES, i) for i in range(90)])  # ties; floors go down below zero


def test_large_components(spark):
    rows = [(i, [1000.0 * ((i * 7 + j) % 5 - 2) for j in range(2 * PLACES)], i % 2) for i in range(80)]
    check(spark, rows)  # squares of these leave 32 bits
    far = spark.createDataFrame([(1, [3e38] * PLACES, 0), (2, [-3e38] * PLACES, 0)], "vec_id long, embedding array<float>, label int")
    assert [r["error"] for r in vector_codes(far)[0].collect()] == [0, 0]


def test_empty(spark):
    out, codebook = vector_codes(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int"))
    assert out.columns == ["vec_id", "label", "code", "error", "label_error"] and out.count() == 0 and codebook.size == 0
    with pytest.raises(ValueError):
        vector_codes(out, entries=300)


@pytest.mark.parametrize("n, entries, leaf, spread", [(1, 1, 8, 9), (40, 3, 8, 1), (700, 64, 8, 3), (700, 50, 1, 300), (513, 64, 16, 40_000)])
def test_walk(n, entries, leaf, spread):
    """Each part goes to the entry of the least distance, the lower index of equals; sums and counts follow."""
    rng = np.random.default_rng(n + entries)
    points = rng.integers(-spread, spread + 1, (3, 4, n))
    book = rng.integers(-spread, spread + 1, (4, entries, 3))
    parts = Forest(points.astype(np.int32), leaf)
    again = Forest.unpacked(parts.packed(), n, 4, leaf)
    entry_tree = Forest(np.ascontiguousarray(book.transpose(2, 0, 1)), 1)
    walk = Walk(again, entry_tree)
    want = ((points.transpose(1, 2, 0)[:, :, None] - book[:, None]) ** 2).sum(-1).argmin(-1)
    assert (choices(again, walk) == want).all()
    sums, counts = totals(again, walk, entries)
    for p in range(4):
        assert (counts[p] == np.bincount(want[p], minlength=entries)).all()
        for d in range(3):
            assert (sums[d, p] == np.bincount(want[p], points[d, p], entries)).all()
