"""Benchmark windows against a plain search of every place, removal, and the defined cases."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from mensura.llm.decontaminate import WINDOW, drop_documents, drop_spans, hits, report

KIND = "doc_id long, text string, row string, Found string, gram string"
ITEMS = "item_id long, text string, size string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items):
    """The words hit, and the items."""
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        size = min(len(v), WINDOW)
        for a in range(len(v) - size + 1) if v else ():
            for i in range(len(w) - size + 1):
                if w[i : i + size] == v[a : a + size]:
                    hit.update(range(i, i + size))
                    found.add("" if item is None else str(item))
    return hit, sorted(found)


def frames(spark, rows, items):
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], KIND).repartition(3)
    return docs, spark.createDataFrame([(i, t, "q") for i, t in items], ITEMS)


def check(spark, rows, items, **settings):
    docs, bench = frames(spark, rows, items)
    got = sorted(map(str, (tuple(r) for r in report(docs, bench, **settings).collect())))
    want = []
    for i, t in rows:
        hit, found = plain(t, items)
        want.append((i, len(words(t)), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    assert got == sorted(map(str, want))
    clean = sorted(str(i) for (i, t) in rows if not plain(t, items)[0])
    assert sorted(str(r["doc_id"]) for r in drop_documents(docs, bench, **settings).collect()) == clean


def bodies(draw, n):
    return " ".join(draw.choice(["the", "of", "Ab", "c1", "élan", "x"]) for _ in range(n))


def test_planted_passages(spark):
    draw = random.Random(3)
    items = [(i, bodies(draw, 14 + i)) for i in range(6)] + [(9, "the of"), (10, "Ab c1 x!")]
    rows = [(i, bodies(draw, 60)) for i in range(80)]
    for i in range(80, 160):
        whole = items[i % 6][1].split()
        at = draw.randrange(len(whole) - 9)
        rows.append((i, f"{bodies(draw, i % 20)}; {', '.join(whole[at : at + 9 + i % 3]).upper()}. {bodies(draw, 5)}"))
    check(spark, rows, items)
    check(spark, rows, items, broadcast_bytes=500)  # several joins


def test_defined_cases(spark):
    ten = "one two three four five six seven eight nine ten"
    rows = [(1, None), (2, ""), (3, " !! "), (4, ten), (4, ten), (4, ten + " eleven"), (None, f"x {ten}"), (5, ten[:-4]), (6, "One-Two (three) four/five six:seven eight nine TEN"), (7, ("a " * 25)), (8, "q " * 40_000 + ten), (9, "É é"), (10, "one_two three")]
    items = [(1, ten + " eleven"), (1, None), (2, ""), (3, ten), (None, "é"), (20, "a a"), (5, "a " * 12), (6, "K")]
    check(spark, rows, items)
    check(spark, rows, [])
    check(spark, [], items)
    check(spark, rows, [(1, None)])


def test_spans_are_removed(spark):
    ten = "one two three four five six seven eight nine ten"
    rows = [(1, f"Start, {ten}. Then {ten}; end!"), (2, ten), (3, f"({ten}) {ten} tail "), (4, "clean  text\n"), (5, None), (6, f"{ten} {ten}")]
    docs, bench = frames(spark, rows, [(1, ten)])
    got = {r["doc_id"]: r["text"] for r in drop_spans(docs, bench).collect()}
    assert got == {1: "Start, . Then ; end!", 2: "", 3: "( tail ", 4: "clean  text\n", 5: None, 6: ""}
    out = drop_spans(docs, bench)
    assert out.columns == docs.columns and not report(out.select("doc_id", "text"), bench).where("contaminated").count()


def test_all_false_alarms_are_verified(spark):
    """A bitmap with every bit set lets all windows through; the join decides alone."""
    from mensura.llm import decontaminate as D

    whole = D._bitmap
    rows, items = [(i, f"a{i} b c d e f g h i j k{i}") for i in range(50)], [(1, "a7 b c d e f g h i j"), (2, "b c d e f g h i j k9")]
    try:
        D._bitmap = lambda windows, bits, window: F.array_repeat(F.lit(-1).cast("long"), 1 << bits - 6)
        check(spark, rows, items)
    finally:
        D._bitmap = whole


def test_columns_stay(spark):
    docs, bench = frames(spark, [(1, "a b")], [(1, "a")])
    assert hits(docs, bench).columns == [*docs.columns, "_words", "_spans", "_items"]
    assert not hits(docs, bench).where(F.size("_spans") != 1).count()
