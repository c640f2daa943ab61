"""Quality rules against plain Python, and their defined cases."""

import re
from collections import Counter

from mensura.llm.quality_rules import COLUMNS, RULES, STOP_WORDS, quality_rules

KIND = "doc_id long, text string, N_words string, kept string, other string"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    repeated = {k for i, w in enumerate(windows) if times[w] > 1 for k in range(i, i + 5)}
    n, chars = len(words), sum(map(len, words))
    symbols, dup = len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    stops = sum("".join(c for c in w if c.isalpha()).lower() in STOP_WORDS for w in words)
    failed = n < 10 or 100 * len(repeated) > 20 * n
    good = 2 <= chars / max(n, 1) <= 12 and symbols / max(n, 1) <= 0.1 and dup / max(len(lines), 1) <= 0.6
    good = good and (n < 50 or stops / n >= 0.02)
    return n, chars, symbols, dup, len(repeated), failed, not failed and good


def check(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate(texts)], KIND)
    out = quality_rules(docs, **more)
    assert out.columns.count("kept") == 1 and "other" in out.columns
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in out.collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_against_plain_python(spark):
    plain_words = " ".join(f"word{i} of the" for i in range(40))
    check(spark, [
        None, "", " \t\n", "one", "a b c d e", plain_words, plain_words, plain_words + " # $ % &" * 20,
        "a b c d e f a b c d e f g h", "x " * 500, "\n".join(["same line of the text"] * 4 + ["other line"]),
        " ".join(f"w{i}" for i in range(60)), "é ü " * 3 + plain_words, "line\r\nline\r\n\n\nline " + plain_words, "w" * 50_000 + " " + plain_words,
    ])


def test_long_text_is_read_whole(spark):
    tail = "one two three four five"
    check(spark, [" ".join([tail, *(f"the{i}" for i in range(30_000)), tail])])


def test_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in quality_rules(docs).collect()}
    assert got == {i: plain(t) for i, t in texts.items()} and {v[-1] for v in got.values()} == {True, False}


def test_table_and_plan(spark):
    docs = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(12)))], "doc_id long, text string")
    assert quality_rules(docs).first()["kept"]
    assert not quality_rules(docs, rules=(*RULES, ("more words", "n_words", 13, None, 0))).first()["kept"]
    plan = quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert quality_rules(docs.limit(0)).count() == 0
