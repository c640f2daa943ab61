"""The pipeline against the same stages done plainly, row by row."""

import hashlib
import re
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from mensura.llm.bpe import word_bpe_path
from mensura.llm.quality_rules import quality_rules
from tests.llm.test_simhash import classes, plain_print

SF = "/root/testdata/sf0.001"


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in quality_rules(docs).where("kept").collect()}
    rows = sorted((r for r in docs.collect() if r["doc_id"] in kept), key=lambda r: r["doc_id"])
    by_text = {}
    for r in sorted(rows, key=lambda r: (-len(r["text"]), r["doc_id"])):
        by_text.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"]), r)
    rows = sorted(by_text.values(), key=lambda r: r["doc_id"])
    roots = classes([plain_print(r["text"]) for r in rows])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]

    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows}
    total = Counter()
    for r in rows:
        total[r["source"]] += size[r["doc_id"]]
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(total))}
    target, open_ = {}, set(total)
    while True:  # share, clamp, share the rest again
        budget = sum(total.values()) - sum(target.values())
        share = {s: budget * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * total[s] for s in over}
        open_ -= over
    want = Counter()
    for s in total:
        rest = round(target[s]) - int(target[s] / total[s]) * total[s]
        for r in sorted((r for r in rows if r["source"] == s), key=lambda r: hashlib.md5(f"{r['doc_id']}:7".encode()).hexdigest()):
            n = size[r["doc_id"]]
            times = int(target[s] / total[s]) + (2 * min(n, max(0, rest)) >= n)
            rest -= n
            want[r["doc_id"]] = times
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == +want
    lib = Tokenizer.from_file(word_bpe_path())
    texts = {r["doc_id"]: r["text"] for r in rows}
    for r in got:
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert list(r["token_ids"]) == ids and r["n_tokens"] == len(ids)


def test_repeated_rows(spark):
    text = " ".join(f"word{i} of the" for i in range(40))
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (2, None, None, None, None), (3, text + " end", "en", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.exact(spark, corpus_pipeline.quality(spark, docs, SF), SF)
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
