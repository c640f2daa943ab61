"""BPE against the tokenizers library, which the operator itself does not use."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mensura.llm import bpe as module
from mensura.llm.bpe import Codec, Ranks, SegmentTree, bpe, codec, merge, merge_many, op2_bpe, word_bpe_path

LIB = Tokenizer.from_file(word_bpe_path())
LIB.no_padding()
LIB.no_truncation()


def want(text):
    ids = LIB.encode(text or "", add_special_tokens=False).ids
    return ids, LIB.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize(
    "text",
    ["", " \n\t", "Hello, World's 123 don't", "ΑΣ ΣΑΣ ὈΔΥΣΣΕΎΣ", "été Å Å", "a\x1cb\x85c d　e\xa0f", "x<|endoftext|>y <|startoftext|>", "İstanbul ǅ ß ﬁ", "日本語 🚀👩‍🚀 ‍", "a" * 3000, "ab" * 500 + " " + "é" * 999, "\x00\x01 ### $$$", "'S 'RE 'll'd", "a<|endoftext|>b\u2003<|ENDOFTEXT|><|startoftext|><|endoftext|>É\x85<", "\u3000 \xa0"],
)
def test_against_library(text):
    ids, decoded = want(text)
    assert codec(word_bpe_path()).encode(text) == ids
    assert codec(word_bpe_path()).decode(ids) == decoded


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert codec(word_bpe_path()).encode(text) == want(text)[0]


def test_long_unbroken_text():
    """A word of 3 million letters, and lengths about the widths at which pieces get trees of their own."""
    text = ("abcdefghij" * 7 + "The" * 11 + "é") * 29_000
    assert len(text) > 3_000_000 and codec(word_bpe_path()).encode(text) == want(text)[0]
    for n in (*range(1, 20), *range(61, 67), *range(253, 259), 511, 513):
        word = ("thequickbrown" * 50)[:n]
        assert codec(word_bpe_path()).encode(word) == want(word)[0], n


def test_maps_stay_bounded():
    """Results are the same when words are dropped from the maps and learnt anew."""
    c = Codec(word_bpe_path(), 200)
    for k in range(30):
        text = " ".join(f"word{(i * k) % 37} Ünïque{i % (k + 1)} x{'y' * (i % 90)}" for i in range(60))
        assert [int(i) for _, ids, _ in c.results([text, text]) for i in ids.split()] == 2 * want(text)[0]
        assert len(c.words) <= 100 and len(c.old) <= 100 + 60 and len(c.pieces) <= 100
        assert all(len(w) <= module.LONGEST_KEPT for w in (*c.words, *c.pieces))


def plainly(symbols, ranks):
    plain = list(symbols)
    while found := min(((ranks[p][0], i) for i, p in enumerate(zip(plain, plain[1:], strict=False)) if p in ranks), default=None):
        i = found[1]
        plain[i : i + 2] = [ranks[plain[i], plain[i + 1]][1]]
    return plain


@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=31), min_size=1, max_size=9), st.permutations(range(16)))
@settings(max_examples=200, deadline=None)
def test_merge_order(rows, order):
    pairs = sorted((r, (i // 4, i % 4), (i * 7) % 4) for i, r in zip(range(0, 16, 2), order, strict=False))
    table = {p: (r, m) for r, (_, p, m) in enumerate(pairs)}
    ranks = Ranks([p for _, p, _ in pairs], [m for _, _, m in pairs])
    matrix = np.full((len(rows), 32), -1)
    for i, row in enumerate(rows):
        matrix[i, : len(row)] = row
    for row, got in zip(rows, merge_many(matrix, ranks), strict=True):
        assert merge(row, ranks) == [x for x in got.tolist() if x >= 0] == plainly(row, table)


def test_ranks():
    """Every pair of the vocabulary and none other is found, by arrays as well."""
    r = codec(word_bpe_path()).ranks
    left, right = np.array([divmod(k, 1 << 20) for k in r.of]).T
    assert r.find(left, right).tolist() == list(r.of.values())
    assert set(r.find(left + (1 << 17), right).tolist()) == {r.none}


@given(st.lists(st.integers(0, 99), min_size=3, max_size=30), st.data())
def test_tree(leaves, data):
    t = SegmentTree(np.array(leaves), 100)
    for _ in range(5):
        a, b, c = sorted(data.draw(st.lists(st.integers(0, len(leaves) - 1), min_size=3, max_size=3)))
        for x in (a, b, c):
            leaves[x] = t.nodes[t.size + x] = data.draw(st.integers(0, 99))
        t.update(a, b, c)
        assert t.nodes[1] == min(leaves)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op2_bpe(spark, sf).collect():
        ids, decoded = want(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_corners(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "Ab ab", None)], "doc_id long, text string, n_tokens int")
    out = bpe(docs, word_bpe_path, with_ids=True, with_text=True).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], list(r["token_ids"]), r["decoded"]) for r in out) == [(0, 2, *want("Ab ab")), (1, 0, [], ""), (1, 0, [], "")]
    assert out[0]["text"] is None or out[0]["text"] == "Ab ab"
    assert bpe(docs.limit(0), word_bpe_path).count() == 0
