"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree hold, for each symbol, the rank of its pair with the next one (and its place, so that ties go
left); the root holds the least. Each merge takes the root's pair and updates three leaves, each in logarithmic time,
until the root holds no pair. Words recur, so a task keeps the results of words it has met, in maps of bounded size, and
merges the new pieces of many texts together: a tree each, of one width, growing side by side as rows of an array. Long
pieces have a tree of their own, at some 50 bytes a symbol: a word of 20 million letters takes 1 GB and is merged whole.

The vocabulary is a file in the JSON format of the tokenizers library, given by path; it is read once a worker.

Defined results: null counts as empty, which has no tokens and decodes to the empty text; repeated rows are encoded
each; texts of any length are encoded whole; extra columns are ignored or make way for the results' names.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, with_longs
from .slots import Slots

MOST_WORDS = 400_000  # in each of a worker's maps
LONGEST_KEPT = 64  # characters of a word or piece that stays in the maps
CHARS_OUT = 500_000  # characters of text that a worker takes up at once
WIDEST = 256  # symbols from which a piece has a tree of its own
FEW = 16  # pieces of a width below which each has a tree of its own
CELLS = 1 << 20  # leaves of the trees that grow side by side
#: Unicode's White_Space, which the vocabulary's patterns call \s.
_SPACES = "\t-\r\x20\x85\xa0  -     　"
_WHITE = re.compile(f"[{_SPACES}]+")
#: Letters, numbers and capitals that Unicode 16 added to Python's tables: fixed values, as in the Unicode database.
_MORE_LETTERS = "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0"
_MORE_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
_MORE_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_MORE_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def _category(first: str, more: str) -> str:
    """A character set of all code points whose general category begins so."""
    found = [i for i in range(0x110000) if unicodedata.category(chr(i))[0] == first]
    ends = [(int(a, 16), int(b or a, 16)) for a, _, b in (x.partition("-") for x in more.split())]
    starts = [i for i, before in zip(found, [-1, *found], strict=False) if i != before + 1]
    stops = [i for i, after in zip(found, [*found[1:], -1], strict=True) if i + 1 != after]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in [*zip(starts, stops, strict=True), *ends])


def _pattern(source: str) -> re.Pattern:
    """The vocabulary's splitting pattern with its classes spelt out."""
    for name, chars in ((r"\p{L}", _category("L", _MORE_LETTERS)), (r"\p{N}", _category("N", _MORE_NUMBERS)), (r"\s", _SPACES)):
        source = re.sub(r"(?<!\[)" + re.escape(name) + r"(?![^\[]*\])", lambda _, n=name: f"[{n}]", source)
        source = source.replace(name, chars)
    return re.compile(source)


def lower(text: str) -> str:
    """Lower case letter by letter: no final sigma."""
    text = text.replace("Σ", "σ").lower()
    return text if text.isascii() else text.translate(_MORE_LOWER)


class SegmentTree:
    """Minimum over n leaves, the root at 1: eight bytes a node, so that a text of millions of symbols without a space fits too."""

    def __init__(self, leaves: np.ndarray, none: int):
        self.size = size = 1 << (len(leaves) - 1).bit_length()
        nodes = np.full(2 * size, none, np.int64)
        nodes[size : size + len(leaves)] = leaves
        at = size >> 1
        while at:
            np.minimum(nodes[2 * at : 4 * at : 2], nodes[2 * at + 1 : 4 * at : 2], out=nodes[at : 2 * at])
            at >>= 1
        self.nodes = array("q", nodes.tobytes())

    def update(self, a: int, b: int, c: int) -> None:
        """Mend the paths above three leaves a <= b <= c, together where they meet."""
        nodes = self.nodes
        a, b, c = a + self.size >> 1, b + self.size >> 1, c + self.size >> 1
        while a:
            x, y = nodes[2 * a], nodes[2 * a + 1]
            nodes[a] = x if x < y else y
            if b != a:
                x, y = nodes[2 * b], nodes[2 * b + 1]
                nodes[b] = x if x < y else y
            if c != b:
                x, y = nodes[2 * c], nodes[2 * c + 1]
                nodes[c] = x if x < y else y
            a, b, c = a >> 1, b >> 1, c >> 1


def pair_key(left, right):
    return left << 20 | right


class Ranks:
    """Ranks of pairs and the symbols that they merge into: a dictionary for one pair, a table for arrays of pairs."""

    def __init__(self, pairs: Iterable[tuple[int, int]], merged: Iterable[int]):
        self.of = {pair_key(a, b): r for r, (a, b) in enumerate(pairs)}
        self.merged = np.fromiter(merged, np.int64)
        self.none = len(self.merged)  # the rank of no pair: above all others
        self.table = Slots(np.fromiter(self.of, np.int64, len(self.of)))
        self.by_place = np.append(np.fromiter(self.of.values(), np.int64, len(self.of)), self.none)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; a symbol below zero is in none."""
        return self.by_place[self.table.find(pair_key(left, right))]


def merge(symbols: list[int], ranks: Ranks) -> list[int]:
    """Merges the leftmost pair of the lowest rank until there is none, over one tree. Leaves are rank * n + place."""
    n, get, merged = len(symbols), ranks.of.get, ranks.merged
    if n < 2:
        return symbols
    none = ranks.none * n  # above every pair's leaf, whatever the length
    ids = np.asarray(symbols, np.int64)
    tree = SegmentTree(np.append(ranks.find(ids[:-1], ids[1:]) * n + np.arange(n - 1), none), none)
    nodes, size, update = tree.nodes, tree.size, tree.update
    after, before, ids = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), array("q", ids.tobytes())
    while (top := nodes[1]) < none:
        rank, i = divmod(top, n)
        j = after[i]
        after[i] = k = after[j]
        ids[i] = now = int(merged[rank])
        ids[j] = -1
        nodes[size + j] = none
        if k < n:
            before[k] = i
            nodes[size + i] = get(now << 20 | ids[k], ranks.none) * n + i
        else:
            nodes[size + i] = none
        if (h := before[i]) >= 0:
            nodes[size + h] = get(ids[h] << 20 | now, ranks.none) * n + h
        else:
            h = i
        update(h, i, j)
    return [x for x in ids if x >= 0]


def merge_many(symbols: np.ndarray, ranks: Ranks) -> np.ndarray:
    """The same over one tree a row, all trees growing side by side. symbols: rows of equal width, a power of two, with -1 after
    each row's end, one at least; returned with -1 wherever a symbol went into another.

    The last place, which is never a symbol, stands before the first one and after the last, and is in no pair.
    """
    m, w = symbols.shape
    deep, none = w.bit_length() - 1, np.int64(ranks.none * w)
    ids = symbols.astype(np.int64)
    nodes = np.full((m, 2 * w), none, np.int64)
    nodes[:, w:-1] = ranks.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(m, w - 1) * w + np.arange(w - 1)
    at = w >> 1
    while at:
        nodes[:, at : 2 * at] = np.minimum(nodes[:, 2 * at : 4 * at : 2], nodes[:, 2 * at + 1 : 4 * at : 2])
        at >>= 1
    after, before = np.tile(np.minimum(np.arange(1, w + 1), w - 1), m), np.tile(np.arange(-1, w - 1) % w, m)
    ids, nodes = ids.ravel(), nodes.ravel()
    rows = np.arange(m)
    while True:
        top = nodes[rows * (2 * w) + 1]
        open_ = top < none
        rows, top = rows[open_], top[open_]
        if not len(rows):
            return ids.reshape(m, w)
        own, tree = rows * w, rows * (2 * w)
        rank, i = top >> deep, top & w - 1
        j = after[own + i]
        k = after[own + j]
        h = before[own + i]
        now = ranks.merged[rank]
        after[own + i] = k
        before[own + k] = i
        ids[own + i], ids[own + j] = now, -1
        pairs = ranks.find(np.concatenate([now, ids[own + h]]), np.concatenate([ids[own + k], now])) * w
        leaf = np.concatenate([i, h, j])
        trees = np.concatenate([tree, tree, tree])
        nodes[trees + leaf + w] = np.concatenate([pairs + leaf[: len(pairs)], np.full(len(rows), none)])
        leaf += w
        for _ in range(deep):
            leaf >>= 1
            below = trees + 2 * leaf
            nodes[trees + leaf] = np.minimum(nodes[below], nodes[below + 1])


def _byte_letters() -> list[str]:
    """The printable letter for each byte in byte-level vocabularies: itself where printable in Latin-1, else 256 onwards."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


Found = tuple[int, str, str]  # tokens, their ids and their strings, both joined by spaces


class Codec:
    """A vocabulary with its normaliser (NFC, lower case), its splitting pattern, byte letters and word ends."""

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = Ranks([(self.vocab[a], self.vocab[b]) for a, b in pairs], [self.vocab[a + b] for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        longest = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.specials = re.compile(f"({'|'.join(longest)})")
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = _pattern(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        letters = _byte_letters()
        self.inner, self.last = (np.array([self.vocab[x + end] for x in letters], np.int64) for end in ("", self.suffix))
        self.most = most_words // 2  # a map that is full becomes the old one, whose words move over when they are met again
        self.pieces: dict[str, Found] = {s: (1, str(i), s) for s, i in self.special.items()}
        self.words: dict[bytes, Found] = {}
        self.old: dict[bytes, Found] = {}

    def found(self, ids: list[int]) -> Found:
        strings = [self.token[i] for i in ids]
        return len(ids), " ".join(map(str, ids)), " ".join(strings)

    def learn_pieces(self, pieces: list[str]) -> None:
        """Merge pieces that the pattern has cut out, those of like length together."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        widths = np.int64(1) << np.ceil(np.log2(np.minimum(lengths, WIDEST) + 1)).astype(np.int64)
        for w in np.unique(widths).tolist():
            group = np.flatnonzero(widths == w)
            if w > WIDEST or len(group) < FEW:
                for g in group.tolist():
                    self.pieces[pieces[g]] = self.found(merge(symbols[ends[g] - lengths[g] : ends[g]].tolist(), self.ranks))
                continue
            for at in range(0, len(group), CELLS // w):
                part = group[at : at + CELLS // w]
                inside = np.arange(w) < lengths[part][:, None]
                rows = np.full((len(part), w), -1, np.int64)
                rows[inside] = symbols[np.repeat(ends[part] - lengths[part], lengths[part]) + np.nonzero(inside)[1]]
                done = merge_many(rows, self.ranks)
                kept = done >= 0
                ids, stops = done[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
                for g, a, b in zip(part.tolist(), [0, *stops], stops, strict=False):
                    self.pieces[pieces[g]] = self.found(ids[a:b])

    def cut(self, word: str) -> str | list[str]:
        """The piece, or the pieces, of a word between ASCII white space. Other white space and special tokens cut it first."""
        if not word.isascii():
            if len(parts := _WHITE.split(word)) > 1:
                return [p for w in parts if w for p in self.several(w)]
            word = unicodedata.normalize("NFC", word)
        plain = word.lower() if word.isascii() else lower(word)
        return plain if plain.isalpha() else self.pattern.findall(plain)

    def several(self, word: str) -> list[str]:
        cut = self.cut(word)
        return [cut] if isinstance(cut, str) else cut

    def learn(self, words: Iterable[bytes]) -> None:
        """Put the results of words into the map."""
        single, several = {}, {}
        for w in words:
            word = w.decode("utf-8", "surrogatepass")
            if "<" in word and self.specials.search(word):
                cut = [p for span in self.specials.split(word) if span for p in ([span] if span in self.special else self.several(span))]
            else:
                cut = self.cut(word)
            if isinstance(cut, str):
                single[w] = cut
            else:
                several[w] = cut
        new = set(single.values())
        for cut in several.values():
            new.update(cut)
        pieces = self.pieces
        if new := new - pieces.keys():
            self.learn_pieces(list(new))
        own = self.words
        for w, piece in single.items():
            own[w] = pieces[piece]
        for w, cut in several.items():
            n, ids, strings = zip(*[pieces[p] for p in cut], strict=True) if cut else ((), (), ())
            own[w] = sum(n), " ".join(ids), " ".join(strings)

    def results(self, texts: list[str]) -> Iterator[Found]:
        """Of each text, whole. What several of the texts share is merged once; words met before are in the map."""
        cut = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        known = [list(map(self.words.get, words)) for words in cut]
        missed = {w for words, found in zip(cut, known, strict=True) for w, f in zip(words, found, strict=True) if f is None}
        new = set(missed)
        for w in self.old.keys() & missed:
            self.words[w] = self.old[w]
            new.discard(w)
        collects = gc.isenabled()
        gc.disable()  # nothing learnt is a cycle, and there is much of it to look through
        self.learn(new)
        if collects:
            gc.enable()
        get = self.words.__getitem__
        for words, found in zip(cut, known, strict=True):
            n, ids, strings = zip(*[f or get(w) for w, f in zip(words, found, strict=True)], strict=True) if words else ((), (), ())
            yield sum(n), " ".join(ids), " ".join(strings)
        self.forget(missed)

    def forget(self, last: set[bytes]) -> None:
        """Keep the maps bounded; last: the words learnt last, of which long ones go at once."""
        if long := [w for w in last if len(w) > LONGEST_KEPT]:
            for w in long:
                del self.words[w]
            self.pieces = {p: f for p, f in self.pieces.items() if len(p) <= LONGEST_KEPT}
        if len(self.words) > self.most:
            self.words, self.old = {}, self.words
        if len(self.pieces) > self.most:
            self.pieces = {s: (1, str(i), s) for s, i in self.special.items()}

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.results([text]) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings joined by spaces: the vocabulary file names no decoder. Ids without a token are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)


@lru_cache(maxsize=4)
def codec(path: str, most_words: int = MOST_WORDS) -> Codec:
    return Codec(path, most_words)


def bpe(docs: DataFrame, path: str | Callable[[], str], text: str = "text", with_ids: bool = False, with_text: bool = False, most_words: int = MOST_WORDS) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256; on request token_ids (array) and decoded (the decoded text).

    path: of the vocabulary on the workers, or a function that gives it there. most_words: in a worker's map of words met,
    some 350 bytes each; it bounds memory and changes no result.
    """
    new = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    new |= {"token_ids": "array<int>"} if with_ids else {}
    new |= {"decoded": "string"} if with_text else {}
    kept = [c for c in docs.columns if c.lower() not in new]
    ready = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias("__text"))
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path() if callable(path) else path, most_words)
        for batch in batches:
            ends = batch["__text"].str.len().fillna(0).cumsum() // CHARS_OUT
            for _, b in batch.groupby(ends.to_numpy(), sort=False):  # pieces of bounded size, so that ids never pile up
                yield encoded(c, b)

    def encoded(c: Codec, b: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {k: [] for k in new}
        for n, ids, decoded in c.results([t or "" for t in b["__text"]]):
            out["n_tokens"].append(n)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            if with_ids:
                out["token_ids"].append(np.fromstring(ids, np.int32, sep=" "))
            if with_text:
                out["decoded"].append(decoded)
        return b.drop(columns="__text").assign(**out)

    def work(rows: DataFrame) -> DataFrame:
        return rows.mapInPandas(run, beside(rows, {k: F.lit(None).cast(v) for k, v in new.items()}).drop("__text").schema)

    return with_longs(ready, kept, work)


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe(docs, word_bpe_path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op2_bpe": op2_bpe}
SQL: dict[str, str] = {}
