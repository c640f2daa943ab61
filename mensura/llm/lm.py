"""LM scoring with a weighted backoff automaton over word n-grams, counted and delivered by blocks of documents.

Unigrams: p(w) = (c(w) + 1) / (N + V + 1). Above them each order k is smoothed by a prior of weight MU[k - 2] on the order
below: p(w | h) = (c(h w) + MU p(w | h')) / (c(h) + MU), h' being h without its first word; this sums to one. A text is
preceded by its end. As an automaton: a state for each history of up to ORDER - 1 words seen in training, the root for the
empty one; from a state an arc for each word seen after it, with the weight above, to the longest suffix of history and word
that is a state; and a failure arc of weight MU / (c(h) + MU) to the state of h'. A word without an arc falls back along
failure arcs; at the root each word seen has an arc, and one more takes unseen words back to the root. A text is traversed
once from left to right with the state carried from token to token; long texts in spans side by side, each of which begins
in the state that the words before it lead to.

The model grows with the corpus, so no task holds it. A scan packs documents into blocks of about BLOCK characters as they
come, so that repeated rows and hot sources spread as they lie in the files, and writes them as a table. A task sends, for
each block, its distinct n-grams as sorted hashes with their counts in training, packed by ranges of the hash; a task
for each range adds the counts up and sends each block back the totals in the order it asked for; a task with the block's
documents and totals builds the block's part of the automaton and traverses its documents. A block asks once for an n-gram,
so frequent words weigh no more than rare ones.

Sizes: a message holds the n-grams of one block, order and range; empty ones are not sent. There are a range for RANGE
characters of the corpus, MOST_RANGES at most, so messages grow with the corpus and not with its square: 30 GB make 7,500
blocks of up to 3 x 1,875 messages of about 300 n-grams, 1 TB 250,000 blocks of 3 x 4,096. Beyond 64 GB the ranges grow
instead; a range is added up in parts of PART n-grams, for which a task holds some 20 bytes an n-gram of its range (0.7 GB
at 1 TB; raise MOST_RANGES or the executors beyond). Of n n-grams in the corpus, a share of about n / 2 ** BITS has its hash in
common with another and is counted with it: one in 10 ** 7 at 30 GB, one in 10 ** 4 at 100 TB.

Defined results: null texts count as empty and score the end alone; a null doc_id counts as the empty string under the
checksum; repeated rows count and are scored each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .slots import Slots

BLOCK = 4_000_000  # characters in a block of documents
RANGE = 16_000_000  # characters of the corpus for each range of hashes
MOST_RANGES = 4096
PART = 2_000_000  # n-grams of a range that are added up at once
MU = (1000.0, 5.0)  # weights of the priors of orders two, three, ...: of those tried, near the best on held-out documents
BITS = 56  # of a hash
SPAN = 512  # tokens of a text that are traversed in one go
FOLDS, HELD_OUT = 7, 2
END = 0  # the end's number among a block's words; its hash is that of no word
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Numbers(dict):
    """Words by the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Tokens:
    """A block's documents as numbers of its words, and its distinct n-grams of each order.

    gram[k]: the number of the n-gram of order k + 1 that ends at each token, -1 where the text has none yet.
    """

    def __init__(self, texts: Sequence[bytes], order: int):
        number = Numbers({b" ": END})
        ids: list[np.ndarray] = []
        for text in texts:
            words = text.lower().split()  # of bytes: A-Z only, and just the contract's white space
            words.append(b" ")
            ids.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        self.lengths = np.array(list(map(len, ids)), np.int64)
        self.tokens = np.concatenate(ids) if ids else np.empty(0, np.int32)
        del ids
        self.starts = np.cumsum(self.lengths) - self.lengths
        at = np.arange(len(self.tokens)) - np.repeat(self.starts, self.lengths)  # place in the text
        self.words = len(number)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
        self.gram, self.prefix, self.suffix, self.word = [self.tokens.astype(np.int64)], [None], [None], [np.arange(len(number))]
        self.order, self.hashes = [], []
        for k in range(order):
            if k:
                # the n-gram before this token, then its word; the first token of a text follows an end
                before = np.full(len(self.tokens), -1, np.int64)
                before[1:] = self.gram[k - 1][:-1]
                before[at == 0] = END if k == 1 else -1
                own = np.flatnonzero(before >= 0)
                distinct, place, inverse = np.unique(before[own] * self.words + self.tokens[own], return_index=True, return_inverse=True)
                gram = np.full(len(self.tokens), -1, np.int64)
                gram[own] = inverse
                self.gram.append(gram)
                self.prefix.append(distinct // self.words)
                self.word.append(distinct % self.words)
                self.suffix.append(self.gram[k - 1][own[place]])
                left = lower[self.prefix[k]]
                mixed = (left ^ (left >> np.uint64(31))) * _MIX + hashes[self.word[k]]
                lower = (mixed ^ (mixed >> np.uint64(33))) * _MIX
            else:
                lower = hashes
            # n-grams in the order of their hashes, which both passes over a block share
            sent = lower >> np.uint64(64 - BITS)
            self.order.append(np.argsort(sent, kind="stable"))
            self.hashes.append(sent[self.order[k]])

    def counts(self, k: int, train: np.ndarray) -> np.ndarray:
        """Occurrences in training documents, in the order of hashes."""
        used = self.gram[k][np.repeat(train, self.lengths)]
        return np.bincount(used[used >= 0], minlength=len(self.order[k]))[self.order[k]]

    def unsort(self, k: int, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[self.order[k]] = values
        return out


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as bytes, by byte planes."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.array(planes.T, order="C").view("<u8").ravel()


def _blocks(batches: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    """Documents as they come -> blocks of them: (block, doc_id, train, lengths, texts, n_chars), the texts as one compressed string."""
    made, held, size = 0, [], 0

    def row() -> pd.DataFrame:
        nonlocal made, held, size
        raw = [t.encode("utf-8", "surrogatepass") for _, _, t in held]
        out = (TaskContext.get().partitionId() << 32 | made, [d for d, _, _ in held], [x for _, x, _ in held], list(map(len, raw)), zstandard.ZstdCompressor(level=3).compress(b"".join(raw)), size)
        made, held, size = made + 1, [], 0
        return pd.DataFrame([out], columns=["block", "doc_id", "train", "lengths", "texts", "n_chars"])

    for b in batches:
        ids = b["doc_id"].astype(object).where(b["doc_id"].notna(), None)
        for doc_id, train, text in zip(ids, b["train"], b["text"], strict=True):
            held.append((doc_id, bool(train), text))
            size += len(text)
            if size >= block:
                yield row()
    if held:
        yield row()


def _texts(block) -> list[bytes]:
    whole, ends = zstandard.ZstdDecompressor().decompress(block["texts"]), np.cumsum(block["lengths"]).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _sent(batches: Iterator[pd.DataFrame], ranges: int, order: int) -> Iterator[pd.DataFrame]:
    """Blocks -> their n-grams by order and range: (part, block, hashes, counts, tokens)."""
    edges = np.array([(i << BITS) // ranges for i in range(1, ranges)], np.uint64)
    for b in batches:
        for block in b.to_dict("records"):
            t, train = Tokens(_texts(block), order), np.array(block["train"], bool)
            rows, tokens = [], int(t.lengths[train].sum())
            for k in range(order):
                counts, hashes = t.counts(k, train), t.hashes[k]
                bounds = np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])
                for i in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
                    own = slice(bounds[i], bounds[i + 1])
                    rows.append((order * i + k, block["block"], pack(np.diff(hashes[own], prepend=np.uint64(0))), pack(counts[own]), tokens))
                    tokens = 0  # told once a block
            yield pd.DataFrame(rows, columns=["part", "block", "hashes", "counts", "tokens"])


def _added(rows: pd.DataFrame, order: int, part: int) -> pd.DataFrame:
    """One order's n-grams of a range from all blocks -> each block's totals; the first row has the distinct words in training."""
    hashes = [np.cumsum(unpack(h), dtype=np.uint64) for h in rows["hashes"]]
    totals = [unpack(c) for c in rows["counts"]]
    sizes = [len(h) for h in hashes]
    parts = max(1, math.ceil(sum(sizes) / part))
    low, high = min(int(h[0]) for h in hashes), max(int(h[-1]) for h in hashes) + 1
    edges = np.array([low + (high - low) * i // parts for i in range(parts)], np.uint64)
    cuts = [np.append(np.searchsorted(h, edges), len(h)) for h in hashes]
    seen = 0
    for i in range(parts):
        own = [slice(c[i], c[i + 1]) for c in cuts]
        distinct, at = np.unique(np.concatenate([h[s] for h, s in zip(hashes, own, strict=True)]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([c[s] for c, s in zip(totals, own, strict=True)]), len(distinct)).astype(np.uint64)
        seen += int((counts > 0).sum())
        begin = 0
        for c, s in zip(totals, own, strict=True):
            end = begin + s.stop - s.start
            c[s] = counts[at[begin:end]]
            begin = end
    out = pd.DataFrame({"block": rows["block"], "part": rows["part"], "totals": [pack(c) for c in totals]})
    out["distinct"], out["tokens"] = 0, rows["tokens"]
    out.iloc[0, out.columns.get_loc("distinct")] = seen if int(rows["part"].iloc[0]) % order == 0 else 0
    return out


class Automaton:
    """A block's part of the weighted backoff automaton. Weights are log10; state 0 is the root."""

    def __init__(self, t: Tokens, totals: list[np.ndarray], n: int, v: int, mu: Sequence[float]):
        """totals: occurrences in training by n-gram, for each order."""
        order = len(totals)
        p = (totals[0] + 1.0) / (n + v + 1.0)
        #: at the root a word's own number is its arc; unseen words share the last arc's weight and return to the root
        self.root = np.log10(p)
        self.state = []  # of each n-gram as a history; the root where it was not seen
        states = 1
        for k in range(order - 1):
            seen = totals[k] > 0
            number = np.zeros(len(seen), np.int64)
            number[seen] = np.arange(states, states + seen.sum())
            self.state.append(number)
            states += int(seen.sum())
        self.fail, self.fail_to = np.zeros(states), np.zeros(states, np.int64)
        keys, weights, targets = [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, np.int64)]
        for k in range(1, order):
            # a text's end is no history of more than one word, so a history was followed as often as it occurred
            histories, own = totals[k - 1], np.flatnonzero(totals[k - 1] > 0)
            at = self.state[k - 1][own]
            self.fail[at] = np.log10(mu[k - 1] / (histories[own] + mu[k - 1]))
            self.fail_to[at] = self.state[k - 2][t.suffix[k - 1][own]] if k > 1 else 0
            seen = totals[k] > 0
            prior = p[t.suffix[k]]
            before = histories[t.prefix[k]]
            p = np.where(seen, (totals[k] + mu[k - 1] * prior) / (before + mu[k - 1]), prior)
            keys.append(self.state[k - 1][t.prefix[k][seen]] << 32 | t.word[k][seen])
            weights.append(np.log10(p[seen]))
            targets.append(self.state[k][seen] if k < order - 1 else self.state[k - 1][t.suffix[k][seen]])
        self.arcs, self.weights, self.targets = Slots(np.concatenate(keys)), np.concatenate(weights), np.concatenate(targets)
        self.root_to = self.state[0] if order > 1 else np.zeros(len(self.root), np.int64)

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One token each: the weights on the way and the states reached."""
        weight, reached = np.zeros(len(states)), np.zeros(len(states), np.int64)
        todo, now = np.arange(len(states)), states
        while True:
            at_root = now == 0
            if at_root.any():
                own = todo[at_root]
                weight[own] += self.root[words[own]]
                reached[own] = self.root_to[words[own]]
                todo, now = todo[~at_root], now[~at_root]
            if not len(todo):
                return weight, reached
            arc = self.arcs.find(now << 32 | words[todo])
            hit = arc >= 0
            weight[todo[hit]] += self.weights[arc[hit]]
            reached[todo[hit]] = self.targets[arc[hit]]
            todo, now = todo[~hit], now[~hit]
            weight[todo] += self.fail[now]
            now = self.fail_to[now]

    def entry(self, t: Tokens, at: np.ndarray) -> np.ndarray:
        """The state after the tokens at these places: of the longest history that is one."""
        out = np.zeros(len(at), np.int64)
        for k in range(len(self.state)):
            gram = t.gram[k][at]
            found = np.where(gram >= 0, self.state[k][gram], 0)
            out = np.where(found > 0, found, out)
        return out

    def traverse(self, t: Tokens, span: int = SPAN) -> np.ndarray:
        """log10 of each document's probability."""
        spans = -(-t.lengths // span)
        doc = np.repeat(np.arange(len(t.lengths)), spans)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(spans) - spans, spans)
        begin = t.starts[doc] + nth * span
        length = np.minimum(span, t.lengths[doc] - nth * span)
        state = np.where(nth > 0, self.entry(t, np.maximum(begin - 1, 0)), self.root_to[END])
        by_length = np.argsort(-length, kind="stable")
        doc, begin, length, state = doc[by_length], begin[by_length], length[by_length], state[by_length]
        total = np.zeros(len(doc))
        running = np.searchsorted(-length, -np.arange(1, span + 1), side="right")  # spans that have a token at each place
        for i in range(span):
            m = running[i]
            if not m:
                break
            weight, state = self.step(state[:m], t.tokens[begin[:m] + i].astype(np.int64))
            total[:m] += weight
        return np.bincount(doc, total, len(t.lengths))


def _scored(n: int, v: int, mu: Sequence[float], order: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def score(blocks: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):
            return pd.DataFrame(columns=names)
        block = blocks.iloc[0]
        t = Tokens(_texts(block), order)
        totals = totals.sort_values("part")
        kinds = [totals["totals"][totals["part"] % order == k] for k in range(order)]
        found = [t.unsort(k, np.concatenate([unpack(x) for x in own]).astype(np.float64) if len(own) else np.empty(0)) for k, own in enumerate(kinds)]
        model = Automaton(t, found, n, v, mu)
        known = (found[0] > 0).astype(np.int64)
        values = (
            pd.Series(list(block["doc_id"]), dtype=object),
            ~np.array(block["train"], bool),
            t.lengths,
            np.add.reduceat(known[t.tokens], t.starts),
            np.add.reduceat(model.root[t.tokens], t.starts),
            model.traverse(t),
        )
        return pd.DataFrame(dict(zip(names, values, strict=True)))

    return score


def lm_scores(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mu: Sequence[float] = MU, block: int = BLOCK, hash_range: int = RANGE, most_ranges: int = MOST_RANGES, part: int = PART
) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. The order is len(mu) + 1."""
    order = len(mu) + 1
    train = F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % FOLDS != HELD_OUT
    kind = dict(docs.select(F.col(f"`{doc_id}`").alias("doc_id")).dtypes)["doc_id"]
    named = F.col(f"`{doc_id}`").cast("string" if kind == "bigint" else kind)  # among nulls, pandas would make fractions of longs
    rows = docs.select(named.alias("doc_id"), train.alias("train"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    inner = dict(rows.dtypes)["doc_id"]
    schema = f"block long, doc_id array<{inner}>, train array<boolean>, lengths array<int>, texts binary, n_chars long"
    blocks = cut(rows.mapInPandas(lambda it: _blocks(it, block), schema), "blocks")
    size = blocks.agg(F.sum("n_chars")).first()[0] or 0
    ranges = min(most_ranges, max(1, math.ceil(size / hash_range)))
    sent = blocks.select("block", "train", "lengths", "texts").mapInPandas(lambda it: _sent(it, ranges, order), "part long, block long, hashes binary, counts binary, tokens long")
    added = sent.groupBy("part").applyInPandas(lambda df: _added(df, order, part), "block long, part long, totals binary, distinct long, tokens long")
    totals = cut(added, "totals")
    n, v = (int(x or 0) for x in totals.agg(F.sum("tokens"), F.sum("distinct")).first())
    schema = f"doc_id {inner}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = blocks.groupBy("block").cogroup(totals.select("block", "part", "totals").groupBy("block")).applyInPandas(_scored(n, v, mu, order), schema)
    return scored.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op8_lm": op8_lm}
SQL: dict[str, str] = {}
