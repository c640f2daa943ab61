"""Ranked lexical search by presence masks.

The terms of the items are broadcast in blocks of items whose size is bounded (a stated query set against all documents). One scan
turns documents into blocks of postings: for each term of the items its documents and how often it occurs there, and for each
document its number of terms. Blocks are written once; N, L and the documents of each term are sums over them, taken before
anything is scored.

A task then reads a block and searches each item in it: the documents' bitmaps of the item's terms are set side by side, which
gives each document the mask of the terms it holds. Documents are grouped by mask. A mask's greatest score adds, for its terms,
weight times the greatest factor in the block. Masks are scored in descending order of it, a few at a time, until the tenth
best score that the task has for the item is above all that is left. A task hands on ten documents an item, so what is shuffled
is bounded by tasks, not documents, and the final ranking takes a task an item with ten rows a task.

Weights are floored doubles, all else is whole numbers of 64 bits; the one product that could leave them goes through Python's.

Defined results: null texts have no terms; items without terms give no row; items of one id are one item with the terms of all
its rows, null being an id; documents of one id are ranked each on its own; null ids come last among equal scores; texts of any
length go whole (a long one is a block of its own); empty tables give no row; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

TOP = 10
TERMS_A_BLOCK = 1_000_000  # terms of the items that are broadcast at once, on average half of it
DOCS_A_BLOCK = 2048
BYTES_A_BLOCK = 8 << 20
AT_ONCE = 64  # documents scored before the bound is looked at again, doubled each time

#: What parts terms is mapped to a space, A-Z to a-z; bytes from 128 on belong to terms as they are.
_TABLE = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b > 127 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term): the distinct terms of each item. Items are a stated set."""
    rows = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(terms(t))) for t in b.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("item"), pa.ListArray.from_arrays(pa.array(ends), pa.array([t for f in found for t in f], pa.binary()))], ["item", "terms"])

    schema = T.StructType([rows.schema["item"], T.StructField("terms", T.ArrayType(T.BinaryType()))])
    return rows.mapInArrow(run, schema).select("item", F.explode("terms").alias("term")).distinct()


def postings(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text", docs_a_block: int = DOCS_A_BLOCK, bytes_a_block: int = BYTES_A_BLOCK) -> DataFrame:
    """Blocks of documents: ids and lengths in terms, and for the vocabulary's terms their documents and counts (slices of `at` and
    `tf`, ending at `ends`)."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    schema = T.StructType([T.StructField("ids", T.ArrayType(rows.schema["doc_id"].dataType))])
    for name in ("lengths", "terms", "ends"):
        schema = schema.add(name, T.ArrayType(T.LongType()))
    schema = schema.add("at", T.BinaryType()).add("tf", T.BinaryType())
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def block(ids: list, lengths: list[int], found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        table = np.array(found, np.int64).reshape(-1, 3)  # term, document, count
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        names, counts = np.unique(table[:, 0], return_counts=True)
        lists = {"lengths": lengths, "terms": names.tolist(), "ends": np.cumsum(counts).tolist()}
        columns = [pa.array([ids], pa.list_(kind)), *(pa.array([v], pa.list_(pa.int64())) for v in lists.values())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([table[:, 1].astype(np.int32).tobytes()], pa.binary()), pa.array([table[:, 2].tobytes()], pa.binary())], ["ids", *lists, "at", "tf"])

    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(dict(rows.dtypes)["doc_id"])
    if kind is None:
        raise TypeError("document ids are whole numbers or strings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, lengths, found, size = shared.value.get, [], [], [], 0
        for b in batches:
            for i, whole in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                raw = whole.as_py()
                words = terms(raw)
                found += ((t, len(ids), n) for t, n in Counter(map(place, words)).items() if t is not None)
                ids.append(i)
                lengths.append(len(words))
                size += len(raw or b"")
                if len(ids) >= docs_a_block or size >= bytes_a_block:
                    yield block(ids, lengths, found)
                    ids, lengths, found, size = [], [], [], 0
        if ids:
            yield block(ids, lengths, found)

    return rows.mapInArrow(run, schema)


class Block:
    """The postings of a block, with the factor of each posting and each term's greatest one."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        at, tf = np.frombuffer(row["at"], np.int32), np.frombuffer(row["tf"], np.int64)
        lengths = row["lengths"]
        small = 90 * max(lengths) * n_docs < 1 << 62
        m = 10 + (90 * np.array(lengths, np.int64) * n_docs // n_terms if small else np.array([90 * n * n_docs // n_terms for n in lengths], np.int64))
        factor = 1_000_000_000 * tf // (1000 * tf + 8 * m[at])
        starts = [0, *row["ends"]][: len(row["ends"])]
        self.size = len(lengths)
        self.slices = {t: (at[a:b], factor[a:b], int(factor[a:b].max())) for t, a, b in zip(row["terms"], starts, row["ends"], strict=True)}

    def best(self, weights: dict[int, int], least: int, top: int) -> list[tuple[int, int]]:
        """(score, document) of the block's best documents, ties whole, none below `least`; weights: of the item's terms by place."""
        held = [(self.slices[t], w) for t, w in weights.items() if w > 0 and t in self.slices]
        if not held:
            return []
        words = np.zeros((len(held) + 63 >> 6, self.size), np.uint64)  # each document's mask of the terms that it holds
        for j, ((at, _, _), _) in enumerate(held):
            words[j >> 6, at] |= np.uint64(1 << (j & 63))
        if len(words) == 1:
            masks, group = np.unique(words[0], return_inverse=True)
            masks = masks[None]
        else:
            masks, group = np.unique(words, axis=1, return_inverse=True)
        bounds = np.zeros(masks.shape[1], np.int64)
        for j, ((_, _, most), w) in enumerate(held):
            bounds[(masks[j >> 6] >> np.uint64(j & 63) & np.uint64(1)).astype(bool)] += w * most
        order = (-bounds[group]).argsort(kind="stable")  # documents, by their mask's greatest score
        bounds = bounds[group[order]]
        place = np.empty(self.size, np.int64)
        place[order] = np.arange(self.size)
        kept: list[tuple[int, int]] = []
        begin, step = 0, AT_ONCE
        while begin < self.size and bounds[begin] >= max(least, 1):
            end = begin + step
            if end < self.size:  # whole masks
                end = int(np.searchsorted(-bounds, -bounds[end - 1], side="right"))
            scores = np.zeros(min(end, self.size) - begin, np.int64)
            for (at, factor, _), w in held:
                spot = place[at] - begin
                hit = (spot >= 0) & (spot < len(scores))
                scores[spot[hit]] += w * factor[hit]
            kept += [(int(scores[i]), int(order[begin + i])) for i in np.flatnonzero(scores >= max(least, 1))]
            if len(kept) > top:
                kept.sort(reverse=True)
                least = max(least, kept[top - 1][0])
                kept = [k for k in kept if k[0] >= least]
            begin, step = end, 2 * step
        return kept


def ranked(stored: DataFrame, items: dict[int, dict[int, int]], n_docs: int, n_terms: int, top: int = TOP) -> DataFrame:
    """(item, doc_id, score): ten documents an item from each task. items: place -> weight by term."""
    shared = stored.sparkSession.sparkContext.broadcast(items)
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", stored.schema["ids"].dataType.elementType), T.StructField("score", T.LongType())])
    last = lambda d: (d is None, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, tuple]]] = {i: [] for i in shared.value}  # (minus score, id's place in order), first ones first
        kind = None
        for b in batches:
            kind = b.schema.field("ids").type.value_type
            for k in range(b.num_rows):  # a block at a time
                row = {name: b.column(name)[k].as_py() for name in b.schema.names}
                block, ids = Block(row, n_docs, n_terms), row["ids"]
                for i, weights in shared.value.items():
                    have = best[i]
                    found = block.best(weights, -have[-1][0] if len(have) == top else 0, top)
                    if found:
                        best[i] = sorted(have + [(-s, last(ids[d])) for s, d in found])[:top]
        if kind is not None:
            rows = [(i, d[1], -s) for i, have in best.items() for s, d in have]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())], ["item", "doc_id", "score"])

    return stored.mapInArrow(run, schema)


def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _search(docs: DataFrame, rows: list, doc_id: str, text: str, top: int) -> DataFrame:
    """The ranking of one block of items; rows: (item, terms)."""
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
    stored = cut(postings(docs, vocabulary, doc_id, text), "postings")
    total = stored.select(F.explode("lengths").alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 1
    in_block = F.transform("ends", lambda e, i: e - F.when(i > 0, F.get("ends", i - 1)).otherwise(0))
    counted = stored.select(F.explode(F.arrays_zip(F.col("terms").alias("term"), in_block.alias("n"))).alias("t")).select("t.*").groupBy("term").agg(F.sum("n").alias("df"))
    weight = {r["term"]: _weight(n_docs, r["df"]) for r in counted.collect()}  # a row a term of the block of items
    items = {i: {vocabulary[bytes(t)]: weight.get(vocabulary[bytes(t)], 0) for t in r["terms"]} for i, r in enumerate(rows)}
    within = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    out = ranked(stored, items, n_docs, n_terms, top).withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top)
    names = docs.sparkSession.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", rows_kind(rows))]))
    return out.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a row an item of the block


def rows_kind(rows: list) -> T.DataType:
    return T.StringType() if any(isinstance(r["item"], str) for r in rows) else T.LongType()


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP, terms_a_block: int = TERMS_A_BLOCK) -> DataFrame:
    """One row per item and rank: item_id, rank, doc_id, score."""
    pairs = cut(item_terms(items, item_id, item_text), "items")
    n = max(1, math.ceil(2 * pairs.count() / terms_a_block))
    found = []
    for k in range(n):
        block = pairs.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).groupBy("item").agg(F.collect_list("term").alias("terms"))
        rows = block.collect()  # the items of a block, whose terms are bounded by terms_a_block
        if rows:
            found.append(cut(_search(docs, rows, doc_id, text, top), "ranked"))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs.select("doc_id", "text"), items.select("item_id", "text"))


_SPLIT = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "op12_lexical_search": f"""
WITH t AS MATERIALIZED (SELECT d, doc_id, n, term, count(*) AS tf FROM
    (SELECT d, doc_id, len(ts) AS n, unnest(ts) AS term FROM (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({_LOWER}, '{_SPLIT}') AS ts FROM documents)) GROUP BY ALL),
g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM (SELECT DISTINCT d, n FROM t)),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_SPLIT}')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), g),
s AS (SELECT item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
    FROM i JOIN w USING (term) JOIN t USING (term), g GROUP BY item_id, d, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM
    (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}"""
}
QUERIES = {"op12_lexical_search": op12_lexical_search}
