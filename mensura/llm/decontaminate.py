"""Benchmark decontamination: windows of the test items in a broadcast hash set, verified hits, spans or documents removed.

Items are cut into windows of ten words (an item of fewer words is one window). Their hashes set bits of a bitmap that goes to
every task within the plan. One scan of the documents hashes each window of each text, in place, and keeps those whose two bits
are set: a document without any is done, and no window of it ever becomes a row. What is left (hits and about one window in a thousand)
is written, and verified word for word by a broadcast join with the items' windows, in blocks of bounded size. Rows of a
document, found by its row number, are then merged: overlapping hits count each word once.

A passage that a third of all documents share is a window of the broadcast side; documents meet only by their own row number, so
no key is hot.

Only DataFrame functions are used. The bitmap has BITS_A_WINDOW bits a window, at most 2 ** MOST_BITS; with more windows it lets more
through to the exact join, which decides alone, so results are the same at every size.

Defined results: null texts have no words; null items give no window; items of one id are one item; a null item id is written as
the empty text; rows of one doc_id are documents each on its own; an occurrence counts at any place, overlapping others and itself;
empty tables give no row (no items: nothing is hit); extra columns stay where rows are removed, and are ignored in the
report. A text is split by Spark's own functions in one row, so it takes some 30 times its size in memory.
"""

from __future__ import annotations

import json
import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free, text_of

WINDOW = 10
BITS_A_WINDOW = 64
MOST_BITS = 26  # of 64 million bits, as 8 MB of whole numbers in the plan
BROADCAST_BYTES = 64 << 20  # of windows with their items, that are broadcast at once
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # of a text as it is; lower-cased, it is the contract's


def words_of(text: Column) -> Column:
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(_WORD), F.lit(0))


def _next(array: Column, at: Column, size: int) -> list[Column]:
    """`size` elements from a place on. slice() would copy the whole array for each window."""
    return [F.get(array, at + k) for k in range(size)]


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(size, gram, items): each distinct window, its words joined by a space, and the sorted ids of its items as text."""
    rows = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), words_of(text_of(text)).alias("w"))
    size = F.least(F.size("w"), F.lit(window))
    rows = rows.where(F.size("w") > 0).select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("at"))
    rows = rows.select("item", "size", F.concat_ws(" ", *_next(F.col("w"), F.col("at"), window)).alias("gram"))  # of a short item there are no more words
    return rows.groupBy("size", "gram").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _spots(hash_: Column, bits: int) -> tuple[Column, Column]:
    """Two of 2 ** bits bits by a hash: its high and its low ones."""
    return F.shiftrightunsigned(hash_, 64 - bits), hash_.bitwiseAND((1 << bits) - 1)


def _bitmap(windows: DataFrame, bits: int, window: int) -> Column:
    """The bits of all windows as a constant array of longs."""
    words = F.transform(F.split("gram", " "), lambda w: F.xxhash64(w))
    hash_ = F.xxhash64(*_next(F.col("h"), F.lit(0), window))  # nulls, behind a short window, leave a hash as it is
    spots = windows.select(words.alias("h")).select(F.explode(F.array(*_spots(hash_, bits))).alias("bit"))
    cells = spots.groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    filled = [0] * (1 << bits - 6)
    for r in cells.collect():  # at most as many rows as the bitmap has cells, whatever the number of windows
        filled[r["cell"]] = r["mask"]
    return F.from_json(F.lit(json.dumps(filled)), "array<bigint>")  # a constant: read once, when the plan is made


def _found(hashes: Column, size: int, bitmap: Column, bits: int) -> Column:
    """Where windows of that size begin that the bitmap has, from 0. hashes: of the words."""
    def known(at: Column) -> Column:
        hash_ = F.xxhash64(*_next(hashes, at, size))
        set_ = lambda spot: F.getbit(F.get(bitmap, F.shiftright(spot, 6).cast("int")), spot.bitwiseAND(63).cast("int")) == 1
        return reduce(lambda a, b: a & b, map(set_, _spots(hash_, bits)))

    return F.when(F.size(hashes) >= size, F.filter(F.sequence(F.lit(0), F.size(hashes) - size), known)).otherwise(F.array().cast("array<int>"))


def hits(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs to keep (None: all), which are written once, and three more: _words (how many), _spans (array of the struct
    start, end: words of merged hits, from 0, end exclusive) and _items (sorted ids)."""
    keep = docs.columns if keep is None else keep
    if clash := {"_words", "_spans", "_items"} & {c.lower() for c in keep}:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    windows = cut(item_windows(items, item_id, item_text, window), "windows")
    facts = windows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("gram") + 24 + 24 * F.size("items") + F.octet_length(F.array_join("items", ""))).alias("bytes"), F.sort_array(F.collect_set("size")).alias("sizes")).first()
    bits = min(MOST_BITS, max(12, (facts["n"] * BITS_A_WINDOW).bit_length()))
    bitmap = _bitmap(windows, bits, window)

    row, found, words, hashes, other = free(docs, "row", "found", "words", "hashes", "other")
    rows = docs.select("*", words_of(text_of(text)).alias(words))
    rows = rows.select("*", F.transform(F.col(words), lambda w: F.xxhash64(w)).alias(hashes))
    gram = lambda at, size: F.struct(at.alias("at"), F.lit(size).alias("size"), F.concat_ws(" ", *_next(F.col(words), at, size)).alias("gram"))
    grams = lambda size: F.transform(_found(F.col(hashes), size, bitmap, bits), lambda at: gram(at, size))
    all_found = F.concat(*map(grams, facts["sizes"])) if facts["sizes"] else F.lit(None).cast("array<struct<at:int,size:int,gram:string>>")
    rows = rows.select(*(F.col(f"`{c}`") for c in keep), F.size(words).cast("long").alias("_words"), all_found.alias(found), F.monotonically_increasing_id().alias(row))
    rows = cut(rows, "scanned")  # row numbers are fixed once written

    shares = max(1, math.ceil(2 * (facts["bytes"] or 0) / broadcast_bytes))
    seen = rows.where(F.size(found) > 0).select(F.col(row).alias("row"), F.explode(found).alias("f")).select("row", "f.*")
    share = lambda c, k: F.pmod(F.xxhash64("gram"), F.lit(shares)) == k
    sure = reduce(DataFrame.unionByName, (seen.where(share("gram", k)).join(F.broadcast(windows.where(share("gram", k))), ["size", "gram"]) for k in range(shares)))
    words_hit = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("size") - 1)))))
    per_row = sure.groupBy("row").agg(words_hit.alias("hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"))
    per_row = per_row.select(F.col("row").alias(other), _spans_of(F.col("hit")).alias("_spans"), "_items")
    out = rows.drop(found).join(per_row.hint("shuffle_hash"), F.col(row) == F.col(other), "left")
    none = lambda kind: F.array().cast(kind)
    return out.select(
        *(F.col(f"`{c}`") for c in keep), "_words",
        F.coalesce("_spans", none("array<struct<start:int,end:int>>")).alias("_spans"), F.coalesce("_items", none("array<string>")).alias("_items"),
    )


def _spans_of(places: Column) -> Column:
    """Runs of neighbours among sorted places: where the one before is missing, and where the one after is."""
    first = F.filter(places, lambda p, i: (i == 0) | (F.get(places, i - 1) < p - 1))
    last = F.filter(places, lambda p, i: (i == F.size(places) - 1) | (F.get(places, i + 1) > p + 1))
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))


def report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = hits(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), items, keep=["doc_id"], **settings)
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.select(
        "doc_id", F.col("_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"),
    )


def drop_documents(docs: DataFrame, items: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The documents in which no window occurs."""
    return hits(docs, items, text, **settings).where(F.size("_spans") == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_spans(docs: DataFrame, items: DataFrame, text: str = "text", **settings) -> DataFrame:
    """All documents, without the words that are hit and what stands between two of one span; texts without a hit stay as they are."""
    rows = hits(docs, items, text, **settings)
    whole = text_of(text)
    words, gaps = F.regexp_extract_all(whole, F.lit(_WORD), F.lit(0)), F.split(whole, _WORD, -1)
    # a gap stands before each word and after the last; of a span, the gap before its first word stays
    spans, pieces = F.col("_spans"), F.zip_with(gaps, words, lambda g, w: F.concat(g, F.coalesce(w, F.lit(""))))
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.size(gaps)))
    stretches = F.zip_with(begins, ends, lambda a, b: F.concat(F.array_join(F.slice(pieces, a + 1, b - a), ""), F.coalesce(F.get(gaps, b), F.lit(""))))
    cleaned = F.when(F.size(spans) > 0, F.array_join(stretches, "")).otherwise(F.col(f"`{text}`"))
    return rows.select(*(cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return report(docs, items.select("item_id", "text"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op13_decontaminate": f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS gram FROM
    (SELECT item, w, least(len(w), {WINDOW}) AS size, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram FROM
    (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM g) WHERE len(w) >= size)),
h AS MATERIALIZED (SELECT r, i, p.size, item FROM p JOIN g ON p.size = g.size AND p.gram = g.gram),
n AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS word FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)"""
}
QUERIES = {"op13_decontaminate": op13_decontaminate}
