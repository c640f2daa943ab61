"""SimHash near-dedup over a Gray-order hierarchical index.

1. A task turns each whole text into a 64-bit fingerprint; equal fingerprints are one class (a partial aggregate).
2. Distinct fingerprints are routed to buckets. Two that differ in at most 2 bits agree in one of three blocks of
   bits, so each goes to three buckets. A bucket above HOT is routed again by three blocks of the bits left, twice at
   most: then 45 bits or more are fixed, and a bucket can hold 2 ** 19 distinct fingerprints at the very most.
3. Within a bucket, hamming.Index finds what lies within the distance and gives a spanning forest, never all pairs.
4. components() joins the forests; a class takes the smallest doc_id of its component, and rows get it by their fingerprint.

Hot keys: a fingerprint that a third of all rows share is one class; its rows are dealt over SALTS parts, aggregated by part
first, and get their component by a join on fingerprint and part. A component's links are dealt likewise. Joining raises an
error after components.MAX_ROUNDS rounds, which the logarithm of a component's size does not reach.

Defined results: null counts as empty; a text without words has fingerprint zero, which links like any other; repeated
rows and ties share one component; a null doc_id never names a component unless it has no other; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, with_longs
from .components import components
from .hamming import forest_of

SHINGLE = 3
SEED = 42
DISTANCE = 2
HOT = 8192  # fingerprints in a bucket before it is routed by more bits
SALTS = 64  # parts that the rows of one fingerprint are dealt over
_ROWS = 255  # summed in 8 bits without overflow


def _set_counts(digests: bytes) -> np.ndarray:
    """How many of the 8-byte digests have each bit set, most significant bit first."""
    total = np.zeros(64, np.int64)
    step = 8 * _ROWS * 64
    for at in range(0, len(digests), step):
        bits = np.unpackbits(np.frombuffer(digests[at : at + step], np.uint8)).reshape(-1, 64)
        full = len(bits) // _ROWS * _ROWS
        if full:
            total += np.add.reduce(bits[:full].reshape(-1, _ROWS, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        if full < len(bits):
            total += np.add.reduce(bits[full:], axis=0, dtype=np.uint8)
    return total


def fingerprint(text: str | None) -> int:
    """The unsigned SimHash of a text over 3-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and just the contract's white space
    if not words:
        return 0
    whole = b" ".join(words)
    n = len(words) - SHINGLE + 1
    if n < 2:
        shingles = [whole]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        shingles = [whole[a : b - 1] for a, b in zip([0, *ends], ends[SHINGLE - 1 :], strict=False)]
    digests = b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
    counts = _set_counts(digests)
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed long."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            prints = np.fromiter(map(fingerprint, b["text"]), np.uint64, len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": prints.view(np.int64)})

    return with_longs(rows, ["doc_id"], lambda rows: rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long"))


def _masks() -> list[int]:
    """Bits fixed by each route: a tree of degree 3, root first, children of p at 3 p + 1 to 3 p + 3."""
    masks, free = [0], [list(range(64))]
    for p in range(13):
        for j in range(3):
            n = len(free[p])
            block = free[p][j * n // 3 : (j + 1) * n // 3]
            masks.append(masks[p] | sum(1 << b for b in block))
            free.append([b for b in free[p] if b not in block])
    return masks


_MASKS = [m - (1 << 64) if m >> 63 else m for m in _masks()]


def _routed(rows: DataFrame, parent: Column) -> DataFrame:
    """(fp, path, part): each row below its parent's path thrice, with the bits that the path fixes."""
    rows = rows.select("fp", F.explode(F.array(*(parent * 3 + j for j in (1, 2, 3)))).alias("path"))
    mask = F.element_at(F.array(*(F.lit(m).cast("long") for m in _MASKS)), F.col("path") + 1)
    return rows.select("fp", F.col("path").cast("int").alias("path"), F.col("fp").bitwiseAND(mask).alias("part"))


def _gray(fp: Column) -> Column:
    return reduce(lambda c, s: c.bitwiseXOR(F.shiftrightunsigned(c, s)), (1, 2, 4, 8, 16, 32), fp)


def _index_links(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Batches sorted by path, part and Gray rank. A bucket that a batch leaves open waits for the next."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pd.DataFrame:
        a, b = forest_of(rows[:, 2].astype(np.int64).view(np.uint64), [rows[:, 0], rows[:, 1]], most)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    for batch in batches:
        rows = batch[["path", "part", "fp"]].to_numpy(np.int64)
        if not len(rows):
            continue
        if held and (rows[-1, :2] == held[0][0, :2]).all():
            held.append(rows)  # the open bucket goes on
            continue
        rows = np.concatenate([*held, rows])
        open_ = (rows[:, :2] == rows[-1, :2]).all(axis=1)
        first = len(rows) - int(np.argmin(open_[::-1])) if not open_.all() else 0
        held = [rows[first:]]
        if first:
            yield links(rows[:first])
    if held:
        yield links(np.concatenate(held))


def near_links(prints: DataFrame, most: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that span all that lie within the distance."""
    if not 0 <= most <= 2:
        raise ValueError("three blocks find at most 2 differing bits")
    found = []
    rows = _routed(prints, F.lit(0))
    for level in (1, 2, 3):
        counts = rows.groupBy("path", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = cut(rows.join(counts, ["path", "part"]), "routed")
        limit = hot if level < 3 else None
        found.append(rows if limit is None else rows.where(F.col("n") <= limit))
        above = rows.where(F.col("n") > hot) if limit is not None else None
        if above is None or above.isEmpty():
            break
        rows = _routed(above.select("fp", "path"), F.col("path"))
    ready = reduce(DataFrame.unionByName, found).select("path", "part", "fp", _gray(F.col("fp")).alias("rank"))
    ready = ready.repartition("path", "part").sortWithinPartitions("path", "part", "rank").drop("rank")
    return ready.mapInPandas(lambda it: _index_links(it, most), "a long, b long").distinct()


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    salted = fingerprints(docs, doc_id, text).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    rows = cut(salted, "prints")  # the salt is fixed once it is written
    parts = cut(rows.groupBy("fp", "salt").agg(F.min("doc_id").alias("least")), "parts")
    classes = cut(parts.groupBy("fp").agg(F.min("least").alias("least")), "classes")
    roots = components(near_links(classes.select("fp"), most, hot))
    classes = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # a component may hold a third of all fingerprints: it too is dealt over parts, and its least id returns to each of them
    classes = cut(classes.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")), "rooted")
    shares = classes.groupBy("root", "part").agg(F.min("least").alias("least"))
    whole = shares.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = shares.select("root", "part").join(whole, "root")
    named = classes.select("fp", "root", "part").join(whole, ["root", "part"]).select("fp", "component_id")
    named = parts.select("fp", "salt").join(named, "fp")
    return rows.join(named, ["fp", "salt"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op1_simhash": op1_simhash}
SQL: dict[str, str] = {}
