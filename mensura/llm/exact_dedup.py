"""Exact dedup by progressive refinement: length, then a prefix hash, then the full hash.

One scan turns each text into a small row: its length without white space, a hash of its first characters, its
length in code points. Groups are refined on these small rows only: rows alone in their length are done, then
rows alone in (length, prefix hash); only the rest are grouped by the full hash. The full hash is taken in the
same scan (a digest beside the text costs less than moving the text to meet the survivors, and the result
carries the digest of every row).

Hot groups: rows carry a salt. A key is aggregated by salt first, and its facts return to the rows by a join on key
and salt, so the rows of a group that holds a third of them all are dealt over SALTS parts and never meet in one task.
SALTS is a parameter: a part of a group of n rows holds n / SALTS of them.

Defined results: null counts as empty, and all texts without a word are one group; of a group exactly one row stays, ties in
length go to the smallest id, a null id behind any other, and ties in both to the smaller content hash, then to any one of
the rows, which are then alike; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, text_of

PREFIX = 64  # characters under the prefix hash
SALTS = 64  # parts that the rows of one key are dealt over


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One small row per row: content (a hash of the text as it is), n_code, n_bare, prefix, sha."""
    whole = text_of(text)
    bare = F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(whole).alias("content"), F.length(whole).alias("n_code"), bare.alias("bare"))
    return rows.select(
        "doc_id",
        "content",
        "n_code",
        F.length("bare").alias("n_bare"),
        F.xxhash64(F.substring("bare", 1, PREFIX)).alias("prefix"),
        F.sha2(F.col("bare"), 256).alias("sha"),
    )


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each key with several rows, a row for each of its salts: size of the whole group and the row that comes first in it."""
    order = ((-F.col("n_code")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("content").alias("content"), F.col("row").alias("row"))
    parts = rows.groupBy(*keys, "salt").agg(F.count(F.lit(1)).alias("part"), F.min(F.struct(*order)).alias("part_first"))
    whole = parts.groupBy(*keys).agg(F.sum("part").alias("size"), F.min("part_first").alias("first")).where("size > 1")
    return parts.select(*keys, "salt").join(whole, keys)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, content (xxhash64 of the text)."""
    numbered = signatures(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id())
    rows = cut(numbered.withColumn("salt", F.pmod("row", F.lit(salts)).cast("int")), "exact")  # numbers are fixed once written
    left = rows
    for level in (["n_bare"], ["n_bare", "prefix"]):
        left = left.join(_shared(left, level), [*level, "salt"], "left_semi")
    out = rows.join(_shared(left, ["sha"]), ["sha", "salt"], "left")
    alone = F.col("size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "content",
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("content")


SQL = {
    "op9_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents),
k AS (SELECT doc_id, h, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS c, row_number() OVER w = 1 AS kept
    FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(c AS BIGINT) AS group_size, kept, h AS text_sha256 FROM k"""
}
QUERIES = {"op9_exact_dedup": op9_exact_dedup}
