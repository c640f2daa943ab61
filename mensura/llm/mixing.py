"""Mixing sources to target weights by capped water-filling.

Sources share a budget by weight. A source whose share is above max_epochs times its size is clamped there, and
the excess is shared again by weight, until none is above. With r = cap / weight, the clamped sources are those
of the smallest r, so one pass over the sources in this order (a few rows each, aggregates of all documents)
gives the fixed point of the repeated sharing.

A source then takes every document floor(target / size) times, and once more the documents that come first in
a seeded order of its documents until the target is met to the word; the last of them is taken in part. The
order is a hash of seed and id. To place a document in it without one task for one source, hashes are dealt
into BUCKETS ranges: a running sum within (source, range) plus the summed ranges before it.

Sizes are taken in one scan, which is written once. Windows over sources hold a row a source; sources are few. A range of a
hot source is one task's: BUCKETS, a parameter and a power of 16, bounds it at the source's rows / BUCKETS.

Only DataFrame functions are used. Defined results: a null text has size 0; null is a source of its own, last
in order; empty sources get target 0; ties in hash order fall back to id and size; repeated rows are separate
documents; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, text_of

MAX_EPOCHS = 3
SEED = 7
BUCKETS = 4096  # three hex digits of the hash


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    key = F.md5(F.concat(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.lit(f":{seed}")))
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"),
        key.alias("key"),
    )


def default_weight(place: Column) -> Column:
    """1, 2, 3, repeating, by the place of a source from 1."""
    return ((place - 1) % 3 + 1).cast("double")


def targets(sources: DataFrame, weight=default_weight, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources: (source, source_size), one row each. Adds target, by water-filling."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    rows = (
        sources.select("source", "source_size", F.row_number().over(by_name).alias("place"))
        .select("*", weight(F.col("place")).alias("weight"), (F.col("source_size") * float(max_epochs)).alias("cap"))
        .select("*", F.sum("source_size").over(everything).alias("budget"), F.sum("weight").over(everything).alias("weights"))
    )
    before = W.orderBy("ratio", "place").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    rows = rows.select(
        "*",
        ((F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"),
    )
    # the water level is that of the first source not clamped; clamped ones lie below it
    open_level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "place", "level"))).over(everything)["level"]
    return rows.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.coalesce(open_level, F.lit(float("inf")))).alias("target"))


def mixed(rows: DataFrame, max_epochs: int = MAX_EPOCHS, buckets: int = BUCKETS) -> DataFrame:
    """rows of sized() with source_size, target and taken."""
    bucket = F.substring("key", 1, round(math.log(buckets, 16)))
    rows = rows.withColumn("bucket", bucket)
    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    total = targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), max_epochs=max_epochs)
    parts = parts.select(
        "source",
        "bucket",
        F.coalesce(F.sum("part").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
    )
    # one small row for each source and range: what a document needs to know of all the others
    facts = parts.join(total.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    facts = facts.withColumnsRenamed({"source": "f_source", "bucket": "f_bucket"})
    within = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(facts, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("bucket") == F.col("f_bucket")))
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target")).cast("long") - whole * size
    more = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("offset") + F.col("ahead"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", whole.alias("epochs"), more.cast("long").alias("more"), (whole * F.col("size") + more).cast("long").alias("taken"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, max_epochs: int = MAX_EPOCHS, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs (whole repetitions), more (words of the fractional one), taken."""
    return mixed(cut(sized(docs, doc_id, text, source, seed), "sizes"), max_epochs, buckets)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op4_mix_sources": rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}') AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM d GROUP BY source),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS budget, sum(weight) OVER () AS weights FROM s),
l AS (SELECT *, cap / weight AS ratio,
    (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (weights - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM c),
o AS (SELECT min(level) FILTER (WHERE ratio >= level) AS any_level, arg_min(level, ratio) FILTER (WHERE ratio >= level) AS level FROM l),
t AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT level FROM o), 'inf'::DOUBLE)) AS target FROM l),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS e,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(e * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - e * source_size - ahead)) AS BIGINT) AS taken FROM r"""
}
QUERIES = {"op4_mix_sources": op4_mix_sources}
