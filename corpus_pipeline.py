"""A corpus pipeline of five stages over documents: quality rules, exact dedup, SimHash near-dedup, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the folder that driver and
executors share and reads again as the next stage's docs. All but the last return the columns of documents; columns beyond
those are left behind by the first stage, and so can't clash with any. The near stage goes by id: rows of one id, where their
texts differ, stay or go as their components say, each under that id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm.bpe import bpe, word_bpe_path
from mensura.llm.common import cut, text_of
from mensura.llm.exact_dedup import exact_dedup
from mensura.llm.mixing import mix_sources
from mensura.llm.quality_rules import quality_rules
from mensura.llm.simhash import simhash_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _only(docs: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of docs whose keys are among those of kept."""
    named = kept.select(*(F.col(k).alias(f"k_{k}") for k in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys))
    # merged at every size: left to itself, the join would broadcast the keys of a small input only
    return docs.join(named.hint("merge"), same, "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_rules(docs).where("kept").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one row that stays: found by id and content, as ids may repeat."""
    verdicts = cut(exact_dedup(docs).select("doc_id", "content", "kept"), "exact-kept")
    rows = docs.withColumn("content", F.xxhash64(text_of("text")))
    out = _only(rows, verdicts.where("kept"), ["doc_id", "content"])
    if not verdicts.groupBy("doc_id", "content").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "content"])
    return out.select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component, the document of the smallest id."""
    kept = cut(simhash_components(docs).where("doc_id <=> component_id").select("doc_id"), "near-kept")
    return _only(docs, kept, ["doc_id"]).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its whole repetitions, and once more where the fractional one takes half of it or more."""
    taken = mix_sources(docs)
    times = taken.select(F.col("doc_id").alias("id"), (F.col("epochs") + (2 * F.col("more") >= F.greatest("size", F.lit(1))).cast("int")).cast("int").alias("times"))
    times = cut(times.groupBy("id").agg(F.max("times").alias("times")).where("times > 0"), "mix-times")
    rows = docs.join(times.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document, with the digests of its ids and of the decoded text."""
    return bpe(docs.select("doc_id", "source", "text"), word_bpe_path, with_ids=True, most_words=100_000).select("doc_id", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("mixing", mix), ("bpe", encode)]

#: BPE has no SQL form; tests/llm/test_pipeline.py holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
