"""What all operators share."""

import pytest

from mensura.llm.bpe import bpe, word_bpe_path
from mensura.llm.chat import chat_digests
from mensura.llm.common import shared_dir
from mensura.llm.exact_dedup import exact_dedup
from mensura.llm.html_text import extract
from mensura.llm.license_scan import license_scan
from mensura.llm.lm import lm_scores
from mensura.llm.mixing import mix_sources
from mensura.llm.pii import pii_spans
from mensura.llm.quality_rules import quality_rules
from mensura.llm.simhash import simhash_components

IDS = {None, 2**62 + 1, 2**53 + 1, -3}
OPERATORS = {
    "bpe": lambda df: bpe(df, word_bpe_path),
    "chat": lambda df: chat_digests(df.selectExpr("doc_id AS conv_id", "doc_id AS turn", "source AS role", "text")).withColumnRenamed("conv_id", "doc_id"),
    "html": lambda df: extract(df, "doc_id", "source", "text").withColumnRenamed("page_id", "doc_id"),
    "exact": exact_dedup, "license": license_scan, "lm": lm_scores, "mixing": mix_sources, "pii": pii_spans, "quality": quality_rules, "simhash": simhash_components,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_long_ids_beside_nulls(spark, name):
    """Ids of more than 53 bits stay whole in one batch with nulls, and a column of clashing names does no harm."""
    rows = [(i, f"text number {n} of all", "s", 1, "x") for n, i in enumerate(IDS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score int, Salt string").coalesce(1)
    out = OPERATORS[name](df)
    assert dict(out.dtypes)["doc_id"] == "bigint" and {r["doc_id"] for r in out.collect()} == IDS


def test_shared_dir(spark, monkeypatch):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: None)
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(spark)
