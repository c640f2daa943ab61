"""The queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe, chat, decontaminate, exact_dedup, html_text, lexical, license_scan, lm, mixing, pii, quality_rules, simhash, vector_codes

MODULES = [simhash, bpe, html_text, mixing, chat, quality_rules, pii, lm, exact_dedup, license_scan, vector_codes, lexical, decontaminate]


def queries() -> dict:
    found = {"pipeline": pipeline}
    for module in MODULES:
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for module in MODULES:
        found.update(module.SQL)
    return found


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
