"""Document bookkeeping over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.operators import bookkeeping as B
from mensura.operators.storage import scratch
from mensura.sources.tables import read_tagged, write_tagged


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _keys(spark, d):
    return _docs(spark, d).select("doc_id", F.concat(F.lit("in/"), "source", F.lit("/doc."), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"))


def record_key(spark, d):
    return _keys(spark, d).select("doc_id", B.record_key(F.col("path")).alias("key"))


def pending(spark, d):
    """Documents without a result; the first 50 by key."""
    keys = record_key(spark, d)
    return B.pending_documents(keys, keys.where("doc_id % 3 = 0"), "key", 50)


def pending_versions(spark, d):
    """Documents without a result of this version: results of every fifth one are stale."""
    keys = record_key(spark, d)
    done = keys.where("doc_id % 3 = 0").withColumn("schema_version", F.when(F.col("doc_id") % 5 == 0, "1").otherwise("2"))
    return B.pending_documents(keys, done, "key", version="2")


def pending_of_tag(spark, d):
    """Documents without a result of one model: of the tree of results only that model's folder is read."""
    path, keys = scratch(spark, "results"), record_key(spark, d)
    write_tagged(keys.where("doc_id % 3 <> 1").withColumn("model_tag", F.when(F.col("doc_id") % 2 == 0, "terra").otherwise("sol")), path)
    return B.pending_documents(keys, read_tagged(spark, path, "terra"), "key")


def text_density(spark, d):
    """Conversations as documents whose pages are their turns."""
    pages = B.assemble_document(spark.read.parquet(f"{d}/conversations.parquet"), "conv_id", "turn", "text")
    return B.text_density(pages, "text", F.col("n_pages")).select("conv_id", "chars", "tokens", "low_density")


def low_text(spark, d):
    return B.route_low_text(_docs(spark, d), "text")[1].select("doc_id", "reason")


def truncated(spark, d):
    return B.truncate_text(_docs(spark, d), "text").select("doc_id", "truncated", F.md5("text").alias("digest"))


def assembled(spark, d):
    """Conversations as documents of ordered pages."""
    out = B.assemble_document(spark.read.parquet(f"{d}/conversations.parquet"), "conv_id", "turn", "text")
    return out.select("conv_id", "n_pages", F.md5("text").alias("digest"))


def preflight(spark, d):
    return B.preflight(_docs(spark, d), B.pricing(spark))


def preflight_v2(spark, d):
    return B.preflight(_docs(spark, d), B.pricing(spark), kind="v2", electrodes=2.5, measurements=3.0)


def unreadable(spark, d):
    return B.unreadable(_docs(spark, d))


def _runs(spark, d):
    model = F.element_at(F.array(*map(F.lit, ["gpt-5.4", "gpt-5.6-terra", "gpt-5.4-nano", "other"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return _docs(spark, d).select("doc_id", model.alias("model"), F.expr("length(text) div 4").alias("in_tokens"), (F.col("doc_id") % 7 * 350).alias("out_tokens"), (F.col("doc_id") % 5).alias("n_electrodes"))


def record_cost(spark, d):
    return B.record_cost(_runs(spark, d), B.pricing(spark)).select("doc_id", "cost_usd", "per_electrode")


def namespaces(spark, d):
    return _runs(spark, d).groupBy(B.output_namespace(F.col("model")).alias("model_tag")).agg(F.count(F.lit(1)).alias("n"))


def _records(spark, d):
    costs = B.record_cost(_runs(spark, d), B.pricing(spark))
    warnings = F.filter(F.array(F.when(F.col("n_electrodes") == 0, "empty"), F.when(F.col("out_tokens") == 0, "silent"), F.when(F.col("doc_id") % 10 == 0, "count")), lambda w: w.isNotNull())
    return costs.select(F.col("doc_id").cast("string").alias("source_file"), "n_electrodes", (F.col("n_electrodes") * 3).alias("n_measurements"), "cost_usd", warnings.alias("warnings"))


def run_summary(spark, d):
    failures = B.route_low_text(_docs(spark, d), "text")[1]
    return B.run_summary(_records(spark, d), failures).select("papers", "electrodes", "measurements", "flagged", F.round("cost_usd", 2).alias("cost_usd"), "failed")


def first_warnings(spark, d):
    return B.first_warnings(_records(spark, d))


QUERIES = {f.__name__: f for f in (record_key, pending, pending_versions, pending_of_tag, text_density, low_text, truncated, assembled, preflight, preflight_v2, unreadable, record_cost, namespaces, run_summary, first_warnings)}

_PRICES = "pr AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, (a, b) in B.PRICING.items()) + ") t(model, i, o))"
_RUNS = "r AS (SELECT doc_id, (['gpt-5.4', 'gpt-5.6-terra', 'gpt-5.4-nano', 'other'])[doc_id % 4 + 1] AS model, length(text) // 4 AS in_tokens, doc_id % 7 * 350 AS out_tokens, doc_id % 5 AS n FROM documents)"
_COST = "c AS (SELECT doc_id, n, out_tokens, floor((in_tokens / 1e6 * coalesce(i, 2.5) + out_tokens / 1e6 * coalesce(o, 15)) * 1e5 + 0.5) / 1e5 AS cost_usd FROM r LEFT JOIN pr USING (model))"
_KEY = "'in__' || source || '__doc.' || CAST(doc_id AS VARCHAR)"
_W = "list_filter([CASE WHEN n = 0 THEN 'empty' END, CASE WHEN out_tokens = 0 THEN 'silent' END, CASE WHEN doc_id % 10 = 0 THEN 'count' END], lambda w: w IS NOT NULL)"
_PAGES = r"SELECT conv_id, count(*) AS n_pages, regexp_replace(regexp_replace(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn), '[ \t]{3,}', ' ', 'g'), '\n{4,}', chr(10) || chr(10), 'g') AS text FROM conversations GROUP BY conv_id"


def _preflight(overhead, each):
    return f"""WITH {_PRICES}, s AS (SELECT length(coalesce(text, '')) AS c, row_number() OVER (ORDER BY length(coalesce(text, ''))) AS r, count(*) OVER () AS k FROM documents),
t AS (SELECT count(*) AS documents, CAST(sum(length(coalesce(text, '')) // 4 + {overhead}) AS BIGINT) AS in_tokens, count(*) FILTER (WHERE length(trim(coalesce(text, ''), ' ')) < 1000) AS unreadable, CAST(count(*) * {each} AS DOUBLE) AS out_tokens, (SELECT c FROM s WHERE r = k // 2 + 1) AS median_chars FROM documents)
SELECT model, documents, unreadable, median_chars, in_tokens, out_tokens, round(in_tokens / 1e6 * i + out_tokens / 1e6 * o, 4) AS cost_usd, round((in_tokens / 1e6 * i + out_tokens / 1e6 * o) / 2, 4) AS batch_usd FROM t, pr"""


SQL = {
    "record_key": f"SELECT doc_id, {_KEY} AS key FROM documents",
    "pending": f"SELECT doc_id, {_KEY} AS key FROM documents WHERE doc_id % 3 <> 0 ORDER BY key LIMIT 50",
    "pending_versions": f"SELECT doc_id, {_KEY} AS key FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 5 <> 0)",
    "pending_of_tag": f"SELECT doc_id, {_KEY} AS key FROM documents WHERE doc_id % 3 = 1 OR doc_id % 2 = 1",
    "text_density": f"SELECT conv_id, length(text) AS chars, length(text) // 4 AS tokens, length(text) / n_pages < 500 AS low_density FROM ({_PAGES})",
    "low_text": "SELECT doc_id, 'low text: ' || CAST(length(trim(coalesce(text, ''), ' ')) AS VARCHAR) AS reason FROM documents WHERE length(trim(coalesce(text, ''), ' ')) < 1000",
    "truncated": "SELECT doc_id, length(text) > 140000 AS truncated, md5(substring(text, 1, 140000)) AS digest FROM documents",
    "assembled": f"SELECT conv_id, n_pages, md5(text) AS digest FROM ({_PAGES})",
    "preflight": _preflight(1400, "1250"),
    "preflight_v2": _preflight(5000, "(300 + 500 * 2.5 + 260 * 2.5 * 3.0)"),
    "unreadable": "SELECT doc_id FROM documents WHERE length(trim(coalesce(text, ''), ' ')) < 1000",
    "record_cost": f"WITH {_PRICES}, {_RUNS}, {_COST} SELECT doc_id, cost_usd, cost_usd / greatest(n, 1) AS per_electrode FROM c",
    "namespaces": f"WITH {_RUNS} SELECT CASE WHEN regexp_extract(model, '[^-]*$') IN ('terra', 'sol', 'luna') THEN regexp_extract(model, '[^-]*$') ELSE replace(model, '.', '-') END AS model_tag, count(*) AS n FROM r GROUP BY 1",
    "run_summary": f"WITH {_PRICES}, {_RUNS}, {_COST} SELECT count(*) AS papers, CAST(sum(n) AS BIGINT) AS electrodes, CAST(sum(n * 3) AS BIGINT) AS measurements, count(*) FILTER (WHERE len({_W}) > 0) AS flagged, round(round(sum(cost_usd), 4), 2) AS cost_usd, (SELECT count(*) FROM documents WHERE length(trim(coalesce(text, ''), ' ')) < 1000) AS failed FROM c",
    "first_warnings": f"WITH {_PRICES}, {_RUNS}, {_COST} SELECT CAST(doc_id AS VARCHAR) AS source_file, array_to_string(({_W})[1:2], '; ') AS warnings FROM c WHERE len({_W}) > 0",
}
