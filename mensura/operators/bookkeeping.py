"""Documents on the way to records: keys, pending work, text size, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import stored

#: Dollars per million tokens, in and out.
PRICING = {"gpt-5.4": (2.50, 15.00), "gpt-5.6-terra": (2.50, 15.00), "gpt-5.6-sol": (5.00, 30.00), "gpt-5.6-luna": (1.00, 6.00), "gpt-5.4-mini": (0.75, 4.50), "gpt-5.4-nano": (0.20, 1.25)}
DEFAULT_RATES = (2.5, 15.0)
CODENAMES = ("terra", "sol", "luna")
OVERHEAD = {"v1": 1400, "v2": 5000}
MOST_CHARS, LOW_TEXT = 140_000, 1000


def pricing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, *r) for m, r in PRICING.items()], "model string, input_rate double, output_rate double")


def output_namespace(model: Column) -> Column:
    last = F.element_at(F.split(model, "-"), -1)
    return F.when(last.isin(*CODENAMES), last).otherwise(F.replace(model, F.lit("."), F.lit("-")))


def record_key(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\.[^./\\]*$", ""), r"[/\\]", "__")


def row_index(group: str, order: str) -> Column:
    """Position of a row within its group, from 0. Files have no order of their own once they are read, so a key gives it."""
    return F.row_number().over(W.partitionBy(group).orderBy(order)) - 1


def pending_documents(listing: DataFrame, done: DataFrame, key: str, limit: int | None = None, version: str | None = None, mode: str | None = None) -> DataFrame:
    """Documents without a result, the first of them by key. Given a version or a mode, results of another one (columns
    schema_version and measurement_mode) count as none."""
    if version is not None:
        done = done.where(F.col("schema_version").eqNullSafe(version))
    if mode is not None:
        done = done.where(F.col("measurement_mode").eqNullSafe(mode))
    left = listing.join(done.select(key), key, "left_anti")
    return left.orderBy(key).limit(limit) if limit else left


def assemble_document(pages: DataFrame, doc: str, position: str, text: str) -> DataFrame:
    """Pages joined by a blank line in order; long runs of blanks and newlines shortened."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(position, F.coalesce(text, F.lit("")).alias("t")))), lambda p: p["t"])
    whole = F.regexp_replace(F.regexp_replace(F.array_join(parts, "\n\n"), r"[ \t]{3,}", " "), r"\n{4,}", "\n\n")
    return pages.groupBy(doc).agg(F.count(F.lit(1)).alias("n_pages"), whole.alias("text"))


def text_density(df: DataFrame, text: str, n_pages: Column) -> DataFrame:
    n = F.length(F.coalesce(text, F.lit("")))
    return df.withColumns({"chars": n.cast("long"), "tokens": F.expr(f"length(coalesce({text}, '')) div 4").cast("long"), "low_density": n / F.greatest(n_pages, F.lit(1)) < 500})


def route_low_text(df: DataFrame, text: str, least: int = LOW_TEXT) -> tuple[DataFrame, DataFrame]:
    """(documents to go on with, failures with a reason)."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return df.where(n >= least), df.where(n < least).withColumn("reason", F.concat(F.lit("low text: "), n.cast("string")))


def truncate_text(df: DataFrame, text: str, most: int = MOST_CHARS) -> DataFrame:
    return df.withColumns({"truncated": F.length(text) > most, text: F.substring(text, 1, most)})


def record_cost(df: DataFrame, prices: DataFrame) -> DataFrame:
    rates = [F.coalesce(c, F.lit(d)) for c, d in zip(("input_rate", "output_rate"), DEFAULT_RATES, strict=True)]
    out = df.join(F.broadcast(prices), "model", "left")  # six rows
    cost = F.floor((F.col("in_tokens") / 1e6 * rates[0] + F.col("out_tokens") / 1e6 * rates[1]) * 1e5 + 0.5) / 1e5  # five places, half up
    return out.withColumn("cost_usd", cost).withColumn("per_electrode", F.col("cost_usd") / F.greatest("n_electrodes", F.lit(1))).drop("input_rate", "output_rate")


def unreadable(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with too little text."""
    return docs.where(F.length(F.trim(F.coalesce(text, F.lit("")))) < LOW_TEXT).select(key)


def preflight(docs: DataFrame, prices: DataFrame, text: str = "text", kind: str = "v1", electrodes: float = 3.0, measurements: float = 4.0) -> DataFrame:
    """Totals of the corpus, the upper median of document sizes, and each model's price, with the batch price at half."""
    out_each = 200 + 350 * electrodes if kind == "v1" else 300 + 500 * electrodes + 260 * electrodes * measurements
    whole = F.coalesce(text, F.lit(""))
    # texts are read once: of each size, how many documents have it and how many of them are unreadable
    sizes = stored(docs.groupBy(F.length(whole).alias("chars")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length(F.trim(whole)) < LOW_TEXT).alias("low")), "sizes")
    tokens = F.sum((F.expr("chars div 4") + OVERHEAD[kind]) * F.col("n")).cast("long")
    one = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), tokens.alias("in_tokens"), F.coalesce(F.sum("low"), F.lit(0)).alias("unreadable"))
    # few rows: sizes are numbers of characters
    median = sizes.select("chars", F.sum("n").over(W.orderBy("chars")).alias("upto"), F.sum("n").over(W.partitionBy()).alias("all")).where(F.col("upto") > F.expr("all div 2")).agg(F.min("chars").alias("median_chars"))
    one = one.withColumn("out_tokens", (F.col("documents") * out_each).cast("double")).join(median)  # one row each
    full = F.col("in_tokens") / 1e6 * F.col("input_rate") + F.col("out_tokens") / 1e6 * F.col("output_rate")
    return one.crossJoin(F.broadcast(prices)).select("model", "documents", "unreadable", "median_chars", "in_tokens", "out_tokens", F.round(full, 4).alias("cost_usd"), F.round(full / 2, 4).alias("batch_usd"))


def run_summary(records: DataFrame, failures: DataFrame) -> DataFrame:
    """records: source_file, n_electrodes, n_measurements, cost_usd, warnings."""
    a = records.agg(
        F.count(F.lit(1)).alias("papers"), F.sum("n_electrodes").alias("electrodes"), F.sum("n_measurements").alias("measurements"), F.count_if(F.size("warnings") > 0).alias("flagged"), F.round(F.sum("cost_usd"), 4).alias("cost_usd")
    )
    return a.crossJoin(failures.agg(F.count(F.lit(1)).alias("failed")))


def first_warnings(records: DataFrame, n: int = 2) -> DataFrame:
    return records.where(F.size("warnings") > 0).select("source_file", F.array_join(F.slice("warnings", 1, n), "; ").alias("warnings"))
