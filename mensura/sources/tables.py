"""Flat tables in and out: CSV folders, verdict splits, results."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _csv(spark: SparkSession, multi_line: bool):
    """multi_line: values hold line breaks. A file is then one task's; without, its lines are split among tasks."""
    return spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')


def _columns(line: str) -> tuple[str, ...]:
    return tuple(next(csv.reader([line.lstrip("\ufeff")])))


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str] | str]:
    """Header -> the files that have it; where all files have one header, the path itself. First lines are found and grouped by Spark:
    a row a header comes to the driver, and the names of files only where headers differ."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    first = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("line"))
    known = [r["line"] for r in first.groupBy("line").agg(F.count(F.lit(1)).alias("n")).collect()]
    if len({_columns(line) for line in known}) <= 1:
        return {_columns(line): path for line in known}
    found: dict[tuple[str, ...], list[str] | str] = {}
    for row in first.collect():
        found.setdefault(_columns(row["line"]), []).append(unquote(row["file"]))
    return {header: sorted(files) for header, files in found.items()}


def file_name() -> Column:
    """A row's file, without the escapes that paths have."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def _strings(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` STRING" for c in columns)


def _stacked(spark: SparkSession, path: str, columns: Sequence[str] | None, multi_line: bool, one_header: bool, **more: Column) -> DataFrame:
    """The files of a path by header, each group read with its own names, with further columns; all at once where one header is told."""
    reader = _csv(spark, multi_line).option("enforceSchema", False)
    if columns and one_header:
        parts = [reader.schema(_strings(columns)).csv(path).withColumns(more)]
    else:
        parts = [reader.schema(_strings(header)).csv(files).withColumns(more) for header, files in sorted(_headers(spark, path).items())]
    out = union_files(parts or [spark.createDataFrame([], _strings([*(columns or []), *more]))])
    return out.select(*columns, *more) if columns else out


def scan_strings(spark: SparkSession, path: str, columns: Sequence[str] | None = None, multi_line: bool = False, one_header: bool = False) -> DataFrame:
    """CSV with every column a string and nulls empty. Files are read by their headers' names: those whose headers differ are
    stacked by name, and what one lacks is empty. With columns, one_header says that all have just these, and spares the look."""
    return _stacked(spark, path, columns, multi_line, one_header)


def scan_dir(spark: SparkSession, path: str, columns: Sequence[str] | None = None, multi_line: bool = False, one_header: bool = False) -> DataFrame:
    """Every CSV of a folder, as scan_strings reads it, with search_id, the file's name without its suffix."""
    return _stacked(spark, path, columns, multi_line, one_header, search_id=F.regexp_replace(file_name(), r"\.csv$", ""))


def scan_positions(spark: SparkSession, path: str, columns: Sequence[str] | None = None, multi_line: bool = False, one_header: bool = False) -> DataFrame:
    """scan_dir with row_index, the place of a row in its file from 0, as the file's own lines are ordered.

    Rows of a split of a file are numbered in their order as they are read; a table with a row for each split says how many rows lie
    before it in its file, so position is that offset and the place within the split. No key is needed, no rows are sorted, and
    the positions are the same for one split or many. Both readings of the files are of one listing, so they are split alike.
    """
    places = {"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start")}
    search_id = F.regexp_replace(file_name(), r"\.csv$", "")
    rows = _stacked(spark, path, columns, multi_line, one_header, search_id=search_id, **places).withColumn("_at", F.monotonically_increasing_id())
    splits = rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("own"), F.min("_at").alias("first"))
    before = F.sum("own").over(W.partitionBy("_file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1))  # a row a split of a file
    splits = splits.select("_file", "_start", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(splits, ["_file", "_start"]).withColumn("row_index", F.col("_at") + F.col("shift")).drop("_file", "_start", "_at", "shift")


def union_files(parts: Sequence[DataFrame]) -> DataFrame:
    """Files whose headers differ, stacked by name; what one lacks is empty."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.na.fill("")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, or an error that lists the missing columns; no job runs."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def scan_inferred(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with types: of the schema, or inferred by a pass over the data where none is given."""
    reader = _csv(spark, multi_line)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode).partitionBy(*by)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def write_tagged(df: DataFrame, path: str, tag: str = "model_tag") -> None:
    """One folder for each tag. Folders of tags that df has are replaced, all others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(tag).parquet(path)


def read_tagged(spark: SparkSession, path: str, value: str | None = None, tag: str = "model_tag") -> DataFrame:
    """The rows of one tag, from its folder alone, or of all."""
    rows = spark.read.parquet(path).withColumn(tag, F.col(tag).cast("string"))
    return rows if value is None else rows.where(F.col(tag) == value)


def write_verdict_split(df: DataFrame, path: str, reasoning: Sequence[str], verdict: str = "overall") -> None:
    """Rows in one folder per verdict, and the reasoning columns of all rows beside them.

    The rows are judged once: the reasoning is projected from the written rows, not from the rules again.
    """
    write_table(df, f"{path}/rows", by=[verdict])
    write_table(df.sparkSession.read.parquet(f"{path}/rows").select(*reasoning), f"{path}/reasoning")
