"""Nested records in and out, as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions.catalog import V1_FIELDS
from mensura.operators.records import ITEM, PAPER_V1, PAPER_V2

from .tables import file_name

CELL = "struct<value:string,unit:string,note:string,confidence:string>"
HEAD = "source_file string, source_path string, model string, cost_usd double, warnings array<string>, summary string"


def schema_v1(fields: Sequence[str] = V1_FIELDS) -> str:
    """Dense: a cell for each paper value and for each field of an electrode."""
    cells = lambda names: ",".join(f"`{f}`:{CELL}" for f in names)
    return f"{HEAD}, paper struct<{cells(PAPER_V1)}>, n_electrodes int, electrodes array<struct<label:string,role:string,is_primary:boolean,fields:struct<{cells(fields)}>>>"


def schema_v2() -> str:
    """Sparse: paper values as strings, an item for each field that is reported; ids are strings."""
    one = f"struct<measurement_id:string,measurement_label:string,is_representative:boolean,fields:array<{ITEM}>>"
    electrode = f"struct<electrode_id:string,label:string,role:string,is_primary:boolean,fields:array<{ITEM}>,n_measurements:int,measurements:array<{one}>>"
    paper = ",".join(f"{p}:string" for p in PAPER_V2)
    return f"schema_version string, measurement_mode string, {HEAD}, paper struct<{paper}>, n_electrodes int, n_measurements int, electrodes array<{electrode}>"


def _named(rows: DataFrame) -> DataFrame:
    """source_file from the name of the file where the record has none."""
    return rows.withColumn("source_file", F.coalesce("source_file", file_name()))


def scan_records_v1(spark: SparkSession, path: str, fields: Sequence[str] = V1_FIELDS, multi_line: bool = False) -> DataFrame:
    """Dense records. A file per record, spread over lines, needs multi_line; one record a line can be split among tasks."""
    return _named(spark.read.schema(schema_v1(fields)).option("multiLine", multi_line).json(path))


def scan_records_v2(spark: SparkSession, path: str, version: str, mode: str, strict: bool = False, multi_line: bool = False) -> DataFrame:
    """Sparse records of one schema version and measurement mode; others are left out, or with strict raise when read."""
    rows = _named(spark.read.schema(schema_v2()).option("multiLine", multi_line).json(path))
    fits = F.col("schema_version").eqNullSafe(version) & F.col("measurement_mode").eqNullSafe(mode)
    if not strict:
        return rows.where(fits)
    message = F.concat(F.lit("record of another version or mode: "), F.coalesce("source_file", F.lit("unnamed")))
    return rows.withColumn("schema_version", F.when(fits, F.col("schema_version")).otherwise(F.raise_error(message)))


def write_records(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "gzip") -> None:
    """One record a line, absent fields left out; packed, as names take most of the text. A task's file is read by one task."""
    df.write.mode(mode).option("compression", compression).json(path)
