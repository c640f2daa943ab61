"""What several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: the space and the characters 9 to 13. Everything else belongs to words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or what was set as the context's checkpoint folder."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a lost executor then costs one stage, not the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names with underscores put before them until none is a column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def beside(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df with new columns; those of df that have such a name make way."""
    own = {k.lower() for k in new}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in own), *(v.alias(k) for k, v in new.items()))


def with_longs(df: DataFrame, names: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(df) with the columns `names` as strings where they are longs, and longs again after: among nulls, pandas would make
    fractions of them, which hold no more than 53 bits."""
    longs = {c for c, t in df.dtypes if c in names and t == "bigint"}
    as_ = lambda df, kind: df.select(*(F.col(f"`{c}`").cast(kind).alias(c) if c in longs else F.col(f"`{c}`") for c in df.columns)) if longs else df
    return as_(work(as_(df, "string")), "long")
