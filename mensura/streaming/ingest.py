"""Records as they arrive: each is taken once, and a rerun goes on where the last one stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.sources.tables import file_name

STATE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed(records: DataFrame) -> DataFrame:
    """Records with source_file, by the file's name where the record has none, and record_key: model and source_path; a record without
    a source_path goes by the file's name and a hash of its content, so that none is taken for another."""
    whole = F.sha2(F.to_json(F.struct(*records.columns)), 256)
    name = F.coalesce(F.concat(F.lit("path:"), F.col("source_path")), F.concat(F.lit("file:"), file_name(), F.lit(":"), whole))
    model = F.coalesce(F.concat(F.lit("model:"), F.col("model")), F.lit("none"))
    return records.withColumns({"source_file": F.coalesce("source_file", file_name()), "record_key": F.concat_ws("\n", model, name)})


def incremental_ingest(spark: SparkSession, source: str, schema: str, flatten: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Take all record files of source that the checkpoint does not know, flatten them and add them to target/rows.

    A record whose key was seen is left out, also where it comes again in a new file: keys are state of the stream, in RocksDB on the
    executors and in the checkpoint, so a batch costs what it brings, whatever is stored already. A batch goes to a folder
    named by its number and replaces what a broken attempt left there, so its rows appear once.
    """

    def store(batch: DataFrame, number: int) -> None:
        flatten(batch.drop("record_key")).write.mode("overwrite").parquet(f"{target}/rows/batch={number}")

    before = spark.conf.get(STATE)
    spark.conf.set(STATE, ROCKS)  # read when the stream starts
    try:
        stream = keyed(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)).dropDuplicates(["record_key"])
        query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STATE, before)
    query.awaitTermination()
