"""Stored results of streams that stay right when a batch is run again.

Every micro-batch is a folder of its own, named after its number and replaced as a whole, so a batch that runs twice is stored once.  A result
that is updated by key keeps all its versions; the one of the last batch counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import LongType, StructField, StructType

from stratacode.operators.common import first_per_key

BATCH = "batch_no"


def batch_writer(path: str):
    """A ``foreachBatch`` function that stores each batch below ``path`` under its number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return write


def store(stream: DataFrame, path: str, checkpoint: str, mode: str) -> DataStreamWriter:
    """Writer of the new rows (``append``) or changed rows (``update``) of a stream."""
    return stream.writeStream.outputMode(mode).foreachBatch(batch_writer(path)).option("checkpointLocation", checkpoint)


def read_all(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of all batches with the number of theirs."""
    return spark.read.schema(StructType([*schema.fields, StructField(BATCH, LongType())])).parquet(path)


def read_latest(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """The last version of each key."""
    rest = [f.name for f in schema.fields if f.name not in keys]
    return first_per_key(read_all(spark, path, schema), keys, [-F.col(BATCH)], rest).select(*schema.names)
