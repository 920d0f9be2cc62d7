"""Tables written once into the shared folder of the cluster and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stratacode.session import ensure_checkpoint_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir`` (a local fallback only where that is unset, as in tests)."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back.

    Cuts the lineage like a checkpoint, but columnar: later steps read only the columns they use, and a lost
    executor costs a re-read.  The shuffle files behind the table are of no further use and are removed with the
    write, so a job of many steps needs the disk of its widest step only.

    ``batch_bytes`` bounds the Arrow batches in which rows with texts or sets go to Python, which a task holds on both sides.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    wanted = {CLEANUP: "true"} | ({BATCH: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)
