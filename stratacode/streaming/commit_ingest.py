"""Incremental commit ingest: insert-ignore per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from stratacode import schemas
from stratacode.operators.writes import append_ignore

COMMIT_KEYS = ["repo_id", "hash"]
COMMIT_ORDER = ["log_pos", "author_email", "message"]


def commit_ingest(stream: DataFrame, table_path: str, checkpoint: str) -> DataStreamWriter:
    """Writer that appends unseen commits to a stored table.

    A replayed batch inserts nothing new, so the table stays exact after a restart.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        append_ignore(batch.sparkSession, table_path, schemas.COMMITS, batch, COMMIT_KEYS, COMMIT_ORDER, f"{checkpoint}#{batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
