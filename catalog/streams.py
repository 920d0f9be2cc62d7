"""Progress streams run as Structured Streaming jobs over the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from catalog.base import Catalog, table
from stratacode import schemas
from stratacode.operators.writes import append_ignore, read_table, write_table
from stratacode.session import ensure_checkpoint_dir
from stratacode.streaming import commit_ingest, keyed, progress

C = Catalog()

_RAW = (
    "concat('task:', user_id, ':logs') AS channel", "event_id",
    "to_json(named_struct('event', CASE event_type WHEN 'purchase' THEN 'done' ELSE event_type END, 'message', props, "
    "'timestamp', date_format(CAST(ts AS TIMESTAMP), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\"), "
    "'status', CASE event_type WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'parsing' END)) AS data",
)


BATCHES = 4
LATE = "event_id * 7919 % 4"  # deals events of all times over the batches, so each batch after the first brings late ones


def _run_dir(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark, d, name):
    # The schema must come from the files: a stream does not infer one.
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _late_events(spark, d):
    """The event table as a stream of ``BATCHES`` files, one a micro-batch; every file holds events of all times."""
    events, path = table(spark, d, "events"), f"{_run_dir(spark)}/in"
    events.withColumn("batch", F.expr(LATE)).repartition("batch").write.partitionBy("batch").parquet(path)
    with_batch = StructType([*events.schema.fields, StructField("batch", IntegerType())])
    stream = spark.readStream.schema(with_batch).option("maxFilesPerTrigger", 1).parquet(path)
    return progress.progress_events(stream.selectExpr(*_RAW))


def _finish(df: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream to its end and read what it stored in the checkpoint folder."""
    spark = df.sparkSession
    base = _run_dir(spark)
    query = keyed.store(df, f"{base}/out", f"{base}/state", mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return keyed.read_latest(spark, f"{base}/out", df.schema, keys) if keys else keyed.read_all(spark, f"{base}/out", df.schema).drop(keyed.BATCH)


@C.query("progress_events", """SELECT user_id::VARCHAR AS repo_id, event_id, CASE event_type WHEN 'purchase' THEN 'done' ELSE event_type END AS event,
  props AS message, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts,
  CASE event_type WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'parsing' END AS status FROM events""")
def progress_events(spark, d):
    return _finish(_late_events(spark, d), "append").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@C.query("repo_status", """SELECT user_id::VARCHAR AS repo_id, count(*) AS n_events, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_event,
  arg_max(CASE event_type WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'failed' ELSE 'parsing' END, ts)
    FILTER (event_type IN ('purchase', 'error', 'signup')) AS status FROM events GROUP BY 1""")
def repo_status(spark, d):
    status = _finish(progress.repo_status(_late_events(spark, d)), "update", ["repo_id"])
    return status.withColumn("last_event", F.date_format("last_event", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


_FIRST_END = """SELECT repo_id, event_id, event FROM (
  SELECT user_id::VARCHAR AS repo_id, event_id, CASE event_type WHEN 'purchase' THEN 'done' ELSE 'error' END AS event,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events WHERE event_type IN ('purchase', 'error')) WHERE rn = 1"""


@C.query("finished_repos", _FIRST_END)
def finished_repos(spark, d):
    """As a stream: a terminal event that arrives late replaces the one reported before."""
    return _finish(progress.finished(_late_events(spark, d)), "update", ["repo_id"]).select("repo_id", "event_id", "event")


@C.query("first_terminal_events", _FIRST_END)
def first_terminal_events(spark, d):
    events = progress.progress_events(table(spark, d, "events").selectExpr(*_RAW))
    return progress.finished(events).select("repo_id", "event_id", "event")


@C.query("commit_ingest", """SELECT o_orderpriority AS repo_id, sha1((o_orderkey // 2)::VARCHAR) AS hash, min(o_orderkey) AS log_pos
FROM orders GROUP BY 1, 2""")
def commits_ingested(spark, d):
    """Half of the commits are stored first; the stream brings all of them, many twice."""
    made = (
        "o_orderpriority AS repo_id", "sha1(CAST(o_orderkey div 2 AS STRING)) AS hash", "concat('c', o_custkey) AS author_name",
        "'c@x' AS author_email", "'m' AS message", "0 AS files_changed", "CAST(o_orderdate AS TIMESTAMP) AS authored_at",
        "o_orderkey AS log_pos", "true AS date_ok",
    )
    base = _run_dir(spark)
    write_table(spark.createDataFrame([], schemas.COMMITS), f"{base}/commits")
    stored = table(spark, d, "orders").where("o_orderkey % 4 < 2").selectExpr(*made)
    append_ignore(spark, f"{base}/commits", schemas.COMMITS, stored, commit_ingest.COMMIT_KEYS, commit_ingest.COMMIT_ORDER)
    stream = _stream(spark, d, "orders").selectExpr(*made)
    writer = commit_ingest.commit_ingest(stream, f"{base}/commits", f"{base}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return read_table(spark, f"{base}/commits", schemas.COMMITS).select("repo_id", "hash", "log_pos")
