"""Ingest-progress streams: typed events, latest status, finished repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fields of a progress message and the events that end an ingest.
MESSAGE = "event string, message string, timestamp timestamp, status string"
TERMINAL_EVENTS = ("done", "error")


def progress_events(raw: DataFrame, repo_id: str | None = None) -> DataFrame:
    """Typed events from (channel, event_id, data); works on streams and batches.

    The channel is ``task:<repo_id>:logs``; rows whose data is no JSON drop out.
    """
    typed = raw.select(
        F.regexp_extract("channel", r"^task:(.*):logs$", 1).alias("repo_id"), "event_id",
        F.from_json("data", MESSAGE).alias("m"),
    ).where(F.col("m.event").isNotNull())
    events = typed.select(
        "repo_id", "event_id", "m.event", "m.message", F.col("m.timestamp").alias("ts"), "m.status"
    )
    return events if repo_id is None else events.where(F.col("repo_id") == repo_id)


def repo_status(events: DataFrame) -> DataFrame:
    """Latest status, number of events and last event time per repository.

    Events without a status count but do not change it.  On a stream the state is one row per repository and events may come late: run it in update mode, where a
    batch gives the repositories it touched.
    """
    reported = F.when(F.col("status").isNotNull(), F.struct("ts", "event_id"))
    return events.groupBy("repo_id").agg(
        F.max_by("status", reported).alias("status"),
        F.count(F.lit(1)).alias("n_events"),
        F.max("ts").alias("last_event"),
    )


def finished(events: DataFrame, terminal=TERMINAL_EVENTS) -> DataFrame:
    """First terminal event of each repository by (ts, event_id).

    The same on streams, in update mode: the state keeps the smallest event of a repository (one row each, no watermark needed), and one that arrives late but
    happened earlier replaces what was reported.
    """
    ends = events.where(F.col("event").isin(*terminal))
    first = F.min_by(F.struct("event_id", "event", "ts"), F.struct("ts", "event_id"))
    return ends.groupBy("repo_id").agg(first.alias("e")).select("repo_id", "e.*")
