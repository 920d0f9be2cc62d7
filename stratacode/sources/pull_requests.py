"""Merged pull requests from dumped JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacode import schemas
from stratacode.functions.paths import strip_ws
from stratacode.operators.common import top_k


def normalise_pull_requests(raw: DataFrame, max_prs: int | None = None) -> DataFrame:
    """Merged requests with cleaned fields; with ``max_prs`` only the newest-updated so many per repository."""
    merged = raw.where(F.col("merged_at").isNotNull())
    if max_prs is not None:
        merged = top_k(merged, ["repo_id"], [F.desc("updated_at"), F.desc("number")], max_prs)
    empty = F.lit("")
    logins = F.filter(
        F.transform("requested_reviewers", lambda r: r["login"]), lambda x: x.isNotNull() & (x != "")
    )
    return merged.select(
        "repo_id",
        "number",
        strip_ws(F.coalesce("title", empty)).alias("title"),
        strip_ws(F.coalesce("body", empty)).alias("description"),
        F.coalesce("user.login", empty).alias("author"),
        F.coalesce(logins, F.array().cast("array<string>")).alias("reviewers"),
        F.coalesce("changed_files", F.lit(0)).alias("files_changed"),
        F.col("merged_at").try_cast("timestamp").alias("merged_at"),
    )


def read_pull_requests(spark: SparkSession, path: str, max_prs: int | None = None) -> DataFrame:
    return normalise_pull_requests(spark.read.schema(schemas.PULL_REQUESTS_RAW).json(path), max_prs)
