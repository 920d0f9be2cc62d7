"""Commits and changed files from git-log text.

The text is the output of ``git log --numstat`` with the header format
``%H|%ae|%an|%s|%ai``, newest commit first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacode.functions.paths import slashes, strip_ws
from stratacode.operators.common import top_k

LINES_PER_BLOCK = 100_000

# The header line of a commit, a renamed path and the date format of git log.
_HEADER = r"^\s*[0-9a-f]{7,40}\s*\|"
_RENAME = r"^(.*?)\{(.+?) => (.+?)\}(.*)$"
_DATE = "yyyy-MM-dd HH:mm:ss Z"


def read_git_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(repo_id, line_no, line) of ``<folder>/<repo_id>.log`` files of any size.

    Logs are read by splits.  ``line_no`` rises with the lines of a log but is not gapless: it is twice the byte at which a line's split starts plus its place in
    the split, and a split has at most one line more than bytes.  Places come from one small count per split.
    """
    read = spark.read.option("lineSep", "\n").text(folder).select(
        F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("repo_id"), "_metadata.file_path", "_metadata.file_block_start",
        F.monotonically_increasing_id().alias("read_no"), F.regexp_replace("value", r"\r$", "").alias("line"),
    )
    split = ["file_path", "file_block_start"]
    first = read.groupBy(*split).agg(F.min("read_no").alias("first_no"))
    line_no = 2 * F.col("file_block_start") + F.col("read_no") - F.col("first_no")
    return read.join(first, split).select("repo_id", line_no.alias("line_no"), "line")


def new_path(path: Column) -> Column:
    """Path after a rename: ``a/{old => new}/b`` becomes ``a/new/b``."""
    renamed = F.replace(F.regexp_replace(path, _RENAME, "$1$3$4"), F.lit("//"), F.lit("/"))
    return slashes(F.when(path.rlike(_RENAME), renamed).otherwise(path))


def _number(text: Column) -> Column:
    # Binary files show "-"; a missing count is 0, anything else that is no integer drops the line.
    return F.when(text == "-", F.lit(0)).otherwise(strip_ws(text).try_cast("int"))


def _is_header(line: Column) -> Column:
    # A header needs all five fields; a shorter one neither starts nor ends a record.
    return line.rlike(_HEADER) & (F.size(F.split(line, r"\|", 5)) == 5)


def group_log_records(lines: DataFrame, lines_per_block: int = LINES_PER_BLOCK) -> DataFrame:
    """Change lines (those with a tab) with ``log_pos``, the line number of the commit header above.

    The last header above a line is found inside a block of lines first and carried
    over from earlier blocks second, so a log of any length is spread over many tasks.
    Header texts stay behind, and lines above the first header drop out.
    """
    line = F.col("line")
    header = F.col("is_header")
    marked = (
        lines.select("repo_id", "line_no", "line", _is_header(line).alias("is_header"))
        .where(header | line.contains("\t"))
        .select(
            "repo_id", "line_no", F.floor(F.col("line_no") / F.lit(lines_per_block)).alias("block"),
            F.when(header, F.col("line_no")).alias("head"), F.when(~header, line).alias("line"),
        )
    )
    running = Window.partitionBy("repo_id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("repo_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        marked.groupBy("repo_id", "block").agg(F.max("head").alias("last_head"))
        .select("repo_id", "block", F.max("last_head").over(earlier).alias("carried"))
    )
    return (
        marked.withColumn("in_block", F.max("head").over(running))
        .where(F.col("line").isNotNull())
        .join(carry, ["repo_id", "block"])
        .select("repo_id", "line_no", "line", F.coalesce("in_block", "carried").alias("log_pos"))
        .where(F.col("log_pos").isNotNull())
    )


def parse_git_log(lines: DataFrame, now, lines_per_block: int = LINES_PER_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files).

    A date that cannot be read becomes ``now`` and is flagged by ``date_ok``.
    ``log_pos`` and ``line_no`` give the order of the log, newest first.
    """
    part = F.col("part")
    date = F.try_to_timestamp(strip_ws(F.get(part, F.lit(4))), F.lit(_DATE))
    heads = (
        lines.where(F.col("line").rlike(_HEADER))
        .select("repo_id", F.col("line_no").alias("log_pos"), F.split("line", r"\|", 5).alias("part"))
        .where(F.size("part") == 5)
        .select(
            "repo_id", "log_pos",
            strip_ws(F.get(part, F.lit(0))).alias("hash"),
            F.lower(strip_ws(F.get(part, F.lit(1)))).alias("author_email"),
            strip_ws(F.get(part, F.lit(2))).alias("author_name"),
            strip_ws(F.get(part, F.lit(3))).alias("message"),
            F.coalesce(date, F.lit(now).cast("timestamp")).alias("authored_at"),
            date.isNotNull().alias("date_ok"),
        )
    )
    tab = F.col("tab")
    changes = (
        group_log_records(lines, lines_per_block)
        # Half a header ("abc1234|...") is no change either.
        .where(~F.col("line").rlike(_HEADER))
        .select("repo_id", "log_pos", "line_no", F.split("line", "\t", 3).alias("tab"))
        .where(F.size("tab") == 3)
        .select(
            "repo_id", "log_pos", "line_no", new_path(strip_ws(F.get(tab, F.lit(2)))).alias("path"),
            _number(F.get(tab, F.lit(0))).alias("added"), _number(F.get(tab, F.lit(1))).alias("deleted"),
        )
        .where("added IS NOT NULL AND deleted IS NOT NULL")
    )
    counts = changes.groupBy("repo_id", "log_pos").agg(F.count(F.lit(1)).cast("int").alias("files_changed"))
    commits = heads.join(counts, ["repo_id", "log_pos"], "left").select(
        "repo_id", "hash", "author_name", "author_email", "message",
        F.coalesce("files_changed", F.lit(0)).alias("files_changed"), "authored_at", "log_pos", "date_ok",
    )
    commit_files = changes.join(
        heads.select("repo_id", "log_pos", "hash", "author_email", "author_name", F.col("authored_at").alias("ts")),
        ["repo_id", "log_pos"],
    ).select(
        "repo_id", "hash", "log_pos", "line_no", "path", "added", "deleted", "author_email", "author_name", "ts"
    )
    return commits, commit_files


def newest_commits(commits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` commits of each log."""
    return top_k(commits, ["repo_id"], ["log_pos"], k).drop("rank")
