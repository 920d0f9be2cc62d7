"""Code ownership from the touch log (one row per commit and changed file)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacode.functions.paths import owner_label, slashes
from stratacode.operators.common import ordered_items, restrict_to

ISO_UTC = "yyyy-MM-dd'T'HH:mm:ssxxx"
LOG_ORDER = ("log_pos", "line_no")


def author_stats(commit_files: DataFrame, log_order=LOG_ORDER) -> DataFrame:
    """Commits, last commit and first-seen name per (path, author e-mail).

    ``log_order`` names the columns that give the order of the log, newest first.
    Map-side combining reduces a hot file to one row per author and task.
    """
    first = F.struct(*log_order, F.col("author_name").alias("name"))
    return commit_files.groupBy(
        "repo_id", "path", F.lower("author_email").alias("email")
    ).agg(
        F.count(F.lit(1)).alias("commit_count"),
        F.max("ts").alias("last_commit"),
        F.min(first).alias("first_pos"),
    ).withColumn("name", F.col("first_pos.name"))


def path_stats(authors: DataFrame, *more: Column) -> DataFrame:
    """Change frequency, last change, owner and silo flag per path, from ``author_stats``; combined on the map side, whatever the number of authors.

    ``more`` are further aggregates over the authors of a path.
    """
    rank = F.struct((-F.col("commit_count")).alias("neg_count"), "first_pos")
    return authors.groupBy("repo_id", "path").agg(
        F.sum("commit_count").alias("change_frequency"),
        F.max("last_commit").alias("git_last_modified"),
        F.min_by(owner_label(F.col("name"), F.col("email")), rank).alias("primary_owner"),
        F.count(F.lit(1)).cast("int").alias("bus_factor"),
        *more,
    ).withColumn("is_knowledge_silo", F.col("bus_factor") == 1)


def _share(count, total):
    # Half-even on the decimal form of the quotient, one decimal.
    return F.bround(count / total * 100, 1)


def _ranked(authors: DataFrame) -> DataFrame:
    by_commits = Window.partitionBy("repo_id", "path").orderBy(F.desc("commit_count"), "first_pos")
    return authors.withColumn("rank", F.row_number().over(by_commits))


def contributors(authors: DataFrame, paths: DataFrame, max_rank: int | None = None) -> DataFrame:
    """One row per (path, author) with its 1-based rank and share: the stored form of a path's contributors.

    ``authors`` are ``author_stats``, ``paths`` their ``path_stats``.  With ``max_rank`` every map task cuts a path down to so many authors; without it the
    authors of a path go through a sorted window that can spill.  They are never one array.
    """
    if max_rank is None:
        # One exchange gives rank and total.
        total = F.sum("commit_count").over(Window.partitionBy("repo_id", "path"))
        ranked = _ranked(authors.where("repo_id is not null and path is not null")).withColumn("_total", total)
    else:
        totals = paths.select("repo_id", "path", F.col("change_frequency").alias("_total"))
        ranked = _ranked(authors).where(F.col("rank") <= max_rank).join(totals, ["repo_id", "path"])
    return ranked.select(
        "repo_id", "path", "rank", "email", "name", "commit_count", _share(F.col("commit_count"), F.col("_total")).alias("percentage"), "last_commit",
    )


def rank_contributors(commit_files: DataFrame, log_order=LOG_ORDER) -> DataFrame:
    """``contributors`` of a touch log, all of them."""
    authors = author_stats(commit_files, log_order)
    return contributors(authors, path_stats(authors))


def file_ownership(commit_files: DataFrame, log_order=LOG_ORDER, max_contributors: int | None = None) -> DataFrame:
    """Change frequency, last change, ranked contributors, owner and silo flag per path.

    The ``contributors`` array holds every author of a path, made beside the other columns in one aggregate: a plan that drops the column makes no array and moves no
    authors for it.  With ``max_contributors`` it shows the first so many authors, cut in every map task; ``bus_factor`` and the shares count all of them
    either way, and ``rank_contributors`` gives all as rows.
    """
    authors = author_stats(commit_files, log_order)
    item = F.struct("email", "name", "commit_count", "last_commit")
    if max_contributors is None:
        order = [(-F.col("commit_count")).alias("neg_count"), "first_pos", "email"]
        # Equal log positions are told apart by e-mail.
        listed = path_stats(authors.where("repo_id is not null and path is not null"), ordered_items(item, order).alias("contributors"))
    else:
        # The touch log is read and exchanged once: both sides need the same columns of the authors, and shares are taken when the total has arrived.
        first = _ranked(authors).where(F.col("rank") <= max_contributors).groupBy("repo_id", "path").agg(ordered_items(item, ["rank"]).alias("contributors"))
        listed = path_stats(authors).join(first, ["repo_id", "path"])
    shown = F.transform("contributors", lambda c: F.struct(
        c["email"].alias("email"), c["name"].alias("name"), c["commit_count"].alias("commit_count"),
        _share(c["commit_count"], F.col("change_frequency")).alias("percentage"), F.date_format(c["last_commit"], ISO_UTC).alias("last_commit")))
    return listed.select(
        "repo_id", "path", "change_frequency", "git_last_modified", "primary_owner", shown.alias("contributors"), "bus_factor", "is_knowledge_silo")


def resolve_path(df: DataFrame, files: DataFrame) -> DataFrame:
    """Attach ``file_id`` by path within the repository; unknown paths drop out."""
    ids = files.select("repo_id", "file_id", slashes(F.col("path")).alias("path"))
    return df.join(ids, ["repo_id", "path"])


def code_owners(ownership: DataFrame, files: DataFrame) -> DataFrame:
    """Ownership rows of the known files."""
    return resolve_path(ownership, files).select(
        "repo_id", "file_id", "primary_owner", "contributors", "bus_factor", "is_knowledge_silo"
    )


def apply_git_stats(files: DataFrame, ownership: DataFrame, has_tests: DataFrame) -> DataFrame:
    """Files with change frequency, last change and test flag from the history.

    Files absent from the history keep what they had.
    """
    stats = ownership.select(
        "repo_id", F.col("path").alias("_path"), F.col("change_frequency").alias("_freq"),
        F.col("git_last_modified").alias("_last"),
    ).join(
        has_tests.select("repo_id", F.col("path").alias("_path"), F.col("has_tests").alias("_tests")),
        ["repo_id", "_path"],
        "left",
    )
    touched = F.col("_freq").isNotNull()
    return (
        files.withColumn("_path", slashes(F.col("path")))
        .join(stats, ["repo_id", "_path"], "left")
        .withColumn("change_frequency", F.when(touched, F.col("_freq").cast("double")).otherwise(F.col("change_frequency")))
        .withColumn("git_last_modified", F.when(touched, F.col("_last")).otherwise(F.col("git_last_modified")))
        .withColumn("has_tests", F.when(touched, F.coalesce("_tests", F.lit(False))).otherwise(F.col("has_tests")))
        .drop("_path", "_freq", "_last", "_tests")
    )


def owners_with_file(owners: DataFrame, files: DataFrame) -> DataFrame:
    """Owner rows with the path of their file."""
    return owners.join(files.select("repo_id", "file_id", "path"), ["repo_id", "file_id"])


def silos(owners: DataFrame, files: DataFrame) -> DataFrame:
    """Files known to a single author, ordered by path within the repository."""
    return owners_with_file(owners.where("is_knowledge_silo"), files).orderBy("repo_id", "path")


def silo_totals(owners: DataFrame) -> DataFrame:
    return owners.where("is_knowledge_silo").groupBy("repo_id").agg(F.count(F.lit(1)).alias("total"))


def ownership_summary(key_modules: DataFrame, owners: DataFrame) -> DataFrame:
    """Owner, bus factor and silo flag of the key modules."""
    return restrict_to(owners, key_modules, ["repo_id", "file_id"]).select(
        "repo_id", "file_id", "primary_owner", "bus_factor", "is_knowledge_silo"
    )
