"""Merges and table writes: insert-ignore, upsert, replace, cascade delete.

The merges are plain DataFrame functions; the writers below apply them to stored tables (``stored``), of which one repository can be rewritten without touching
the buckets of others, and every change is visible at once or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacode import schemas
from stratacode.operators import stored
from stratacode.session import cut_lineage

def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``new`` to append: first per key by ``order``, keys of ``target`` left out.

    ``order`` must be total, so that reruns pick the same survivor.
    """
    rest = [c for c in new.columns if c not in keys]
    survivors = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    fresh = survivors.select(*keys, "_row.*").select(*new.columns)
    return fresh.join(target.select(*keys), keys, "left_anti").select(*new.columns)


def upsert(
    target: DataFrame, new: DataFrame, keys: list[str], update_cols: list[str] | None = None,
    keep_when_null: bool = False,
) -> DataFrame:
    """Full table after the merge: new keys are added, known keys get ``update_cols`` from ``new``.

    ``update_cols`` defaults to all other columns; columns left out keep their old
    value.  With ``keep_when_null`` a null in ``new`` also keeps the old value.
    ``new`` must be unique per key.
    """
    columns = target.columns
    updated = [c for c in columns if c not in keys] if update_cols is None else update_cols
    incoming = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns if c not in keys], F.lit(True).alias("_in"))
    merged = target.withColumn("_old", F.lit(True)).join(incoming, keys, "full_outer")

    def value(c: str):
        if c in keys:
            return F.col(c)
        fresh, known = F.col(f"_new_{c}"), F.col("_old").isNotNull()
        if c in updated:
            taken = F.coalesce(fresh, F.col(c)) if keep_when_null else fresh
            return F.when(F.col("_in"), taken).otherwise(F.col(c)).alias(c)
        return F.when(known, F.col(c)).otherwise(fresh).alias(c)

    return merged.select(*[value(c) for c in columns])


def upsert_guides(guides: DataFrame, new: DataFrame, update_cols: list[str]) -> DataFrame:
    """Guide rows with some columns replaced; a null new value leaves the old one."""
    return upsert(guides, new, ["repo_id"], update_cols, keep_when_null=True)


def without_repos(table: DataFrame, repo_ids: DataFrame) -> DataFrame:
    return table.join(repo_ids.select("repo_id"), "repo_id", "left_anti")


def replace_rows(table: DataFrame, new: DataFrame, repo_ids: DataFrame) -> DataFrame:
    """Table with everything of ``repo_ids`` replaced by ``new``."""
    return without_repos(table, repo_ids).unionByName(new)


def delete_cascade(tables: dict[str, DataFrame], repo_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the given repositories and everything below them."""
    return {name: without_repos(df, repo_ids) for name, df in tables.items()}


def reset_for_reingest(repositories: DataFrame, repo_ids: DataFrame) -> DataFrame:
    """Repositories to ingest again: finished ones go back to ``pending`` with empty results."""
    wanted = repo_ids.select("repo_id").distinct().withColumn("_wanted", F.lit(True))
    marked = repositories.join(wanted, "repo_id", "left")
    again = F.coalesce(F.col("_wanted"), F.lit(False)) & F.col("status").isin("ready", "failed")
    cleared = ("detected_stack", "entry_points", "architecture_summary")
    for c in cleared:
        marked = marked.withColumn(c, F.when(~again, F.col(c)))
    return marked.withColumn("status", F.when(again, "pending").otherwise(F.col("status"))).drop("_wanted")


def write_table(df: DataFrame, path: str, mode: str = "error", buckets: int = stored.N_BUCKETS) -> None:
    """Create, extend (``append``) or replace (``overwrite``) a stored table; a new one gets ``buckets`` buckets."""
    spark = df.sparkSession
    if mode == "error" and stored.load(spark, path) is not None:
        raise FileExistsError(f"{path} holds a table")
    stored.commit(spark, path, df, [] if mode == "append" else None, buckets=buckets)


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return stored.read(spark, path, ddl)


def append_ignore(spark: SparkSession, path: str, ddl: str, new: DataFrame, keys: list[str], order: list[str], token: str | None = None) -> int:
    """Insert-ignore into a stored table; returns the number of rows really inserted.

    Only the buckets of the repositories in ``new`` are compared, so a small batch
    does not read the whole table.
    """
    new = cut_lineage(new)
    target = stored.read(spark, path, ddl, stored.buckets_of(spark, path, new))
    fresh = cut_lineage(insert_ignore(target, new, keys, order))
    inserted = fresh.count()
    return inserted if inserted and stored.commit(spark, path, fresh, [], token) else 0


def store_upsert(
    spark: SparkSession, path: str, ddl: str, new: DataFrame, keys: list[str], update_cols=None, keep_when_null: bool = False, token: str | None = None
) -> bool:
    """Upsert into a stored table, rewriting only the buckets of the repositories in ``new``; False if the token was stored before."""
    new = cut_lineage(new)
    buckets = stored.buckets_of(spark, path, new)
    merged = upsert(stored.read(spark, path, ddl, buckets), new, keys, update_cols, keep_when_null)
    return stored.commit(spark, path, merged, buckets, token)


def replace_partition(spark: SparkSession, path: str, ddl: str, new: DataFrame, repo_ids: DataFrame, token: str | None = None) -> bool:
    """Delete-then-replace of whole repositories in a stored table, as one change."""
    repo_ids = cut_lineage(repo_ids.select("repo_id"))
    buckets = stored.buckets_of(spark, path, repo_ids)
    return stored.commit(spark, path, replace_rows(stored.read(spark, path, ddl, buckets), new, repo_ids), buckets, token)


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All stored tables with their fixed schemas; nothing is inferred."""
    return {name: read_table(spark, f"{folder}/{name}", ddl) for name, ddl in schemas.TABLES.items()}


def delete_repositories(spark: SparkSession, folder: str, repo_ids: DataFrame, token: str | None = None) -> None:
    """Remove repositories and all their rows from the stored tables.

    Each table changes at once.  A run that ends between two tables is finished by running it again: the children go first, the repositories last.
    """
    repo_ids = cut_lineage(repo_ids.select("repo_id"))
    for name in [n for n in schemas.TABLES if n != "repositories"] + ["repositories"]:
        ddl, state = schemas.TABLES[name], stored.load(spark, f"{folder}/{name}")
        if state is None or not state.folders:
            continue  # nothing is stored
        replace_partition(spark, f"{folder}/{name}", ddl, spark.createDataFrame([], ddl), repo_ids, token)


def clear_tables(spark: SparkSession, folder: str, buckets: int = stored.N_BUCKETS) -> None:
    for name in schemas.TABLES:
        stored.clear(spark, f"{folder}/{name}", buckets)
