"""Topological tiers and the reading order built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacode.operators.common import number_rows
from stratacode.operators.edges import distinct_edges
from stratacode.session import cut_lineage, stage


# Rounds whose results are folded into one table, so that deep graphs keep a small plan.
FOLD_ROUNDS = 24


def _highest(presence: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, presence).groupBy("repo_id", "file_id").agg(F.max("level").alias("level"))


def peel(edges: DataFrame) -> DataFrame:
    """Levels of all files that import something: (repo_id, file_id, level).

    Round k keeps only the edges whose target still imports something, so a file
    leaves once its last dependency has left; its level is the number of rounds it
    was present.  Files that stay for ever (cycle members and everything above
    them) get a null level.  All repositories advance together, and each round
    costs one semi-join and one staged table of the shrinking edge set.  The joins are
    merges: tables broadcast round by round would add up in the driver.
    """
    current = stage(distinct_edges(edges), "edges")
    left = current.count()
    presence = []
    rounds = 0
    while left:
        present = current.select("repo_id", F.col("src_file_id").alias("file_id")).distinct()
        presence.append(present.withColumn("level", F.lit(rounds + 1)))
        if len(presence) >= FOLD_ROUNDS:
            presence = [cut_lineage(_highest(presence))]
        unresolved = present.withColumnRenamed("file_id", "tgt_file_id").hint("merge")
        kept = stage(current.join(unresolved, ["repo_id", "tgt_file_id"], "left_semi").select(current.columns), "edges")
        still = kept.count()
        rounds += 1
        if still == left:
            break
        current, left = kept, still
    else:
        still = 0
    if not presence:
        return current.select("repo_id", F.col("src_file_id").alias("file_id"), F.lit(None).cast("int").alias("level"))
    levels = _highest(presence)
    if not still:
        return levels
    stuck = kept.select("repo_id", F.col("src_file_id").alias("file_id")).distinct().withColumn("stuck", F.lit(True))
    return levels.join(stuck, ["repo_id", "file_id"], "left").select(
        "repo_id", "file_id", F.when(F.col("stuck"), F.lit(None)).otherwise(F.col("level")).alias("level")
    )


def cycle_remainder(files: DataFrame, levels: DataFrame) -> DataFrame:
    """Files that never become free of unresolved imports."""
    stuck = levels.where(F.col("level").isNull()).select("repo_id", "file_id")
    return files.join(stuck, ["repo_id", "file_id"], "left_semi")


def topological_tiers(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files with ``tier``: 0 = imports nothing, else one above its highest import.

    The unresolvable remainder of a repository forms one tier after its last level.
    """
    known = files.select("repo_id", "file_id")
    inner = (
        edges.join(known.withColumnRenamed("file_id", "src_file_id"), ["repo_id", "src_file_id"], "left_semi")
        .where("src_file_id <> tgt_file_id")
    )
    levels = peel(inner).withColumn("listed", F.lit(True))
    placed = files.join(levels, ["repo_id", "file_id"], "left").withColumn(
        "level", F.when(F.col("listed"), F.col("level")).otherwise(F.lit(0))
    )
    deepest = placed.groupBy("repo_id").agg(F.max("level").alias("deepest"))
    return (
        placed.join(deepest, "repo_id")
        .withColumn("tier", F.coalesce("level", F.col("deepest") + 1, F.lit(0)).cast("int"))
        .drop("level", "listed", "deepest")
    )


def reading_order(files: DataFrame, edges: DataFrame) -> DataFrame:
    """All files of a repository by (tier, fan_in descending, path) with 1-based positions."""
    tiers = topological_tiers(files, edges).select(
        "repo_id", "file_id", "path",
        F.coalesce("fan_in", F.lit(0)).alias("fan_in"),
        F.coalesce("fan_out", F.lit(0)).alias("fan_out"),
        "language", "tier",
    )
    ordered = number_rows(tiers, ["repo_id"], ["tier", F.desc("fan_in"), "path"])
    return ordered.withColumn("annotation", F.lit(""))


def ordered_nodes(order: DataFrame, nodes: DataFrame) -> DataFrame:
    """Graph nodes in reading order; entries without a node drop out."""
    return order.select("repo_id", "path", "position").join(nodes, ["repo_id", "path"]).orderBy("repo_id", "position")
