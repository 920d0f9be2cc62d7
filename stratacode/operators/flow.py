"""Data-flow trace from the entry points of each repository, as joins.

Entries are walked one after another, all repositories at once.  A walk goes ``hops`` steps breadth-first; a file emits its imports the first time that
any walk of its repository expands it and never again, which is an anti join with what was expanded before.  The order of the trace is a key
of its own: (rank of the entry, hop, path of files that led to the parent, import path), so the report is cut last, from whole rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacode.operators.common import top_k
from stratacode.operators.edges import file_dependency_paths
from stratacode.session import cut_lineage

# What the report of a brief shows.
MAX_ENTRIES = 5
HOPS = 2
MAX_EDGES = 40

ORDER = ["entry_rank", "hop", "via", "to_path"]


def trace(entry_points: DataFrame, files: DataFrame, edges: DataFrame, hops: int = HOPS, max_entries: int | None = None) -> DataFrame:
    """Every import met by the walks: (repo_id, entry_rank, hop, via, from_path, to_path), in the order of ``ORDER`` within a repository.

    ``entry_points`` has (repo_id, path, entry_rank); ``via`` lists the files from the entry to ``from_path``, the least such list where several lead
    there.  Entries that are no file of their repository are left out.  There is one small job per rank and two hops, whatever the number of
    repositories.
    """
    paths = files.select("repo_id", "file_id", F.col("path").alias("from_path"))
    # Every step reads this table, so it is materialised once.
    imports = cut_lineage(
        file_dependency_paths(edges, files).join(paths, ["repo_id", "file_id"])
        .select("repo_id", "from_path", F.col("target_path").alias("to_path")).distinct()
    )
    asked = entry_points if max_entries is None else entry_points.where(F.col("entry_rank") <= max_entries)
    entries = cut_lineage(
        asked.select("repo_id", F.col("path").alias("from_path"), F.col("entry_rank").cast("int").alias("entry_rank"))
        .join(paths.select("repo_id", "from_path"), ["repo_id", "from_path"], "left_semi")
    )
    ranks = sorted(r[0] for r in entries.select("entry_rank").distinct().collect())
    node = ["repo_id", "from_path"]

    def after(wave: DataFrame) -> DataFrame:
        """The files that a wave leads to, each by its least way."""
        met = wave.join(imports, node).select("repo_id", "to_path", F.concat("via", F.array("to_path")).alias("via"))
        return met.groupBy("repo_id", F.col("to_path").alias("from_path")).agg(F.min("via").alias("via"))

    expanded, steps = entries.select(*node).limit(0), None
    for rank in ranks:
        level, hop = entries.where(F.col("entry_rank") == rank).groupBy(*node).agg(F.array("from_path").alias("via")), 1
        while hop <= hops:
            # Two hops a job: the second one's anti join sees what the first expands.
            wave = level.join(expanded, node, "left_anti").withColumn("hop", F.lit(hop))
            reach = min(hop + 1, hops)
            if reach > hop:
                second = after(wave).join(expanded.unionByName(wave.select(*node)), node, "left_anti").withColumn("hop", F.lit(reach))
                wave = wave.unionByName(second)
            wave = cut_lineage(wave)
            if wave.isEmpty():
                break
            expanded = expanded.unionByName(wave.select(*node))
            step = wave.join(imports, node).select("repo_id", F.lit(rank).alias("entry_rank"), "hop", "via", "from_path", "to_path")
            steps = step if steps is None else steps.unionByName(step)
            level, hop = after(wave.where(F.col("hop") == reach)), reach + 1
    if steps is None:
        none = F.lit(None)
        return imports.limit(0).select("repo_id", none.cast("int").alias("entry_rank"), none.cast("int").alias("hop"), none.cast("array<string>").alias("via"), "from_path", "to_path")
    return steps


def trace_data_flow(
    entry_points: DataFrame,
    files: DataFrame,
    edges: DataFrame,
    hops: int = HOPS,
    max_edges: int | None = MAX_EDGES,
    max_entries: int | None = MAX_ENTRIES,
) -> DataFrame:
    """The first ``max_edges`` imports of the trace of each repository, numbered by ``step``; all of them with ``None``."""
    whole = trace(entry_points, files, edges, hops, max_entries)
    shown = top_k(whole, ["repo_id"], ORDER, max_edges if max_edges is not None else (1 << 31) - 1, "step")
    return shown.select("repo_id", "step", "from_path", "to_path", "hop")
