"""Onboarding brief and guide views, one or more rows per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacode.operators.common import number_rows, ordered_items, top_k
from stratacode.operators.ownership import ownership_summary
from stratacode.operators.stats import critical_files, key_modules, severity_rank

# Section sizes.
MODULE_EDGES, GLOSSARY_PREVIEW, ORDER_PREVIEW = 30, 10, 10


def _array(df: DataFrame, item: Column, order: list, name: str) -> DataFrame:
    return df.groupBy("repo_id").agg(ordered_items(item, order).alias(name))


def build_brief(
    repositories: DataFrame,
    files: DataFrame,
    symbols: DataFrame,
    stacks: DataFrame,
    entry_points: DataFrame,
    module_edges: DataFrame,
    data_flow: DataFrame,
    integrations: DataFrame,
    owners: DataFrame,
    glossary: DataFrame,
    order: DataFrame,
) -> DataFrame:
    """One row per repository with files.

    Sections with a fixed size are arrays here.  Entry points and critical files have
    no limit, so the row carries their counts and ``brief_lists`` gives the whole
    lists as rows: one huge repository never has to fit into one cell.
    """
    modules = key_modules(files)
    module_item = F.struct("path", "fan_in", "fan_out", "language", "criticality")
    edges = top_k(module_edges, ["repo_id"], ["src_module", "tgt_module"], MODULE_EDGES)
    edge_item = F.struct(F.col("src_module").alias("from"), F.col("tgt_module").alias("to"))
    flow_item = F.struct(F.col("from_path").alias("from"), F.col("to_path").alias("to"), "hop")
    summary = ownership_summary(modules, owners)
    summary_item = F.struct("file_id", "primary_owner", "bus_factor", "is_knowledge_silo")
    terms = top_k(glossary, ["repo_id"], ["name", "symbol_id"], GLOSSARY_PREVIEW)
    term_item = F.struct(F.col("name").alias("term"), "definition", "file_path")
    first = order.where(F.col("position") <= ORDER_PREVIEW)
    order_item = F.struct("file_id", "path", "fan_in", "fan_out", "language", "tier", "position", "annotation")
    symbol_repo = symbols.select("repo_id", "file_id").join(files.select("repo_id", "file_id"), ["repo_id", "file_id"], "left_semi")

    counts = files.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("criticality").isin("critical", "caution")).alias("n_critical_files"),
    )
    parts = [
        repositories.select("repo_id", F.col("architecture_summary").alias("narrative")),
        stacks.select("repo_id", F.struct("languages", "frameworks", "databases", "ci_cd").alias("tech_stack")),
        _array(modules, module_item, ["rank"], "key_modules"),
        _array(data_flow, flow_item, ["step"], "data_flow"),
        _array(integrations, F.col("integration"), ["integration"], "external_integrations"),
        _array(edges, edge_item, ["rank"], "module_edges"),
        _array(summary, summary_item, ["file_id"], "ownership_summary"),
        _array(terms, term_item, ["rank"], "glossary_preview"),
        _array(first, order_item, ["position"], "reading_order_preview"),
        entry_points.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_entry_points")),
        symbol_repo.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_symbols")),
    ]
    brief = counts
    for part in parts:
        brief = brief.join(part, "repo_id", "left")
    return brief.fillna(0, ["total_symbols", "n_entry_points"])


def brief_lists(files: DataFrame, entry_points: DataFrame) -> DataFrame:
    """The unbounded sections as rows: (repo_id, section, position, path, criticality, reasons, fan_in)."""
    severe = number_rows(
        critical_files(files).withColumn("_severity", severity_rank(F.col("criticality"))),
        ["repo_id"], ["_severity", F.desc("fan_in"), "path"],
    ).select(
        "repo_id", F.lit("critical_files").alias("section"), "position", "path", "criticality", "reasons", "fan_in"
    )
    entries = number_rows(entry_points.select("repo_id", "path"), ["repo_id"], ["path"]).select(
        "repo_id", F.lit("entry_points").alias("section"), "position", "path"
    )
    return severe.unionByName(entries, allowMissingColumns=True)


def guide_reading_order(order: DataFrame) -> DataFrame:
    """Reading order as a reader sees it."""
    return order.select(
        "repo_id", "position", F.col("path").alias("file_path"), F.coalesce("annotation", F.lit("")).alias("annotation"),
        F.coalesce("fan_in", F.lit(0)).alias("fan_in"),
    ).orderBy("repo_id", "position")


def guide_critical_files(files: DataFrame) -> DataFrame:
    """Critical files by severity with the fields of the guide."""
    return critical_files(files).withColumnRenamed("path", "file_path")


def guide_view(brief: DataFrame) -> DataFrame:
    """The part of the brief the guide shows."""
    return brief.select(
        "repo_id", "external_integrations", "data_flow", "module_edges", "key_modules", "ownership_summary",
    )
