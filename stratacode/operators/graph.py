"""File graph, symbol graph and path tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacode.functions.paths import (
    base_name, criticality_label, criticality_score, parent_dir, symbol_loc, top_dir,
)
from stratacode.operators.edges import IMPORT_KIND, NODE_KINDS, file_edges, first_symbol, of_kind


def file_nodes(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.select(
        "repo_id",
        F.col("file_id").alias("id"),
        base_name(path).alias("label"),
        "path",
        parent_dir(path).alias("group"),
        F.lit("file").alias("kind"),
        F.coalesce("loc", F.lit(0)).alias("loc"),
        criticality_label(F.col("criticality")).alias("criticality"),
        criticality_score(F.col("criticality")).alias("criticality_score"),
        F.coalesce(F.nullif("language", F.lit("")), F.lit("unknown")).alias("language"),
        F.coalesce("fan_in", F.lit(0)).alias("fan_in"),
        F.coalesce("fan_out", F.lit(0)).alias("fan_out"),
    )


def weighted_links(edges: DataFrame) -> DataFrame:
    """One link per file pair: weight = edge rows, type = most frequent (ties: alphabetical)."""
    per_type = edges.groupBy("repo_id", "src_file_id", "tgt_file_id", "dep_type").agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_type.groupBy("repo_id", "src_file_id", "tgt_file_id").agg(
        F.min_by("dep_type", F.struct((-F.col("n")).alias("n"), "dep_type")).alias("type"),
        F.sum("n").alias("weight"),
    ).select(
        "repo_id", F.col("src_file_id").alias("source"), F.col("tgt_file_id").alias("target"), "type", "weight"
    )


def graph_metadata(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Node, edge and cluster (distinct top directory) counts per repository."""
    node_side = nodes.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total_nodes"),
        F.count_distinct(top_dir(F.col("path"))).alias("clusters"),
    )
    link_side = links.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_edges"))
    return node_side.join(link_side, "repo_id", "left").select(
        "repo_id", "total_nodes", F.coalesce("total_edges", F.lit(0)).alias("total_edges"), "clusters"
    )


def file_graph(files: DataFrame, symbols: DataFrame, dependencies: DataFrame):
    """(nodes, links, metadata) at file level."""
    nodes = file_nodes(files)
    known = files.select("repo_id", "file_id")
    edges = file_edges(dependencies, symbols.join(known, ["repo_id", "file_id"], "left_semi"))
    links = weighted_links(edges)
    return nodes, links, graph_metadata(nodes, links)


def symbol_nodes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    meta = files.select("repo_id", "file_id", "path", "criticality")
    path = F.col("path")
    return (
        of_kind(symbols, NODE_KINDS)
        .select("repo_id", "symbol_id", "file_id", "kind", "name", "start_line", "end_line", "cyclomatic_complexity")
        .join(meta, ["repo_id", "file_id"])
        .select(
            "repo_id",
            F.col("symbol_id").alias("id"),
            F.col("name").alias("label"),
            "path",
            parent_dir(path).alias("group"),
            "kind",
            symbol_loc(F.col("start_line"), F.col("end_line")).alias("loc"),
            F.coalesce("cyclomatic_complexity", F.lit(0)).alias("complexity"),
            criticality_label(F.col("criticality")).alias("criticality"),
            criticality_score(F.col("criticality")).alias("criticality_score"),
        )
    )


def symbol_links(symbols: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One link per pair of node symbols.

    A function or class endpoint stands for itself, an import endpoint for the
    first node of its file, any other endpoint (a method, say) drops the row.
    Of several rows for one pair the first in (source, target) symbol order
    gives the type.
    """
    first_node = first_symbol(symbols, NODE_KINDS).withColumnRenamed("symbol_id", "first_node")
    endpoint = (
        of_kind(symbols, (*NODE_KINDS, IMPORT_KIND))
        .select("repo_id", "symbol_id", "file_id", "kind")
        .join(first_node, ["repo_id", "file_id"], "left")
        .select(
            "repo_id", "symbol_id",
            F.when(F.col("kind") == IMPORT_KIND, F.col("first_node")).otherwise(F.col("symbol_id")).alias("node"),
        )
        .where(F.col("node").isNotNull())
    )
    source = endpoint.withColumnsRenamed({"symbol_id": "source_symbol_id", "node": "source"})
    target = endpoint.withColumnsRenamed({"symbol_id": "target_symbol_id", "node": "target"})
    return (
        dependencies.join(source, ["repo_id", "source_symbol_id"])
        .join(target, ["repo_id", "target_symbol_id"])
        .where("source <> target")
        .groupBy("repo_id", "source", "target")
        .agg(F.min_by("dep_type", F.struct("source_symbol_id", "target_symbol_id", "dep_type")).alias("type"))
        .withColumn("weight", F.lit(1))
    )


def symbol_graph(files: DataFrame, symbols: DataFrame, dependencies: DataFrame):
    """(nodes, links, metadata) at symbol level."""
    known = symbols.join(files.select("repo_id", "file_id"), ["repo_id", "file_id"], "left_semi")
    nodes = symbol_nodes(files, known)
    links = symbol_links(known, dependencies)
    return nodes, links, graph_metadata(nodes, links)


def path_tree(files: DataFrame) -> DataFrame:
    """Every prefix of every path as a tree node, with files and lines beneath it."""
    clean = F.regexp_replace("path", r"^[/\\]+", "")
    parts = F.split(clean, r"[/\\]")
    prefixes = files.select("repo_id", "loc", parts.alias("parts")).select(
        "repo_id", "loc", F.col("parts"), F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth")
    )
    is_leaf = F.col("depth") == F.size("parts")
    return (
        prefixes.select(
            "repo_id", "loc", "depth", is_leaf.alias("leaf"),
            F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("path"),
        )
        .groupBy("repo_id", "path", "depth")
        .agg(
            F.when(F.bool_or("leaf"), "file").otherwise("directory").alias("type"),
            F.count(F.lit(1)).alias("files"),
            F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"),
        )
        .withColumn("name", F.substring_index("path", "/", -1))
        .withColumn(
            "parent",
            F.when(F.col("depth") == 1, F.lit("")).otherwise(F.regexp_replace("path", r"/[^/]*$", "")),
        )
    )


def tree_order(tree: DataFrame) -> DataFrame:
    """Children of each directory: directories first, then by name."""
    return tree.orderBy("repo_id", "parent", "type", "name")
