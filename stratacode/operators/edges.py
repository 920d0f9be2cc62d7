"""Import resolution, file edges and the metrics counted on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacode.functions.paths import (
    full_stem, import_path, last_segment, slashes, top_dir,
)
from stratacode.operators.common import first_per_key, ordered_items, top_k

# Symbol kinds by use.
EMBEDDABLE_KINDS = ("function", "class", "method")
NODE_KINDS = ("function", "class")
TARGET_KINDS = ("function", "class", "method")
GLOSSARY_KINDS = ("function", "class", "method", "variable")
IMPORT_KIND = "import"


def of_kind(symbols: DataFrame, kinds) -> DataFrame:
    return symbols.where(F.col("kind").isin(*kinds))


def has_source(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("source_code").isNotNull() & (F.col("source_code") != ""))


def with_file(symbols: DataFrame, files: DataFrame, columns=("path",)) -> DataFrame:
    """Symbols with columns of their file."""
    return symbols.join(files.select("repo_id", "file_id", *columns), ["repo_id", "file_id"])


def first_symbol(symbols: DataFrame, kinds) -> DataFrame:
    """First symbol of the given kinds per file, by (ordinal, symbol_id)."""
    narrow = of_kind(symbols, kinds).select("repo_id", "file_id", "symbol_id", "ordinal")
    return first_per_key(narrow, ["repo_id", "file_id"], ["ordinal", "symbol_id"], ["symbol_id"])


def import_keys(files: DataFrame) -> DataFrame:
    """(repo, key) -> file for every name a file can be imported by.

    A key is the full stem of a path or the stem of its file name.  A full stem
    always beats a file-name stem; among full stems the last path wins, among
    file-name stems the first.
    """
    path = slashes(F.col("path"))
    stem = full_stem(F.col("path"))
    keyed = files.select(
        "repo_id", "file_id", path.alias("path"),
        F.explode(
            F.array(
                F.struct(stem.alias("key"), F.lit(True).alias("full")),
                F.struct(last_segment(stem).alias("key"), F.lit(False).alias("full")),
            )
        ).alias("k"),
    )
    full = F.col("k.full")
    return keyed.groupBy("repo_id", F.col("k.key").alias("key")).agg(
        F.coalesce(
            F.max_by("file_id", F.when(full, F.col("path"))),
            F.min_by("file_id", F.when(~full, F.col("path"))),
        ).alias("file_id")
    )


def normalise_imports(symbols: DataFrame) -> DataFrame:
    """Import symbols with the slash path of the imported name; unusable names drop out."""
    return (
        of_kind(symbols, (IMPORT_KIND,))
        .select("repo_id", "symbol_id", "file_id", import_path(F.col("name")).alias("import_path"))
        .where(F.col("import_path").isNotNull())
    )


def resolve_imports(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """At most one ``imports`` edge per import symbol: (repo_id, source_symbol_id, src_file_id, target_symbol_id, tgt_file_id, dep_type).

    The whole import path is tried first, then its last segment; a match on the
    importing file itself is passed over.  Each try is one equi-join with a key
    table that is unique per key.  A matched file without a function, class or
    method gives no edge.
    """
    keys = import_keys(files).join(
        first_symbol(symbols, TARGET_KINDS).withColumnRenamed("symbol_id", "target_symbol_id"),
        ["repo_id", "file_id"],
        "left",
    ).select("repo_id", "key", F.struct(F.col("file_id").alias("file_id"), "target_symbol_id").alias("hit"))

    imports = normalise_imports(symbols)
    whole = keys.select("repo_id", F.col("key").alias("import_path"), F.col("hit").alias("whole"))
    short = keys.select("repo_id", F.col("key").alias("short_name"), F.col("hit").alias("short"))
    tried = (
        imports.withColumn("short_name", last_segment(F.col("import_path")))
        .join(whole, ["repo_id", "import_path"], "left")
        .join(short, ["repo_id", "short_name"], "left")
    )
    own = F.col("file_id")
    hit = F.when(F.col("whole.file_id") != own, F.col("whole")).when(
        F.col("short.file_id") != own, F.col("short")
    )
    return (
        tried.select("repo_id", F.col("symbol_id").alias("source_symbol_id"), own.alias("src_file_id"), hit.alias("hit"))
        .where(F.col("hit.target_symbol_id").isNotNull())
        .select(
            "repo_id", "source_symbol_id", "src_file_id", F.col("hit.target_symbol_id").alias("target_symbol_id"),
            F.col("hit.file_id").alias("tgt_file_id"), F.lit("imports").alias("dep_type"),
        )
    )


def resolve_dependencies(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """The dependency table: ``resolve_imports`` by symbols alone."""
    return resolve_imports(files, symbols).select("repo_id", "source_symbol_id", "target_symbol_id", "dep_type")


def import_edges(resolved: DataFrame) -> DataFrame:
    """``file_edges`` of freshly resolved imports, whose files are known: no join."""
    return cross_file(resolved).select("repo_id", "src_file_id", "tgt_file_id", "dep_type")


def cross_file(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src_file_id") != F.col("tgt_file_id"))


def file_edges(dependencies: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row per dependency of a stored table between two files (rows inside one file drop out).

    Only (symbol_id, file_id) of the symbols travels through the joins.
    """
    owner = symbols.select("repo_id", "symbol_id", "file_id")
    source = owner.withColumnsRenamed({"symbol_id": "source_symbol_id", "file_id": "src_file_id"})
    target = owner.withColumnsRenamed({"symbol_id": "target_symbol_id", "file_id": "tgt_file_id"})
    joined = dependencies.join(source, ["repo_id", "source_symbol_id"]).join(
        target, ["repo_id", "target_symbol_id"]
    )
    return cross_file(joined).select("repo_id", "src_file_id", "tgt_file_id", "dep_type")


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("repo_id", "src_file_id", "tgt_file_id").distinct()


def adjacency(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct edges keyed both ways: (file -> imported file) and (file -> importing file)."""
    distinct = distinct_edges(edges)
    forward = distinct.select("repo_id", F.col("src_file_id").alias("file_id"), F.col("tgt_file_id").alias("imports"))
    backward = distinct.select("repo_id", F.col("tgt_file_id").alias("file_id"), F.col("src_file_id").alias("imported_by"))
    return forward, backward


def degrees(edges: DataFrame) -> DataFrame:
    """fan_in / fan_out per file in one aggregation; counts edge rows, not distinct files."""
    ends = edges.select(
        "repo_id",
        F.explode(
            F.array(
                F.struct(F.col("src_file_id").alias("file_id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("tgt_file_id").alias("file_id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        ).alias("end"),
    )
    return ends.groupBy("repo_id", F.col("end.file_id").alias("file_id")).agg(
        F.sum("end.i").cast("int").alias("fan_in"), F.sum("end.o").cast("int").alias("fan_out")
    )


def fan_metrics(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files with fan_in and fan_out, zero where a file has no edge."""
    return (
        files.drop("fan_in", "fan_out")
        .join(degrees(edges), ["repo_id", "file_id"], "left")
        .fillna(0, ["fan_in", "fan_out"])
    )


def module_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct pairs of different modules (top directories)."""
    module = files.select("repo_id", "file_id", top_dir(F.col("path")).alias("module"))
    source = module.withColumnsRenamed({"file_id": "src_file_id", "module": "src_module"})
    target = module.withColumnsRenamed({"file_id": "tgt_file_id", "module": "tgt_module"})
    return (
        distinct_edges(edges)
        .join(source, ["repo_id", "src_file_id"])
        .join(target, ["repo_id", "tgt_file_id"])
        .where("src_module <> tgt_module")
        .select("repo_id", "src_module", "tgt_module")
        .distinct()
    )


def file_dependency_paths(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (file, imported path) rows."""
    target = files.select("repo_id", F.col("file_id").alias("tgt_file_id"), F.col("path").alias("target_path"))
    return (
        distinct_edges(edges)
        .join(target, ["repo_id", "tgt_file_id"])
        .select("repo_id", F.col("src_file_id").alias("file_id"), "target_path")
    )


def file_dep_map(edges: DataFrame, files: DataFrame, max_targets: int | None = None) -> DataFrame:
    """Imported paths per file as one array, by path, and their number.

    With ``max_targets`` only the first so many are shown, and every map task cuts a file down before the arrays are built.  The same as rows is
    ``file_dependency_paths``.
    """
    paths = file_dependency_paths(edges, files)
    listed = ordered_items(F.col("target_path"), ["target_path"]).alias("targets")
    if max_targets is None:
        return paths.groupBy("repo_id", "file_id").agg(listed, F.count(F.lit(1)).alias("n_targets"))
    shown = top_k(paths, ["repo_id", "file_id"], ["target_path"], max_targets, "_nth").drop("_nth")
    arrays = shown.groupBy("repo_id", "file_id").agg(listed)
    totals = paths.groupBy("repo_id", "file_id").agg(F.count(F.lit(1)).alias("n_targets"))
    return arrays.join(totals, ["repo_id", "file_id"])


def dependency_counts(dependencies: DataFrame, symbols: DataFrame) -> DataFrame:
    """Dependencies per repository whose source symbol is known."""
    known = dependencies.join(
        symbols.select("repo_id", F.col("symbol_id").alias("source_symbol_id")),
        ["repo_id", "source_symbol_id"],
        "left_semi",
    )
    return known.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_dependencies"))
