"""The whole ingest as one job: raw inputs in, all analytic tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacode.operators import chunks as chunk_ops
from stratacode.operators import edges as edge_ops
from stratacode.operators import flow, order, ownership, rules, stats, symbols as symbol_ops, textgen
from stratacode.operators.tests_lookup import detect_tests
from stratacode.plans.brief import build_brief
from stratacode.session import stage
from stratacode.sources.git_log import newest_commits, parse_git_log
from stratacode.sources.tree import keep_source_files, pick_readme, to_files


@dataclass
class Ingested:
    """Analytic tables of one ingest run."""

    files: DataFrame
    symbols: DataFrame
    dependencies: DataFrame
    edges: DataFrame
    commits: DataFrame
    commit_files: DataFrame
    code_owners: DataFrame
    stacks: DataFrame
    entry_points: DataFrame
    integrations: DataFrame
    module_edges: DataFrame
    reading_order: DataFrame
    data_flow: DataFrame
    chunks: DataFrame
    glossary_candidates: DataFrame
    brief: DataFrame


def ingest(
    repositories: DataFrame,
    listing: DataFrame,
    log_lines: DataFrame,
    pull_requests: DataFrame,
    glossary: DataFrame,
    now,
    git_aware: bool = True,
    max_commits: int | None = None,
) -> Ingested:
    """``listing`` has (repo_id, path, content) of all files, sources and manifests alike.

    The whole history counts; ``max_commits`` keeps the newest so many commits of each repository only.

    Source files, symbols, resolved imports, the touch log and ownership are each used several times, so they are written once as Parquet in the checkpoint
    folder, and every consumer reads only its columns; everything else stays lazy.
    """
    source_files = stage(to_files(keep_source_files(listing)), "source-files")
    symbols = stage(symbol_ops.extract_symbols(source_files), "symbols")
    bare = source_files.drop("content")

    resolved = stage(edge_ops.resolve_imports(bare, symbols), "imports")
    dependencies = resolved.select("repo_id", "source_symbol_id", "target_symbol_id", "dep_type")
    edges = edge_ops.import_edges(resolved)
    measured = edge_ops.fan_metrics(bare, edges).select(
        "*",
        F.lit(None).cast("double").alias("change_frequency"),
        F.lit(None).cast("timestamp").alias("git_last_modified"),
        F.lit(None).cast("boolean").alias("has_tests"),
    )

    commits, all_changes = parse_git_log(log_lines, now)
    if max_commits is not None:
        commits = newest_commits(commits, max_commits)
        all_changes = all_changes.join(commits.select("repo_id", "log_pos"), ["repo_id", "log_pos"], "left_semi")
    commit_files = stage(all_changes, "commit-files")
    owned = stage(ownership.file_ownership(commit_files), "ownership")
    tests = detect_tests(owned, listing)
    files = rules.criticality(ownership.apply_git_stats(measured, owned, tests), now, git_aware)
    owners = ownership.code_owners(owned, files)

    stacks = rules.detect_stack(listing)
    entry_points = rules.detect_entry_points(listing)
    integrations = rules.detect_integrations(symbols)
    module_edges = edge_ops.module_edges(edges, files)
    positions = order.reading_order(files, edges)
    first_entries = rules.rank_entry_points(entry_points, flow.MAX_ENTRIES)
    data_flow = flow.trace_data_flow(first_entries, files, edges)
    chunks = chunk_ops.build_chunks(symbols, files, commits, pull_requests, pick_readme(listing))
    candidates = stats.glossary_candidates(symbols, files)
    brief = build_brief(
        repositories, files, symbols, stacks, entry_points, module_edges, data_flow, integrations, owners,
        glossary, positions,
    )
    return Ingested(
        files, symbols, dependencies, edges, commits, commit_files, owners, stacks, entry_points, integrations,
        module_edges, positions, data_flow, chunks, candidates, brief,
    )


def brief_prompts(run: Ingested, repositories: DataFrame) -> DataFrame:
    """Architecture prompts of an ingest run."""
    return textgen.brief_requests(
        repositories, run.stacks, run.entry_points, stats.key_modules(run.files),
        textgen.module_symbols(run.symbols, run.files), run.module_edges, run.data_flow, run.integrations,
        stats.file_totals(run.files),
    )
