"""Tables of text-generation requests and the tables built from the responses."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacode.functions.paths import strip_ws, top_dir
from stratacode.operators.common import batch_of_rank, ordered_items, top_k
from stratacode.operators.edges import TARGET_KINDS, of_kind, with_file

# Request sizes.
ANNOTATION_BATCH, GLOSSARY_BATCH = 10, 25
SOURCE_PREVIEW = 300
ENTRY_PREVIEW, MODULE_SYMBOL_PREVIEW, EDGE_PREVIEW, FLOW_PREVIEW = 8, 8, 20, 20
NO_NARRATIVE = "Architecture summary could not be generated."

ANNOTATION_TASK = (
    "Each line below is a JSON object about one file, in reading order. For every file say in one or two sentences what a newcomer gains from reading it now. "
    'Answer with a JSON array of {"file_path": ..., "annotation": ...}.'
)
GLOSSARY_TASK = (
    "Each line below is a JSON object about one symbol. For every symbol write one or two sentences that say what it is for. "
    'Answer with a JSON array of {"name": ..., "definition": ...}.'
)
BRIEF_TASK = (
    "Each line below is a JSON object about one aspect of a repository. Write five to eight sentences on its architecture: what it does, how it is divided, "
    "how data and control move, what it depends on. Name nothing that the lines do not name."
)


@dataclass(frozen=True)
class Section:
    """A line of a brief prompt: the rows of a table as JSON objects of some columns, the first ``shown`` by ``order`` (all with None)."""

    name: str
    order: tuple[str, ...]
    columns: tuple[str, ...]
    shown: int | None = None


BRIEF_SECTIONS = (
    Section("entry_points", ("path",), ("path",), ENTRY_PREVIEW),
    Section("key_modules", ("rank",), ("path", "fan_in", "criticality")),
    Section("modules", ("module",), ("module", "lines", "n_more")),
    Section("module_edges", ("src_module", "tgt_module"), ("src_module", "tgt_module"), EDGE_PREVIEW),
    Section("data_flow", ("step",), ("hop", "from_path", "to_path"), FLOW_PREVIEW),
    Section("integrations", ("integration",), ("integration",)),
)


def _json(item: Column) -> Column:
    return F.to_json(item, {"ignoreNullFields": "false"})


def _batched(rows: DataFrame, rank: str, size: int, item: Column, task: str) -> DataFrame:
    """One prompt per ``size`` rows of a repository: the task, then a JSON object a line."""
    return (
        batch_of_rank(rows, rank, size).groupBy("repo_id", "batch_id")
        .agg(F.count(F.lit(1)).alias("n_items"), F.array_join(ordered_items(_json(item), ["batch_pos"]), "\n").alias("items"))
        .withColumn("prompt", F.concat(F.lit(task + "\n"), F.col("items")))
    )


def annotation_requests(order: DataFrame, task: str = ANNOTATION_TASK, max_files: int | None = None) -> DataFrame:
    """One prompt per ten files of each reading order, or of its first ``max_files``."""
    wanted = order if max_files is None else order.where(F.col("position") <= max_files)
    language = F.coalesce(F.nullif("language", F.lit("")), F.lit("unknown"))
    item = F.struct(F.col("path").alias("file_path"), "fan_in", "fan_out", "tier", language.alias("language"))
    return _batched(wanted, "position", ANNOTATION_BATCH, item, task)


def glossary_requests(candidates: DataFrame, task: str = GLOSSARY_TASK, source_chars: int | None = None) -> DataFrame:
    """One prompt per 25 glossary candidates (they carry ``rank``), with their sources or the first ``source_chars`` characters of them."""
    source = F.col("source_code") if source_chars is None else F.left("source_code", F.lit(source_chars))
    item = F.struct("name", "path", F.array("start_line", "end_line").alias("lines"), source.alias("source"))
    return _batched(candidates, "rank", GLOSSARY_BATCH, item, task)


def parse_responses(responses: DataFrame, item_schema: str) -> DataFrame:
    """Rows of the JSON arrays in a response table; fences are stripped, bad JSON gives no rows.

    ``item_pos`` is the index of the item in its response.
    """
    clean = F.regexp_replace(strip_ws(F.col("text")), r"^```(?:json)?|```$", "")
    items = F.from_json(strip_ws(clean), f"array<struct<{item_schema}>>")
    return responses.select("repo_id", "batch_id", F.posexplode(items).alias("item_pos", "item")).select(
        "repo_id", "batch_id", "item_pos", "item.*"
    )


def build_glossary(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """Glossary entries: candidates whose name was defined, any case; the last definition of a name wins."""
    definitions = (
        parse_responses(responses, "name:string,definition:string")
        .groupBy("repo_id", F.lower("name").alias("key"))
        .agg(F.max_by("definition", F.struct("batch_id", "item_pos")).alias("definition"))
    )
    return (
        candidates.withColumn("key", F.lower("name"))
        .join(definitions, ["repo_id", "key"])
        .where(F.col("definition") != "")
        .select(
            "repo_id", "symbol_id", "name", "definition", F.col("path").alias("file_path"),
            F.col("start_line").alias("line_number"),
        )
    )


def attach_annotations(order: DataFrame, responses: DataFrame) -> DataFrame:
    """Reading order with the annotation of each path, empty where none came back."""
    notes = (
        parse_responses(responses, "file_path:string,annotation:string")
        .where("file_path <> '' AND annotation <> ''")
        .groupBy("repo_id", F.col("file_path").alias("path"))
        .agg(F.max_by("annotation", F.struct("batch_id", "item_pos")).alias("note"))
    )
    return (
        order.join(notes, ["repo_id", "path"], "left")
        .withColumn("annotation", F.coalesce("note", F.lit(""))).drop("note")
    )


def attach_narrative(repositories: DataFrame, responses: DataFrame) -> DataFrame:
    """Repositories with their architecture text, or the fixed fallback."""
    text = responses.select("repo_id", F.nullif(strip_ws(F.col("text")), F.lit("")).alias("_text"))
    return repositories.join(text, "repo_id", "left").withColumn(
        "architecture_summary", F.coalesce("_text", F.lit(NO_NARRATIVE))
    ).drop("_text")


def module_symbols(symbols: DataFrame, files: DataFrame, k: int = MODULE_SYMBOL_PREVIEW) -> DataFrame:
    """Per module: first ``k`` symbol lines (by path, then line) and how many more there are.

    Only ``k`` lines of a module are collected; the rest is a count.
    """
    rows = with_file(
        of_kind(symbols, TARGET_KINDS).select("repo_id", "file_id", "symbol_id", "kind", "name", "start_line"), files
    ).withColumn("module", top_dir(F.col("path")))
    line = F.concat_ws(" ", "kind", "name", F.lit("at"), F.concat("path", F.lit(":"), F.col("start_line").cast("string")))
    totals = rows.groupBy("repo_id", "module").agg(F.count(F.lit(1)).alias("n_symbols"))
    shown = top_k(rows, ["repo_id", "module"], ["path", "start_line", "symbol_id"], k).groupBy("repo_id", "module").agg(
        ordered_items(line, ["rank"]).alias("lines")
    )
    return shown.join(totals, ["repo_id", "module"]).withColumn(
        "n_more", F.greatest(F.col("n_symbols") - k, F.lit(0))
    )


def _section(table: DataFrame, section: Section) -> DataFrame:
    """(repo_id, line): the line of one section per repository that has rows of it."""
    rows = table if section.shown is None else top_k(table, ["repo_id"], list(section.order), section.shown, "_shown")
    items = ordered_items(F.struct(*section.columns), list(section.order))
    return rows.groupBy("repo_id").agg(items.alias("items")).select(
        "repo_id", _json(F.struct(F.lit(section.name).alias("section"), "items")).alias("line"))


def brief_requests(
    repositories: DataFrame,
    stacks: DataFrame,
    entry_points: DataFrame,
    key_modules: DataFrame,
    modules: DataFrame,
    module_edges: DataFrame,
    data_flow: DataFrame,
    integrations: DataFrame,
    file_counts: DataFrame,
    max_modules: int | None = None,
    task: str = BRIEF_TASK,
) -> DataFrame:
    """One architecture prompt per repository with files: the task, the repository and its stack, then the lines of ``BRIEF_SECTIONS``.

    A section is cut to its preview length before it is collected; a repository without rows of a section has no such line.  ``max_modules`` bounds the
    module section for repositories with very many top directories.
    """
    tables = dict(zip([s.name for s in BRIEF_SECTIONS], (entry_points, key_modules, modules, module_edges, data_flow, integrations)))
    joined = file_counts.select("repo_id", "total_files").join(repositories.select("repo_id", "name"), "repo_id").join(stacks, "repo_id", "left")
    lines = []
    for section in BRIEF_SECTIONS:
        cut = replace(section, shown=max_modules) if section.name == "modules" else section
        joined = joined.join(_section(tables[section.name], cut).withColumnRenamed("line", f"_{section.name}"), "repo_id", "left")
        lines.append(F.col(f"_{section.name}"))
    none = F.array().cast("array<string>")
    stack = [F.coalesce(F.col(c), none).alias(c) for c in ("languages", "frameworks", "databases", "ci_cd")]
    head = _json(F.struct(F.lit("repository").alias("section"), "name", F.col("total_files").alias("files"), *stack))
    return joined.select("repo_id", F.concat_ws("\n", F.lit(task), head, *lines).alias("prompt"))
