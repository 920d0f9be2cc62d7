"""Exact vector retrieval per repository, source look-up and prompt context."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratacode.functions.text import PART_MARK
from stratacode.operators.common import broadcast_if_small, number_rows, ordered_items, top_k
from stratacode.session import cut_lineage

# Hits per source type, in display order.
QUOTAS = {"symbol": 6, "commit": 2, "pull_request": 1, "document": 1}
# Joiner of context blocks and the answer when nothing was found.
BLOCK_SEPARATOR = "\n\n---\n\n"
NO_HIT_ANSWER = "No relevant code was found in this repository for your question."
HISTORY_TURNS = 5
DISTANCE_DECIMALS = 9

SYSTEM_INSTRUCTIONS = (
    "Answer the question about this repository from the numbered sources only. "
    "Cite files, lines, commits or pull requests. Say so when the sources do not hold the answer."
)

_HITS = "repo_id string, query_id string, bucket string, source_id string, distance double"


class _Slab:
    """Some questions by repository, as unit vectors by their length.  A question without a direction asks for nothing."""

    def __init__(self, questions: pa.Table | pa.RecordBatch) -> None:
        repos, ids = (questions.column(c).to_pylist() for c in ("repo_id", "query_id"))
        self.by_repo: dict[str, dict[int, tuple[list[str], np.ndarray]]] = {}
        for unit, kept in _directions(questions.column("embedding")):
            rows: dict[str, list[int]] = {}
            for at, row in enumerate(kept.tolist()):
                rows.setdefault(repos[row], []).append(at)
            for repo, at in rows.items():
                self.by_repo.setdefault(repo, {})[unit.shape[1]] = ([ids[kept[i]] for i in at], unit[at])


def _directions(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(unit vectors, their rows) of the vectors that have a direction, finite and not zero, one pair for each length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == dim)
        matrix = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
        largest = np.abs(matrix).max(axis=1)
        good = np.isfinite(largest) & (largest > 0)
        if good.any():
            matrix = matrix[good] / largest[good, None]
            yield matrix / np.linalg.norm(matrix, axis=1, keepdims=True), rows[good]


class _Best:
    """The nearest ``k`` so far of each question, by (distance, id)."""

    def __init__(self, questions: int, k: int) -> None:
        self.k = k
        self.bound = np.full(questions, np.inf)  # no distance beyond it can enter
        self.hits: list[list[tuple[float, str]]] = [[] for _ in range(questions)]

    def add(self, distances: np.ndarray, ids: list[str]) -> None:
        for row in np.flatnonzero(distances.min(axis=1) <= self.bound):
            near = np.flatnonzero(distances[row] <= self.bound[row])
            if len(near) > self.k:
                limit = np.partition(distances[row][near], self.k - 1)[self.k - 1]
                near = near[distances[row][near] <= limit]
            found = self.hits[row] + [(float(distances[row][i]), ids[i]) for i in near]
            # Ids are compared as Spark compares them, by their UTF-8 bytes.
            self.hits[row] = sorted(found, key=lambda hit: (hit[0], hit[1].encode("utf-8")))[: self.k]
            if len(self.hits[row]) == self.k:
                self.bound[row] = self.hits[row][-1][0]


class _Search:
    """The nearest vectors of the questions of one slab among the batches that pass."""

    def __init__(self, slab: _Slab, quotas: dict[str, int], vector_block: int) -> None:
        self.asked, self.quotas, self.vector_block = slab.by_repo, quotas, vector_block
        self.best: dict[tuple[str, str, int], _Best] = {}

    def add(self, whole: pa.RecordBatch) -> None:
        """``whole`` has repo_id, bucket, source_id, embedding."""
        for start in range(0, whole.num_rows, self.vector_block):
            batch = whole.slice(start, self.vector_block)
            for unit, rows in _directions(batch.column(3)):
                dim = unit.shape[1]
                repos, buckets, ids = (batch.column(i).take(pa.array(rows)).to_pylist() for i in range(3))
                groups: dict[tuple[str, str], list[int]] = {}
                for i, key in enumerate(zip(repos, buckets)):
                    if dim in self.asked.get(key[0], ()):
                        groups.setdefault(key, []).append(i)
                for (repo, bucket), at in groups.items():
                    query_ids, questions = self.asked[repo][dim]
                    state = self.best.setdefault((repo, bucket, dim), _Best(len(query_ids), self.quotas[bucket]))
                    state.add(np.round(1.0 - questions @ unit[at].T, DISTANCE_DECIMALS), [ids[i] for i in at])

    def found(self) -> Iterator[pa.RecordBatch]:
        for (repo, bucket, dim), state in self.best.items():
            hits = [(repo, q, bucket, i, d) for q, near in zip(self.asked[repo][dim][0], state.hits) for d, i in near]
            if hits:
                columns = [pa.array(c, pa.string()) for c in list(zip(*hits))[:4]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([h[4] for h in hits])], ["repo_id", "query_id", "bucket", "source_id", "distance"])


def _nearest(slab, quotas: dict[str, int], vector_block: int):
    """Kernel over the vectors of a task: keeps the quota of each question and nothing else."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(slab.value, quotas, vector_block)
        for batch in batches:
            search.add(batch)
        yield from search.found()

    return kernel


_CELL = ["repo_id", "block", "slice"]


def _nearest_by_cell(quotas: dict[str, int], vector_block: int):
    """Kernel over rows sorted by cell, the questions of each cell (those that ask) before its vectors."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asking, search = None, [], None
        for batch in batches:
            new = np.zeros(batch.num_rows, bool)
            new[:1] = True
            for name in (*_CELL, "asks"):
                codes = pc.dictionary_encode(batch.column(name), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(new).tolist()
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                part = batch.slice(start, end - start)
                *at, asks = (part.column(name)[0].as_py() for name in (*_CELL, "asks"))
                if at != cell:
                    if search is not None:
                        yield from search.found()
                    cell, asking, search = at, [], None
                if asks:
                    asking.append(part.select(["repo_id", "id", "embedding"]).rename_columns(["repo_id", "query_id", "embedding"]))
                elif asking:
                    search = search or _Search(_Slab(pa.Table.from_batches(asking)), quotas, vector_block)
                    search.add(part.select(["repo_id", "bucket", "id", "embedding"]))
        if search is not None:
            yield from search.found()

    return kernel


# Slabs of questions that are sent through the driver at most, and vectors of a repository that one cell sees.
SLABS = 8
CELL_VECTORS = 1 << 16


def _cells(vectors: DataFrame, questions: DataFrame, query_block: int) -> DataFrame:
    """Questions and vectors by cell: each block of ``query_block`` questions of a repository meets each slice of its vectors in one cell.

    A question goes to every slice and a vector to every block of its repository, so a repository of any size is spread over tasks and none is held whole.
    """
    def counted(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("repo_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("bigint").alias(name))

    asking = counted(questions, query_block, "blocks").withColumnRenamed("repo_id", "of")
    grid = asking.join(counted(vectors, CELL_VECTORS, "slices"), F.col("of").eqNullSafe(F.col("repo_id"))).drop("repo_id")
    grid = broadcast_if_small(grid)  # without the repositories that have no vector or no question
    first = F.lit(0).cast("bigint")

    def dealt(df: DataFrame, block, part) -> DataFrame:
        placed = df.join(grid, F.col("repo_id").eqNullSafe(F.col("of"))).withColumn("own", F.xxhash64("id", "embedding"))
        return placed.select(*df.columns, block.alias("block"), "slices", "own").select(*df.columns, "block", part.alias("slice"))

    every_block, every_slice = (F.explode(F.sequence(first, F.col(n) - 1)) for n in ("blocks", "slices"))
    own_block, own_slice = (F.pmod("own", F.col(n)) for n in ("blocks", "slices"))
    asked = questions.select("repo_id", F.lit(None).cast("string").alias("bucket"), F.col("query_id").alias("id"), "embedding", F.lit(True).alias("asks"))
    known = vectors.select("repo_id", "bucket", F.col("source_id").alias("id"), "embedding", F.lit(False).alias("asks"))
    return dealt(asked, own_block, every_slice).unionAll(dealt(known, every_block, own_slice))


def _slabs(questions: DataFrame, n: int, size: int) -> Iterator[_Slab]:
    """The ``n`` questions in slabs of at most ``size``, neighbours by repository."""
    if n <= size:
        yield _Slab(questions.toArrow())
        return
    placed = cut_lineage(number_rows(questions.withColumn("_all", F.lit(0)), ["_all"], ["repo_id", "query_id"], "_at"))
    for start in range(0, n, size):
        yield _Slab(placed.where(F.col("_at").between(start + 1, start + size)).toArrow())


def _search(vectors: DataFrame, queries: DataFrame, quotas: dict[str, int], vector_block: int, query_block: int) -> DataFrame:
    """Candidates per (question, bucket): the nearest of every task.

    Up to ``SLABS`` slabs of ``query_block`` questions go to the vectors where they lie, one pass each.  More questions meet the vectors in cells of one repository;
    no question or vector passes the driver then, and a vector moves once for each ``query_block`` questions of its repository.  Only the quota of a
    question leaves a task or a cell.
    """
    spark = vectors.sparkSession
    narrow = vectors.select("repo_id", "bucket", "source_id", "embedding")
    questions = cut_lineage(queries.select("repo_id", "query_id", "embedding"))
    n = questions.count()
    if n > SLABS * query_block:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # small rows that take long: not to be coalesced by their size
        cells = _cells(narrow, questions, query_block).repartition(tasks, *_CELL).sortWithinPartitions(*_CELL, F.desc("asks"), "bucket")
        return cells.mapInArrow(_nearest_by_cell(quotas, vector_block), _HITS)
    passes = [narrow.mapInArrow(_nearest(spark.sparkContext.broadcast(slab), quotas, vector_block), _HITS) for slab in _slabs(questions, n, query_block)]
    return reduce(DataFrame.unionAll, passes)


def vector_topk(embeddings: DataFrame, queries: DataFrame, k: int = 10, vector_block: int = 2048, query_block: int = 1024) -> DataFrame:
    """``k`` nearest chunks of the question's repository by cosine distance, ties by source_id.

    Vectors that are zero, hold a null, NaN or infinite number, or have another length than the question have no direction and are no hits.
    ``query_block`` questions meet the vectors at a time, ``vector_block`` vectors go into one product.
    """
    vectors = embeddings.select("repo_id", F.lit("all").alias("bucket"), F.col("source_id"), "embedding")
    partial = _search(vectors, queries, {"all": k}, vector_block, query_block)
    return top_k(partial, ["repo_id", "query_id"], ["distance", "source_id"], k).drop("bucket")


def quota_topk(
    embeddings: DataFrame,
    queries: DataFrame,
    quotas: dict[str, int] | None = None,
    vector_block: int = 2048,
    query_block: int = 1024,
) -> DataFrame:
    """Nearest chunks per source type, the types in quota order: ``hit_no`` counts through them."""
    quotas = dict(quotas or QUOTAS)
    vectors = embeddings.where(F.col("source_type").isin(*quotas)).select(
        "repo_id", F.col("source_type").alias("bucket"), "source_id", "embedding"
    )
    partial = _search(vectors, queries, quotas, vector_block, query_block)
    quota, type_no = F.lit(0), F.lit(0)
    for no, (name, limit) in enumerate(quotas.items()):
        quota = F.when(F.col("bucket") == name, F.lit(limit)).otherwise(quota)
        type_no = F.when(F.col("bucket") == name, F.lit(no)).otherwise(type_no)
    hits = (
        top_k(partial, ["repo_id", "query_id", "bucket"], ["distance", "source_id"], max(quotas.values()))
        .where(F.col("rank") <= quota)
        .withColumn("type_no", type_no)
    )
    display = Window.partitionBy("repo_id", "query_id").orderBy("type_no", "rank")
    return hits.select(
        "repo_id", "query_id", F.col("bucket").alias("source_type"), "source_id", "distance",
        F.row_number().over(display).alias("hit_no"),
    )


def resolve_sources(
    hits: DataFrame, embeddings: DataFrame, symbols: DataFrame, files: DataFrame, commits: DataFrame, pull_requests: DataFrame
) -> DataFrame:
    """Hits with the text and the fields of the symbol, commit or pull request behind them.

    A source that cannot be found keeps null fields.  A part of a long text has the fields of its source.
    """
    of_type = F.col("source_type")
    key, behind = ["repo_id", "source_type", "source_id"], ["repo_id", "source_type", "origin"]
    hits = cut_lineage(hits).withColumn("origin", F.substring_index("source_id", PART_MARK, 1))
    # The tables behind the hits are cut down to the hits first; few hits are broadcast,
    # so that none of these tables is shuffled for a handful of rows.
    wanted = broadcast_if_small(hits.select(*key, "origin").distinct())

    def hit(df: DataFrame) -> DataFrame:
        return df.join(wanted, behind, "left_semi")

    texts = embeddings.select(*key, "file_id", "chunk_text").join(wanted, key, "left_semi")
    symbol = symbols.select(
        "repo_id", F.lit("symbol").alias("source_type"), F.col("symbol_id").alias("origin"),
        F.col("name").alias("symbol_name"), "start_line", "end_line",
    )
    commit = commits.select(
        "repo_id", F.lit("commit").alias("source_type"), F.col("hash").alias("origin"),
        F.col("hash").alias("commit_hash"), "author_name",
    )
    request = pull_requests.select(
        "repo_id", F.lit("pull_request").alias("source_type"), F.col("number").cast("string").alias("origin"),
        F.col("number").alias("pr_number"), F.col("title").alias("pr_title"),
    )
    path = files.select("repo_id", "file_id", F.col("path").alias("file_path"))
    return (
        hits.join(texts, key)
        .join(hit(symbol), behind, "left")
        .join(hit(commit), behind, "left")
        .join(hit(request), behind, "left")
        .join(path, ["repo_id", "file_id"], "left")
        .select(
            "repo_id", "query_id", "hit_no", "source_type", "source_id", "distance", "chunk_text",
            F.when(of_type == "symbol", F.col("file_path")).alias("file_path"),
            "symbol_name", "start_line", "end_line", "commit_hash", "author_name", "pr_number", "pr_title",
        )
    )


def _shown(name: str):
    # Fixed value: how a missing field is printed.
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def source_header():
    """Numbered header line of a source, by type."""
    number = F.concat(F.lit("[Source "), F.col("hit_no").cast("string"), F.lit("] "))
    kind = F.col("source_type")
    code = F.concat(
        F.lit("[Code] "), _shown("file_path"), F.lit(" — "), _shown("symbol_name"),
        F.lit(" (lines "), _shown("start_line"), F.lit("–"), _shown("end_line"), F.lit(")"),
    )
    commit = F.concat(F.lit("[Commit] "), _shown("commit_hash"), F.lit(" by "), _shown("author_name"))
    request = F.concat(F.lit("[PR #"), _shown("pr_number"), F.lit("] "), _shown("pr_title"))
    return F.concat(
        number,
        F.when(kind == "symbol", code).when(kind == "commit", commit)
        .when(kind == "pull_request", request).otherwise(F.lit("[README]")),
    )


def build_context(sources: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per question: context text, number of sources, and the fixed answer when there are none."""
    block = F.concat(source_header(), F.lit("\n"), F.col("chunk_text"))
    joined = sources.groupBy("repo_id", "query_id").agg(
        F.array_join(ordered_items(block, ["hit_no"]), BLOCK_SEPARATOR).alias("context"),
        F.count(F.lit(1)).alias("n_sources"),
    )
    return queries.select("repo_id", "query_id", "question").join(joined, ["repo_id", "query_id"], "left").select(
        "repo_id", "query_id", "question", "context", F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
        F.when(F.col("n_sources").isNull(), F.lit(NO_HIT_ANSWER)).alias("answer"),
    )


def last_turns(turns: DataFrame, n: int = HISTORY_TURNS) -> DataFrame:
    """The newest ``n`` turns of each conversation."""
    return top_k(turns, ["repo_id", "query_id"], [F.desc("turn")], n, "_age").drop("_age")


def build_messages(contexts: DataFrame, turns: DataFrame, instructions: str = SYSTEM_INSTRUCTIONS) -> DataFrame:
    """Message array per answered question: context, the last turns, the question."""
    message = F.struct("role", "content")
    history = last_turns(turns).groupBy("repo_id", "query_id").agg(ordered_items(message, ["turn"]).alias("history"))
    system = F.concat(
        F.lit(instructions + "\n\n## Context\n"), F.col("context"), F.lit("\n\n## Question\n"), F.col("question"),
    )

    def said(role, content):
        return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))

    none = F.array().cast("array<struct<role:string,content:string>>")
    return contexts.where(F.col("n_sources") > 0).join(history, ["repo_id", "query_id"], "left").select(
        "repo_id", "query_id",
        F.concat(said("system", system), F.coalesce("history", none), said("user", F.col("question"))).alias("messages"),
    )


def with_citation(sources: DataFrame, repositories: DataFrame) -> DataFrame:
    """Sources with the labels and the link a reader sees."""
    kind = F.col("source_type")
    path = F.col("file_path")
    label = (
        F.when(kind == "symbol", F.when(F.col("symbol_name") == "<anonymous>", F.lit("")).otherwise(F.col("symbol_name")))
        .when(kind == "commit", F.coalesce(F.left("commit_hash", F.lit(7)), F.col("author_name"), F.lit("")))
        .when(kind == "pull_request", F.concat(F.lit("PR #"), _shown("pr_number")))
        .otherwise(F.coalesce(F.substring_index(path, "/", -1), F.lit("Source")))
    )
    sub_label = (
        F.when(kind == "commit", F.coalesce(F.concat(F.lit("by "), F.col("author_name")), F.lit("")))
        .when(kind == "pull_request", F.coalesce("pr_title", F.lit("")))
        .otherwise(F.coalesce(path, F.lit("")))
    )
    url = F.col("github_url")
    href = (
        F.when(
            path.isNotNull(),
            F.concat(url, F.lit("/blob/master/"), path, F.lit("#L"), F.col("start_line").cast("string"),
                     F.lit("-L"), F.col("end_line").cast("string")),
        )
        .when(F.col("commit_hash").isNotNull(), F.concat(url, F.lit("/commit/"), F.col("commit_hash")))
        .when(F.col("pr_number").isNotNull(), F.concat(url, F.lit("/pull/"), F.col("pr_number").cast("string")))
    )
    return (
        sources.join(repositories.select("repo_id", "github_url"), "repo_id", "left")
        .withColumn("primary_label", label).withColumn("sub_label", sub_label).withColumn("href", href)
        .drop("github_url")
    )


def glossary_link(github_url, file_path, line_number):
    """Link to the line a glossary entry is defined on."""
    return F.concat(github_url, F.lit("/blob/master/"), file_path, F.lit("#L"), line_number.cast("string"))
