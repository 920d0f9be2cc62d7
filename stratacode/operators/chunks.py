"""Text chunks for embedding and the embedding step itself."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from stratacode.functions.paths import strip_ws
from stratacode.functions.text import (
    MAX_CHUNK_TOKENS, PART_MARK, commit_chunk, file_chunk, parts_within_budget, pull_request_chunk, readme_chunk, symbol_chunk, window_chars,
    windows, within_budget,
)
from stratacode.operators.common import ordered_texts
from stratacode.operators.edges import EMBEDDABLE_KINDS, has_source, of_kind, with_file

CHUNK_COLUMNS = ("repo_id", "source_type", "source_id", "file_id", "chunk_text")
EMBED_BATCH = 100
KNOWN_WORDS = 500_000  # words whose hash a task remembers


def _fitted(chunks: DataFrame, max_tokens: int, oversize: str) -> DataFrame:
    """Chunks within the budget: longer texts are split into windows, or left out with ``oversize="drop"``.

    The first window keeps the id of its source; later ones add ``PART_MARK`` and their number.
    """
    if oversize == "drop":
        return chunks.where(within_budget(F.col("chunk_text"), max_tokens))
    if oversize != "split":
        raise ValueError(f"oversize is split or drop, not {oversize!r}")
    kept = [F.col(c) for c in chunks.columns if c != "chunk_text"]
    parts = chunks.select(*kept, F.posexplode(parts_within_budget(F.col("chunk_text"), max_tokens)).alias("_part", "chunk_text"))
    marked = F.concat("source_id", F.lit(PART_MARK), F.col("_part").cast("string"))
    return parts.withColumn("source_id", F.when(F.col("_part") == 0, F.col("source_id")).otherwise(marked)).drop("_part")


def embeddable(symbols: DataFrame) -> DataFrame:
    return has_source(of_kind(symbols, EMBEDDABLE_KINDS))


def _symbol_texts(symbols: DataFrame, files: DataFrame) -> DataFrame:
    text = symbol_chunk(F.col("path"), F.col("kind"), F.col("name"), F.col("source_code"))
    return with_file(embeddable(symbols), files).select(
        "repo_id", F.lit("symbol").alias("source_type"), F.col("symbol_id").alias("source_id"), "file_id",
        text.alias("chunk_text"),
    )


def symbol_chunks(symbols: DataFrame, files: DataFrame, max_tokens: int = MAX_CHUNK_TOKENS, oversize: str = "split") -> DataFrame:
    """Chunks of every embeddable symbol, or with ``oversize="drop"`` of those that fit the budget.

    A source to be dropped for its own length is dropped before it is shuffled.
    """
    fitting = symbols.where(within_budget(F.col("source_code"), max_tokens)) if oversize == "drop" else symbols
    return _fitted(_symbol_texts(fitting, files), max_tokens, oversize)


def skipped_counts(symbols: DataFrame, files: DataFrame, max_tokens: int = MAX_CHUNK_TOKENS) -> DataFrame:
    """Kept and skipped symbol chunks per repository."""
    fits = within_budget(F.col("chunk_text"), max_tokens)
    return _symbol_texts(symbols, files).groupBy("repo_id").agg(
        F.count_if(fits).alias("kept"), F.count_if(~fits).alias("skipped")
    )


def unembedded_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files none of whose symbols became a chunk."""
    done = chunks.select("repo_id", "file_id").distinct()
    return files.join(done, ["repo_id", "file_id"], "left_anti")


def file_chunks(
    symbols: DataFrame, files: DataFrame, chunks: DataFrame, max_tokens: int = MAX_CHUNK_TOKENS, oversize: str = "split"
) -> DataFrame:
    """Fallback chunks of a file without symbol chunk: all its symbol sources, in order, in windows within the budget.

    A file's text is never put together: running sums over the lengths of its sources say in which windows each source lies, and only the pieces of one window
    meet.  With ``oversize="drop"`` a file over the budget is left out, as soon as the sum of its lengths is known.
    """
    if oversize not in ("split", "drop"):
        raise ValueError(f"oversize is split or drop, not {oversize!r}")
    size, keys = window_chars(max_tokens), ["repo_id", "file_id"]
    rest = unembedded_files(files.select("repo_id", "file_id", "path"), chunks)
    sources = has_source(symbols)
    spoken = sources.groupBy(*keys).agg(
        F.bool_or(strip_ws(F.col("source_code")) != "").alias("spoken"), (F.sum(F.length("source_code") + 1) - 1).alias("chars")
    ).where("spoken")
    # "# " + path + newline + text
    head = F.length("path") + 3
    wanted = rest.join(spoken, keys)
    if oversize == "drop":
        wanted = wanted.where(head + F.col("chars") <= size)
    placed = ["ordinal", "symbol_id"]
    before = Window.partitionBy(*keys).orderBy(*placed).rowsBetween(Window.unboundedPreceding, -1)
    lengths = sources.select(*keys, *placed, F.length("source_code").alias("n")).join(wanted.select(*keys, "path"), keys)
    starts = lengths.select(*keys, *placed, "path", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)).alias("start"))
    # The first source brings the header, every other one the line break before it.
    opening = F.when(F.col("start") == 0, file_chunk(F.col("path"), F.lit(""))).otherwise("\n")
    at = F.when(F.col("start") == 0, 0).otherwise(head + F.col("start") - 1)
    pieces = starts.join(sources.select(*keys, *placed, "source_code"), [*keys, *placed]).select(
        *keys, *placed, at.alias("at"), F.concat(opening, "source_code").alias("text")
    )
    room = (F.lit(size) - F.col("at") % size).cast("int")
    cut = F.concat(F.array(F.left("text", room)), windows(F.substring("text", room + 1, F.length("text")), size))
    dealt = pieces.select(*keys, *placed, F.floor(F.col("at") / size).alias("first"), F.posexplode(cut).alias("nth", "piece"))
    window = dealt.withColumn("window", F.col("first") + F.col("nth")).where(F.col("piece") != "")
    joined = window.groupBy(*keys, "window").agg(ordered_texts(F.col("piece"), placed, "").alias("chunk_text"))
    marked = F.concat("file_id", F.lit(PART_MARK), F.col("window").cast("string"))
    return joined.select(
        "repo_id", F.lit("symbol").alias("source_type"), F.when(F.col("window") == 0, F.col("file_id")).otherwise(marked).alias("source_id"),
        "file_id", "chunk_text",
    )


def _document_chunks(df: DataFrame, source_type: str, source_id, text, max_tokens: int, oversize: str) -> DataFrame:
    texts = df.select(
        "repo_id", F.lit(source_type).alias("source_type"), source_id.cast("string").alias("source_id"),
        F.lit(None).cast("string").alias("file_id"), text.alias("chunk_text"),
    )
    return _fitted(texts, max_tokens, oversize)


def commit_chunks(commits: DataFrame, max_tokens: int = MAX_CHUNK_TOKENS, oversize: str = "split") -> DataFrame:
    text = commit_chunk(F.col("hash"), F.col("author_name"), F.col("message"))
    return _document_chunks(commits, "commit", F.col("hash"), text, max_tokens, oversize)


def pr_chunks(pull_requests: DataFrame, max_tokens: int = MAX_CHUNK_TOKENS, oversize: str = "split") -> DataFrame:
    text = pull_request_chunk(F.col("number"), F.col("title"), F.col("description"))
    return _document_chunks(pull_requests, "pull_request", F.col("number"), text, max_tokens, oversize)


def doc_chunks(readmes: DataFrame, max_tokens: int = MAX_CHUNK_TOKENS, oversize: str = "split") -> DataFrame:
    """README chunks per repository; empty documents give none."""
    filled = readmes.where(F.col("content") != "")
    return _document_chunks(filled, "document", F.col("repo_id"), readme_chunk(F.col("content")), max_tokens, oversize)


def build_chunks(
    symbols: DataFrame,
    files: DataFrame,
    commits: DataFrame,
    pull_requests: DataFrame,
    readmes: DataFrame,
    max_tokens: int = MAX_CHUNK_TOKENS,
    require_symbols: bool = False,
    oversize: str = "split",
) -> DataFrame:
    """All chunks of all repositories.

    With ``require_symbols`` a repository without any embeddable symbol gives no
    chunk of any kind.  Texts over the budget are split into windows; ``oversize="drop"`` leaves them out.
    """
    from_symbols = symbol_chunks(symbols, files, max_tokens, oversize)
    parts = [
        from_symbols,
        file_chunks(symbols, files, from_symbols, max_tokens, oversize),
        commit_chunks(commits, max_tokens, oversize),
        pr_chunks(pull_requests, max_tokens, oversize),
        doc_chunks(readmes, max_tokens, oversize),
    ]
    chunks = parts[0]
    for part in parts[1:]:
        chunks = chunks.unionByName(part)
    if require_symbols:
        chunks = chunks.join(embeddable(symbols).select("repo_id").distinct(), "repo_id", "left_semi")
    return chunks.select(*CHUNK_COLUMNS)


_WORD = re.compile(r"[A-Za-z0-9_]+")


def _bucket(word: str, dim: int) -> int:
    return int(hashlib.md5(word.lower().encode()).hexdigest()[:8], 16) % dim


def _hashed(dim: int, at: int):
    """Adds unit vectors of hashed word counts to batches whose text is column ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            vectors = np.zeros((batch.num_rows, dim))
            for row, text in enumerate(batch.column(at).to_pylist()):
                found = _WORD.findall(text or "")
                known.update((w, _bucket(w, dim)) for w in set(found).difference(known))
                vectors[row] = np.bincount([known[w] for w in found], minlength=dim)
            if len(known) > KNOWN_WORDS:
                known = {}
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = (vectors / np.where(norms > 0, norms, 1)).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * dim, pa.int32()), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "embedding"])

    return run


def hash_embedding(chunks: DataFrame, dim: int = 256) -> DataFrame:
    """Offline embedding: counts of words (runs of ASCII letters, digits and ``_``, lower case) by the first 32 bits of their md5 modulo ``dim``, scaled to
    unit length; a text without words is a vector of zeros."""
    schema = StructType([*chunks.schema.fields, StructField("embedding", ArrayType(FloatType()))])
    return chunks.mapInArrow(_hashed(dim, chunks.columns.index("chunk_text")), schema)


def embed_chunks(
    chunks: DataFrame,
    fn: Callable[[list[str]], np.ndarray] | None = None,
    dim: int = 256,
    batch_size: int = EMBED_BATCH,
) -> DataFrame:
    """Chunks with an ``embedding`` column.

    ``fn`` maps a list of texts to a (len, dim) array and is called with at most
    ``batch_size`` texts; without it the offline hashing embedding is used.
    """
    if fn is None:
        return hash_embedding(chunks, dim)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size]
                vectors = np.asarray(fn(part["chunk_text"].tolist()), dtype=np.float32)
                yield part.assign(embedding=list(vectors))

    schema = StructType([*chunks.schema.fields, StructField("embedding", ArrayType(FloatType()))])
    return chunks.mapInPandas(run, schema)
