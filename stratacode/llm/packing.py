"""Hierarchical multi-length packing of tokenised documents.

A document goes to the shortest context tier (a power of two) that holds it; what exceeds the longest tier is cut into
full windows first.  Long windows are packed before short ones: the longest remaining piece opens a window of its tier, whole
documents of the shorter tiers fill the gap best-fit first, and the last few tokens are cut from the longest waiting piece.  So
every window is full.  What is left at the end of a task, less than the longest tier, is laid
into windows at its binary digits.  Windows of one tier then form step groups of equal token counts.

Packing reads each document once, in the task that scans it; a task holds ``buffer_tokens`` at a time.  Only counts of windows per
task and tier are shuffled to number the step groups.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as st

from stratacode.llm.staging import stage
from stratacode.llm.tokens import encoder

TIERS = (256, 512, 1024, 2048, 4096)
END_ID = 2
GROUP_TOKENS = 1 << 16
SEQUENCES_PER_TASK = 1 << 32


class Pool:
    """Waiting pieces ``(document, start, length)`` by length."""

    def __init__(self, pieces=()) -> None:
        self.sizes: list[int] = []
        self.by: dict[int, list[tuple[int, int]]] = {}
        self.tokens = 0
        for piece in pieces:
            self.add(*piece)

    def add(self, doc: int, start: int, length: int) -> None:
        if not length:
            return
        if length not in self.by:
            insort(self.sizes, length)
            self.by[length] = []
        self.by[length].append((doc, start))
        self.tokens += length

    def take(self, at: int) -> tuple[int, int, int]:
        length = self.sizes[at]
        doc, start = self.by[length].pop()
        if not self.by[length]:
            del self.by[length], self.sizes[at]
        self.tokens -= length
        return doc, start, length

    def largest(self) -> tuple[int, int, int]:
        return self.take(len(self.sizes) - 1)

    def fill(self, room: int) -> list[tuple[int, int, int]]:
        """Pieces of exactly ``room`` tokens: whole ones that fit, the longest first, then the end of the longest waiting one."""
        out = []
        while room:
            at = bisect_right(self.sizes, room) - 1
            if at >= 0:
                piece = self.take(at)
            else:
                doc, start, length = self.largest()
                self.add(doc, start, length - room)
                piece = (doc, start + length - room, room)
            out.append(piece)
            room -= piece[2]
        return out

    def rest(self) -> list[tuple[int, int, int]]:
        return [(doc, start, size) for size in self.sizes for doc, start in self.by[size]]


def pack(pool: Pool, tiers: tuple[int, ...] = TIERS) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Full windows ``(tier, pieces)``, long tiers first; leaves fewer tokens than the tier of the longest piece."""
    while pool.tokens:
        longest = pool.sizes[-1]
        tier = next((t for t in tiers if t >= longest), tiers[-1])
        if pool.tokens < tier:
            return
        if longest > tier:
            doc, start, length = pool.largest()
            pool.add(doc, start + tier, length - tier)
            yield tier, [(doc, start, tier)]
            continue
        first = pool.largest()
        yield tier, [first, *pool.fill(tier - first[2])]


def pack_tail(pool: Pool, longest: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """The rest in windows of falling powers of two, each full."""
    while pool.tokens:
        size = min(longest, 1 << (pool.tokens.bit_length() - 1))
        yield size, pool.fill(size)


def _schema(id_field: st.StructField) -> st.StructType:
    return st.StructType([
        st.StructField("doc_id", id_field.dataType), st.StructField("start", st.LongType()), st.StructField("length", st.LongType()),
        st.StructField("doc_tokens", st.LongType()), st.StructField("tier", st.LongType()), st.StructField("sequence_id", st.LongType()),
        st.StructField("offset", st.LongType()), st.StructField("tier_rank", st.LongType()), st.StructField("ids", st.BinaryType()),
    ])


def _packer(path: str, tiers: tuple[int, ...], end_id: int, buffer_tokens: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        sequence = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        docs: dict[int, tuple[object, bytes]] = {}
        ranks: dict[int, int] = {}
        pool, seen = Pool(), 0

        def batch(windows) -> pa.RecordBatch:
            nonlocal sequence
            columns: list[list] = [[] for _ in range(9)]
            for tier, pieces in windows:
                offset = 0
                for doc, start, length in pieces:
                    key, ids = docs[doc]
                    row = (key, start, length, len(ids) // 4, tier, sequence, offset, ranks.get(tier, 0), ids[4 * start : 4 * (start + length)])
                    for column, value in zip(columns, row):
                        column.append(value)
                    offset += length
                sequence += 1
                ranks[tier] = ranks.get(tier, 0) + 1
            types = [id_type, *[pa.int64()] * 7, pa.binary()]
            names = ["doc_id", "start", "length", "doc_tokens", "tier", "sequence_id", "offset", "tier_rank", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        id_type = pa.int64()
        for rows in batches:
            id_type = rows.schema.field(0).type
            for key, ids in zip(rows.column(0).to_pylist(), encode.batch(rows.column(1))):
                ids += end
                docs[seen] = (key, ids)
                pool.add(seen, 0, len(ids) // 4)
                seen += 1
                if pool.tokens >= buffer_tokens:
                    yield batch(pack(pool, tiers))
                    waiting = {doc for doc, _, _ in pool.rest()}
                    docs = {doc: docs[doc] for doc in waiting}
        encode.forget()
        yield batch(pack(pool, tiers))
        yield batch(pack_tail(pool, tiers[-1]))

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, id_col: str = "doc_id",
                   text_col: str = "text", buffer_tokens: int = 1 << 20, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece of a document in a training window.

    Columns: doc_id, start, length (of the document's ids, which end with ``end_id``), doc_tokens, tier (length of the window),
    sequence_id, offset, ids (little-endian unsigned 32-bit) and step_group: windows of one tier are
    numbered over all tasks and grouped by ``group_tokens`` tokens, so every step (tier, step_group) but the last of its tier costs the same.

    Null and empty texts hold only ``end_id``; repeated rows are packed as often as they occur; a null id is
    kept; an empty table gives no rows.  Other columns of ``docs`` are not carried.
    """
    if any(t & (t - 1) or t < 1 for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers are ascending powers of two")
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    pieces = stage(narrow.mapInArrow(_packer(tokenizer_path, tiers, end_id, buffer_tokens), _schema(narrow.schema["doc_id"])), "pieces")
    # Windows of a tier are numbered over all tasks: counts per task and tier give each task its first number.
    task = F.shiftright("sequence_id", 32).alias("_task")
    counts = pieces.where(F.col("offset") == 0).groupBy("tier", task).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("tier").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tier", "_task", before.alias("_before"))
    rank = F.col("_before") + F.col("tier_rank")
    return (
        pieces.withColumn("_task", task).join(starts, ["tier", "_task"])
        .withColumn("step_group", F.floor(rank * F.col("tier") / F.lit(group_tokens)).cast("bigint"))
        .select("doc_id", "start", "length", "doc_tokens", "tier", "sequence_id", "offset", "step_group", "ids")
    )
