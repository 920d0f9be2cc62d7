"""Best-fit packing by minimum bin slack.

A sequence is opened by the longest waiting piece; a subset-sum dynamic program over the lengths that wait, kept as the bits of one integer,
finds the fullest combination for the room that is left, and this combination leaves the pool.  Only texts longer than a sequence are cut.

Each task packs the documents that it reads, at most ``buffer_tokens`` at a time.  Toward its end, where lengths get scarce, it stops at the
first sequence that cannot be filled while less than ``rest_tokens`` wait; these rests of ``merge_tasks`` tasks are packed together.  So
there is about one sequence with much padding for every ``merge_tasks`` tasks, and nothing but the rests is shuffled.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st
from pyspark.sql.pandas.types import to_arrow_schema

from stratacode.llm.staging import stage
from stratacode.llm.tokens import encoder

ROOM = 2048
END_ID = 0
TASK_BITS = 32
MERGED = 1 << 62  # sequence numbers of merged rests start here
ROWS = 4096  # pieces per Arrow batch

# (doc_id, piece, start, doc_tokens, ids) as it waits; its length is the key it waits under.
Piece = tuple[object, int, int, int, bytes]


def fullest(sizes: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Lengths, with repeats, of the combination of largest sum that is at most ``room``.

    ``sizes`` holds the distinct lengths in ascending order, ``counts`` how many of each there are.  Bit ``s`` of ``reach`` is set if some
    combination of the lengths seen so far sums to ``s``; copies of one length enter in steps of 1, 2, 4, ... copies.  Long lengths
    enter first, and a full room ends the search.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    at = bisect_right(sizes, room) - 1
    while at >= 0 and not reach >> room & 1:
        size = sizes[at]
        left, copies = min(counts[size], room // size), 1
        while left:
            copies = min(copies, left)
            steps.append((size, copies, reach))
            reach |= reach << size * copies & mask
            if reach >> room & 1:
                break
            left -= copies
            copies *= 2
        at -= 1
    total, out = reach.bit_length() - 1, []
    for size, copies, before in reversed(steps):
        if not before >> total & 1:
            out += [size] * copies
            total -= size * copies
    return out


class Pool:
    """Pieces that wait for a sequence, by length."""

    def __init__(self, room: int) -> None:
        self.room, self.tokens = room, 0
        self.sizes: list[int] = []
        self.counts: dict[int, int] = {}
        self.waiting: dict[int, list[Piece]] = {}

    def add(self, length: int, piece: Piece) -> None:
        if length not in self.counts:
            insort(self.sizes, length)
            self.counts[length], self.waiting[length] = 0, []
        self.counts[length] += 1
        self.waiting[length].append(piece)
        self.tokens += length

    def take(self, length: int) -> Piece:
        piece = self.waiting[length].pop()
        self.counts[length] -= 1
        self.tokens -= length
        if not self.counts[length]:
            del self.counts[length], self.waiting[length], self.sizes[bisect_right(self.sizes, length) - 1]
        return piece

    def sequences(self, until: int = 0, last: int = 0) -> Iterator[list[tuple[int, Piece]]]:
        """Sequences of (length, piece) while more than ``until`` tokens wait; below ``last`` tokens only full ones, then it ends."""
        while self.tokens > until:
            longest = self.sizes[-1]
            self.counts[longest] -= 1  # it opens the sequence
            lengths = [longest, *fullest(self.sizes, self.counts, self.room - longest)]
            self.counts[longest] += 1
            if self.tokens <= last and sum(lengths) < self.room:
                return
            yield [(length, self.take(length)) for length in lengths]

    def rest(self) -> Iterator[tuple[int, Piece]]:
        for length in self.sizes:
            for piece in self.waiting[length]:
                yield length, piece


def _schema(id_field: st.StructField) -> st.StructType:
    longs = ["piece", "start", "length", "doc_tokens", "sequence_id", "offset", "rest_of"]
    return st.StructType([st.StructField("doc_id", id_field.dataType), *[st.StructField(n, st.LongType()) for n in longs], st.StructField("ids", st.BinaryType())])


class _Rows:
    """Arrow batches of pieces."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows = schema, []

    def place(self, sequence: list[tuple[int, Piece]], number: int) -> None:
        offset = 0
        for length, (key, piece, start, doc_tokens, ids) in sequence:
            self.rows.append((key, piece, start, length, doc_tokens, number, offset, None, ids))
            offset += length

    def put_off(self, length: int, piece: Piece, group: int) -> None:
        key, number, start, doc_tokens, ids = piece
        self.rows.append((key, number, start, length, doc_tokens, None, None, group, ids))

    def batches(self, at_least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= at_least:
            columns = zip(*self.rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
            self.rows = []


def _packer(path: str, room: int, end_id: int, buffer_tokens: int, rest_tokens: int, merge_tasks: int, schema: pa.Schema):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path), TaskContext.get().partitionId()
        pool, out, number = Pool(room), _Rows(schema), task << TASK_BITS
        for rows in batches:
            for key, ids in zip(rows.column(0).to_pylist(), encode.batch(rows.column(1))):
                ids += end
                n = len(ids) // 4
                for i, start in enumerate(range(0, n, room)):
                    length = min(room, n - start)
                    piece = (key, i, start, n, ids[4 * start : 4 * (start + length)])
                    if length < room:
                        pool.add(length, piece)
                        continue
                    out.place([(length, piece)], number)
                    number += 1
                if pool.tokens >= buffer_tokens:
                    for sequence in pool.sequences(until=buffer_tokens // 2):
                        out.place(sequence, number)
                        number += 1
                yield from out.batches(ROWS)
        encode.forget()
        for sequence in pool.sequences(last=rest_tokens):
            out.place(sequence, number)
            number += 1
            yield from out.batches(ROWS)
        for length, piece in pool.rest():
            out.put_off(length, piece, task // merge_tasks)
        yield from out.batches()

    return run


def _merger(room: int, schema: pa.Schema):
    def run(rows: pa.Table) -> pa.Table:
        pool, out = Pool(room), _Rows(schema)
        x = rows.to_pydict()
        # A fixed order, so that a repeated task packs alike.
        order = sorted(range(rows.num_rows), key=lambda i: (x["length"][i], str(x["doc_id"][i]), x["piece"][i], x["ids"][i]))
        for i in order:
            pool.add(x["length"][i], (x["doc_id"][i], x["piece"][i], x["start"][i], x["doc_tokens"][i], x["ids"][i]))
        for number, sequence in enumerate(pool.sequences()):
            out.place(sequence, MERGED + (x["rest_of"][0] << TASK_BITS) + number)
        return pa.Table.from_batches(out.batches(), schema)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, room: int = ROOM, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
                   buffer_tokens: int = 1 << 20, rest_tokens: int = 1 << 16, merge_tasks: int = 32) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``room`` tokens.

    Columns: doc_id, piece (from 0), start, length (of the document's ids, which end with ``end_id``), doc_tokens, sequence_id (any number), offset (place in
    the sequence, gapless from 0), ids (little-endian unsigned 32-bit).  A document is cut only if it is longer than ``room``, into full pieces and a last one.

    Null and empty texts hold only ``end_id``; repeated rows are packed as often as they occur; a null id is kept; an empty table gives no
    rows.  Other columns of ``docs`` are not carried.
    """
    if room < 1 or merge_tasks < 1:
        raise ValueError("room and merge_tasks are positive")
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = _schema(narrow.schema["doc_id"])
    fields = to_arrow_schema(schema)
    run = _packer(tokenizer_path, room, end_id, buffer_tokens, rest_tokens, merge_tasks, fields)
    pieces = stage(narrow.mapInArrow(run, schema), "min-slack")
    merged = pieces.where("rest_of is not null").groupBy("rest_of").applyInArrow(_merger(room, fields), schema)
    return pieces.where("rest_of is null").unionByName(merged).drop("rest_of")
