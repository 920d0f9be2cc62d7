"""Near duplicates by bottom-k sketches of one hash function.

The shingles of a document are hashed once; its sketch is the ``k`` smallest hashes.  Documents with the
same shingle set are one class, compared once.  Values held by several classes form inverted lists.  Two
sets of similarity 0.75 share at least ``least_shared`` of their ``k`` retained values (but for one pair in a million at
exactly 0.75, fewer above), so a document is listed under its ``k - least_shared + 1`` rarest values only and a
document with as many values of its own needs no list at all: common passages do not fill the lists.

1. Each list proposes (centre, member) pairs, the centre being the member whose values are most widely held; the estimate
   from the union sketch filters them and the exact similarity of the full shingle sets verifies them.  A
   group of near copies collapses here without being paired.
2. Lists that still touch several components are compared in full, block against block, on the full sets: a block task
   counts intersections as a matrix product and emits a spanning forest of the links, never the pairs.

Blocks are bounded by members and bytes, lists of any length are split into them; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st

from stratacode.llm.components import connected_components
from stratacode.llm.shingles import shingle_hashes, word_hashes
from stratacode.llm.staging import stage
from stratacode.llm.text import fresh

K, LEAST_SHARED, WIDTH = 32, 12, 5
PERCENT = 75  # links need 100 * intersection >= PERCENT * union
BLOCK_MEMBERS, BLOCK_BYTES = 1024, 4 << 20
BATCH_BYTES = 4 << 20  # of texts or sets that go to Python at once


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct shingle hashes as ascending signed integers."""
    return np.unique(shingle_hashes(word_hashes(text), width).view(np.int64))


def _sketcher(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes, prints, sketches = [], [], []
            for text in rows.column(1).to_pylist():
                s = shingle_set(text, width)
                sizes.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sketches.append(s[:k])
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sketches])]).astype(np.int32)
            flat = np.concatenate(sketches) if sketches else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["id", "n", "print", "sketch"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sets = [shingle_set(t, width).tobytes() for t in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    return run


def _linked(shared, a, b, percent: int):
    return 100 * shared >= percent * (a + b - shared)


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = []
            for left, right in zip(rows.column("set_a"), rows.column("set_b")):
                a, b = np.frombuffer(left.as_buffer(), np.int64), np.frombuffer(right.as_buffer(), np.int64)
                keep.append(bool(_linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent)))
            yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _block_forest(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids, labels = table.column("id").to_pylist(), table.column("label").to_pylist()
        blocks = np.array(table.column("block").to_pylist())
        sets = [np.frombuffer(s.as_buffer(), np.int64) for s in table.column("set")]  # views, no copies
        sizes = np.array([len(s) for s in sets], np.int64)
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        del sets
        order = np.argsort(values)
        values, owner = values[order], owner[order]
        del order
        # Only values held twice can be shared; they are counted in slices of columns.
        again = values[1:] == values[:-1]
        use = np.append(again, False) | np.append(False, again)
        new = np.append(True, ~again)[use]
        owner, rank = owner[use], np.cumsum(new, dtype=np.int32) - 1
        del values, again, use, new
        many = len(sizes)
        shared = np.zeros((many, many), np.float32)
        width = 1024
        for low in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
            lo, hi = np.searchsorted(rank, [low, low + width])
            held = np.zeros((many, width), np.float32)
            held[owner[lo:hi], rank[lo:hi] - low] = 1
            shared += held @ held.T
        two = blocks.min() != blocks.max()  # pairs inside one block belong to another task

        def links() -> Iterator[tuple[int, int]]:
            for low in range(0, many, 256):
                part = slice(low, low + 256)
                found = _linked(shared[part].astype(np.int64), sizes[part, None], sizes[None, :], percent)
                if two:
                    found &= blocks[part, None] != blocks[None, :]
                for i, j in np.argwhere(np.triu(found, low + 1)).tolist():
                    yield low + i, j

        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = ([], [])
        for i, j in links():
            x, y = root(labels[i]), root(labels[j])
            if x != y:
                parent[x] = y
                out[0].append(ids[i])
                out[1].append(ids[j])
        kind = table.schema.field("id").type
        return pa.table({"a": pa.array(out[0], kind), "b": pa.array(out[1], kind)})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, least_shared: int = LEAST_SHARED,
                    width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id (smallest id reachable over links), kept.

    Texts without a word have no shingles and no links.  Rows repeated under one id are one node and share a
    component; a null id links with nothing, has a null component and is kept.  An empty table gives no rows.  No other column is read.
    """
    id_field = docs.select(F.col(f"`{id_col}`").alias("id")).schema["id"]
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sketch_schema = st.StructType([id_field, st.StructField("n", st.LongType()), st.StructField("print", st.BinaryType()),
                                   st.StructField("sketch", st.ArrayType(st.LongType()))])
    sketched = narrow.mapInArrow(_sketcher(k, width), sketch_schema)
    rows = stage(sketched.withColumn("row", F.monotonically_increasing_id()), "sketches", BATCH_BYTES)
    linkable = rows.where(F.col("id").isNotNull() & (F.col("n") > 0))
    first = F.min(F.struct("id", "row"))
    classes = stage(
        linkable.groupBy("print").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
        .select("print", F.col("first.id").alias("rep"), F.col("first.row").alias("row"), "copies"),
        "classes",
    )
    several = classes.where("copies > 1").select("print", F.col("row").alias("rep_row"))
    copies = stage(linkable.select("print", "row").join(several, "print").where("row != rep_row").select("row"), "copies")
    reps = linkable.join(copies, "row", "left_anti")

    # Inverted lists of the rarest values of each class.
    held = reps.select("id", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    common = held.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    profile = (
        held.join(common, "v").groupBy("id", "n", "s")
        .agg(F.sort_array(F.collect_set(F.struct("df", "v"))).alias("values"))
    )
    needed = F.least(F.ceil(F.col("n") * F.lit(percent / 100)), F.lit(least_shared))
    room = (F.col("s") - needed + 1) - (F.col("s") - F.size("values"))  # prefix length less the values of its own
    spread = F.aggregate("values", F.lit(0.0), lambda acc, x: acc + F.log2(x["df"].cast("double")))
    listed = stage(
        profile.where(room > 0).select("id", "n", spread.alias("spread"), F.explode(F.slice("values", 1, room.cast("int"))).alias("e"))
        .select("id", "n", "spread", F.col("e.v").alias("v")),
        "lists",
    )

    # Round 1: every member against the centre of its list.
    centres = listed.groupBy("v").agg(F.max_by("id", F.struct("spread", "id")).alias("a"), F.count(F.lit(1)).alias("g")).where("g > 1")
    pairs = listed.join(centres, "v").where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b")).distinct()
    sketches = reps.select("id", "sketch")
    estimated = (
        pairs.join(sketches.toDF("a", "sketch_a"), "a").join(sketches.toDF("b", "sketch_b"), "b")
        .withColumn("union", F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k))
        .withColumn("shared", F.size(F.array_intersect(F.array_intersect("union", "sketch_a"), "sketch_b")))
        .where(F.col("shared") >= F.least(F.ceil(F.size("union") * F.lit(percent / 100)), F.lit(least_shared)))
        .select("a", "b")
    )
    candidates = stage(estimated, "candidates")
    involved = listed.select("id").distinct()
    set_schema = st.StructType([id_field, st.StructField("set", st.BinaryType())])
    sets = stage(narrow.join(involved, "id", "left_semi").mapInArrow(_sets(width), set_schema), "sets", BATCH_BYTES)
    pair_schema = st.StructType([st.StructField("a", id_field.dataType), st.StructField("b", id_field.dataType)])
    star = stage(
        candidates.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").mapInArrow(_verifier(percent), pair_schema),
        "links", BATCH_BYTES,
    )
    labels = connected_components(star)

    # Round 2: lists that still touch several components, block against block.
    tagged = listed.join(labels.toDF("id", "label"), "id", "left").select("v", "id", "n", F.coalesce("label", "id").alias("label"))
    mixed = (
        tagged.groupBy("v").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("w"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        .where("g > 2 and lo != hi")
        .select("v", F.greatest(F.ceil(F.col("g") / F.lit(BLOCK_MEMBERS)), F.ceil(F.col("w") * 8 / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    )
    dealt = (
        tagged.join(mixed, "v")
        .withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("v", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "label", "block")
    )
    rest = stage(dealt.join(sets, "id").groupBy("v", "i", "j").applyInArrow(_block_forest(percent), pair_schema), "links", BATCH_BYTES)
    # An id with several texts is one node and ties their classes together.
    member = linkable.select("print", "id").join(classes.select("print", "rep"), "print").select("id", "rep")
    torn = member.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo != hi").select("id")
    ties = member.join(torn, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    merged = connected_components(star.unionAll(rest).unionAll(ties))

    by_print = classes.join(merged.toDF("rep", "component"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component"))
    named = rows.join(by_print, "print", "left")
    own = F.coalesce("component", "id")
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Of rows repeated under one id the one with the smallest text stays (a null text first); rows without an id all stay.
    """
    key = F.col(f"`{id_col}`")
    gone, many, whole_row = fresh(docs, "gone", "many", "row")
    marks = stage(near_duplicates(docs, id_col, text_col, **options), "marks")
    dropped = stage(marks.where(~F.col("kept")).select(key.alias(gone)).distinct(), "dropped")
    kept = docs.join(dropped, key == F.col(gone), "left_anti")
    several = stage(marks.where(key.isNotNull()).groupBy(key.alias(many)).count().where("count > 1").select(many), "several")
    repeated = kept.join(several, key == F.col(many), "left_semi")
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = repeated.groupBy(key).agg(F.min_by(columns, F.struct(F.col(f"`{text_col}`"))).alias(whole_row)).select(f"{whole_row}.*")
    return kept.join(several, key == F.col(many), "left_anti").unionAll(first)
