"""Benchmark decontamination with spaced seeds.

A seed mask reads some of the words of a window and ignores the others, so a hit survives substituted words at
the ignored places.  Masked hashes of every benchmark position are joined with those of every document
position; around each hit the words of both sides are compared along its diagonal.  The default masks hit every window of
``WINDOW`` words with at most ``WINDOW - 12`` substitutions (checked exhaustively in the tests).

Most document positions hit nothing.  A bitmap of fixed size over the benchmark's hashes, the only thing that is broadcast, drops
them in the task that reads the text; it lets a few wrong positions pass and never loses one, and the join on the full hash
decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st

from stratacode.llm.shingles import mix, word_hashes
from stratacode.llm.staging import stage
from stratacode.llm.text import fresh

WINDOW, PERCENT = 16, 75
# Places read by each mask; together they miss no window of 16 words with up to 4 substitutions.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 6, 8, 9), (0, 1, 2, 7, 11))
BITMAP_BITS = 24  # 2 MB, whatever the benchmark's size


def seeds(words: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """Masked hash at every position where the whole mask fits."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(number + 1))
    for place in mask:
        out = out * np.uint64(0xD1342543DE82EF95) + words[place : place + n]
    return mix(out)


def slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in the bitmap, from its two ends."""
    return hashes >> np.uint64(64 - bits), hashes & np.uint64((1 << bits) - 1)


def _benchmark_seeds(masks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for item, text in zip(rows.column(0), rows.column(1).to_pylist()):
                words = word_hashes(text)
                hashes = [seeds(words, m, i) for i, m in enumerate(masks)]
                found = np.concatenate(hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item.as_py()] * 1, rows.schema.field(0).type), pa.array([words.tobytes()], pa.binary()),
                     pa.array([found.view(np.int64)], pa.list_(pa.int64())),
                     pa.array([np.concatenate([np.arange(len(h)) for h in hashes]).astype(np.int32)], pa.list_(pa.int32()))],
                    ["item_id", "item_words", "hashes", "places"],
                )

    return run


def _scanner(bitmap, masks, window: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(bitmap.value, np.uint8)

        def on(places: np.ndarray) -> np.ndarray:
            return (marked[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1

        for rows in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                words = word_hashes(text)
                at, value = [], []
                for number, mask in enumerate(masks):
                    found = seeds(words, mask, number)
                    high, low = slots(found, bits)
                    hit = np.flatnonzero(on(high))
                    hit = hit[on(low[hit]) == 1]
                    at.append(hit)
                    value.append(found[hit])
                at, value = np.concatenate(at), np.concatenate(value)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, value = at[order], value[order]
                # Hits whose surroundings touch share a region.
                cuts = np.flatnonzero(np.diff(at) > 2 * window) + 1
                for where, hashes in zip(np.split(at, cuts), np.split(value, cuts)):
                    start = max(0, int(where[0]) - window)
                    stop = min(len(words), int(where[-1]) + 2 * window)
                    for column, x in zip(out, (key, start, words[start:stop].tobytes(), where, hashes.view(np.int64))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], rows.schema.field(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()),
                 pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.list_(pa.int64()))],
                ["doc_id", "start", "words", "places", "hashes"],
            )

    return run


def matched_spans(doc: np.ndarray, item: np.ndarray, shift: int, window: int, percent: int) -> list[tuple[int, int, int]]:
    """Maximal runs ``(first, end, matches)`` of item places whose windows agree with ``doc`` at place + shift."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    size = min(window, len(item))
    if high - low < size:
        return []
    same = doc[low + shift : high + shift] == item[low:high]
    sums = np.concatenate([[0], np.cumsum(same)])
    good = 100 * (sums[size:] - sums[:-size]) >= percent * size
    cover = np.zeros(high - low + 1, np.int64)
    np.add.at(cover, np.flatnonzero(good), 1)
    np.add.at(cover, np.flatnonzero(good) + size, -1)
    inside = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
    edges = np.diff(inside.astype(np.int8))
    spans = []
    for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
        hits = np.flatnonzero(same[a:b]) + a
        spans.append((int(hits[0]) + low, int(hits[-1]) + 1 + low, len(hits)))
    return spans


def _verifier(window: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: list[tuple] = []
            for doc_id, item_id, start, words, item, shift in zip(*[rows.column(c).to_pylist() for c in ("doc_id", "item_id", "start", "words", "item_words", "shift")]):
                doc, item = np.frombuffer(words, np.uint64), np.frombuffer(item, np.uint64)
                for a, b, n in matched_spans(doc, item, shift - start, window, percent):
                    out.append((doc_id, item_id, a + shift, b + shift, a, b, n))
            columns = list(zip(*out)) or [()] * 7
            types = [rows.schema.field("doc_id").type, rows.schema.field("item_id").type, *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                             ["doc_id", "item_id", "doc_start", "doc_end", "item_start", "item_end", "n_matches"])

    return run


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", masks: tuple[tuple[int, ...], ...] = MASKS, window: int = WINDOW, percent: int = PERCENT,
                       bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """Passages of ``docs`` that repeat a benchmark text with substitutions.

    One row per maximal run of windows of ``window`` words (the whole item if that is shorter) of which ``percent`` % agree word by word, A-Z
    lower-cased: doc_id, item_id, doc_start, doc_end, item_start, item_end (word positions, ends excluded), n_matches.  With the default masks no such run of
    an item of 16 words or more is missed; items shorter than a mask (6 words) cannot be found.

    Null and empty texts on either side match nothing; null ids are carried; repeated rows give repeated results; an
    empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    doc = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    bench = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("text"))
    id_field, item_field = doc.schema["doc_id"], bench.schema["item_id"]
    seed_schema = st.StructType([item_field, st.StructField("item_words", st.BinaryType()), st.StructField("hashes", st.ArrayType(st.LongType())),
                                 st.StructField("places", st.ArrayType(st.IntegerType()))])
    items = stage(bench.mapInArrow(_benchmark_seeds(masks), seed_schema).withColumn("item", F.monotonically_increasing_id()), "items")
    seed = items.select("item", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select("item", F.col("s.hashes").alias("hash"), F.col("s.places").alias("item_at"))

    slot = F.explode(F.array(F.shiftrightunsigned("hash", 64 - bitmap_bits), F.col("hash").bitwiseAND((1 << bitmap_bits) - 1)))
    chunks = (
        seed.select(slot.alias("slot")).select((F.col("slot") + 1).alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    )
    marked = np.zeros(1 << (bitmap_bits - 3), np.uint8)
    for row in chunks.collect():  # at most 2^bitmap_bits bits in all
        at = (row["chunk"] - 1) * len(row["bits"])  # buckets of 32,768 places, counted from 1
        marked[at : at + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    bitmap = spark.sparkContext.broadcast(marked.tobytes())

    region_schema = st.StructType([id_field, st.StructField("start", st.LongType()), st.StructField("words", st.BinaryType()),
                                   st.StructField("places", st.ArrayType(st.LongType())), st.StructField("hashes", st.ArrayType(st.LongType()))])
    regions = stage(doc.mapInArrow(_scanner(bitmap, masks, window, bitmap_bits), region_schema).withColumn("region", F.monotonically_increasing_id()), "regions")
    hits = regions.select("region", F.explode(F.arrays_zip("places", "hashes")).alias("h")).select("region", F.col("h.places").alias("at"), F.col("h.hashes").alias("hash"))
    diagonals = hits.join(seed, "hash").select("region", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    sides = (
        diagonals.join(regions.select("region", "doc_id", "start", "words"), "region")
        .join(items.select("item", "item_id", "item_words"), "item")
        .select("doc_id", "item_id", "start", "words", "item_words", "shift")
    )
    out = st.StructType([id_field, item_field, *[st.StructField(c, st.LongType()) for c in ("doc_start", "doc_end", "item_start", "item_end", "n_matches")]])
    return sides.mapInArrow(_verifier(window, percent), out)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold a passage of the benchmark; rows without an id stay."""
    (leak,) = fresh(docs, "leak")
    spans = contaminated_spans(docs, benchmark, id_col=id_col, **options)
    leaks = stage(spans.select(F.col("doc_id").alias(leak)).where(F.col(leak).isNotNull()).distinct(), "leaks")
    return docs.join(leaks, F.col(f"`{id_col}`") == F.col(leak), "left_anti")
