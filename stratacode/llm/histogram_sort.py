"""Histogram sort: shards of near-equal bytes in the order of a sort key.

Rows are ordered by a 64-bit key, whose upper half comes from the text and whose lower half from the id: equal
texts are neighbours, and a group of copies of any size can still be cut between its members.  The splitters
are found by counting, not by sampling: each round puts ``2^bits`` equally spaced candidate boundaries into every
interval that still holds a splitter, counts the exact bytes and rows below each candidate over all partitions
(one map-side combined aggregate over a narrow staged table) and keeps the cell in which the target lies.  A
splitter is settled as soon as a boundary lies within tolerance; at most ``64 / bits`` rounds are needed.
Then every row moves once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from stratacode.llm.staging import stage
from stratacode.llm.text import fresh, own, whole

KEY_BITS = 64
TOP = 1 << (KEY_BITS - 1)
PREFIX_BITS = 12


def sort_key(text: Column, row_id: Column) -> Column:
    """Signed 64-bit key: 32 hash bits of the text, then 32 of the id."""
    upper = F.shiftleft(F.shiftright(F.xxhash64(whole(text)), 32), 32)
    return upper.bitwiseOR(F.shiftrightunsigned(F.xxhash64(row_id), 32))


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text (a null has none) plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


@dataclass
class _Open:
    """A splitter being searched: the cell ``[low, low + width)`` and what lies below it."""

    target: float
    low: int
    width: int
    bytes_below: int
    rows_below: int


@dataclass
class Splitter:
    key: int
    bytes_below: int
    rows_below: int


def _cells(keys: DataFrame, lows: list[int], width: int, bits: int) -> dict[int, list[tuple[int, int, int]]]:
    """Exact bytes and rows of the ``2^bits`` sub-cells of each open cell.

    ``keys`` has (key, size).  The result has at most ``len(lows) * 2^bits`` rows, whatever the input.
    """
    shift = width.bit_length() - 1 - bits
    keep = keys
    if width < 2 * TOP:
        cell = F.shiftright("key", width.bit_length() - 1)
        keep = keys.where(cell.isin(*[low >> (width.bit_length() - 1) for low in lows]))
    found = keep.groupBy(F.shiftright("key", shift).alias("sub")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    out: dict[int, list[tuple[int, int, int]]] = {low: [] for low in lows}
    for row in found.collect():
        low = row["sub"] << shift
        out[-TOP if width == 2 * TOP else low // width * width].append((low, row["b"], row["n"]))
    return {low: sorted(v) for low, v in out.items()}


def find_splitters(keys: DataFrame, parts: int, tolerance: float = 0.002, bits: int = 8) -> list[Splitter]:
    """``parts - 1`` ascending splitters of a (key, size) table; part ``i`` holds the keys from splitter i-1 on.

    Each splitter's bytes below differ from its target by at most ``tolerance`` of a part, unless one key value alone
    is larger than that (rows with equal text and equal id stay together).  An empty table gives no splitter.
    """
    total = keys.agg(F.sum("size").alias("b")).first()["b"] or 0
    if parts < 2 or not total:
        return []
    slack = tolerance * total / parts
    found: dict[int, Splitter] = {}
    open_ = {i: _Open(total * i / parts, -TOP, 2 * TOP, 0, 0) for i in range(1, parts)}
    while open_:
        width = next(iter(open_.values())).width
        cells = _cells(keys, sorted({o.low for o in open_.values()}), width, bits)
        step, still = width >> bits, {}
        for i, o in open_.items():
            b, n = o.bytes_below, o.rows_below
            for low, size, rows in cells[o.low]:
                if b + size < o.target:
                    b, n = b + size, n + rows
                    continue
                # The target lies in this sub-cell: its two ends are the nearest boundaries.
                ends = [Splitter(low, b, n), Splitter(low + step, b + size, n + rows)]
                best = min(ends, key=lambda s: abs(s.bytes_below - o.target))
                if abs(best.bytes_below - o.target) <= slack or step == 1:
                    found[i] = best
                else:
                    still[i] = _Open(o.target, low, step, b, n)
                break
        open_ = still
    return sorted(found.values(), key=lambda s: s.key)


def _lookup(spark, splitters: list[Splitter]) -> DataFrame:
    """(prefix, base, keys): splitters by the leading bits of their key; one row per prefix, 4,096 at most."""
    shift, half = KEY_BITS - PREFIX_BITS, 1 << (PREFIX_BITS - 1)
    by: dict[int, list[int]] = {}
    for s in splitters:
        if s.key < TOP:  # a splitter above every key leaves the rest of the parts empty
            by.setdefault(s.key >> shift, []).append(s.key)
    rows, base = [], 0
    for p in range(-half, half):
        rows.append((p, base, by.get(p, [])))
        base += len(by.get(p, []))
    schema = StructType([StructField("_prefix", LongType()), StructField("_base", LongType()), StructField("_splits", ArrayType(LongType()))])
    return spark.createDataFrame(rows, schema)


def histogram_sort(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", piece_bytes: int = 64 << 20,
                   tolerance: float = 0.002, bits: int = 8) -> DataFrame:
    """Every row of ``docs`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 within the shard).

    Shards are ranges of the sort key with near-equal bytes.  A shard is exchanged in pieces of about ``piece_bytes``, each a range
    of keys as well, so that no task ever sorts more than a piece; slots add the exact row counts of the earlier pieces.
    Null and empty texts have size 1 and are spread by id; a null id is one value.  Rows with equal text and id share a key
    and stay together in any order; an empty table gives an empty result.  Input columns named like a result column
    are replaced.
    """
    spark = docs.sparkSession
    key, part, prefix, base, splits, before = fresh(docs, "key", "part", "prefix", "base", "splits", "before")
    text, row_id, row = F.col(f"`{text_col}`"), F.col(f"`{id_col}`"), own(docs, ["shard", "slot"])
    keyed = docs.select(*row, sort_key(text, row_id).alias(key))
    keys = stage(docs.select(sort_key(text, row_id).alias("key"), byte_size(text).alias("size")), "sort-keys")
    total = keys.agg(F.sum("size").alias("b")).first()["b"] or 0
    pieces = max(1, -(-total // (shards * piece_bytes)))
    splitters = find_splitters(keys, shards * pieces, tolerance / pieces, bits)
    # Both small tables are bounded by total bytes / piece_bytes entries: 13 MB each for 100 TB.
    table = F.broadcast(_lookup(spark, splitters).toDF(prefix, base, splits))
    below = [0] + [s.rows_below for s in splitters]
    starts = [(i, below[i] - below[i // pieces * pieces]) for i in range(len(below))]
    starts = F.broadcast(spark.createDataFrame(starts, f"{part} bigint, {before} bigint"))
    index = (F.col(base) + F.size(F.filter(splits, lambda s: s <= F.col(key)))).cast("bigint")
    placed = keyed.join(table, F.shiftright(key, KEY_BITS - PREFIX_BITS) == F.col(prefix)).select(*row, key, index.alias(part))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(key, f"`{id_col}`"))
    return (
        placed.withColumn("slot", inside)
        .join(starts, part)
        .select(*row, F.floor(F.col(part) / F.lit(pieces)).cast("int").alias("shard"),
                (F.col(before) + F.col("slot") - 1).cast("bigint").alias("slot"))
    )
