"""Building blocks shared by the operators.

All of them stay safe when one key holds a large share of the rows: first-row and
top-k reduce on the map side, and ranking splits a key over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stratacode.session import cut_lineage


def as_columns(items) -> list[Column]:
    return [F.col(i) if isinstance(i, str) else i for i in items]


def first_per_key(df: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """The row with the smallest ``order`` of each key, as a map-side combined aggregate."""
    picked = F.min_by(F.struct(*columns), F.struct(*as_columns(order)))
    return df.groupBy(*keys).agg(picked.alias("_row")).select(*keys, "_row.*")


def top_k(df: DataFrame, keys: list[str], order: list, k, rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows of each key with their 1-based rank.

    The rank filter lets Spark cut every map task down to ``k`` rows per key
    before the shuffle, so a hot key never reaches one task whole.
    """
    window = Window.partitionBy(*keys).orderBy(*as_columns(order))
    return df.withColumn(rank_col, F.row_number().over(window)).where(F.col(rank_col) <= k)


def _run_places(n_keys: int):
    """Adds to sorted rows: the slice (task), the run of equal keys within it from 0, and the place in the run from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, runs, place, last = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.zeros(batch.num_rows, bool)
            for column in batch.columns[:n_keys]:
                codes = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                starts[1:] |= codes[1:] != codes[:-1]
            first = [column[0].as_py() for column in batch.columns[:n_keys]]
            starts[0] = last is not None and first != last
            at = np.arange(batch.num_rows)
            begin = np.maximum.accumulate(np.where(starts, at, -1))
            places = np.where(begin < 0, place + at + 1, at - begin + 1)
            run_no = runs + np.cumsum(starts)
            last, place, runs = [column[-1].as_py() for column in batch.columns[:n_keys]], int(places[-1]), int(run_no[-1])
            added = [pa.array(np.full(batch.num_rows, task, np.int64)), pa.array(run_no.astype(np.int64)), pa.array(places.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "_slice", "_run", "_place"])

    return run


def number_rows(df: DataFrame, keys: list[str], order: list, position_col: str = "position") -> DataFrame:
    """1-based position of every row within its key, for keys of any size.

    One exchange: rows are range-partitioned on (key, order), so a hot key spreads over many tasks, sorted in their task and numbered as they pass.  They are
    written to the checkpoint folder then, because slices must not change afterwards.  Only the first key of a slice can have begun in an earlier one; what
    it had there is one number per slice, and that table (as many rows as slices) is broadcast.  ``order`` must be total within the key.
    """
    ordering = [F.col(k) for k in keys] + as_columns(order)
    columns = [*keys, *(c for c in df.columns if c not in keys)]
    placed = StructType([*df.select(*columns).schema.fields, *[StructField(c, LongType()) for c in ("_slice", "_run", "_place")]])
    ranged = df.repartitionByRange(*ordering).sortWithinPartitions(*ordering).select(*columns)
    numbered = cut_lineage(ranged.mapInArrow(_run_places(len(keys)), placed))
    key, at = F.struct(*keys), F.struct("_run", "_place")
    slices = numbered.groupBy("_slice").agg(
        F.min_by(key, at).alias("first_key"), F.max_by(key, at).alias("last_key"), F.max_by("_place", at).alias("n_last")
    )
    earlier = slices.select(F.col("_slice").alias("earlier"), F.col("last_key").alias("ended_key"), F.col("n_last").alias("n_ended"))
    before = (
        slices.join(earlier, F.col("first_key").eqNullSafe(F.col("ended_key")) & (F.col("earlier") < F.col("_slice")))
        .groupBy("_slice").agg(F.sum("n_ended").alias("_before"))
    )
    begun = F.when(F.col("_run") == 0, F.coalesce("_before", F.lit(0))).otherwise(0)
    return (
        numbered.join(F.broadcast(before), "_slice", "left")
        .withColumn(position_col, (F.col("_place") + begun).cast("bigint"))
        .select(*df.columns, position_col)
    )


def with_batch(df: DataFrame, keys: list[str], order: list, size: int) -> DataFrame:
    """0-based ``batch_id`` and 1-based ``batch_pos``: consecutive runs of ``size`` rows per key."""
    return (
        number_rows(df, keys, order, "_pos")
        .withColumn("batch_id", F.floor((F.col("_pos") - 1) / F.lit(size)).cast("bigint"))
        .withColumn("batch_pos", ((F.col("_pos") - 1) % size + 1).cast("int"))
        .drop("_pos")
    )


def batch_of_rank(df: DataFrame, rank_col: str, size: int) -> DataFrame:
    """Same numbering for rows that already carry a rank."""
    zero = F.col(rank_col) - 1
    return (
        df.withColumn("batch_id", F.floor(zero / F.lit(size)).cast("bigint"))
        .withColumn("batch_pos", (zero % size + 1).cast("int"))
    )


def ordered_texts(text: Column, order: list, separator: str) -> Column:
    """Aggregate: texts of a (bounded) group joined by ``separator`` in ``order``."""
    items = F.array_sort(F.collect_list(F.struct(*as_columns(order), text.alias("_text"))))
    return F.array_join(F.transform(items, lambda i: i["_text"]), separator)


def ordered_items(item: Column, order: list) -> Column:
    """Aggregate: items of a (bounded) group as an array in ``order``."""
    items = F.array_sort(F.collect_list(F.struct(*as_columns(order), item.alias("_item"))))
    return F.transform(items, lambda i: i["_item"])


BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` (narrow) rows, else unchanged.

    Materialises ``df`` first, so that checking its size does not compute it twice.
    """
    ready = cut_lineage(df)
    return F.broadcast(ready) if ready.limit(max_rows + 1).count() <= max_rows else ready


def restrict_to(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs in ``ids`` (distributed IN-list)."""
    return df.join(ids.select(*keys), keys, "left_semi")


def scope_to_user(df: DataFrame, repositories: DataFrame, user_id) -> DataFrame:
    """Rows of the repositories that belong to one user."""
    mine = repositories.where(F.col("user_id") == F.lit(user_id)).select("repo_id")
    return df.join(mine, "repo_id", "left_semi")
