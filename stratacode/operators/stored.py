"""Stored tables: folders of Parquet buckets and one small list of the folders that count.

Rows lie in hash buckets of ``repo_id``.  A write puts its buckets into a folder of its own and becomes visible by one rename: that of a list which names the
folders of every bucket.  A run that ends before the rename leaves a folder nobody reads; a reader that began before it goes on reading the old folders.  A write
may carry a token; a token that the list already holds is not written again, so a repeated batch changes nothing.

One writer at a time; readers need no care.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "repo_bucket"
N_BUCKETS = 256
SALT = 8  # files per bucket and write, at most
LISTS = "_lists"
TOKENS = 1000  # remembered tokens


@dataclass
class State:
    """Which folders hold the rows of each bucket."""

    number: int = 0
    buckets: int = N_BUCKETS
    folders: dict[int, list[str]] = field(default_factory=dict)
    tokens: list[str] = field(default_factory=list)


def _path(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    place, system = _path(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(place)) if system.exists(place) else []


def load(spark: SparkSession, path: str) -> State | None:
    """The present state of a table; None where there is none."""
    lists = [n for n in _names(spark, f"{path}/{LISTS}") if n.endswith(".json")]
    if not lists:
        return None
    place, system = _path(spark, f"{path}/{LISTS}/{lists[-1]}")
    stream = system.open(place)
    try:
        found = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return State(found["number"], found["buckets"], {int(b): f for b, f in found["folders"].items()}, found["tokens"])


def _switch(spark: SparkSession, path: str, state: State) -> None:
    """Make a state the present one."""
    draft, system = _path(spark, f"{path}/{LISTS}/draft-{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(vars(state)).encode("utf-8")))
    finally:
        stream.close()
    final, _ = _path(spark, f"{path}/{LISTS}/{state.number:012d}.json")
    if system.exists(final) or not system.rename(draft, final):
        raise RuntimeError(f"another writer changed {path}")


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("repo_id"), F.lit(buckets)).cast("int")


def _write(spark: SparkSession, df: DataFrame, path: str, buckets: int) -> list[int]:
    """Write bucketed rows into a new folder; the buckets that got any."""
    dealt = df.withColumn(BUCKET, bucket_of(buckets)).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALT)))
    dealt.repartition(BUCKET, "_salt").drop("_salt").write.mode("overwrite").partitionBy(BUCKET).parquet(path)
    return [int(n.split("=")[1]) for n in _names(spark, path) if n.startswith(f"{BUCKET}=")]


def commit(spark: SparkSession, path: str, df: DataFrame, replaced: list[int] | None, token: str | None = None, buckets: int = N_BUCKETS) -> bool:
    """Store ``df`` and make it visible; False if the token was stored before.

    ``replaced`` lists the buckets whose present rows go; ``[]`` adds to the table, ``None`` replaces all of it.  ``df`` must not be read from the table lazily
    where its folders may be removed meanwhile; merges checkpoint it.
    """
    state = load(spark, path) or State(buckets=buckets)
    if token is not None and token in state.tokens:
        return False
    folder = "rows-" + (uuid.uuid4().hex if token is None else hashlib.sha256(token.encode("utf-8")).hexdigest()[:32])
    present = _write(spark, df, f"{path}/{folder}", state.buckets if replaced is not None else buckets)
    kept = {} if replaced is None else {b: f for b, f in state.folders.items() if b not in set(replaced)}
    for bucket in present:
        kept[bucket] = [*kept.get(bucket, []), folder]
    tokens = state.tokens if token is None else [*state.tokens, token][-TOKENS:]
    _switch(spark, path, State(state.number + 1, state.buckets if replaced is not None else buckets, kept, tokens))
    return True


def clear(spark: SparkSession, path: str, buckets: int = N_BUCKETS) -> None:
    """Make a table empty, or create an empty one."""
    state = load(spark, path) or State()
    _switch(spark, path, State(state.number + 1, buckets, {}, state.tokens))


def read(spark: SparkSession, path: str, ddl: str, buckets: list[int] | None = None) -> DataFrame:
    """Rows of a table, or of some of its buckets only: other folders are not read at all."""
    state = load(spark, path)
    if state is None:
        raise FileNotFoundError(f"no stored table at {path}")
    wanted = set(state.folders) if buckets is None else set(buckets) & set(state.folders)
    by_folder: dict[str, list[int]] = {}
    for bucket in sorted(wanted):
        for folder in state.folders[bucket]:
            by_folder.setdefault(folder, []).append(bucket)
    found = None
    for folder, own in by_folder.items():
        rows = spark.read.schema(f"{ddl}, {BUCKET} int").parquet(f"{path}/{folder}").where(F.col(BUCKET).isin(own)).drop(BUCKET)
        found = rows if found is None else found.unionAll(rows)
    return spark.createDataFrame([], ddl) if found is None else found


def buckets_of(spark: SparkSession, path: str, repo_ids: DataFrame) -> list[int]:
    """Bucket numbers of some repositories: at most as many integers as the table has buckets."""
    state = load(spark, path) or State()
    return [row[0] for row in repo_ids.select(bucket_of(state.buckets).alias(BUCKET)).distinct().collect()]


def remove_unused(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders that no bucket names (of replaced rows and of runs that ended early) and the older lists."""
    state = load(spark, path) or State()
    used = {f for folders in state.folders.values() for f in folders}
    gone = [n for n in _names(spark, path) if n.startswith("rows-") and n not in used]
    old = [n for n in _names(spark, f"{path}/{LISTS}") if n != f"{state.number:012d}.json"]
    for name in [*gone, *(f"{LISTS}/{n}" for n in old)]:
        place, system = _path(spark, f"{path}/{name}")
        system.delete(place, True)
    return gone
