from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratacode import schemas
from stratacode.operators import stored, writes
from stratacode.streaming import commit_ingest, keyed, progress


def _commits(spark, rows):
    full = [(r, h, "a", "a@x", m, 0, datetime(2024, 1, 1), p, True) for r, h, m, p in rows]
    return spark.createDataFrame(full, schemas.COMMITS)


def test_append_ignore_counts_what_it_inserts(spark, tmp_path, rows):
    path = str(tmp_path / "commits")
    writes.write_table(_commits(spark, [("r", "h1", "old", 1)]), path)
    new = _commits(spark, [("r", "h1", "new", 2), ("r", "h2", "b", 9), ("r", "h2", "a", 3), ("q", "h1", "c", 1)])
    assert writes.append_ignore(spark, path, schemas.COMMITS, new, ["repo_id", "hash"], ["log_pos"]) == 2
    assert writes.append_ignore(spark, path, schemas.COMMITS, new, ["repo_id", "hash"], ["log_pos"]) == 0
    assert rows(writes.read_table(spark, path, schemas.COMMITS), "repo_id", "hash", "message") == [("q", "h1", "c"), ("r", "h1", "old"), ("r", "h2", "a")]


OWNERS = "repo_id string, file_id string, primary_owner string, bus_factor int"


def test_store_upsert(spark, tmp_path, rows):
    path = str(tmp_path / "owners")
    writes.write_table(spark.createDataFrame([("r", "f1", "a", 1), ("r", "f2", "b", 1), ("q", "f1", "c", 1)], OWNERS), path)
    new = spark.createDataFrame([("r", "f1", "z", 5), ("r", "f3", "y", 7)], OWNERS)
    writes.store_upsert(spark, path, OWNERS, new, ["repo_id", "file_id"], ["primary_owner"])
    assert rows(writes.read_table(spark, path, OWNERS)) == [("q", "f1", "c", 1), ("r", "f1", "z", 1), ("r", "f2", "b", 1), ("r", "f3", "y", 7)]


def test_replace_partition_and_delete(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    writes.write_table(spark.createDataFrame([(f"r{i}", "f", "a", i) for i in range(8)], OWNERS), path)
    gone = spark.createDataFrame([("r1",), ("r2",)], "repo_id string")
    writes.replace_partition(spark, path, OWNERS, spark.createDataFrame([("r2", "n", "n", 0)], OWNERS), gone)
    left = rows(writes.read_table(spark, path, OWNERS), "repo_id", "file_id")
    assert left == [("r0", "f"), ("r2", "n"), *[(f"r{i}", "f") for i in range(3, 8)]]


def test_an_interrupted_write_changes_nothing(spark, tmp_path, rows, monkeypatch):
    path = str(tmp_path / "owners")
    writes.write_table(spark.createDataFrame([(f"r{i}", "f1", "a", i) for i in range(6)], OWNERS), path)
    before = rows(writes.read_table(spark, path, OWNERS))
    new, gone = spark.createDataFrame([("r1", "f1", "z", 9), ("r9", "f1", "y", 9)], OWNERS), spark.createDataFrame([("r2",)], "repo_id string")
    reader = writes.read_table(spark, path, OWNERS)
    runs = [
        lambda: writes.store_upsert(spark, path, OWNERS, new, ["repo_id", "file_id"], token="u"),
        lambda: writes.replace_partition(spark, path, OWNERS, spark.createDataFrame([], OWNERS), gone, token="d"),
        lambda: writes.append_ignore(spark, path, OWNERS, new, ["repo_id", "file_id"], ["primary_owner"], token="a"),
    ]

    def stopped(*_):
        raise KeyboardInterrupt

    for run in runs:
        with monkeypatch.context() as m:
            m.setattr(stored, "_switch", stopped)
            with pytest.raises(KeyboardInterrupt):
                run()
        assert rows(writes.read_table(spark, path, OWNERS)) == before
    assert runs[0]() and runs[1]()
    want = sorted([("r0", "f1", "a", 0), ("r1", "f1", "z", 9), *[(f"r{i}", "f1", "a", i) for i in (3, 4, 5)], ("r9", "f1", "y", 9)])
    assert rows(writes.read_table(spark, path, OWNERS)) == want
    # The same tokens again change nothing, even with other rows; a reader of before still reads what it found.
    other = spark.createDataFrame([("r0", "f1", "other", 0)], OWNERS)
    assert not writes.store_upsert(spark, path, OWNERS, other, ["repo_id", "file_id"], token="u")
    assert rows(writes.read_table(spark, path, OWNERS)) == want and rows(reader) == before
    assert stored.remove_unused(spark, path) and rows(writes.read_table(spark, path, OWNERS)) == want
    with pytest.raises(FileExistsError):
        writes.write_table(other, path)


def test_a_changed_bucket_leaves_the_others_alone(spark, tmp_path):
    path = str(tmp_path / "owners")
    writes.write_table(spark.createDataFrame([(f"r{i}", "f", "a", i) for i in range(50)], OWNERS), path)
    old = stored.load(spark, path).folders
    writes.store_upsert(spark, path, OWNERS, spark.createDataFrame([("r7", "f", "b", 1)], OWNERS), ["repo_id", "file_id"])
    new = stored.load(spark, path).folders
    assert sum(old[b] != new[b] for b in old) == 1 and set(old) == set(new)


def test_delete_cascade_over_all_stored_tables(spark, tmp_path, rows):
    folder = str(tmp_path)
    writes.clear_tables(spark, folder)
    for name, ddl in schemas.TABLES.items():
        columns = spark.createDataFrame([], ddl).schema
        made = spark.createDataFrame([("r",), ("q",)], "repo_id string")
        filled = made.select("repo_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in columns if f.name != "repo_id"])
        writes.write_table(filled, f"{folder}/{name}", "append")
    writes.delete_repositories(spark, folder, spark.createDataFrame([("r",)], "repo_id string"))
    assert {name: rows(df, "repo_id") for name, df in writes.load_tables(spark, folder).items()} == {name: [("q",)] for name in schemas.TABLES}
    assert set(schemas.REPO_CHILDREN) | {"repositories"} == set(schemas.TABLES) and "guides" in schemas.TABLES


def test_delete_cascade(spark, rows):
    files = spark.createDataFrame([("r", "f"), ("q", "f")], "repo_id string, file_id string")
    kept = writes.delete_cascade({"files": files}, spark.createDataFrame([("r",)], "repo_id string"))
    assert rows(kept["files"]) == [("q", "f")]


def test_guide_upsert_keeps_old_value_on_null(spark, rows):
    ddl = "repo_id string, reading_order string, critical_files string"
    old = spark.createDataFrame([("r", "o", "c")], ddl)
    new = spark.createDataFrame([("r", "n", None), ("q", "m", None)], ddl)
    assert rows(writes.upsert_guides(old, new, ["reading_order", "critical_files"])) == [("q", "m", None), ("r", "n", "c")]


def test_load_and_clear(spark, tmp_path):
    writes.clear_tables(spark, str(tmp_path))
    tables = writes.load_tables(spark, str(tmp_path))
    assert set(tables) == set(schemas.TABLES) and all(df.count() == 0 for df in tables.values())


EVENTS = [
    ("a", 1, "clone_started", None), ("a", 2, "status_update", "cloning"), ("b", 3, "status_update", "failed"), ("b", 4, "error", None),
    ("a", 5, "status_update", "ready"), ("a", 6, "done", None), ("a", 7, "info", None), ("a", 8, "done", None),
]


def _messages():
    out = []
    for repo, n, event, status in EVENTS:
        data = {"event": event, "message": "m", "timestamp": f"2024-01-01T00:00:{n:02d}+00:00"}
        if status:
            data["status"] = status
        out.append({"channel": f"task:{repo}:logs", "event_id": n, "data": json.dumps(data)})
    return [*out, {"channel": "task:a:logs", "event_id": 99, "data": "DONE"}]


RAW = "channel string, event_id bigint, data string"


def test_progress_stream_equals_batch(spark, tmp_path, rows):
    source = tmp_path / "in"
    source.mkdir()
    for i, m in enumerate(_messages()):
        (source / f"{i:03d}.json").write_text(json.dumps(m))
    batch = progress.progress_events(spark.read.schema(RAW).json(str(source)))
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 2).json(str(source))

    def run(df, mode, name):
        query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name)

    events = progress.progress_events(stream)
    assert rows(run(events, "append", "all_events")) == rows(batch) and batch.count() == len(EVENTS)
    assert rows(progress.progress_events(spark.read.schema(RAW).json(str(source)), "b"), "event_id") == [(3,), (4,)]
    for i, (df, want) in enumerate([(progress.repo_status(events), progress.repo_status(batch)), (progress.finished(events), progress.finished(batch))]):
        out, state = str(tmp_path / f"out{i}"), str(tmp_path / f"state{i}")
        keyed.store(df, out, state, "update").trigger(availableNow=True).start().awaitTermination()
        assert rows(keyed.read_latest(spark, out, df.schema, ["repo_id"])) == rows(want)
        # A batch that is run again changes nothing.
        stored = keyed.read_all(spark, out, df.schema)
        last = stored.agg(F.max(keyed.BATCH)).first()[0]
        again = spark.createDataFrame(stored.where(F.col(keyed.BATCH) == last).drop(keyed.BATCH).collect(), df.schema)
        keyed.batch_writer(out)(again, last)
        assert last >= 3 and rows(keyed.read_latest(spark, out, df.schema, ["repo_id"])) == rows(want)
    status = run(progress.repo_status(events), "complete", "status_now")
    assert rows(status) == rows(progress.repo_status(batch))
    assert rows(status, "repo_id", "status", "n_events") == [("a", "ready", 6), ("b", "failed", 2)]
    assert rows(progress.finished(batch), "repo_id", "event_id", "event") == [("a", 6, "done"), ("b", 4, "error")]


def test_late_terminal_event_replaces_a_later_one(spark, tmp_path, rows):
    source = tmp_path / "late"
    source.mkdir()
    for i, (n, event) in enumerate([(50, "done"), (70, "error"), (20, "error"), (20, "done"), (60, "info")]):
        data = {"event": event, "message": "m", "timestamp": f"2024-01-01T00:00:{n // 10:02d}+00:00", "status": event}
        (source / f"{i}.json").write_text(json.dumps({"channel": "task:a:logs", "event_id": 10 - i, "data": json.dumps(data)}))
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).json(str(source))
    df = progress.finished(progress.progress_events(stream))
    out = str(tmp_path / "out")
    keyed.store(df, out, str(tmp_path / "state"), "update").trigger(availableNow=True).start().awaitTermination()
    assert rows(keyed.read_latest(spark, out, df.schema, ["repo_id"]), "repo_id", "event_id", "event") == [("a", 7, "done")]
    assert len(rows(keyed.read_all(spark, out, df.schema))) >= 3


def test_commit_stream_is_insert_ignore(spark, tmp_path, rows):
    path, source = str(tmp_path / "commits"), str(tmp_path / "in")
    writes.write_table(_commits(spark, [("r", "h0", "kept", 0)]), path)
    for part in ([("r", "h0", "x", 1), ("r", "h1", "a", 2)], [("r", "h1", "late", 1), ("r", "h2", "b", 3)]):
        _commits(spark, part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schemas.COMMITS).option("maxFilesPerTrigger", 1).parquet(source)
    commit_ingest.commit_ingest(stream, path, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    stored = rows(writes.read_table(spark, path, schemas.COMMITS), "hash")
    assert stored == [("h0",), ("h1",), ("h2",)]
