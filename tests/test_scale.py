"""Plans and behaviour under a key that holds most of the rows."""

from __future__ import annotations

from stratacode.operators import chunks, edges, ownership, stats
from stratacode.operators.common import BROADCAST_ROWS, broadcast_if_small


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_import_name_is_split_by_the_join(spark, monkeypatch):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        files = spark.range(400).selectExpr("'r' AS repo_id", "concat('f', id) AS file_id", "concat('d/m', id, '.py') AS path")
        symbols = spark.range(0, 60000, 1, 8).selectExpr(
            "'r' AS repo_id", "concat('f', id % 400) AS file_id", "concat('s', id) AS symbol_id",
            "IF(id < 400, 'function', 'import') AS kind", "IF(id % 3 = 0, concat('m', id % 397), 'm7') AS name", "id AS ordinal",
        )
        found = edges.resolve_dependencies(files, symbols)
        # Every import but those of the target file itself resolves.
        expected = symbols.where("kind = 'import'").where("concat('f', substr(name, 2)) <> file_id").count()
        assert found.count() == expected
        found.write.format("noop").mode("overwrite").save()
        rows = found.collect()
        assert len(rows) == expected
        assert "skew=true" in _plan(found)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_scalar_ownership_needs_no_author_array(spark):
    touches = spark.range(1000).selectExpr(
        "'r' AS repo_id", "IF(id % 3 = 0, 'hot', concat('p', id)) AS path", "concat(id % 50, '@x') AS author_email", "'n' AS author_name",
        "TIMESTAMP '2024-01-01' AS ts", "id AS log_pos", "id AS line_no",
    )
    authors = ownership.author_stats(touches)
    lean = ownership.path_stats(authors)
    assert "collect_list" not in _plan(lean)
    assert lean.where("path = 'hot'").first().bus_factor == 50
    # The array holds a bounded number of authors, cut before the shuffle; all of them are rows.
    shown = ownership.file_ownership(touches, max_contributors=7)
    assert _plan(shown).count("WindowGroupLimit") >= 2
    hot = shown.where("path = 'hot'").first()
    everyone = ownership.rank_contributors(touches).where("path = 'hot'").orderBy("rank").collect()
    assert hot.bus_factor == 50 and len(everyone) == 50
    assert [(c.email, c.commit_count, c.percentage) for c in hot.contributors] == [(r.email, r.commit_count, r.percentage) for r in everyone[:7]]


def test_broadcast_hint_only_when_small(spark):
    small = broadcast_if_small(spark.range(10).toDF("k"))
    large = broadcast_if_small(spark.range(BROADCAST_ROWS + 1).toDF("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        other = spark.range(1000).toDF("k")
        assert "BroadcastHashJoin" in _plan(other.join(small, "k"))
        assert "BroadcastHashJoin" not in _plan(other.join(large, "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_kind_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "symbols")
    spark.createDataFrame(
        [("r", "f", "s", "class", "n", "src", 0, 1, 2)],
        "repo_id string, file_id string, symbol_id string, kind string, name string, source_code string, ordinal int, "
        "start_line int, end_line int",
    ).write.parquet(path)
    symbols = spark.read.parquet(path)
    assert "In(kind, [class,function,method])" in _plan(chunks.embeddable(symbols))
    files = spark.createDataFrame([("r", "f", "p", 1)], "repo_id string, file_id string, path string, fan_in int")
    assert stats.glossary_candidates(symbols, files).first().source_code == "src"


def test_key_modules_cut_before_the_shuffle(spark):
    files = spark.range(100).selectExpr(
        "concat('r', id % 3) AS repo_id", "id AS file_id", "'p' AS path", "id AS fan_in", "0 AS fan_out", "'x' AS language", "'safe' AS criticality"
    )
    assert _plan(stats.key_modules(files)).count("WindowGroupLimit") == 2


def _some_rows(spark):
    return spark.range(500).selectExpr("IF(id % 50 = 0, NULL, concat('r', id % 3)) AS repo_id", "id AS v")


def test_pages_and_their_totals_make_the_rows_once(spark):
    df = _some_rows(spark)
    pages = stats.number_pages(df, ["repo_id"], ["v"], 50)
    assert "Range (" not in _plan(pages)  # it reads the numbered rows, which are written already
    want = df.where("repo_id is not null").groupBy("repo_id").count().collect()
    assert {(r.repo_id, r.total) for r in pages.collect()} == {tuple(r) for r in want}


def test_a_page_and_the_total_make_the_rows_once(spark):
    page, total = stats.paginate(_some_rows(spark), ["v"], 2, 50)
    assert "Range (" not in _plan(page) and "Range (" not in _plan(total)
    assert total.first().total == 500 and [r.v for r in page.collect()] == list(range(50, 100))
