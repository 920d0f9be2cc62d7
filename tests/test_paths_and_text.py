from __future__ import annotations

from pyspark.sql import functions as F

from stratacode.functions import paths, text
from stratacode.functions.vectors import cosine_distance


def _values(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_suffix_and_stems(spark):
    names = ["a/b.py", "x.d.ts", ".env", "Makefile", "a.b/c", "a/.x.y", "f."]
    assert _values(spark, names, paths.suffix) == [".py", ".ts", "", "", "", ".y", ""]
    assert _values(spark, names, paths.file_stem) == ["b", "x.d", ".env", "Makefile", "c", ".x", "f."]
    assert _values(spark, names, paths.full_stem) == ["a/b", "x.d", "", "Makefile", "a", "a/.x", "f"]


def test_path_parts(spark):
    names = ["a/b/c.py", "c.py", "a\\b.py"]
    assert _values(spark, names, paths.base_name) == ["c.py", "c.py", "b.py"]
    assert _values(spark, names, paths.parent_dir) == ["a/b", "root", "a"]
    assert _values(spark, names, paths.top_dir) == ["a", "root", "a"]


def test_language_and_skip(spark):
    names = ["a.tsx", "b.h", "c.txt", "d.PY"]
    assert _values(spark, names, paths.language_of) == ["typescript", "c", None, None]
    skipped = ["node_modules/a.js", "a/dist/b.js", "bin", "src/bin.py", "bin/x"]
    assert _values(spark, skipped, paths.in_skipped_dir) == [True, True, False, False, True]


def test_line_count(spark):
    assert _values(spark, ["", "a", "a\n", "a\nb"], paths.line_count) == [1, 1, 2, 2]


def test_import_path(spark):
    names = ["app.core.x", "..pkg.mod", "a\\b", "redis.asyncio as aioredis", "./lib/x", "<anonymous>", "", "...", " np as n "]
    expected = ["app/core/x", "pkg/mod", "a/b", "redis/asyncio", "lib/x", None, None, None, "np"]
    assert _values(spark, names, paths.import_path) == expected


def test_repo_urls(spark):
    urls = ["https://github.com/o/r.git", "github.com/o/r/", "https://github.com/o", "https://github.com/o/r/tree/x"]
    assert [tuple(v) for v in _values(spark, urls, paths.url_owner_repo)] == [("o", "r"), ("o", "r"), (None, None), ("o", "r")]
    assert _values(spark, urls, paths.url_name) == ["r.git", "r", "o", "x"]
    assert _values(spark, urls, paths.is_hosted_repo_url) == [True, False, False, False]


def test_criticality_score(spark):
    labels = ["critical", "caution", "safe", "other", None, " Critical "]
    assert _values(spark, labels, paths.criticality_score) == [100.0, 75.0, 25.0, 50.0, 50.0, 100.0]
    assert _values(spark, ["safe", None, ""], paths.criticality_label) == ["safe", "medium", "medium"]


def test_chunk_budget_edge(spark):
    texts = ["x" * 8195, "x" * 8196]
    assert _values(spark, texts, text.within_budget) == [True, False]
    assert _values(spark, texts, text.token_estimate) == [2048, 2049]


def test_preview(spark):
    assert _values(spark, ["a" * 200, "a" * 201], lambda c: text.preview(c, 200)) == ["a" * 200, "a" * 200 + "..."]


def test_chunk_texts(spark):
    df = spark.createDataFrame([(7, "T", None, "abcdef0123456", "me", "msg")], "n int, t string, b string, h string, a string, m string")
    row = df.select(
        text.pull_request_chunk(F.col("n"), F.col("t"), F.col("b")), text.commit_chunk(F.col("h"), F.col("a"), F.col("m")),
        text.symbol_chunk(F.lit("p.py"), F.lit("class"), F.lit("K"), F.lit("src")),
    ).first()
    assert tuple(row) == ("# PR #7: T", "# Commit abcdef01 by me\nmsg", "# p.py\n## class: K\nsrc")


def test_cosine_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    values = [r[0] for r in df.select(F.round(cosine_distance(F.col("a"), F.col("b")), 9)).collect()]
    assert values == [1.0, 0.0, None]
