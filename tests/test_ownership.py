from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime

from stratacode.operators import ownership as own
from stratacode.operators.tests_lookup import detect_tests

TOUCH = "repo_id string, path string, author_email string, author_name string, ts timestamp, log_pos bigint, line_no bigint"


def _plain(touches):
    """Ownership of one log, newest first, as plain dictionaries."""
    seen = defaultdict(dict)
    for repo, path, email, name, ts, *_ in sorted(touches, key=lambda t: (t[5], t[6])):
        entry = seen[(repo, path)].setdefault(email.lower(), [name, 0, ts])
        entry[1] += 1
        entry[2] = max(entry[2], ts)
    out = []
    for (repo, path), authors in seen.items():
        total = sum(a[1] for a in authors.values())
        ranked = sorted(authors.items(), key=lambda kv: -kv[1][1])
        email, (name, _, _) = ranked[0]
        shares = [(e, n, c, round(c / total * 100, 1)) for e, (n, c, _) in ranked]
        out.append((repo, path, total, f"{name} <{email}>", len(authors), len(authors) == 1, shares))
    return sorted(out)


def test_matches_plain_model(spark):
    rng = random.Random(5)
    touches = [
        (f"r{rng.randrange(2)}", f"p{rng.randrange(6)}", f"{rng.choice('ABcd')}@x", f"n{rng.randrange(3)}",
         datetime(2024, 1, 1 + rng.randrange(28)), i // 3, i)
        for i in range(300)
    ]
    got = [
        (r.repo_id, r.path, r.change_frequency, r.primary_owner, r.bus_factor, r.is_knowledge_silo,
         [(c.email, c.name, c.commit_count, c.percentage) for c in r.contributors])
        for r in own.file_ownership(spark.createDataFrame(touches, TOUCH)).collect()
    ]
    assert sorted(got) == _plain(touches)


def test_percentage_is_half_even(spark):
    # 1 of 16 is 6.25 % and must print as 6.2.
    touches = [("r", "p", "a@x" if i else "b@x", "n", datetime(2024, 1, 1), i, 0) for i in range(16)]
    shares = {c.email: c.percentage for c in own.file_ownership(spark.createDataFrame(touches, TOUCH)).first().contributors}
    assert shares == {"a@x": 93.8, "b@x": 6.2}


def test_percentages_match_python_rounding(spark):
    from pyspark.sql import functions as F

    pairs = [(a, b) for b in range(1, 120) for a in range(1, b + 1)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {(r.a, r.b): r.p for r in df.select("a", "b", F.bround(F.col("a") / F.col("b") * 100, 1).alias("p")).collect()}
    assert all(got[(a, b)] == round(a / b * 100, 1) for a, b in pairs)


def test_last_commit_is_iso_utc(spark):
    df = spark.createDataFrame([("r", "p", "A@x", "n", datetime(2024, 3, 1, 10, 5), 1, 1)], TOUCH)
    assert own.file_ownership(df).first().contributors[0].last_commit == "2024-03-01T10:05:00+00:00"


def test_git_stats_keep_untouched_files(spark, rows):
    files = spark.createDataFrame(
        [("r", "f1", "a\\b.py", None, None, None), ("r", "f2", "z.py", 9.0, None, True)],
        "repo_id string, file_id string, path string, change_frequency double, git_last_modified timestamp, has_tests boolean",
    )
    stats = spark.createDataFrame([("r", "a/b.py", 3, datetime(2024, 1, 1)), ("r", "gone.py", 1, datetime(2024, 1, 1))],
                                  "repo_id string, path string, change_frequency bigint, git_last_modified timestamp")
    tests = spark.createDataFrame([("r", "gone.py", True)], "repo_id string, path string, has_tests boolean")
    got = rows(own.apply_git_stats(files, stats, tests), "file_id", "change_frequency", "has_tests")
    assert got == [("f1", 3.0, False), ("f2", 9.0, True)]


def _candidates(path):
    """Every path at which a test of ``path`` may lie."""
    from pathlib import PurePosixPath

    p = PurePosixPath(path)
    s, x = p.stem, p.suffix
    names = [f"test_{s}{x}", f"{s}.test{x}", f"{s}.spec{x}", f"{s}_test{x}", f"{s}.test.js", f"{s}.spec.js",
             f"{s}.test.tsx", f"{s}.spec.tsx", f"test_{s}.py", f"{s}_spec{x}"]
    dirs = [p.parent, p.parent / "tests", p.parent / "__tests__", p.parent / "spec"]
    if str(p.parent) != ".":
        dirs += [PurePosixPath("tests"), PurePosixPath("__tests__")]
    return {str(d / n) for d in dirs for n in names}


def test_detect_tests_against_plain_candidates(spark):
    rng = random.Random(11)
    stems = ["a", "b.c", ".env", "test_a", "a.test", "x_test", "spec"]
    exts = ["", ".py", ".js", ".tsx", ".go"]
    folders = ["", "src/", "src/tests/", "tests/", "__tests__/", "src/spec/", "src/__tests__/", "deep/er/tests/"]
    paths = sorted({rng.choice(folders) + rng.choice(stems) + rng.choice(exts) for _ in range(120)})
    listing = set(paths)
    for path in rng.sample(paths, 60):
        listing.add(rng.choice(sorted(_candidates(path))))
    as_df = lambda items: spark.createDataFrame([("r", p) for p in items], "repo_id string, path string")
    got = {r.path: r.has_tests for r in detect_tests(as_df(paths), as_df(sorted(listing))).collect()}
    assert got == {p: bool(_candidates(p) & listing) for p in paths}


def test_silos_are_sorted(spark):
    owners = spark.createDataFrame([("r", "f2", True), ("r", "f1", True), ("r", "f3", False)], "repo_id string, file_id string, is_knowledge_silo boolean")
    files = spark.createDataFrame([("r", "f1", "b"), ("r", "f2", "a"), ("r", "f3", "c")], "repo_id string, file_id string, path string")
    assert [r.path for r in own.silos(owners, files).collect()] == ["a", "b"]
    assert own.silo_totals(owners).first().total == 2


def test_touch_log_is_read_once_a_side(spark, rows):
    touches = spark.range(600).selectExpr(
        "'r' AS repo_id", "IF(id % 50 = 0, NULL, concat('p', id % 7)) AS path", "concat(id % 13, '@x') AS author_email", "'n' AS author_name",
        "TIMESTAMP '2024-01-01' AS ts", "id AS log_pos", "id AS line_no",
    )

    def scans(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Range (")

    everyone, shown = own.rank_contributors(touches), own.file_ownership(touches, max_contributors=20)
    assert scans(everyone) == 1 and scans(shown) == 2
    authors = own.author_stats(touches)
    assert rows(everyone) == rows(own.contributors(authors, own.path_stats(authors), 20)) and everyone.where("path is null").isEmpty()
    listed = shown.selectExpr("repo_id", "path", "posexplode(contributors) AS (at, c)").selectExpr("repo_id", "path", "at + 1 AS rank", "c.email", "c.percentage")
    assert rows(listed) == rows(everyone, "repo_id", "path", "rank", "email", "percentage")


def test_every_author_of_a_path_is_listed(spark, rows):
    touches = spark.range(400).selectExpr(
        "'r' AS repo_id", "IF(id % 100 = 0, NULL, IF(id % 4 = 1, 'p', 'hot')) AS path", "concat(id % 150, '@x') AS author_email", "'n' AS author_name",
        "TIMESTAMP '2024-01-01' AS ts", "id AS log_pos", "id AS line_no",
    )
    shown = own.file_ownership(touches)
    assert max(len(r.contributors) for r in shown.collect()) > 100 and shown.where("bus_factor != size(contributors)").isEmpty()
    listed = shown.selectExpr("repo_id", "path", "posexplode(contributors) AS (at, c)").selectExpr("repo_id", "path", "at + 1 AS rank", "c.email", "c.percentage")
    assert rows(listed) == rows(own.rank_contributors(touches), "repo_id", "path", "rank", "email", "percentage")


def test_owners_alone_move_no_contributors(spark):
    touches = spark.range(10).selectExpr(
        "'r' AS repo_id", "'p' AS path", "'a@x' AS author_email", "'n' AS author_name", "TIMESTAMP '2024-01-01' AS ts", "id AS log_pos", "id AS line_no")
    plan = own.file_ownership(touches).select("repo_id", "path", "primary_owner")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan and plan.count("Range (") == 1
