from __future__ import annotations

from datetime import datetime, timedelta

from stratacode.operators import rules, stats

AS_OF = "2024-07-01 12:00:00"
FILE = "repo_id string, path string, fan_in int, git_last_modified timestamp, has_tests boolean"


def _judge(spark, rows, **kw):
    got = rules.criticality(spark.createDataFrame(rows, FILE), AS_OF, **kw).collect()
    return {r.path: (r.criticality, r.criticality_reasons) for r in got}


def test_criticality(spark):
    now = datetime(2024, 7, 1, 12)
    got = _judge(spark, [
        ("r", "a/config.py", 10, now - timedelta(days=181), None),
        ("r", "domain.py", 5, now, True),
        ("r", "x.py", 4, now - timedelta(days=180, hours=23), True),
        ("r", "Main.py", None, None, False),
        ("r", "auth_x.py", 9, None, None),
    ])
    assert got["a/config.py"] == ("critical", ["imported by 10 files", "core infrastructure file", "untouched for 6+ months", "no test coverage"])
    assert got["domain.py"] == ("caution", ["imported by 5 files", "core infrastructure file"])
    assert got["x.py"] == ("safe", [])
    assert got["Main.py"] == ("safe", ["no test coverage"])
    assert got["auth_x.py"] == ("caution", ["imported by 9 files", "no test coverage"])


def test_criticality_before_history(spark):
    old = datetime(2020, 1, 1)
    got = _judge(spark, [("r", "x.py", 0, old, True)], git_aware=False)
    assert got["x.py"] == ("safe", ["no test coverage"])


LISTING = "repo_id string, path string, content string"


def _stack(spark, rows):
    got = rules.detect_stack(spark.createDataFrame([("r", *r) for r in rows], LISTING)).first()
    return {c: got[c] for c in rules.STACK_CATEGORIES}


def test_stack_manifests(spark):
    got = _stack(spark, [
        ("web/package.json", '{"dependencies": {"react": "18", "pg": "8"}, "devDependencies": {"vue": "3"}}'),
        ("bad/package.json", "{not json"),
        ("node_modules/p/package.json", '{"dependencies": {"svelte": "1"}}'),
        ("api/a.py", "from FastAPI import x\nimport Psycopg"),
        ("svc/POM.xml", "<a>spring-boot</a>"),
        ("go.mod", "require github.com/gin-gonic/gin"),
        ("sub/go.mod", "echo"),
        ("Cargo.toml", "diesel = 1"),
        ("composer.json", '{"require": {"laravel/framework": "1", "symfony/x": "2"}}'),
        (".github/workflows/ci.yml", ""), ("Dockerfile", None), ("sub/Jenkinsfile", None),
    ])
    assert got["languages"] == ["Python"]
    assert got["frameworks"] == ["FastAPI", "Gin", "Laravel", "React", "Real-time System", "Spring Boot", "Symfony", "Vue", "WebSockets"]
    assert got["databases"] == ["PostgreSQL"]
    assert got["ci_cd"] == ["Docker", "GitHub Actions"]


def test_stack_names(spark):
    assert "WebSockets" in _stack(spark, [("a/news.py", "")])["frameworks"]
    assert "Prisma ORM" in _stack(spark, [("Prisma/s.txt", "")])["frameworks"]
    assert _stack(spark, [("apps/a.txt", ""), ("packages/b.txt", "")])["frameworks"] == ["Monorepo"]
    assert _stack(spark, [("apps/a.txt", "")])["frameworks"] == []
    # Directories in front of a skipped folder still count, those behind it do not.
    assert _stack(spark, [("sockets/dist/a.txt", "")])["frameworks"] == ["Real-time System", "WebSockets"]
    assert _stack(spark, [("dist/sockets/a.py", "flask")])["frameworks"] == []


def test_entry_points(spark, rows):
    cases = [
        ("main.py", ""), ("src/index.js", ""), ("src/server/index.js", ""), ("lib/Index.TS", ""), ("src/App.tsx", ""),
        ("App.tsx", ""), ("app/x/page.tsx", ""), ("web/page.tsx", ""), ("pages/index.jsx", ""), ("next.config.js", ""), ("wsgi.py", ""),
        ("sub/Dockerfile", ""), ("a.py", 'IF __name__ == "__main__":'), ("b.go", "func main() {}"), ("c.txt", "func main()"),
        ("d.js", "createServer"), ("build/main.py", ""), ("e.ts", "const a = Express()"), ("f.rb", "uvicorn.run"), ("g.py", None),
    ]
    got = rows(rules.detect_entry_points(spark.createDataFrame([("r", *c) for c in cases], LISTING)), "path")
    assert [g[0] for g in got] == sorted([
        "main.py", "src/server/index.js", "lib/Index.TS", "src/App.tsx", "app/x/page.tsx", "pages/index.jsx", "next.config.js",
        "wsgi.py", "sub/Dockerfile", "a.py", "b.go", "e.ts",
    ])


def test_integrations_first_prefix_wins(spark, rows):
    imports = [("r", "import", n) for n in ("Boto3.session", "google.cloud.storage", "google.auth", "redis", "s3fs", "celery_x")] + [("r", "class", "stripe")]
    df = spark.createDataFrame(imports, "repo_id string, kind string, name string")
    assert [r[1] for r in rows(rules.detect_integrations(df))] == ["boto3", "celery", "google", "redis", "s3"]


def test_glossary_search_wildcards(spark, rows):
    df = spark.createDataFrame([("User_ID", "x"), ("UserXID", "y"), ("z", "the USER_id")], "name string, definition string")
    assert [r[0] for r in rows(stats.search_glossary(df, "user_id"), "name")] == ["UserXID", "User_ID", "z"]


def test_paginate(spark):
    df = spark.range(45).selectExpr("id AS v")
    rows, total = stats.paginate(df, ["v"], 3, 20)
    assert [r.v for r in rows.collect()] == list(range(40, 45)) and total.first().total == 45


def test_glossary_candidates_put_unknown_fan_in_first(spark):
    files = spark.createDataFrame([("r", "f1", "a", 5), ("r", "f2", "b", None), ("r", "f3", "c", 9)], "repo_id string, file_id string, path string, fan_in int")
    symbols = spark.createDataFrame(
        [("r", f"s{i}", f, "class", "n", 1, 2, "src") for i, f in enumerate(("f1", "f2", "f3"))] + [("r", "i", "f3", "import", "n", 1, 2, "src")],
        "repo_id string, symbol_id string, file_id string, kind string, name string, start_line int, end_line int, source_code string")
    got = stats.glossary_candidates(symbols, files, 2).orderBy("rank").collect()
    assert [r.symbol_id for r in got] == ["s1", "s2"]


def test_pages_by_key_equal_pages_by_number(spark):
    df = spark.createDataFrame([(i % 4, f"n{i:03d}", i) for i in range(103)], "v int, name string, i int")
    last, seen = None, []
    for page in range(1, 13):
        rows = [tuple(r) for r in stats.page_after(df, ["v", "name"], last, 10).collect()]
        assert rows == [tuple(r) for r in stats.paginate(df, ["v", "name"], page, 10)[0].collect()]
        seen += rows
        last = rows[-1][:2] if rows else last
    assert seen == sorted(map(tuple, df.collect()))
    plan = stats.page_after(df, ["v", "name"], (2, "n050"), 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_glossary_terms_are_verified_once(spark, rows):
    glossary = spark.createDataFrame(
        [("r", i, f"name {i}", "Def" if i % 2 else None) for i in range(6)] + [("q", 9, "other", "x")], "repo_id string, entry_id int, name string, definition string")
    asked = [("r", i, t) for i, t in enumerate(("%", "", "__", "NAME 1", "name 1", "d_f", "zzz", None, "name 1"))] + [("q", 20, "%")]
    terms = spark.createDataFrame(asked, "repo_id string, term_id int, term string")
    found = stats.search_terms(glossary, terms)
    want = [(t, r, e) for r, t, term in asked if term is not None
            for e in stats.search_glossary(glossary.where(f"repo_id = '{r}'"), term).select("entry_id").toPandas().entry_id]
    assert rows(found) == sorted(want, key=repr)
    # Below the join that fetches the texts no row carries the key of a term.
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    top = next(i for i, line in enumerate(lines) if "Join" in line and "entry_id#" in line)
    end = next((i for i in range(top + 1, len(lines)) if depth[i] <= depth[top]), len(lines))
    assert not any("term_id#" in line for line in lines[top:end])
    # Runs are many more than their table shows, so they are never broadcast.
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    runs = [i for i, line in enumerate(plan) if "Generate explode(array_distinct" in line and "entry_id#" in line]
    assert runs
    for i in runs:
        above, at = [], depth[i]
        for k in range(i, -1, -1):
            if depth[k] < at:
                above.append(plan[k])
                at = depth[k]
        assert not any("BroadcastExchange" in line for line in above)
