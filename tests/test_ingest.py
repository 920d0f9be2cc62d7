"""The whole ingest on two small repositories."""

from __future__ import annotations

import pytest

from stratacode.plans import brief as briefs
from stratacode.plans.ingest import brief_prompts, ingest

FILES = {
    ("shop", "app/main.py"): 'from app.db import connect\nimport redis\n\ndef main():\n    connect()\n\nif __name__ == "__main__":\n    main()\n',
    ("shop", "app/db.py"): "import psycopg2\n\ndef connect():\n    return 1\n",
    ("shop", "tests/test_db.py"): "from app.db import connect\n\ndef test_connect():\n    assert connect()\n",
    ("shop", "README.md"): "# Shop",
    ("web", "src/a.ts"): 'import { b } from "./b";\nexport function a() {\n  return b();\n}\n',
    ("web", "src/b.ts"): 'import { a } from "./a";\nexport function b() {\n  return a();\n}\n',
    ("web", "src/c.ts"): 'import { b } from "./b";\nexport function c() {\n  return b();\n}\n',
    ("web", "package.json"): '{"dependencies": {"react": "18"}}',
}
LOG = {
    "shop": "aaaaaaa1|ann@x|Ann|two|2024-01-02 00:00:00 +0000\n1\t0\tapp/main.py\n1\t0\tapp/db.py\naaaaaaa0|bob@x|Bob|one|2023-01-01 00:00:00 +0000\n5\t0\tapp/main.py\n",
    "web": "bbbbbbb1|cy@x|Cy|init|2024-01-01 00:00:00 +0000\n1\t0\tsrc/a.ts\n",
}


@pytest.fixture(scope="module")
def run(spark):
    listing = spark.createDataFrame([(r, p, c) for (r, p), c in FILES.items()], "repo_id string, path string, content string")
    lines = [(r, i, line) for r, text in LOG.items() for i, line in enumerate(text.split("\n"))]
    log = spark.createDataFrame(lines, "repo_id string, line_no bigint, line string")
    prs = spark.createDataFrame([("shop", 1, "T", "d")], "repo_id string, number int, title string, description string")
    glossary = spark.createDataFrame([("shop", "s", "connect", "opens", "app/db.py", 3)],
                                     "repo_id string, symbol_id string, name string, definition string, file_path string, line_number int")
    repos = spark.createDataFrame([("shop", "shop", "about"), ("web", "web", None)], "repo_id string, name string, architecture_summary string")
    return ingest(repos, listing, log, prs, glossary, "2024-02-01 00:00:00"), repos


def test_edges_and_order(run, rows):
    result, _ = run
    fans = {(r.repo_id, r.path): (r.fan_in, r.fan_out) for r in result.files.collect()}
    assert fans[("shop", "app/db.py")] == (2, 0) and fans[("shop", "app/main.py")] == (0, 1)
    assert fans[("web", "src/b.ts")] == (2, 1)
    order = {(r.repo_id, r.path): (r.tier, r.position) for r in result.reading_order.collect()}
    assert order[("shop", "app/db.py")] == (0, 1)
    # a and b import each other, c sits above them: one last tier, most imported first.
    assert [order[("web", f"src/{x}.ts")] for x in "bac"] == [(0, 1), (0, 2), (0, 3)]
    assert rows(result.module_edges) == [("shop", "tests", "app")]
    assert rows(result.data_flow, "repo_id", "from_path", "to_path", "hop") == [("shop", "app/main.py", "app/db.py", 1)]


def test_rules_and_owners(run, rows):
    result, _ = run
    assert rows(result.entry_points) == [("shop", "app/main.py")]
    assert rows(result.integrations) == [("shop", "redis")]
    stacks = {r.repo_id: r for r in result.stacks.collect()}
    assert stacks["shop"].languages == ["Python"] and stacks["shop"].databases == ["PostgreSQL", "Redis"]
    assert stacks["web"].frameworks == ["React"]
    files = {(r.repo_id, r.path): r for r in result.files.collect()}
    assert files[("shop", "app/db.py")].has_tests and not files[("shop", "app/main.py")].has_tests
    assert files[("shop", "app/main.py")].criticality_reasons == ["core infrastructure file", "no test coverage"]
    assert rows(result.code_owners, "repo_id", "primary_owner", "bus_factor", "is_knowledge_silo") == [
        ("shop", "Ann <ann@x>", 1, True), ("shop", "Ann <ann@x>", 2, False), ("web", "Cy <cy@x>", 1, True)]


def test_chunks_and_brief(run, rows):
    result, repos = run
    types = {r.source_type for r in result.chunks.where("repo_id = 'shop'").collect()}
    assert types == {"symbol", "commit", "pull_request", "document"}
    brief = {r.repo_id: r for r in result.brief.collect()}
    shop = brief["shop"]
    assert (shop.total_files, shop.n_entry_points, shop.narrative) == (3, 1, "about")
    assert [m.path for m in shop.key_modules] == ["app/db.py", "app/main.py", "tests/test_db.py"]
    assert [(e["from"], e["to"]) for e in shop.module_edges] == [("tests", "app")]
    assert [g.term for g in shop.glossary_preview] == ["connect"]
    assert [o.path for o in shop.reading_order_preview][0] == "app/db.py"
    assert len(shop.ownership_summary) == 2
    lists = rows(briefs.brief_lists(result.files, result.entry_points).where("repo_id = 'shop'"), "section", "position", "path")
    assert lists == [("critical_files", 1, "app/main.py"), ("entry_points", 1, "app/main.py")]
    assert set(briefs.guide_view(result.brief).columns) >= {"data_flow", "key_modules"}
    assert [r.file_path for r in briefs.guide_reading_order(result.reading_order).where("repo_id = 'shop'").collect()][0] == "app/db.py"
    assert [r.file_path for r in briefs.guide_critical_files(result.files).where("repo_id = 'shop'").collect()] == ["app/main.py"]
    prompts = {r.repo_id: r.prompt for r in brief_prompts(result, repos).collect()}
    assert '{"hop":1,"from_path":"app/main.py","to_path":"app/db.py"}' in prompts["shop"] and "React" in prompts["web"]


def test_ingest_tables_are_staged_and_pruned(spark):
    """Every consumer of the symbols scans a stored table and only the columns that it needs."""
    from stratacode.plans import ingest as plan

    listing = spark.createDataFrame([("r", "a.py", "import b\n\ndef f():\n    return 1\n"), ("r", "b.py", "def g():\n    pass\n")], "repo_id string, path string, content string")
    repos = spark.createDataFrame([("r", "demo", None)], "repo_id string, name string, architecture_summary string")
    log = spark.createDataFrame([], "repo_id string, line_no bigint, line string")
    requests = spark.createDataFrame([], "repo_id string, number int, title string, description string")
    terms = spark.createDataFrame([], "repo_id string, symbol_id string, name string, definition string, file_path string")
    run = plan.ingest(repos, listing, log, requests, terms, now="2024-07-01 00:00:00")
    text = run.integrations._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in text and "source_code" not in text and "ExistingRDD" not in text
    edges = run.edges._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in edges and "Join" not in edges and run.edges.count() == 1
