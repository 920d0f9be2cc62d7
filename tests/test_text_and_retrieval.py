from __future__ import annotations

import json
import random

import numpy as np

from stratacode.operators import chunks as ch
from stratacode.operators import textgen
from stratacode.operators import retrieval as ret
from stratacode.operators import textgen

SYMBOL = "repo_id string, file_id string, symbol_id string, kind string, name string, source_code string, ordinal int"
FILES = "repo_id string, file_id string, path string"


def _inputs(spark):
    symbols = [
        ("r", "f1", "s1", "function", "a", "src a", 0),
        ("r", "f2", "s2", "import", "b", "import b", 1), ("r", "f2", "s3", "variable", "v", "v = 1", 0),
        ("r", "f3", "s4", "class", "big", "x" * 9000, 0),
        ("r", "f4", "s5", "import", "c", "", 0),
        ("q", "g1", "s6", "import", "d", "import d", 0),
    ]
    files = [("r", f"f{i}", f"p{i}.py") for i in range(1, 5)] + [("q", "g1", "g.py")]
    commits = spark.createDataFrame([("r", "abcdef0123", "me", "fix"), ("q", "aaaaaaaaaa", "me", "m")], "repo_id string, hash string, author_name string, message string")
    prs = spark.createDataFrame([("r", 3, "T", " ")], "repo_id string, number int, title string, description string")
    readmes = spark.createDataFrame([("r", "hello"), ("q", "")], "repo_id string, content string")
    return spark.createDataFrame(symbols, SYMBOL), spark.createDataFrame(files, FILES), commits, prs, readmes


def test_build_chunks(spark, rows):
    got = rows(ch.build_chunks(*_inputs(spark), require_symbols=True, oversize="drop"), "source_type", "source_id", "file_id", "chunk_text")
    assert got == [
        ("commit", "abcdef0123", None, "# Commit abcdef01 by me\nfix"),
        ("document", "r", None, "# README\nhello"),
        ("pull_request", "3", None, "# PR #3: T"),
        ("symbol", "f2", "f2", "# p2.py\nv = 1\nimport b"),
        ("symbol", "s1", "f1", "# p1.py\n## function: a\nsrc a"),
    ]
    everything = ch.build_chunks(*_inputs(spark))
    assert {r.source_id for r in everything.where("repo_id = 'q'").collect()} == {"g1", "aaaaaaaaaa"}


def test_file_chunk_budget_edge(spark):
    files = spark.createDataFrame([("r", "f", "p")], FILES)
    none = spark.createDataFrame([], "repo_id string, file_id string")
    for size, kept in ((8191, 1), (8192, 0)):
        # "# p\n" + text: 4 more characters.
        symbols = spark.createDataFrame([("r", "f", "s", "import", "n", "x" * size, 0)], SYMBOL)
        assert ch.file_chunks(symbols, files, none, oversize="drop").count() == kept
        assert sorted(len(r.chunk_text) for r in ch.file_chunks(symbols, files, none).collect()) == ([8195] if kept else [1, 8195])


def test_windows_of_many_sources_equal_the_cut_text(spark):
    rng = random.Random(2)
    made, want = [], {}
    for f in range(12):
        sources = ["".join(rng.choice("ab \n\té😀") for _ in range(rng.choice([0, 1, 3, 30, 90, 400]))) for _ in range(rng.randint(1, 30))]
        made += [("r", f"f{f}", f"s{i:02d}", "import", "n", t, i // 2) for i, t in enumerate(sources)]
        filled = [t for t in sources if t]
        text = f"# p{f}\n" + "\n".join(filled)
        if any(t.strip() for t in filled):
            want[f"f{f}"] = [text[i:i + 83] for i in range(0, len(text), 83)]
    rng.shuffle(made)
    files = spark.createDataFrame([("r", f"f{f}", f"p{f}") for f in range(12)], FILES)
    none = spark.createDataFrame([], "repo_id string, file_id string")
    got = {}
    for r in ch.file_chunks(spark.createDataFrame(made, SYMBOL), files, none, max_tokens=20).collect():
        _, _, part = r.source_id.partition("\x1f")
        got.setdefault(r.file_id, {})[int(part or 0)] = r.chunk_text
    assert {f: [parts[i] for i in range(len(parts))] for f, parts in got.items()} == want


def test_embed_with_user_function(spark):
    chunks = spark.createDataFrame([("r", str(i), "x" * i) for i in range(1, 251)], "repo_id string, source_id string, chunk_text string")

    def fn(texts):
        assert len(texts) <= 100
        return np.array([[len(t), 1.0] for t in texts])

    got = ch.embed_chunks(chunks, fn).collect()
    assert {int(r.source_id): r.embedding for r in got} == {i: [float(i), 1.0] for i in range(1, 251)}


def test_hash_embedding_is_unit_and_stable(spark):
    chunks = spark.createDataFrame([("a b b",), ("b a b",), ("c",)], "chunk_text string")
    a, b, c = [r.embedding for r in ch.embed_chunks(chunks, dim=32).collect()]
    assert a == b != c and abs(sum(x * x for x in a) - 1) < 1e-6


def _corpus(spark, n=400, repos=2):
    rng = np.random.default_rng(4)
    types = ["symbol", "commit", "pull_request", "document", "other"]
    base = rng.normal(size=(n // 2, 8))
    vectors = np.vstack([base, base])  # every vector twice: ties must go by source_id
    rows = [(f"r{0 if i % 5 else 1 % repos}", types[i % 5], f"s{i:04d}", f"f{i}", f"t{i}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    emb = spark.createDataFrame(rows, "repo_id string, source_type string, source_id string, file_id string, chunk_text string, embedding array<float>")
    questions = [(f"r{k % 3}", f"q{k}", f"why {k}", [float(x) for x in rng.normal(size=8)]) for k in range(30)]
    return rows, questions, emb, spark.createDataFrame(questions, "repo_id string, query_id string, question string, embedding array<float>")


def _nearest(rows, question, types, k):
    repo, _, _, q = question
    q = np.float32(q).astype(float)
    scored = []
    for r, t, s, _, _, v in rows:
        if r == repo and t in types:
            v = np.float32(v).astype(float)
            scored.append((round(1 - float(v @ q) / float(np.linalg.norm(v) * np.linalg.norm(q)), 9), s))
    return [s for _, s in sorted(scored)[:k]]


def test_blocked_search_is_exact(spark):
    rows, questions, emb, q = _corpus(spark)
    got = {}
    # Tiny blocks: every repository is cut both ways.
    for r in ret.vector_topk(emb, q, 7, vector_block=32, query_block=4).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.source_id)
    types = {r[1] for r in rows}
    assert got == {k[1]: want for k in questions if (want := _nearest(rows, k, types, 7))}


def test_zero_vectors_hide_no_hits(spark):
    made = [("r", "symbol", f"s{i}", "f", "t", v) for i, v in enumerate([[1.0, 0.0], [0.0, 0.0], [0.0, 1.0], [1.0, 1.0]])]
    emb = spark.createDataFrame(made, "repo_id string, source_type string, source_id string, file_id string, chunk_text string, embedding array<float>")
    q = spark.createDataFrame([("r", "q", "?", [1.0, 0.0])], "repo_id string, query_id string, question string, embedding array<float>")
    for k, want in ((2, ["s0", "s3"]), (6, ["s0", "s3", "s2"])):
        assert [r.source_id for r in ret.vector_topk(emb, q, k).orderBy("rank").collect()] == want
    assert [r.source_id for r in ret.quota_topk(emb, q).orderBy("hit_no").collect()] == ["s0", "s3", "s2"]
    assert ret.vector_topk(emb.where("source_id = 's1'"), q, 3).count() == 0


def test_vectors_without_direction_are_no_hits(spark):
    nan, inf = float("nan"), float("inf")
    made = [[1.0, 0.0], [nan, 0.0], [0.0, 1.0], [inf, 1.0], [1.0, None], [0.0, 0.0], [1.0, 1.0, 1.0], None, [-inf, nan], [1e300, 1e300]]
    ddl = "repo_id string, source_type string, source_id string, file_id string, chunk_text string, embedding array<double>"
    emb = spark.createDataFrame([("r", "symbol", f"s{i}", "f", "t", v) for i, v in enumerate(made)], ddl)
    asked = [("r", "q", "?", [1.0, 0.0]), ("r", "nan", "?", [nan, 1.0]), ("r", "zero", "?", [0.0, 0.0]), ("none", "q2", "?", [1.0, 0.0])]
    q = spark.createDataFrame(asked, "repo_id string, query_id string, question string, embedding array<double>")
    for k, want in ((1, ["s0"]), (2, ["s0", "s9"]), (3, ["s0", "s9", "s2"]), (10, ["s0", "s9", "s2"])):
        for blocks in ({}, {"vector_block": 2, "query_block": 1}):
            assert [(r.query_id, r.source_id) for r in ret.vector_topk(emb, q, k, **blocks).orderBy("rank").collect()] == [("q", x) for x in want]


def test_search_leaves_the_vectors_where_they_lie(spark, tmp_path):
    _, _, emb, q = _corpus(spark)
    emb.write.parquet(str(tmp_path / "emb"))
    plan = ret.vector_topk(spark.read.parquet(str(tmp_path / "emb")), q, 3, query_block=8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 4 and "CartesianProduct" not in plan and "NestedLoop" not in plan and "Join" not in plan
    # Below the search there is a scan and nothing that moves rows: what is exchanged are hits, which have no vectors.
    assert all("embedding" not in line for line in plan.splitlines() if "Exchange" in line)
    for below in plan.split("MapInArrow")[1:]:
        assert "Exchange" not in below.split("Scan parquet")[0]


def test_quotas(spark):
    rows, questions, emb, q = _corpus(spark)
    got = {}
    for r in ret.quota_topk(emb, q, vector_block=50, query_block=7).orderBy("hit_no").collect():
        got.setdefault(r.query_id, []).append(r.source_id)
    want = {k[1]: [s for t, n in ret.QUOTAS.items() for s in _nearest(rows, k, {t}, n)] for k in questions}
    assert got == {k: v for k, v in want.items() if v}


def test_context_and_no_hit(spark):
    sources = spark.createDataFrame(
        [("r", "q", 1, "symbol", "txt", "p.py", None, None, None, None, None, None, None),
         ("r", "q", 2, "commit", "c", None, None, None, None, "abc", "me", None, None),
         ("r", "q", 3, "pull_request", "p", None, None, None, None, None, None, 4, "T"),
         ("r", "q", 4, "document", "d", None, None, None, None, None, None, None, None)],
        "repo_id string, query_id string, hit_no int, source_type string, chunk_text string, file_path string, symbol_name string, "
        "start_line int, end_line int, commit_hash string, author_name string, pr_number int, pr_title string")
    asked = spark.createDataFrame([("r", "q", "Q?"), ("r", "z", "Z?")], "repo_id string, query_id string, question string")
    got = {r.query_id: r for r in ret.build_context(sources, asked).collect()}
    assert got["q"].context == (
        "[Source 1] [Code] p.py — None (lines None–None)\ntxt\n\n---\n\n[Source 2] [Commit] abc by me\nc\n\n---\n\n"
        "[Source 3] [PR #4] T\np\n\n---\n\n[Source 4] [README]\nd")
    assert got["z"].n_sources == 0 and got["z"].answer == ret.NO_HIT_ANSWER and got["q"].answer is None
    turns = spark.createDataFrame([("r", "q", i, "user", f"t{i}") for i in range(8)], "repo_id string, query_id string, turn int, role string, content string")
    messages = ret.build_messages(ret.build_context(sources, asked), turns).collect()
    assert len(messages) == 1
    assert [m.content for m in messages[0].messages][1:] == ["t3", "t4", "t5", "t6", "t7", "Q?"]
    cited = ret.with_citation(sources, spark.createDataFrame([("r", "https://h/o/r")], "repo_id string, github_url string"))
    labels = {r.hit_no: (r.primary_label, r.sub_label, r.href) for r in cited.collect()}
    assert labels[2] == ("abc", "by me", "https://h/o/r/commit/abc") and labels[3] == ("PR #4", "T", "https://h/o/r/pull/4")
    assert labels[4] == ("Source", "", None)


def test_parse_responses(spark, rows):
    texts = [("r", 0, '```json\n[{"name": "A", "definition": "1"}]\n```'), ("r", 1, "oops"), ("r", 2, ' [{"name": "a", "definition": "2"}] ')]
    df = spark.createDataFrame(texts, "repo_id string, batch_id int, text string")
    assert rows(textgen.parse_responses(df, "name:string,definition:string"), "batch_id", "name") == [(0, "A"), (2, "a")]
    candidates = spark.createDataFrame([("r", "s1", "A", "p", 3), ("r", "s2", "B", "p", 4)], "repo_id string, symbol_id string, name string, path string, start_line int")
    assert rows(textgen.build_glossary(candidates, df), "symbol_id", "definition", "line_number") == [("s1", "2", 3)]


def test_module_preview_counts_the_rest(spark):
    files = spark.createDataFrame([("r", "f", "m/a.py")], FILES)
    symbols = spark.createDataFrame([("r", "f", f"s{i:02d}", "function", f"n{i}", i) for i in range(11)],
                                    "repo_id string, file_id string, symbol_id string, kind string, name string, start_line int")
    row = textgen.module_symbols(symbols, files).first()
    assert row.lines[0] == "function n0 at m/a.py:0" and len(row.lines) == 8 and row.n_more == 3


def test_brief_prompt_sections(spark):
    one = lambda ddl, *rows: spark.createDataFrame(list(rows), ddl)
    prompt = textgen.brief_requests(
        one("repo_id string, name string", ("r", "demo")),
        one("repo_id string, languages array<string>, frameworks array<string>, databases array<string>, ci_cd array<string>", ("r", ["Go", "Rust"], [], [], ["Docker"])),
        one("repo_id string, path string", *[("r", f"e{i}.py") for i in range(9)]),
        one("repo_id string, path string, fan_in int, criticality string, rank int", ("r", "k.py", 4, None, 1)),
        one("repo_id string, module string, lines array<string>, n_more bigint", ("r", "m", ["x"], 2)),
        one("repo_id string, src_module string, tgt_module string", ("r", "a", "b")),
        one("repo_id string, step int, from_path string, to_path string, hop int", ("r", 1, "a.py", "b.py", 1)),
        one("repo_id string, integration string", ("r", "redis")),
        one("repo_id string, total_files bigint", ("r", 7)),
    ).first().prompt
    task, *lines = prompt.split("\n")
    assert task == textgen.BRIEF_TASK
    said = {x["section"]: x for x in map(json.loads, lines)}
    assert said["repository"] == {"section": "repository", "name": "demo", "files": 7, "languages": ["Go", "Rust"], "frameworks": [], "databases": [], "ci_cd": ["Docker"]}
    assert [x["path"] for x in said["entry_points"]["items"]] == [f"e{i}.py" for i in range(8)]
    assert said["key_modules"]["items"] == [{"path": "k.py", "fan_in": 4, "criticality": None}]
    assert said["modules"]["items"] == [{"module": "m", "lines": ["x"], "n_more": 2}]
    assert said["module_edges"]["items"] == [{"src_module": "a", "tgt_module": "b"}]
    assert said["data_flow"]["items"] == [{"hop": 1, "from_path": "a.py", "to_path": "b.py"}] and said["integrations"]["items"] == [{"integration": "redis"}]


def test_glossary_requests_hold_whole_sources(spark):
    made = [("r", f"s{i}", f"n{i}", "p.py", i, i + 1, 'a "b"\n' * 200, i) for i in range(1, 28)]
    candidates = spark.createDataFrame(made, "repo_id string, symbol_id string, name string, path string, start_line int, end_line int, source_code string, rank int")
    for limit, size in ((None, 1200), (300, 300)):
        got = textgen.glossary_requests(candidates, source_chars=limit).orderBy("batch_id").collect()
        items = [json.loads(line) for r in got for line in r["items"].split("\n")]
        assert [r.n_items for r in got] == [25, 2] and [x["name"] for x in items] == [f"n{i}" for i in range(1, 28)]
        assert all(len(x["source"]) == size for x in items) and items[0]["lines"] == [1, 2]


def test_every_file_gets_an_annotation_request(spark):
    made = [("r", f"p{i}.py", i, 0, 0, 0, "Python") for i in range(1, 236)]
    order = spark.createDataFrame(made, "repo_id string, path string, position int, fan_in int, fan_out int, tier int, language string")
    for limit, files, batches in ((None, 235, 24), (100, 100, 10)):
        got = textgen.annotation_requests(order, max_files=limit).collect()
        assert (sum(r.n_items for r in got), len(got)) == (files, batches)
        assert all(f'"file_path":"p{i}.py"' in "".join(r.prompt for r in got) for i in (1, files))


def test_long_texts_are_split_and_found_again(spark):
    _, files, commits, prs, _ = _inputs(spark)
    long = "".join(chr(97 + i % 26) for i in range(20_000)) + "é\U0001f600"
    symbols = spark.createDataFrame([("r", "f1", "s1", "function", "a", long, 0), ("r", "f2", "s2", "import", "b", long, 0)], SYMBOL)
    readmes = spark.createDataFrame([("r", long), ("q", "")], "repo_id string, content string")
    texts: dict = {}
    for r in ch.build_chunks(symbols, files, commits, prs, readmes).collect():
        source, _, part = r.source_id.partition("\x1f")
        texts.setdefault((r.source_type, source), {})[int(part or 0)] = r.chunk_text
        assert len(r.chunk_text) <= 8195
    whole = {k: "".join(v[i] for i in range(len(v))) for k, v in texts.items()}
    assert whole["symbol", "s1"] == "# p1.py\n## function: a\n" + long
    assert whole["symbol", "f2"] == "# p2.py\n" + long and whole["document", "r"] == "# README\n" + long
    assert len(whole["document", "r"]) == sum(map(len, texts["document", "r"].values())) and len(texts["document", "r"]) == 3
    dropped = ch.build_chunks(symbols, files, commits, prs, readmes, oversize="drop")
    assert {r.source_type for r in dropped.collect()} == {"commit", "pull_request"}
    chunks = ch.symbol_chunks(symbols, files)
    hits = chunks.selectExpr("repo_id", "'1' AS query_id", "1 AS hit_no", "source_type", "source_id", "0.0 AS distance")
    named = symbols.selectExpr("repo_id", "symbol_id", "name", "1 AS start_line", "2 AS end_line")
    got = ret.resolve_sources(hits, chunks, named, files, commits, prs).collect()
    assert sorted(r.chunk_text for r in got) == sorted(texts["symbol", "s1"].values()) and {r.symbol_name for r in got} == {"a"}


def test_many_questions_meet_the_vectors_in_cells(spark, monkeypatch):
    rng = random.Random(11)
    made = [(rng.choice(("r1", "r1", "r1", "r2", None)), f"s{i:03d}", "symbol", [rng.uniform(-1, 1) for _ in range(rng.choice((3, 3, 4)))]) for i in range(300)]
    emb = spark.createDataFrame(made, "repo_id string, source_id string, source_type string, embedding array<double>").repartition(5)
    q = emb.selectExpr("repo_id", "source_id AS query_id", "embedding")
    whole = ret.vector_topk(emb, q, 5)
    want = sorted(map(tuple, whole.collect()), key=repr)
    monkeypatch.setattr(ret, "CELL_VECTORS", 16)
    sent = []
    context = type(spark.sparkContext)
    monkeypatch.setattr(context, "broadcast", lambda self, value: sent.append(value))
    cells = ret.vector_topk(emb, q, 5, vector_block=7, query_block=20)
    assert sorted(map(tuple, cells.collect()), key=repr) == want and len(want) >= 1200
    assert not sent  # no question passes the driver
