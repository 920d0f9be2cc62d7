from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from stratacode.operators import symbols
from stratacode.operators.symbols import extract_symbols
from stratacode.sources import git_log, tree
from stratacode.sources.pull_requests import read_pull_requests

LOG = """\
12\t0\tbefore.py
a1b2c3d4|Me@X.org|Me|first | bar|2024-01-02 03:04:05 +0200

3\t1\tsrc/{old => new}/a.py
-\t-\timg.png
x\t1\tbad.py
deadbeef|you@x.org|You|second|2024-01-01 00:00:00 +0000
1\t2\tw\\in.py
cafebabe|you@x.org|You|merge|2023-12-31 23:00:00 -0100
"""


def _lines(spark, text, repo="r"):
    return spark.createDataFrame([(repo, i, line) for i, line in enumerate(text.split("\n"))], "repo_id string, line_no bigint, line string")


def test_git_log(spark):
    for block in (2, 3, 100):
        commits, files = git_log.parse_git_log(_lines(spark, LOG), "2030-01-01 00:00:00", block)
        got = [(r.hash, r.author_email, r.message, r.files_changed, str(r.authored_at), r.date_ok) for r in commits.orderBy("log_pos").collect()]
        assert got == [
            ("a1b2c3d4", "me@x.org", "first", 2, "2030-01-01 00:00:00", False),
            ("deadbeef", "you@x.org", "second", 1, "2024-01-01 00:00:00", True),
            ("cafebabe", "you@x.org", "merge", 0, "2024-01-01 00:00:00", True),
        ]
        assert [(r.path, r.added, r.deleted) for r in files.orderBy("line_no").collect()] == [("src/new/a.py", 3, 1), ("img.png", 0, 0), ("w/in.py", 1, 2)]
    assert git_log.newest_commits(commits, 2).count() == 2


def _log_of(rng, commits):
    out = []
    for i in range(commits):
        out.append(f"{rng.getrandbits(160):040x}|a{i % 7}@x|A{i % 7}|subject {i}|2024-01-{i % 28 + 1:02d} 00:00:00 +0000")
        out += ["", *(f"{k}\t{i % 5}\tsrc/f{rng.randrange(9)}.py" for k in range(rng.randrange(12)))]
    return "\n".join(out) + "\n"


def test_logs_are_read_by_splits(spark, tmp_path, rows):
    (tmp_path / "one.log").write_bytes(b"a\r\nb\n\n\nc")
    got = git_log.read_git_logs(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.repo_id, r.line) for r in got] == [("one", x) for x in ("a", "b", "", "", "c")]
    rng = random.Random(6)
    logs, folder = {f"r.{i}": _log_of(rng, 60) for i in range(3)}, tmp_path / "logs"
    folder.mkdir()
    for repo, text in logs.items():
        (folder / f"{repo}.log").write_text(text)
    whole = spark.createDataFrame([(r, i, line) for r, t in logs.items() for i, line in enumerate(t.split("\n"))], "repo_id string, line_no bigint, line string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        split = git_log.read_git_logs(spark, str(folder))
        assert split.select("line_no").rdd.getNumPartitions() > 6
        for repo, text in logs.items():
            assert [r.line for r in split.where(F.col("repo_id") == repo).orderBy("line_no").collect()] == text.split("\n")[:-1]
        for got, want in zip(git_log.parse_git_log(split, "2030-01-01 00:00:00", 64), git_log.parse_git_log(whole, "2030-01-01 00:00:00")):
            columns = [c for c in want.columns if c not in ("log_pos", "line_no")]
            assert rows(got, *columns) == rows(want, *columns)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rename_paths(spark):
    paths = ["a/{b => c}/d", "{x => y}//z", "plain//p", "a/{ => b}/c"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(git_log.new_path(F.col("p"))).collect()] == ["a/c/d", "y/z", "plain//p", "a/{ => b}/c"]


def test_source_tree(spark, tmp_path, rows):
    for path, text in {
        "r1/src/a.py": "x\ny\n", "r1/node_modules/b.js": "", "r1/README.md": "hi", "r1/readme.md": "lower", "r1/Makefile": "",
        "r2/c.tsx": "", "r2/x/dist/d.go": "", "r2/Readme.md": "two",
    }.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    (tmp_path / "r2/raw.py").write_bytes(b"x = '\xff'\n")
    (tmp_path / "r2/logo.png").write_bytes(b"\x89PNG")
    manifest = tmp_path / "manifest.tsv"
    listed = [p for p in sorted(tmp_path.rglob("*")) if p.is_file()]
    manifest.write_text("".join(f"{p.stat().st_size}\t{p.relative_to(tmp_path).as_posix()}\n" for p in listed))
    sizes = tree.read_manifest(spark, str(manifest))
    assert sizes.count() == 10 and sizes.where("size = 0").count() == 4
    manifest.rename(tmp_path.parent / f"{tmp_path.name}.tsv")
    sizes = tree.read_manifest(spark, str(tmp_path.parent / f"{tmp_path.name}.tsv"))
    assert rows(tree.to_files(tree.scan_source_tree(spark, str(tmp_path))), "path") == [("raw.py",), ("src/a.py",)]
    source = tree.scan_source_tree(spark, str(tmp_path), sizes)
    assert rows(tree.to_files(source), "repo_id", "path", "language", "loc") == [("r1", "src/a.py", "python", 3), ("r2", "c.tsx", "typescript", 1), ("r2", "raw.py", "python", 2)]
    listing = tree.scan_tree(spark, str(tmp_path), sizes)
    assert listing.count() == 10
    assert {r.path: r.content for r in listing.where("path LIKE '%.p%' AND repo_id = 'r2'").collect()} == {"raw.py": "x = '\ufffd'\n", "logo.png": None}
    assert rows(tree.pick_readme(listing)) == [("r1", "hi"), ("r2", "two")]


def test_stored_listing_keeps_empty_and_unopened_files(spark, tmp_path, rows):
    files = spark.createDataFrame([("r", "a.py", "x\n"), ("r", "b.py", ""), ("r", "logo.png", None), ("q", "README.md", "hi")], "repo_id string, path string, content string")
    tree.write_listing(files, str(tmp_path / "listing"))
    back = tree.read_listing(spark, str(tmp_path / "listing"))
    assert rows(back) == rows(files)
    plan = tree.keep_source_files(back).select("repo_id", "path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1]


def test_pull_requests(spark, tmp_path):
    raw = [
        {"repo_id": "r", "number": 1, "title": " T ", "body": None, "user": None, "requested_reviewers": [{"login": "a"}, {"login": None}], "changed_files": None, "merged_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-02"},
        {"repo_id": "r", "number": 2, "title": None, "body": "b\n", "user": {"login": "u"}, "requested_reviewers": None, "changed_files": 4, "merged_at": "bad", "updated_at": "2024-01-03"},
        {"repo_id": "r", "number": 3, "title": "open", "merged_at": None, "updated_at": "2024-01-04"},
        {"repo_id": "r", "number": 4, "title": "old", "merged_at": "2023-01-01T00:00:00Z", "updated_at": "2023-01-01"},
    ]
    (tmp_path / "p.json").write_text("\n".join(json.dumps(r) for r in raw))
    got = read_pull_requests(spark, str(tmp_path), max_prs=2).orderBy("number").collect()
    assert [(r.number, r.title, r.description, r.author, r.reviewers, r.files_changed) for r in got] == [(1, "T", "", "", ["a"], 0), (2, "", "b", "u", [], 4)]
    assert got[1].merged_at is None


PY = '''\
"""doc"""
import os as o, sys
from .pkg import thing as t
from . import sib
from a.b import (
    c,
)
from __future__ import annotations
X = 1


@deco
@more(1)
class D(Base):
    pass

async def f(a):
    if a and "x or y":
        for i in a:
            yield i
    # if not counted
    return [i for i in a if i]
# trailing


class K:
    import inner

    def m(self):
        pass
'''

TS = """\
import React from "react";
import './side.css';
export default function App() {
  return a?.b ? c : d;
}
export const go = (x: number) => {
  if (x) { return 1; } else { return 2; }
};
interface P {
  a: string;
}
type Q = string;
export default App;
const hidden = () => 1;
class Z {}
"""


def _extract(spark, language, content):
    df = spark.createDataFrame([("r", "f", "p", language, content)], "repo_id string, file_id string, path string, language string, content string")
    return extract_symbols(df).orderBy("start_line").collect()


def test_python_symbols(spark):
    got = [(s.kind, s.name, s.start_line, s.end_line, s.cyclomatic_complexity) for s in _extract(spark, "python", PY)]
    assert got == [
        ("import", "os as o", 2, 2, 0), ("import", "thing as t", 3, 3, 0), ("import", "sib", 4, 4, 0), ("import", "a.b", 5, 7, 0),
        ("function", "D", 12, 15, 1), ("function", "f", 17, 22, 4), ("class", "K", 26, 30, 0),
    ]
    ordinals = [s.ordinal for s in _extract(spark, "python", PY)]
    assert ordinals == sorted(ordinals, reverse=True)


def test_typescript_symbols(spark):
    got = [(s.kind, s.name, s.start_line, s.end_line, s.cyclomatic_complexity) for s in _extract(spark, "typescript", TS)]
    assert got == [
        ("import", "react", 1, 1, 0), ("import", "side.css", 2, 2, 0), ("function", "App", 3, 5, 3), ("function", "go", 6, 8, 3),
        ("class", "P", 9, 11, 0), ("class", "Q", 12, 12, 0), ("function", "App", 13, 13, 1), ("class", "Z", 15, 15, 0),
    ]
    source = {s.start_line: s.source_code for s in _extract(spark, "typescript", TS)}
    assert source[3].startswith("function App") and source[6].startswith("(x: number) =>") and source[6].endswith("}")


def test_javascript_has_no_type_declarations(spark):
    got = [(s.kind, s.name) for s in _extract(spark, "javascript", TS)]
    assert got == [("import", "react"), ("import", "side.css"), ("function", "App"), ("function", "go"), ("class", "Z")]


def test_long_quiet_tail_and_escapes_do_not_overflow(spark):
    text = "def f():\n    s = '" + "\\x41" * 20000 + "'\n" + "# c\n" * 20000
    (symbol,) = _extract(spark, "python", text)
    assert (symbol.end_line, symbol.cyclomatic_complexity) == (2, 1)


def test_member_names_and_keys_are_no_decisions(spark):
    code = {"fetch(u).then(g).catch(h)": 1, "x = {do: 1, case: 2}": 1, "if (a) { b() } else { c() }": 3, "try { a() } catch (e) { b() }": 3}
    made = [("javascript", "function", text) for text in code]
    got = symbols.complexity(spark.createDataFrame(made, "language string, kind string, source_code string"))
    assert {r.source_code: r.cyclomatic_complexity for r in got.collect()} == code


def test_text_inside_docstrings_declares_nothing(spark):
    code = '"""About this.\nfrom config import x\nclass of things\n"""\nimport real\n\n\ndef f():\n    """One\nclass Two:\n    """\n    return 1\n'
    files = spark.createDataFrame([("r", "f", "a.py", "python", code)], "repo_id string, file_id string, path string, language string, content string")
    got = {(r.kind, r.name, r.start_line) for r in extract_symbols(files).collect()}
    assert got == {("import", "real", 5), ("function", "f", 8)}


def _named(spark, language, content):
    return [(s.kind, s.name, s.start_line, s.end_line) for s in _extract(spark, language, content)]


def test_quotes_in_comments_and_strings_open_nothing(spark):
    code = "# the \"\"\" mark opens a docstring\nimport os\n\n\ndef f():\n    return 1\n\n\nclass A:\n    pass\n"
    assert _named(spark, "python", code) == [("import", "os", 2, 2), ("function", "f", 5, 6), ("class", "A", 9, 10)]
    code = "Q = '\"\"\"'\nimport os\nR = \"it's '''\"\ndef f():\n    s = '''\nclass of things\n'''\n    return s\n"
    assert _named(spark, "python", code) == [("import", "os", 2, 2), ("function", "f", 4, 8)]
    code = "S = \"\"\"a \\\"\"\" still\nclass of things\n\"\"\"\nclass A:\n    pass\n"
    assert _named(spark, "python", code) == [("class", "A", 4, 5)]


SCRIPT = """\
/*
class of comments {}
*/
const glob = "src/**/*.ts"; // ` is only a comment
const page = `
class of templates
import x from 'y';
it's ${ list.map((a) => { return `<li>
class Inner {}
${a} } </li>`; }).join("`") } and
function no() {}
`;
export class Real {
  m() { return `${this.a}`; }
}
import z from './z';
function last() {}
"""


def test_template_strings_and_block_comments_declare_nothing(spark):
    want = [("class", "Real", 13, 15), ("import", "z", 16, 16), ("function", "last", 17, 17)]
    assert _named(spark, "typescript", SCRIPT) == want
    assert _named(spark, "javascript", SCRIPT) == want
    plain = "/*\nclass of things {}\n*/\nconst glob = 'a/**/*.ts';\nclass A {}\nconst b = 'c/*';\nclass B {}\n"
    assert _named(spark, "typescript", plain) == [("class", "A", 5, 5), ("class", "B", 7, 7)]


def test_scanner_against_a_plain_walk(spark):
    """The state of every line start equals a character walk over random marks."""
    rng = random.Random(3)

    def walk(text):
        mode, stack, out, i = "", [], ["0"], 0
        while i < len(text):
            two, c = text[i:i + 2], text[i]
            i += 1
            if c == "\n":
                mode = "" if mode in ("/", "'", '"') else mode
                out.append("1" if mode else "0")
            elif mode == "":
                if two in ("//", "/*"):
                    mode, i = two[1], i + 1
                elif c in "'\"`":
                    mode = c
                elif c == "{":
                    stack.append("{")
                elif c == "}":
                    mode = "`" if stack and stack.pop() == "`" else ""
            elif mode == "`" and two == "${":
                stack.append("`")
                mode, i = "", i + 1
            elif mode == "*" and two == "*/":
                mode, i = "", i + 1
            elif mode == c and c in "'\"`":
                mode = ""
        return "".join(out)

    marks = ["'", '"', "`", "${", "{", "}", "\n", "//", "/* ", " */", " a ", "class X"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    # Neighbouring marks may form others (a star and a slash); the walk and the scanner read them alike only where marks are apart.
    texts = [t for t in texts if not any(x in t for x in ("/*/", "//*", "///", "*//", "*/*"))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.s for r in df.select("t", symbols._silent_lines(F.col("t")).alias("s")).collect()}
    assert got == {t: walk(t) for t in texts}
