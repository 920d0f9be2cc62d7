"""Raw sources: git log text, pull-request JSON, source files, repository URLs, symbols."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import Catalog, table
from stratacode import schemas
from stratacode.operators.symbols import extract_symbols
from stratacode.session import ensure_checkpoint_dir
from stratacode.sources import git_log, tree
from stratacode.sources.pull_requests import normalise_pull_requests

C = Catalog()

NOW = "2024-01-01 00:00:00"

# Orders as commits, line items as changed files.  Some subjects hold a "|", which shifts
# the fields; some counts are "-" or no number; some paths are renames or use "\".
_BAR = "o_orderkey % 50 = 7"


def _log_lines(spark, d):
    heads = table(spark, d, "orders").selectExpr(
        "o_orderpriority AS repo_id", "o_orderkey * 100 AS line_no",
        "concat(sha1(CAST(o_orderkey AS STRING)), '|Cust', o_custkey, '@X.org|Customer ', o_custkey, '|', "
        f"IF({_BAR}, 'pay|later', concat('order ', o_orderkey)), '|', date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss'), ' +0200') AS line",
    )
    repo = table(spark, d, "orders").selectExpr("o_orderkey AS l_orderkey", "o_orderpriority AS repo_id")
    changes = table(spark, d, "lineitem").join(repo, "l_orderkey").selectExpr(
        "repo_id", "l_orderkey * 100 + 10 + l_linenumber AS line_no",
        r"concat(CASE l_linenumber WHEN 3 THEN '-' WHEN 7 THEN 'x' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END, '\t', "
        r"IF(l_linenumber = 3, '-', CAST(l_linenumber AS STRING)), '\t', "
        r"CASE l_linenumber WHEN 5 THEN concat('src/{old => new}/p', l_partkey, '.py') WHEN 6 THEN concat('a\\b\\p', l_partkey, '.py') "
        r"WHEN 4 THEN concat('lib/{ => sub}/p', l_partkey, '.py') WHEN 2 THEN concat('{a => b}//p', l_partkey, '.py') ELSE concat('p', l_partkey, '/s', l_suppkey, '.py') END) AS line",
    )
    blank = heads.selectExpr("repo_id", "line_no + 1 AS line_no", "' ' AS line")
    return heads.unionByName(blank).unionByName(changes)


_CHANGES = r"""changes AS (
  SELECT o_orderpriority AS repo_id, sha1(o_orderkey::VARCHAR) AS hash, o_orderkey * 100 AS log_pos,
         CASE l_linenumber WHEN 3 THEN 0 ELSE l_quantity::INT END AS added, CASE l_linenumber WHEN 3 THEN 0 ELSE l_linenumber END AS deleted,
         CASE l_linenumber WHEN 5 THEN 'src/new/p' || l_partkey || '.py' WHEN 6 THEN 'a/b/p' || l_partkey || '.py'
              WHEN 4 THEN 'lib/{ => sub}/p' || l_partkey || '.py' WHEN 2 THEN 'b/p' || l_partkey || '.py'
              ELSE 'p' || l_partkey || '/s' || l_suppkey || '.py' END AS path, o_custkey, o_orderkey
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber <> 7)"""

_COMMITS = f"""{_CHANGES}, counts AS (SELECT o_orderkey, count(*) AS n FROM changes GROUP BY 1), commits AS (
  SELECT o_orderpriority AS repo_id, sha1(o_orderkey::VARCHAR) AS hash, 'Customer ' || o_custkey AS author_name,
         'cust' || o_custkey || '@x.org' AS author_email, CASE WHEN {_BAR} THEN 'pay' ELSE 'order ' || o_orderkey END AS message,
         coalesce(n, 0)::INT AS files_changed,
         CASE WHEN {_BAR} THEN '{NOW}' ELSE strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') END AS authored_at,
         o_orderkey * 100 AS log_pos, NOT ({_BAR}) AS date_ok
  FROM orders LEFT JOIN counts USING (o_orderkey))"""


def _shown(commits):
    return commits.withColumn("authored_at", F.date_format("authored_at", "yyyy-MM-dd HH:mm:ss"))


@C.query("git_commits", f"WITH {_COMMITS} SELECT * FROM commits")
def git_commits(spark, d):
    return _shown(git_log.parse_git_log(_log_lines(spark, d), NOW)[0])


@C.query("git_commit_files", f"""WITH {_CHANGES}
SELECT repo_id, hash, log_pos, path, added, deleted, 'cust' || o_custkey || '@x.org' AS author_email, 'Customer ' || o_custkey AS author_name
FROM changes""")
def git_commit_files(spark, d):
    return git_log.parse_git_log(_log_lines(spark, d), NOW, lines_per_block=5000)[1].drop("line_no", "ts")


@C.query("newest_commits", f"""WITH {_COMMITS}
SELECT repo_id, hash, files_changed FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY log_pos) AS rn FROM commits) WHERE rn <= 500""")
def newest_commits(spark, d):
    commits, _ = git_log.parse_git_log(_log_lines(spark, d), NOW)
    return git_log.newest_commits(commits, 500).select("repo_id", "hash", "files_changed")


@C.query("pull_requests", """SELECT o_orderpriority AS repo_id, o_orderkey::INT AS number, 'Order ' || o_orderkey AS title,
       CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'body' || chr(10) || 'of ' || o_orderkey END AS description,
       CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'c' || o_custkey END AS author,
       CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'r' || o_custkey || ',r1' END AS reviewers,
       CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE (o_orderkey % 100)::INT END AS files_changed,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS merged_at FROM orders WHERE o_orderstatus <> 'P'""")
def pull_requests(spark, d):
    dumped = table(spark, d, "orders").selectExpr(
        "to_json(named_struct('repo_id', o_orderpriority, 'number', o_orderkey, 'title', concat('  Order ', o_orderkey, ' '), "
        "'body', IF(o_orderkey % 3 = 0, NULL, concat('body\n', 'of ', o_orderkey, '\n')), "
        "'user', IF(o_orderkey % 7 = 0, NULL, named_struct('login', concat('c', o_custkey))), "
        "'requested_reviewers', IF(o_orderkey % 5 = 0, NULL, array(named_struct('login', concat('r', o_custkey)), "
        "named_struct('login', CAST(NULL AS STRING)), named_struct('login', 'r1'))), "
        "'changed_files', IF(o_orderkey % 2 = 0, NULL, o_orderkey % 100), "
        "'merged_at', IF(o_orderstatus = 'P', NULL, date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")), "
        "'updated_at', date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"))) AS dump"
    )
    raw = dumped.select(F.from_json("dump", schemas.PULL_REQUESTS_RAW).alias("r")).select("r.*")
    return _shown_requests(normalise_pull_requests(raw))


def _shown_requests(requests):
    return requests.withColumn("reviewers", F.array_join("reviewers", ",")).withColumn("merged_at", F.date_format("merged_at", "yyyy-MM-dd HH:mm:ss"))


_PATHS = (
    "CASE doc_id % 9 WHEN 0 THEN 'src/a_' || doc_id || '.py' WHEN 1 THEN 'node_modules/x/a_' || doc_id || '.js' WHEN 2 THEN 'README.md' "
    "WHEN 3 THEN 'lib/a_' || doc_id || '.d.ts' WHEN 4 THEN 'x/build/a_' || doc_id || '.go' WHEN 5 THEN '.py' WHEN 6 THEN 'Makefile' "
    "WHEN 7 THEN 'readme.md' ELSE 'build.rs' END"
)


# Some files are empty, and some are listed but not opened.
_CONTENT = "CASE WHEN doc_id % 27 = 3 THEN '' WHEN doc_id % 9 = 6 THEN NULL ELSE text END"


def _tree_files(spark, d):
    """A stored listing of files, one repository a document, read back by a scan."""
    made = table(spark, d, "documents").selectExpr("concat('doc', doc_id) AS repo_id", f"{_PATHS} AS path", f"{_CONTENT} AS content")
    path = f"{ensure_checkpoint_dir(spark)}/listing-{uuid.uuid4().hex}"
    tree.write_listing(made, path)
    return tree.read_listing(spark, path)


@C.query("source_files", f"""WITH f AS (SELECT 'doc' || doc_id AS repo_id, doc_id, {_CONTENT} AS text, {_PATHS} AS path FROM documents)
SELECT repo_id, path, CASE doc_id % 9 WHEN 0 THEN 'python' WHEN 3 THEN 'typescript' ELSE 'rust' END AS language,
       (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS loc FROM f WHERE doc_id % 9 IN (0, 3, 8)""")
def source_files(spark, d):
    return tree.to_files(tree.keep_source_files(_tree_files(spark, d))).drop("file_id", "content")


@C.query("readmes", f"""WITH f AS (SELECT source AS repo_id, text, {_PATHS} AS path, doc_id FROM documents), r AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY CASE path WHEN 'README.md' THEN 1 ELSE 2 END) AS rn,
         min(doc_id) OVER (PARTITION BY repo_id, path) AS first_doc FROM f WHERE path IN ('README.md', 'readme.md'))
SELECT repo_id, text AS content FROM r WHERE doc_id = first_doc AND path = CASE WHEN repo_id IN
  (SELECT repo_id FROM f WHERE path = 'README.md') THEN 'README.md' ELSE 'readme.md' END""")
def readmes(spark, d):
    docs = table(spark, d, "documents").selectExpr("source AS repo_id", f"{_PATHS} AS path", "text AS content", "doc_id")
    # A path occurs once per repository: the first document that has it.
    unique = docs.groupBy("repo_id", "path").agg(F.min_by("content", "doc_id").alias("content"))
    return tree.pick_readme(unique)


@C.query("repo_urls", r"""WITH u AS (
  SELECT page_id, url, regexp_replace(url, '/+$', '') AS clean FROM pages), s AS (
  SELECT *, list_filter(string_split(regexp_extract(clean, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM u)
SELECT page_id, split_part(clean, '/', -1) AS repo_name, CASE WHEN len(parts) >= 2 THEN parts[1] END AS owner,
       CASE WHEN len(parts) >= 2 THEN regexp_replace(parts[2], '\.git$', '') END AS repo, len(parts) >= 2 AS parsed,
       regexp_full_match(url, 'https://github\.com/[\w.-]+/[\w.-]+/?') AS is_valid FROM s""")
def repo_urls(spark, d):
    return tree.parse_repo_url(table(spark, d, "pages").select("page_id", "url"), "url").drop("url")


# One source file per order, one statement per line item; scripts for odd customers.
_PY = {
    "A": "from pkg.mod{k} import thing",
    "N": "def fn_{k}(a, b):\n    if a > b and b:\n        return 'if x and y'\n\n    return b  # or not",
    "RO": "class C_{k}(Base):\n    x = 1\n\n    def m(self):\n        pass",
    "RF": "@deco\n@other(1)\nclass D_{k}:\n    y = 2",
}
_TS = {
    "A": "import {{ a }} from './mod{k}';",
    "N": "export const fn_{k} = async (x) => {{\n  return x ? 1 : 2;\n}};",
    "RO": "export class K_{k} {{\n  m() {{ return 1; }}\n}}",
    "RF": "export interface I_{k} {{\n  a: number;\n}}",
}
# What every file begins with: text in strings and comments that only looks like declarations.
_PY_LEAD = "# the \"\"\" mark opens a docstring\nQ = '\"\"\"'\nS = \"\"\"\nclass of things\nimport nothing\n\"\"\"\n"
_TS_LEAD = "/*\nclass of things {}\n*/\nconst glob = 'src/**/*.ts';\nconst page = `\nclass of ${ a ? `b\nclass Inner {}\n` : \"`\" } it's\nimport x from 'y';\n`;\n"
_TAIL = {"py": "\n# tail\n", "ts": "\n// tail\n"}


def _spark_text(text):
    head, tail = text.replace("{{", "{").replace("}}", "}").split("{k}")
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    return f"concat({quote(head)}, l_partkey, {quote(tail)})"


def _sql_text(text):
    head, tail = text.replace("{{", "{").replace("}}", "}").split("{k}")
    quote = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"{quote(head)} || l_partkey || {quote(tail)}"


def _case(texts, render):
    return (
        f"CASE WHEN l_returnflag = 'A' THEN {render(texts['A'])} WHEN l_returnflag = 'N' THEN {render(texts['N'])} "
        f"WHEN l_linestatus = 'O' THEN {render(texts['RO'])} ELSE {render(texts['RF'])} END"
    )


def _code_files(spark, d):
    orders = table(spark, d, "orders").selectExpr("o_orderkey AS l_orderkey", "o_orderpriority AS repo_id", "o_custkey % 2 = 1 AS ts")
    parts = table(spark, d, "lineitem").join(orders, "l_orderkey").selectExpr(
        "repo_id", "l_orderkey", "ts", "l_linenumber", "l_partkey", "l_suppkey",
        f"concat(IF(ts, {_case(_TS, _spark_text)}, {_case(_PY, _spark_text)}), IF(ts, '\\n// tail\\n', '\\n# tail\\n')) AS snippet",
    )
    return parts.groupBy("repo_id", "l_orderkey", "ts").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(l_linenumber, l_partkey, l_suppkey, snippet))), x -> x.snippet), '\n')").alias("body")
    ).withColumn("content", F.concat(F.when(F.col("ts"), F.lit(_TS_LEAD)).otherwise(F.lit(_PY_LEAD)), "body")).selectExpr(
        "repo_id", "concat('o', l_orderkey) AS file_id", "IF(ts, 'typescript', 'python') AS language", "content")


def _lines_of(texts):
    n = {k: v.count("\n") + 1 for k, v in texts.items()}
    return f"CASE WHEN l_returnflag = 'A' THEN {n['A']} WHEN l_returnflag = 'N' THEN {n['N']} WHEN l_linestatus = 'O' THEN {n['RO']} ELSE {n['RF']} END"


_CODE = f"""code AS (
  SELECT o_orderpriority AS repo_id, 'o' || o_orderkey AS file_id, o_custkey % 2 = 1 AS ts, l_partkey, l_returnflag, l_linestatus,
         CASE WHEN o_custkey % 2 = 1 THEN {_lines_of(_TS)} ELSE {_lines_of(_PY)} END AS n_lines,
         CASE WHEN o_custkey % 2 = 1 THEN {_TS_LEAD.count(chr(10))} ELSE {_PY_LEAD.count(chr(10))} END AS lead,
         row_number() OVER w AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n_stmts,
         sum(2 + CASE WHEN o_custkey % 2 = 1 THEN {_lines_of(_TS)} ELSE {_lines_of(_PY)} END) OVER w AS upto
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)),
extracted AS (
  SELECT repo_id, file_id,
         CASE WHEN l_returnflag = 'A' THEN 'import' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'class' ELSE 'function' END AS kind,
         CASE WHEN l_returnflag = 'A' THEN CASE WHEN ts THEN 'mod' || l_partkey ELSE 'pkg.mod' || l_partkey END
              WHEN l_returnflag = 'N' THEN 'fn_' || l_partkey WHEN l_linestatus = 'O' THEN CASE WHEN ts THEN 'K_' ELSE 'C_' END || l_partkey
              WHEN ts THEN '<anonymous>' ELSE 'D_' || l_partkey END AS name,
         (lead + upto - n_lines - 1)::INT AS start_line, (lead + upto - 2)::INT AS end_line,
         CASE WHEN l_returnflag = 'N' THEN CASE WHEN ts THEN 2 ELSE 3 END
              WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END AS cyclomatic_complexity,
         (n_stmts - rn)::INT AS ordinal,
         CASE WHEN ts THEN CASE WHEN l_returnflag = 'N' THEN replace(replace({_sql_text(_TS['N'])}, 'export const fn_' || l_partkey || ' = ', ''), chr(10) || '}};', chr(10) || '}}')
                                WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN replace({_sql_text(_TS['RO'])}, 'export ', '')
                                ELSE {_case(_TS, _sql_text)} END
              ELSE {_case(_PY, _sql_text)} END AS source_code
  FROM code)"""


@C.query("extract_symbols", f"WITH {_CODE} SELECT * FROM extracted")
def symbols(spark, d):
    return extract_symbols(_code_files(spark, d)).drop("symbol_id")


@C.query("complexity_totals", f"""WITH {_CODE}
SELECT repo_id, kind, count(*) AS n_symbols, sum(cyclomatic_complexity)::BIGINT AS complexity FROM extracted GROUP BY 1, 2""")
def complexity_totals(spark, d):
    return extract_symbols(_code_files(spark, d)).groupBy("repo_id", "kind").agg(
        F.count(F.lit(1)).alias("n_symbols"), F.sum("cyclomatic_complexity").alias("complexity")
    )
