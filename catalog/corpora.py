"""Canonical inputs derived from the test tables, in Spark and as SQL common table expressions.

Part corpus    one file per part, one symbol per line item, imports name other parts.
Order corpus   one file per order, touched once per line item by its supplier.
Line corpus    one file per document, one symbol per text line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import table

# --- part corpus -----------------------------------------------------------------


def part_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(
        "p_brand AS repo_id",
        "concat('f', p_partkey) AS file_id",
        "concat(lower(p_type), '/d', p_partkey, '/', replace(p_name, ' ', '_'), "
        "CASE p_size % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.js' ELSE '.go' END) AS path",
        "CASE p_size % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript' END AS language",
        "IF(p_size = 50, NULL, p_size) AS loc",
    )


PART_FILES = """files AS (
  SELECT p_brand AS repo_id, 'f' || p_partkey AS file_id,
         lower(p_type) || '/d' || p_partkey || '/' || replace(p_name, ' ', '_') ||
         CASE p_size % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.js' ELSE '.go' END AS path,
         CASE p_size % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript' END AS language,
         CASE WHEN p_size = 50 THEN NULL ELSE p_size END AS loc
  FROM part)"""


def part_symbols(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    line = table(spark, d, "lineitem")
    owner = part.selectExpr("p_partkey AS l_partkey", "p_brand AS repo_id")
    named = part.selectExpr(
        "p_partkey AS tgt_part", "concat(lower(p_type), '.d', p_partkey, '.') AS tgt_pkg",
        "replace(p_name, ' ', '_') AS tgt_name",
    )
    return (
        line.withColumn("tgt_part", F.expr("l_suppkey * 20 + l_linenumber"))
        .join(owner, "l_partkey").join(named, "tgt_part")
        .selectExpr(
            "repo_id",
            "concat('L', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS symbol_id",
            "concat('f', l_partkey) AS file_id",
            "CASE WHEN l_returnflag = 'A' THEN 'import' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'function' "
            "WHEN l_returnflag = 'N' THEN 'class' WHEN l_linestatus = 'O' THEN 'method' ELSE 'variable' END AS kind",
            "CASE WHEN l_returnflag <> 'A' THEN concat('sym_', l_orderkey) "
            "WHEN l_linenumber % 2 = 1 THEN concat('.', tgt_pkg, tgt_name) "
            "WHEN l_linenumber % 4 = 0 THEN concat(tgt_name, ' as x') ELSE tgt_name END AS name",
            "l_linenumber * 10 AS start_line",
            "l_linenumber * 10 + CAST(l_quantity AS INT) AS end_line",
            "concat('def sym_', l_orderkey, '(q):\n    return ', CAST(l_quantity AS INT)) AS source_code",
            "CAST(l_quantity AS INT) AS cyclomatic_complexity",
            "l_orderkey * 10 + l_linenumber AS ordinal",
        )
    )


PART_SYMBOLS = """symbols AS (
  SELECT o.p_brand AS repo_id,
         'L' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS symbol_id,
         'f' || l_partkey AS file_id,
         CASE WHEN l_returnflag = 'A' THEN 'import' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'function'
              WHEN l_returnflag = 'N' THEN 'class' WHEN l_linestatus = 'O' THEN 'method' ELSE 'variable' END AS kind,
         CASE WHEN l_returnflag <> 'A' THEN 'sym_' || l_orderkey
              WHEN l_linenumber % 2 = 1 THEN '.' || lower(t.p_type) || '.d' || t.p_partkey || '.' || replace(t.p_name, ' ', '_')
              WHEN l_linenumber % 4 = 0 THEN replace(t.p_name, ' ', '_') || ' as x'
              ELSE replace(t.p_name, ' ', '_') END AS name,
         l_linenumber * 10 AS start_line, l_linenumber * 10 + CAST(l_quantity AS INT) AS end_line,
         'def sym_' || l_orderkey || '(q):' || chr(10) || '    return ' || CAST(l_quantity AS INT) AS source_code,
         CAST(l_quantity AS INT) AS cyclomatic_complexity,
         l_orderkey * 10 + l_linenumber AS ordinal
  FROM lineitem JOIN part o ON o.p_partkey = l_partkey JOIN part t ON t.p_partkey = l_suppkey * 20 + l_linenumber)"""

FIRST_TARGET = """first_target AS (
  SELECT repo_id, file_id, symbol_id AS target_symbol_id FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, file_id ORDER BY ordinal, symbol_id) AS rn
    FROM symbols WHERE kind IN ('function', 'class', 'method')) WHERE rn = 1)"""

RESOLVED = """full_key AS (
  SELECT repo_id, regexp_replace(path, '\\.[^.]*$', '') AS key, arg_max(file_id, path) AS file_id FROM files GROUP BY 1, 2),
name_key AS (
  SELECT repo_id, regexp_extract(regexp_replace(path, '\\.[^.]*$', ''), '[^/]*$') AS key, arg_min(file_id, path) AS file_id
  FROM files GROUP BY 1, 2),
import_key AS (
  SELECT repo_id, key, coalesce(f.file_id, n.file_id) AS file_id FROM full_key f FULL JOIN name_key n USING (repo_id, key)),
raw_import AS (
  SELECT repo_id, symbol_id, file_id, trim(ltrim(replace(name, '.', '/'), './')) AS dotted FROM symbols WHERE kind = 'import'),
import_path AS (
  SELECT repo_id, symbol_id, file_id, trim(split_part(dotted, ' as ', 1)) AS import_path FROM raw_import),
resolved AS (
  SELECT i.repo_id, i.symbol_id AS source_symbol_id,
         CASE WHEN a.file_id <> i.file_id THEN a.file_id WHEN b.file_id <> i.file_id THEN b.file_id END AS hit
  FROM import_path i
  LEFT JOIN import_key a ON a.repo_id = i.repo_id AND a.key = i.import_path
  LEFT JOIN import_key b ON b.repo_id = i.repo_id AND b.key = split_part(i.import_path, '/', -1)),
deps AS (
  SELECT r.repo_id, source_symbol_id, target_symbol_id, 'imports' AS dep_type
  FROM resolved r JOIN first_target t ON t.repo_id = r.repo_id AND t.file_id = r.hit)"""

FILE_EDGES = """edges AS (
  SELECT d.repo_id, s.file_id AS src_file_id, t.file_id AS tgt_file_id, dep_type
  FROM deps d JOIN symbols s ON s.symbol_id = d.source_symbol_id AND s.repo_id = d.repo_id
              JOIN symbols t ON t.symbol_id = d.target_symbol_id AND t.repo_id = d.repo_id
  WHERE s.file_id <> t.file_id)"""

DEGREES = """measured AS (
  SELECT f.*, coalesce(i.n, 0)::INT AS fan_in, coalesce(o.n, 0)::INT AS fan_out
  FROM files f
  LEFT JOIN (SELECT repo_id, tgt_file_id AS file_id, count(*) AS n FROM edges GROUP BY 1, 2) i USING (repo_id, file_id)
  LEFT JOIN (SELECT repo_id, src_file_id AS file_id, count(*) AS n FROM edges GROUP BY 1, 2) o USING (repo_id, file_id))"""

PART_DEPS = ",\n".join([PART_FILES, PART_SYMBOLS, FIRST_TARGET, RESOLVED])
PART_EDGES = f"{PART_DEPS},\n{FILE_EDGES}"
PART_MEASURED = f"{PART_EDGES},\n{DEGREES}"

# --- typed edges: several dependency types per file pair ----------------------------


def typed_edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "l_linestatus AS repo_id", "l_partkey % 200 AS src_file_id", "l_suppkey AS tgt_file_id",
        "l_returnflag AS dep_type",
    ).where("src_file_id <> tgt_file_id")


TYPED_EDGES = """edges AS (
  SELECT l_linestatus AS repo_id, l_partkey % 200 AS src_file_id, l_suppkey AS tgt_file_id, l_returnflag AS dep_type
  FROM lineitem WHERE l_partkey % 200 <> l_suppkey)"""

# --- layered graph: acyclic, part p of four interleaved repositories imports lower parts --


def layered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, d, "part")
    nodes = part.selectExpr(
        "concat('r', p_partkey % 4) AS repo_id", "concat('f', p_partkey) AS file_id",
        "concat(lower(p_type), '/', replace(p_name, ' ', '_'), '_', p_partkey, '.py') AS path",
        "p_brand AS language", "p_size AS loc",
    )
    edges = part.selectExpr(
        "concat('r', p_partkey % 4) AS repo_id", "concat('f', p_partkey) AS src_file_id",
        "explode(array((p_partkey div 4) div 2, (p_partkey div 4) div 3)) AS lower", "p_partkey",
    ).where("lower <> p_partkey div 4").selectExpr(
        "repo_id", "src_file_id", "concat('f', lower * 4 + p_partkey % 4) AS tgt_file_id", "'imports' AS dep_type",
    )
    return nodes, edges


LAYERED = """files AS (
  SELECT 'r' || (p_partkey % 4) AS repo_id, 'f' || p_partkey AS file_id,
         lower(p_type) || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.py' AS path,
         p_brand AS language, p_size AS loc FROM part),
edges AS (
  SELECT 'r' || (p_partkey % 4) AS repo_id, 'f' || p_partkey AS src_file_id,
         'f' || (l.lower * 4 + p_partkey % 4) AS tgt_file_id, 'imports' AS dep_type
  FROM part, LATERAL (SELECT unnest([(p_partkey // 4) // 2, (p_partkey // 4) // 3]) AS lower) l
  WHERE l.lower <> p_partkey // 4)"""

# --- order corpus --------------------------------------------------------------------

_ORDER_PATH_SPARK = (
    "concat(lower(o_orderstatus), '/y', year(o_orderdate), '/order_', o_orderkey, "
    "CASE o_custkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.go' ELSE '' END)"
)
_ORDER_PATH_SQL = (
    "lower(o_orderstatus) || '/y' || year(o_orderdate) || '/order_' || o_orderkey || "
    "CASE o_custkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.go' ELSE '' END"
)


def order_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(
        "o_orderpriority AS repo_id",
        "concat('o', o_orderkey) AS file_id",
        f"{_ORDER_PATH_SPARK} AS path",
        "CASE o_orderstatus WHEN 'F' THEN 'python' WHEN 'O' THEN 'go' END AS language",
        "IF(o_orderkey % 10 = 9, NULL, CAST(floor(o_totalprice / 1000) AS INT)) AS loc",
    )


ORDER_FILES = f"""files AS (
  SELECT o_orderpriority AS repo_id, 'o' || o_orderkey AS file_id, {_ORDER_PATH_SQL} AS path,
         CASE o_orderstatus WHEN 'F' THEN 'python' WHEN 'O' THEN 'go' END AS language,
         CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE CAST(floor(o_totalprice / 1000) AS INT) END AS loc
  FROM orders)"""

LOG_ORDER = ("age", "l_linenumber", "l_partkey", "l_suppkey")


def order_touches(spark: SparkSession, d: str) -> DataFrame:
    """Touch log of the order corpus; e-mails in mixed case, names that vary between touches."""
    line = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", "l_shipdate"
    )
    orders = table(spark, d, "orders").selectExpr(
        "o_orderkey AS l_orderkey", "o_orderpriority AS repo_id", f"{_ORDER_PATH_SPARK} AS path"
    )
    supplier = table(spark, d, "supplier").selectExpr("s_suppkey AS l_suppkey", "s_name")
    return line.join(orders, "l_orderkey").join(supplier, "l_suppkey").selectExpr(
        "repo_id", "path", "concat('S', l_suppkey, '@Example.com') AS author_email",
        "concat(s_name, ' ', l_linestatus) AS author_name", "CAST(l_shipdate AS TIMESTAMP) AS ts",
        "-unix_micros(CAST(l_shipdate AS TIMESTAMP)) AS age", "l_linenumber", "l_partkey", "l_suppkey",
    )


ORDER_TOUCHES = f"""touches AS (
  SELECT o_orderpriority AS repo_id, {_ORDER_PATH_SQL} AS path, lower('S' || l_suppkey || '@Example.com') AS email,
         s_name || ' ' || l_linestatus AS author_name, l_shipdate AS ts,
         row_number() OVER (ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_orderkey) AS log_pos
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey)"""

AUTHOR_STATS = """author_stats AS (
  SELECT repo_id, path, email, count(*) AS commit_count, max(ts) AS last_commit,
         arg_min(author_name, log_pos) AS name, min(log_pos) AS first_pos
  FROM touches GROUP BY 1, 2, 3),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY commit_count DESC, first_pos) AS rank,
         sum(commit_count) OVER (PARTITION BY repo_id, path) AS total
  FROM author_stats),
shares AS (SELECT *, round_even(commit_count / total * 100, 1) AS percentage FROM ranked)"""

OWNERSHIP = """ownership AS (
  SELECT repo_id, path, sum(commit_count)::BIGINT AS change_frequency, max(last_commit) AS git_last_modified,
         max(CASE WHEN rank = 1 THEN name || ' <' || email || '>' END) AS primary_owner,
         string_agg(email || '|' || name || '|' || commit_count || '|' || percentage || '|' ||
                    strftime(last_commit, '%Y-%m-%dT%H:%M:%S+00:00'), ';' ORDER BY rank) AS contributors,
         count(*)::INT AS bus_factor, count(*) = 1 AS is_knowledge_silo
  FROM shares GROUP BY 1, 2),
owners AS (SELECT f.file_id, o.* FROM ownership o JOIN files f USING (repo_id, path))"""

ORDER_OWNED = ",\n".join([ORDER_FILES, ORDER_TOUCHES, AUTHOR_STATS, OWNERSHIP])

# --- line corpus ---------------------------------------------------------------------


def line_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr(
        "lang AS repo_id", "concat('d', doc_id) AS file_id", "concat(source, '/doc_', doc_id, '.py') AS path"
    )


def line_symbols(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").selectExpr(
        "lang AS repo_id", "doc_id", "posexplode(split(text, '\n')) AS (pos, source_code)"
    )
    return lines.selectExpr(
        "repo_id", "concat('d', doc_id, '-', pos) AS symbol_id", "concat('d', doc_id) AS file_id",
        "CASE (pos + doc_id) % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'method' ELSE 'variable' END AS kind",
        "concat('line_', pos) AS name", "source_code", "pos AS ordinal", "pos + 1 AS start_line", "pos + 1 AS end_line",
    )


LINE_CORPUS = """files AS (
  SELECT lang AS repo_id, 'd' || doc_id AS file_id, source || '/doc_' || doc_id || '.py' AS path FROM documents),
raw_lines AS (
  SELECT lang AS repo_id, doc_id, unnest(string_split(text, chr(10))) AS source_code,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
symbols AS (
  SELECT repo_id, 'd' || doc_id || '-' || pos AS symbol_id, 'd' || doc_id AS file_id,
         CASE (pos + doc_id) % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'method' ELSE 'variable' END AS kind,
         'line_' || pos AS name, source_code, pos AS ordinal, (pos + 1)::INT AS start_line, (pos + 1)::INT AS end_line
  FROM raw_lines)"""
