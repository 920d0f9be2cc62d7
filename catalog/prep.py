"""Text-generation requests and responses, merges, briefs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.base import Catalog, table
from catalog.corpora import (
    PART_FILES, PART_MEASURED, PART_SYMBOLS, part_files, part_symbols,
)
from catalog.graphs import _TIERS, _reading

from stratacode import schemas
from stratacode.operators import edges as e
from stratacode.operators import flow, rules, stats, textgen, writes
from stratacode.plans import brief as briefs
from stratacode.session import cut_lineage, ensure_checkpoint_dir

C = Catalog()


def _measured(spark, d):
    files, symbols = part_files(spark, d), part_symbols(spark, d)
    resolved = e.resolve_imports(files, symbols)
    deps, edges = resolved.select("repo_id", "source_symbol_id", "target_symbol_id", "dep_type"), e.import_edges(resolved)
    return e.fan_metrics(files, edges), symbols, deps, edges


@C.query("annotation_requests", f"""{_TIERS}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY tier, fan_in DESC, path) AS position
  FROM measured JOIN tiers USING (repo_id, file_id))
SELECT repo_id, (position - 1) // 10 AS batch_id, count(*) AS n_items,
       string_agg('{{"file_path":"' || path || '","fan_in":' || fan_in || ',"fan_out":' || fan_out || ',"tier":' || tier || ',"language":"' || language || '"}}',
                  chr(10) ORDER BY position) AS items
FROM numbered WHERE position <= 100 GROUP BY 1, 2""")
def annotation_requests(spark, d):
    return textgen.annotation_requests(_reading(spark, d)[0], max_files=100).drop("prompt")


_CANDIDATES = f"""{PART_MEASURED}, ranked AS (
  SELECT s.*, path, fan_in, row_number() OVER (PARTITION BY repo_id ORDER BY fan_in DESC NULLS FIRST, path, start_line, symbol_id)::INT AS rank
  FROM symbols s JOIN measured USING (repo_id, file_id) WHERE kind IN ('function', 'class', 'method', 'variable')),
candidates AS (SELECT * FROM ranked WHERE rank <= 50)"""


def _candidates(spark, d):
    files, symbols, _, _ = _measured(spark, d)
    return stats.glossary_candidates(symbols, files)


@C.query("glossary_candidates", f"""WITH {_CANDIDATES}
SELECT repo_id, symbol_id, kind, name, path, fan_in, rank, source_code FROM candidates""")
def glossary_candidates(spark, d):
    return _candidates(spark, d).select("repo_id", "symbol_id", "kind", "name", "path", "fan_in", "rank", "source_code")


@C.query("glossary_requests", f"""WITH {_CANDIDATES}
SELECT repo_id, ((rank - 1) // 25)::BIGINT AS batch_id, count(*) AS n_items,
       string_agg('{{"name":"' || name || '","path":"' || path || '","lines":[' || start_line || ',' || end_line || '],"source":"' ||
                  replace(left(source_code, 300), chr(10), chr(92) || 'n') || '"}}', chr(10) ORDER BY rank) AS items
FROM candidates GROUP BY 1, 2""")
def glossary_requests(spark, d):
    return textgen.glossary_requests(_candidates(spark, d), source_chars=textgen.SOURCE_PREVIEW).drop("prompt").withColumn("batch_id", F.col("batch_id").cast("bigint"))


# Responses: JSON arrays of fifty parts each, fenced, some of them broken.
def _responses(spark, d, fields, repo="p_brand"):
    return table(spark, d, "part").selectExpr(
        f"{repo} AS repo_id", "p_partkey div 50 AS batch_id", "p_partkey", f"{fields} AS item"
    ).groupBy("repo_id", "batch_id").agg(
        F.expr("to_json(transform(array_sort(collect_list(struct(p_partkey, item))), x -> x.item))").alias("json")
    ).selectExpr(
        "repo_id", "batch_id",
        "CASE batch_id % 4 WHEN 0 THEN concat('```json\n', json, '\n```') WHEN 1 THEN concat('  ```', json, '```') "
        "WHEN 2 THEN concat('Sorry: ', json) ELSE json END AS text",
    )


@C.query("parse_responses", """SELECT p_brand AS repo_id, p_partkey // 50 AS batch_id, p_name AS name, 'def ' || p_partkey AS definition,
       (row_number() OVER (PARTITION BY p_brand, p_partkey // 50 ORDER BY p_partkey) - 1)::INT AS item_pos
FROM part WHERE (p_partkey // 50) % 4 <> 2""")
def parse_responses(spark, d):
    texts = _responses(spark, d, "named_struct('name', p_name, 'definition', concat('def ', p_partkey))")
    return textgen.parse_responses(texts, "name:string,definition:string")


@C.query("build_glossary", f"""WITH {PART_FILES}, defined AS (
  SELECT p_brand AS repo_id, p_name AS key, arg_max('def ' || p_partkey, p_partkey) AS definition
  FROM part WHERE (p_partkey // 50) % 4 <> 2 GROUP BY 1, 2)
SELECT p.p_brand AS repo_id, 'S' || p_partkey AS symbol_id, p_name AS name, definition, path AS file_path, p_size AS line_number
FROM part p JOIN defined d ON d.repo_id = p.p_brand AND d.key = p.p_name JOIN files f ON f.file_id = 'f' || p_partkey""")
def build_glossary(spark, d):
    candidates = table(spark, d, "part").selectExpr(
        "concat('f', p_partkey) AS file_id", "concat('S', p_partkey) AS symbol_id", "p_name AS name", "p_size AS start_line"
    ).join(part_files(spark, d).select("repo_id", "file_id", "path"), "file_id")
    texts = _responses(spark, d, "named_struct('name', upper(p_name), 'definition', concat('def ', p_partkey))")
    return textgen.build_glossary(candidates, texts)


@C.query("attach_annotations", f"""{_TIERS}
SELECT repo_id, path, CASE WHEN (f.p_partkey // 50) % 4 <> 2 THEN 'read ' || p_name ELSE '' END AS annotation
FROM measured m JOIN tiers USING (repo_id, file_id) JOIN part f ON m.file_id = 'f' || f.p_partkey""")
def attach_annotations(spark, d):
    order = _reading(spark, d)[0]
    texts = _responses(
        spark, d,
        "named_struct('file_path', concat(lower(p_type), '/', replace(p_name, ' ', '_'), '_', p_partkey, '.py'), 'annotation', concat('read ', p_name))",
        repo="concat('r', p_partkey % 4)",
    )
    return textgen.attach_annotations(order, texts).select("repo_id", "path", "annotation")


@C.query("attach_narrative", """SELECT 'doc' || d.doc_id AS repo_id, coalesce(nullif(trim(d.text, ' ' || chr(10) || chr(9)), ''),
  'Architecture summary could not be generated.') AS narrative FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'doc' || d.doc_id, 'Architecture summary could not be generated.' FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def attach_narrative(spark, d):
    docs = table(spark, d, "documents")
    repos = docs.selectExpr("concat('doc', doc_id) AS repo_id", "CAST(NULL AS STRING) AS architecture_summary")
    answers = docs.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id").selectExpr("concat('doc', doc_id) AS repo_id", "text")
    return textgen.attach_narrative(repos, answers).selectExpr("repo_id", "architecture_summary AS narrative")


@C.query("module_symbols", f"""WITH {PART_FILES}, {PART_SYMBOLS}, ranked AS (
  SELECT repo_id, split_part(path, '/', 1) AS module, kind || ' ' || name || ' at ' || path || ':' || start_line AS line,
         row_number() OVER (PARTITION BY repo_id, split_part(path, '/', 1) ORDER BY path, start_line, symbol_id) AS rn
  FROM symbols JOIN files USING (repo_id, file_id) WHERE kind IN ('function', 'class', 'method'))
SELECT repo_id, module, string_agg(line, chr(10) ORDER BY rn) FILTER (rn <= 8) AS lines, count(*) AS n_symbols,
       greatest(count(*) - 8, 0) AS n_more FROM ranked GROUP BY 1, 2""")
def module_symbols(spark, d):
    return textgen.module_symbols(part_symbols(spark, d), part_files(spark, d)).withColumn("lines", F.array_join("lines", "\n"))


def _brief_parts(spark, d):
    # As in the ingest, what every section reads is materialised once.
    measured, symbols, _, edges = _measured(spark, d)
    edges = cut_lineage(edges)
    measured = e.fan_metrics(part_files(spark, d), edges)
    files = cut_lineage(rules.criticality(
        measured.selectExpr("*", "CAST(NULL AS TIMESTAMP) AS git_last_modified", "CAST(NULL AS BOOLEAN) AS has_tests",
                            "CAST(NULL AS DOUBLE) AS change_frequency"),
        "2001-12-01", False,
    ))
    listing = files.selectExpr("repo_id", "path", "CAST(NULL AS STRING) AS content")
    repos = files.select("repo_id").distinct().selectExpr("repo_id", "repo_id AS name", "'n/a' AS architecture_summary")
    entries = files.where("fan_in = 0").select("repo_id", "path")
    modules = e.module_edges(edges, files)
    steps = flow.trace_data_flow(rules.rank_entry_points(entries, flow.MAX_ENTRIES), files, edges)
    used = rules.detect_integrations(symbols, ("small", "hot", "cold"))
    return files, symbols, repos, rules.detect_stack(listing), entries, modules, steps, used


# The stack of a repository of parts follows from the suffixes of its files.
_PART_LANGUAGES = """list_filter(['Go', 'JavaScript', 'Python', 'TypeScript'], lambda x: list_contains(found, x))"""

_BRIEF_PROMPT = f"""WITH {PART_MEASURED}, rated AS (
  SELECT *, CASE WHEN fan_in >= 10 THEN 'critical' WHEN fan_in >= 5 THEN 'caution' ELSE 'safe' END AS criticality FROM measured),
head AS (
  SELECT repo_id, count(*) AS n, list(DISTINCT CASE split_part(path, '.', -1) WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' WHEN 'js' THEN 'JavaScript' ELSE 'Go' END) AS found
  FROM files GROUP BY 1),
entries AS (
  SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY path)::INT AS rk FROM rated WHERE fan_in = 0),
entry_line AS (
  SELECT repo_id, '{{"section":"entry_points","items":[' || string_agg('{{"path":"' || path || '"}}', ',' ORDER BY path) || ']}}' AS line FROM entries WHERE rk <= 8 GROUP BY 1),
key_line AS (
  SELECT repo_id, '{{"section":"key_modules","items":[' || string_agg('{{"path":"' || path || '","fan_in":' || fan_in || ',"criticality":"' || criticality || '"}}', ',' ORDER BY rk) || ']}}' AS line
  FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY fan_in DESC, path) AS rk FROM rated) WHERE rk <= 10 GROUP BY 1),
declared AS (
  SELECT s.repo_id, split_part(path, '/', 1) AS module, '"' || kind || ' ' || s.name || ' at ' || path || ':' || start_line || '"' AS line,
         row_number() OVER (PARTITION BY s.repo_id, split_part(path, '/', 1) ORDER BY path, start_line, symbol_id) AS rn
  FROM symbols s JOIN files USING (repo_id, file_id) WHERE kind IN ('function', 'class', 'method')),
module_item AS (
  SELECT repo_id, module, '{{"module":"' || module || '","lines":[' || string_agg(line, ',' ORDER BY rn) FILTER (rn <= 8) || '],"n_more":' || greatest(count(*) - 8, 0) || '}}' AS item
  FROM declared GROUP BY 1, 2),
module_line AS (SELECT repo_id, '{{"section":"modules","items":[' || string_agg(item, ',' ORDER BY module) || ']}}' AS line FROM module_item GROUP BY 1),
named AS (
  SELECT DISTINCT x.repo_id, s.path AS from_path, t.path AS to_path
  FROM edges x JOIN files s ON s.repo_id = x.repo_id AND s.file_id = src_file_id JOIN files t ON t.repo_id = x.repo_id AND t.file_id = tgt_file_id),
module_pair AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY a, b) AS rk FROM (
    SELECT DISTINCT repo_id, split_part(from_path, '/', 1) AS a, split_part(to_path, '/', 1) AS b FROM named) WHERE a <> b),
edge_line AS (
  SELECT repo_id, '{{"section":"module_edges","items":[' || string_agg('{{"src_module":"' || a || '","tgt_module":"' || b || '"}}', ',' ORDER BY rk) || ']}}' AS line
  FROM module_pair WHERE rk <= 20 GROUP BY 1),
used AS (SELECT DISTINCT repo_id, CASE WHEN lower(name) LIKE 'small%' THEN 'small' WHEN lower(name) LIKE 'hot%' THEN 'hot' ELSE 'cold' END AS name
  FROM symbols WHERE kind = 'import' AND (lower(name) LIKE 'small%' OR lower(name) LIKE 'hot%' OR lower(name) LIKE 'cold%')),
used_line AS (SELECT repo_id, '{{"section":"integrations","items":[' || string_agg('{{"integration":"' || name || '"}}', ',' ORDER BY name) || ']}}' AS line FROM used GROUP BY 1)
SELECT repo_id, concat_ws(chr(10), '{textgen.BRIEF_TASK}',
  '{{"section":"repository","name":"' || repo_id || '","files":' || n || ',"languages":' || to_json({_PART_LANGUAGES}) || ',"frameworks":[],"databases":[],"ci_cd":[]}}',
  e.line, k.line, m.line, g.line, u.line) AS prompt
FROM head LEFT JOIN entry_line e USING (repo_id) LEFT JOIN key_line k USING (repo_id) LEFT JOIN module_line m USING (repo_id)
LEFT JOIN edge_line g USING (repo_id) LEFT JOIN used_line u USING (repo_id)"""


@C.query("brief_requests", _BRIEF_PROMPT)
def brief_requests(spark, d):
    """One prompt per repository; the section of the data flow is left out here, it has a checked query of its own."""
    files, symbols, repos, stacks, entries, modules, steps, used = _brief_parts(spark, d)
    return textgen.brief_requests(
        repos, stacks, entries, stats.key_modules(files), textgen.module_symbols(symbols, files), modules, steps.limit(0), used,
        stats.file_totals(files),
    )


_BRIEF = f"""WITH {PART_MEASURED}, scored AS (
  SELECT *, CASE WHEN fan_in >= 10 THEN 3 WHEN fan_in >= 5 THEN 1 ELSE 0 END + 1 AS score FROM measured),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY fan_in DESC, path) AS rn FROM scored),
totals AS (
  SELECT repo_id, count(*) AS total_files, count(*) FILTER (score >= 2) AS n_critical_files, count(*) FILTER (fan_in = 0) AS n_entry_points,
         string_agg(path || ':' || fan_in, ',' ORDER BY rn) FILTER (rn <= 10) AS key_modules FROM ranked GROUP BY 1),
syms AS (SELECT repo_id, count(*) AS total_symbols FROM symbols GROUP BY 1),
pairs AS (
  SELECT DISTINCT x.repo_id, split_part(s.path, '/', 1) AS a, split_part(t.path, '/', 1) AS b
  FROM edges x JOIN files s ON s.repo_id = x.repo_id AND s.file_id = src_file_id
               JOIN files t ON t.repo_id = x.repo_id AND t.file_id = tgt_file_id WHERE a <> b),
edge_list AS (
  SELECT repo_id, string_agg(a || '>' || b, ',' ORDER BY a, b) AS module_edges FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY a, b) AS rn FROM pairs) WHERE rn <= 30 GROUP BY 1),
silo AS (
  SELECT repo_id, string_agg(file_id || ':' || CASE WHEN loc % 2 = 0 THEN 'x' ELSE 'y' END || ':' || coalesce(loc, 0) || ':' || (coalesce(loc, 0) = 1), ',' ORDER BY file_id) AS ownership
  FROM ranked WHERE rn <= 10 GROUP BY 1),
stack AS (
  SELECT repo_id, array_to_string({_PART_LANGUAGES}, ',') || '|||' AS tech_stack FROM (
    SELECT repo_id, list(DISTINCT CASE split_part(path, '.', -1) WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' WHEN 'js' THEN 'JavaScript' ELSE 'Go' END) AS found FROM files GROUP BY 1)),
used AS (SELECT DISTINCT repo_id, CASE WHEN lower(name) LIKE 'small%' THEN 'small' WHEN lower(name) LIKE 'hot%' THEN 'hot' ELSE 'cold' END AS name
  FROM symbols WHERE kind = 'import' AND (lower(name) LIKE 'small%' OR lower(name) LIKE 'hot%' OR lower(name) LIKE 'cold%')),
used_list AS (SELECT repo_id, string_agg(name, ',' ORDER BY name) AS external_integrations FROM used GROUP BY 1),
term_list AS (
  SELECT repo_id, string_agg(name || ':d:' || file_id, ',' ORDER BY name, symbol_id) AS glossary_preview FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY name, symbol_id) AS rn FROM symbols WHERE kind = 'class') WHERE rn <= 10 GROUP BY 1),
order_list AS (
  SELECT repo_id, string_agg(path || ':' || fan_in || ':' || fan_out || ':' || coalesce(language, '-') || ':0:' || rn || ':', ',' ORDER BY rn) AS reading_order_preview FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS rn FROM scored) WHERE rn <= 10 GROUP BY 1),
one_flow AS (
  SELECT repo_id, string_agg(path || '>' || path || ':' || rn, ',' ORDER BY rn) AS data_flow FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS rn FROM scored) WHERE rn <= 3 GROUP BY 1)
SELECT totals.*, total_symbols, module_edges, ownership, 'n/a' AS narrative, tech_stack, external_integrations, glossary_preview, reading_order_preview, data_flow
FROM totals JOIN syms USING (repo_id) JOIN stack USING (repo_id) JOIN order_list USING (repo_id) JOIN one_flow USING (repo_id)
LEFT JOIN edge_list USING (repo_id) LEFT JOIN silo USING (repo_id) LEFT JOIN used_list USING (repo_id) LEFT JOIN term_list USING (repo_id)"""


def _brief(spark, d):
    files, symbols, repos, stacks, entries, modules, steps, used = _brief_parts(spark, d)
    owners = files.selectExpr(
        "repo_id", "file_id", "IF(loc % 2 = 0, 'x', 'y') AS primary_owner", "coalesce(loc, 0) AS bus_factor", "coalesce(loc, 0) = 1 AS is_knowledge_silo")
    glossary = symbols.where("kind = 'class'").selectExpr("repo_id", "symbol_id", "name", "'d' AS definition", "file_id AS file_path")
    by_path = F.row_number().over(Window.partitionBy("repo_id").orderBy("path"))
    order = files.select("repo_id", "file_id", "path", "fan_in", "fan_out", "language", F.lit(0).alias("tier"), by_path.alias("position"), F.lit("").alias("annotation"))
    # The trace itself has a query of its own; here it is what the section shows of a given one.
    steps = order.where("position <= 3").selectExpr("repo_id", "position AS step", "path AS from_path", "path AS to_path", "position AS hop")
    return briefs.build_brief(repos, files, symbols, stacks, entries, modules, steps, used, owners, glossary, order)


def _shown_sections(*names):
    """Sections of a brief as texts."""

    def items(column, *fields, between=":"):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(between, *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields])), ",")

    made = {
        "key_modules": lambda: items("key_modules", "path", "fan_in"),
        "module_edges": lambda: items("module_edges", "from", "to", between=">"),
        "ownership": lambda: items("ownership_summary", "file_id", "primary_owner", "bus_factor", "is_knowledge_silo"),
        "tech_stack": lambda: F.concat_ws("|", *[F.array_join(F.col("tech_stack")[c], ",") for c in rules.STACK_CATEGORIES]),
        "external_integrations": lambda: F.array_join("external_integrations", ","),
        "glossary_preview": lambda: items("glossary_preview", "term", "definition", "file_path"),
        "reading_order_preview": lambda: items("reading_order_preview", "path", "fan_in", "fan_out", "language", "tier", "position", "annotation"),
        "data_flow": lambda: F.array_join(F.transform("data_flow", lambda x: F.concat(x["from"], F.lit(">"), x["to"], F.lit(":"), x["hop"].cast("string"))), ","),
    }
    return [made[n]().alias(n) for n in names]


@C.query("onboarding_brief", _BRIEF)
def onboarding_brief(spark, d):
    return _brief(spark, d).select(
        "repo_id", "total_files", "n_critical_files", "n_entry_points", "total_symbols", "narrative",
        *_shown_sections("key_modules", "module_edges", "ownership", "tech_stack", "external_integrations", "glossary_preview", "reading_order_preview", "data_flow"))


@C.query("guide_view", f"SELECT repo_id, external_integrations, data_flow, module_edges, key_modules, ownership FROM ({_BRIEF})")
def guide_view(spark, d):
    """What the guide shows of a brief."""
    return briefs.guide_view(_brief(spark, d)).select("repo_id", *_shown_sections("external_integrations", "data_flow", "module_edges", "key_modules", "ownership"))


@C.query("brief_lists", f"""WITH {PART_MEASURED}, scored AS (
  SELECT *, CASE WHEN fan_in >= 10 THEN 3 WHEN fan_in >= 5 THEN 1 ELSE 0 END + 1 AS score FROM measured)
SELECT repo_id, 'critical_files' AS section, path, row_number() OVER (PARTITION BY repo_id ORDER BY score < 4, fan_in DESC, path) AS position
FROM scored WHERE score >= 2
UNION ALL SELECT repo_id, 'entry_points', path, row_number() OVER (PARTITION BY repo_id ORDER BY path) FROM scored WHERE fan_in = 0""")
def brief_lists(spark, d):
    files, _, _, _, entries, _, _, _ = _brief_parts(spark, d)
    return briefs.brief_lists(files, entries).select("repo_id", "section", "path", "position")


@C.query("guide_reading_order", f"""{_TIERS}
SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY tier, fan_in DESC, path) AS position, path AS file_path, '' AS annotation, fan_in
FROM measured JOIN tiers USING (repo_id, file_id)""")
def guide_reading_order(spark, d):
    return briefs.guide_reading_order(_reading(spark, d)[0])


@C.query("repo_stats", f"""WITH {PART_MEASURED}
SELECT f.repo_id, count(*) AS total_files, coalesce(sum(loc), 0)::BIGINT AS total_loc,
       count(DISTINCT p_name) FILTER (p_size % 3 > 0) AS total_contributors,
       count(*) FILTER (p_size % 3 > 0 AND p_size % 2 = 0) AS knowledge_silo_count, any_value(n) AS total_dependencies
FROM measured f JOIN part ON 'f' || p_partkey = f.file_id
JOIN (SELECT repo_id, count(*) AS n FROM deps GROUP BY 1) x USING (repo_id) GROUP BY 1""")
def repo_stats(spark, d):
    files, symbols, deps, _ = _measured(spark, d)
    owners = table(spark, d, "part").where("p_size % 3 > 0").selectExpr(
        "p_brand AS repo_id", "concat('f', p_partkey) AS file_id", "p_name AS primary_owner", "p_size % 2 = 0 AS is_knowledge_silo"
    )
    return stats.repo_stats(files, owners, deps, symbols)


# --- merges ------------------------------------------------------------------------

_LINE_KEYS = ["l_orderkey", "l_linenumber"]
_LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]


@C.query("insert_ignore", """WITH survivors AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM survivors
WHERE rn = 1 AND l_linenumber <> 1""")
def insert_ignore(spark, d):
    line = table(spark, d, "lineitem")
    stored = line.where("l_linenumber = 1").select(*_LINE_KEYS).distinct()
    new = line.select(*_LINE_COLUMNS, "l_shipdate")
    return writes.insert_ignore(stored, new, _LINE_KEYS, ["l_shipdate", "l_partkey", "l_suppkey"]).drop("l_shipdate")


def _owner_tables(spark, d):
    orders = table(spark, d, "orders")
    old = orders.where("o_orderkey % 3 > 0").selectExpr(
        "o_orderpriority AS repo_id", "o_orderkey AS file_id", "o_orderstatus AS primary_owner", "1 AS bus_factor"
    )
    new = orders.where("o_orderkey % 3 < 2").selectExpr(
        "o_orderpriority AS repo_id", "o_orderkey AS file_id", "concat('c', o_custkey) AS primary_owner", "CAST(o_custkey % 9 AS INT) AS bus_factor"
    )
    return old, new


@C.query("upsert", """SELECT o_orderpriority AS repo_id, o_orderkey AS file_id,
  CASE WHEN o_orderkey % 3 < 2 THEN 'c' || o_custkey ELSE o_orderstatus END AS primary_owner,
  CASE WHEN o_orderkey % 3 < 2 THEN (o_custkey % 9)::INT ELSE 1 END AS bus_factor FROM orders""")
def upsert(spark, d):
    return writes.upsert(*_owner_tables(spark, d), ["repo_id", "file_id"])


@C.query("upsert_keeping_bus_factor", """SELECT o_orderpriority AS repo_id, o_orderkey AS file_id,
  CASE WHEN o_orderkey % 3 < 2 THEN 'c' || o_custkey ELSE o_orderstatus END AS primary_owner,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey % 9)::INT ELSE 1 END AS bus_factor FROM orders""")
def upsert_keeping_bus_factor(spark, d):
    return writes.upsert(*_owner_tables(spark, d), ["repo_id", "file_id"], ["primary_owner"])


def _stored_folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"


_OWNER_DDL = "repo_id string, file_id bigint, primary_owner string, bus_factor int"


@C.query("stored_upsert", """SELECT o_orderpriority AS repo_id, o_orderkey AS file_id,
  CASE WHEN o_orderkey % 3 < 2 THEN 'c' || o_custkey ELSE o_orderstatus END AS primary_owner,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey % 9)::INT ELSE 1 END AS bus_factor FROM orders""")
def stored_upsert(spark, d):
    """Written, merged and read back; the repeated batch is known by its token."""
    path, (old, new) = _stored_folder(spark), _owner_tables(spark, d)
    writes.write_table(old, path)
    for _ in range(2):
        writes.store_upsert(spark, path, _OWNER_DDL, new, ["repo_id", "file_id"], ["primary_owner"], token="batch 1")
    return writes.read_table(spark, path, _OWNER_DDL)


_PART_DDL = "repo_id string, p_partkey bigint, state string"


@C.query("stored_replace", """SELECT p_brand AS repo_id, p_partkey, 'old' AS state FROM part WHERE p_brand NOT LIKE '%1%'
UNION ALL SELECT p_brand, p_partkey, 'new' FROM part WHERE p_brand LIKE '%1%' AND p_size > 25""")
def stored_replace(spark, d):
    part, path = table(spark, d, "part"), _stored_folder(spark)
    writes.write_table(part.selectExpr("p_brand AS repo_id", "CAST(p_partkey AS BIGINT) AS p_partkey", "'old' AS state"), path)
    new = part.where("p_brand LIKE '%1%' AND p_size > 25").selectExpr("p_brand AS repo_id", "CAST(p_partkey AS BIGINT) AS p_partkey", "'new' AS state")
    writes.replace_partition(spark, path, _PART_DDL, new, _brands(spark, d))
    return writes.read_table(spark, path, _PART_DDL)


@C.query("stored_delete", """SELECT 'doc' || d.doc_id AS repo_id, t.table_name FROM documents d, (VALUES ('commits'), ('files'), ('guides'), ('repositories')) t(table_name)
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def stored_delete(spark, d):
    """Repositories deleted from all twelve stored tables; four of them hold rows."""
    folder = _stored_folder(spark)
    docs = table(spark, d, "documents").selectExpr("concat('doc', doc_id) AS repo_id", "text", "source")
    writes.clear_tables(spark, folder, buckets=16)
    filled = {"repositories": {"architecture_summary": "text"}, "files": {"path": "source"}, "commits": {"message": "text"}, "guides": {"architecture_narrative": "text"}}
    for name, columns in filled.items():
        empty = spark.createDataFrame([], schemas.TABLES[name])
        value = lambda f: F.col("repo_id") if f.name == "repo_id" else F.col(columns[f.name]) if f.name in columns else F.lit(None).cast(f.dataType)  # noqa: B023, E731
        writes.write_table(docs.select(*[value(f).alias(f.name) for f in empty.schema]), f"{folder}/{name}", "append")
    writes.delete_repositories(spark, folder, table(spark, d, "labels").selectExpr("concat('doc', doc_id) AS repo_id"))
    left = [df.select("repo_id", F.lit(name).alias("table_name")) for name, df in writes.load_tables(spark, folder).items()]
    out = left[0]
    for more in left[1:]:
        out = out.unionByName(more)
    return out


@C.query("stored_guides", """SELECT 'doc' || d.doc_id AS repo_id, coalesce(CASE WHEN l.quality = 1 THEN 'quality ' || d.lang END, d.text) AS architecture_narrative,
  CASE WHEN l.doc_id IS NULL THEN 'm_' || d.source ELSE 'n_' || l.toxic END AS module, CASE WHEN l.doc_id IS NULL THEN d.n_chars ELSE l.toxic END::INT AS fan_in
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def stored_guides(spark, d):
    """Guides stored, then updated; a null narrative leaves the old one."""
    path = f"{_stored_folder(spark)}/guides"

    def guides(rows, narrative, module, fan_in):
        made = rows.select(F.concat(F.lit("doc"), "doc_id").alias("repo_id"), narrative.alias("architecture_narrative"),
                           F.array(F.struct(module.alias("path"), fan_in.cast("int").alias("fan_in"))).alias("key_modules"))
        columns = spark.createDataFrame([], schemas.GUIDES).schema
        return made.select(*[F.col(f.name) if f.name in made.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in columns])

    docs = table(spark, d, "documents")
    writes.write_table(guides(docs, F.col("text"), F.concat(F.lit("m_"), "source"), F.col("n_chars")), path)
    marked = table(spark, d, "labels").join(docs.select("doc_id", "lang"), "doc_id")
    narrative = F.when(F.col("quality") == 1, F.concat(F.lit("quality "), "lang"))
    new = guides(marked, narrative, F.concat(F.lit("n_"), F.col("toxic").cast("string")), F.col("toxic"))
    writes.store_upsert(spark, path, schemas.GUIDES, new, ["repo_id"], ["architecture_narrative", "key_modules"], keep_when_null=True)
    return writes.read_table(spark, path, schemas.GUIDES).select(
        "repo_id", "architecture_narrative", F.col("key_modules")[0]["path"].alias("module"), F.col("key_modules")[0]["fan_in"].alias("fan_in"))


@C.query("upsert_guides", """SELECT 'doc' || d.doc_id AS repo_id, d.text AS reading_order,
  coalesce(CASE WHEN l.quality = 1 THEN 'crit' END, d.source) AS critical_files FROM documents d LEFT JOIN labels l USING (doc_id)""")
def upsert_guides(spark, d):
    docs = table(spark, d, "documents").selectExpr("concat('doc', doc_id) AS repo_id", "text AS reading_order", "source AS critical_files")
    new = table(spark, d, "labels").selectExpr(
        "concat('doc', doc_id) AS repo_id", "CAST(NULL AS STRING) AS reading_order", "IF(quality = 1, 'crit', NULL) AS critical_files"
    )
    return writes.upsert_guides(docs, new, ["critical_files"])


def _brands(spark, d):
    return table(spark, d, "part").where("p_brand LIKE '%1%'").selectExpr("p_brand AS repo_id").distinct()


@C.query("replace_rows", """SELECT p_brand AS repo_id, p_partkey, 'old' AS state FROM part WHERE p_brand NOT LIKE '%1%'
UNION ALL SELECT p_brand, p_partkey, 'new' FROM part WHERE p_brand LIKE '%1%' AND p_size > 25""")
def replace_rows(spark, d):
    part = table(spark, d, "part")
    old = part.selectExpr("p_brand AS repo_id", "p_partkey", "'old' AS state")
    new = part.where("p_brand LIKE '%1%' AND p_size > 25").selectExpr("p_brand AS repo_id", "p_partkey", "'new' AS state")
    return writes.replace_rows(old, new, _brands(spark, d))


@C.query("delete_cascade", f"""WITH {PART_SYMBOLS}
SELECT 'files' AS table_name, p_brand AS repo_id, count(*) AS n FROM part WHERE p_brand NOT LIKE '%1%' GROUP BY 2
UNION ALL SELECT 'symbols', repo_id, count(*) FROM symbols WHERE repo_id NOT LIKE '%1%' GROUP BY 2""")
def delete_cascade(spark, d):
    kept = writes.delete_cascade({"files": part_files(spark, d), "symbols": part_symbols(spark, d)}, _brands(spark, d))
    counts = [
        df.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).withColumn("table_name", F.lit(name)) for name, df in kept.items()
    ]
    return counts[0].unionByName(counts[1])


@C.query("reset_for_reingest", """SELECT 'doc' || doc_id AS repo_id,
  CASE WHEN doc_id % 4 IN (0, 1) AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 'pending'
       ELSE ['ready', 'failed', 'parsing', 'cloning'][doc_id % 4 + 1] END AS status,
  CASE WHEN doc_id % 4 IN (0, 1) AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN NULL ELSE text END AS architecture_summary
FROM documents d""")
def reset_for_reingest(spark, d):
    repos = table(spark, d, "documents").selectExpr(
        "concat('doc', doc_id) AS repo_id", "element_at(array('ready', 'failed', 'parsing', 'cloning'), CAST(doc_id % 4 + 1 AS INT)) AS status",
        "text AS architecture_summary", "CAST(NULL AS STRING) AS detected_stack", "CAST(NULL AS STRING) AS entry_points",
    )
    wanted = table(spark, d, "labels").selectExpr("concat('doc', doc_id) AS repo_id")
    return writes.reset_for_reingest(repos, wanted).select("repo_id", "status", "architecture_summary")
