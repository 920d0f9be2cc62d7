"""Criticality, stack, entry-point and integration rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Catalog, table
from catalog.corpora import PART_MEASURED, part_files, part_symbols
from stratacode.operators import edges as e
from stratacode.operators import rules, stats
from stratacode.plans import brief as briefs

C = Catalog()

AS_OF = "2001-12-01 00:00:00"

# File names with core patterns: the last word of the part name decides.
_CORE_SPARK = (
    "concat(path, CASE WHEN p_name LIKE '%ring' THEN '/domain.py' WHEN p_name LIKE '%rod' THEN '/auth.ts' "
    "WHEN p_name LIKE '%gear' THEN '/middleware/x.py' WHEN p_name LIKE '%bolt' THEN '/configs.py' ELSE '/x.py' END)"
)


def _aged(spark, d):
    symbols = part_symbols(spark, d)
    files = part_files(spark, d)
    edges = e.import_edges(e.resolve_imports(files, symbols))
    names = table(spark, d, "part").selectExpr("concat('f', p_partkey) AS file_id", "p_name", "p_brand AS repo_id")
    last = table(spark, d, "lineitem").groupBy(F.expr("concat('f', l_partkey)").alias("file_id")).agg(
        F.max(F.col("l_shipdate").cast("timestamp")).alias("git_last_modified")
    )
    return (
        e.fan_metrics(files, edges).join(names, ["repo_id", "file_id"])
        .join(last, "file_id", "left")
        .withColumn("path", F.expr(_CORE_SPARK))
        .withColumn("has_tests", F.expr("CASE WHEN loc % 3 = 0 THEN true WHEN loc % 3 = 1 THEN false END"))
    )


_AGED = f"""WITH {PART_MEASURED}, aged AS (
  SELECT m.repo_id, m.file_id, m.fan_in,
         m.path || CASE WHEN p_name LIKE '%ring' THEN '/domain.py' WHEN p_name LIKE '%rod' THEN '/auth.ts'
                        WHEN p_name LIKE '%gear' THEN '/middleware/x.py' WHEN p_name LIKE '%bolt' THEN '/configs.py' ELSE '/x.py' END AS path,
         last AS git_last_modified, loc % 3 = 0 AS has_tests
  FROM measured m JOIN part ON 'f' || p_partkey = m.file_id
  LEFT JOIN (SELECT 'f' || l_partkey AS file_id, max(l_shipdate) AS last FROM lineitem GROUP BY 1) USING (file_id)),
flags AS (
  SELECT *, regexp_matches(path, 'config\\.|database\\.|middleware/|migrations/|auth\\.|security\\.|celery\\.|main\\.') AS core,
         coalesce(floor(epoch(TIMESTAMP '{AS_OF}' - git_last_modified) / 86400) > 180, false) AS stale,
         NOT coalesce(has_tests, false) AS untested FROM aged),
scored AS (
  SELECT *, CASE WHEN fan_in >= 10 THEN 3 WHEN fan_in >= 5 THEN 1 ELSE 0 END + 2 * core::INT + stale::INT + untested::INT AS score
  FROM flags),
judged AS (
  SELECT *, CASE WHEN score >= 4 THEN 'critical' WHEN score >= 2 THEN 'caution' ELSE 'safe' END AS criticality,
         concat_ws('; ', CASE WHEN fan_in >= 5 THEN 'imported by ' || fan_in || ' files' END,
                   CASE WHEN core THEN 'core infrastructure file' END, CASE WHEN stale THEN 'untouched for 6+ months' END,
                   CASE WHEN untested THEN 'no test coverage' END) AS reasons FROM scored)"""


def _judged(spark, d, git_aware=True):
    return rules.criticality(_aged(spark, d), AS_OF, git_aware)


@C.query("criticality", f"{_AGED} SELECT repo_id, file_id, path, criticality, reasons FROM judged")
def criticality(spark, d):
    return _judged(spark, d).select(
        "repo_id", "file_id", "path", "criticality", F.array_join("criticality_reasons", "; ").alias("reasons")
    )


@C.query("criticality_without_history", f"""{_AGED}
SELECT repo_id, file_id, CASE WHEN score - stale::INT - untested::INT + 1 >= 4 THEN 'critical'
       WHEN score - stale::INT - untested::INT + 1 >= 2 THEN 'caution' ELSE 'safe' END AS criticality FROM judged""")
def criticality_without_history(spark, d):
    return _judged(spark, d, git_aware=False).select("repo_id", "file_id", "criticality")


@C.query("critical_files", f"""{_AGED}
SELECT repo_id, path, criticality, reasons, fan_in, coalesce(has_tests, false) AS has_tests FROM judged
WHERE criticality IN ('critical', 'caution')""")
def critical_files(spark, d):
    files = _judged(spark, d).withColumn("change_frequency", F.lit(None).cast("double"))
    return stats.critical_files(files).drop("change_frequency").withColumn("reasons", F.array_join("reasons", "; "))


@C.query("guide_critical_files", f"""{_AGED}
SELECT repo_id, path AS file_path, criticality, fan_in, CASE criticality WHEN 'critical' THEN 0 ELSE 1 END AS severity
FROM judged WHERE criticality IN ('critical', 'caution')""")
def guide_critical_files(spark, d):
    files = _judged(spark, d).withColumn("change_frequency", F.lit(None).cast("double"))
    return briefs.guide_critical_files(files).select(
        "repo_id", "file_path", "criticality", "fan_in", stats.severity_rank(F.col("criticality")).alias("severity")
    )


@C.query("critical_file_previews", f"""{_AGED}
SELECT repo_id, path, preview_pos FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY criticality = 'caution', fan_in DESC, path)::INT AS preview_pos
  FROM judged WHERE criticality IN ('critical', 'caution')) WHERE preview_pos <= 8""")
def critical_file_previews(spark, d):
    rows = stats.critical_only(_judged(spark, d)).select("repo_id", "path", "fan_in", "criticality")
    order = [stats.severity_rank(F.col("criticality")), F.desc("fan_in"), "path"]
    return stats.preview_rows(rows, ["repo_id"], order, 8).select("repo_id", "path", "preview_pos")


@C.query("key_modules", f"""WITH {PART_MEASURED}
SELECT repo_id, file_id, path, fan_in, fan_out, language, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY fan_in DESC, path)::INT AS rank FROM measured) WHERE rank <= 10""")
def key_modules(spark, d):
    files, symbols = part_files(spark, d), part_symbols(spark, d)
    edges = e.import_edges(e.resolve_imports(files, symbols))
    measured = e.fan_metrics(files, edges).withColumn("criticality", F.lit(None).cast("string"))
    return stats.key_modules(measured).drop("criticality")


# Page hosts as repositories, page addresses as paths, page text as content.
_SITE_FILES = """site AS (
  SELECT page_id, 'site' || (page_id % 9) AS repo_id, html AS content,
         CASE page_id % 12 WHEN 0 THEN 'package.json' WHEN 1 THEN 'src/news.py' WHEN 2 THEN 'app/page.tsx' WHEN 3 THEN 'manage.py'
              WHEN 4 THEN 'node_modules/x/index.js' WHEN 5 THEN 'apps/web/server.ts' WHEN 6 THEN 'packages/ui/Socket.TSX'
              WHEN 7 THEN '.github/workflows/ci.yml' WHEN 8 THEN 'src/index.ts' WHEN 9 THEN 'Dockerfile'
              WHEN 10 THEN 'prisma/schema.rs' ELSE 'lib/util.go' END AS path
  FROM pages)"""


def _site(spark, d):
    return table(spark, d, "pages").selectExpr(
        "concat('site', page_id % 9) AS repo_id", "html AS content",
        "CASE page_id % 12 WHEN 0 THEN 'package.json' WHEN 1 THEN 'src/news.py' WHEN 2 THEN 'app/page.tsx' WHEN 3 THEN 'manage.py' "
        "WHEN 4 THEN 'node_modules/x/index.js' WHEN 5 THEN 'apps/web/server.ts' WHEN 6 THEN 'packages/ui/Socket.TSX' "
        "WHEN 7 THEN '.github/workflows/ci.yml' WHEN 8 THEN 'src/index.ts' WHEN 9 THEN 'Dockerfile' "
        "WHEN 10 THEN 'prisma/schema.rs' ELSE 'lib/util.go' END AS path",
    )


_STACK_LABELS = f"""WITH {_SITE_FILES}, hits AS (
  SELECT repo_id, unnest(CASE
    WHEN path = 'src/news.py' THEN ['languages:Python', 'frameworks:WebSockets', 'frameworks:Real-time System']
    WHEN path = 'app/page.tsx' THEN ['languages:TypeScript']
    WHEN path = 'manage.py' THEN ['languages:Python', 'frameworks:Django']
    WHEN path = 'apps/web/server.ts' THEN ['languages:TypeScript']
    WHEN path = 'packages/ui/Socket.TSX' THEN ['frameworks:WebSockets', 'frameworks:Real-time System']
    WHEN path = '.github/workflows/ci.yml' THEN ['frameworks:WebSockets', 'frameworks:Real-time System', 'ci_cd:GitHub Actions']
    WHEN path = 'src/index.ts' THEN ['languages:TypeScript']
    WHEN path = 'Dockerfile' THEN ['ci_cd:Docker']
    WHEN path = 'prisma/schema.rs' THEN ['languages:Rust', 'frameworks:Prisma ORM', 'databases:PostgreSQL']
    WHEN path = 'lib/util.go' THEN ['languages:Go'] ELSE [] END) AS hit FROM site
  UNION ALL
  SELECT repo_id, unnest(list_filter(['frameworks:FastAPI', 'frameworks:Django', 'frameworks:Flask', 'databases:SQLAlchemy', 'databases:MongoDB', 'databases:Redis'],
         lambda x: contains(lower(content), lower(split_part(replace(x, 'MongoDB', 'pymongo'), ':', 2))))) FROM site WHERE path IN ('src/news.py', 'manage.py')
  UNION ALL
  SELECT repo_id, 'frameworks:Monorepo' FROM site GROUP BY 1 HAVING bool_or(path LIKE 'apps/%') AND bool_or(path LIKE 'packages/%'))
SELECT DISTINCT repo_id, split_part(hit, ':', 1) AS category, split_part(hit, ':', 2) AS label FROM hits"""


@C.query("stack_labels", _STACK_LABELS)
def stack_labels(spark, d):
    return rules.stack_labels(_site(spark, d))


_SETS = ", ".join(
    f"coalesce(string_agg(label, ',' ORDER BY label) FILTER (category = '{c}'), '') AS {c}" for c in rules.STACK_CATEGORIES
)


@C.query("detect_stack", f"SELECT repo_id, {_SETS} FROM ({_STACK_LABELS}) GROUP BY 1")
def detect_stack(spark, d):
    stacks = rules.detect_stack(_site(spark, d))
    return stacks.select("repo_id", *[F.array_join(c, ",").alias(c) for c in rules.STACK_CATEGORIES])


@C.query("entry_points", f"""WITH {_SITE_FILES}
SELECT DISTINCT repo_id, path FROM site
WHERE path IN ('app/page.tsx', 'manage.py', 'apps/web/server.ts', 'Dockerfile')
   OR (path IN ('src/news.py', 'src/index.ts', 'prisma/schema.rs', 'lib/util.go') AND (
       contains(lower(content), 'if __name__ == "__main__"') OR contains(lower(content), 'uvicorn.run')
       OR contains(lower(content), 'fastapi(') OR contains(lower(content), 'app.listen') OR contains(lower(content), 'express()')
       OR contains(lower(content), 'func main()') OR contains(lower(content), 'fn main()')
       OR contains(lower(content), 'public static void main') OR contains(lower(content), 'webapplication.createbuilder')))""")
def entry_points(spark, d):
    return rules.detect_entry_points(_site(spark, d))


@C.query("integrations", """SELECT DISTINCT p_brand AS repo_id,
  CASE WHEN lower(p_name) LIKE 'small r%' THEN 'small r' WHEN lower(p_name) LIKE 'small%' THEN 'small'
       WHEN lower(p_name) LIKE 'cold.%' THEN 'cold' ELSE 'hot' END AS integration
FROM part WHERE p_size % 2 = 0 AND (lower(p_name) LIKE 'small%' OR lower(p_name) LIKE 'hot%' OR lower(p_name) LIKE 'cold.%')""")
def integrations(spark, d):
    imports = table(spark, d, "part").selectExpr(
        "p_brand AS repo_id", "upper(p_name) AS name", "IF(p_size % 2 = 0, 'import', 'class') AS kind"
    )
    return rules.detect_integrations(imports, ("small r", "small", "cold.ring", "hot"))


# --- every rule with a file that it hits and one that it just misses ----------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _samples():
    """(path, content) pairs: for every stack rule a hit and a near miss."""
    out = []
    for i, (scope, needle, _, _) in enumerate(rules.STACK_RULES):
        name, _, word = needle.partition("|")
        field = "dependencies" if i % 2 else "devDependencies"
        out += {
            "suffix": [(f"m/a{needle}", ""), (f"m/a{needle}x", "")],
            "package_dep": [("w/package.json", f'{{"{field}": {{"{needle}": "1"}}}}'),
                            ("w/package.json", f'{{"peerDependencies": {{"{needle}": "1"}}, "dependencies": {{"{needle}-x": "1"}}}}')],
            "py_text": [("t.py", f"IMPORT {needle.upper()}"), ("t.txt", needle)],
            "name_text": [(f"sub/{name.upper()}", f"<x {word.upper()}>"), (f"sub/{name}.bak", word)],
            "root_text": [(name, f"needs {word.upper()}"), (f"sub/{name}", word)],
            "composer": [("composer.json", f'{{"require": {{"{needle}": "1"}}}}'), ("composer.json", f'{{"require": {{"{needle}-x": "1"}}}}')],
            "composer_any": [("composer.json", f'{{"require": {{"{needle}/x": "1"}}}}'), ("composer.json", f'{{"require-dev": {{"{needle}/x": "1"}}}}')],
            "root_file": [(needle, "x"), (f"sub/{needle}", "x")],
            "root_dir": [(f"{needle}/x.txt", "x"), (f"{needle}s/x.txt", "x")],
            "segment": [(f"mod{needle.upper()}x/a.txt", "x"), (f"node_modules/{needle}/a.txt", "x")],
            "path": [(f"a/{needle}z/b.txt", "x"), (f"node_modules/{needle}/b.txt", "x")],
        }[scope]
    for needle in rules.ENTRY_NAMES + rules.ENTRY_MANIFESTS:
        out += [(f"sub/{needle.upper()}", "x"), (f"sub/a{needle}", "x"), (f"node_modules/{needle}", "x")]
    for needle in rules.ENTRY_SCRIPT_NAMES:
        out += [(f"lib/{needle}", "x"), (f"src/{needle}", "x"), (f"src/api/{needle}", "x")]
    for folder, name in (("src", "app.tsx"), ("src", "app.jsx"), ("app", "page.tsx"), ("app", "page.jsx"), ("pages", "index.tsx"), ("pages", "index.jsx")):
        out += [(f"{folder}/{name}", "x"), (f"other/{name}", "x")]
    for marker in rules.ENTRY_MARKERS:
        out += [(f"m{suffix}", f"a\n{marker.upper()} b") for suffix in rules.ENTRY_TEXT_SUFFIXES]
        out += [("m.txt", marker), ("m.py", marker[:-1])]
    return out


_SAMPLES = _samples()
# Repositories of one file each, and one in seven with the two folders of a monorepo, or with one of them only.
_MONO = ("apps/a.txt", "packages/b.txt")


def _sampled(spark, d):
    n = len(_SAMPLES)
    samples = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(_SAMPLES)], "sample int, path string, content string")
    repos = table(spark, d, "part").selectExpr("concat('repo', p_partkey) AS repo_id", f"CAST(p_partkey % {n} AS INT) AS sample", "p_partkey")
    extra = [repos.where(f"p_partkey % 7 < {k}").selectExpr("repo_id", f"'{p}' AS path", "CAST(NULL AS STRING) AS content") for k, p in zip((1, 2), _MONO)]
    return repos.join(samples, "sample").select("repo_id", "path", "content").unionByName(extra[0]).unionByName(extra[1])


_SAMPLED_SQL = f"""samples(sample, path, content) AS (VALUES {", ".join(f"({i}, {_quoted(p)}, {_quoted(c)})" for i, (p, c) in enumerate(_SAMPLES))}),
sampled AS (
  SELECT 'repo' || p_partkey AS repo_id, path, content FROM part JOIN samples ON sample = p_partkey % {len(_SAMPLES)}
  UNION ALL SELECT 'repo' || p_partkey, '{_MONO[0]}', NULL FROM part WHERE p_partkey % 7 < 1
  UNION ALL SELECT 'repo' || p_partkey, '{_MONO[1]}', NULL FROM part WHERE p_partkey % 7 < 2),
cut AS (
  SELECT *, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS name, coalesce(lower(content), '') AS body,
         list_position(list_transform(string_split(path, '/'), lambda x: x IN ({", ".join(_quoted(x) for x in sorted(rules.SKIP_DIRS))})), true) AS skip FROM sampled),
seen AS (
  SELECT *, coalesce(skip, 0) = 0 AS visible, regexp_extract(name, '[^.](\\.[^.]*)$', 1) AS suffix,
         list_transform(CASE WHEN coalesce(skip, 0) = 0 THEN parts ELSE parts[1:skip - 1] END, lambda x: lower(x)) AS low,
         CASE WHEN name IN ('package.json', 'composer.json') AND json_valid(content) THEN content ELSE '{{}}' END AS json FROM cut)"""

_STACK_SQL = f"""WITH {_SAMPLED_SQL},
rule(scope, needle, category, label) AS (VALUES {", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rules.STACK_RULES)}),
hits AS (
  SELECT repo_id, category, label FROM seen CROSS JOIN rule WHERE CASE scope
    WHEN 'suffix' THEN visible AND suffix = needle
    WHEN 'package_dep' THEN visible AND name = 'package.json' AND
      (coalesce(list_contains(json_keys(json, '$.dependencies'), needle), false) OR coalesce(list_contains(json_keys(json, '$.devDependencies'), needle), false))
    WHEN 'py_text' THEN visible AND suffix = '.py' AND contains(body, needle)
    WHEN 'name_text' THEN visible AND lower(name) = split_part(needle, '|', 1) AND contains(body, split_part(needle, '|', 2))
    WHEN 'root_text' THEN path = split_part(needle, '|', 1) AND contains(body, split_part(needle, '|', 2))
    WHEN 'composer' THEN path = 'composer.json' AND coalesce(list_contains(json_keys(json, '$.require'), needle), false)
    WHEN 'composer_any' THEN path = 'composer.json' AND coalesce(contains((json->'$.require')::VARCHAR, needle), false)
    WHEN 'root_file' THEN path = needle
    WHEN 'root_dir' THEN starts_with(path, needle || '/')
    WHEN 'segment' THEN len(list_filter(low, lambda x: contains(x, needle))) > 0
    ELSE contains(array_to_string(low, '/'), needle) END
  UNION ALL
  SELECT repo_id, 'frameworks', 'Monorepo' FROM sampled GROUP BY 1 HAVING bool_or(starts_with(path, 'apps/')) AND bool_or(starts_with(path, 'packages/')))
SELECT DISTINCT repo_id, category, label FROM hits"""


@C.query("stack_rules", _STACK_SQL)
def stack_rules(spark, d):
    """Labels of repositories among which every stack rule hits and just misses."""
    return rules.stack_labels(_sampled(spark, d))


def _names(names) -> str:
    return ", ".join(map(_quoted, names))


@C.query("entry_rules", f"""WITH {_SAMPLED_SQL}
SELECT DISTINCT repo_id, path FROM seen WHERE visible AND (
  lower(name) IN ({_names(rules.ENTRY_NAMES + rules.ENTRY_MANIFESTS)})
  OR (lower(name) IN ({_names(rules.ENTRY_SCRIPT_NAMES)}) AND (NOT contains(path, 'src') OR contains(path, 'server') OR contains(path, 'api')))
  OR (lower(name) IN ('app.tsx', 'app.jsx') AND contains(path, 'src')) OR (lower(name) IN ('page.tsx', 'page.jsx') AND contains(path, 'app'))
  OR (lower(name) IN ('index.tsx', 'index.jsx') AND contains(path, 'pages'))
  OR (suffix IN ({_names(rules.ENTRY_TEXT_SUFFIXES)}) AND ({" OR ".join(f"contains(body, {_quoted(m)})" for m in rules.ENTRY_MARKERS)})))""")
def entry_rules(spark, d):
    """Entry points among files that every name and every marker hits and just misses."""
    return rules.detect_entry_points(_sampled(spark, d))


_PREFIXES = ", ".join(f"({i}, {_quoted(p)})" for i, p in enumerate(rules.INTEGRATION_PREFIXES))


@C.query("integration_rules", f"""WITH prefix(no, prefix) AS (VALUES {_PREFIXES}),
imported AS (
  SELECT 'repo' || p_size AS repo_id, CASE p_partkey % 3 WHEN 0 THEN upper(prefix) || '.x' WHEN 1 THEN 'x' || prefix ELSE left(prefix, length(prefix) - 1) END AS name
  FROM part JOIN prefix ON no = p_partkey % {len(rules.INTEGRATION_PREFIXES)} WHERE p_partkey % 5 > 0),
first AS (SELECT i.repo_id, i.name, arg_min(prefix, no) AS hit FROM imported i JOIN prefix ON starts_with(lower(i.name), prefix) GROUP BY 1, 2)
SELECT DISTINCT repo_id, split_part(hit, '.', 1) AS integration FROM first""")
def integration_rules(spark, d):
    """All prefixes of the rule list: names that begin with one, hold one elsewhere, or lack its last letter."""
    prefixes = spark.createDataFrame(list(enumerate(rules.INTEGRATION_PREFIXES)), "no int, prefix string")
    part = table(spark, d, "part").selectExpr("concat('repo', p_size) AS repo_id", "p_partkey", f"CAST(p_partkey % {len(rules.INTEGRATION_PREFIXES)} AS INT) AS no")
    imported = part.join(prefixes, "no").selectExpr(
        "repo_id", "CASE p_partkey % 3 WHEN 0 THEN concat(upper(prefix), '.x') WHEN 1 THEN concat('x', prefix) ELSE left(prefix, length(prefix) - 1) END AS name",
        "IF(p_partkey % 5 > 0, 'import', 'class') AS kind")
    return rules.detect_integrations(imported)
