"""Ownership, statistics and list queries on the order corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Catalog, table
from catalog.corpora import (
    AUTHOR_STATS, LOG_ORDER, ORDER_FILES, ORDER_OWNED, ORDER_TOUCHES, order_files, order_touches,
)
from stratacode.operators import ownership as own
from stratacode.operators import stats
from stratacode.operators.tests_lookup import detect_tests
from stratacode.session import cut_lineage

C = Catalog()

_DAY = "yyyy-MM-dd HH:mm:ss"
_SQL_DAY = "'%Y-%m-%d %H:%M:%S'"


def _owned(spark, d):
    return own.file_ownership(order_touches(spark, d), LOG_ORDER)


def _owners(spark, d):
    files = order_files(spark, d)
    return own.code_owners(_owned(spark, d), files), files


def _flat(contributors):
    return F.array_join(
        F.transform(contributors, lambda c: F.concat_ws(
            "|", c["email"], c["name"], c["commit_count"].cast("string"), c["percentage"].cast("string"), c["last_commit"]
        )), ";")


@C.query("file_ownership", f"""WITH {ORDER_OWNED}
SELECT repo_id, path, change_frequency, strftime(git_last_modified, {_SQL_DAY}) AS last_modified, primary_owner,
       contributors, bus_factor, is_knowledge_silo FROM ownership""")
def file_ownership(spark, d):
    return _owned(spark, d).select(
        "repo_id", "path", "change_frequency", F.date_format("git_last_modified", _DAY).alias("last_modified"),
        "primary_owner", _flat("contributors").alias("contributors"), "bus_factor", "is_knowledge_silo",
    )


@C.query("author_stats", f"""WITH {ORDER_TOUCHES},
{AUTHOR_STATS}
SELECT repo_id, path, email, commit_count, strftime(last_commit, {_SQL_DAY}) AS last_commit, name FROM author_stats""")
def author_stats(spark, d):
    return own.author_stats(order_touches(spark, d), LOG_ORDER).select(
        "repo_id", "path", "email", "commit_count", F.date_format("last_commit", _DAY).alias("last_commit"), "name"
    )


@C.query("rank_contributors", f"""WITH {ORDER_TOUCHES},
{AUTHOR_STATS}
SELECT repo_id, path, rank::INT AS rank, email, name, commit_count, percentage FROM shares""")
def rank_contributors(spark, d):
    return own.rank_contributors(order_touches(spark, d), LOG_ORDER).drop("last_commit")


@C.query("code_owners", f"""WITH {ORDER_OWNED}
SELECT repo_id, file_id, primary_owner, bus_factor, is_knowledge_silo FROM owners""")
def code_owners(spark, d):
    return _owners(spark, d)[0].drop("contributors")


@C.query("owners_with_file", f"""WITH {ORDER_OWNED}
SELECT repo_id, file_id, primary_owner, bus_factor, path FROM owners""")
def owners_with_file(spark, d):
    owners, files = _owners(spark, d)
    return own.owners_with_file(owners, files).select("repo_id", "file_id", "primary_owner", "bus_factor", "path")


@C.query("knowledge_silos", f"""WITH {ORDER_OWNED}
SELECT repo_id, path, primary_owner FROM owners WHERE is_knowledge_silo ORDER BY repo_id, path""")
def knowledge_silos(spark, d):
    return own.silos(*_owners(spark, d)).select("repo_id", "path", "primary_owner")


@C.query("silo_totals", f"""WITH {ORDER_OWNED}
SELECT repo_id, count(*) AS total FROM owners WHERE is_knowledge_silo GROUP BY 1""")
def silo_totals(spark, d):
    return own.silo_totals(_owners(spark, d)[0])


_LISTING = """listing AS (
  SELECT repo_id, path FROM files
  UNION ALL
  SELECT repo_id, regexp_replace(path, '[^/]*$', '') || 'tests/test_order_' || substr(file_id, 2) ||
         CASE WHEN path LIKE '%.%' THEN regexp_extract(path, '\\.[^.]*$') ELSE '.py' END
  FROM files WHERE loc IS NOT NULL)"""


def _listing(files):
    made = files.where("loc IS NOT NULL").selectExpr(
        "repo_id",
        r"concat(regexp_replace(path, '[^/]*$', ''), 'tests/test_order_', substr(file_id, 2), "
        r"CASE WHEN path LIKE '%.%' THEN regexp_extract(path, '(\\.[^.]*)$', 1) ELSE '.py' END) AS path",
    )
    return files.select("repo_id", "path").unionByName(made)


@C.query("detect_tests", f"""WITH {ORDER_FILES}, {ORDER_TOUCHES}, {_LISTING}
SELECT DISTINCT t.repo_id, t.path, f.loc IS NOT NULL AS has_tests FROM touches t JOIN files f USING (repo_id, path)""")
def tests_found(spark, d):
    return detect_tests(order_touches(spark, d).select("repo_id", "path"), _listing(order_files(spark, d)))


@C.query("apply_git_stats", f"""WITH {ORDER_OWNED}
SELECT f.repo_id, f.file_id, coalesce(o.change_frequency, -1)::DOUBLE AS change_frequency,
       strftime(o.git_last_modified, {_SQL_DAY}) AS last_modified,
       CASE WHEN o.path IS NULL THEN NULL ELSE (f.loc IS NOT NULL)::VARCHAR END AS has_tests
FROM files f LEFT JOIN ownership o USING (repo_id, path)""")
def apply_git_stats(spark, d):
    files = order_files(spark, d)
    # One pass over the touch log: the paths are those of the statistics.
    owned = cut_lineage(own.path_stats(own.author_stats(order_touches(spark, d), LOG_ORDER)))
    tests = detect_tests(owned.select("repo_id", "path"), _listing(files))
    bare = files.selectExpr(
        "*", "CAST(-1 AS DOUBLE) AS change_frequency", "CAST(NULL AS TIMESTAMP) AS git_last_modified",
        "CAST(NULL AS BOOLEAN) AS has_tests",
    )
    return own.apply_git_stats(bare, owned, tests).select(
        "repo_id", "file_id", "change_frequency", F.date_format("git_last_modified", _DAY).alias("last_modified"),
        F.col("has_tests").cast("string").alias("has_tests"),
    )


@C.query("file_totals", f"""WITH {ORDER_FILES}
SELECT repo_id, count(*) AS total_files, coalesce(sum(loc), 0)::BIGINT AS total_loc FROM files GROUP BY 1""")
def file_totals(spark, d):
    return stats.file_totals(order_files(spark, d))


@C.query("language_breakdown", f"""WITH {ORDER_FILES}
SELECT repo_id, coalesce(language, 'Unknown') AS language, count(*) AS file_count, coalesce(sum(loc), 0)::BIGINT AS loc_count
FROM files GROUP BY 1, 2""")
def language_breakdown(spark, d):
    return stats.language_breakdown(order_files(spark, d))


@C.query("owner_totals", f"""WITH {ORDER_OWNED}
SELECT repo_id, count(DISTINCT primary_owner) AS total_contributors,
       count(*) FILTER (is_knowledge_silo) AS knowledge_silo_count FROM owners GROUP BY 1""")
def owner_totals(spark, d):
    return stats.owner_totals(*_owners(spark, d))


@C.query("top_owners", f"""WITH {ORDER_OWNED}, counts AS (
  SELECT repo_id, primary_owner AS name, count(*) AS files_owned FROM owners GROUP BY 1, 2)
SELECT repo_id, name, files_owned, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY files_owned DESC, name)::INT AS rank FROM counts) WHERE rank <= 5""")
def top_owners(spark, d):
    return stats.top_owners(*_owners(spark, d))


@C.query("ownership_pages", f"""WITH {ORDER_OWNED}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS position, count(*) OVER (PARTITION BY repo_id) AS total FROM owners)
SELECT repo_id, path, primary_owner, position, ceil(position / 50)::BIGINT AS page, total FROM numbered""")
def ownership_pages(spark, d):
    rows = own.owners_with_file(*_owners(spark, d)).select("repo_id", "path", "primary_owner")
    return stats.number_pages(rows, ["repo_id"], ["path"], 50)


@C.query("ownership_page", f"""WITH {ORDER_OWNED}
SELECT repo_id, path, primary_owner FROM owners ORDER BY path, repo_id LIMIT 50 OFFSET 100""")
def ownership_page(spark, d):
    rows = own.owners_with_file(*_owners(spark, d)).select("repo_id", "path", "primary_owner")
    return stats.paginate(rows, ["path", "repo_id"], 3, 50, max_page_size=200)[0]


# The files that some order priorities share a name with.
_ONE_PATH = "f/y1995/order_%.py"


@C.query("ownership_by_path", f"""WITH {ORDER_OWNED}
SELECT repo_id, path, primary_owner FROM owners WHERE path = (SELECT min(path) FROM files WHERE path LIKE '{_ONE_PATH}')""")
def ownership_by_path(spark, d):
    owners, files = _owners(spark, d)
    wanted = files.where(F.col("path").like(_ONE_PATH)).agg(F.min("path")).first()[0]
    return stats.by_path(own.owners_with_file(owners, files), wanted).select("repo_id", "path", "primary_owner")


@C.query("ownership_filtered_page", f"""WITH {ORDER_OWNED}, chosen AS (SELECT repo_id, path, primary_owner FROM owners WHERE path LIKE 'o/%')
SELECT *, (SELECT count(*) FROM chosen) AS total FROM chosen ORDER BY path, repo_id LIMIT 50 OFFSET 50""")
def ownership_filtered_page(spark, d):
    """The second page of the owners below a folder, with the total of all pages."""
    rows = own.owners_with_file(*_owners(spark, d)).select("repo_id", "path", "primary_owner").where("path LIKE 'o/%'")
    page, total = stats.paginate(rows, ["path", "repo_id"], 2, 50)
    return page.withColumn("total", F.lit(total.first()["total"]).cast("bigint"))


_REPOS = """repos AS (
  SELECT doc_id, 'doc' || doc_id AS repo_id, source AS user_id, text AS architecture_summary,
         CASE doc_id % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' WHEN 2 THEN 'ready' ELSE 'parsing' END AS status FROM documents)"""


def _repos(spark, d):
    return table(spark, d, "documents").selectExpr(
        "concat('doc', doc_id) AS repo_id", "source AS user_id", "text AS architecture_summary",
        "CASE doc_id % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' WHEN 2 THEN 'ready' ELSE 'parsing' END AS status",
        "doc_id AS created_at",
    )


@C.query("list_repositories", f"""WITH {_REPOS}
SELECT repo_id, user_id, CASE WHEN length(architecture_summary) > 200 THEN substr(architecture_summary, 1, 200) || '...'
       ELSE architecture_summary END AS architecture_summary FROM repos""")
def list_repositories(spark, d):
    return stats.list_repositories(_repos(spark, d)).select("repo_id", "user_id", "architecture_summary")


@C.query("pending_users", f"""WITH {_REPOS}
SELECT user_id, bool_or(status NOT IN ('ready', 'failed')) AS has_pending FROM repos GROUP BY 1""")
def pending_users(spark, d):
    return stats.pending_users(_repos(spark, d))


@C.query("ready_documents", f"""WITH {_REPOS}
SELECT l.doc_id, quality FROM labels l JOIN repos r USING (doc_id) WHERE status = 'ready' AND user_id = 'src2'""")
def ready_documents(spark, d):
    from stratacode.operators.common import scope_to_user

    labels = table(spark, d, "labels").withColumn("repo_id", F.concat(F.lit("doc"), "doc_id"))
    return scope_to_user(labels, stats.ready(_repos(spark, d)), "src2").select("doc_id", "quality")


@C.query("glossary_search", """SELECT p_partkey, p_name, p_brand FROM part
WHERE p_name ILIKE '%RING%' OR p_brand ILIKE '%RING%'""")
def glossary_search(spark, d):
    terms = table(spark, d, "part").selectExpr("p_partkey", "p_name AS name", "p_brand AS definition")
    return stats.search_glossary(terms, "RING").selectExpr("p_partkey", "name AS p_name", "definition AS p_brand")


@C.query("glossary_next_page", """SELECT p_partkey, p_name FROM part
WHERE (p_name ILIKE '%d_b%' OR p_brand ILIKE '%d_b%') AND (p_name > 'c' OR (p_name = 'c' AND p_partkey > 50)) ORDER BY p_name, p_partkey LIMIT 20""")
def glossary_next_page(spark, d):
    terms = table(spark, d, "part").selectExpr("p_partkey", "p_name AS name", "p_brand AS definition")
    return stats.page_after(stats.search_glossary(terms, "d_b"), ["name", "p_partkey"], ("c", 50), 20).selectExpr("p_partkey", "name AS p_name")


# Terms of all kinds: parts of names in both cases, wildcards inside and alone, runs that no entry has.
_TERMS = (
    "CASE s_suppkey % 12 WHEN 0 THEN upper(substr(s_name, 1, 4)) WHEN 1 THEN 'd_b' WHEN 2 THEN '%' WHEN 3 THEN '' WHEN 4 THEN 'r%g' WHEN 5 THEN 'zzz' "
    "WHEN 6 THEN '__' WHEN 7 THEN concat('Brand#', s_suppkey % 60) WHEN 8 THEN 'R_N%a' WHEN 9 THEN 'a' WHEN 10 THEN concat('%', s_suppkey % 10, '%') ELSE 'Steel' END"
)


@C.query("glossary_search_terms", f"""WITH terms AS (
  SELECT s_suppkey AS term_id, 's' || (s_suppkey % 40) AS repo_id, {_TERMS} AS term FROM supplier),
glossary AS (
  SELECT 's' || (p_partkey % 40) AS repo_id, p_partkey AS entry_id, p_name AS name, CASE WHEN p_partkey % 7 > 0 THEN p_brand END AS definition FROM part)
SELECT term_id, repo_id, entry_id FROM terms JOIN glossary USING (repo_id) WHERE name ILIKE '%' || term || '%' OR definition ILIKE '%' || term || '%'""")
def glossary_search_terms(spark, d):
    terms = table(spark, d, "supplier").selectExpr("s_suppkey AS term_id", "concat('s', s_suppkey % 40) AS repo_id", f"{_TERMS} AS term")
    glossary = table(spark, d, "part").selectExpr(
        "concat('s', p_partkey % 40) AS repo_id", "p_partkey AS entry_id", "p_name AS name", "IF(p_partkey % 7 > 0, p_brand, NULL) AS definition")
    return stats.search_terms(glossary, terms)


@C.query("glossary_search_page", """SELECT p_partkey, p_name FROM part
WHERE p_name ILIKE '%d_b%' OR p_brand ILIKE '%d_b%' ORDER BY p_name, p_partkey LIMIT 20 OFFSET 20""")
def glossary_search_page(spark, d):
    terms = table(spark, d, "part").selectExpr("p_partkey", "p_name AS name", "p_brand AS definition")
    page, _ = stats.paginate(stats.search_glossary(terms, "d_b"), ["name", "p_partkey"], 2, 20)
    return page.selectExpr("p_partkey", "name AS p_name")


@C.query("glossary_search_total", """SELECT count(*) AS total FROM part WHERE p_name ILIKE '%d_b%' OR p_brand ILIKE '%d_b%'""")
def glossary_search_total(spark, d):
    terms = table(spark, d, "part").selectExpr("p_partkey", "p_name AS name", "p_brand AS definition")
    return stats.paginate(stats.search_glossary(terms, "d_b"), ["name", "p_partkey"], 1, 20)[1]


@C.query("reingestible", f"WITH {_REPOS} SELECT repo_id, status FROM repos WHERE status IN ('ready', 'failed')")
def reingestible(spark, d):
    return stats.reingestible(_repos(spark, d)).select("repo_id", "status")
