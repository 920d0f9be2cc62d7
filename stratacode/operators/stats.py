"""Repository statistics, top lists, paging and guide views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacode.functions.text import preview
from stratacode.operators.common import broadcast_if_small, number_rows, top_k
from stratacode.operators.edges import GLOSSARY_KINDS, dependency_counts, of_kind
from stratacode.session import cut_lineage

# Severity order of the criticality labels.
SEVERITY = ("critical", "caution", "safe")
PENDING_DONE = ("ready", "failed")


def severity_rank(criticality: Column) -> Column:
    rank = F.lit(len(SEVERITY))
    for i, label in reversed(list(enumerate(SEVERITY))):
        rank = F.when(criticality == label, F.lit(i)).otherwise(rank)
    return rank


def file_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc")
    )


def language_breakdown(files: DataFrame) -> DataFrame:
    language = F.coalesce(F.nullif("language", F.lit("")), F.lit("Unknown"))
    return files.groupBy("repo_id", language.alias("language")).agg(
        F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc_count")
    )


def _owners_of_files(owners: DataFrame, files: DataFrame) -> DataFrame:
    return owners.join(files.select("repo_id", "file_id"), ["repo_id", "file_id"], "left_semi")


def owner_totals(owners: DataFrame, files: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct primary owners and knowledge silos per repository."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return _owners_of_files(owners, files).groupBy("repo_id").agg(
        distinct(F.col("primary_owner")).alias("total_contributors"),
        F.count_if("is_knowledge_silo").alias("knowledge_silo_count"),
    )


def top_owners(owners: DataFrame, files: DataFrame, k: int = 5) -> DataFrame:
    """Owners with the most files, ties by name."""
    counts = _owners_of_files(owners, files).groupBy(
        "repo_id", F.coalesce("primary_owner", F.lit("Unknown")).alias("name")
    ).agg(F.count(F.lit(1)).alias("files_owned"))
    return top_k(counts, ["repo_id"], [F.desc("files_owned"), "name"], k)


def repo_stats(files: DataFrame, owners: DataFrame, dependencies: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row of totals per repository; each base table is aggregated once."""
    stats = (
        file_totals(files)
        .join(owner_totals(owners, files), "repo_id", "left")
        .join(dependency_counts(dependencies, symbols), "repo_id", "left")
    )
    return stats.fillna(0, ["total_contributors", "knowledge_silo_count", "total_dependencies"])


def key_modules(files: DataFrame, k: int = 10) -> DataFrame:
    """Files with the highest fan_in, ties by path."""
    rows = files.select(
        "repo_id", "file_id", "path", F.coalesce("fan_in", F.lit(0)).alias("fan_in"),
        F.coalesce("fan_out", F.lit(0)).alias("fan_out"), "language", "criticality",
    )
    return top_k(rows, ["repo_id"], [F.desc("fan_in"), "path"], k)


def critical_only(files: DataFrame) -> DataFrame:
    return files.where(F.col("criticality").isin("critical", "caution"))


def critical_files(files: DataFrame) -> DataFrame:
    """All critical and caution files: severity, then fan_in descending, then path."""
    return critical_only(files).select(
        "repo_id", "path", "criticality",
        F.coalesce("criticality_reasons", F.array().cast("array<string>")).alias("reasons"),
        F.coalesce("fan_in", F.lit(0)).alias("fan_in"),
        "change_frequency",
        F.coalesce("has_tests", F.lit(False)).alias("has_tests"),
    ).orderBy("repo_id", severity_rank(F.col("criticality")), F.desc("fan_in"), "path")


def glossary_candidates(symbols: DataFrame, files: DataFrame, k: int = 50) -> DataFrame:
    """Symbols of the most imported files, unknown fan_in first.

    The top-k runs on narrow rows; source text is fetched only for the survivors.
    """
    narrow = of_kind(symbols, GLOSSARY_KINDS).select(
        "repo_id", "symbol_id", "file_id", "kind", "name", "start_line", "end_line"
    )
    ranked = top_k(
        narrow.join(files.select("repo_id", "file_id", "path", "fan_in"), ["repo_id", "file_id"]),
        ["repo_id"], [F.desc_nulls_first("fan_in"), "path", "start_line", "symbol_id"], k,
    )
    keys = ["repo_id", "symbol_id"]
    # Broadcast when few, so that the texts of all other symbols stay where they are.
    return symbols.select(*keys, "source_code").join(broadcast_if_small(ranked), keys)


def search_glossary(glossary: DataFrame, query: str) -> DataFrame:
    """Entries whose name or definition contains the text, any case (``%`` and ``_`` stay wildcards)."""
    pattern = f"%{query}%"
    return glossary.where(F.col("name").ilike(pattern) | F.col("definition").ilike(pattern))


GRAM = 3


def _grams(text: Column) -> Column:
    """Distinct runs of one to ``GRAM`` characters of a text."""
    chars, n = F.split(text, ""), F.length(text)

    def runs(size: int) -> Column:
        at = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(*[F.get(chars, i + k) for k in range(size)]))

    return F.array_distinct(F.concat(*[runs(size) for size in range(1, GRAM + 1)]))


def _literal_parts(term: Column) -> Column:
    """What a term asks for letter by letter: its parts between the wildcards."""
    return F.filter(F.split(term, "[%_]"), lambda part: part != F.lit(""))


def search_terms(glossary: DataFrame, terms: DataFrame, entry_key: str = "entry_id", term_key: str = "term_id") -> DataFrame:
    """``search_glossary`` for a table of terms: (``term_key``, repo_id, ``entry_key``) of every entry that contains the term.

    ``glossary`` has (repo_id, ``entry_key``, name, definition), ``terms`` (repo_id, ``term_key``, term).  Entries are indexed by the runs of one to three characters of
    their texts.  A term is looked up by the run of its literal parts that the fewest entries of its repository have, and each entry found is verified with ``ilike``.
    Terms asked for several times are looked up and verified once; what matches is dealt to their keys last, so only keys travel with the rows of the result.  A
    term of wildcards only, or an empty one, is verified against every entry and has no postings.  Null terms find nothing; ``%`` and ``_`` stay wildcards and no
    character escapes them.
    """
    lowered = [F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "definition")]
    # The size of runs and entries shows neither in that of their table nor before they are made: these sides are merged, never broadcast unseen.
    texts = glossary.select("repo_id", entry_key, "name", "definition").hint("merge")
    postings = glossary.select("repo_id", entry_key, F.explode(F.array_distinct(F.concat(*[_grams(c) for c in lowered]))).alias("gram"))
    asked = broadcast_if_small(terms.where("term is not null").select("repo_id", term_key, "term").distinct())
    grams = F.array_distinct(F.flatten(F.transform(_literal_parts(F.lower("term")), _grams)))
    distinct = cut_lineage(asked.select("repo_id", "term").distinct().withColumn("grams", grams))

    # A run that no entry has ends the search; else the rarest one decides, a longer one first among equals.
    literal = distinct.select("repo_id", "term", F.explode("grams").alias("gram"))
    frequency = postings.groupBy("repo_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    rated = literal.join(frequency.hint("merge"), ["repo_id", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rated.groupBy("repo_id", "term").agg(F.min_by("gram", F.struct("n", -F.length("gram"), "gram")).alias("gram"))
    found = rarest.join(postings.hint("merge"), ["repo_id", "gram"]).select("repo_id", "term", entry_key)
    open_terms = broadcast_if_small(distinct.where(F.size("grams") == 0).select("repo_id", "term"))
    candidates = found.unionAll(open_terms.join(glossary.select("repo_id", entry_key).hint("merge"), "repo_id").select("repo_id", "term", entry_key))
    pattern = F.concat(F.lit("%"), F.replace("term", F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    matches = F.call_function("ilike", F.col("name"), pattern) | F.call_function("ilike", F.col("definition"), pattern)
    hits = candidates.join(texts, ["repo_id", entry_key]).where(matches).select("repo_id", "term", entry_key)
    return hits.hint("merge").join(asked, ["repo_id", "term"]).select(term_key, "repo_id", entry_key)


def by_path(df: DataFrame, path: str, column: str = "path") -> DataFrame:
    return df.where(F.col(column) == path)


def silos_only(owners: DataFrame) -> DataFrame:
    return owners.where("is_knowledge_silo")


def ready(repositories: DataFrame) -> DataFrame:
    return repositories.where("status = 'ready'")


def reingestible(repositories: DataFrame) -> DataFrame:
    return repositories.where(F.col("status").isin(*PENDING_DONE))


def pending_users(repositories: DataFrame) -> DataFrame:
    """Per user: is any repository still being worked on?"""
    return repositories.groupBy("user_id").agg(
        F.bool_or(~F.col("status").isin(*PENDING_DONE)).alias("has_pending")
    )


def list_repositories(repositories: DataFrame, user_id=None, limit: int = 200) -> DataFrame:
    """Repositories newest first per user, long summaries cut."""
    rows = repositories if user_id is None else repositories.where(F.col("user_id") == F.lit(user_id))
    return rows.withColumn("architecture_summary", preview(F.col("architecture_summary"), limit)).orderBy(
        "user_id", F.desc("created_at"), "repo_id"
    )


def paginate(df: DataFrame, order: list[str], page: int, page_size: int, max_page_size: int = 100):
    """(rows of one page, one-row total).  Pages count from 1; order must be total.

    The first page is a top-k.  A later one is cut from distributed positions, so no task sorts the pages before it; who walks through all pages takes ``page_after``.
    """
    if page < 1 or not 1 <= page_size <= max_page_size:
        raise ValueError(f"page >= 1 and 1 <= page_size <= {max_page_size} required")
    count = F.count(F.lit(1)).alias("total")
    if page == 1:
        return df.orderBy(*order).limit(page_size), df.agg(count)
    last = page * page_size
    numbered = number_rows(df.withColumn("_all", F.lit(0)), ["_all"], order, "_at")
    # The numbered rows are written already: counting them makes ``df`` no second time.
    total = numbered.agg(count)
    return numbered.where(F.col("_at").between(last - page_size + 1, last)).orderBy("_at").select(*df.columns), total


def page_after(df: DataFrame, order: list[str], last: tuple | None, page_size: int) -> DataFrame:
    """The page that follows a row: ``last`` holds that row's values of ``order`` (rising, without nulls), ``None`` for the first page.

    A filter and a top-k, whatever the depth of the page.
    """
    if last is None:
        return df.orderBy(*order).limit(page_size)
    if len(last) != len(order):
        raise ValueError("last holds one value for each column of order")
    beyond, equal = F.lit(False), F.lit(True)
    for column, value in zip(order, last):
        beyond = beyond | (equal & (F.col(column) > F.lit(value)))
        equal = equal & (F.col(column) == F.lit(value))
    # The bound on the first column alone reaches the scan.
    return df.where((F.col(order[0]) >= F.lit(last[0])) & beyond).orderBy(*order).limit(page_size)


def number_pages(df: DataFrame, keys: list[str], order: list, page_size: int) -> DataFrame:
    """Every row with its page, position and the total of its key, for all pages at once.

    Totals are counted over the numbered rows, which are written already, so ``df`` is made once.
    """
    numbered = number_rows(df, keys, order)
    totals = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return (
        numbered
        .withColumn("page", F.ceil(F.col("position") / F.lit(page_size)).cast("bigint"))
        .join(totals, keys)
    )


def preview_rows(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows per key in display order."""
    return top_k(df, keys, order, n, "preview_pos")
