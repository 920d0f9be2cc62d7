"""Column functions over file paths, repository URLs and symbol names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffix -> language of the parsed files.
SUFFIX_LANGUAGE = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".hpp": "cpp",
    ".rb": "ruby",
    ".cs": "c_sharp",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
}

# Directory names that are never scanned.
SKIP_DIRS = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".next",
    "coverage", ".pytest_cache", "alembic", "target", "bin", "obj",
)

# Criticality -> display score; anything else scores 50.
CRITICALITY_SCORE = {"critical": 100.0, "caution": 75.0, "safe": 25.0}
DEFAULT_SCORE = 50.0


def lookup(mapping: dict[str, object], key: Column) -> Column:
    """Literal map look-up; null when the key is absent."""
    entries = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.try_element_at(F.create_map(*entries), key)


_BLANKS = " \t\n\r\f\x0b"


def strip_ws(col: Column) -> Column:
    """Trim every kind of white space, not blanks only."""
    return F.btrim(col, F.lit(_BLANKS))


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def segments(path: Column) -> Column:
    return F.split(slashes(path), "/")


def base_name(path: Column) -> Column:
    return F.regexp_extract(slashes(path), r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """Last dot-suffix of the file name; empty for names such as ``.env`` or ``Makefile``."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)


def file_stem(path: Column) -> Column:
    """File name without its last suffix."""
    name = base_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def full_stem(path: Column) -> Column:
    """Whole path cut at its last dot."""
    return F.regexp_replace(slashes(path), r"\.[^.]*$", "")


def parent_dir(path: Column) -> Column:
    """Parent directory, ``root`` for a file at the top."""
    p = slashes(path)
    return F.when(p.contains("/"), F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit("root"))


def top_dir(path: Column) -> Column:
    """First directory, ``root`` for a file at the top.  Also the module of a file."""
    p = slashes(path)
    return F.when(p.contains("/"), F.substring_index(p, "/", 1)).otherwise(F.lit("root"))


def language_of(path: Column) -> Column:
    return lookup(SUFFIX_LANGUAGE, suffix(path))


def in_skipped_dir(path: Column) -> Column:
    """True when a directory on the way to the file is skipped."""
    dirs = F.slice(segments(path), F.lit(1), F.size(segments(path)) - 1)
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in SKIP_DIRS]))


def line_count(content: Column) -> Column:
    """Number of newline characters plus one."""
    return (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1).cast("int")


def symbol_loc(start: Column, end: Column) -> Column:
    known = start.isNotNull() & end.isNotNull() & (start != 0) & (end != 0)
    return F.when(known, end - start + 1).otherwise(F.lit(0)).cast("int")


def criticality_label(criticality: Column) -> Column:
    return F.coalesce(F.nullif(criticality, F.lit("")), F.lit("medium"))


def criticality_score(criticality: Column) -> Column:
    key = F.lower(F.trim(criticality_label(criticality)))
    return F.coalesce(lookup(CRITICALITY_SCORE, key), F.lit(DEFAULT_SCORE))


def import_path(name: Column) -> Column:
    """Slash form of an imported name: leading dots and slashes off, alias cut off.

    Null when nothing is left to resolve.
    """
    path = strip_ws(F.ltrim(F.translate(name, "\\.", "//"), F.lit("/")))
    path = F.nullif(strip_ws(F.substring_index(path, " as ", 1)), F.lit(""))
    return F.when(name != "<anonymous>", path)


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def owner_label(name: Column, email: Column) -> Column:
    return F.concat(name, F.lit(" <"), email, F.lit(">"))


def url_name(url: Column) -> Column:
    """Repository name: last path segment of the URL as given."""
    return F.substring_index(F.regexp_replace(url, r"/+$", ""), "/", -1)


def url_owner_repo(url: Column) -> Column:
    """``struct<owner, repo>`` from the first two path segments; null fields if absent."""
    clean = F.regexp_replace(strip_ws(url), r"/+$", "")
    with_scheme = F.when(clean.startswith("http"), clean).otherwise(F.concat(F.lit("https://"), clean))
    path = F.regexp_replace(F.regexp_extract(with_scheme, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), r"^/+", "")
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    complete = F.size(parts) >= 2
    return F.struct(
        F.when(complete, F.get(parts, F.lit(0))).alias("owner"),
        F.when(complete, F.regexp_replace(F.get(parts, F.lit(1)), r"\.git$", "")).alias("repo"),
    )


def is_hosted_repo_url(url: Column) -> Column:
    # Fixed value: form of an accepted repository URL.
    return F.coalesce(strip_ws(url).rlike(r"^https://github\.com/[\w.-]+/[\w.-]+/?$"), F.lit(False))
