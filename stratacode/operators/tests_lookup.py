"""Which files have a test file next to them or in a usual test folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacode.functions.paths import base_name, file_stem, slashes, suffix

# Names of a test file for a file with stem {s} and suffix {x}:
#   test_{s}{x}  {s}.test{x}  {s}.spec{x}  {s}_test{x}  {s}_spec{x}
#   {s}.test.js  {s}.spec.js  {s}.test.tsx  {s}.spec.tsx  test_{s}.py
# They may lie in the file's own folder, in tests/, __tests__/ or spec/ below it, or,
# for a file that is not at the root, in tests/ or __tests__/ at the root.
PREFIX = "test_"
TAGS = (".test", ".spec", "_test", "_spec")
FIXED_ENDS = (".test.js", ".spec.js", ".test.tsx", ".spec.tsx")
FIXED_PREFIX_END = ".py"
SIBLING_DIRS = ("tests", "__tests__", "spec")
ROOT_DIRS = ("tests", "__tests__")

_ANYWHERE = "\u0001"


def _by_name(name: Column) -> Column:
    return F.concat(F.lit("\0name\0"), name)


def _by_stem(stem: Column) -> Column:
    return F.concat(F.lit("\0stem\0"), stem)


def _without_end(text: Column, end: str) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - len(end))


def _tested_names(name: Column, stem: Column, ext: Column) -> Column:
    """Names and stems of the files that a file called ``name`` would test."""
    found = [F.when(name.startswith(PREFIX), _by_name(F.substring(name, len(PREFIX) + 1, 2**30)))]
    for tag in TAGS:
        inner = F.concat(_without_end(stem, tag), ext)
        found.append(F.when(stem.endswith(tag) & (F.length(stem) > len(tag)) & (suffix(inner) == ext), _by_name(inner)))
        whole = _without_end(name, tag)
        found.append(F.when(name.endswith(tag) & (F.length(name) > len(tag)) & (suffix(whole) == ""), _by_name(whole)))
    for end in FIXED_ENDS:
        found.append(F.when(name.endswith(end) & (F.length(name) > len(end)), _by_stem(_without_end(name, end))))
    bare = len(PREFIX) + len(FIXED_PREFIX_END)
    found.append(
        F.when(
            name.startswith(PREFIX) & name.endswith(FIXED_PREFIX_END) & (F.length(name) > bare),
            _by_stem(F.substring(name, F.lit(len(PREFIX) + 1), F.length(name) - bare)),
        )
    )
    return F.array_compact(F.array(*found))


def _tested_folders(folder: Column) -> Column:
    """Folders whose files a test in ``folder`` can belong to (``""`` is the root)."""
    last = F.substring_index(folder, "/", -1)
    above = F.when(folder.contains("/"), F.regexp_replace(folder, r"/[^/]*$", "")).otherwise(F.lit(""))
    return F.array_compact(
        F.array(
            folder,
            F.when(last.isin(*SIBLING_DIRS), above),
            F.when(folder.isin(*ROOT_DIRS), F.lit(_ANYWHERE)),
        )
    )


def _located(df: DataFrame, path: Column, *columns: str) -> DataFrame:
    return df.select(
        "repo_id", *columns, base_name(path).alias("name"), file_stem(path).alias("stem"), suffix(path).alias("ext"),
        F.regexp_extract(slashes(path), r"^(.*)/[^/]*$", 1).alias("folder"),
    )


def detect_tests(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """(repo_id, path, has_tests) for every path of the history.

    The few test-like files of ``listing`` name the files they would test; a path has
    at most four keys to be found by.  One equi semi-join decides, and no two files
    are ever compared directly.
    """
    name, stem, ext, folder = (F.col(c) for c in ("name", "stem", "ext", "folder"))
    test_like = _located(listing.where(base_name(F.col("path")).rlike("test|spec")), F.col("path"))
    keys = (
        test_like.select("repo_id", "folder", F.explode(_tested_names(name, stem, ext)).alias("what"))
        .select("repo_id", "what", F.explode(_tested_folders(folder)).alias("where"))
        .select("repo_id", F.concat("where", "what").alias("key"))
    )
    wanted = paths.select("repo_id", "path").distinct()
    places = F.when(folder == "", F.array(folder)).otherwise(F.array(folder, F.lit(_ANYWHERE)))
    sought = (
        _located(wanted, F.col("path"), "path")
        .select("repo_id", "path", F.array(_by_name(name), _by_stem(stem)).alias("whats"), F.explode(places).alias("where"))
        .select("repo_id", "path", F.explode(F.transform("whats", lambda w: F.concat(F.col("where"), w))).alias("key"))
    )
    tested = (
        sought.join(keys, ["repo_id", "key"], "left_semi")
        .select("repo_id", "path").distinct().withColumn("has_tests", F.lit(True))
    )
    return wanted.join(tested, ["repo_id", "path"], "left").fillna(False, ["has_tests"])
