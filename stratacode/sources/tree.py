"""Source trees: one folder per repository below a root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacode import schemas
from stratacode.functions.paths import (
    SUFFIX_LANGUAGE, base_name, in_skipped_dir, is_hosted_repo_url, language_of, line_count, suffix, url_name, url_owner_repo,
)

# Names under which a README is looked for, best first.
README_NAMES = ("README.md", "readme.md", "Readme.md")
# Lower-case names of the non-source files whose text is used.
OPENED_NAMES = (
    "package.json", "pom.xml", "build.gradle", "build.gradle.kts", "go.mod", "cargo.toml", "gemfile", "composer.json", "readme.md",
)


def _base_uri(spark: SparkSession, root: str) -> str:
    """Fully qualified form of ``root``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(conf).makeQualified(path).toString().rstrip("/")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(repo_id, path, size) of a listing with one line a file: its bytes, a tab, and its path below the root (``find . -type f -printf '%s\\t%P\\n'``).

    The lines are read by splits; a line that is none of this drops out.
    """
    line = F.regexp_extract("value", r"^(\d+)\t([^/]+)/(.+)$", 0)
    parts = [F.regexp_extract("value", r"^(\d+)\t([^/]+)/(.+)$", i) for i in (1, 2, 3)]
    read = spark.read.option("lineSep", "\n").text(path).where(line != "")
    return read.select(parts[1].alias("repo_id"), parts[2].alias("path"), parts[0].cast("bigint").alias("size"))


def _empty_files(manifest: DataFrame) -> DataFrame:
    """(repo_id, path, content) of files without a byte: Spark's file sources leave such files out, yet an empty module is a source file."""
    return manifest.where("size = 0").select("repo_id", "path", F.lit("").alias("content"))


def write_listing(files: DataFrame, path: str) -> None:
    """Store (repo_id, path, content) rows as a listing table with the size of each file."""
    files.select("repo_id", "path", F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint").alias("size"), "content").write.parquet(path)


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """(repo_id, path, content) of a stored listing: one scan, of which filters on paths read no content."""
    return spark.read.schema(schemas.LISTING).parquet(path).drop("size")


def _read_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    )
    base = len(_base_uri(spark, root)) + 1
    below = files.select(F.substring("path", base + 1, 2**30).alias("below"), "content")
    return below.select(
        F.substring_index("below", "/", 1).alias("repo_id"),
        F.regexp_extract("below", r"^[^/]*/(.*)$", 1).alias("path"),
        "content",
    ).where("path <> ''")


def _text(content: Column) -> Column:
    """Bytes as text; bytes that are no UTF-8 become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def scan_tree(spark: SparkSession, root: str, manifest: DataFrame | None = None) -> DataFrame:
    """(repo_id, path, content) of every file below ``root/<repo_id>/``.

    Only sources, manifests and READMEs are opened; the other files are listed with
    null content, since no rule looks into them.  Files without a byte are known from ``manifest`` only (``read_manifest``).
    """
    name = base_name(F.col("path"))
    opened = suffix(F.col("path")).isin(*SUFFIX_LANGUAGE) | F.lower(name).isin(*OPENED_NAMES)
    files = _read_files(spark, root, "*")
    read = files.where(opened).withColumn("content", _text(F.col("content")))
    listed = files.where(~opened).select("repo_id", "path", F.lit(None).cast("string").alias("content"))
    found = read.unionByName(listed)
    return found if manifest is None else found.unionByName(_empty_files(manifest))


def keep_source_files(files: DataFrame) -> DataFrame:
    """Files with a known source suffix outside skipped directories."""
    path = F.col("path")
    return files.where(suffix(path).isin(*SUFFIX_LANGUAGE) & ~in_skipped_dir(path))


def scan_source_tree(spark: SparkSession, root: str, manifest: DataFrame | None = None) -> DataFrame:
    """Source files only; suffix and folder filters run on the path, before a file is decoded."""
    wanted = "*{" + ",".join(SUFFIX_LANGUAGE) + "}"
    read = keep_source_files(_read_files(spark, root, wanted)).withColumn("content", _text(F.col("content")))
    return read if manifest is None else read.unionByName(keep_source_files(_empty_files(manifest)))


def to_files(source_files: DataFrame) -> DataFrame:
    """Canonical file rows: stable id, language and line count; unknown languages drop out."""
    path = F.col("path")
    return source_files.select(
        "repo_id",
        F.sha2(F.concat_ws("\0", "repo_id", "path"), 256).alias("file_id"),
        "path",
        language_of(path).alias("language"),
        line_count(F.col("content")).alias("loc"),
        "content",
    ).where(F.col("language").isNotNull())


def pick_readme(files: DataFrame) -> DataFrame:
    """(repo_id, content) of the best README at the root of each repository."""
    rank = F.array_position(F.array(*[F.lit(n) for n in README_NAMES]), F.col("path"))
    return (
        files.where(F.col("path").isin(*README_NAMES))
        .groupBy("repo_id").agg(F.min_by("content", rank).alias("content"))
    )


def parse_repo_url(df: DataFrame, column: str) -> DataFrame:
    """Adds name, owner, repo and validity flags; a bad URL gives nulls, never an error."""
    parts = url_owner_repo(F.col(column))
    return (
        df.withColumn("repo_name", url_name(F.col(column)))
        .withColumn("_parts", parts)
        .withColumn("owner", F.col("_parts.owner"))
        .withColumn("repo", F.col("_parts.repo"))
        .withColumn("parsed", F.col("_parts.owner").isNotNull())
        .withColumn("is_valid", is_hosted_repo_url(F.col(column)))
        .drop("_parts")
    )
