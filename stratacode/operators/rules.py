"""Rule-based classification: criticality, stack, entry points, integrations.

Each rule list becomes column expressions evaluated in the scan, so matching adds
no join; only the few distinct labels per repository are shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacode.functions.paths import SKIP_DIRS, base_name, segments, slashes, suffix
from stratacode.operators.common import top_k
from stratacode.operators.edges import IMPORT_KIND, of_kind

# Path patterns of core infrastructure files.
CRITICAL_PATH_PATTERNS = (
    r"config\.", r"database\.", r"middleware/", r"migrations/",
    r"auth\.", r"security\.", r"celery\.", r"main\.",
)

# The age from which a file counts as untouched, the fan-in steps and scores, and the texts of the reasons below.
STALE_DAYS = 180


def criticality(files: DataFrame, as_of, git_aware: bool = True) -> DataFrame:
    """Files with ``criticality`` and ``criticality_reasons``.

    ``as_of`` is the timestamp ages are measured from.  ``git_aware=False`` scores
    before any history is known: no file is old and none has tests.
    """
    fan_in = F.coalesce(F.col("fan_in"), F.lit(0))
    core = F.col("path").rlike("|".join(CRITICAL_PATH_PATTERNS))
    if git_aware:
        age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("git_last_modified")
        stale = F.coalesce(F.floor(age / F.lit(86_400_000_000)) > STALE_DAYS, F.lit(False))
        untested = ~F.coalesce(F.col("has_tests"), F.lit(False))
    else:
        stale, untested = F.lit(False), F.lit(True)
    score = (
        F.when(fan_in >= 10, 3).when(fan_in >= 5, 1).otherwise(0)
        + F.when(core, 2).otherwise(0)
        + F.when(stale, 1).otherwise(0)
        + F.when(untested, 1).otherwise(0)
    )
    reasons = F.array_compact(
        F.array(
            F.when(fan_in >= 5, F.concat(F.lit("imported by "), fan_in.cast("string"), F.lit(" files"))),
            F.when(core, F.lit("core infrastructure file")),
            F.when(stale, F.lit("untouched for 6+ months")),
            F.when(untested, F.lit("no test coverage")),
        )
    )
    return files.withColumn(
        "criticality", F.when(score >= 4, "critical").when(score >= 2, "caution").otherwise("safe")
    ).withColumn("criticality_reasons", reasons)


# Suffix -> language label of the stack report.
STACK_LANGUAGES = {
    ".py": "Python", ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript",
    ".jsx": "JavaScript", ".go": "Go", ".rs": "Rust", ".java": "Java", ".cs": "C#",
    ".rb": "Ruby", ".php": "PHP", ".cpp": "C++", ".c": "C", ".kt": "Kotlin", ".swift": "Swift",
}

# Stack rules as (scope, needle, category, label).
#   suffix        file suffix equals needle
#   package_dep   package.json lists needle as (dev) dependency
#   py_text       a .py file contains needle, any case
#   name_text     "<lower-case file name>|<needle>": such a file contains needle, any case
#   root_text     "<root file>|<needle>": that root file contains needle, any case
#   composer      root composer.json requires exactly needle
#   composer_any  needle occurs anywhere in its requirements
#   root_file     this file exists at the root
#   root_dir      something exists below this root directory
#   segment       a file or directory name contains needle, any case
#   path          the path contains needle, any case
STACK_RULES = (
    *[("suffix", s, "languages", label) for s, label in STACK_LANGUAGES.items()],
    ("package_dep", "next", "frameworks", "Next.js"),
    ("package_dep", "react", "frameworks", "React"),
    ("package_dep", "vue", "frameworks", "Vue"),
    ("package_dep", "svelte", "frameworks", "Svelte"),
    ("package_dep", "express", "frameworks", "Express"),
    ("package_dep", "@nestjs/core", "frameworks", "NestJS"),
    ("package_dep", "angular", "frameworks", "Angular"),
    ("package_dep", "mongoose", "databases", "MongoDB"),
    ("package_dep", "pg", "databases", "PostgreSQL"),
    ("package_dep", "mysql", "databases", "MySQL"),
    ("package_dep", "sqlite3", "databases", "SQLite"),
    ("package_dep", "redis", "databases", "Redis"),
    ("package_dep", "ioredis", "databases", "Redis"),
    ("py_text", "fastapi", "frameworks", "FastAPI"),
    ("py_text", "django", "frameworks", "Django"),
    ("py_text", "flask", "frameworks", "Flask"),
    ("py_text", "sqlalchemy", "databases", "SQLAlchemy"),
    ("py_text", "psycopg", "databases", "PostgreSQL"),
    ("py_text", "pymongo", "databases", "MongoDB"),
    ("py_text", "redis", "databases", "Redis"),
    ("name_text", "pom.xml|spring-boot", "frameworks", "Spring Boot"),
    ("name_text", "build.gradle|spring", "frameworks", "Spring"),
    ("name_text", "build.gradle.kts|spring", "frameworks", "Spring"),
    ("root_text", "go.mod|gin-gonic", "frameworks", "Gin"),
    ("root_text", "go.mod|echo", "frameworks", "Echo"),
    ("root_text", "Cargo.toml|actix-web", "frameworks", "Actix"),
    ("root_text", "Cargo.toml|rocket", "frameworks", "Rocket"),
    ("root_text", "Cargo.toml|diesel", "databases", "PostgreSQL"),
    ("root_text", "Gemfile|rails", "frameworks", "Ruby on Rails"),
    ("composer", "laravel/framework", "frameworks", "Laravel"),
    ("composer_any", "symfony", "frameworks", "Symfony"),
    ("root_file", "manage.py", "frameworks", "Django"),
    ("root_file", "next.config.js", "frameworks", "Next.js"),
    ("root_file", "next.config.ts", "frameworks", "Next.js"),
    ("segment", "socket", "frameworks", "WebSockets"),
    ("segment", "socket", "frameworks", "Real-time System"),
    ("segment", "ws", "frameworks", "WebSockets"),
    ("segment", "ws", "frameworks", "Real-time System"),
    ("path", "prisma", "frameworks", "Prisma ORM"),
    ("path", "prisma", "databases", "PostgreSQL"),
    ("path", "redis", "databases", "Redis"),
    ("path", "redis", "frameworks", "Caching Layer"),
    ("root_dir", ".github/workflows", "ci_cd", "GitHub Actions"),
    ("root_file", ".gitlab-ci.yml", "ci_cd", "GitLab CI"),
    ("root_file", "Jenkinsfile", "ci_cd", "Jenkins"),
    ("root_file", "Dockerfile", "ci_cd", "Docker"),
)

STACK_CATEGORIES = ("languages", "frameworks", "databases", "ci_cd")
_MONOREPO_DIRS = ("apps", "packages")


class _Listing:
    """Columns the rule scopes look at, derived once from (path, content)."""

    def __init__(self, listing: DataFrame) -> None:
        parts = segments(F.col("path"))
        first_skip = F.array_position(F.transform(parts, lambda s: s.isin(*SKIP_DIRS)), F.lit(True))
        # Directories in front of a skipped one are still part of the listing.
        seen = F.when(first_skip == 0, parts).otherwise(
            F.slice(parts, F.lit(1), F.greatest(first_skip - 1, F.lit(0)).cast("int"))
        )
        self.rows = listing.select(
            "repo_id", "content",
            slashes(F.col("path")).alias("path"),
            suffix(F.col("path")).alias("suffix"),
            base_name(F.col("path")).alias("name"),
            (first_skip == 0).alias("visible"),
            F.transform(seen, F.lower).alias("seen"),
            F.lower("content").alias("text"),
        )
        self.path, self.suffix, self.name = F.col("path"), F.col("suffix"), F.col("name")
        self.visible, self.seen = F.col("visible"), F.col("seen")
        self.text = F.coalesce(F.col("text"), F.lit(""))

    def _json_map(self, field: str) -> Column:
        return F.from_json("content", f"struct<{field}:map<string,string>>")[field]

    def test(self, scope: str, needle: str) -> Column:
        if scope == "suffix":
            return self.visible & (self.suffix == needle)
        if scope == "package_dep":
            listed = F.coalesce(F.map_contains_key(self._json_map("dependencies"), needle), F.lit(False)) | F.coalesce(
                F.map_contains_key(self._json_map("devDependencies"), needle), F.lit(False)
            )
            return self.visible & (self.name == "package.json") & listed
        if scope == "py_text":
            return self.visible & (self.suffix == ".py") & self.text.contains(needle)
        if scope == "name_text":
            file_name, word = needle.split("|")
            return self.visible & (F.lower(self.name) == file_name) & self.text.contains(word)
        if scope == "root_text":
            file_name, word = needle.split("|")
            return (self.path == file_name) & self.text.contains(word)
        if scope == "composer":
            return (self.path == "composer.json") & F.coalesce(
                F.map_contains_key(self._json_map("require"), needle), F.lit(False)
            )
        if scope == "composer_any":
            return (self.path == "composer.json") & F.coalesce(
                F.get_json_object("content", "$.require").contains(needle), F.lit(False)
            )
        if scope == "root_file":
            return self.path == needle
        if scope == "root_dir":
            return self.path.startswith(needle + "/")
        if scope == "segment":
            return F.exists(self.seen, lambda s: s.contains(needle))
        if scope == "path":
            return F.array_join(self.seen, "/").contains(needle)
        raise ValueError(f"unknown rule scope {scope!r}")


def match_rules(listing: DataFrame, rules=STACK_RULES) -> DataFrame:
    """Distinct (repo_id, category, label) of the rules that hit a file of the repository."""
    view = _Listing(listing)
    hits = F.array_compact(
        F.array(
            *[
                F.when(view.test(scope, needle), F.struct(F.lit(category).alias("category"), F.lit(label).alias("label")))
                for scope, needle, category, label in rules
            ]
        )
    )
    return view.rows.select("repo_id", F.explode(hits).alias("hit")).select("repo_id", "hit.*").distinct()


def stack_labels(listing: DataFrame, rules=STACK_RULES) -> DataFrame:
    """Long form of the stack report: distinct (repo_id, category, label)."""
    path = slashes(F.col("path"))
    roots = [F.bool_or(path.startswith(d + "/") | (path == d)).alias(d) for d in _MONOREPO_DIRS]
    monorepo = (
        listing.groupBy("repo_id").agg(*roots)
        .where(" AND ".join(_MONOREPO_DIRS))
        .select("repo_id", F.lit("frameworks").alias("category"), F.lit("Monorepo").alias("label"))
    )
    return match_rules(listing, rules).unionByName(monorepo)


def _label_set(category: str) -> Column:
    return F.array_sort(F.collect_set(F.when(F.col("category") == category, F.col("label"))))


def detect_stack(listing: DataFrame, rules=STACK_RULES) -> DataFrame:
    """Sorted languages, frameworks, databases and ci_cd per repository.

    ``listing`` has (repo_id, path, content); the content may be null for files no
    rule reads.  Repositories without a hit get empty arrays.
    """
    labels = stack_labels(listing, rules)
    stacks = labels.groupBy("repo_id").agg(*[_label_set(c).alias(c) for c in STACK_CATEGORIES])
    empty = F.array().cast("array<string>")
    return (
        listing.select("repo_id").distinct()
        .join(stacks, "repo_id", "left")
        .select("repo_id", *[F.coalesce(c, empty).alias(c) for c in STACK_CATEGORIES])
    )


# File names (lower case) that are entry points by themselves.
ENTRY_NAMES = (
    "main.py", "app.py", "server.py", "run.py", "main.go", "main.rs", "main.java", "main.kt",
    "program.cs", "app.rb",
)
ENTRY_SCRIPT_NAMES = ("index.js", "server.js", "main.js", "index.ts", "server.ts", "main.ts")
ENTRY_MANIFESTS = (
    "next.config.js", "next.config.ts", "manage.py", "wsgi.py", "asgi.py", "pom.xml", "build.gradle",
    "build.gradle.kts", "cargo.toml", "go.mod", "gemfile", "composer.json", "dockerfile",
)
# Suffixes whose text is searched, and the markers (lower case).
ENTRY_TEXT_SUFFIXES = (".py", ".js", ".ts", ".go", ".rs", ".java", ".cs")
ENTRY_MARKERS = (
    'if __name__ == "__main__"', "uvicorn.run", "fastapi(", "app.listen", "express()", "func main()",
    "fn main()", "public static void main", "webapplication.createbuilder",
)


def detect_entry_points(listing: DataFrame) -> DataFrame:
    """(repo_id, path) of the files a program starts from, ordered by path."""
    path = slashes(F.col("path"))
    name = F.lower(base_name(F.col("path")))
    text = F.lower(F.col("content"))
    outside_src = ~path.contains("src") | path.contains("server") | path.contains("api")
    by_name = (
        name.isin(*ENTRY_NAMES, *ENTRY_MANIFESTS)
        | (name.isin(*ENTRY_SCRIPT_NAMES) & outside_src)
        | (name.isin("app.tsx", "app.jsx") & path.contains("src"))
        | (name.isin("page.tsx", "page.jsx") & path.contains("app"))
        | (name.isin("index.tsx", "index.jsx") & path.contains("pages"))
    )
    # One pass over the text looks for all markers.
    marked = text.rlike("|".join(re.escape(m) for m in ENTRY_MARKERS))
    by_text = suffix(F.col("path")).isin(*ENTRY_TEXT_SUFFIXES) & F.coalesce(marked, F.lit(False))
    skipped = F.arrays_overlap(segments(F.col("path")), F.array(*[F.lit(d) for d in SKIP_DIRS]))
    return listing.where(~skipped & (by_name | by_text)).select("repo_id", path.alias("path")).distinct()


def rank_entry_points(entry_points: DataFrame, k: int) -> DataFrame:
    """First ``k`` entry points of each repository by path, with ``entry_rank``."""
    return top_k(entry_points, ["repo_id"], ["path"], k, "entry_rank")


# Import-name prefixes of external services, first match wins.
INTEGRATION_PREFIXES = (
    "stripe", "twilio", "sendgrid", "mailgun", "boto3", "botocore", "s3", "redis", "celery",
    "openai", "anthropic", "pinecone", "weaviate", "elasticsearch", "sentry_sdk", "datadog",
    "segment", "mixpanel", "firebase", "supabase", "prisma", "mongoengine", "pymongo",
    "google.cloud", "azure", "slack_sdk", "shopify", "hubspot",
)


def detect_integrations(symbols: DataFrame, prefixes=INTEGRATION_PREFIXES) -> DataFrame:
    """Distinct (repo_id, integration) of the import names that start with a known prefix."""
    name = F.lower(F.col("name"))
    label = F.coalesce(*[F.when(name.startswith(p), F.lit(p.split(".")[0])) for p in prefixes])
    return (
        of_kind(symbols, (IMPORT_KIND,))
        .select("repo_id", label.alias("integration"))
        .where(F.col("integration").isNotNull())
        .distinct()
    )
