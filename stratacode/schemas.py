"""Spark DDL of the canonical tables."""

SOURCE_FILES = "repo_id string, path string, content string"

LISTING = "repo_id string, path string, size bigint, content string"

REPOSITORIES = (
    "repo_id string, repo_number int, user_id string, github_url string, name string, "
    "default_branch string, primary_language string, status string, "
    "detected_stack struct<languages:array<string>,frameworks:array<string>,"
    "databases:array<string>,ci_cd:array<string>>, "
    "entry_points array<string>, architecture_summary string, "
    "created_at timestamp, updated_at timestamp"
)

FILES = (
    "repo_id string, file_id string, path string, language string, loc int, fan_in int, "
    "fan_out int, criticality string, criticality_reasons array<string>, "
    "change_frequency double, has_tests boolean, git_last_modified timestamp"
)

SYMBOLS = (
    "repo_id string, symbol_id string, file_id string, kind string, name string, "
    "start_line int, end_line int, source_code string, cyclomatic_complexity int, ordinal int"
)

DEPENDENCIES = "repo_id string, source_symbol_id string, target_symbol_id string, dep_type string"

LOG_LINES = "repo_id string, line_no bigint, line string"

COMMITS = (
    "repo_id string, hash string, author_name string, author_email string, message string, "
    "files_changed int, authored_at timestamp, log_pos bigint, date_ok boolean"
)

COMMIT_FILES = (
    "repo_id string, hash string, log_pos bigint, line_no bigint, path string, added int, deleted int, "
    "author_email string, author_name string, ts timestamp"
)

PULL_REQUESTS_RAW = (
    "repo_id string, number int, title string, body string, user struct<login:string>, "
    "requested_reviewers array<struct<login:string>>, changed_files int, "
    "merged_at string, updated_at string"
)

PULL_REQUESTS = (
    "repo_id string, number int, title string, description string, author string, "
    "reviewers array<string>, files_changed int, merged_at timestamp"
)

CODE_OWNERS = (
    "repo_id string, file_id string, primary_owner string, "
    "contributors array<struct<email:string,name:string,commit_count:bigint,"
    "percentage:double,last_commit:string>>, bus_factor int, is_knowledge_silo boolean"
)

EMBEDDINGS = (
    "repo_id string, source_type string, source_id string, file_id string, "
    "chunk_text string, embedding array<float>"
)

GLOSSARY = (
    "repo_id string, symbol_id string, name string, definition string, "
    "file_path string, line_number int"
)

READING_ORDER = (
    "repo_id string, file_id string, path string, fan_in int, fan_out int, language string, "
    "tier int, position bigint, annotation string"
)

GUIDES = (
    "repo_id string, reading_order array<struct<path:string,position:bigint,annotation:string>>, critical_files array<struct<path:string,criticality:string,"
    "reasons:array<string>>>, key_modules array<struct<path:string,fan_in:int>>, architecture_narrative string, generated_at timestamp"
)

PROGRESS_EVENTS = (
    "repo_id string, event_id bigint, event string, message string, ts timestamp, status string"
)

TABLES = {
    "repositories": REPOSITORIES,
    "files": FILES,
    "symbols": SYMBOLS,
    "dependencies": DEPENDENCIES,
    "commits": COMMITS,
    "pull_requests": PULL_REQUESTS,
    "code_owners": CODE_OWNERS,
    "embeddings": EMBEDDINGS,
    "glossary": GLOSSARY,
    "reading_order": READING_ORDER,
    "guides": GUIDES,
    "progress_events": PROGRESS_EVENTS,
}

# Child tables removed together with a repository, and the column that links them.
REPO_CHILDREN = (
    "files", "symbols", "dependencies", "commits", "pull_requests", "code_owners",
    "embeddings", "glossary", "reading_order", "guides",
    "progress_events",
)
