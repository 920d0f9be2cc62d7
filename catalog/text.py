"""Chunks, retrieval and chat assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Catalog, table
from catalog.corpora import LINE_CORPUS, line_files, line_symbols
from stratacode.functions.text import preview, token_estimate
from stratacode.functions.vectors import cosine_distance
from stratacode.operators import chunks as ch
from stratacode.operators import retrieval as ret

C = Catalog()


@C.query("token_estimates", "SELECT doc_id, length(text) // 4 AS tokens, length(text) // 4 <= 2048 AS fits FROM documents")
def token_estimates(spark, d):
    from stratacode.functions.text import within_budget

    return table(spark, d, "documents").select(
        "doc_id", token_estimate(F.col("text")).cast("bigint").alias("tokens"), within_budget(F.col("text")).alias("fits")
    )


# Every third document has no symbol that is embedded for itself, so its file is chunked as a whole.
_CHUNK_KIND = "CASE WHEN file_id LIKE '%3' OR file_id LIKE '%6' OR file_id LIKE '%9' THEN 'variable' ELSE kind END"


def _chunk_symbols(spark, d):
    return line_symbols(spark, d).withColumn("kind", F.expr(_CHUNK_KIND))


_SOURCES = f"""{LINE_CORPUS.replace("symbols AS (", "line_symbols AS (")},
symbols AS (SELECT repo_id, symbol_id, file_id, {_CHUNK_KIND} AS kind, name, source_code, ordinal FROM line_symbols)"""

_SYMBOL_TEXTS = """symbol_texts AS (
  SELECT repo_id, 'symbol' AS source_type, symbol_id AS source_id, file_id,
         '# ' || path || chr(10) || '## ' || kind || ': ' || name || chr(10) || source_code AS chunk_text
  FROM symbols JOIN files USING (repo_id, file_id) WHERE kind IN ('function', 'class', 'method') AND source_code <> '')"""

_FILE_TEXTS = r"""rest AS (
  SELECT * FROM files f WHERE NOT EXISTS (SELECT 1 FROM symbol_chunks c WHERE c.repo_id = f.repo_id AND c.file_id = f.file_id)),
file_texts AS (
  SELECT repo_id, 'symbol' AS source_type, file_id AS source_id, file_id,
         '# ' || path || chr(10) || string_agg(source_code, chr(10) ORDER BY ordinal) AS chunk_text
  FROM symbols JOIN rest USING (repo_id, file_id) WHERE source_code <> '' GROUP BY repo_id, file_id, path
  HAVING bool_or(regexp_matches(source_code, '\S')))"""

_COMMIT_TEXTS = """commit_texts AS (
  SELECT role AS repo_id, 'commit' AS source_type, sha1(conv_id || '-' || turn) AS source_id, NULL::VARCHAR AS file_id,
         '# Commit ' || left(sha1(conv_id || '-' || turn), 8) || ' by user ' || conv_id || chr(10) || text AS chunk_text FROM conversations)"""
_PR_TEXTS = r"""pr_texts AS (
  SELECT 'user' AS repo_id, 'pull_request' AS source_type, item_id::VARCHAR AS source_id, NULL::VARCHAR AS file_id,
         regexp_replace('# PR #' || item_id || ': Item ' || item_id || chr(10) || text, '\s+$', '') AS chunk_text FROM benchmark)"""
_README_TEXTS = """readme_texts AS (
  SELECT 'doc' || doc_id AS repo_id, 'document' AS source_type, 'doc' || doc_id AS source_id, NULL::VARCHAR AS file_id,
         '# README' || chr(10) || text AS chunk_text FROM documents WHERE text <> '')"""

_WINDOW = 8195


def _fitted_sql(texts: str, chunks: str, oversize: str) -> str:
    """Common table expression of the chunks made of texts."""
    if oversize == "drop":
        return f"{chunks} AS (SELECT * FROM {texts} WHERE length(chunk_text) <= {_WINDOW})"
    return f"""{chunks} AS (
  SELECT repo_id, source_type, source_id || CASE WHEN part = 0 THEN '' ELSE chr(31) || part END AS source_id, file_id,
         substr(chunk_text, part * {_WINDOW} + 1, {_WINDOW}) AS chunk_text
  FROM (SELECT *, unnest(range(greatest(1, (length(chunk_text) + {_WINDOW - 1}) // {_WINDOW}))) AS part FROM {texts}))"""


def _chunk_sql(oversize: str) -> str:
    made = [(_SYMBOL_TEXTS, "symbol"), (_FILE_TEXTS, "file"), (_COMMIT_TEXTS, "commit"), (_PR_TEXTS, "pr"), (_README_TEXTS, "readme")]
    return ",\n".join([_SOURCES, *(f"{texts},\n{_fitted_sql(f'{name}_texts', f'{name}_chunks', oversize)}" for texts, name in made)])


_SPLIT, _DROP = _chunk_sql("split"), _chunk_sql("drop")
_ALL_CHUNKS = " UNION ALL ".join(f"SELECT * FROM {name}_chunks" for name in ("symbol", "file", "commit", "pr", "readme"))


def _commits(spark, d):
    return table(spark, d, "conversations").selectExpr(
        "role AS repo_id", "sha1(concat(conv_id, '-', turn)) AS hash", "concat('user ', conv_id) AS author_name", "text AS message"
    )


def _requests(spark, d):
    return table(spark, d, "benchmark").selectExpr(
        "'user' AS repo_id", "CAST(item_id AS INT) AS number", "concat('Item ', item_id) AS title", "text AS description"
    )


def _readmes(spark, d):
    return table(spark, d, "documents").selectExpr("concat('doc', doc_id) AS repo_id", "text AS content")


def _all_chunks(spark, d, **options):
    return ch.build_chunks(_chunk_symbols(spark, d), line_files(spark, d), _commits(spark, d), _requests(spark, d), _readmes(spark, d), **options)


@C.query("symbol_chunks", f"WITH {_SPLIT} SELECT * FROM symbol_chunks")
def symbol_chunks(spark, d):
    return ch.symbol_chunks(_chunk_symbols(spark, d), line_files(spark, d))


@C.query("skipped_chunks", f"""WITH {_SPLIT}
SELECT repo_id, count(*) FILTER (length(chunk_text) // 4 <= 2048) AS kept,
       count(*) FILTER (length(chunk_text) // 4 > 2048) AS skipped FROM symbol_texts GROUP BY 1""")
def skipped_chunks(spark, d):
    return ch.skipped_counts(_chunk_symbols(spark, d), line_files(spark, d))


@C.query("file_chunks", f"WITH {_SPLIT} SELECT * FROM file_chunks")
def file_chunks(spark, d):
    symbols, files = _chunk_symbols(spark, d), line_files(spark, d)
    return ch.file_chunks(symbols, files, ch.symbol_chunks(symbols, files))


@C.query("file_chunk_lengths", f"WITH {_SPLIT} SELECT repo_id, file_id, length(chunk_text)::BIGINT AS chars, (length(chunk_text) + {_WINDOW - 1}) // {_WINDOW} AS n_windows FROM file_texts")
def file_chunk_lengths(spark, d):
    """The windows of a file add up to its text."""
    return file_chunks(spark, d).groupBy("repo_id", "file_id").agg(F.sum(F.length("chunk_text")).alias("chars"), F.count(F.lit(1)).alias("n_windows"))


@C.query("unembedded_files", f"WITH {_SPLIT} SELECT repo_id, file_id, path FROM rest")
def unembedded_files(spark, d):
    symbols, files = _chunk_symbols(spark, d), line_files(spark, d)
    return ch.unembedded_files(files, ch.symbol_chunks(symbols, files))


@C.query("commit_chunks", f"WITH {_SPLIT} SELECT * FROM commit_chunks")
def commit_chunks(spark, d):
    return ch.commit_chunks(_commits(spark, d))


@C.query("pr_chunks", f"WITH {_SPLIT} SELECT * FROM pr_chunks")
def pr_chunks(spark, d):
    return ch.pr_chunks(_requests(spark, d))


@C.query("doc_chunks", f"WITH {_SPLIT} SELECT * FROM readme_chunks")
def doc_chunks(spark, d):
    return ch.doc_chunks(_readmes(spark, d))


@C.query("build_chunks", f"WITH {_SPLIT} {_ALL_CHUNKS}")
def build_chunks(spark, d):
    return _all_chunks(spark, d)


@C.query("build_chunks_dropping", f"WITH {_DROP} {_ALL_CHUNKS}")
def build_chunks_dropping(spark, d):
    """The form that leaves out what exceeds the budget."""
    return _all_chunks(spark, d, oversize="drop")


@C.query("build_chunks_of_symbol_repos", f"WITH {_SPLIT} SELECT * FROM symbol_chunks UNION ALL SELECT * FROM file_chunks")
def build_chunks_of_symbol_repos(spark, d):
    return _all_chunks(spark, d, require_symbols=True)


@C.query("hash_embeddings", f"""WITH {_SPLIT}, words AS (
  SELECT source_id, ('0x' || left(md5(lower(word)), 8))::BIGINT % 64 AS dim_no FROM (
    SELECT source_id, unnest(regexp_extract_all(chunk_text, '[A-Za-z0-9_]+')) AS word FROM readme_chunks)),
counts AS (SELECT source_id, dim_no, count(*) AS n FROM words GROUP BY 1, 2)
SELECT source_id, dim_no, round((n / sqrt(sum(n * n) OVER (PARTITION BY source_id)))::FLOAT::DOUBLE, 6) AS value FROM counts""")
def hash_embeddings(spark, d):
    """Every number of the vectors that is not zero."""
    chunks = ch.embed_chunks(ch.doc_chunks(_readmes(spark, d)), dim=64)
    numbers = chunks.select("source_id", F.posexplode("embedding").alias("dim_no", "value")).where("value <> 0")
    return numbers.select("source_id", F.col("dim_no").cast("bigint").alias("dim_no"), F.round(F.col("value").cast("double"), 6).alias("value"))


@C.query("cosine_distances", """SELECT a.vec_id,
  round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_distances(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = table(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", (F.round(cosine_distance(F.col("a"), F.col("b")), 6) + 0.0).alias("distance"))


# Every vector asks for its neighbours among the vectors with its label.  Some have no direction: a number that is none or infinite, or all zeros.
_ODD_VECTOR = (
    "CASE vec_id % 50 WHEN 3 THEN transform(embedding, (x, i) -> IF(i = 0, CAST('NaN' AS FLOAT), CAST(x AS FLOAT))) "
    "WHEN 7 THEN transform(embedding, (x, i) -> IF(i = 1, CAST('Infinity' AS FLOAT), CAST(x AS FLOAT))) "
    "WHEN 11 THEN transform(embedding, x -> CAST(0 AS FLOAT)) ELSE CAST(embedding AS ARRAY<FLOAT>) END AS embedding"
)
_ODD = "vec_id % 50 IN (3, 7, 11)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").selectExpr(
        "concat('repo', label) AS repo_id",
        "CASE vec_id % 4 WHEN 0 THEN 'symbol' WHEN 1 THEN 'commit' WHEN 2 THEN 'pull_request' ELSE 'document' END AS source_type",
        "CASE vec_id % 4 WHEN 0 THEN concat('P', vec_id) WHEN 1 THEN sha1(CAST(vec_id AS STRING)) ELSE CAST(vec_id AS STRING) END AS source_id",
        "CASE WHEN vec_id % 4 = 0 THEN concat('f', vec_id) END AS file_id",
        "concat('chunk ', vec_id) AS chunk_text", _ODD_VECTOR,
    )


def _questions(spark, d):
    return table(spark, d, "embeddings").selectExpr(
        "concat('repo', label) AS repo_id", "CAST(vec_id AS STRING) AS query_id", "concat('question ', vec_id) AS question", _ODD_VECTOR
    )


_VECTORS = f"""vectors AS (
  SELECT vec_id, 'repo' || label AS repo_id,
         CASE vec_id % 4 WHEN 0 THEN 'symbol' WHEN 1 THEN 'commit' WHEN 2 THEN 'pull_request' ELSE 'document' END AS source_type,
         CASE vec_id % 4 WHEN 0 THEN 'P' || vec_id WHEN 1 THEN sha1(vec_id::VARCHAR) ELSE vec_id::VARCHAR END AS source_id,
         'chunk ' || vec_id AS chunk_text, embedding::DOUBLE[] AS embedding FROM embeddings),
pairs AS (
  SELECT q.repo_id, q.vec_id::VARCHAR AS query_id, 'question ' || q.vec_id AS question, v.source_type, v.source_id, v.vec_id, v.chunk_text,
         round(list_cosine_distance(v.embedding, q.embedding), 9) AS distance
  FROM vectors q JOIN vectors v USING (repo_id) WHERE NOT (q.{_ODD}) AND NOT (v.{_ODD}))"""

_HITS = f"""{_VECTORS}, typed AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id, query_id, source_type ORDER BY distance, source_id) AS type_rank,
         CASE source_type WHEN 'symbol' THEN 0 WHEN 'commit' THEN 1 WHEN 'pull_request' THEN 2 ELSE 3 END AS type_no FROM pairs),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id, query_id ORDER BY type_no, type_rank)::INT AS hit_no FROM typed
  WHERE type_rank <= CASE source_type WHEN 'symbol' THEN 6 WHEN 'commit' THEN 2 ELSE 1 END)"""


@C.query("vector_topk", f"""WITH {_VECTORS}
SELECT repo_id, query_id, source_id, distance + 0.0 AS distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id, query_id ORDER BY distance, source_id)::INT AS rank FROM pairs) WHERE rank <= 10""")
def vector_topk(spark, d):
    return ret.vector_topk(_vectors(spark, d), _questions(spark, d)).withColumn("distance", F.col("distance") + 0.0)


@C.query("quota_topk", f"WITH {_HITS} SELECT repo_id, query_id, source_type, source_id, distance + 0.0 AS distance, hit_no FROM hits")
def quota_topk(spark, d):
    return ret.quota_topk(_vectors(spark, d), _questions(spark, d)).withColumn("distance", F.col("distance") + 0.0)


_RESOLVED = f"""{_HITS}, sources AS (
  SELECT h.repo_id, query_id, question, hit_no, source_type, source_id, chunk_text,
         CASE WHEN source_type = 'symbol' THEN lower(p_type) || '/p' || p_partkey || '.py' END AS file_path,
         CASE WHEN p_size % 5 > 0 THEN p_name END AS symbol_name, CASE WHEN p_size % 5 > 0 THEN p_size END AS start_line,
         CASE WHEN p_size % 5 > 0 THEN p_size + 5 END AS end_line,
         CASE WHEN o_orderkey IS NOT NULL THEN source_id END AS commit_hash, o_orderpriority AS author_name,
         s_suppkey::INT AS pr_number, s_name AS pr_title
  FROM hits h LEFT JOIN part ON source_type = 'symbol' AND p_partkey = vec_id
  LEFT JOIN orders ON source_type = 'commit' AND o_orderkey = vec_id
  LEFT JOIN supplier ON source_type = 'pull_request' AND s_suppkey = vec_id)"""


def _sources(spark, d):
    """Symbols are parts, commits orders, pull requests suppliers; some of them are missing."""
    vectors = _vectors(spark, d)
    place = vectors.select("repo_id", "source_type", "source_id")

    def of_type(kind):
        return place.where(F.col("source_type") == kind).select("repo_id", "source_id")

    part = table(spark, d, "part")
    symbols = part.where("p_size % 5 > 0").selectExpr(
        "concat('P', p_partkey) AS source_id", "p_name AS name", "p_size AS start_line", "p_size + 5 AS end_line"
    ).join(of_type("symbol"), "source_id").withColumnRenamed("source_id", "symbol_id")
    files = part.selectExpr(
        "concat('P', p_partkey) AS source_id", "concat('f', p_partkey) AS file_id", "concat(lower(p_type), '/p', p_partkey, '.py') AS path"
    ).join(of_type("symbol"), "source_id")
    commits = table(spark, d, "orders").selectExpr(
        "sha1(CAST(o_orderkey AS STRING)) AS source_id", "o_orderpriority AS author_name"
    ).join(of_type("commit"), "source_id").withColumnRenamed("source_id", "hash")
    requests = table(spark, d, "supplier").selectExpr(
        "CAST(s_suppkey AS STRING) AS source_id", "CAST(s_suppkey AS INT) AS number", "s_name AS title"
    ).join(of_type("pull_request"), "source_id")
    hits = ret.quota_topk(vectors, _questions(spark, d))
    return ret.resolve_sources(hits, vectors, symbols, files, commits, requests)


@C.query("resolve_sources", f"""WITH {_RESOLVED}
SELECT repo_id, query_id, hit_no, source_type, source_id, chunk_text, file_path, symbol_name, start_line::VARCHAR AS start_line,
       end_line::VARCHAR AS end_line, commit_hash, author_name, pr_number::VARCHAR AS pr_number, pr_title FROM sources""")
def resolve_sources(spark, d):
    text = {c: F.col(c).cast("string") for c in ("start_line", "end_line", "pr_number")}
    return _sources(spark, d).drop("distance").withColumns(text)


_CONTEXT = f"""{_RESOLVED}, blocks AS (
  SELECT *, '[Source ' || hit_no || '] ' || CASE source_type
    WHEN 'symbol' THEN '[Code] ' || coalesce(file_path, 'None') || ' — ' || coalesce(symbol_name, 'None') || ' (lines ' ||
                       coalesce(start_line::VARCHAR, 'None') || '–' || coalesce(end_line::VARCHAR, 'None') || ')'
    WHEN 'commit' THEN '[Commit] ' || coalesce(commit_hash, 'None') || ' by ' || coalesce(author_name, 'None')
    WHEN 'pull_request' THEN '[PR #' || coalesce(pr_number::VARCHAR, 'None') || '] ' || coalesce(pr_title, 'None')
    ELSE '[README]' END || chr(10) || chunk_text AS block FROM sources),
contexts AS (
  SELECT repo_id, query_id, any_value(question) AS question, count(*) AS n_sources,
         string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY hit_no) AS context FROM blocks GROUP BY 1, 2)"""


@C.query("build_context", f"""WITH {_CONTEXT}
SELECT q.repo_id, vec_id::VARCHAR AS query_id, 'question ' || vec_id AS question, context, coalesce(n_sources, 0) AS n_sources,
       CASE WHEN n_sources IS NULL THEN '{ret.NO_HIT_ANSWER}' END AS answer
FROM vectors q LEFT JOIN contexts c ON c.repo_id = q.repo_id AND c.query_id = vec_id::VARCHAR""")
def build_context(spark, d):
    return ret.build_context(_sources(spark, d), _questions(spark, d))


@C.query("citations", f"""WITH {_RESOLVED}
SELECT repo_id, query_id, hit_no,
  CASE source_type WHEN 'symbol' THEN symbol_name WHEN 'commit' THEN coalesce(left(commit_hash, 7), author_name, '')
       WHEN 'pull_request' THEN 'PR #' || coalesce(pr_number::VARCHAR, 'None') ELSE 'Source' END AS primary_label,
  CASE WHEN file_path IS NOT NULL THEN 'https://h/' || repo_id || '/blob/master/' || file_path || '#L' || start_line || '-L' || end_line
       WHEN commit_hash IS NOT NULL THEN 'https://h/' || repo_id || '/commit/' || commit_hash
       WHEN pr_number IS NOT NULL THEN 'https://h/' || repo_id || '/pull/' || pr_number END AS href FROM sources""")
def citations(spark, d):
    repos = _vectors(spark, d).select("repo_id").distinct().withColumn("github_url", F.concat(F.lit("https://h/"), "repo_id"))
    return ret.with_citation(_sources(spark, d), repos).select("repo_id", "query_id", "hit_no", "primary_label", "href")


# Conversations: the last turn asks, the turns before it are the history.
def _turns(spark, d):
    said = table(spark, d, "conversations").selectExpr(
        "'chat' AS repo_id", "CAST(conv_id AS STRING) AS query_id", "turn", "role", "text AS content"
    )
    last = said.groupBy("repo_id", "query_id").agg(F.max("turn").alias("last"), F.max_by("content", "turn").alias("question"))
    return said.join(last, ["repo_id", "query_id"]).where("turn < last").drop("last", "question"), last


@C.query("last_turns", """WITH numbered AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations)
SELECT conv_id::VARCHAR AS query_id, turn, role, text AS content FROM numbered WHERE age BETWEEN 2 AND 6""")
def last_turns(spark, d):
    return ret.last_turns(_turns(spark, d)[0]).drop("repo_id")


@C.query("chat_messages", """WITH numbered AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations)
SELECT conv_id::VARCHAR AS query_id, count(*) + 1 AS n_messages,
       'INFO' || chr(10) || chr(10) || '## Context' || chr(10) || 'conversation ' || conv_id || chr(10) || chr(10) || '## Question' || chr(10) ||
       max(CASE WHEN age = 1 THEN text END) AS system_text,
       string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (age BETWEEN 2 AND 6) AS history,
       max(CASE WHEN age = 1 THEN text END) AS question
FROM numbered WHERE age <= 6 GROUP BY conv_id""")
def chat_messages(spark, d):
    turns, last = _turns(spark, d)
    contexts = last.select(
        "repo_id", "query_id", "question", F.concat(F.lit("conversation "), "query_id").alias("context"), F.lit(1).alias("n_sources")
    )
    m = F.col("messages")
    n = F.size(m)
    history = F.slice(m, F.lit(2), n - 2)
    return ret.build_messages(contexts, turns, "INFO").select(
        "query_id", n.cast("bigint").alias("n_messages"), m[0]["content"].alias("system_text"),
        F.when(n > 2, F.array_join(F.transform(history, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")).alias("history"),
        F.element_at(m, -1)["content"].alias("question"),
    )


@C.query("previews", """SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS shown FROM documents""")
def previews(spark, d):
    return table(spark, d, "documents").select("doc_id", preview(F.col("text"), 300).alias("shown"))
