"""The registered queries of the operators, with the SQL that states the same result where SQL can."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import Catalog
from stratacode.llm import (
    alignment, bottomk, compact_windows, decontaminate, divergence, histogram_sort, html_layout, interpolation, min_slack, packing, pu_quality,
    quality_rules, toxicity,
)
from stratacode.llm.staging import stage
from stratacode.llm.text import whole

C = Catalog()

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_crc32(column) -> F.Column:
    return F.crc32(whole(column).cast("binary"))


# --- 7: quality rules -------------------------------------------------------------------------

_STOP_LIST = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)


def _rule_sql(rule) -> str:
    under = rule.denominator or "1"
    tests = [f"{rule.scale} * {rule.numerator} >= {rule.low} * {under}"] if rule.low is not None else []
    tests += [f"{rule.scale} * {rule.numerator} <= {rule.high} * {under}"] if rule.high is not None else []
    return "(" + " AND ".join(tests) + ")"


QUALITY_MEASURED = rf"""
worded AS (
  SELECT doc_id, coalesce(text, '') AS body, {WORDS} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
windows AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM worded)),
repeated AS (
  SELECT doc_id, count(DISTINCT i + step) AS n
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS times FROM windows), (VALUES (0), (1), (2)) s(step)
  WHERE times > 1 GROUP BY doc_id),
measured AS (
  SELECT w.doc_id, len(ws) AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(body) - length(translate(body, '#*$%&|<>', '')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         len(list_filter(ls, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•●▪]'))) AS n_bullet_lines,
         len(list_filter(ls, lambda x: ends_with(rtrim(x, ' '), '...') OR ends_with(rtrim(x, ' '), '…'))) AS n_cut_lines,
         len(list_filter(ws, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({_STOP_LIST}))) AS n_stop_words,
         coalesce(r.n, 0) AS n_repeat_words
  FROM worded w LEFT JOIN repeated r ON w.doc_id = r.doc_id)"""
QUALITY_PASSES = " AND ".join(_rule_sql(r) for r in quality_rules.RULES)


@C.query("op7_quality_rules", f"""
WITH {QUALITY_MEASURED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       {QUALITY_PASSES} AS kept
FROM measured
""")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(quality_rules.measure(read(spark, sf_dir, "documents")))
    base = F.exists("failed_rules", lambda r: r.isin(*quality_rules.BASE_RULES))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         base.alias("base_failed"), "kept")


# --- 5: sharding by histogram sort ------------------------------------------------------------

SHARDS = 8


@C.query("op5_histogram_sort")
def op5_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = histogram_sort.histogram_sort(read(spark, sf_dir, "documents"), SHARDS)
    return sharded.select(
        "doc_id", histogram_sort.byte_size(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


# --- 3: packing ---------------------------------------------------------------------------------

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@C.query("op3_hierarchical_packing")
def op3_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(read(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
                         "tier", "step_group")


# --- 9: near duplicates by bottom-k sketches -----------------------------------------------------


@C.query("op9_bottom_k_near_dedup")
def op9_bottom_k_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(read(spark, sf_dir, "documents"))


# --- 2: benchmark decontamination ----------------------------------------------------------------


@C.query("op2_spaced_seed_decontamination")
def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_spans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


# --- 1: substring dedup --------------------------------------------------------------------------


@C.query("op1_compact_windows")
def op1_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated_passages(read(spark, sf_dir, "documents"))


# --- 4: toxicity by a classifier chain -------------------------------------------------------------

TOXIC_FROM = 0.5


@C.query("op4_toxicity_chain")
def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain runs over the two judgements of the labels: whether a text is of low quality, then whether it is toxic."""
    docs = read(spark, sf_dir, "documents")
    chain = toxicity.train(docs, read(spark, sf_dir, "labels"), {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    scored = toxicity.score(docs.select("doc_id", "text"), chain)
    return scored.select("doc_id", *[F.col(f"p_{c}") for c in chain.categories], (F.col("p_toxic") >= TOXIC_FROM).cast("int").alias("toxic"))


# --- 6: quality by positive-unlabelled learning ------------------------------------------------------


@C.query("op6_pu_quality")
def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").where(~held_out)
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality is not null")
    prior = pu_quality.estimated_prior(trusted)
    measured = pu_quality.measure(docs, ["doc_id"])
    measured = stage(measured.join(trusted.where("quality = 1").select("doc_id", F.lit(True).alias("positive")), "doc_id", "left"), "measured")
    model = pu_quality.fit(measured.where(~held_out), F.coalesce("positive", F.lit(False)), prior)
    score = pu_quality.score_column(model)
    return measured.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


# --- 8: language-model scores by deleted interpolation ----------------------------------------------


@C.query("op8_deleted_interpolation")
def op8_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return interpolation.score(read(spark, sf_dir, "documents"), held_out)


# --- 10: layout-aware text of web pages ---------------------------------------------------------------


@C.query("op10_html_layout")
def op10_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_layout.extract_text(read(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


# --- 11: source divergence audit ----------------------------------------------------------------------


def _distance_sql(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) // ({p} + {q}))"


@C.query("op11_count_cell_ranking", rf"""
WITH named AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
used AS (SELECT row, lang, source, unnest(terms) AS term FROM named),
kept AS (
  SELECT lang, term, count(*) AS n FROM used GROUP BY lang, term HAVING count(DISTINCT row) >= {divergence.MIN_DOCS}),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
held AS (
  SELECT u.lang, u.source, u.term, count(*) AS n FROM used u JOIN kept k ON u.lang = k.lang AND u.term = k.term GROUP BY u.lang, u.source, u.term),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(h.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM named) g LEFT JOIN held h ON g.lang = h.lang AND g.source = h.source GROUP BY g.lang, g.source),
rated AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
         (1 + ({divergence.SCALE} * (coalesce(h.n, 0) + 2)) // (g.total + 2 * s.v))::BIGINT AS p,
         (1 + ({divergence.SCALE} * (k.n + 2)) // (s.total + 2 * s.v))::BIGINT AS q
  FROM groups g JOIN sizes s ON g.lang = s.lang JOIN kept k ON g.lang = k.lang
  LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
pairs AS (
  SELECT x.lang, x.source, y.source AS item, sum({_distance_sql('x.p', 'y.p')}) AS value
  FROM rated x JOIN rated y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
told AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = o.source
  UNION ALL
  SELECT lang, source, 'term', term, {_distance_sql('p', 'q')}::BIGINT FROM rated WHERE n > 0 AND p > q)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM told)
WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}
""")
def op11_count_cell_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


# --- 12: best-fit packing by minimum bin slack ----------------------------------------------------------


@C.query("op12_minimum_bin_slack")
def op12_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = min_slack.pack_documents(read(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset").withColumn("piece", F.col("piece").cast("int"))


# --- 13: cross-tokenizer alignment ----------------------------------------------------------------------


@C.query("op13_fragment_monoid")
def op13_fragment_monoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).documents


# --- the pipeline -----------------------------------------------------------------------------------

C.query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
