"""Column functions for chunk texts and token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratacode.functions.paths import strip_ws

CHARS_PER_TOKEN = 4
MAX_CHUNK_TOKENS = 2048
PART_MARK = "\x1f"  # stands between the id of a source and the number of a later part of its text


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("int")


def within_budget(text: Column, max_tokens: int = MAX_CHUNK_TOKENS) -> Column:
    """``token_estimate(text) <= max_tokens`` as one comparison on the length."""
    return F.length(text) < F.lit((max_tokens + 1) * CHARS_PER_TOKEN)


def window_chars(max_tokens: int = MAX_CHUNK_TOKENS) -> int:
    """The longest text within the budget, in characters."""
    return (max_tokens + 1) * CHARS_PER_TOKEN - 1


def windows(text: Column, size: int) -> Column:
    """The text in consecutive windows of ``size`` characters, in one pass over it; an empty text has none."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def parts_within_budget(text: Column, max_tokens: int = MAX_CHUNK_TOKENS) -> Column:
    """The text in consecutive windows within the budget; an empty text is one window."""
    size = window_chars(max_tokens)
    return F.when(F.length(text) <= size, F.array(text)).otherwise(windows(text, size))


def symbol_chunk(path: Column, kind: Column, name: Column, source: Column) -> Column:
    return F.concat(F.lit("# "), path, F.lit("\n## "), kind, F.lit(": "), name, F.lit("\n"), source)


def commit_chunk(hash_: Column, author: Column, message: Column) -> Column:
    return F.concat(F.lit("# Commit "), F.left(hash_, F.lit(8)), F.lit(" by "), author, F.lit("\n"), message)


def pull_request_chunk(number: Column, title: Column, description: Column) -> Column:
    body = F.concat(
        F.lit("# PR #"), number.cast("string"), F.lit(": "), title, F.lit("\n"),
        F.coalesce(description, F.lit("")),
    )
    return strip_ws(body)


def readme_chunk(content: Column) -> Column:
    return F.concat(F.lit("# README\n"), content)


def file_chunk(path: Column, symbol_sources: Column) -> Column:
    return F.concat(F.lit("# "), path, F.lit("\n"), symbol_sources)


def preview(text: Column, limit: int) -> Column:
    """Text cut to ``limit`` characters, marked with ``...`` when something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)
