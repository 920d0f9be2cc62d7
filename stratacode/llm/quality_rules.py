"""Quality rules: a threshold table compiled into native Spark projections.

``measure`` adds the counts of a text, ``judge`` turns a table of thresholds into one
boolean column per rule.  Everything is a column expression inside the scan: no shuffle, no
user function, and a row needs memory for its own text only.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacode.llm import text as T

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

# The most frequent function words of the four languages of the corpus; a parameter of ``measure``.
STOP_WORDS = tuple(sorted(set(
    "the of and to in that is was for with it as on be at by this are or from an not you a "
    "der die und das den in ist von zu mit auf für nicht im des dem ein eine auch sich "
    "le la les de des et est un une que qui en du pour dans sur pas au avec par "
    "el los las y del que se por con para una su al es lo como más".split()
)))


class Rule(NamedTuple):
    """``scale * numerator / denominator`` must lie in ``[low, high]``; an open end is None.

    With a denominator the test is written as a product, so it stays exact on whole numbers and
    has a value for a denominator of zero (0 times anything).
    """

    name: str
    numerator: str
    denominator: str | None
    low: float | None
    high: float | None
    scale: int = 100


# A document must pass all rules.  Ratios are percentages.
RULES = (
    Rule("too_short", "n_words", None, 50, None, 1),
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 40),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 30),
)
BASE_RULES = ("too_short", "repeated_words")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_bullet_lines", "n_cut_lines", "n_stop_words",
          "n_repeat_words")


def measure(docs: DataFrame, text_col: str = "text", stop_words: tuple[str, ...] = STOP_WORDS, prefix: str = "") -> DataFrame:
    """Add the counts of ``COUNTS`` (long, named ``prefix`` + count) to every row.

    Null, empty and blank texts count zero everywhere.  Input columns of the same name as a count are replaced;
    all others stay.  Rows are independent, so repeated rows get the same counts.
    """
    raw = F.col(f"`{text_col}`")
    body, ws, lines, wins, ordered = T.fresh(docs, "text", "words", "lines", "windows", "sorted")
    row = T.own(docs, [prefix + n for n in COUNTS])
    # Each select is a stage of one projection: an array that a later expression uses
    # several times is computed once.
    staged = docs.select(*row, T.whole(raw).alias(body), T.words(raw).alias(ws), T.lines_with_words(raw).alias(lines))
    last = F.size(ws) - 3
    at = lambda i: F.element_at(ws, i + 1)
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", at(i), at(i + 1), at(i + 2))))
    staged = staged.withColumn(wins, windows)
    # Windows sorted with their places: equal ones become neighbours.  A text without a repeated window needs no sort.
    unique = F.size(F.array_distinct(wins)) == F.size(wins)
    in_order = F.sort_array(F.transform(wins, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    staged = staged.withColumn(ordered, F.when(~unique, in_order))
    other = lambda j: F.try_element_at(ordered, j)["w"]
    same = lambda x, j: x["w"].eqNullSafe(F.when(j > 0, other(j))) | x["w"].eqNullSafe(other(j + 2))
    places = F.transform(F.filter(ordered, same), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
    counts = {
        "n_words": F.size(ws),
        "word_chars": F.length(F.translate(body, T.BLANKS, "")),
        "n_symbols": F.length(body) - F.length(F.translate(body, SYMBOLS, "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[-*•●▪]"))),
        "n_cut_lines": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
        "n_stop_words": F.size(F.filter(ws, lambda w: T.lowered(w).isin(*stop_words))) if stop_words else F.lit(0),
        "n_repeat_words": F.coalesce(F.size(F.array_distinct(F.flatten(places))), F.lit(0)),
    }
    return staged.select(*row, *[F.greatest(v, F.lit(0)).cast("bigint").alias(prefix + n) for n, v in counts.items()])


def passes(rule: Rule, prefix: str = "") -> Column:
    """The rule as a boolean expression over measured counts."""
    top = F.col(prefix + rule.numerator) * F.lit(rule.scale)
    under = F.col(prefix + rule.denominator) if rule.denominator else F.lit(1)
    tests = [] if rule.low is None else [top >= under * F.lit(rule.low)]
    tests += [] if rule.high is None else [top <= under * F.lit(rule.high)]
    if not tests:
        return F.lit(True)
    return tests[0] & tests[1] if len(tests) == 2 else tests[0]


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES, prefix: str = "") -> DataFrame:
    """Add ``failed_rules`` (names in table order) and ``kept`` (no rule failed)."""
    failed = F.array_compact(F.array(*[F.when(~passes(r, prefix), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    judged = measured.withColumn("failed_rules", failed)
    return judged.withColumn("kept", F.size("failed_rules") == 0)


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of ``docs`` that pass every rule, with their own columns only."""
    prefix, wall = T.fresh(docs, "quality_", "wall")
    # A filter over plain projections would be pushed below them and copy the array expressions into its own
    # lambdas, to be computed again for every word; it is not pushed through a row number.
    measured = measure(docs, text_col, prefix=prefix).withColumn(wall, F.monotonically_increasing_id())
    return measured.where(reduce(and_, [passes(r, prefix) for r in rules], F.col(wall) >= 0)).select(*T.own(docs))
