"""Words and lines as column expressions, shared by the text operators.

A word is a run of characters other than the six ASCII white-space characters
(space, tab, newline, vertical tab, form feed, carriage return).  No other character separates words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ASCII white space that separates words.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(text: Column) -> Column:
    """The text, a null as the empty string."""
    return F.coalesce(text, F.lit(""))


def lowered(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words in order; an empty array for a null or blank text."""
    spaced = F.translate(whole(text), BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.filter(F.split(spaced, " "), lambda w: w != F.lit(""))


def lines_with_words(text: Column) -> Column:
    """The \\n-separated lines that hold a word, unchanged."""
    blank = lambda line: F.translate(line, BLANKS, "") == F.lit("")
    return F.filter(F.split(whole(text), "\n"), lambda line: ~blank(line))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    lead = "_t_"
    while any(c.startswith(lead) for c in taken):
        lead = "_" + lead
    return [lead + n for n in names]


def own(docs: DataFrame, replaced=()) -> list[Column]:
    """The columns of ``docs`` apart from those that a result column replaces."""
    gone = {c.lower() for c in replaced}
    return [F.col(f"`{c}`") for c in docs.columns if c.lower() not in gone]
