from __future__ import annotations

import random

import pytest
from llm_corpora import DOCS, prose


@pytest.fixture
def make(spark):
    """Documents from (id, text) pairs with all columns of the table and some that clash with helper names."""

    def build(pairs):
        rows = [(i, t, "en", "s", len(t or ""), "x", 1, True, "y") for i, t in pairs]
        return spark.createDataFrame(rows, DOCS + ", _t_key string, shard int, kept boolean, `print` string")

    return build


@pytest.fixture
def edge(make):
    """Nulls in every column, empty and blank texts, repeated rows, a very long text."""
    rng = random.Random(7)
    long = prose(rng, 60_000)
    pairs = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "a b c d e"), (6, "a b c d e"), (7, long), (8, long), (None, "no id at all"),
             (None, None), (9, prose(rng, 80)), (9, prose(rng, 70)), (10, "ÄÖ ß é́ \U0001f600 <|endoftext|> x y")]
    return make(pairs)
