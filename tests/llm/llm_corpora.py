"""Invented texts for the tests of the text operators."""

from __future__ import annotations

import re
import string

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(rng, n, vocabulary=4000):
    """Words with a skewed distribution, some capitalised, in lines and sentences."""
    out = []
    for i in range(n):
        w = "w" + "".join(string.ascii_lowercase[int(d)] for d in str(int(vocabulary * rng.random() ** 3)))
        out.append(w.capitalize() if rng.random() < 0.1 else w)
        if rng.random() < 0.05:
            out[-1] += rng.choice([".", ",", ".\n"])
    return " ".join(out)
