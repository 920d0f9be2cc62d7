"""Toxicity categories by a classifier chain.

Categories are predicted in a fixed order.  The linear model of a category sees the words and word beginnings of a text and the
probabilities of all earlier categories.  While training, those probabilities come from models that did not
see the row (out-of-fold), so later models learn from inputs of the quality they will get.

The chain is fitted on a bounded sample of labelled rows (``max_rows``, by hash of the id) on the driver; every document is scored
where it is read, with a model of at most ``max_features`` weights per category.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st

from stratacode.llm.linear import SparseRows, fit_logistic, logit, sigmoid
from stratacode.llm.shingles import span_hashes, word_spans

MAX_ROWS, MAX_FEATURES, FOLDS, LEAST_ROWS = 8_000, 4_096, 3, 5
STARTS = (5, 6, 7)  # bytes of a word's beginning that count as a feature of their own
_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?\"'()")] = True


def text_features(text: str | None) -> np.ndarray:
    """Hashes of the words (without closing marks, A-Z lower-cased) and of their beginnings; with repeats."""
    data, starts, ends = word_spans(text)
    for _ in range(3):
        ends = ends - (_MARKS[data[ends - 1]] & (ends - starts > 1)) if len(ends) else ends
    parts = [span_hashes(data, starts, ends)]
    for n in STARTS:
        longer = ends - starts > n
        parts.append(span_hashes(data, starts[longer], starts[longer] + n) + np.uint64(n))
    return np.concatenate(parts)


@dataclass
class Chain:
    """Chosen features (ascending hashes) and one weight vector per category: features, earlier logits, intercept."""

    categories: tuple[str, ...]
    features: np.ndarray
    weights: list[np.ndarray]

    def probabilities(self, text: str | None) -> list[float]:
        found = text_features(text)
        at = np.searchsorted(self.features, found)
        at[at == len(self.features)] = 0
        present = np.unique(at[self.features[at] == found]) if len(self.features) else at[:0]
        out: list[float] = []
        for w in self.weights:
            z = w[present].sum() + w[-1] + sum(w[len(self.features) + i] * logit(np.float64(p)) for i, p in enumerate(out))
            out.append(float(sigmoid(z)))
        return out


def _choose(hashes: list[np.ndarray], y: np.ndarray, most: int) -> np.ndarray:
    """The features whose presence tells most about any category, of those in at least ``LEAST_ROWS`` rows."""
    flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    row = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    values, column, rows = np.unique(flat, return_inverse=True, return_counts=True)
    best = np.zeros(len(values))
    for k in range(y.shape[1]):
        rate = y[:, k].mean() if len(y) else 0.0
        if 0 < rate < 1:
            seen = np.bincount(column, y[row, k], len(values))
            best = np.maximum(best, np.abs(seen - rows * rate) / np.sqrt(rows * rate * (1 - rate)))
    best[rows < LEAST_ROWS] = 0
    keep = np.argsort(-best, kind="stable")[:most]
    return np.sort(values[keep[best[keep] > 3.0]])


def fit_chain(texts: Sequence[str | None], labels: np.ndarray, folds: np.ndarray, categories: tuple[str, ...], max_features: int = MAX_FEATURES) -> Chain:
    """``labels`` is rows x categories of 0/1; ``folds`` numbers the rows' folds."""
    hashes = [np.unique(text_features(t)) for t in texts]
    y = labels.astype(np.float64).reshape(len(hashes), len(categories))
    chosen = _choose(hashes, y, max_features)
    row, column = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, h in enumerate(hashes):
        at = np.searchsorted(chosen, h)
        at[at == len(chosen)] = 0
        hit = at[chosen[at] == h] if len(chosen) else at[:0]
        row.append(np.full(len(hit), i))
        column.append(hit)
    row, column = np.concatenate(row), np.concatenate(column)
    earlier, weights = np.empty((len(hashes), 0)), []
    for k in range(len(categories)):
        x = SparseRows(row, column, len(hashes), len(chosen), np.hstack([earlier, np.ones((len(hashes), 1))]))
        out_of_fold = np.full(len(hashes), y[:, k].mean() if len(hashes) else 0.0)
        for fold in np.unique(folds):
            inside = folds == fold
            if inside.all():
                continue
            w = fit_logistic(x.take(~inside), y[~inside, k])
            out_of_fold[inside] = sigmoid(x.take(inside).score(w))
        weights.append(fit_logistic(x, y[:, k]))
        earlier = np.hstack([earlier, logit(out_of_fold)[:, None]])
    return Chain(categories, chosen, weights)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS,
          max_features: int = MAX_FEATURES, folds: int = FOLDS) -> Chain:
    """Fit the chain on at most ``max_rows`` labelled documents, those with the smallest id hash.

    ``categories`` maps each category, in chain order, to a 0/1 or boolean expression over the columns of ``labels`` and the text.  Rows with a null id
    or category are not used, a repeated id counts as labelled when any of its rows is.  Without labelled rows every probability is one half.
    """
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    order = F.xxhash64(key)
    ids = labels.where(key.isNotNull()).select(key).distinct().orderBy(order, key).limit(max_rows)
    # The sample is bounded by max_rows, so it may be broadcast to where the texts are.
    chosen = labels.join(F.broadcast(ids), id_col, "left_semi").orderBy(order).limit(4 * max_rows)
    # One text an id, the one of the least hash: ids bound the sample, however often one repeats in ``docs``.
    mine = docs.select(key, text).join(F.broadcast(ids), id_col).groupBy(id_col).agg(F.min_by(text, F.xxhash64(text)).alias(text_col))
    marked = mine.join(F.broadcast(chosen), id_col).select(key, text, *[c.cast("int").alias(n) for n, c in categories.items()])
    sample = (
        marked.dropna(subset=[id_col, *categories]).groupBy(id_col, text_col).agg(*[F.max(c).alias(c) for c in categories])
        .select(text.alias("_text"), F.pmod(order, F.lit(folds)).cast("int").alias("_fold"), *categories).toPandas()
    )
    names = tuple(categories)
    return fit_chain(list(sample["_text"]), sample[list(names)].to_numpy(), sample["_fold"].to_numpy(), names, max_features)


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``p_<category>`` (double) for each category; null and empty texts get the intercepts.

    Input columns named like a result column are replaced.
    """
    names = [f"p_{c}" for c in chain.categories]
    replaced = {n.lower() for n in names}
    kept = [c for c in docs.columns if c.lower() not in replaced]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    model = docs.sparkSession.sparkContext.broadcast(chain)
    place = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.probabilities(t) for t in batch.column(place).to_pylist()]
            columns = [pa.array([p[k] for p in found], pa.float64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*kept, *names])

    return rows.mapInArrow(run, st.StructType([*rows.schema.fields, *[st.StructField(n, st.DoubleType()) for n in names]]))
