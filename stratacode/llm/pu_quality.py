"""Quality by positive-unlabelled learning with a non-negative risk.

Trusted positives and unlabelled web text train a linear model of text statistics; no document serves as a negative.  With the class
prior pi the risk is ``pi E_p[loss(g)] + max(0, E_u[loss(-g)] - pi E_p[loss(-g)])``: the second term estimates the loss
on the unseen negatives and is kept from falling below zero, where the model would only fit noise.

The statistics of every text are taken once and staged as a narrow table.  Each descent step is one aggregate over all of its rows; only
the sums of the gradient, as many numbers as there are statistics, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st

from stratacode.llm.linear import sigmoid
from stratacode.llm.quality_rules import STOP_WORDS, SYMBOLS
from stratacode.llm.shingles import shingle_hashes, span_hashes, word_hashes, word_spans

STEPS, RATE, PENALTY = 40, 0.3, 1e-4

STATISTICS = ("length", "short", "mean_word", "spread_word", "symbols", "any_symbols", "marks", "shouts", "capitals", "digits", "stop_words", "few_stop_words",
              "distinct", "echo", "repeats", "repeated_lines", "line_length", "alone_lines")

_SYMBOL, _MARK, _CAPITAL, _LETTER, _DIGIT = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(SYMBOLS.encode())] = True
_MARK[list(b".,;:?")] = True
_CAPITAL[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
_STOPS = np.sort(word_hashes(" ".join(STOP_WORDS)))


def statistics(text: str | None) -> np.ndarray:
    """Bounded statistics of a whole text, all zero but ``short`` for a text without words."""
    raw, starts, ends = word_spans(text, lower=False)
    out = dict.fromkeys(STATISTICS, 0.0)
    n = len(starts)
    out["short"] = 1.0 if n < 50 else 0.0
    if n:
        hashes = word_hashes(text)
        sizes = ends - starts
        letters = max(1, int(_LETTER[raw].sum()))
        symbols = _SYMBOL[raw].sum() / n
        stops = np.isin(hashes, _STOPS).mean()
        three = shingle_hashes(hashes, 3)
        _, at, times = np.unique(three, return_inverse=True, return_counts=True)
        lines = np.flatnonzero(raw == 10)
        first, last = np.concatenate([[0], lines + 1]), np.concatenate([lines, [len(raw)]])
        full = last > first
        line = span_hashes(raw, first[full], last[full])
        same = hashes[1:] == hashes[:-1]
        out.update(
            length=np.log1p(n) / 10, mean_word=min(sizes.mean() / 10, 2.0), spread_word=min(sizes.std() / 10, 2.0), symbols=min(symbols, 1.0),
            any_symbols=float(symbols > 0.05), marks=min(_MARK[raw].sum() / n, 1.0), shouts=min((raw == 33).sum() / n, 1.0),
            capitals=_CAPITAL[raw].sum() / letters, digits=_DIGIT[raw].mean(), stop_words=stops, few_stop_words=float(stops < 0.06),
            distinct=len(np.unique(hashes)) / n, echo=same.mean() if n > 1 else 0.0, repeats=(times[at] > 1).mean() if n > 3 else 0.0,
            repeated_lines=1 - len(np.unique(line)) / max(1, len(line)), line_length=np.log1p(n / max(1, len(line))) / 5,
            alone_lines=float(len(line) == n),
        )
    return np.array([out[s] for s in STATISTICS])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        found = [statistics(t) for t in rows.column("_text").to_pylist()]
        flat = np.concatenate(found) if found else np.empty(0)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(flat), len(STATISTICS)).cast(pa.list_(pa.float64()))
        keep = [c for c in rows.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], lists], [*keep, "x"])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # one per statistic, then the intercept
    prior: float


def estimated_prior(labels: DataFrame, label_col: str = "quality") -> float:
    """Share of positives among the labelled rows given, kept inside (0.01, 0.99); one half without any."""
    row = labels.agg(F.avg(F.col(label_col).cast("double")).alias("p")).first()
    return min(0.99, max(0.01, 0.5 if row["p"] is None else row["p"]))


def fit(measured: DataFrame, positive: Column, prior: float, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """Gradient descent on the non-negative risk over all rows of ``measured`` (array column ``x``).

    Rows where ``positive`` holds are the trusted positives; all rows are the unlabelled text.
    """
    width = len(STATISTICS)
    items = [F.col("x")[i] for i in range(width)]
    row = measured.agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("p"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(items)],
                       *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(items)]).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(width)])
    scale = np.array([max(row[f"s{i}"] or 0.0, 1e-3) for i in range(width)])
    w = np.zeros(width + 1)
    if not row["p"]:
        return Model(mean, scale, w, prior)
    w[-1] = np.log(prior / (1 - prior))
    rows = measured.select("x", positive.alias("positive"))
    names = [f"{kind}{i}" for kind in ("a", "b", "u") for i in range(width + 1)] + ["n", "lp", "lu"]

    def partial(weights: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(names))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = (batch.column(0).flatten().to_numpy().reshape(-1, width) - mean) / scale
                x = np.hstack([x, np.ones((len(x), 1))])
                p = np.asarray(batch.column(1).to_pylist(), bool)
                g = x @ weights
                s = sigmoid(g)
                total += np.concatenate([((s - 1)[p, None] * x[p]).sum(0), (s[p, None] * x[p]).sum(0), (s[:, None] * x).sum(0),
                                         [p.sum(), np.logaddexp(0, g[p]).sum(), np.logaddexp(0, g).sum()]])
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names)

        return run

    schema = st.StructType([st.StructField(c, st.DoubleType()) for c in names])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        sums = rows.mapInArrow(partial(w), schema).agg(*[F.sum(c).alias(c) for c in names]).first()
        k = width + 1
        a, b, u = (np.array(sums[i * k : (i + 1) * k]) for i in range(3))
        n, unlabelled = sums["n"], row["n"]
        negative = sums["lu"] / unlabelled - prior * sums["lp"] / n
        grad = prior * a / n + (u / unlabelled - prior * b / n if negative >= 0 else 0.0)
        grad = grad + 2 * penalty * np.append(w[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(mean, scale, w, prior)


def score_column(model: Model) -> Column:
    """The model's probability of a positive for the array column ``x``."""
    z = F.lit(float(model.weights[-1]))
    for i in range(len(STATISTICS)):
        z = z + (F.col("x")[i] - F.lit(float(model.mean[i]))) * F.lit(float(model.weights[i] / model.scale[i]))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(60.0)), F.lit(-60.0))))


def measure(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the statistics of the text as array ``x``."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInArrow(_measure, st.StructType([*[rows.schema[c] for c in keep], st.StructField("x", st.ArrayType(st.DoubleType()))]))
