"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

A text's features are the indicators of its byte n-grams and of its word
n-grams up to renaming (which words of four are equal).  Each is scaled by
the log of the ratio of its smoothed frequencies among good and bad texts, the
row is brought to unit length, and a linear hinge-loss model is fitted by dual
coordinate descent (Hsieh et al., 2008).  A logistic curve over the margin,
fitted on the same rows, gives the score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediascore.llm.common import text_parts
from mediascore.llm.grams import PATTERNS, gram_ids, pattern_ids

SIZES = (2, 3, 4)
BITS = 16
#: The last ids are kept for the word patterns.
SIZE = 1 << BITS
FIRST_PATTERN = SIZE - PATTERNS
#: The most labelled rows that the model is fitted on (their distinct n-gram ids are collected, 2 bytes each).
FIT_ROWS = 8192


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of indicators, with the log-count ratio in them
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float


def indicators(text: str | None) -> np.ndarray:
    seen = np.zeros(SIZE, bool)
    seen[gram_ids(text, SIZES, BITS) % FIRST_PATTERN] = True
    seen[FIRST_PATTERN + pattern_ids(text)] = True
    return np.flatnonzero(seen)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, rounds: int = 12, seed: int = 42):
    """Weights and bias of the L2-regularised linear model with hinge loss:
    for each row in random order the dual variable's exact step, kept between
    0 and the row's cost."""
    rng = np.random.default_rng(seed)
    w, b, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    q = np.array([(v * v).sum() + 1.0 for v in values])
    for _ in range(rounds):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            grad = y[i] * (w[rows[i]] @ values[i] + b) - 1
            new = min(max(alpha[i] - grad / q[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                b += step
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return w, b


def _logistic(margin: np.ndarray, good: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of P(good) over the margin, each class weighing the
    same, by Newton's method with smoothed targets (Platt, 1999; Lin et al., 2007)."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(good, 0.5 / max(n1, 1), 0.5 / max(n0, 1))
    a, c = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        r, h = weight * (p - target), weight * p * (1 - p)
        g = np.array([(r * margin).sum() + 1e-4 * a, r.sum()])
        m = np.array([[(h * margin * margin).sum() + 1e-4, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(m, g)
        size = min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, c = a - size * step[0], c - size * step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(max(a, 1e-3)), float(c)


def fit(docs: DataFrame, labels: DataFrame, training: Column, fit_rows: int = FIT_ROWS, smooth: float = 1.0, c: float = 4.0) -> Model:
    """Fit on the rows of ``docs`` whose doc_id has a quality of 0 or 1 in
    ``labels`` and for which ``training``, a condition on doc_id, holds: at
    most ``fit_rows`` labelled ids, the first by a hash.  A doc_id with both
    labels counts as bad; null labels and ids are skipped.  With one class or
    none the score is that class's share, smoothed."""
    chosen = labels.where(training & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = chosen.groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").alias("l_good"))
    chosen = chosen.orderBy(F.xxhash64(F.lit("quality"), "l_id"), "l_id").limit(fit_rows)
    # at most fit_rows ids and labels
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("l_id", "l_good", "text").limit(2 * fit_rows)

    def grams(batches):
        for batch in batches:
            got = [indicators(t).astype("<u2").tobytes() for _, texts in text_parts(batch) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("l_id"), batch.column("l_good"), pa.array(got, pa.binary())], ["l_id", "good", "ids"])

    # the ids stay in Arrow's own buffer: a few large arrays, no object for each row
    found = sample.mapInArrow(grams, "l_id long, good int, ids binary").toArrow().combine_chunks().sort_by("l_id")
    good = found.column("good").to_numpy() == 1
    size = SIZE
    if not good.any() or good.all():
        share = (good.sum() + 1) / (len(good) + 2)
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, math.log(share / (1 - share)))
    column = found.column("ids").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    wide = "<i8" if pa.types.is_large_binary(column.type) else "<i4"
    at = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
    ids = np.frombuffer(column.buffers()[2], "<u2")
    rows = [ids[i:j] for i, j in zip(at[:-1], at[1:])]
    p, q = np.full(size, smooth), np.full(size, smooth)
    for row, g in zip(rows, good):
        (p if g else q)[row] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    scaled = ratio.astype(np.float32)[ids]
    values = [scaled[i:j] for i, j in zip(at[:-1], at[1:])]
    for v in values:
        v /= max(1e-12, math.sqrt(float((v * v).sum())))
    y = np.where(good, 1.0, -1.0)
    cost = np.where(good, c * len(y) / (2 * good.sum()), c * len(y) / (2 * (~good).sum()))
    w, b = dual_coordinate_descent(rows, values, y, cost, size)
    margin = np.array([w[i] @ v + b for i, v in zip(rows, values)])
    slope, shift = _logistic(margin, good)
    return Model(w * ratio, ratio, b, slope, shift)


def score(text: str | None, m: Model) -> float:
    """P(good), 0 to 1; a null text counts as empty."""
    ids = indicators(text)
    r = m.ratio[ids]
    margin = float(m.weights[ids].sum()) / max(1e-12, math.sqrt(float((r * r).sum()))) + m.bias
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, m.slope * margin + m.shift))))


def scored(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """Adds to the columns ``keep`` of each row: score and predicted (1 if
    score >= 0.5, else 0).  Null and empty texts are scored as texts without
    words.  Only the text is read besides ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    rows = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches):
        m = shared.value
        for batch in batches:
            s = np.array([score(t, m) for _, texts in text_parts(batch, column="__text") for t in texts], float)
            own = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names[:-1], "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose score is 0.5 or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([score(t, m) >= 0.5 for _, texts in text_parts(batch) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
