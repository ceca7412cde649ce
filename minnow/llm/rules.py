"""Quality classifier: a sparse rule ensemble compiled into Spark columns (operator 10).

Boosted trees are grown over text statistics, every path of a tree becomes a conjunctive rule, a
lasso logistic regression keeps few of the rules, and the kept ones are one Column expression over
the statistics. Fitting takes at most SAMPLE labelled rows, those with the least hash of doc_id.

Defined cases: null counts as the empty text, whose statistics are all 0; repeated rows each get a
score; documents without a label are scored like others; labels that are null or have no document
are not learned from; with fewer than two classes the score is the share of label 1 (0.5 without
labels); a text of any length is read whole; of rows with one hash of doc_id those with the least id and
statistics are learned from first; null doc_ids are scored; a score of 0.5 predicts 1; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minnow.llm import kernel as K
from minnow.llm.cluster import ship, stored
from minnow.llm.quality import base_counts

STATS = ("log_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "bang_share", "distinct_share", "words_per_line", "letter_share")
SAMPLE = 20_000
TREES, DEPTH, SHRINK, BINS = 40, 3, 0.3, 32
PENALTY, STEPS = 0.002, 400

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, at most?, threshold)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    c = base_counts(data, offsets)
    h, starts, _, bounds = c["_words"]
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    _, later = K.repeated(h, rows)

    def share(low: int, high: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum((data >= low) & (data <= high))])
        return np.diff(total[offsets])

    n_bytes, n_words = np.maximum(np.diff(offsets), 1), np.maximum(c["n_words"], 1)
    lines = np.maximum(share(10, 10) + (np.diff(offsets) > 0), 1)
    upper, lower, digits, high = share(0x41, 0x5A), share(0x61, 0x7A), share(0x30, 0x39), share(0x80, 0xFF)
    marks = share(0x21, 0x2F) + share(0x3A, 0x40) + share(0x5B, 0x60) + share(0x7B, 0x7E)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / n_words, c["n_symbols"] / n_words, c["n_dup_lines"] / lines, c["n_repeat_words"] / n_words,
        upper / np.maximum(upper + lower, 1), digits / n_bytes, marks / n_bytes, share(0x21, 0x21) / n_words,
        1 - K.row_sums(later.astype(np.int64), bounds) / n_words, c["n_words"] / lines, (upper + lower + high) / n_bytes,
    ]).astype(np.float64)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, off in K.blocks(batch.column(1)):
                s = statistics(data, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), *(pa.array(s[:, i]) for i in range(len(STATS)))], ["doc_id", *STATS])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *(T.StructField(s, T.DoubleType()) for s in STATS)]))


def grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, at: np.ndarray, path: Rule, depth: int, found: list[Rule], value: np.ndarray) -> None:
    """Split rows at by the best threshold, note each new path, and put leaf values into value."""
    g, h = grad[at].sum(), hess[at].sum()
    best = (1e-6, -1, 0)
    if depth < DEPTH and len(at) >= 20:
        for j, e in enumerate(edges):
            if not len(e):
                continue
            gl = np.cumsum(np.bincount(bins[at, j], grad[at], len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(bins[at, j], hess[at], len(e) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(hl < 1) | (h - hl < 1)] = 0
            if gain.max() > best[0]:
                best = (gain.max(), j, int(gain.argmax()))
    if best[1] < 0:
        value[at] = -g / (h + 1)
        return
    _, j, k = best
    for low in (True, False):
        rule = (*path, (j, low, float(edges[j][k])))
        found.append(rule)
        grow(x, bins, edges, grad, hess, at[(bins[at, j] <= k) == low], rule, depth + 1, found, value)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, j] <= t) if low else (x[:, j] > t) for j, low, t in rule])


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and weighted rules."""
    if len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return float(np.log((share + 1e-6) / (1 - share + 1e-6))), []
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    edges = [e[e < x[:, j].max()] for j, e in enumerate(edges)]
    bins = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    raw, found = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        value = np.zeros(len(y))
        grow(x, bins, edges, p - y, p * (1 - p), np.arange(len(y)), (), 0, found, value)
        raw += SHRINK * value
    rules, z, seen = [], [], set()
    for rule in found:
        column = holds(rule, x)
        if 0 < column.mean() < 1 and (key := column.tobytes()) not in seen:
            seen.add(key)
            rules.append(rule)
            z.append(column)
    z = np.column_stack(z).astype(np.float32) if z else np.zeros((len(y), 0), np.float32)
    intercept, weights = lasso(z, y)
    return intercept, [(float(w), r) for w, r in zip(weights, rules, strict=True) if w]


def lasso(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient; the intercept is free."""
    n, k = z.shape
    z = np.column_stack([np.ones(n, np.float32), z])
    v = np.ones(k + 1, np.float32)
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(np.linalg.norm(z @ v) ** 2)
    w, u, t = np.zeros(k + 1), np.zeros(k + 1), 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(z @ u.astype(np.float32))))
        new = u - step * (z.T @ (p - y).astype(np.float32)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * PENALTY, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        u, w = new + (before - 1) / t * (new - w), new
    return float(w[0]), w[1:]


def compiled(intercept: float, rules: list[tuple[float, Rule]]) -> Column:
    """The probability of label 1 as an expression over the statistics."""
    total = F.lit(intercept)
    for weight, rule in rules:
        test = reduce(lambda a, b: a & b, [(F.col(STATS[j]) <= t) if low else (F.col(STATS[j]) > t) for j, low, t in rule])
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, statistics, score and predicted; learned from labelled rows that satisfy learn (over doc_id)."""
    stats = stored(text_statistics(docs))
    marked = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").alias("__y")).filter(learn).dropDuplicates()
    taken = stats.join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *STATS).limit(sample).select("__y", *STATS).toArrow()
    rows = np.column_stack([taken.column(c).to_numpy() for c in ("__y", *STATS)]).astype(np.float64)
    score = compiled(*fit(rows[:, 1:], rows[:, 0]))
    return stats.withColumn("score", score).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
