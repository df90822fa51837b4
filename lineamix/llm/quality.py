"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text has a lookup table over its bins, and so have the few pairs of features
that explain most of what is left. The tables are sums of shallow trees, boosted in cycles over
the features. A score is the logistic of a sum of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lineamix.llm.common import table
from lineamix.llm.words import SMALL_PART, by_text, parts, words_of

FEATURES = (
    "log_words", "word_length", "upper_case", "symbols", "digits", "repeated_word", "repeated_pair", "bars",
    "exclamations", "sentence_length", "short_words", "symbol_runs", "line_length", "marked_words",
)
#: Labelled rows that a fit uses at most, those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7

_KIND = {
    "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A),
    "symbol": [b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,;:!?'\"()-|"],
    "bar": [0x7C], "exclamation": [0x21], "stop": [0x2E, 0x3F, 0x21], "line": [0x0A],
}
_IS = {}
for _name, _bytes in _KIND.items():
    _IS[_name] = np.zeros(256, bool)
    _IS[_name][list(_bytes)] = True


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text, counted over the whole text. NULL counts as empty: all 0."""
    rows = [_features(part) for part in parts(texts, SMALL_PART)]
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


def _features(texts: pa.Array) -> np.ndarray:
    w = words_of(texts, lower=False)
    count = {k: by_text(m[w.data], w.bytes_at) for k, m in _IS.items()}
    size, n = np.diff(w.bytes_at), np.diff(w.text_at)
    lengths = w.ends - w.starts
    inner = np.ones(len(w.hashes), bool)
    inner[w.text_at[:-1][n > 0]] = False  # first words have none before them
    again = np.zeros(len(w.hashes), bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & inner[1:]
    second = np.zeros(len(w.hashes), bool)
    second[2:] = (w.hashes[2:] == w.hashes[:-2]) & inner[2:] & inner[1:-1]
    run = np.zeros(len(w.data), bool)
    run[1:] = (w.data[1:] == w.data[:-1]) & _IS["symbol"][w.data[1:]]
    marked = _IS["symbol"][w.data[w.ends - 1]] | _IS["exclamation"][w.data[w.ends - 1]] if len(w.ends) else inner
    words, letters, bytes_ = np.maximum(n, 1), np.maximum(count["upper"] + count["lower"], 1), np.maximum(size, 1)
    return np.column_stack([
        np.log1p(n), by_text(lengths, w.text_at) / words, count["upper"] / letters, count["symbol"] / bytes_,
        count["digit"] / bytes_, by_text(again, w.text_at) / words, by_text(second, w.text_at) / words,
        count["bar"] / words, count["exclamation"] / words, n / (count["stop"] + 1),
        by_text(lengths <= 3, w.text_at) / words, by_text(run, w.bytes_at) / bytes_, n / (count["line"] + 1),
        by_text(marked, w.text_at) / words,
    ])


@dataclass
class AdditiveModel:
    """Bin edges and table of each feature, and tables of pairs over coarser bins."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables)):
            out += values[np.searchsorted(edges, x[:, f], "right")]
        for (a, b), values in zip(self.pairs, self.pair_tables):
            out += values[
                np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")
            ]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.logits(x)))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, pair_bins: int = 8, rounds: int = 150, rate: float = 0.15, pairs: int = 6) -> AdditiveModel:
    """Boost the tables on rows ``x`` with labels ``y`` in {0, 1}.

    Without rows, or with one label only, the tables are 0 and the score is the smoothed share of
    label 1. Equal rows get equal scores whatever their order.
    """
    width = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    edges = [_edges(x[:, f], bins) for f in range(width)]
    coarse = [_edges(x[:, f], pair_bins) for f in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = AdditiveModel(base, edges, tables, [], coarse, [])
    if not len(y) or y.min() == y.max():
        return model
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    logit = np.full(len(y), base)
    for _ in range(rounds):
        for f in range(width):
            step = rate * _tree(at[f], len(tables[f]), *_slopes(y, logit))
            tables[f] += step
            logit += step[at[f]]
    wide = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
    shape = [(len(coarse[a]) + 1, len(coarse[b]) + 1) for a, b in combinations(range(width), 2)]
    gains = []
    for (a, b), s in zip(combinations(range(width), 2), shape):
        gains.append((-_quadrants(wide[a] * s[1] + wide[b], s, *_slopes(y, logit))[0], a, b, s))
    for _, a, b, s in sorted(gains)[:pairs]:
        model.pairs.append((a, b))
        model.pair_tables.append(np.zeros(s))
    for _ in range(rounds // 3):
        for (a, b), values in zip(model.pairs, model.pair_tables):
            cell = wide[a] * values.shape[1] + wide[b]
            step = rate * _quadrants(cell, values.shape, *_slopes(y, logit))[1]
            values += step
            logit += step.ravel()[cell]
    return model


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    if not len(values):
        return np.zeros(0)
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _slopes(y: np.ndarray, logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-logit))
    return y - p, p * (1 - p)


_RIDGE = 1.0


def _tree(at: np.ndarray, size: int, slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """A tree of two levels over the bins of one feature, as a value per bin."""
    g, h = np.bincount(at, slope, size), np.bincount(at, curve, size)
    out = np.zeros(size)
    spans = [(0, size)]
    for _ in range(2):
        spans = [part for span in spans for part in _split(g, h, *span)]
    for a, b in spans:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + _RIDGE)
    return out


def _split(g: np.ndarray, h: np.ndarray, a: int, b: int) -> list[tuple[int, int]]:
    if b - a < 2:
        return [(a, b)]
    left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
    all_g, all_h = g[a:b].sum(), h[a:b].sum()
    gain = left_g**2 / (left_h + _RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + _RIDGE)
    best = int(np.argmax(gain))
    if gain[best] <= all_g**2 / (all_h + _RIDGE) + 1e-9:
        return [(a, b)]
    return [(a, a + best + 1), (a + best + 1, b)]


def _quadrants(cell: np.ndarray, shape: tuple[int, int], slope: np.ndarray, curve: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of both features at once: its gain, and the values of the four quarters."""
    size = shape[0] * shape[1]
    g = np.bincount(cell, slope, size).reshape(shape).cumsum(0).cumsum(1)
    h = np.bincount(cell, curve, size).reshape(shape).cumsum(0).cumsum(1)
    if min(shape) < 2:
        return 0.0, np.zeros(shape)

    def quarters(s: np.ndarray) -> tuple[np.ndarray, ...]:
        corner, top, left, whole = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1], s[-1, -1]
        return corner, top - corner, left - corner, whole - top - left + corner

    qg, qh = quarters(g), quarters(h)
    gain = sum(a**2 / (b + _RIDGE) for a, b in zip(qg, qh))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = [float(a[i, j] / (b[i, j] + _RIDGE)) for a, b in zip(qg, qh)]
    out = np.empty(shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1:], out[i + 1:, : j + 1], out[i + 1:, j + 1:] = values
    return float(gain[i, j]), out


def features_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def compute(texts: pa.Array) -> pa.Array:
        rows = text_features(texts)
        at = np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(rows.ravel()))

    return compute(text)


def score_column(model: AdditiveModel, text: Column) -> Column:
    """Score of each text in (0, 1); also NULL and empty texts have one."""
    @F.arrow_udf("double")
    def compute(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(text_features(texts)))

    return compute(text)


def remainder(id_col: Column, divisor: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % divisor


def sample(labels: DataFrame, label: str, learn: Column, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` rows (doc_id, label) to learn from, the same on every run."""
    rows = labels.where(learn & F.col(label).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label).alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", most: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on at most ``most`` labelled documents for which ``learn`` holds.

    The sample bounds what is broadcast (ids and labels) and what comes to the driver (features).
    Of a document with two labels the larger counts; NULL labels and ids are left out.
    """
    chosen = F.broadcast(sample(labels, label, learn, most))
    rows = docs.select(F.col("doc_id"), F.col("text")).join(chosen, "doc_id")
    found = rows.select("doc_id", features_column(F.col("text")).alias("x"), "label").toArrow()
    x = np.array(found["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    y = found["label"].to_numpy().astype(float)
    return fit(x, y)


def score_documents(docs: DataFrame, model: AdditiveModel, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each document."""
    return docs.select(
        F.col("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), score_column(model, F.col("text")).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), 4) == 2
    return score_documents(docs, train(docs, labels, ~held_out), held_out)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of ``threshold`` or more, with all their columns."""
    model = train(docs, labels, F.lit(True))
    return docs.where(score_column(model, F.col("text")) >= threshold)
