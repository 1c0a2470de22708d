"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn, fitting one shallow tree at a time to one feature's histogram of gradients, so
each feature ends as a lookup table over its bins; then the strongest pairs get two-way tables in the same manner. A
score is the sum of one entry of each table, added for a whole Arrow batch at once.

Learning takes a bounded sample of labelled rows to the driver (``max_fit_rows``); scoring is one pass without a
shuffle. Inputs are the shape features of the text alone.

Contract: a null text counts as empty, whose features are 0; rows may repeat and are scored each on its own; without
labels every score is 0.5, with one class only it is that class's smoothed share; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels
from .text_features import FEATURES, with_counts, with_features


def _bin(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, values, side="right")


def _quantile_edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Gam:
    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    #: (feature, feature, edges, edges, table)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows of ``x``: vectorised additions of table entries."""
        total = np.full(len(x), self.bias)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[_bin(x[:, j], edges)]
        for a, b, edges_a, edges_b, table in self.pairs:
            total += table[_bin(x[:, a], edges_a), _bin(x[:, b], edges_b)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x))


def _leaf(g: float, h: float, ridge: float) -> float:
    return g / (h + ridge)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values over ordered bins of a tree with at most ``leaves`` leaves, grown best split first."""
    cg, ch = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])

    def worth(lo: int | np.ndarray, hi: int | np.ndarray) -> np.ndarray:
        return (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + ridge)

    def best(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        cuts = np.arange(lo + 1, hi)
        gains = worth(lo, cuts) + worth(cuts, hi) - worth(lo, hi)
        k = int(np.argmax(gains))
        return float(gains[k]), int(cuts[k])

    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, cut, k = max(((*best(*part), k) for k, part in enumerate(parts)), key=lambda t: (t[0], -t[2]))
        if gain <= 1e-12:
            break
        lo, hi = parts.pop(k)
        parts += [(lo, cut), (cut, hi)]
    out = np.empty(len(g))
    for lo, hi in parts:
        out[lo:hi] = _leaf(cg[hi] - cg[lo], ch[hi] - ch[lo], ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a two-way histogram into four quadrants: its gain and the values."""
    cg = np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    ch = cg.copy()
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    i, j = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    if not i.size or not j.size:
        return 0.0, np.zeros_like(g)

    def four(c: np.ndarray) -> list[np.ndarray]:
        tl = c[i, j]
        return [tl, c[i, -1] - tl, c[-1, j] - tl, c[-1, -1] - c[i, -1] - c[-1, j] + tl]

    gains = sum(a**2 / (b + ridge) for a, b in zip(four(cg), four(ch), strict=True))
    a, b = np.unravel_index(int(np.argmax(gains)), gains.shape)
    values = [q[a, b] / (p[a, b] + ridge) for q, p in zip(four(cg), four(ch), strict=True)]
    out = np.empty_like(g)
    a, b = a + 1, b + 1
    out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = values
    return float(gains.max() - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 120, rate: float = 0.15, leaves: int = 3, n_pairs: int = 6, pair_bins: int = 12, pair_rounds: int = 40, ridge: float = 1.0) -> Gam:
    """Cyclic boosting of log loss. Deterministic."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(bias=float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    n_features = x.shape[1]
    model.edges = [_quantile_edges(x[:, j], bins) for j in range(n_features)]
    binned = [_bin(x[:, j], model.edges[j]) for j in range(n_features)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    raw = np.full(len(y), model.bias)
    for _ in range(rounds):
        for j in range(n_features):
            p = _sigmoid(raw)
            size = len(model.tables[j])
            step = rate * _shallow_tree(np.bincount(binned[j], y - p, size), np.bincount(binned[j], p * (1 - p), size), leaves, ridge)
            model.tables[j] += step
            raw += step[binned[j]]
    coarse_edges = [_quantile_edges(x[:, j], pair_bins) for j in range(n_features)]
    coarse = [_bin(x[:, j], e) for j, e in enumerate(coarse_edges)]

    def histogram(a: int, b: int, weights: np.ndarray) -> np.ndarray:
        shape = len(coarse_edges[a]) + 1, len(coarse_edges[b]) + 1
        return np.bincount(coarse[a] * shape[1] + coarse[b], weights, shape[0] * shape[1]).reshape(shape)

    p = _sigmoid(raw)
    every = [(_quadrants(histogram(a, b, y - p), histogram(a, b, p * (1 - p)), ridge)[0], a, b) for a in range(n_features) for b in range(a)]
    chosen = [(a, b) for gain, a, b in sorted(every, key=lambda t: (-t[0], t[1:]))[:n_pairs] if gain > 1e-6]
    tables = {pair: np.zeros((len(coarse_edges[pair[0]]) + 1, len(coarse_edges[pair[1]]) + 1)) for pair in chosen}
    for _ in range(pair_rounds):
        for a, b in chosen:
            p = _sigmoid(raw)
            step = rate * _quadrants(histogram(a, b, y - p), histogram(a, b, p * (1 - p)), ridge)[1]
            tables[a, b] += step
            raw += step[coarse[a], coarse[b]]
    model.pairs = [(a, b, coarse_edges[a], coarse_edges[b], tables[a, b]) for a, b in chosen]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: CRC-32 of the id as text leaves 1 modulo 3. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 20_000) -> Gam:
    """Fit on at most ``max_fit_rows`` labelled documents that are not held out."""
    sample = bounded_labels(labels.filter(~held_out(F.col("doc_id"))), F.col("quality"), max_fit_rows)
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most max_fit_rows rows
    featured = with_features(with_counts(labelled.select("doc_id", "text"))).groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("least"))  # of a repeated id the smallest
    rows = featured.join(F.broadcast(sample), "doc_id").select("target", "least.*").select("target", *FEATURES).toPandas().sort_values(["target", *FEATURES])  # the order is that of the values, not of the tasks
    return fit(rows[list(FEATURES)].to_numpy(float), rows["target"].to_numpy(float))


def score_column(model: Gam, spark_context) -> Column:
    """The probability of label 1, from the feature columns."""
    shared = spark_context.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(shared.value.score(np.column_stack([c.to_numpy(float) for c in columns])))

    # not to be moved or repeated by the optimizer
    return score.asNondeterministic()(*[F.col(f) for f in FEATURES])


def classify(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 20_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    model = learn(docs, labels, max_fit_rows)
    features = with_features(with_counts(docs)).select("doc_id", *FEATURES)
    scored = features.withColumn("score", score_column(model, docs.sparkSession.sparkContext))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, with all their columns: one pass, without a shuffle."""
    model = learn(docs, labels, max_fit_rows)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id"), F.col("text"))
    features = with_features(with_counts(held, "_row")).select("_row", *FEATURES)
    scored = features.withColumn("_score", score_column(model, docs.sparkSession.sparkContext))
    return scored.filter("_score >= 0.5").select("_row.*")
