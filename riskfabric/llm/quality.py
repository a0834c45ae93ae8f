"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins at quantiles. Shallow trees are boosted in cycles, one feature at a time, on the gradients of the
logistic loss; a tree on one feature only adds to that feature's lookup table, so the model is a table for each feature. Then
the pairs of features whose joint bins explain most of what is left get tables of their own, boosted the same way. A score
is the sum of one entry per table, looked up for a whole batch at once.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfabric.llm.langid import held_out

#: Labelled rows that are learned from, those with the least hashes of their ids; a bound of the fit, not of what is scored.
TRAIN_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
CYCLES = 120
PAIR_CYCLES = 40
RATE = 0.1
LEAVES = 4
#: Hessian mass that a leaf must hold, and ridge on leaf values.
LEAST_MASS = 2.0
RIDGE = 1.0

FEATURES = ["log_words", "mean_word", "distinct_words", "top_word", "repeats", "upper", "symbols", "digits", "high_bytes",
            "marked_words", "bars", "lines", "distinct_lines", "stops"]


def features(text: str | None) -> list[float]:
    """Surface features of a whole text; zeros for null, empty and word-less texts."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    lines, n, size = text.split("\n"), len(words), float(raw.sum())
    counts = Counter(words)
    printed = max(1.0, size - float(raw[[9, 10, 13, 32]].sum()))
    letters = float(raw[65:91].sum() + raw[97:123].sum())
    stops = float(raw[[33, 46, 63]].sum())
    return [float(np.log1p(n)), printed / n, len(counts) / n, max(counts.values()) / n, sum(map(operator.eq, words, words[1:])) / n,
            float(raw[65:91].sum()) / max(1.0, letters), (printed - letters - float(raw[48:58].sum()) - float(raw[128:].sum())) / printed,
            float(raw[48:58].sum()) / printed, float(raw[128:].sum()) / printed, float(raw[[33, 35, 36, 37, 38, 42]].sum()) / n,
            float(raw[124]) / n, float(np.log1p(len(lines))), len(set(lines)) / len(lines), stops / n]


@dataclass
class Additive:
    """Bin edges and tables: `bias` + one entry per feature + one per pair of features."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    bias: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for column, edges, table in zip(x.T, self.edges, self.tables, strict=True):
            total += table[np.searchsorted(edges, column, side="right")]
        if self.pairs:
            bins = [np.searchsorted(edges, column, side="right") for column, edges in zip(x.T, self.coarse, strict=True)]
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[bins[a], bins[b]]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins)) if len(column) else np.zeros(0)


def _tree(gradient: np.ndarray, mass: np.ndarray, leaves: int) -> np.ndarray:
    """Values per bin of a best-first tree on ordered bins, each leaf a Newton step."""
    g, h = np.r_[0, np.cumsum(gradient)], np.r_[0, np.cumsum(mass)]

    def gain(a: int, b: int) -> tuple[float, int]:
        """Best split of the bins a to b."""
        at = np.arange(a + 1, b)
        if not len(at):
            return 0.0, a
        left, right = h[at] - h[a], h[b] - h[at]
        value = (g[at] - g[a]) ** 2 / (left + RIDGE) + (g[b] - g[at]) ** 2 / (right + RIDGE) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + RIDGE)
        value = np.where((left >= LEAST_MASS) & (right >= LEAST_MASS), value, 0)
        best = int(value.argmax())
        return float(value[best]), int(at[best])

    cuts = [0, len(gradient)]
    while len(cuts) <= leaves:
        best, at = max(gain(a, b) for a, b in zip(cuts, cuts[1:], strict=False))
        if best <= 1e-12:
            break
        cuts = sorted([*cuts, at])
    out = np.zeros(len(gradient))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + RIDGE)
    return out


def _grid_tree(gradient: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Values per cell of the best tree that splits one feature once, and each side on the other feature."""
    best, out = -1.0, np.zeros_like(gradient)
    for turned in (False, True):
        g, h = (gradient.T, mass.T) if turned else (gradient, mass)
        for at in range(1, len(g)):
            values = np.zeros_like(g)
            for rows in (slice(0, at), slice(at, None)):
                values[rows] = _tree(g[rows].sum(0), h[rows].sum(0), 2)
            gain = float((values * g - values**2 * (h + RIDGE / h.size) / 2).sum())
            if gain > best:
                best, out = gain, values.T if turned else values
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting of feature tables, then of the pair tables of the largest gain. y: 0 or 1; one class gives a constant."""
    positive = (y.sum() + 0.5) / (len(y) + 1.0)
    bias = float(np.log(positive / (1 - positive)))
    edges, coarse = [_edges(c, BINS) for c in x.T], [_edges(c, PAIR_BINS) for c in x.T]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not len(y) or y.min() == y.max():
        return Additive(edges, coarse, bias, tables, [], [])
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)]
    total = np.full(len(y), bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(CYCLES):
        for own, table in zip(bins, tables, strict=True):
            gradient, mass = slopes()
            step = RATE * _tree(np.bincount(own, gradient, len(table)), np.bincount(own, mass, len(table)), LEAVES)
            table += step
            total += step[own]
    wide = [np.searchsorted(e, c, side="right") for e, c in zip(coarse, x.T, strict=True)]
    sizes = [len(e) + 1 for e in coarse]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cells, gradient_mass = wide[a] * sizes[b] + wide[b], slopes()
        return cells, *(np.bincount(cells, v, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b]) for v in gradient_mass)

    gains = []
    for a in range(len(sizes)):
        for b in range(a + 1, len(sizes)):
            _, g, h = grid(a, b)
            values = _grid_tree(g, h)
            gains.append((float((values * g - values**2 * h / 2).sum()), a, b))
    pairs = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in pairs]
    for _ in range(PAIR_CYCLES):
        for (a, b), table in zip(pairs, pair_tables, strict=True):
            cells, g, h = grid(a, b)
            step = RATE * _grid_tree(g, h)
            table += step
            total += step.ravel()[cells]
    return Additive(edges, coarse, bias, tables, pairs, pair_tables)


def _features_of(column: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py()) for t in column]).reshape(len(column), len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Additive:
    """The model of up to `rows` labelled ids, those of the least hashes; repeated labels of an id count by their mean."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).filter("_id is not null and _label is not null").groupBy("_id").agg(
        F.round(F.avg("_label")).cast("int").alias("_label"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _features_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(c) for c in found.T]], names=["_label", *FEATURES])

    # The sample has a documented bound of rows of two numbers.
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("_text", "_label")
    table = texts.mapInArrow(run, "_label int, " + ", ".join(f"{n} double" for n in FEATURES)).toPandas()
    table = table.sort_values([*FEATURES, "_label"])
    return fit(table[FEATURES].to_numpy(float).reshape(-1, len(FEATURES)), table["_label"].to_numpy(float))


def scored(text: Column, model: Additive) -> Column:
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(model.score(_features_of(column)))

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.DoubleType())(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.3) -> DataFrame:
    """id, `held_out`, `score` (0 to 1) and `predicted` (1 if score >= least) of every row; null and empty texts have all features 0.

    Labels are learned only from ids whose crc32 as text leaves a remainder modulo 5. Without labels every score is 0.5.
    """
    model = learn(docs, labels.filter(~held_out(F.col(id_col), 5, 0)), id_col, text_col, label_col)
    return docs.select(F.col(id_col), held_out(F.col(id_col), 5, 0).alias("held_out"), scored(F.col(text_col), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= least).cast("int"))
