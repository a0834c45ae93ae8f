"""Trained models: isolation forest, malware and threat classifiers, delay and reward regressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfabric.operators.binary import with_feature_defaults
from riskfabric.session import discard, scratch

TELEMETRY_FEATURES = ("avg_connection_rate", "cve_criticality_sum", "unique_ips_contacted", "degree_centrality")
TRAFFIC_FEATURES = ("bytes_in", "bytes_out", "duration_ms", "protocol_modbus", "protocol_mqtt", "failed_logins")
BINARY_FEATURES = ("entropy", "num_imports", "num_sections", "packer_detected", "signature_valid")

# Baseline binaries (entropy, imports, sections, packer, signature, label).
BASELINE_BINARIES = (
    (4.5, 20, 4, 0, 1, 0),
    (5.1, 15, 3, 0, 1, 0),
    (3.8, 30, 5, 0, 1, 0),
    (4.2, 25, 4, 0, 1, 0),
    (4.9, 18, 4, 0, 1, 0),
    (7.8, 80, 8, 1, 0, 1),
    (7.9, 95, 10, 1, 0, 1),
    (6.8, 10, 2, 1, 0, 1),
    (7.2, 5, 2, 1, 0, 1),
    (7.5, 120, 9, 0, 0, 1),
)


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    value = 2.0 * (np.log(np.maximum(safe - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, value))


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, cut, left, right, path) of one isolation tree; leaves have feature -1."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list = [None]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        part = x[rows]
        low, high = (part.min(0), part.max(0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes[at] = (-1, 0.0, at, at, depth + float(average_path(len(rows))))
            continue
        feature = int(rng.choice(usable))
        cut_at = float(rng.uniform(low[feature], high[feature]))
        left = part[:, feature] <= cut_at
        a, b = len(nodes), len(nodes) + 1
        nodes += [None, None]
        nodes[at] = (feature, cut_at, a, b, 0.0)
        todo += [(a, rows[left], depth + 1), (b, rows[~left], depth + 1)]
    return nodes


@dataclass
class LeafTables:
    """A forest as bit masks over the leaves of each tree, numbered from left to right.

    A node whose cut lies below the value rules out the leaves of its left branch; the first leaf that no node rules out is the one a walk
    ends in. What the nodes of a feature rule out together depends on how many of its cuts lie below the value only, so it is looked up.
    """

    words: int
    leaf_path: np.ndarray
    #: Per feature: cuts in order, tree of each, first and last leaf (exclusive) of its left branch.
    cuts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    #: Bytes of the tables of one task at most; larger forests are walked.
    LIMIT = 256 << 20

    @classmethod
    def of(cls, starts: np.ndarray, feature: np.ndarray, cut_at: np.ndarray, lo: np.ndarray, hi: np.ndarray, path: np.ndarray, features: int) -> LeafTables | None:
        leaves: list[list[float]] = []
        found: list[list[tuple]] = [[] for _ in range(features)]
        for tree, root in enumerate(starts):
            own: list[float] = []
            todo = [(int(root), False, 0)]
            while todo:
                at, left_done, first = todo.pop()
                if left_done:
                    found[feature[at]].append((cut_at[at], tree, first, len(own)))
                elif feature[at] < 0:
                    own.append(path[at])
                else:
                    todo += [(int(hi[at]), False, 0), (at, True, len(own)), (int(lo[at]), False, 0)]
            leaves.append(own)
        most = max(map(len, leaves), default=1)
        words = -(-most // 64)
        if (sum(map(len, found)) + features) * len(leaves) * words * 8 > cls.LIMIT:
            return None
        cuts = []
        for rows in found:
            rows.sort()
            cuts.append((np.array([r[0] for r in rows], dtype=float), *[np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2, 3)]))
        return cls(words, np.array([own + [0.0] * (most - len(own)) for own in leaves]), cuts)

    def reader(self) -> Callable[[np.ndarray], np.ndarray]:
        """Rows of features -> path length per row and tree."""
        trees, every = len(self.leaf_path), np.uint64(0xFFFFFFFFFFFFFFFF)
        tables = []
        for cuts, tree, first, last in self.cuts:
            left = np.full((len(cuts) + 1, trees, self.words), every)
            for word in range(self.words):
                begin, end = (np.clip(v - 64 * word, 0, 64) for v in (first, last))
                below = [np.array([(1 << int(n)) - 1 for n in v], dtype=np.uint64) for v in (begin, end)]
                left[np.arange(1, len(cuts) + 1), tree, word] = ~(below[1] & ~below[0])
            tables.append(np.bitwise_and.accumulate(left, axis=0))
        each = np.arange(trees)

        def paths(x: np.ndarray) -> np.ndarray:
            masks = np.full((len(x), trees, self.words), every)
            for i, (cuts, *_) in enumerate(self.cuts):
                masks &= tables[i][np.searchsorted(cuts, x[:, i], side="left")]
            word = (masks != 0).argmax(axis=2)
            bits = np.take_along_axis(masks, word[:, :, None], axis=2)[:, :, 0]
            return self.leaf_path[each, word * 64 + np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1))]

        return paths


@dataclass
class IsolationForest:
    """Forest as one table of nodes; a few hundred kilobytes whatever the size of the data."""

    features: tuple[str, ...]
    nodes: pd.DataFrame
    sample_rows: int
    threshold: float = 1.0

    @classmethod
    def fit(cls, df: DataFrame, features: tuple[str, ...], ident: str, trees: int = 100, sample_rows: int = 256,
            contamination: float = 0.05, seed: int = 42) -> IsolationForest:
        """Each tree sees about `sample_rows` rows drawn by a hash of (row, tree), so no task holds more.

        The features are written out once and then counted, drawn by one hash per row and tree whatever the number of rows,
        and scored in full for the threshold.
        """
        folder = scratch(df.sparkSession, "forest")  # Parquet takes a few bytes a value, a checkpoint some hundred a row
        df.select(F.col(ident).alias("_id"), *[F.col(c).cast("double").alias(c) for c in features]).dropna().write.parquet(folder)
        data = df.sparkSession.read.parquet(folder)
        total = data.count()
        space = 1 << 60
        share = int(space * min(1.0, sample_rows / max(total, 1)))
        drawn = data.withColumn("tree", F.explode(F.filter(
            F.sequence(F.lit(0), F.lit(trees - 1)),
            lambda t: F.pmod(F.xxhash64(F.col("_id"), t, F.lit(seed + 1)), F.lit(space)) < share)))
        names = list(features)

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            x = pdf.sort_values("_id")[names].to_numpy()
            out = pd.DataFrame(grow_tree(x, np.random.default_rng([seed, tree])), columns=["feature", "cut_at", "lo", "hi", "path"])
            return out.assign(tree=tree, node=np.arange(len(out)))

        table = drawn.groupBy("tree").applyInPandas(
            grow, "feature int, cut_at double, lo int, hi int, path double, tree int, node int").toPandas()
        model = cls(features, table.sort_values(["tree", "node"], ignore_index=True), min(sample_rows, max(total, 1)))
        cutoff = model.scores(data).agg(F.percentile_approx("anomaly_score", 1.0 - contamination, 10_000)).first()[0]
        model.threshold = float(cutoff) if cutoff is not None else 1.0
        discard(df.sparkSession, folder)
        return model

    def scores(self, df: DataFrame) -> DataFrame:
        """Add `anomaly_score` in (0, 1]: 2^(-mean path / expected path)."""
        starts = self.nodes.groupby("tree")["node"].size().cumsum().shift(fill_value=0).to_numpy()
        offset = np.repeat(starts, self.nodes.groupby("tree")["node"].size().to_numpy())
        feature = self.nodes["feature"].to_numpy()
        cut_at, path = self.nodes["cut_at"].to_numpy(), self.nodes["path"].to_numpy()
        lo, hi = self.nodes["lo"].to_numpy() + offset, self.nodes["hi"].to_numpy() + offset
        expected = float(average_path(self.sample_rows)) or 1.0

        def walk(x: np.ndarray) -> np.ndarray:
            at = np.broadcast_to(starts, (len(x), len(starts))).copy()
            row = np.arange(len(x))[:, None]
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    return path[at]
                value = x[row, np.maximum(f, 0)]
                at = np.where(inner, np.where(value <= cut_at[at], lo[at], hi[at]), at)

        tables = LeafTables.of(starts, feature, cut_at, lo, hi, path, len(self.features))

        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            paths = tables.reader() if tables else walk
            for columns in batches:
                x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
                parts = [paths(x[i:i + 1000]).mean(axis=1) for i in range(0, len(x), 1000)]
                yield pd.Series(np.power(2.0, -np.concatenate(parts or [np.zeros(0)]) / expected))

        udf = F.pandas_udf(score, "double", F.PandasUDFType.SCALAR_ITER)
        return df.withColumn("anomaly_score", udf(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features]))

    def predict(self, df: DataFrame) -> DataFrame:
        """1.0 for an anomaly, 0.0 for a normal row."""
        return self.scores(df).withColumn("is_anomaly", F.when(F.col("anomaly_score") > self.threshold, 1.0).otherwise(0.0))


def predict_or_normal(model: IsolationForest | None, df: DataFrame) -> DataFrame:
    """Without a model every row counts as normal."""
    return model.predict(df) if model else df.withColumn("is_anomaly", F.lit(0.0))


def _assembled(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    numeric = df.withColumns({f"_f_{c}": F.col(c).cast("double") for c in features})
    return VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="features").transform(numeric)


def train_malware(spark: SparkSession, trees: int = 10, seed: int = 42) -> RandomForestClassificationModel:
    """Classifier on the baseline binaries."""
    rows = spark.createDataFrame(
        [(float(a), b, c, d, e, float(y)) for a, b, c, d, e, y in BASELINE_BINARIES],
        "entropy double, num_imports int, num_sections int, packer_detected int, signature_valid int, label double")
    return RandomForestClassifier(numTrees=trees, seed=seed).fit(_assembled(rows, BINARY_FEATURES))


def predict_malware(model: RandomForestClassificationModel, df: DataFrame) -> DataFrame:
    """Probability, verdict and confidence; missing features take their defaults."""
    scored = model.transform(_assembled(with_feature_defaults(df), BINARY_FEATURES))
    prob = vector_to_array("probability")[1]
    found = F.col("prediction") == 1.0
    return scored.withColumns({
        "malware_probability": F.round(prob, 4), "malware_detected": found,
        "confidence": F.round(F.when(found, prob).otherwise(1.0 - prob), 4),
    }).drop("features", "rawPrediction", "probability", "prediction", *[f"_f_{c}" for c in BINARY_FEATURES])


def split_rows(df: DataFrame, ident: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the id; stable under any partitioning and recomputation."""
    unit = F.pmod(F.xxhash64(F.col(ident), F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    return df.filter(unit >= test_share), df.filter(unit < test_share)


def train_threats(df: DataFrame, label: str, features: tuple[str, ...] = TRAFFIC_FEATURES, trees: int = 100,
                  depth: int = 10, seed: int = 42) -> PipelineModel:
    """Scale, then a random forest."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed),
    ]
    return Pipeline(stages=stages).fit(df)


def predict_threats(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("prob", vector_to_array("probability")[1]).drop(
        "raw", "features", "rawPrediction", "probability", "prediction")


DELAY_FEATURES = ("hour", "target_code", "priority")


def delay_history(df: DataFrame, ident: str, target: str, scheduled: str, hit: str, applied: str, seed: int = 42) -> DataFrame:
    """Features and label of past decisions: waited too little after a hit, perhaps too long otherwise."""
    jitter = F.pmod(F.xxhash64(F.col(ident), F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0 * 10.0 + 5.0
    label = F.when(F.col(hit), F.col(applied) + jitter).otherwise(F.greatest(F.lit(0.0), F.col(applied) - 1.0))
    return df.withColumns({
        "hour": F.hour(scheduled).cast("double"), "target_code": F.pmod(F.xxhash64(target), F.lit(1000)).cast("double"),
        "label": label})


def train_delay(history: DataFrame, seed: int = 42):
    return RandomForestRegressor(numTrees=10, maxDepth=5, seed=seed).fit(_assembled(history, DELAY_FEATURES))


def suggest_delay(model, jobs: DataFrame) -> DataFrame:
    scored = model.transform(_assembled(jobs, DELAY_FEATURES))
    return scored.withColumn("delay", F.greatest(F.lit(0.0), F.col("prediction"))).drop(
        "features", "prediction", *[f"_f_{c}" for c in DELAY_FEATURES])


def train_reward(feedback: DataFrame, vector: str, label: str, reg: float = 1e-4) -> LinearRegressionModel:
    """Regression of +1 / -1 targets on feedback vectors."""
    rows = feedback.select(
        array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("features"),
        F.when(F.col(label) == 1, 1.0).otherwise(-1.0).alias("label"))
    return LinearRegression(regParam=reg).fit(rows)


def predict_reward(model: LinearRegressionModel, df: DataFrame, vector: str) -> DataFrame:
    rows = df.withColumn("features", array_to_vector(F.transform(vector, lambda v: v.cast("double"))))
    return model.transform(rows).withColumnRenamed("prediction", "reward").drop("features")
