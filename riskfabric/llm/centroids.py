"""Exact Lloyd rounds over integer vectors, centroids filtered in a rotated space.

The vectors' principal axes give an orthonormal rotation. Each vector is stored with its leading rotated coordinates and the
norm of the rest. For a vector x and a centroid c, |x - c|^2 >= |lead(x) - lead(c)|^2 + (rest(x) - rest(c))^2, since the rest of
x - c is no shorter than the difference of the two rests' norms. The centroid of the least bound is measured in integers first;
only centroids whose bound does not exceed that distance are measured too, in integers, so results are exact whatever the
rotation's rounding. Tasks send one row per centroid and component, never vectors, and centroids are the only thing that is sent back.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfabric.session import cut

#: Leading rotated coordinates that are stored.
LEADING = 16
#: Components below this size keep squared distances within 64 bits; larger ones are counted in Python's integers.
PLAIN = 2**26
LARGEST = 2**63 - 1
#: Vectors that are compared with all centroids at once.
BLOCK = 4096
WHOLE = pa.decimal128(38, 0)


def kept(vector: Column, width: int) -> Column:
    """True for vectors of exactly `width` components, none null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == width) & finite, F.lit(False))


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64; where components are large as Python's integers, those past 64 bits as the end of that range."""
    whole = np.floor(values.astype(np.float64) * scale)
    if not whole.size or np.abs(whole).max() < PLAIN:
        return whole.astype(np.int64)
    out = np.empty(whole.shape, dtype=object)
    out.ravel()[:] = [int(v) if abs(v) < 2.0**63 else LARGEST if v > 0 else -LARGEST - 1 for v in whole.ravel()]
    return out


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((x - centre) ** 2).sum(1)


class Rotation:
    """Centre and principal axes of the vectors, and what bounds are computed from."""

    def __init__(self, centre: np.ndarray, axes: np.ndarray, leading: int) -> None:
        self.centre, self.axes = centre, axes[:, :leading]

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates, and the norm of the rest."""
        x = x.astype(np.float64) - self.centre
        lead = x @ self.axes
        return lead, np.sqrt(np.maximum(0.0, (x**2).sum(1) - (lead**2).sum(1)))


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """The number of the nearest centroid (ties: the smaller), the squared distance, and how many distances were measured."""
    own_lead, own_rest = rotation.project(centroids)
    rows = np.arange(len(x))
    lengths = (lead**2).sum(1) + rest**2
    # Rounding grows with the lengths that cancel in the bound.
    slack = 1e-9 * (1 + lengths[:, None] + ((own_lead**2).sum(1) + own_rest**2)[None, :])
    bound = (lead**2).sum(1)[:, None] + (own_lead**2).sum(1) - 2 * lead @ own_lead.T + (rest[:, None] - own_rest) ** 2 - slack
    first = bound.argmin(1)
    best, choice = _squared(x, centroids[first]), first.astype(np.int64)
    who, which = np.nonzero(bound <= best.astype(np.float64)[:, None] * (1 + 1e-12))
    other = which != first[who]
    who, which = who[other], which[other]
    measured = _squared(x[who], centroids[which])
    # Centroid by centroid: a vector occurs once for each, so plain assignment is safe.
    order = np.argsort(which, kind="stable")
    who, which, measured = who[order], which[order], measured[order]
    for start, stop in zip(*(lambda e: (e[:-1], e[1:]))(np.searchsorted(which, np.arange(len(centroids) + 1))), strict=True):
        if start < stop:
            row, value, number = who[start:stop], measured[start:stop], which[start]
            better = (value < best[row]) | ((value == best[row]) & (number < choice[row]))
            best[row[better]], choice[row[better]] = value[better], number
    return choice, best, len(rows) + len(who)


def _rotation(spark_rows: DataFrame, width: int, scale: int, leading: int) -> Rotation | None:
    """Principal axes of all vectors from one pass of sums and products."""
    size = 1 + width + width * width

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            x = quantised(_rows(batch.column("_x"), width), scale).astype(np.float64)
            total += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["_at", "_value"])

    sums = np.zeros(size)
    for row in spark_rows.select("_x").mapInArrow(moments, "_at int, _value double").groupBy("_at").agg(F.sum("_value").alias("_value")).collect():
        sums[row["_at"]] = row["_value"]
    if not sums[0]:
        return None
    centre = sums[1:1 + width] / sums[0]
    spread = sums[1 + width:].reshape(width, width) / sums[0] - np.outer(centre, centre)
    axes = np.linalg.eigh(spread)[1][:, ::-1] if np.isfinite(spread).all() else np.eye(width)
    return Rotation(centre, axes, min(leading, width))


def cluster(vectors: DataFrame, clusters: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: str = "2",
            id_col: str = "vec_id", vector_col: str = "embedding", leading: int = LEADING) -> DataFrame:
    """id, `cluster`, `distance`, `cluster_inertia`, `inertia` and `centroid` of every vector after `rounds` Lloyd rounds.

    Vectors have exactly `width` finite components, each taken as floor(scale * x); all others give no row. Centroids start as
    the vectors whose ids have the smallest lowercase-hex SHA-256 of `seed:id` (ids without value: `seed:`; equal ids by
    components), as many as there are up to `clusters`. Every row counts, repeated ones too. Nearest is by squared Euclidean distance, ties to the
    smaller centroid; a round replaces every centroid that has vectors by the floor of their mean, per component. `centroid` is
    an array of the final centroid's components as decimal texts. Components, distances and sums past 64 bits stand as the end of that range. An
    empty table gives an empty one. Only the two columns are read.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_x")).filter(kept(F.col("_x"), width))
    id_type, vector_type = (plain.schema[c].dataType.simpleString() for c in ("_id", "_x"))
    rotation = _rotation(plain, width, scale, leading)
    out = [F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    if rotation is None:
        return spark.createDataFrame([], f"_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<string>").select(*out)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column("_x"), width)
            lead, rest = rotation.project(quantised(x, scale))
            offsets = pa.array(np.arange(len(x) + 1) * lead.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_x"), pa.ListArray.from_arrays(offsets, pa.array(lead.ravel())), pa.array(rest)],
                                             names=["_id", "_x", "_lead", "_rest"])

    index = cut(plain.mapInArrow(stored, f"_id {id_type}, _x {vector_type}, _lead array<double>, _rest double"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    first = plain.orderBy(digest, "_x").limit(clusters).collect()  # as many rows as centroids
    centroids = [[int(v) for v in quantised(np.array([row["_x"]]), scale)[0]] for row in first]

    def assigned(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                x = quantised(_rows(part.column("_x"), width), scale)
                lead = _rows(part.column("_lead"), rotation.axes.shape[1])
                # One side of Python's integers makes the arithmetic exact.
                choice, best, _ = nearest(x, lead, part.column("_rest").to_numpy(), centres, rotation)
                yield part, x, choice, best

    def as_array(rows: list[list[int]]) -> np.ndarray:
        large = any(abs(v) >= PLAIN for row in rows for v in row)
        return np.array(rows, dtype=object if large else np.int64)

    def sums_for(centres: np.ndarray):
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(len(centres), np.int64), np.zeros((len(centres), width), dtype=object)
            for _, x, choice, _ in assigned(batches, centres):
                for c in np.unique(choice):
                    own = x[choice == c]
                    count[c] += len(own)
                    total[c] += own.sum(0).astype(object)
            hit = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(hit, width), pa.int32()), pa.array(np.tile(np.arange(width), len(hit)), pa.int32()),
                 pa.array(np.repeat(count[hit], width)), pa.array([Decimal(int(v)) for v in total[hit].ravel()], WHOLE)],
                names=["_cluster", "_at", "_n", "_sum"])
        return sums

    for _ in range(rounds):
        moved = index.mapInArrow(sums_for(as_array(centroids)), "_cluster int, _at int, _n long, _sum decimal(38,0)")
        # clusters x components rows
        for row in moved.groupBy("_cluster", "_at").agg(F.sum("_n").alias("_n"), F.sum("_sum").cast("string").alias("_sum")).collect():
            centroids[row["_cluster"]][row["_at"]] = int(row["_sum"]) // row["_n"]

    final = as_array(centroids)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, choice, best in assigned(batches, final):
            best = pa.array([min(int(v), LARGEST) for v in best] if best.dtype == object else best, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(choice, pa.int32()), best], names=["_id", "cluster", "distance"])

    found = cut(index.mapInArrow(labelled, f"_id {id_type}, cluster int, distance long"))
    per = {r["cluster"]: int(r["_sum"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_sum")).collect()}
    total = min(LARGEST, sum(per.values()))
    facts = spark.createDataFrame([(c, min(LARGEST, s), [str(v) for v in centroids[c]]) for c, s in per.items()],
                                  "cluster int, cluster_inertia long, centroid array<string>")
    # One row per centroid.
    return found.join(F.broadcast(facts), "cluster").withColumn("inertia", F.lit(total).cast("long")).select(*out)
