"""Exact top-k by inner product through a pivot-distance index.

Vectors are lifted by one coordinate, sqrt(M - |x|^2) with M the largest squared norm, and queries by 0; then
|q - x|^2 = |q|^2 + M - 2 q.x, so the highest scores are the nearest vectors. Each vector is keyed by its nearest pivot
and the annulus of its distance to it. |d(q, p) - d(x, p)| <= d(q, x), so a query with k scores of at least s in hand needs
no annulus whose distances lie further than sqrt(|q|^2 + M - 2 s) from its own: annuli are expanded outward from the
query's own in two rounds, the first around its nearest pivot, and the bound of the first stops the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskfabric.session import cut

SCALE = 1024
PIVOTS = 16
#: Annuli from a pivot to its furthest vector.
RINGS = 8
#: Vectors of a cell (an annulus or a part of a crowded one) and queries that meet it in one task.
CELL_ROWS = 4096
CELL_QUERIES = 2048
#: Vectors whose scores give each query its first bound.
SEEDS = 1024


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) per component as longs; null for null vectors and for null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of longs, shorter ones filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in integers; through doubles where every partial sum is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 2**52 else a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Row by row, the places of the k highest scores, ties to smaller ids."""
    for row in scores:
        near = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
        yield near[np.lexsort((ids[near], -row[near]))[:k]]


def top_k(base: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "vector",
          pivots: int = PIVOTS, rings: int = RINGS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """`query_id`, `rank`, id and `score` of the k highest integer inner products of each query with the other base rows.

    Vectors are arrays of longs, shorter ones count as filled with zeros; rows without a vector take no part. Equal scores go to the smaller id. Repeated base rows (same id, same vector) count once, repeated queries
    are answered once. A base row of the query's own id is not a candidate. Only the two columns are read.
    """
    spark = base.sparkSession
    rows = cut(base.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_x")).filter("_id is not null and _x is not null").distinct())
    asked = queries.select(F.col(id_col).alias("_qid"), F.col(vector_col).alias("_q")).filter("_qid is not null and _q is not null").distinct()
    norm = "aggregate(_x, 0D, (s, v) -> s + CAST(v AS DOUBLE) * v)"
    top_norm, wide, wide_query = rows.agg(F.max(F.expr(norm)), F.max(F.size("_x"))).first() + asked.agg(F.max(F.size("_q"))).first()
    top_norm, width = top_norm or 0.0, max(1, wide or 0, wide_query or 0)
    seeds = rows.orderBy(F.xxhash64("_id"), "_id").limit(SEEDS).toPandas()
    schema = "_query long, _rank int, _id long, _score long"
    if seeds.empty:
        return spark.createDataFrame([], schema).select(F.col("_query").alias("query_id"), F.col("_rank").alias("rank"), F.col("_id").alias(id_col), F.col("_score").alias("score"))
    seed_ids = seeds["_id"].to_numpy(np.int64)
    seed_rows = _matrix(pa.array(seeds["_x"].tolist(), pa.list_(pa.int64())), width)
    centre, first = np.unique(seed_rows[:pivots * 8], axis=0, return_index=True)
    centre = centre[np.argsort(first)][:pivots]
    lifted = np.hstack([centre, np.sqrt(np.maximum(0, top_norm - (centre.astype(float) ** 2).sum(1)))[:, None]])

    def distances(x: np.ndarray, rise: np.ndarray) -> np.ndarray:
        x = np.hstack([x.astype(float), rise[:, None]])
        return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (lifted**2).sum(1) - 2 * x @ lifted.T))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("_x"), width)
            d = distances(x, np.sqrt(np.maximum(0, top_norm - (x.astype(float) ** 2).sum(1))))
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_x"), pa.array(near, pa.int32()), pa.array(d[np.arange(len(near)), near])],
                                             names=["_id", "_x", "_pivot", "_d"])

    index = cut(rows.mapInArrow(keyed, "_id long, _x array<long>, _pivot int, _d double"))
    # At most `rings` annuli for a pivot, of equal width; crowded ones are cut into cells by a hash of the id.
    widths = {r["_pivot"]: max(r["far"] / rings, 1e-9) for r in index.groupBy("_pivot").agg(F.max("_d").alias("far")).collect()}
    width_of = F.element_at(F.create_map(*[F.lit(v) for pair in widths.items() for v in pair]), F.col("_pivot"))
    index = index.withColumn("_ring", F.least(F.floor(F.col("_d") / width_of).cast("int"), F.lit(rings - 1)))
    cells = index.groupBy("_pivot", "_ring").agg(F.count(F.lit(1)).alias("_n"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    cells = cells.withColumn("_parts", F.ceil(F.col("_n") / cell_rows).cast("int"))
    bounds = [(r["_pivot"], r["_ring"], r["_lo"], r["_hi"], r["_parts"]) for r in cells.collect()]  # pivots x rings rows at most
    order = {(p, r): i for i, (p, r, *_) in enumerate(bounds)}
    cell_pivot, cell_lo, cell_hi, parts = (np.array([b[i] for b in bounds]) for i in (0, 2, 3, 4))
    cell_of = F.element_at(F.create_map(*[F.lit(v) for (p, r), i in order.items() for v in (p * rings + r, i)]), F.col("_pivot") * rings + F.col("_ring"))
    parts_of = F.element_at(F.array(*[F.lit(int(n)) for n in parts]), F.col("_cell") + 1)
    blocks = index.withColumn("_cell", cell_of).select("_cell", F.pmod(F.xxhash64("_id"), parts_of).cast("int").alias("_part"), "_id", "_x")

    slack = 1e-6 * (1 + float(np.sqrt(top_norm)))

    def reachable(q: np.ndarray, score: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Queries x annuli: False where no vector of the annulus can reach the score."""
        radius = np.sqrt(np.maximum(0, (q.astype(float) ** 2).sum(1) + top_norm - 2 * score)) * (1 + 1e-9) + slack
        own = d[:, cell_pivot]
        return (own - radius[:, None] <= cell_hi) & (own + radius[:, None] >= cell_lo)

    def visits(near_only: bool):
        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                qid, q = batch.column("_qid").to_numpy(), _matrix(batch.column("_q"), width)
                d = distances(q, np.zeros(len(q)))
                if near_only:
                    scores = _products(q, seed_rows)
                    scores = np.where(qid[:, None] == seed_ids, np.iinfo(np.int64).min, scores)
                    bound = np.partition(scores, -k, axis=1)[:, -k] if len(seed_ids) > k else np.full(len(q), np.iinfo(np.int64).min)
                else:
                    bound = batch.column("_bound").to_numpy()
                usable = bound > np.iinfo(np.int64).min
                open_cells = reachable(q, np.where(usable, bound, 0), d) | ~usable[:, None]
                first = cell_pivot[None, :] == d.argmin(1)[:, None]
                who, cell = np.nonzero(open_cells & (first if near_only else ~first))
                times = parts[cell]
                who, cell = np.repeat(who, times), np.repeat(cell, times)
                part = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(part, pa.int32()), pa.array(qid[who]),
                                                  batch.column("_q").take(pa.array(who)), pa.array(bound[who])], names=["_cell", "_part", "_qid", "_q", "_bound"])
        return plan

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["_query", "_id", "_score"]
        kinds = pa.schema([(n, pa.int64()) for n in names])
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        x, ids = _matrix(right.column("_x").combine_chunks(), width), right.column("_id").to_numpy()
        q, qid, bound = _matrix(left.column("_q").combine_chunks(), width), left.column("_qid").to_numpy(), left.column("_bound").to_numpy()
        out = []
        for i in range(0, len(q), CELL_QUERIES):
            scores = _products(q[i:i + CELL_QUERIES], x)
            scores[qid[i:i + CELL_QUERIES, None] == ids] = np.iinfo(np.int64).min
            for own, floor, row, best in zip(qid[i:], bound[i:], scores, _best(scores, ids, k), strict=False):
                best = best[row[best] >= max(floor, np.iinfo(np.int64).min + 1)]
                out.append(np.stack([np.full(len(best), own), ids[best], row[best]]))
        found = np.hstack(out)
        return pa.Table.from_arrays([pa.array(c) for c in found], schema=kinds)

    visit = "_cell int, _part int, _qid long, _q array<long>, _bound long"
    keys = ["_cell", "_part", "_turn"]

    def searched(plan: DataFrame) -> DataFrame:
        """The best k of each query and cell. Many queries of a cell take turns, each with a copy of the cell."""
        turns = max(1, -(-asked_rows // (CELL_QUERIES * 4)))
        left = plan.withColumn("_turn", F.pmod(F.xxhash64("_qid"), F.lit(turns)).cast("int"))
        right = blocks.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))) if turns > 1 else blocks.withColumn("_turn", F.lit(0))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "_query long, _id long, _score long")

    def ranked(found: DataFrame) -> DataFrame:
        order_by = Window.partitionBy("_query").orderBy(F.desc("_score"), "_id")
        return found.distinct().withColumn("_rank", F.row_number().over(order_by)).filter(F.col("_rank") <= k)

    asked = cut(asked)
    asked_rows = asked.count()
    near = cut(ranked(searched(asked.mapInArrow(visits(True), visit))))
    bound = near.groupBy("_query").agg(F.count(F.lit(1)).alias("_n"), F.min("_score").alias("_least")).filter(F.col("_n") >= k)
    bounded = asked.join(bound, asked["_qid"] == bound["_query"], "left").select(
        "_qid", "_q", F.coalesce("_least", F.lit(-(2**63))).cast("long").alias("_bound"))
    rest = searched(bounded.mapInArrow(visits(False), visit))
    return ranked(near.select("_query", "_id", "_score").unionByName(rest)).select(
        F.col("_query").alias("query_id"), F.col("_rank").cast("int").alias("rank"), F.col("_id").alias(id_col), F.col("_score").alias("score"))
