"""Ordered scans per key that stay parallel when one key holds much of the data.

A window partitioned by the key alone sorts a whole key in one task. Keys of up to `SPLIT_OVER` rows are left to such windows: one
exchange. The rows of longer keys are laid out by range of (key, order), so a hot key spreads over many partitions. The window
then runs per (key, partition), and what a partition needs from the ones before it (counts, sums, the last row) is carried over from
a table with a row per key and partition border, which is at most as long as there are partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskfabric.session import cut

#: Rows that one task may sort of a key.
SPLIT_OVER = 500_000
#: Keys above that size are broadcast up to this number, beyond it the join is left to Spark.
BROADCAST_KEYS = 100_000


class KeyedScan:
    """Rows of `df` scanned per `keys` in the order of `order`, which should be unique within a key."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], descending: bool = False,
                 ranges: int | None = None, split_over: int | None = None) -> None:
        """ranges: partitions of the layout, by default as many as shuffles have. split_over: a key with more rows is laid out;
        with `ranges` given and no `split_over`, every key is."""
        self.keys, self.order, self.descending = keys, order, descending
        self.ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        over = split_over if split_over is not None else 0 if ranges else SPLIT_OVER
        self.split = True
        if over <= 0 or (not keys and df.count() > over):
            self.df = self._laid(df)
            return
        hot = None if not keys else cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > over).select(
            *[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]))
        many = hot.count() if hot is not None else 0
        plain = F.lit(0).alias("_chunk")
        if not many:
            self.split = False
            self.df = df.select("*", plain)
            return
        listed = F.broadcast(hot) if many <= BROADCAST_KEYS else hot
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)])
        self.df = self._laid(df.join(listed, same, "left_semi")).unionByName(df.join(listed, same, "left_anti").select("*", plain))

    def _laid(self, df: DataFrame) -> DataFrame:
        """Rows by range; chunk 0 is that of the rows which need no layout."""
        place = F.spark_partition_id() + 1
        laid = df.repartitionByRange(self.ranges, *self.keys, *self.order)
        # Range borders come from a sample, so the layout is written out before anything is computed from it.
        return cut(laid.withColumn("_chunk", -place if self.descending else place))

    def _ordering(self) -> list[Column]:
        return [F.desc(c) if self.descending else F.asc(c) for c in self.order]

    def _rows(self):
        return Window.partitionBy(*self.keys, *(["_chunk"] if self.split else [])).orderBy(*self._ordering())

    def _chunks(self):
        return Window.partitionBy(*self.keys).orderBy("_chunk")

    def _ends(self, *values: Column) -> DataFrame:
        """One row per key and chunk of the layout."""
        return self.df.filter(F.col("_chunk") != 0).groupBy(*self.keys, "_chunk").agg(*values)

    def _carry(self, table: DataFrame) -> None:
        """Join a per-(key, chunk) table, restricted to the chunks of a key after its first, back to the rows."""
        names = [f"_t{i}" for i in range(len(self.keys))]
        values = [c for c in table.columns if c != "_chunk" and c not in self.keys]
        renamed = table.select(
            F.col("_chunk").alias("_tc"), *[F.col(k).alias(n) for k, n in zip(self.keys, names)], *values)
        on = F.col("_chunk") == F.col("_tc")
        for name, key in zip(names, self.keys):
            on = on & F.col(key).eqNullSafe(F.col(name))
        self.df = self.df.join(F.broadcast(renamed), on, "left").drop("_tc", *names)

    def row_number(self, out: str) -> KeyedScan:
        return self.prefix_sum(F.lit(1), out)

    def prefix_sum(self, value: Column, out: str, inclusive: bool = True) -> KeyedScan:
        """Running sum of `value`, this row included or not."""
        self.df = self.df.withColumn("_v", value)
        frame = self._rows().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        running = F.coalesce(F.sum("_v").over(frame), F.lit(0))
        if self.split:
            before = F.sum("_s").over(self._chunks().rowsBetween(Window.unboundedPreceding, -1))
            self._carry(self._ends(F.sum("_v").alias("_s")).withColumn("_before", before).filter(
                F.col("_before").isNotNull()).select(*self.keys, "_chunk", "_before"))
            running = running + F.coalesce("_before", F.lit(0))
        self.df = self.df.withColumn(out, running).drop("_v", "_before")
        return self

    def lag(self, columns: list[str], suffix: str = "_prev") -> KeyedScan:
        """Value of each column in the row before, across chunk borders."""
        packed = F.struct(*[F.col(c).alias(c) for c in columns])
        self.df = self.df.withColumn("_p", F.lag(packed).over(self._rows()))
        if self.split:
            pick = F.min_by if self.descending else F.max_by
            ends = self._ends(pick(packed, F.struct(*self.order)).alias("_end"))
            self._carry(ends.withColumn("_c", F.lag("_end").over(self._chunks())).filter(F.col("_c").isNotNull()).select(
                *self.keys, "_chunk", "_c"))
            self.df = self.df.withColumn("_p", F.coalesce("_p", "_c")).drop("_c")
        self.df = self.df.withColumns({f"{c}{suffix}": F.col("_p")[c] for c in columns}).drop("_p")
        return self

    def last_value(self, value: Column, out: str) -> KeyedScan:
        """Last non-null value seen so far, this row included."""
        self.df = self.df.withColumn("_v", value)
        frame = self._rows().rowsBetween(Window.unboundedPreceding, 0)
        self.df = self.df.withColumn("_l", F.last("_v", ignorenulls=True).over(frame))
        if self.split:
            pick = F.min_by if self.descending else F.max_by
            ends = self._ends(pick(F.col("_v"), F.when(F.col("_v").isNotNull(), F.struct(*self.order))).alias("_end"))
            carried = F.last("_end", ignorenulls=True).over(self._chunks().rowsBetween(Window.unboundedPreceding, -1))
            self._carry(ends.withColumn("_c", carried).filter(F.col("_c").isNotNull()).select(*self.keys, "_chunk", "_c"))
            self.df = self.df.withColumn("_l", F.coalesce("_l", "_c")).drop("_c")
        self.df = self.df.withColumn(out, F.col("_l")).drop("_v", "_l")
        return self

    def done(self) -> DataFrame:
        return self.df.drop("_chunk")
