"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two longs up to which a side may be broadcast (3 MB); counted before use, larger sides are shuffled.
BROADCAST_ROWS = 200_000
#: Bytes of an Arrow batch of whole texts; Spark's own bound of 64 MB holds for each task in the JVM and again in its Python worker.
TEXT_BATCH = 4 << 20
#: Spark's bound as its configuration gives it.
DEFAULT_BATCH = "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def small_or_shuffled(side: DataFrame, rows: int = BROADCAST_ROWS, to_exploded: bool = False) -> DataFrame:
    """The side with a broadcast hint if it was counted to be small, else left to a shuffled join.

    With `to_exploded` what it is joined to comes from an explode, whose rows Spark does not foresee, and is not broadcast by size either.
    """
    if side.count() <= rows:
        return F.broadcast(side)
    return side.hint("merge") if to_exploded else side


def bound_batches(spark: SparkSession) -> None:
    """From now on the session sends batches of about TEXT_BATCH bytes to Python, unless it was told a size of its own. Batches hold whole rows; results do not depend on them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == DEFAULT_BATCH:
        spark.conf.set(name, str(TEXT_BATCH))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: lambda arguments are bound, column expressions may be repeated."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(frame: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key(*columns: Column) -> Column:
    """A text that names a row by its values: equal rows have equal keys, nulls differ from every value."""
    return F.md5(F.concat_ws("/", *[F.coalesce(F.concat(F.length(v), F.lit(":"), v), F.lit("-")) for v in (c.cast("string") for c in columns)]))
