"""Validation with a quarantine side: one pass, an error column, two outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PAYLOAD_BYTES = 10 * 1024 * 1024


def with_errors(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Add `error`: the message of the first rule that does not hold, null for a good row."""
    checks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for message, ok in rules]
    return df.withColumn("error", F.coalesce(*checks))


def split_valid(df: DataFrame, rules: list[tuple[str, Column]], source: Column, payload: Column,
                timestamp: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected rows shaped for the quarantine sink."""
    checked = with_errors(df, rules)
    good = checked.filter(F.col("error").isNull()).drop("error")
    bad = checked.filter(F.col("error").isNotNull()).select(
        source.alias("source"), (timestamp if timestamp is not None else F.current_timestamp()).alias("timestamp"),
        "error", payload.cast("string").alias("payload"),
    )
    return good, bad


def payload_fits(payload: Column, limit: int = MAX_PAYLOAD_BYTES) -> Column:
    return F.octet_length(payload) <= limit


def in_range(col: Column, low: float, high: float) -> Column:
    return col.isNotNull() & (col >= low) & (col <= high)


def is_json_object(payload: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT"), F.lit(False))


def allowed_source(source: Column, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(source.isin(*allowed), F.lit(False))


def write_quarantine(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("source").json(path)
