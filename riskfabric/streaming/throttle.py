"""Token bucket per key: batch over ordered sessions, and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfabric.operators.scan import KeyedScan
from riskfabric.session import cut
from riskfabric.streaming.ordered import HOUR_MS, folded

CAPACITY, REFILL = 100.0, 10.0
SLOW_CAPACITY, SLOW_REFILL = 10.0, 0.5


def take(times, tokens: float, last: int | None, capacity: float, rate: float):
    """Spend one token per time stamp (microseconds, ascending) where one is there."""
    allowed = []
    for now in times:
        if last is not None and now > last:
            tokens = min(capacity, tokens + (now - last) * rate / 1e6)
        last = now if last is None else max(last, now)
        ok = tokens >= 1.0
        if ok:
            tokens -= 1.0
        allowed.append(ok)
    return allowed, tokens, last


def throttle(df: DataFrame, key: str, order: list[str], capacity: float = CAPACITY, rate: float = REFILL, **scan: float) -> DataFrame:
    """Add `allowed` per row; order[0] is the time in microseconds.

    After a pause long enough to refill the bucket the past no longer matters, so each key is cut into sessions
    at such pauses and the sessions are spread over all tasks. Inside a session rows stream through a task in
    order, batch by batch with the bucket as the only state; nothing is gathered per key.
    """
    ts = order[0]
    pause = int(capacity / rate * 1e6) + 1
    scanner = KeyedScan(df, [key], order, **scan).lag([ts])
    fresh = F.when(F.col(f"{ts}_prev").isNull() | (F.col(ts) - F.col(f"{ts}_prev") >= pause), 1).otherwise(0)
    numbered = scanner.prefix_sum(fresh, "_session").done().drop(f"{ts}_prev")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    laid = numbered.repartition(key, "_session").sortWithinPartitions(key, "_session", *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tokens, last = None, capacity, None
        for pdf in batches:
            flags: list[bool] = []
            for group, part in pdf.groupby([key, "_session"], sort=False, dropna=False):
                if group != current:
                    current, tokens, last = group, capacity, None
                ok, tokens, last = take(part[ts].tolist(), tokens, last, capacity, rate)
                flags.extend(ok)
            yield pdf.drop(columns="_session").assign(allowed=flags)

    return laid.mapInPandas(run, f"{fields}, allowed boolean")


def throttle_jobs(df: DataFrame, target: str, source_ip: str, order: list[str], slow: bool = False,
                  limits: tuple[float, float] | None = None, **scan: float) -> DataFrame:
    """Target bucket first, then the source address bucket for jobs the target let pass."""
    capacity, rate = limits or ((SLOW_CAPACITY, SLOW_REFILL) if slow else (CAPACITY, REFILL))
    by_target = cut(throttle(df, target, order, capacity, rate, **scan).withColumnRenamed("allowed", "target_allowed"))
    passed = by_target.filter("target_allowed").drop("target_allowed")
    by_ip = throttle(passed, source_ip, order, capacity, rate, **scan)
    stopped = by_target.filter("NOT target_allowed").drop("target_allowed")
    return by_ip.withColumn("decision", F.when(F.col("allowed"), "executed").otherwise("ip_limit")).drop("allowed").unionByName(
        stopped.withColumn("decision", F.lit("target_limit")))


def throttle_stream(df: DataFrame, key: str, ident: str, ts_us: str, capacity: float = CAPACITY, rate: float = REFILL, delay: str = "10 minutes",
                    slice_ms: int = HOUR_MS) -> DataFrame:
    """The bucket as stream state: key, ident, time and `allowed`, decided in event-time order once the watermark (`delay` behind the newest row) has passed a row.

    The answer is that of `throttle` however the rows are cut into micro-batches and in whatever order they come within the delay. A key that
    was idle until its bucket is full again leaves no state.
    """
    def fold(group, state, rows):
        tokens, last = state or (capacity, None)
        ok, tokens, last = take([row[0] for row in rows], tokens, last, capacity, rate)
        return (tokens, last), [(group[0], row[1], row[0], allowed) for row, allowed in zip(rows, ok, strict=True)]

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = f"{key} {kinds[key]}, {ident} {kinds[ident]}, {ts_us} {kinds[ts_us]}, allowed boolean"
    return folded(df, key, [ts_us, ident], "tokens double, last bigint", fold, out, "append", delay, int(capacity / rate * 1000) + 1, slice_ms)
