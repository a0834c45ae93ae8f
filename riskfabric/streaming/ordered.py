"""Folds of a key's rows in event-time order, as stream state.

Rows wait in state until the watermark has passed them; then one slice of event time after the other is sorted and folded. A key with few waiting rows keeps them in
one value; those of others lie in blocks by slice, so a task holds one slice of one key at a time, however many rows a key has and in whatever micro-batches they came. A key is woken by a timer when the watermark reaches its
first waiting row, and by another when it has been idle so long that its state need not be kept. Rows that come after the watermark has passed
them are dropped by Spark, as in windowed aggregates.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000
#: Waiting rows that a key keeps in one value, and output rows that are handed on at once.
FEW, OUT_ROWS = 1_000, 10_000
NEVER, NOTHING = -(1 << 62), pickle.dumps([])


class OrderedFold(StatefulProcessor):
    """fold(key, state or None, rows) -> (state, output rows); rows are tuples that start with the time in microseconds, in order."""

    def __init__(self, columns: list[str], state: str, fold: Callable[[Any, tuple | None, list[tuple]], tuple[tuple, list[tuple]]],
                 output: list[str], idle_ms: int, slice_ms: int) -> None:
        self.columns, self.state, self.fold, self.output, self.idle_ms, self.slice_ms = columns, state, fold, output, idle_ms, slice_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.state)
        #: Time of the last folded row (or NEVER), blocks stored since none waited, and the rows that wait outside blocks, of any slice:
        #: all of a key that has few. They stand in one value, since each access to state is a call out of Python.
        self.place = handle.getValueState("place", "last long, blocks long, near binary")
        self.waiting = handle.getMapState("waiting", "slice long, block long", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        for piece in rows:
            self.near.extend(zip(*[piece[c].tolist() for c in self.columns], strict=True))
            self._spill()
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _load(self) -> None:
        self.last, self.blocks, near = self.place.get() if self.place.exists() else (NEVER, 0, NOTHING)
        self.near: list[tuple] = pickle.loads(near)

    def _by_slice(self) -> dict[int, list[tuple]]:
        found: dict[int, list[tuple]] = {}
        for row in self.near:
            found.setdefault(row[0] // (self.slice_ms * 1000), []).append(row)
        return found

    def _spill(self) -> None:
        """More than FEW rows wait in blocks of one slice each."""
        if len(self.near) <= FEW:
            return
        for number, own in self._by_slice().items():
            self.waiting.updateValue((number, self.blocks), (pickle.dumps(own),))
            self.blocks += 1
        self.near = []

    def _advance(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        """Folds what the watermark has passed, keeps the rest and sets the next timer."""
        slices: dict[int, list[int]] = {}
        if self.blocks:
            for number, block in self.waiting.keys():
                slices.setdefault(number, []).append(block)
        near = self._by_slice()
        wake, out, folded, state = None, [], False, None
        for number in sorted(slices.keys() | near.keys()):
            start = number * self.slice_ms
            if start >= watermark:
                wake = start + 1
                break
            rows = near.get(number, []) + [row for block in slices.get(number, ()) for row in pickle.loads(self.waiting.getValue((number, block))[0])]
            rows.sort()
            ready = [row for row in rows if row[0] // 1000 < watermark]
            if ready:
                if not folded and self.last > NEVER:
                    state = self.value.get()
                state, more = self.fold(key, state, ready)
                out += more
                folded, self.last = True, ready[-1][0] // 1000
                for block in slices.pop(number, ()):
                    self.waiting.removeKey((number, block))
                near[number] = rows[len(ready):]
                if len(out) >= OUT_ROWS:
                    yield pd.DataFrame(out, columns=self.output)
                    out = []
            if len(ready) < len(rows):
                wake = rows[len(ready)][0] // 1000 + 1
                break
        if out:
            yield pd.DataFrame(out, columns=self.output)
        if not slices:
            self.blocks = 0
        self.near = [row for rows in near.values() for row in rows]
        if wake is None:
            if self.last == NEVER:
                return  # an older timer of a key that has left
            if self.last + self.idle_ms < watermark:
                self.value.clear()
                self.place.clear()
                return
            wake = self.last + self.idle_ms + 1
        self._spill()
        if folded:
            self.value.update(state)
        self.place.update((self.last, self.blocks, pickle.dumps(self.near)))
        self.handle.registerTimer(max(wake, watermark + 1))


def folded(df: DataFrame, key: str, columns: list[str], state: str, fold, output: str, mode: str, delay: str, idle_ms: int, slice_ms: int = HOUR_MS) -> DataFrame:
    """The fold over a stream; columns[0] is the time in microseconds, the whole tuple orders rows of one time. State is kept in RocksDB."""
    df.sparkSession.conf.set(PROVIDER, ROCKSDB)
    timed = df.select(key, *columns).withColumn("_at", F.timestamp_micros(columns[0])).withWatermark("_at", delay)
    names = [part.split()[0] for part in output.split(", ")]
    return timed.groupBy(key).transformWithStateInPandas(OrderedFold(columns, state, fold, names, idle_ms, slice_ms), output, mode, "eventTime")
