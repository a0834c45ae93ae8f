"""Guided workflows as stream state: replay of start, advance and evidence events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from riskfabric.streaming.ordered import HOUR_MS, folded

#: 90 days.
IDLE_MS = 90 * 24 * HOUR_MS


def advance(step: int, kind: str, needs_evidence: Sequence[bool]) -> int:
    """Next step index; -1 is a workflow not yet started."""
    if step < 0:
        return 0 if kind == "start" else step
    if step >= len(needs_evidence):
        return step
    wanted = "evidence" if needs_evidence[step] else "advance"
    return step + 1 if kind == wanted else step


def state_name(step: int, needs_evidence: Sequence[bool]) -> str:
    if step < 0:
        return "PENDING"
    if step >= len(needs_evidence):
        return "COMPLETED"
    return "WAITING_EVIDENCE" if needs_evidence[step] else "IN_PROGRESS"


def workflow_stream(df: DataFrame, key: str, ts_us: str, kind: str, needs_evidence: Sequence[bool], delay: str = "10 minutes",
                    idle_ms: int = IDLE_MS, slice_ms: int = HOUR_MS) -> DataFrame:
    """(key, step_index, state) each time that events of the key are replayed, in event-time order and once the watermark has passed them; update mode.

    Equal times are replayed by kind. A workflow that nobody has touched for `idle_ms` leaves no state and would begin anew.
    """
    steps = list(needs_evidence)

    def fold(group, state, rows):
        (step,) = state or (-1,)
        for _, event in rows:
            step = advance(step, event, steps)
        return (step,), [(group[0], max(step, 0), state_name(step, steps))]

    kind_of = df.schema[key].dataType.simpleString()
    return folded(df, key, [ts_us, kind], "step int", fold, f"{key} {kind_of}, step_index int, state string", "update", delay, idle_ms, slice_ms)
