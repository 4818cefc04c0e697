"""Snapshot runs as a stateful stream: phases in their order, a pending commit that survives, its receipt.

Each run's phase, last event and pending facts are typed state; a timer tells of a
commit that waits too long. The state lives in the stream's checkpoint, so a
stream that is killed and started again goes on as if it had not been.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that typed state and timers need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

# Phases, and those that each may be followed by. Windows are extracted, normalised, validated and staged one by one; a
# window that is too large sends the run back to its plan.
FOLLOWS = {
    "": ("prepare",), "prepare": ("capability",), "capability": ("identity",), "identity": ("plan",), "plan": ("extract", "reconcile"), "extract": ("normalize", "plan"), "normalize": ("validate",),
    "validate": ("stage",), "stage": ("extract", "reconcile"), "reconcile": ("commit_pending",), "commit_pending": (), "proof": ("completed", "partial"),
}
TERMINAL = ("completed", "partial", "failed", "cancelled")
#: Event that isn't a phase: the store's receipt of the commit that is pending.
RECEIPT = "receipt"

OUT = "run string, seq long, event string, phase string, outcome string"


def step(phase: str, facts: str | None, event: str, given: str | None) -> tuple[str, str | None, str]:
    """``(phase, pending facts, outcome)`` after an event: moved, refused, terminal, or receipt_mismatch."""
    if phase in TERMINAL:
        return phase, facts, "terminal"
    if event in ("failed", "cancelled"):
        return event, None, "moved"
    if event == RECEIPT:
        if phase != "commit_pending":
            return phase, facts, "refused"
        return ("proof", None, "moved") if given == facts else ("failed", None, "receipt_mismatch")
    if event not in FOLLOWS[phase]:
        return phase, facts, "refused"
    return event, given if event == "commit_pending" else facts, "moved"


class Runs(StatefulProcessor):
    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "phase string, seq long, facts string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        phase, last, facts = self.state.get() if self.state.exists() else ("", 0, None)
        parts = list(rows)
        events = parts[0] if len(parts) == 1 else pd.concat(parts)
        if len(events) > 1:  # most runs have few events in a micro-batch, for which a sort would be most of the work
            events = events.sort_values(["seq", "at"], kind="stable")
        out = []
        for seq, event, given in zip(events["seq"], events["event"], events["facts"], strict=True):
            if seq <= last:
                outcome = "replayed"
            elif seq > last + 1:
                outcome = "gap"
            else:
                phase, facts, outcome = step(phase, facts, event, None if pd.isna(given) else given)
                last = int(seq)
            out.append((key[0], int(seq), event, phase, outcome))
        self.state.update((phase, last, facts))
        if self.wait_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if phase == "commit_pending":
                self.handle.registerTimer(max(int(events["at"].max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.wait_ms)
        yield pd.DataFrame(out, columns=["run", "seq", "event", "phase", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        phase, last, _ = self.state.get()
        yield pd.DataFrame([(key[0], last, "timer", phase, "resume")] if phase == "commit_pending" else [], columns=["run", "seq", "event", "phase", "outcome"])

    def close(self) -> None:
        pass


def outcomes(events: DataFrame, wait: str | None = None, late: str = "1 day") -> DataFrame:
    """``(run, seq, event, phase, outcome)`` of a stream ``(run string, seq long, at timestamp, event string, facts string)``.

    Events of a run count from 1 and are taken in order: one that was there is replayed, one beyond the next is a gap, neither changes
    the run. An event that may not follow is refused. A receipt with the facts of the pending commit leads to its proof, one
    with others fails the run. With ``wait`` (an interval such as ``1 hour``) a commit that has been pending so long in
    event time gives a row with the outcome ``resume``; events that come more than ``late`` after later ones are lost then, as of any
    watermark (without ``wait`` none is). Memory holds one run's events of a micro-batch. Null runs are one run.
    The session must use ``STATE_STORE``.
    """
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000) if wait else 0
    timed = events.withWatermark("at", late) if wait else events
    return timed.groupBy("run").transformWithStateInPandas(Runs(wait_ms), OUT, "Append", "EventTime" if wait else "None")
