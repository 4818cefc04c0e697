"""Circuit breaker over a stream of attempts, its state kept by endpoint."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

# Failures in a row that open the circuit, and how long it stays open.
THRESHOLD, COOLDOWN_US = 3, 10_000_000


def states(attempts: DataFrame, threshold: int = THRESHOLD, cooldown_us: int = COOLDOWN_US) -> DataFrame:
    """``(endpoint, at_us, attempt_id, phase, failures)`` of a stream ``(endpoint string, at_us long, attempt_id long, outcome string)``.

    phase tells how the attempt was met: closed (admitted), open (refused, its
    outcome ignored) or half_open (admitted as the trial after the cooldown).
    success clears the failures in a row, failure adds one, other outcomes
    change nothing. Attempts of a micro-batch are taken by time, then id; those
    of later micro-batches come after. Memory holds one endpoint's part of a
    micro-batch: set a rate limit at the source. Attempts without a
    time are no attempts and left out; null endpoints are one endpoint.
    """

    def run(key, chunks, state):
        failures, last = state.get if state.exists else (0, 0)
        parts = list(chunks)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts)
        if len(rows) > 1:  # most endpoints have one attempt in a micro-batch, for which a sort would be most of the work
            rows = rows.sort_values(["at_us", "attempt_id"], kind="stable")
        phases, counts = [], []
        for at, outcome in zip(rows["at_us"].array, rows["outcome"].array, strict=True):
            tripped = failures >= threshold
            if tripped and at < last + cooldown_us:
                phases.append("open")
            else:
                phases.append("half_open" if tripped else "closed")
                if outcome == "success":
                    failures = 0
                elif outcome == "failure":
                    failures, last = failures + 1, int(at)
            counts.append(failures)
        state.update((failures, last))
        yield pd.DataFrame({"endpoint": rows["endpoint"], "at_us": rows["at_us"], "attempt_id": rows["attempt_id"], "phase": phases, "failures": counts})

    known = attempts.filter("at_us is not null").select("endpoint", "at_us", "attempt_id", "outcome")
    return known.groupBy("endpoint").applyInPandasWithState(run, "endpoint string, at_us long, attempt_id long, phase string, failures long", "failures long, last long", "append", GroupStateTimeout.NoTimeout)
