"""The lifecycle of proposals over a stream: one ordered state machine for each key, on event time.

Rows may come in any order within the watermark's delay. A key's state holds what has not been passed by the watermark; a
timer stands at the time of each of its periods and at the end of each proposal's lifetime. As the watermark passes them,
periods are taken in order: a proposal is conditioned in its period tau, bets on values after tau only, and is active,
refuted or expired as in control.lifecycle_events, whose events these are. A lifetime ends by its timer although nothing
more arrives. What is kept for a key is its open proposals and the periods under way; both go as they are done with.

The session needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event time of a period: so many milliseconds after the epoch each.
PERIOD_MS = 60_000
OPEN, ACTIVE = "proposed", "active"


def at_time(period) -> F.Column:
    return F.timestamp_millis(F.col(period).cast("long") * PERIOD_MS)


class Lifecycle(StatefulProcessor):
    """Input rows: key, time, period, demand (null on a proposal's row), proposal (null on a period's row), multiplier, lifetime."""

    def __init__(self, key: str, mean: float, sd: float, alpha: float, refute_below: float, streak: int):
        self.key, self.mean, self.sd, self.alpha, self.refute_below, self.streak = key, mean, sd, alpha, refute_below, streak

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "period int", "demand double")
        self.proposals = handle.getMapState("proposals", "proposal int", "tau int, multiplier double, lifetime int, log_e double, low int, state string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in rows:
            if row.proposal is None:
                self.waiting.updateValue((row.period,), (row.demand,))
                self.handle.registerTimer(row.period * PERIOD_MS)
            else:
                self.proposals.updateValue((row.proposal,), (row.period, row.multiplier, row.lifetime, 0.0, 0, OPEN))
                self.handle.registerTimer(row.period * PERIOD_MS)
                self.handle.registerTimer((row.period + row.lifetime + 1) * PERIOD_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """All periods up to the timer's, in order; several timers may fall due at once, and the first to come does the work."""
        now = expiredTimerInfo.getExpiryTimeInMs() // PERIOD_MS
        due = {k[0]: v[0] for k, v in self.waiting.iterator() if k[0] <= now}
        live = {k[0]: tuple(v) for k, v in self.proposals.iterator()}
        ends = {tau + lifetime + 1 for tau, _, lifetime, *_ in live.values() if tau + lifetime + 1 <= now}
        begins = {tau for tau, *_ in live.values() if tau <= now}
        out = []
        for period in sorted({*due, *ends, *begins}):
            for number in sorted(live):
                before = live[number]
                live[number], event = self.step(number, before, period, due.get(period))
                if event:
                    out.append(Row(**{self.key: key[0]}, proposal=number, tau=before[0], period=int(period), event=event))
        for number, state in live.items():
            if state[5] in (OPEN, ACTIVE, "conditioned"):
                self.proposals.updateValue((number,), state)
            else:
                self.proposals.removeKey((number,))
        for period in due:
            self.waiting.removeKey((period,))
        return iter(out)

    def step(self, number: int, proposal: tuple, period: int, demand: float | None) -> tuple[tuple, str | None]:
        tau, multiplier, lifetime, log_e, low, state = proposal
        if period < tau or state in ("refuted", "expired"):
            return proposal, None
        if period - tau > lifetime:
            return (*proposal[:5], "expired"), "expired"
        if period == tau:
            return ((*proposal[:5], "conditioned"), "conditioned") if state == OPEN else (proposal, None)
        if demand is None:
            return proposal, None
        shift = (multiplier - 1) * self.mean
        log_e += (shift * (demand - self.mean) - shift * shift / 2) / (self.sd * self.sd)
        low = low + 1 if log_e < self.refute_below else 0
        if low >= self.streak:
            return (tau, multiplier, lifetime, log_e, low, "refuted"), "refuted"
        if state != ACTIVE and log_e >= -(math.log(self.alpha) + number * math.log(0.5)):
            return (tau, multiplier, lifetime, log_e, low, ACTIVE), "activated"
        return (tau, multiplier, lifetime, log_e, low, state), None


def stream_lifecycle(rows: DataFrame, key: str, delay: timedelta, **law) -> DataFrame:
    """key, proposal, tau, period and event. rows: key, period, demand, proposal, multiplier, lifetime; law: of Lifecycle."""
    timed = rows.withColumn("time", at_time("period")).withWatermark("time", f"{int(delay.total_seconds())} seconds")
    kind = rows.schema[key].dataType.simpleString()
    return timed.groupBy(key).transformWithState(
        Lifecycle(key, **law), outputStructType=f"{key} {kind}, proposal int, tau int, period int, event string", outputMode="append", timeMode="EventTime"
    )
