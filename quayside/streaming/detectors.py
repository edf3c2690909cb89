"""Structured Streaming forms of the stateful operators: the same steps, one state per key, in event order.

Periods must arrive in order for each key; a period at or before the last one seen is an error, as in the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def cusum_step(state: tuple, period: int, x: float, mu: float, slack: float, threshold: float, window: int, cap: int) -> tuple[tuple, tuple[str, float] | None]:
    """The new state (up, down, last firing, firings, last period, its value) and the rule and statistic if the detector fires.

    The value of the period before enters; this period's is kept for the next.
    """
    up, down, last, fires, before, entered = state
    if before >= period:
        raise ValueError(f"period {period} after {before}")
    if before >= 0:
        up, down = max(0.0, up + (entered - mu - slack)), max(0.0, down + (mu - entered - slack))
    top = max(up, down)
    if top > threshold and (last < 0 or period - last > window) and fires < cap:
        return (0.0, 0.0, period, fires + 1, period, x), ("cusum_up" if up >= down else "cusum_down", top)
    return (up, down, last, fires, period, x), None


def stream_cusum(stream: DataFrame, key: str, value: str, mu: float, slack: float, threshold: float, window: int, cap: int) -> DataFrame:
    """key, period, rule, statistic of each permitted firing, as rows arrive."""

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = (state.get if state.exists else (0.0, 0.0, -1, 0, -1, 0.0)), []
        rows = pd.concat(list(batches)).sort_values("period")
        for period, x in zip(rows["period"], rows[value], strict=True):
            now, fired = cusum_step(tuple(now), int(period), float(x), mu, slack, threshold, window, cap)
            if fired is not None:
                out.append((group[0], int(period), *fired))
        state.update(now)
        yield pd.DataFrame(out, columns=[key, "period", "rule", "statistic"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(
        run, outputStructType=f"{key} {kind}, period int, rule string, statistic double", stateStructType="up double, down double, last long, fires long, before long, entered double", outputMode="append", timeoutConf=GroupStateTimeout.NoTimeout
    )


def stream_totals(stream: DataFrame, time: str, late: str, window: str, keys: list[str], value: str) -> DataFrame:
    """Sums of value by key and event-time window; rows later than late are dropped by the watermark."""
    from pyspark.sql import functions as F

    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.sum(value).alias("total"), F.count("*").alias("rows"))
