"""Ordering policies in closed loop.

Rules that need only sums of what they have seen are folds and stay in the JVM; anything else is a policy object, run by
run_policy over one episode and arm at a time. In every period: observe, decide, clamp, dispatch, receive, sell, charge.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators.panel import ordered_fold


@dataclass(frozen=True)
class Observation:
    """What a policy may see: never the lead times, pauses or demand of its own period."""

    period: int
    on_hand: float
    in_transit: float
    prev_demand: float | None
    prev_arrivals: float
    profit: float
    holding: float
    alert: str | None = None


class Policy(Protocol):
    def order(self, seen: Observation) -> float: ...


class BaseStock:
    """Order up to cover periods of mean demand plus z deviations, at most a high quantile of one period's demand."""

    def __init__(self, lead: float, fractile: float, cap_quantile: float = 0.95):
        self.lead, self.z, self.cap_z, self.n, self.mean, self.m2 = lead, NormalDist().inv_cdf(fractile), NormalDist().inv_cdf(cap_quantile), 0, 0.0, 0.0

    def order(self, seen: Observation) -> float:
        if seen.prev_demand is not None:
            self.n += 1
            step = seen.prev_demand - self.mean
            self.mean += step / self.n
            self.m2 += step * (seen.prev_demand - self.mean)
        if not self.n:
            return 0.0
        sd = math.sqrt(self.m2 / (self.n - 1)) if self.n > 1 else 0.0
        goal = (1 + self.lead) * self.mean + self.z * math.sqrt(1 + self.lead) * sd
        return max(0, min(math.ceil(goal - seen.on_hand - seen.in_transit), math.ceil(self.mean + self.cap_z * sd)))


def clamp(quantity: float, cap: float) -> float:
    if not math.isfinite(quantity):
        raise ValueError(f"order {quantity}")
    return float(min(max(0, math.trunc(quantity)), cap))


def run_episode(rows: pd.DataFrame, policy: Policy, profit: float, holding: float, cap: float) -> list[tuple]:
    """rows: period, demand, lead_time (null or inf: lost), pause. A pause freezes what moves; what has arrived still lands."""
    stock, moving, out, prev, arrived = 0.0, [], [], None, 0.0
    for r in rows.sort_values("period").itertuples():
        seen = Observation(int(r.period), stock, sum(q for q, _ in moving), prev, arrived, profit, holding)
        quantity = clamp(policy.order(seen), cap)
        if quantity and pd.notna(r.lead_time) and math.isfinite(r.lead_time):
            moving.append((quantity, int(r.lead_time)))
        arrived = sum(q for q, left in moving if left <= 0)
        moving = [(q, left if r.pause else left - 1) for q, left in moving if left > 0]
        sold = min(r.demand, stock + arrived)
        stock += arrived - sold
        out.append((seen.period, quantity, arrived, float(sold), float(r.demand - sold), stock, profit * sold - holding * stock))
        prev = float(r.demand)
    return out


def run_policy(panel: DataFrame, make: Callable[[], Policy], profit: float, holding: float, cap: float = math.inf, key: str = "episode") -> DataFrame:
    """key, period, ordered, arrivals, sold, lost, on_hand_end, reward; a fresh policy for each key."""
    columns = ["period", "ordered", "arrivals", "sold", "lost", "on_hand_end", "reward"]

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(run_episode(rows, make(), profit, holding, cap), columns=columns)
        out.insert(0, key, group[0])
        return out

    kind = panel.schema[key].dataType.simpleString()
    return panel.groupBy(key).applyInPandas(run, f"{key} {kind}, period int, " + ", ".join(f"{c} double" for c in columns[1:]))


def capped_base_stock(panel: DataFrame, lead: int, fractile: float, cap_quantile: float, keys=("episode",)) -> DataFrame:
    """BaseStock with a constant lead time as a JVM fold: keys, stock, ordered and sold at the end. Whole-number demand."""
    z, cap_z = NormalDist().inv_cdf(fractile), NormalDist().inv_cdf(cap_quantile)
    t = "struct<stock:bigint,pipe:array<bigint>,n:bigint,s:bigint,q:bigint,ordered:bigint,sold:bigint>"
    zero = F.lit(0).cast("bigint")
    init = F.struct(zero.alias("stock"), F.array_repeat(zero, lead).alias("pipe"), zero.alias("n"), zero.alias("s"), zero.alias("q"), zero.alias("ordered"), zero.alias("sold")).cast(t)

    def step(st: Column, row: Column) -> Column:
        n, mean = st["n"], st["s"] / st["n"]
        sd = F.when(n > 1, F.sqrt((n * st["q"] - st["s"] * st["s"]) / (n * (n - 1)))).otherwise(0.0)
        held = st["stock"] + F.aggregate(st["pipe"], zero, lambda a, x: a + x)
        want = F.least(F.ceil((1 + lead) * mean + z * math.sqrt(1 + lead) * sd - held), F.ceil(mean + cap_z * sd))
        order = F.when(n == 0, zero).otherwise(F.greatest(zero, want))
        full = F.concat(st["pipe"], F.array(order))
        have = st["stock"] + full[0]
        sold = F.least(row["demand"], have)
        return F.struct((have - sold).alias("stock"), F.slice(full, 2, lead).alias("pipe"), (n + 1).alias("n"), (st["s"] + row["demand"]).alias("s"), (st["q"] + row["demand"] * row["demand"]).alias("q"), (st["ordered"] + order).alias("ordered"), (st["sold"] + sold).alias("sold")).cast(t)

    return ordered_fold(panel, keys, ["demand"], init, step).select(*keys, "result.stock", "result.ordered", "result.sold")
