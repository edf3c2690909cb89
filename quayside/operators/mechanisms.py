"""Facts about why an arm can or cannot serve a shock: what its orders can still reach, and the level its forecast implies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.operators.panel import running_forecast


def landing_clock(landings: DataFrame, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """landings (keys, period, landing) with soonest, when the first of the orders from this period on lands, and by, the
    last period whose order lands then.

    A later order may land before an earlier one, and pauses hold several back: this is a running minimum from the end, so
    that no pair of orders is looked at.
    """
    w = Window.partitionBy(*keys).orderBy("period").rowsBetween(0, Window.unboundedFollowing)
    first = F.min(F.when(F.col("landing").isNotNull(), F.struct("landing", (-F.col("period")).alias("back")))).over(w)
    return landings.withColumn("_first", first).withColumns({"soonest": F.col("_first.landing"), "by": -F.col("_first.back")}).drop("_first")


def reach(clock: DataFrame, windows: DataFrame, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """windows (keys, period of an order, first, last) with own and any: how many periods of the window that order, or any
    order from it on, can still serve."""
    rows = windows.join(clock, [*keys, "period"], "left")
    served = lambda at: F.when(at.isNull(), 0).otherwise(F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first"), at) + 1)).cast("int")
    return rows.withColumns({"own": served(F.col("landing")), "any": served(F.col("soonest"))})


def implied_ratios(panel: DataFrame, onsets: DataFrame, offsets: Sequence[int], value: str = "demand", keys: Sequence[str] = ("episode",)) -> DataFrame:
    """keys and a ratio for each offset from the onset: the multiplied running mean over the true level after the shock.

    The running mean climbs toward the new level by itself, so that a fixed multiplier counts the shift twice. onsets: keys,
    onset, multiplier, level.
    """
    rows = running_forecast(panel, value, keys).join(onsets, list(keys))
    ratio = F.col("multiplier") * F.col("mean") / F.col("level")
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("period") == F.col("onset") + k, ratio)).alias(f"ratio_{k}") for k in offsets])


def landings_around(clock: DataFrame, onsets: DataFrame, offsets: Sequence[int], keys: Sequence[str] = ("episode",)) -> DataFrame:
    """keys and where the order of each offset from the onset lands (null: never)."""
    name = lambda k: f"lands_{'m' if k < 0 else 'p'}{abs(k)}"
    rows = clock.join(onsets.select(*keys, "onset"), list(keys))
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("period") == F.col("onset") + k, F.col("landing"))).alias(name(k)) for k in offsets])


def window_landings(clock: DataFrame, onsets: DataFrame, length: Column, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """keys, landed (orders of the window from the onset that land at all) and after (where the first order after it lands)."""
    rows = clock.join(onsets.select(*keys, "onset", length.alias("_length")), list(keys))
    inside = (F.col("period") >= F.col("onset")) & (F.col("period") < F.col("onset") + F.col("_length"))
    return rows.groupBy(*keys).agg(F.count(F.when(inside, F.col("landing"))).alias("landed"), F.max(F.when(F.col("period") == F.col("onset") + F.col("_length"), F.col("landing"))).alias("after"))
