"""Orders, arrivals and lost sales: closed forms where the plan is fixed, a fold where orders answer to the state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quayside.operators.panel import BEFORE, UP_TO, ordered_fold, over


def clamp_order(quantity: Column, cap: Column) -> Column:
    """Truncated toward zero, at least 0, at most cap; null if not finite."""
    ok = quantity.isNotNull() & ~F.isnan(quantity) & (F.abs(quantity) != float("inf"))
    return F.when(ok, F.least(F.greatest(F.lit(0.0), F.when(quantity < 0, F.ceil(quantity)).otherwise(F.floor(quantity)).cast("double")), cap))


def arrival_keyed(panel: DataFrame, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Arrivals by period: orders land lead_time periods later; a null lead time is a lost shipment."""
    landed = panel.where("lead_time is not null").select(*keys, (F.col("period") + F.col("lead_time")).cast("int").alias("period"), "ordered")
    return landed.groupBy(*keys, "period").agg(F.sum("ordered").alias("arrivals"))


def with_arrivals(panel: DataFrame, keys: Sequence[str] = ("episode",)) -> DataFrame:
    return panel.join(arrival_keyed(panel, keys), [*keys, "period"], "left").withColumn("arrivals", F.coalesce("arrivals", F.lit(0)))


def landing_with_pause(panel: DataFrame, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Landing period of each order when a pause stops the clock of shipments under way.

    The clock before period u counts unpaused periods; an order lands in the first period whose clock is the order's
    clock plus its lead time, which is an equi join as the clock moves by one at most.
    """
    clock = F.coalesce(F.sum(F.when(F.col("pause"), 0).otherwise(1)).over(over(keys, frame=BEFORE)), F.lit(0))
    timed = panel.withColumn("_clock", clock)
    first = timed.groupBy(*keys, F.col("_clock").alias("_goal")).agg(F.min("period").alias("_at"))
    orders = timed.where("lead_time is not null").withColumn("_goal", F.col("_clock") + F.col("lead_time"))
    return orders.join(first, [*keys, "_goal"], "left").select(*keys, "period", F.when(F.col("_at").isNotNull(), F.greatest("_at", "period")).alias("landing"))


def lost_sales_path(panel: DataFrame, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """on_hand_end, sold, lost by period, from empty stock: with S the running sum of arrivals less demand, stock ends at S - min(0, min S)."""
    s = F.sum(F.col("arrivals") - F.col("demand")).over(over(keys, frame=UP_TO))
    rows = panel.withColumn("_s", s).withColumn("on_hand_end", F.col("_s") - F.least(F.lit(0), F.min("_s").over(over(keys, frame=UP_TO))))
    start = F.coalesce(F.lag("on_hand_end").over(over(keys)), F.lit(0))
    rows = rows.withColumn("sold", start + F.col("arrivals") - F.col("on_hand_end"))
    return rows.withColumn("lost", F.col("demand") - F.col("sold")).drop("_s")


def in_transit_path(panel: DataFrame, keys: Sequence[str] = ("episode",), lost_visible: bool = False) -> DataFrame:
    """Units under way at the start of each period: ordered before it, less landed before it; lost ones only if visible."""
    sent = F.col("ordered") if lost_visible else F.when(F.col("lead_time").isNotNull(), F.col("ordered")).otherwise(0)
    w = over(keys, frame=BEFORE)
    return panel.withColumn("in_transit", F.coalesce(F.sum(sent).over(w) - F.sum("arrivals").over(w), F.lit(0)))


def episode_totals(path: DataFrame, profit: float, holding: float, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Sums of a path, reward, and reward as a share of perfect foresight, floored at 0."""
    totals = path.groupBy(*keys).agg(F.sum("demand").alias("demand"), F.sum("sold").alias("sold"), F.sum("lost").alias("lost"), F.sum("on_hand_end").alias("held"))
    reward = profit * F.col("sold") - holding * F.col("held")
    best = profit * F.col("demand")
    return totals.withColumn("reward", reward).withColumn("normalized_reward", F.when(best > 0, F.greatest(F.lit(0.0), F.col("reward") / best)).otherwise(0.0)).withColumn("fill_rate", F.when(F.col("demand") > 0, F.col("sold") / F.col("demand")).otherwise(1.0))


def fifo_ages(orders: DataFrame, receipts: DataFrame, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Receipts attributed to the oldest orders: overlaps of the cumulative intervals of both. Exact while no receipt exceeds what is outstanding.

    The ends of both kinds of intervals, in one order, cut the units into pieces; the next end of each kind at or after a
    piece names its order and its receipt, so that no orders are held against all receipts.
    """

    def ends(frame: DataFrame, value: str, name: str) -> DataFrame:
        end = F.sum(value).over(over(keys, frame=UP_TO))
        rows = frame.withColumn("_end", end).where(F.col(value) > 0)
        return rows.select(*keys, "_end", *[(F.col("period") if n == name else F.lit(None).cast(frame.schema["period"].dataType)).alias(f"{n}_period") for n in ("o", "r")])

    cuts = ends(orders, "ordered", "o").unionByName(ends(receipts, "received", "r")).groupBy(*keys, "_end").agg(F.max("o_period").alias("o_period"), F.max("r_period").alias("r_period"))
    w = Window.partitionBy(*keys).orderBy("_end")
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    pieces = cuts.select(*keys, *[F.first(c, ignorenulls=True).over(ahead).alias(c) for c in ("o_period", "r_period")], (F.col("_end") - F.coalesce(F.lag("_end").over(w), F.lit(0))).alias("units"))
    return pieces.where("o_period is not null and r_period is not null").select(*keys, "o_period", "r_period", "units", (F.col("r_period") - F.col("o_period")).alias("age"))


def base_stock_path(panel: DataFrame, cover: int, cap: int, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """A base-stock policy in closed loop: target cover times the mean demand seen (rounded up), immediate arrivals, lost sales.

    Orders answer to the stock, so this is a fold over each episode.
    """
    init = F.struct(F.lit(0).cast("long").alias("stock"), F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("ordered"), F.lit(0).cast("long").alias("sold"))

    def step(s: Column, row: Column) -> Column:
        target = F.when(s["seen"] == 0, F.lit(0)).otherwise(F.ceil(cover * s["sum"] / s["seen"]))
        order = F.least(F.greatest(F.lit(0), target - s["stock"]), F.lit(cap)).cast("long")
        sold = F.least(row["demand"], s["stock"] + order)
        return F.struct((s["stock"] + order - sold).cast("long").alias("stock"), (s["seen"] + 1).cast("long").alias("seen"), (s["sum"] + row["demand"]).cast("long").alias("sum"), (s["ordered"] + order).cast("long").alias("ordered"), (s["sold"] + sold).cast("long").alias("sold"))

    return ordered_fold(panel, keys, ["demand"], init, step).select(*keys, "result.stock", "result.ordered", "result.sold")


def order_sequences_equal(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: are the two order sequences the same, period by period?"""
    both = a.select(*keys, "period", F.col("ordered").alias("_a")).join(b.select(*keys, "period", F.col("ordered").alias("_b")), [*keys, "period"], "full")
    return both.groupBy(*keys).agg(F.every(F.col("_a").eqNullSafe(F.col("_b"))).alias("identical"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("differences"))

