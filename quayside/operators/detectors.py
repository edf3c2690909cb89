"""Change detectors, suppression and schedules.

A decision in period t knows the value of period t - 1: that is the value which enters a statistic at t, and none enters
in a key's first period.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators.panel import UP_TO, nearest_rank, ordered_fold, over


def entering(panel: DataFrame, value: str, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """panel with _x, the value of the row before."""
    return panel.withColumn("_x", F.lag(value).over(over(keys)).cast("double"))


def cusum_path(panel: DataFrame, value: str, mu: Column, slack: Column, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Two-sided CUSUM without restarts: running sums above their running minimum of 0."""
    w = over(keys, frame=UP_TO)
    side = lambda sign: F.sum(F.coalesce(sign * (F.col("_x") - mu) - slack, F.lit(0.0))).over(w)
    rows = entering(panel, value, keys).withColumns({"_u": side(1), "_d": side(-1)})
    above = lambda c: F.col(c) - F.least(F.lit(0.0), F.min(c).over(w))
    return rows.withColumns({"up": above("_u"), "down": above("_d")}).drop("_u", "_d", "_x")


def page_hinkley_path(panel: DataFrame, value: str, mu: Column, delta: Column, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Two-sided Page-Hinkley without restarts; 0 counts as an extreme of both sums."""
    w = over(keys, frame=UP_TO)
    total = lambda sign: F.sum(F.coalesce(F.col("_x") - mu + sign * delta, F.lit(0.0))).over(w)
    rows = entering(panel, value, keys).withColumns({"_u": total(-1), "_l": total(1)})
    up = F.col("_u") - F.least(F.lit(0.0), F.min("_u").over(w))
    down = F.greatest(F.lit(0.0), F.max("_l").over(w)) - F.col("_l")
    return rows.withColumns({"up": up, "down": down}).drop("_u", "_l", "_x")


def first_fire(path: DataFrame, threshold: Column, rule: str = "cusum", keys: Sequence[str] = ("episode",)) -> DataFrame:
    """First period whose statistic exceeds threshold, strictly, and which side fired: rule_up or rule_down."""
    top = F.greatest("up", "down")
    side = F.when(F.col("up") >= F.col("down"), f"{rule}_up").otherwise(f"{rule}_down")
    fired = F.when(top > threshold, F.struct("period", side.alias("rule"), top.alias("statistic")))
    found = path.withColumn("_f", fired).groupBy(*keys).agg(F.min("_f").alias("_f"))
    return found.select(*keys, F.col("_f.period").alias("period"), F.col("_f.rule").alias("rule"), F.col("_f.statistic").alias("statistic"))


def with_restarts(panel: DataFrame, value: str, rule: str, mu: float, slack: float, threshold: float, window: int, cap: int, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """A detector with a refractory window and a cap: keys, fires (period, rule, statistic) and suppressed, the firings withheld.

    Both detectors keep a sum above its own least value on each side, CUSUM with a slack and Page-Hinkley with its delta,
    against a fixed mean. Only a permitted firing restarts the sums; withheld ones keep adding up.
    """
    fire_type = "struct<period:int,rule:string,statistic:double>"
    t = f"struct<up:double,down:double,last:int,suppressed:int,fires:array<{fire_type}>>"
    init = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(None).cast("int").alias("last"), F.lit(0).alias("suppressed"), F.array().cast(f"array<{fire_type}>").alias("fires")).cast(t)

    def step(s: Column, row: Column) -> Column:
        entered = lambda side, sign: F.coalesce(F.greatest(F.lit(0.0), s[side] + (sign * (row["_x"] - mu) - slack)), s[side])
        moved = F.struct(F.when(row["_x"].isNull(), s["up"]).otherwise(entered("up", 1)).alias("up"), F.when(row["_x"].isNull(), s["down"]).otherwise(entered("down", -1)).alias("down"))
        up, down, period = moved["up"], moved["down"], row["period"].cast("int")
        top = F.greatest(up, down)
        over_it = top > threshold
        fire = over_it & (s["last"].isNull() | (period - s["last"] > window)) & (F.size(s["fires"]) < cap)
        fired = F.concat(s["fires"], F.array(F.struct(period.alias("period"), F.when(up >= down, f"{rule}_up").otherwise(f"{rule}_down").alias("rule"), top.alias("statistic"))))
        return F.struct(
            F.when(fire, 0.0).otherwise(up).alias("up"), F.when(fire, 0.0).otherwise(down).alias("down"), F.when(fire, period).otherwise(s["last"]).alias("last"),
            (s["suppressed"] + F.when(over_it & ~fire, 1).otherwise(0)).alias("suppressed"), F.when(fire, fired).otherwise(s["fires"]).alias("fires"),
        ).cast(t)

    return ordered_fold(entering(panel, value, keys), keys, ["_x"], init, step).select(*keys, "result.fires", "result.suppressed")


def proposals(folded: DataFrame, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """A row for each permitted firing of with_restarts."""
    return folded.select(*keys, F.explode("fires").alias("f")).select(*keys, "f.period", "f.rule", "f.statistic")


def suppressed_cusum(panel: DataFrame, value: str, mu: float, slack: float, threshold: float, window: int, cap: int, keys: Sequence[str] = ("episode",)) -> DataFrame:
    return proposals(with_restarts(panel, value, "cusum", mu, slack, threshold, window, cap, keys), keys)


def suppressed_page_hinkley(panel: DataFrame, value: str, mu: float, delta: float, threshold: float, window: int, cap: int, keys: Sequence[str] = ("episode",)) -> DataFrame:
    return proposals(with_restarts(panel, value, "page_hinkley", mu, delta, threshold, window, cap, keys), keys)


def alert_trigger(observations: DataFrame, alert: str, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Periods that have an alert."""
    return observations.where(F.col(alert).isNotNull()).select(*keys, "period")


def scheduled(observations: DataFrame, schedule: DataFrame, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Periods on a schedule (period): a registered handful, the same for every key."""
    return observations.join(F.broadcast(schedule.select("period").distinct()), "period", "left_semi").select(*keys, "period")


def refractory(events: DataFrame, window: int, keys: Sequence[str] = ("episode",), cap: int | None = None) -> DataFrame:
    """Events more than window periods after the last one kept, the first cap of them."""
    t = "struct<last:int,kept:array<int>>"
    init = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("kept")).cast(t)

    def step(s: Column, row: Column) -> Column:
        p = row["period"].cast("int")
        keep = s["last"].isNull() | (p - s["last"] > window)
        keep = keep & (F.size(s["kept"]) < cap) if cap is not None else keep
        return F.struct(F.when(keep, p).otherwise(s["last"]).alias("last"), F.when(keep, F.concat(s["kept"], F.array(p))).otherwise(s["kept"]).alias("kept")).cast(t)

    return ordered_fold(events, keys, [], init, step).select(*keys, F.explode("result.kept").alias("period"))


def either_channel(alerts: DataFrame, detections: DataFrame, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Periods in which a channel fired, and the rule that names which."""
    both = alerts.select(*keys, "period", F.lit("alert").alias("rule")).unionByName(detections.select(*keys, "period", F.lit("detector").alias("rule"))).distinct()
    return both.groupBy(*keys, "period").agg(F.array_join(F.sort_array(F.collect_list("rule")), "+").alias("rule"))


def even_schedule(spark, n: int, horizon: int, spacing: int) -> DataFrame:
    """n firing periods evenly over 1..horizon, at least spacing apart."""
    step = max(spacing, horizon // n) if n else 0
    return spark.range(n).select((F.col("id") + 1).alias("slot"), (F.lit(1) + F.col("id") * step).alias("period")).where(F.col("period") <= horizon)


def calibrated_threshold(paths: DataFrame, q: float, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Nearest-rank quantile of the keys' largest statistics, and how many keys exceed it."""
    tops = paths.groupBy(*keys).agg(F.max(F.greatest("up", "down")).alias("top"))
    threshold = nearest_rank(tops, "top", [q]).select(F.col("value").alias("threshold"))
    return tops.join(F.broadcast(threshold)).groupBy("threshold").agg(F.count("*").alias("episodes"), F.count_if(F.col("top") > F.col("threshold")).alias("fires"))
