"""Sequential tests, filters and hypothesis lifecycles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators.panel import UP_TO, ordered_fold, over


def log_sum_exp(values: Column) -> Column:
    """Of an array, shifted by its maximum."""
    top = F.array_max(values)
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def mixture_eprocess(ratios: DataFrame, components: Sequence[str], weights: Sequence[float], alpha: float, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Running log wealth of each component, the mixture's log e-value, and the first period at or above log(1 / alpha), which sticks."""
    w = over(keys, frame=UP_TO)
    wealth = ratios.withColumns({f"_w{k}": F.sum(c).over(w) + math.log(p) for k, (c, p) in enumerate(zip(components, weights, strict=True))})
    value = log_sum_exp(F.array(*[F.col(f"_w{k}") for k in range(len(components))]))
    rows = wealth.withColumn("log_e", value).drop(*[f"_w{k}" for k in range(len(components))])
    crossed = F.min(F.when(F.col("log_e") >= -math.log(alpha), F.col("period"))).over(w)
    return rows.withColumn("crossed_at", crossed)


def alpha_schedule(spark, alpha: float, proposals: int) -> DataFrame:
    """A budget of alpha halved at each proposal, with the thresholds on e-values."""
    share = F.lit(alpha) * F.pow(F.lit(0.5), F.col("id") + 1)
    return spark.range(proposals).select((F.col("id") + 1).alias("proposal"), share.alias("alpha"), (1 / share).alias("threshold"))


def consecutive_guard(panel: DataFrame, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Rows whose period does not follow the one before."""
    return panel.withColumn("before", F.lag("period").over(over(keys))).where("before is not null and before + 1 <> period").select(*keys, "before", "period")


def regime_filter(panel: DataFrame, value: str, means: tuple[float, float], sds: tuple[float, float], stay: tuple[float, float], prior: float = 0.05, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Forward filter of a two-state Gaussian regime model: each key's last probability of the second state, and its largest."""

    def density(x: Column, k: int) -> Column:
        z = (x - means[k]) / sds[k]
        return F.exp(-z * z / 2) / sds[k]

    init = F.struct(F.lit(prior).alias("p"), F.lit(prior).alias("top"))

    def step(s: Column, row: Column) -> Column:
        x = row[value].cast("double")
        ahead = s["p"] * stay[1] + (1 - s["p"]) * (1 - stay[0])
        one, two = (1 - ahead) * density(x, 0), ahead * density(x, 1)
        p = F.when(one + two > 0, two / (one + two)).otherwise(ahead)
        return F.struct(p.alias("p"), F.greatest(s["top"], p).alias("top"))

    return ordered_fold(panel, keys, [value], init, step).select(*keys, F.col("result.p").alias("last_p"), F.col("result.top").alias("max_p"))


def lifecycle(points: DataFrame, alpha: float, refute_below: float, streak: int, lifetime: int, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """proposed → active, refuted or expired, by log e-values: expiry first, then activation, then a streak of low evidence."""
    t = "struct<state:string,at:int,low:int,born:int>"
    init = F.struct(F.lit("proposed").alias("state"), F.lit(None).cast("int").alias("at"), F.lit(0).alias("low"), F.lit(None).cast("int").alias("born")).cast(t)

    def step(s: Column, row: Column) -> Column:
        period = row["period"].cast("int")
        born = F.coalesce(s["born"], period)
        low = F.when(row["log_e"] < refute_below, s["low"] + 1).otherwise(0)
        live = s["state"].isin("proposed", "active")
        new = F.when(~live, s["state"]).when(period - born >= lifetime, "expired").when((s["state"] == "proposed") & (row["log_e"] >= -math.log(alpha)), "active").when(low >= streak, "refuted").otherwise(s["state"])
        return F.struct(new.alias("state"), F.when(new != s["state"], period).otherwise(s["at"]).alias("at"), low.alias("low"), born.alias("born")).cast(t)

    return ordered_fold(points, keys, ["log_e"], init, step).select(*keys, "result.state", F.col("result.at").alias("changed_at"))


def compound_activation(first: DataFrame, second: DataFrame, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Both streams must have crossed; the later crossing activates."""
    both = first.select(*keys, F.col("crossed_at").alias("a")).join(second.select(*keys, F.col("crossed_at").alias("b")), list(keys), "full")
    return both.select(*keys, F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.greatest("a", "b")).alias("activated_at"))


def contradicted(panel: DataFrame, value: str, mean: Column, sd: Column, z: float, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """First period that ends two consecutive values below mean - z sd."""
    below = F.col(value) < mean - z * sd
    rows = panel.withColumn("_b", below).withColumn("_two", F.col("_b") & F.coalesce(F.lag("_b").over(over(keys)), F.lit(False)))
    return rows.groupBy(*keys).agg(F.min(F.when(F.col("_two"), F.col("period"))).alias("rolled_back_at"))


def shift_delays(state: Column, entering: Column, paused: Column) -> tuple[Column, Column]:
    """One period of a shipment pipeline held as an array by remaining periods: what lands, and the array after."""
    emitted = F.when(paused, F.lit(0)).otherwise(F.element_at(state, 1))
    moved = F.when(paused, state).otherwise(F.concat(F.slice(state, 2, F.size(state) - 1), F.array(F.lit(0))))
    return emitted, F.zip_with(moved, entering, lambda a, b: a + b)
