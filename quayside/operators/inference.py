"""Intervals, randomisation tests, multiplicity, frontiers."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quayside.operators.panel import numbered, running_total


def z_of(confidence: float) -> float:
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def mean_interval(frame: DataFrame, value: str, by: Sequence[str] = (), z: float = 1.959963984540054) -> DataFrame:
    """Mean with a normal interval, of no width where there is one row."""
    half = F.coalesce(z * F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0))
    return frame.groupBy(*by).agg(F.avg(value).alias("estimate"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"), F.count(value).alias("n"))


def stratified_interval(frame: DataFrame, value: str, strata: Sequence[str], weights: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Weighted mean of strata and its interval; weights renormalised over strata that have rows."""
    cells = frame.groupBy(*strata).agg(F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"), F.count(value).alias("n")).join(F.broadcast(weights), list(strata))
    total = F.sum("weight")
    mean, var = F.sum(F.col("weight") * F.col("m")) / total, F.sum(F.col("weight") * F.col("weight") * F.col("v") / F.col("n")) / (total * total)
    return cells.agg(mean.alias("estimate"), (mean - z * F.sqrt(var)).alias("low"), (mean + z * F.sqrt(var)).alias("high"), F.sum("n").alias("n"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Score interval of a proportion."""
    p, zz = k / n, z * z
    middle, width = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return (middle - width) / (1 + zz / n), (middle + width) / (1 + zz / n)


def upper_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, to 7.5e-8: a rational approximation of the error function by powers of 1 / (1 + p z)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * poly


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * upper_tail(F.abs(z)))


def signed_rank(frame: DataFrame, value: str) -> DataFrame:
    """Wilcoxon's signed ranks by the normal approximation: zeros dropped, average ranks, no corrections."""
    x = frame.where(F.col(value) != 0).select(F.col(value).alias("d"), F.abs(value).alias("a"))
    # average ranks from counts of values
    counts = x.groupBy("a").agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("plus"))
    ranked = running_total(counts, ["a"], F.col("c"), "before")
    w = ranked.agg(F.sum("c").alias("n"), F.sum(F.col("plus") * (F.col("before") + (F.col("c") + 1) / 2)).alias("w"))
    n = F.col("n")
    z = F.try_divide(F.col("w") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    return w.select(n, F.col("w"), F.when(n > 0, two_sided(z)).otherwise(1.0).alias("p_value"))


def sign_flip_exact(frame: DataFrame, value: str, limit: int = 20) -> DataFrame:
    """Two-sided sign-flip test of a mean of zero: exact for at most limit values (2^limit signs, spread over tasks), by the normal approximation for more, then with flips 0."""
    known, x = frame.where(F.col(value).isNotNull()), F.col(value)
    moments = known.agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), (F.min(x) == F.max(x)).alias("same"))
    values = known.limit(limit + 1).agg(F.sort_array(F.collect_list(value)).alias("d")).select(F.when(F.size("d") <= limit, F.col("d")).alias("d"))
    masks = values.select("d", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.size("d")).cast("int") - 1)).alias("mask"))
    signed = lambda x, i: F.when(F.floor(F.col("mask") / F.pow(F.lit(2), i)) % 2 == 1, x).otherwise(-x)
    flip = masks.select("d", F.aggregate(F.transform("d", signed), F.lit(0.0), lambda s, x: s + x).alias("s"), F.aggregate("d", F.lit(0.0), lambda s, x: s + x).alias("t"))
    exact = flip.agg(F.count("*").alias("flips"), F.try_divide(F.count_if(F.abs("s") >= F.abs("t") - 1e-9), F.count("*")).alias("exact"))
    normal = F.when(F.col("same"), F.when(F.col("mean") == 0, 1.0).otherwise(0.0)).otherwise(two_sided(F.try_divide(F.col("mean") * F.sqrt("n"), F.col("sd"))))
    return exact.join(F.broadcast(moments)).select("flips", F.when(F.col("n") <= limit, F.col("exact")).otherwise(normal).alias("p_value"))


def half_sums(spark: SparkSession, values: Sequence[float], name: str) -> DataFrame:
    """Sums of all signings of at most some twenty values, with how many signings have each."""
    sign = lambda i: F.when(F.shiftright("id", i).bitwiseAND(1) == 1, 1.0).otherwise(-1.0)
    whole = sum((sign(i) * float(v) for i, v in enumerate(values)), F.lit(0.0))
    return spark.range(1 << len(values)).select(whole.alias(name)).groupBy(name).agg(F.count("*").alias("k"))


def sign_flip_halves(frame: DataFrame, value: str, cluster: str, limit: int = 40, tie: float = 1e-9) -> DataFrame:
    """clusters, signings and p_exact, one-sided for a mean above zero: the share of all signings of whole cluster sums that
    reach the observed sum. Null for more than limit clusters.

    The clusters are parted in two halves, whose signings are 2^(n/2) sums each. Both halves are merged in one order by ranges
    of value: a sum of one half meets all of the other that reach what it lacks, which a running count of them tells. So 40
    clusters take twice a million rows instead of 2^40.
    """
    sums = frame.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).cast("double").alias("s"), F.count("*").alias("n"))
    found = sums.orderBy("s", cluster).limit(limit + 1).collect()  # limit + 1 numbers at most
    spark = frame.sparkSession
    if not found or len(found) > limit:
        return sums.agg(F.count("*").alias("clusters"), F.lit(0).cast("long").alias("signings"), F.lit(None).cast("double").alias("p_exact"))
    values, rows = [r.s for r in found], sum(r.n for r in found)
    goal = sum(values) - tie * max(float(rows), abs(sum(values)))
    left, right = half_sums(spark, values[::2], "x"), half_sums(spark, values[1::2], "x")
    # of equal places, what is lacking comes before the sums that meet it
    asked = left.select((F.lit(goal) - F.col("x")).alias("x"), F.lit(0).alias("kind"), F.col("k").alias("asks"), F.lit(0).cast("long").alias("k"))
    both = asked.unionByName(right.select("x", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("asks"), "k"))
    merged = running_total(both, ["x", "kind"], F.col("k"), "below")
    meets = F.col("asks") * (F.lit(1 << len(values[1::2])) - F.col("below"))
    return merged.agg(F.lit(len(values)).cast("long").alias("clusters"), F.lit(1 << len(values)).alias("signings"), (F.sum(meets) / F.lit(float(1 << len(values)))).alias("p_exact"))


def holm(frame: DataFrame, p: str, name: str, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Adjusted p-values and step-down rejections; a family is a registered handful of tests."""
    order = Window.partitionBy(*by).orderBy(p, name) if by else Window.partitionBy(F.lit(0)).orderBy(p, name)
    run, all_ = order.rowsBetween(Window.unboundedPreceding, 0), (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    m, rank = F.count("*").over(all_), F.row_number().over(order)
    step = frame.withColumns({"_m": m, "_r": rank}).withColumn("_a", (F.col("_m") - F.col("_r") + 1) * F.col(p))
    ok = F.min(F.when(F.col(p) <= alpha / (F.col("_m") - F.col("_r") + 1), 1).otherwise(0)).over(run)
    return step.select(*frame.columns, F.least(F.lit(1.0), F.max("_a").over(run)).alias("adjusted"), (ok == 1).alias("rejected"))


def pareto(points: DataFrame, budget: str, reward: str, name: str) -> DataFrame:
    """Points whose reward exceeds that of every cheaper point."""
    order = Window.partitionBy(F.lit(0)).orderBy(budget, F.desc(reward), name)
    best = F.max(reward).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return points.withColumn("_best", best).where(F.col("_best").isNull() | (F.col(reward) > F.col("_best"))).drop("_best")


def frontier_area(points: DataFrame, budget: str, reward: str, name: str) -> DataFrame:
    """Trapezoid area of reward over the budget's share of its maximum; a point at budget 0 repeats the first reward."""
    order = Window.partitionBy(F.lit(0)).orderBy(budget, name)
    top = F.max(budget).over(Window.partitionBy(F.lit(0)))
    x = F.col(budget) / F.col("_top")
    rows = points.withColumn("_top", top).withColumns({"_x": x, "_px": F.coalesce(F.lag(x).over(order), F.lit(0.0)), "_pr": F.coalesce(F.lag(reward).over(order), F.col(reward))})
    return rows.agg(F.when(F.max("_top") > 0, F.sum((F.col("_x") - F.col("_px")) * (F.col(reward) + F.col("_pr")) / 2)).otherwise(F.max(reward)).alias("area"))


def matched_budget(points: DataFrame, budget: str, name: str, reference: str) -> DataFrame:
    """The other point whose budget is nearest to the reference's."""
    goal = points.where(F.col(name) == reference).select(F.col(budget).alias("_goal"))
    gap = points.where(F.col(name) != reference).join(F.broadcast(goal)).withColumn("gap", F.abs(F.col(budget) - F.col("_goal")))
    return gap.orderBy("gap", name).limit(1).drop("_goal")


def hash_draw(draw: Column, i: Column, n: Column) -> Column:
    """A counter-based draw from 0..n-1: the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(draw.cast("string"), F.lit("/"), i.cast("string"))), 1, 8), 16, 10).cast("long") % n


def cluster_bootstrap(frame: DataFrame, value: str, cluster: str, draws: int = 200, confidence: float = 0.95) -> DataFrame:
    """Percentile interval of the pooled mean, whole clusters drawn; clusters are summed first, so that rows are draws x clusters."""
    sums = frame.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("k"))
    rows = numbered(sums, [cluster])
    n = rows.agg(F.count("*").alias("n"))
    plan = rows.join(F.broadcast(n)).select("i", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    picked = plan.withColumn("i", hash_draw(F.col("draw"), F.col("i"), F.col("n"))).join(rows, "i")
    means = picked.groupBy("draw").agg((F.sum("s") / F.sum("k")).alias("m"))
    tail = (1 - confidence) / 2
    return means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"), F.count("*").alias("draws"))


def required_units(frame: DataFrame, value: str, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Units that show a mean effect of the size and spread seen, two-sided; null where the effect is not positive."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    ratio = z * F.stddev_samp(value) / F.avg(value)
    return frame.agg(F.when(F.avg(value) > 0, F.ceil(ratio * ratio)).alias("units"))
