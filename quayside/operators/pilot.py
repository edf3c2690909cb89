"""Operational metrics, and the bundle of metrics and intervals behind a pilot's verdicts.

Period records (keys, family, condition, period, demand, sold, lost, on_hand_end, active_family) are reduced once to a row
per episode and arm; every metric is an aggregate of those rows, in long form: metric, estimate, low, high, n.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators import evaluation, inference, panel, resampling, tails

Z = 1.959963984540054
KEYS = ("episode", "arm")


def recoveries(records: DataFrame, shock: Column, keys: Sequence[str] = KEYS, threshold: float = 0.95, sustain: int = 3) -> DataFrame:
    """keys, recovery (null: never) and excess, the mean stock at the end of periods from the recovery on."""
    fill = F.when(F.col("demand") > 0, F.col("sold") / F.col("demand")).otherwise(1.0)
    found = panel.time_to_recovery(records, fill, shock, keys, threshold, sustain)
    after = records.join(found, list(keys)).where(F.col("recovery").isNotNull() & (F.col("period") >= shock + F.col("recovery")))
    return found.join(after.groupBy(*keys).agg(F.avg("on_hand_end").alias("excess")), list(keys), "left")


def episode_facts(records: DataFrame, shock: Column, profit: float, holding: float, *, baseline_stock: Column | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """A row per key: family, condition, is_null, totals, fill, streak, recovery, excess, active, exposure (null for nulls)."""
    sums = records.groupBy(*keys).agg(
        F.first("family").alias("family"), F.first("condition").alias("condition"), F.first("direction").alias("direction"),
        (profit * F.sum("sold")).alias("profit"), (holding * F.sum("on_hand_end")).alias("holding_cost"), F.sum("lost").alias("lost"), F.sum("demand").alias("demand"), F.sum("sold").alias("sold"),
        F.bool_or(F.col("active_family").isNotNull()).alias("active"), F.avg(F.coalesce(F.col("active_family") != F.col("family"), F.lit(False)).cast("double")).alias("wrong"),
    )
    streak = panel.max_streak(records, F.col("lost") > 0, keys)
    rows = sums.join(streak, list(keys)).join(recoveries(records, shock, keys), list(keys))
    null = F.col("family") == "no_change"
    rows = rows.withColumns({"is_null": null, "fill": F.when(F.col("demand") > 0, F.col("sold") / F.col("demand")).otherwise(1.0), "exposure": F.when(~null, F.col("wrong"))})
    return rows.withColumn("excess", F.col("excess") - (F.lit(0.0) if baseline_stock is None else baseline_stock)).drop("wrong")


def operational_summaries(facts: DataFrame) -> DataFrame:
    """arm, metric, value, n: tail, worst, fill, lost units, holding cost, streak; recovery and excess over the episodes that have them."""
    measures = {"fill_rate": "fill", "lost_sales_units": "lost", "holding_cost": "holding_cost", "max_stockout_streak": "streak", "time_to_recovery": "recovery", "post_recovery_excess_inventory": "excess"}
    each = facts.groupBy("arm").agg(F.count("*").alias("_n"), F.min("profit").alias("_worst"), *[F.avg(c).alias(m) for m, c in measures.items()], *[F.count(c).alias(f"n_{m}") for m, c in measures.items()])
    tail = evaluation.cvar(facts.select("episode", "arm", "profit"), "profit", ["arm"]).select("arm", F.col("cvar").alias("_cvar"))
    rows = [F.struct(F.lit("cvar10_profit").alias("metric"), F.col("_cvar").alias("value"), F.col("_n").alias("n")), F.struct(F.lit("worst_decile_profit").alias("metric"), F.col("_worst").alias("value"), F.col("_n").alias("n"))]
    rows += [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"n_{m}").alias("n")) for m in measures]
    return each.join(tail, "arm").select("arm", F.explode(F.array(*rows)).alias("r")).select("arm", "r.*").where("n > 0")


def fill_by_arm(facts: DataFrame) -> DataFrame:
    """Mean fill over all, shocked and null episodes of each arm."""
    of = lambda c: F.avg(F.when(c, F.col("fill")))
    return facts.groupBy("arm").agg(F.avg("fill").alias("overall"), of(~F.col("is_null")).alias("shocked"), of(F.col("is_null")).alias("null"))


def headroom_key(family: Column, direction: Column) -> Column:
    """The family, with its direction for levels; null for no change."""
    return F.when(family == "no_change", F.lit(None)).when(family == "demand_level", F.concat(family, F.lit(":"), direction)).otherwise(family)


def headroom_pairs(facts: DataFrame, oracle: str, base: str, unit: str = "episode") -> DataFrame:
    """key, unit, a and b: mean profits of both arms of each unit that has both; units of a seed's replays may be the seed."""
    keyed = facts.where(F.col("arm").isin(oracle, base)).withColumn("key", headroom_key(F.col("family"), F.col("direction"))).where("key is not null")
    side = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("profit")))
    return keyed.groupBy("key", F.col(unit).alias("unit")).agg(side(oracle).alias("a"), side(base).alias("b")).where("a is not null and b is not null")


def headroom_lifts(facts: DataFrame, oracle: str, base: str, copies: int = 1) -> DataFrame:
    """key, raw_lift, cvar_lift and passes, over episodes that both arms have; copies: how often each episode counts."""
    paired = headroom_pairs(facts, oracle, base).select("key", F.explode(F.array(F.struct(F.lit("t").alias("side"), F.col("a").alias("profit")), F.struct(F.lit("c").alias("side"), F.col("b").alias("profit")))).alias("x")).select("key", "x.*")
    side = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    means = paired.groupBy("key", "side").agg(F.avg("profit").alias("m")).join(evaluation.cvar(paired, "profit", ["key", "side"], copies=copies), ["key", "side"])
    wide = means.groupBy("key").agg(*[side(c, s).alias(f"{c}_{s}") for c in ("m", "cvar") for s in "tc"])
    lifts = wide.select("key", evaluation.relative_lift(F.col("m_t"), F.col("m_c")).alias("raw_lift"), evaluation.relative_lift(F.col("cvar_t"), F.col("cvar_c")).alias("cvar_lift"))
    return lifts.withColumn("passes", tails.lift_passes(F.col("raw_lift"), F.col("cvar_lift")))


def replicated_rule(facts: DataFrame, oracle: str, base: str, copies: int = 4) -> DataFrame:
    """The lift rule with every episode counted as often as its conditions repeat it."""
    return headroom_lifts(facts, oracle, base, copies)


def cost_points(calls: DataFrame, facts: DataFrame) -> DataFrame:
    """arm, reward (mean profit) and budget (the sum of its calls' cost)."""
    spent = calls.groupBy("arm").agg(F.sum("usd").alias("budget"))
    return facts.groupBy("arm").agg(F.avg("profit").alias("reward")).join(spent, "arm", "left").withColumn("budget", F.coalesce("budget", F.lit(0.0)))


def parser_failures(calls: DataFrame) -> DataFrame:
    """episode, arm, period, failed: is the last attempt of a proposal a fallback?"""
    return calls.groupBy("episode", "arm", "period").agg((F.max_by("outcome", "attempt") == "fallback").alias("failed"))


def pilot_metrics(facts: DataFrame, calls: DataFrame, weights: DataFrame, *, treatment: str, base: str, oracle: str, detector: str, call_budget: int, never_recovered: float, draws: int | None = None) -> DataFrame:
    """metric, estimate, low, high, n. Contrasts are weighted by strata; a metric without a row is not estimable.

    The frontier's and the lift rule's intervals are bootstraps of whole episodes with so many draws, or null without draws.
    """
    mine = facts.where(F.col("arm") == treatment)
    per_call = parser_failures(calls.where(F.col("arm") == treatment))
    counts = calls.where(F.col("arm") == treatment).groupBy("episode").agg(F.count("*").alias("_calls"))
    rows = mine.join(counts, "episode", "left").withColumn("over", (F.coalesce("_calls", F.lit(0)) > call_budget).cast("double"))
    active, shocked = F.col("active").cast("double"), ~F.col("is_null")
    recovery = F.when(shocked, F.coalesce(F.col("recovery").cast("double"), F.lit(never_recovered)))
    values = {
        "fill_rate_floor": F.col("fill"), "false_activation_rate": F.when(F.col("is_null"), active), "false_activation_control": F.when(F.col("is_null"), 1 - active), "wrong_family_exposure": F.col("exposure"),
        "wrong_family_activation_rate": (F.col("exposure") > 0).cast("double"), "recovery_time": recovery, "budget_overrun_rate": F.col("over"),
    }
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values.items()])).alias("r")).select("r.*").where("value is not null")
    failures = per_call.groupBy("episode").agg(F.avg(F.col("failed").cast("double")).alias("value"))
    bundle = inference.mean_interval(long, "value", ["metric"])
    # failures are pooled over proposals, and their interval is that of the episodes' shares
    pooled = per_call.agg(F.avg(F.col("failed").cast("double")).alias("estimate"))
    parser = inference.mean_interval(failures, "value").drop("estimate").crossJoin(pooled).where("n > 0").select(F.lit("parser_failure_rate").alias("metric"), "estimate", "low", "high", "n")  # one row each
    unit = facts.withColumn("unit", F.col("episode"))

    def contrast(name: str, t: str, c: str, endpoint: str) -> DataFrame:
        differences = evaluation.paired_differences(unit, t, c, endpoint, ["family", "condition"])
        return inference.stratified_interval(differences, "difference", ["family", "condition"], weights).select(F.lit(name).alias("metric"), "estimate", "low", "high", "n")

    plain = inference.mean_interval(evaluation.paired_differences(unit, treatment, detector, "profit"), "difference").select(F.lit("detector_indistinguishable").alias("metric"), "estimate", "low", "high", "n")
    lifts = headroom_lifts(facts, oracle, base).agg(F.count_if("passes").cast("double").alias("estimate"), F.count("*").alias("n"))
    nothing = F.lit(None).cast("double")
    points = inference.pareto(cost_points(calls, facts), "budget", "reward", "arm").agg(F.max(F.when(F.col("arm") == treatment, 1.0).otherwise(0.0)).alias("estimate"))
    frontier = points.select(F.lit("cost_frontier").alias("metric"), "estimate", nothing.alias("low"), nothing.alias("high"), F.lit(1).cast("long").alias("n"))
    headroom = lifts.select(F.lit("insufficient_headroom").alias("metric"), "estimate", nothing.alias("low"), nothing.alias("high"), "n")
    if draws:
        cost = calls.groupBy("episode", "arm").agg(F.sum("usd").alias("cost"))
        units = facts.select("episode", "arm", F.col("profit").alias("reward")).join(cost, ["episode", "arm"], "left").na.fill(0.0, ["cost"])
        arms = sorted(r.arm for r in facts.select("arm").distinct().collect())  # registered arms
        ends = resampling.frontier_membership(units, arms, treatment, "episode", draws), tails.lift_interval(headroom_pairs(facts, oracle, base), draws)
        with_ends = lambda one, interval: one.drop("low", "high").crossJoin(interval.select("low", "high")).select("metric", "estimate", "low", "high", "n")  # noqa: E731  a row each
        frontier, headroom = with_ends(frontier, ends[0]), with_ends(headroom, ends[1])
    out = bundle.select("metric", "estimate", "low", "high", "n")
    for part in (parser, contrast("profit_lift", treatment, base, "profit"), contrast("negative_profit_lift", treatment, base, "profit"), contrast("lost_sales_reduction", base, treatment, "lost"), plain, frontier, headroom):
        out = out.unionByName(part)
    return out


def metric_faults(criteria: DataFrame, metrics: DataFrame) -> DataFrame:
    """Criteria (name, kind) without a finite estimate, or, for go criteria, without a finite interval in order."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    joined = criteria.select("name", "kind").join(metrics.withColumnRenamed("metric", "name"), "name", "left")
    fault = F.when(~finite("estimate"), "no estimate").when((F.col("kind") == "go") & ~(finite("low") & finite("high") & (F.col("low") <= F.col("high"))), "no interval")
    return joined.withColumn("fault", fault).where("fault is not null").select("name", "kind", "fault")


def record_faults(facts: DataFrame, low: int, high: int, arms: Sequence[str], strata: DataFrame) -> DataFrame:
    """What keeps a set of episodes from being a pilot: its size, episodes without all arms, strata that are empty."""
    per = facts.groupBy("episode").agg(F.count_distinct("arm").alias("arms"))
    size = per.agg(F.count("*").alias("n")).where((F.col("n") < low) | (F.col("n") > high)).select(F.lit("units").alias("fault"), F.col("n").cast("string").alias("detail"))
    missing = per.where(F.col("arms") < len(arms)).select(F.lit("unpaired").alias("fault"), F.col("episode").cast("string").alias("detail"))
    empty = strata.select("family", "condition").join(facts.select("family", "condition").distinct(), ["family", "condition"], "left_anti").select(F.lit("empty stratum").alias("fault"), F.concat_ws("/", "family", "condition").alias("detail"))
    return size.unionByName(missing).unionByName(empty)


def confirmatory_table(results: DataFrame, members: Sequence[tuple[str, str, str, str]], weights: DataFrame, strata: Sequence[str], alpha: float = 0.05, bootstrap=None) -> DataFrame:
    """A row per registered member (name, treatment, control, endpoint): weighted interval, sign-flip p and its Holm
    adjustment, Wilcoxon p; with bootstrap, a function of differences to low and high, those ends too."""
    rows = None
    for name, t, c, endpoint in members:
        d = evaluation.paired_differences(results, t, c, endpoint, strata)
        one = inference.stratified_interval(d, "difference", strata, weights).crossJoin(inference.sign_flip_exact(d, "difference").select(F.col("p_value").alias("randomization_p")))
        one = one.crossJoin(inference.signed_rank(d, "difference").select(F.col("p_value").alias("wilcoxon_p")))  # a row each
        if bootstrap is not None:
            one = one.crossJoin(bootstrap(d).select(F.col("low").alias("boot_low"), F.col("high").alias("boot_high")))
        one = one.withColumn("member", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    adjusted = inference.holm(rows, "randomization_p", "member", alpha)
    return adjusted.withColumnRenamed("adjusted", "holm_p")
