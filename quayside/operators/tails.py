"""Bootstrap of the lift rule: how many groups pass by the mean or by the tail mean of paired units.

A tail mean is no sum of units: it is the mean of the lowest values of a redrawn group, up to a share of it. Every unit gets
its rank in each arm once, by ranges of values. A draw's multiplicities of units are then summed over bins of ranks; the
bin in which the running multiplicity reaches the tail's size is cut again, until it holds one rank. A task draws for the
units of one shard, by seeds that give the same draw in every pass, so that rows are draws x bins x shards, no unit is
gathered with its group, and every draw counts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.operators.evaluation import relative_lift
from quayside.operators.panel import numbered
from quayside.operators.resampling import PICKS, SEED, SHARD, shard_draws
from quayside.plans.runtime import materialize

BINS, SHARE = 32, 0.1


def ranked(pairs: DataFrame, value: str, name: str) -> DataFrame:
    """pairs with each unit's rank from 0 in its group by value."""
    placed = numbered(pairs, ["key", value, "unit"], "_place")
    first = placed.groupBy("key").agg(F.min("_place").alias("_first"))
    return placed.join(first, "key").withColumn(name, F.col("_place") - F.col("_first")).drop("_place", "_first")


def sharded(pairs: DataFrame) -> tuple[DataFrame, dict[str, list[int]]]:
    """pairs (key, unit, a, b) with ranks and shards, and each group's shard sizes."""
    rows = ranked(ranked(pairs, "a", "rank_a"), "b", "rank_b")
    count = rows.groupBy("key").agg(F.ceil(F.count("*") / SHARD).alias("shards"))
    rows = rows.join(count, "key").withColumn("shard", F.pmod(F.xxhash64("unit"), F.col("shards")).cast("int"))
    rows = materialize(rows, "tail-units")
    sizes: dict[str, list[int]] = {}
    for key, shards, shard, n in sorted(tuple(r) for r in rows.groupBy("key", "shards", "shard").count().collect()):  # a number for thousands of units
        sizes.setdefault(key, [0] * shards)[shard] = n
    return rows, sizes


def binned(rows: DataFrame, state: DataFrame, sizes: dict[str, list[int]], draws: int) -> DataFrame:
    """key, draw, arm, bin, n and s: multiplicities and sums of values in each bin of state's rank intervals; bin -1 holds all.

    state: key, draw, arm (0 or 1), low, high.
    """

    def one(key: tuple, units: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        name, shard = key[0], int(key[1])
        units, seed = units.sort_values("unit"), zlib.crc32(str(name).encode())
        if not len(units):
            return pd.DataFrame({"key": [], "draw": [], "arm": [], "bin": [], "n": [], "s": []})
        n, rng = shard_draws(sizes[name], shard, draws), np.random.default_rng([SEED, seed, len(sizes[name]), shard])
        ends = np.zeros((2, 2, draws), "int64")
        ends[0, wanted["arm"], wanted["draw"]], ends[1, wanted["arm"], wanted["draw"]] = wanted["low"], wanted["high"]
        values, ranks = units[["a", "b"]].to_numpy("float64").T, units[["rank_a", "rank_b"]].to_numpy("int64").T
        many, sums = np.zeros((draws, 2, BINS + 1)), np.zeros((draws, 2, BINS + 1))
        step = max(1, PICKS // max(1, int(n.max())))
        for a in range(0, draws, step):
            some = n[a : a + step]
            pick, of = rng.integers(0, len(units), some.sum()), np.repeat(np.arange(a, a + len(some)), some)
            for arm in (0, 1):
                low, high, r, v = ends[0, arm][of], ends[1, arm][of], ranks[arm][pick], values[arm][pick]
                inside = (r >= low) & (r < high)
                at = np.where(inside, (r - low) * BINS // np.maximum(1, high - low), BINS)
                place = (of - a) * (BINS + 1) + at
                size = (len(some), BINS + 1)
                many[a : a + step, arm] += np.bincount(place, minlength=size[0] * size[1]).reshape(size)
                sums[a : a + step, arm] += np.bincount(place, v, minlength=size[0] * size[1]).reshape(size)
        whole = [x.sum(axis=2) for x in (many, sums)]
        many[:, :, BINS], sums[:, :, BINS] = whole
        draw, arm, place = np.nonzero(many)
        return pd.DataFrame({"key": name, "draw": draw, "arm": arm, "bin": np.where(place == BINS, -1, place), "n": many[draw, arm, place], "s": sums[draw, arm, place]})

    shards = rows.select(F.col("key").alias("of"), F.col("shard").alias("part")).distinct()
    asked = state.select("key", "draw", "arm", "low", "high").join(shards, F.col("key") == F.col("of"))
    kind = rows.schema["key"].dataType.simpleString()
    parts = rows.groupBy("key", "shard").cogroup(asked.groupBy("of", "part")).applyInPandas(one, f"key {kind}, draw int, arm int, bin int, n long, s double")
    return parts.groupBy("key", "draw", "arm", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def tail_draws(pairs: DataFrame, draws: int, share: float = SHARE) -> DataFrame:
    """key, draw, mean_a, tail_a, mean_b, tail_b of paired units (key, unit, a, b) redrawn with replacement within their group."""
    rows, sizes = sharded(pairs.select("key", "unit", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")))
    spark, kind = pairs.sparkSession, rows.schema["key"].dataType.simpleString()
    totals = spark.createDataFrame([(k, sum(n), max(1, -int(-share * sum(n) // 1))) for k, n in sizes.items()], f"key {kind}, size long, tail long")  # a row per group
    state = totals.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("arm", F.explode(F.array(F.lit(0), F.lit(1))))
    zero = F.lit(0).cast("long")
    state = materialize(state.withColumns({"low": zero, "high": F.col("size"), "taken": zero, "sum": F.lit(0.0), "total": F.lit(0.0)}), "tail-state")
    widest = max((sum(n) for n in sizes.values()), default=0)
    by = Window.partitionBy("key", "draw", "arm").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    first = True
    while True:
        found = binned(rows, state, sizes, draws)
        inner = found.where("bin >= 0").withColumns({"before": F.coalesce(F.sum("n").over(by), F.lit(0)), "sum_before": F.coalesce(F.sum("s").over(by), F.lit(0.0))})
        met = state.join(inner, ["key", "draw", "arm"]).where((F.col("taken") + F.col("before") < F.col("tail")) & (F.col("taken") + F.col("before") + F.col("n") >= F.col("tail")))
        if first:
            met = met.drop("total").join(found.where("bin = -1").select("key", "draw", "arm", F.col("s").alias("total")), ["key", "draw", "arm"])
        width = F.col("high") - F.col("low")
        edge = lambda b: F.col("low") + F.floor((b * width + BINS - 1) / BINS)
        taken, summed = F.col("taken") + F.col("before"), F.col("sum") + F.col("sum_before")
        if widest <= BINS:  # a bin is a rank: its units are one value
            tails = met.select("key", "draw", "arm", (F.col("total") / F.col("size")).alias("mean"), ((summed + (F.col("tail") - taken) * F.col("s") / F.col("n")) / F.col("tail")).alias("tail"))
            side = lambda c, arm: F.max(F.when(F.col("arm") == arm, F.col(c)))
            return tails.groupBy("key", "draw").agg(*[side(c, arm).alias(f"{c}_{n}") for arm, n in ((0, "a"), (1, "b")) for c in ("mean", "tail")])
        state = materialize(met.select("key", "size", "tail", "draw", "arm", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), taken.alias("taken"), summed.alias("sum"), "total"), "tail-state")
        widest, first = -(-widest // BINS), False


def lift_passes(raw: Column, tail: Column) -> Column:
    # The registered rule.
    return (raw >= 0.05) | (tail >= 0.10)


def lift_counts(pairs: DataFrame, draws: int) -> DataFrame:
    """draw and count: in how many groups the rule passes."""
    lifts = tail_draws(pairs, draws)
    ok = lift_passes(relative_lift(F.col("mean_a"), F.col("mean_b")), relative_lift(F.col("tail_a"), F.col("tail_b")))
    return lifts.groupBy("draw").agg(F.count_if(ok).alias("count"))


def lift_interval(pairs: DataFrame, draws: int = 2_000, confidence: float = 0.95) -> DataFrame:
    """low, high and draws of the number of groups that pass. pairs: key, unit, a (treatment), b (control)."""
    tail = (1 - confidence) / 2
    return lift_counts(pairs, draws).agg(F.percentile("count", F.lit(tail)).alias("low"), F.percentile("count", F.lit(1 - tail)).alias("high"), F.count("*").alias("draws"))


def lift_distribution(pairs: DataFrame, draws: int = 10_000) -> DataFrame:
    """count and the share of draws that have it; pairs of clusters (means of their units), not of replays of one seed."""
    counts = materialize(lift_counts(pairs, draws), "lift-counts")
    return counts.groupBy("count").agg((F.count("*") / draws).alias("share"))
