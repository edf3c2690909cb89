"""Resampling of whole clusters at the reference's counts, in numpy over shards of clusters.

Clusters are summed first. A task draws for the clusters of one shard and gives partial sums for each draw, so that rows
are draws x shards; no draw is dropped and no clusters are merged. Seeds go by shard, and a shard's clusters are in order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators import inference
from quayside.plans.runtime import materialize

SHARD, PICKS, SEED = 4_096, 4_000_000, 20260927


def dealt(frame: DataFrame, sums: dict[str, Column], cluster: str) -> tuple[DataFrame, list[int]]:
    """cluster, its sums and the shard of each cluster, and the shards' sizes."""
    rows = materialize(frame.groupBy(F.col(cluster).alias("cluster")).agg(*[c.cast("double").alias(n) for n, c in sums.items()]), "clusters")
    shards = max(1, -(-rows.count() // SHARD))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("cluster"), F.lit(shards)).cast("int"))
    found = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}  # a number for thousands of clusters
    return rows, [found.get(i, 0) for i in range(shards)]


def shard_draws(sizes: list[int], shard: int, draws: int) -> np.ndarray:
    """How many of a draw's picks fall in a shard: a multinomial split, halved down to the shard with the same seeds in every task."""
    ends, low, high = np.concatenate([[0], np.cumsum(sizes)]), 0, len(sizes)
    n = np.full(draws, ends[-1], "int64")
    while high - low > 1:
        middle = (low + high) // 2
        left, all_ = ends[middle] - ends[low], ends[high] - ends[low]
        first = np.random.default_rng([SEED, low, high]).binomial(n, left / all_ if all_ else 0.0)
        n, low, high = (first, low, middle) if shard < middle else (n - first, middle, high)
    return n


def resampled(frame: DataFrame, sums: dict[str, Column], cluster: str, draws: int = 10_000) -> DataFrame:
    """draw and each sum over as many whole clusters as there are, drawn with replacement. sums: aggregates that add up over
    clusters, by name; any statistic is an expression of them."""
    names = list(sums)
    rows, sizes = dealt(frame, sums, cluster)

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part, shard = part.sort_values("cluster"), int(key[0])
        values, n, rng = [part[c].fillna(0).to_numpy("float64") for c in names], shard_draws(sizes, shard, draws), np.random.default_rng([SEED, len(sizes), shard])
        out, step = np.zeros((draws, len(names))), max(1, PICKS // max(1, int(n.max())))
        for a in range(0, draws, step):
            some = n[a : a + step]
            pick, of = rng.integers(0, len(part), some.sum()), np.repeat(np.arange(len(some)), some)
            out[a : a + step] = np.stack([np.bincount(of, x[pick], len(some)) for x in values], axis=1)
        return pd.DataFrame({"draw": np.arange(draws)} | dict(zip(names, out.T, strict=True)))

    parts = rows.groupBy("shard").applyInPandas(one, "draw long, " + ", ".join(f"`{c}` double" for c in names))
    return parts.groupBy("draw").agg(*[F.sum(c).alias(c) for c in names])


def percentile_interval(drawn: DataFrame, statistic: Column, confidence: float = 0.95) -> DataFrame:
    """low, high and draws of a statistic; draws without one are dropped and counted out."""
    tail = (1 - confidence) / 2
    found = drawn.select(statistic.alias("m")).where("m is not null")
    return found.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"), F.count("*").alias("draws"))


def bootstrap(frame: DataFrame, value: str, cluster: str, draws: int = 10_000, confidence: float = 0.95) -> DataFrame:
    """Percentile interval of the pooled mean, as many whole clusters drawn as there are."""
    known = frame.where(F.col(value).isNotNull())
    drawn = resampled(known, {"s": F.sum(value), "k": F.count(value)}, cluster, draws)
    return percentile_interval(drawn, F.try_divide(F.col("s"), F.col("k")), confidence)


def ratio_interval(frame: DataFrame, numerator: str, denominator: str, cluster: str, draws: int = 10_000, least: int = 2) -> DataFrame:
    """Ratio of sums and its interval over clusters; draws without a denominator are dropped. With fewer than least clusters
    that have one the ratio is not estimated."""
    sums = {"a": F.sum(numerator), "b": F.sum(denominator)}
    whole = frame.groupBy(cluster).agg(*[c.alias(n) for n, c in sums.items()]).agg(F.count_if(F.col("b") > 0).alias("clusters"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    drawn = percentile_interval(resampled(frame, sums, cluster, draws), F.when(F.col("b") > 0, F.col("a") / F.col("b")))
    ok = F.col("clusters") >= least
    both = whole.crossJoin(drawn)  # a row each
    return both.select("clusters", F.when(ok, F.try_divide("a", "b")).alias("ratio"), F.when(ok, F.col("low")).alias("low"), F.when(ok, F.col("high")).alias("high"), "draws")


def frontier_membership(units: DataFrame, arms: list[str], arm: str, cluster: str, draws: int = 2_000) -> DataFrame:
    """Interval of whether an arm is on the frontier of mean reward over total cost, units drawn whole. units: cluster, arm, reward, cost."""
    of = lambda a, c: F.sum(F.when(F.col("arm") == a, F.col(c)))
    sums = {f"{n}{i}": e for i, a in enumerate(arms) for n, e in (("r", of(a, "reward")), ("n", F.count(F.when(F.col("arm") == a, 1))), ("c", of(a, "cost")))}
    drawn = resampled(units, sums, cluster, draws)
    mean, cost, me = lambda i: F.try_divide(F.col(f"r{i}"), F.col(f"n{i}")), lambda i: F.col(f"c{i}"), arms.index(arm)
    beaten = F.lit(False)
    for i in range(len(arms)):
        if i != me:  # someone cheaper, or as cheap and better, earns as much
            beaten = beaten | F.coalesce(((cost(i) < cost(me)) & (mean(i) >= mean(me))) | ((cost(i) == cost(me)) & ((mean(i) > mean(me)) | ((mean(i) == mean(me)) & F.lit(arms[i] < arm)))), F.lit(False))
    return percentile_interval(drawn, F.when(mean(me).isNotNull(), F.when(beaten, 0.0).otherwise(1.0)))


def flips(frame: DataFrame, value: str, cluster: str, flips: int = 100_000) -> DataFrame:
    """One-sided Monte Carlo sign-flip test on cluster sums; the observed value counts as one flip."""
    sums, _ = dealt(frame.where(F.col(value).isNotNull()), {"s": F.sum(value)}, cluster)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s, rng = rows.sort_values("cluster")["s"].to_numpy(), np.random.default_rng([SEED, int(key[0])])
        t = np.zeros(flips)
        for a in range(0, len(s), 8):  # a byte of signs at a time: the sums of all 256 are known
            part = s[a : a + 8]
            signs = np.unpackbits(np.arange(256, dtype="uint8")[:, None], axis=1, count=len(part)) * 2.0 - 1
            t += (signs @ part)[rng.integers(0, 256, flips, "uint8")]
        return pd.DataFrame({"flip": np.arange(flips), "t": t, "seen": s.sum()})

    total = sums.groupBy("shard").applyInPandas(one, "flip long, t double, seen double").groupBy("flip").agg(F.sum("t").alias("t"), F.sum("seen").alias("seen"))
    close = F.greatest(F.lit(1e-9), 1e-12 * F.abs("seen"))
    return total.agg(((F.count_if(F.col("t") >= F.col("seen") - close) + 1) / (F.count("*") + 1)).alias("p_value"), F.count("*").alias("flips"))


def cluster_test(frame: DataFrame, value: str, cluster: str, draws: int = 100_000, limit: int = 40) -> DataFrame:
    """clusters, p_exact, p_random and p: all signings where there are few enough clusters, else random ones."""
    exact = inference.sign_flip_halves(frame, value, cluster, limit)
    both = exact.crossJoin(flips(frame, value, cluster, draws).select(F.col("p_value").alias("p_random")))  # a row each
    return both.select("clusters", "p_exact", "p_random", F.coalesce("p_exact", "p_random").alias("p"))
