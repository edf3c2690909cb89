"""Null calibration of sequential tests: seeded null paths, exact likelihood ratios, mixture e-processes, activation rates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.operators import generate, inference, laws, sequential
from quayside.operators.panel import over


def period_mean(kind: str, period: np.ndarray, mean: float, amplitude: float = 0.2, season: int = 12) -> np.ndarray:
    return mean * (1 + amplitude * np.sin(2 * np.pi * (period - 1) / season)) if kind == "seasonal" else np.full(len(period), mean)


def ratios(value: Column, period: Column, before: Column, kind: str, mean: float, sd: float, multipliers: Sequence[float], phi: float = 0.5) -> Column:
    """An array of log likelihood ratios, one for each multiplier, against the registered null law.

    The dependent law is conditional on the value before; rounding makes it an approximation, so that its test is valid
    by calibration only.
    """

    def run(x: pd.Series, t: pd.Series, last: pd.Series) -> pd.Series:
        at, spread, v = period_mean(kind, t.to_numpy(dtype=float), mean), sd, x.to_numpy(dtype=float)
        if kind == "ar1":
            at, spread = mean + phi * (last.to_numpy(dtype=float) - mean), sd * np.sqrt(1 - phi * phi)

        def base(u):
            return laws.negative_binomial_log_mass(u, mean, sd) if kind == "negbin" else laws.rounded_normal_log_mass(u, at, spread)

        null = base(v)
        found = np.stack([np.maximum(laws.shocked_log_mass(v, m, base) - null, -700.0) for m in multipliers], axis=1)
        return pd.Series(list(found))

    return F.pandas_udf(run, "array<double>")(value.cast("double"), period, F.coalesce(before, F.lit(mean)).cast("double"))


def null_calibration(
    spark: SparkSession, kind: str, replications: int, horizon: int, tau: int, alpha: float, *, mean: float = 100.0, sd: float = 25.0,
    multipliers: Sequence[float] = (1.25, 1.5, 2.0), starts: Sequence[int] = (1, 2, 3), durations: Sequence[int | None] = (3, 8, None), base: int = 7_000_000,
) -> DataFrame:
    """Share of null paths on which a mixture over (multiplier, start after tau, duration) ever reaches 1 / alpha, with its score interval.

    Paths are drawn from the tested law, so the share stays below alpha up to Monte Carlo error.
    """
    seeds = spark.range(replications).select((F.col("id") + base).alias("seed"))
    paths = generate.baseline(seeds, kind, horizon, mean, sd).withColumn("demand", generate.demand_cells(F.col("draw")))
    paths = paths.withColumn("before", F.lag("demand").over(over(["seed"]))).where(F.col("period") > tau)
    rows = paths.withColumn("r", ratios(F.col("demand"), F.col("period"), F.col("before"), kind, mean, sd, multipliers))
    grid = [(k, tau + s, d) for k in range(len(multipliers)) for s in starts for d in durations]
    live = lambda s, d: F.col("period").between(s, s + d - 1) if d else F.col("period") >= s
    rows = rows.select("seed", "period", *[F.when(live(s, d), F.col("r")[k]).otherwise(0.0).alias(f"c{i}") for i, (k, s, d) in enumerate(grid)])
    names = [f"c{i}" for i in range(len(grid))]
    crossed = sequential.mixture_eprocess(rows, names, [1 / len(grid)] * len(grid), alpha, ["seed"]).groupBy("seed").agg(F.min("crossed_at").alias("at"))
    counts = crossed.agg(F.count("*").alias("replications"), F.count("at").alias("activated"))
    low, high = inference.wilson(F.col("activated"), F.col("replications"))
    return counts.select(F.lit(kind).alias("law"), "replications", "activated", (F.col("activated") / F.col("replications")).alias("rate"), low.alias("low"), high.alias("high"))
