"""Seeded generators: random draws in numpy on the workers, everything after them in expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def demand_cells(x: Column) -> Column:
    """Rounded half up and clipped at 0."""
    return F.greatest(F.lit(0.0), F.floor(x + 0.5)).cast("double")


def baseline(seeds: DataFrame, kind: str, horizon: int, mean: float = 100.0, sd: float = 25.0, phi: float = 0.5, amplitude: float = 0.2, season: int = 12) -> DataFrame:
    """seed, period, draw: one path per seed (iid, seasonal, ar1 or negbin), the same however seeds are partitioned."""

    def path(seed: int) -> np.ndarray:
        rng, t = np.random.default_rng(np.random.SeedSequence(seed).spawn(4)[0]), np.arange(horizon)
        if kind == "iid":
            return rng.normal(mean, sd, horizon)
        if kind == "seasonal":
            return mean * (1 + amplitude * np.sin(2 * np.pi * t / season)) + rng.normal(0, sd, horizon)
        if kind == "ar1":
            e, x = rng.normal(0, sd * np.sqrt(1 - phi * phi), horizon), np.empty(horizon)
            x[0] = rng.normal(0, sd)
            for k in range(1, horizon):
                x[k] = phi * x[k - 1] + e[k]
            return mean + x
        if kind == "negbin":
            p = mean / max(sd * sd, mean + 1e-9)
            return rng.negative_binomial(mean * p / (1 - p), p, horizon).astype(float)
        raise ValueError(kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for seed in pdf["seed"]:
                yield pd.DataFrame({"seed": seed, "period": np.arange(1, horizon + 1), "draw": path(int(seed))})

    return seeds.select("seed").mapInPandas(run, "seed long, period int, draw double")


def level_change(paths: DataFrame, value: str, multiplier: Column, first: Column, last: Column) -> DataFrame:
    """Demand scaled and rounded again on the periods first..last."""
    inside = F.col("period").between(first, last)
    return paths.withColumn("shocked", F.when(inside, demand_cells(F.col(value) * multiplier)).otherwise(F.col(value)))


def lead_times(paths: DataFrame, promised: int, kind: str, first: Column, length: int, disrupted: int) -> DataFrame:
    """Lead time by period: shifted from first on, or lost (null) for length periods."""
    inside = (F.col("period") >= first) & ((F.col("period") < first + length) if kind == "loss" else F.lit(True))
    return paths.withColumn("lead_time", F.when(inside & F.lit(kind == "loss"), F.lit(None).cast("int")).when(inside, F.lit(disrupted)).otherwise(F.lit(promised)))


def conditions(units: DataFrame, onset: str, offset: int) -> DataFrame:
    """Each unit under four alert conditions, with the period of its alert."""
    period = F.when(F.col("condition") == "accurate", F.col(onset) - 1).when(F.col("condition") == "delayed", F.col(onset) + 2).when(F.col("condition") == "unreliable", F.col(onset) + offset)
    names = F.array(*map(F.lit, ("none", "accurate", "delayed", "unreliable")))
    return units.withColumn("condition", F.explode(names)).withColumn("alert_period", period.cast("int"))


def seeds(spark, families: int, per_family: int, base: int = 1_000_000) -> DataFrame:
    """family, index, seed: seeds of a pool by arithmetic."""
    ids = spark.range(families * per_family)
    return ids.select((F.col("id") / per_family).cast("int").alias("family"), (F.col("id") % per_family).cast("int").alias("index")).withColumn("seed", (F.col("family") + 1) * base + F.col("index"))


def units(spark, families: int, per_family: int, held_out: int, base: int = 1_000_000) -> DataFrame:
    """Units of a split: family, index, seed, and whether the unit's combination is held out for the test split."""
    return seeds(spark, families, per_family, base).withColumn("held_out", F.pmod(F.col("index"), F.lit(held_out)) == 0)


def pilot_selection(units_: DataFrame, strata: list[str], shocked: int, null: int, is_null: str) -> DataFrame:
    """The first units by seed of every stratum: so many shocked, so many null."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy(*strata, is_null).orderBy("seed"))
    return units_.withColumn("_p", place).where(F.col("_p") <= F.when(F.col(is_null), null).otherwise(shocked)).drop("_p")
