"""Shocked episodes: numpy draws per seed on the workers, everything after them in expressions.

A seed has four streams, for the baseline, the onset, the parameters and the training values, so that changing one draw
leaves the others as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quayside.operators.generate import demand_cells

# Onsets, training values, and the registered ranges of parameters by numbered family.
ONSETS, TRAIN, BASE_LEAD = (14, 22), 5, 2
GRID = {
    1: [(m,) for m in (1.25, 1.5)], 2: [(m,) for m in (0.6, 0.75)], 3: [(m, d) for m in (1.5, 2.0) for d in (2, 3, 4)], 4: [(a, b) for a in (1, 2) for b in (3, 4)], 5: [(k, 2) for k in (1, 2, 3)],
    6: [(m, d, p) for m in (1.25, 1.5) for d in range(6, 11) for p in range(3, 6)],
}
HELD_OUT = {1: (1.5,), 2: (0.6,), 3: (2.0, 4), 4: (2, 4), 5: (3, 2), 6: (1.5, 10, 5)}
FAMILY = {1: "demand_level", 2: "demand_level", 3: "temporary_pulse", 4: "lead_time_shift", 5: "shipment_loss", 6: "compound"}
PARAMETERS = "magnitude double, duration int, base_lead int, disrupted_lead int, loss_length int, pause_length int"
NAMES = {1: ("magnitude",), 2: ("magnitude",), 3: ("magnitude", "duration"), 4: ("base_lead", "disrupted_lead"), 5: ("loss_length", "base_lead"), 6: ("magnitude", "duration", "pause_length")}


def combo_parameters(combo: Column, family: Column) -> Column:
    """A combination (array of numbers) as named parameters of its family; null where the family has none."""

    def named(name: str, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for f, names in NAMES.items():
            if name in names:
                out = F.when(family == f, F.get(combo, F.lit(names.index(name))).cast(kind)).otherwise(out)
        return out.alias(name)

    return F.struct(*[named(*field.split()) for field in PARAMETERS.split(", ")])


def parameters_combo(params: Column, family: Column) -> Column:
    """The combination that parameters encode: the inverse."""
    out = F.lit(None).cast("array<double>")
    for f, names in NAMES.items():
        out = F.when(family == f, F.array(*[params[n].cast("double") for n in names])).otherwise(out)
    return out


def is_held_out(combo: Column, family: Column) -> Column:
    out = F.lit(False)
    for f, values in HELD_OUT.items():
        out = out | ((family == f) & (combo == F.array(*[F.lit(float(v)) for v in values])))
    return out


def drawn(seeds: DataFrame, horizon: int, mean: float = 100.0, sd: float = 25.0) -> DataFrame:
    """seeds (seed, family) with onset, combo, demand and train: all that is random of an episode."""

    def one(seed: int, family: int) -> tuple:
        base, onset, params, train = (np.random.default_rng(s) for s in np.random.SeedSequence(seed).spawn(4))
        cells = lambda rng, n: np.maximum(0, np.floor(rng.normal(mean, sd, n) + 0.5))
        grid = GRID[family]
        return int(onset.integers(ONSETS[0], ONSETS[1] + 1)), [float(x) for x in grid[int(params.integers(len(grid)))]], cells(base, horizon).tolist(), cells(train, TRAIN).tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [one(int(s), int(f)) for s, f in zip(pdf["seed"], pdf["family"], strict=True)]
            yield pdf.assign(**dict(zip(("onset", "combo", "demand", "train"), map(list, zip(*rows, strict=True)), strict=True))) if rows else pdf.assign(onset=[], combo=[], demand=[], train=[])

    return seeds.select("seed", "family").mapInPandas(run, "seed long, family int, onset int, combo array<double>, demand array<double>, train array<double>")


def lead_noise(seeds: DataFrame, horizon: int, support: tuple[int, ...] = (-1, 0, 1), weights: tuple[float, ...] = (0.2, 0.6, 0.2), offset: int = 900_000_000) -> DataFrame:
    """seed, period, noise: independent whole numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for seed in pdf["seed"]:
                picks = np.random.default_rng(int(seed) + offset).choice(len(support), size=horizon, p=np.asarray(weights))
                yield pd.DataFrame({"seed": seed, "period": np.arange(1, horizon + 1), "noise": np.asarray(support)[picks]})

    return seeds.select("seed").mapInPandas(run, "seed long, period int, noise int")


def shocked(rows: DataFrame) -> DataFrame:
    """Periods under a family's shock and of their unshocked twin. rows: period, family, onset, horizon, demand and the parameters.

    Levels (1, 2) last to the end and pulses (3) their duration; lead times shift for good (4) or are lost for a burst (5, null);
    the compound (6) scales demand and pauses transit; family 7 is a pulse with a burst of losses, held out of every split.
    """
    since = F.col("period") - F.col("onset")
    until = F.when(F.col("family").isin(1, 2), F.col("horizon")).otherwise(F.col("duration"))
    hit = F.col("family").isin(1, 2, 3, 6, 7) & (since >= 0) & (since < until)
    base = F.coalesce("base_lead", F.lit(BASE_LEAD))
    lost = F.col("family").isin(5, 7) & (since >= 0) & (since < F.col("loss_length"))
    lead = F.when(lost, F.lit(None).cast("int")).when((F.col("family") == 4) & (since >= 0), F.col("disrupted_lead")).otherwise(base)
    pause = (F.col("family") == 6) & (since >= 0) & (since < F.col("pause_length"))
    return rows.withColumns({
        "twin_demand": F.col("demand"), "twin_lead_time": base, "lead_time": lead, "pause": F.coalesce(pause, F.lit(False)),
        "demand": F.when(hit, demand_cells(F.col("demand") * F.col("magnitude"))).otherwise(F.col("demand").cast("double")),
    })


def incidents(rows: DataFrame) -> DataFrame:
    """The hidden truth of each episode (family, onset, horizon and parameters): what began when, for how long, and in which stream."""
    f, room = F.col("family"), F.col("horizon") - F.col("onset") + 1
    names = F.coalesce(*[F.when(f == k, v) for k, v in (FAMILY | {7: "compound"}).items()])
    lasting = F.when(f.isin(1, 2, 4), room).when(f == 5, F.least("loss_length", room)).otherwise(F.least("duration", room))
    kind = F.when(f == 4, "lead_time_shift").when(f.isin(5, 7), "shipment_loss").when(f == 6, "transit_pause")
    length = F.when(f == 4, room).when(f.isin(5, 7), F.col("loss_length")).when(f == 6, F.least("pause_length", room))
    return rows.withColumns({"shock_family": names, "lasts": lasting, "effect": kind, "effect_length": length, "conditional_independence": ~f.isin(6, 7)})


def episodes(draws: DataFrame, horizon: int) -> DataFrame:
    """seed, family, period and shocked()'s columns of drawn episodes; training values have periods 0 and before."""
    rows = draws.withColumn("p", combo_parameters(F.col("combo"), F.col("family"))).select("seed", "family", "onset", "demand", "train", "p.*").withColumn("horizon", F.lit(horizon))
    return shocked(rows.select("*", F.posexplode("demand").alias("_i", "_d")).drop("demand").withColumn("demand", F.col("_d")).withColumn("period", F.col("_i") + 1).drop("_i", "_d", "train"))


def violated(paths: DataFrame, violation: str, mean: float, horizon: int) -> DataFrame:
    """Null demand that breaks independence or constancy: variance, seasonality or outliers. paths: seed, period, draw."""
    half, x = horizon // 2, F.col("draw")
    if violation == "variance_change":
        new = F.when(F.col("period") > half, mean + 2.0 * (demand_cells(x) - mean)).otherwise(demand_cells(x))
    elif violation == "seasonality":
        new = demand_cells(x) + 30.0 * F.sin(2 * np.pi * (F.col("period") - 1) / 12.0)
    elif violation == "outliers":
        spot = F.rank().over(Window.partitionBy("seed").orderBy(F.sha2(F.concat_ws("/", "seed", "period"), 256)))
        return paths.withColumn("_r", spot).withColumn("demand", F.when(F.col("_r") <= 3, 4.0 * mean).otherwise(demand_cells(x))).drop("_r")
    else:
        raise ValueError(violation)
    return paths.withColumn("demand", demand_cells(new))


def fresh_units(spark, families: int, per_family: int, base: int, first: int = 0, stride: int = 1_000_000) -> DataFrame:
    """family, index and seed of a pool at base."""
    ids = spark.range(families * per_family)
    family = (F.floor(F.col("id") / per_family) + 1).cast("int")
    index = (F.col("id") % per_family + first).cast("int")
    return ids.select(family.alias("family"), index.alias("index")).withColumn("seed", F.col("family").cast("long") * stride + base + F.col("index"))


def collisions(pools: DataFrame) -> DataFrame:
    """Seeds that occur twice, in one pool or in several (pool, seed)."""
    return pools.groupBy("seed").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("pool")).alias("pools")).where("n > 1")


def cell_design(spark, laws: list[str], regimes: list[str], cvs: list[float], main: int, other: int) -> DataFrame:
    """Monte Carlo cells: every law, regime and variation, with more paths for the first variation."""
    axis = lambda name, values: spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} {'double' if isinstance(values[0], float) else 'string'}, _{name} int")
    cells = axis("law", laws).crossJoin(axis("regime", regimes)).crossJoin(axis("cv", cvs))  # a registered design
    return cells.withColumn("replications", F.when(F.col("_cv") == 0, main).otherwise(other)).drop("_law", "_regime", "_cv")


def balanced(units: DataFrame, strata: list[str], per_stratum: int, order: str = "seed") -> DataFrame:
    """The first units of every stratum."""
    return units.withColumn("_p", F.row_number().over(Window.partitionBy(*strata).orderBy(order))).where(F.col("_p") <= per_stratum).drop("_p")
