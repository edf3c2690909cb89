"""Arrival laws of shipments under way, their alternatives, and the calibration of tests between them.

A law is an array of delay probabilities from 0, a probability of loss and one of a pause. Dispatch, receive what has no
periods left, then advance unless paused.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.operators import inference, sequential


@dataclass(frozen=True)
class Law:
    delays: tuple[float, ...]
    loss: float
    pause: float

    def outcomes(self) -> list[tuple[int | None, float]]:
        """Delay (None: lost) and probability."""
        return [(d, p) for d, p in enumerate(self.delays) if p > 0] + ([(None, self.loss)] if self.loss > 0 else [])


# The registered law, and what alternatives change of it.
NULL = Law((0.02, 0.27, 0.48, 0.18, 0.04), 0.01, 0.01)
TILTS, LOSSES, PAUSES = (0.55, 0.95), (0.80, 0.98), (0.80, 0.98)
DURATIONS = {"lead_time_shift": (None,), "shipment_loss": (1, 2, 3), "transit_pause": (3, 4, 5)}


def with_tilt(law: Law, strength: float) -> Law:
    raw = [p * math.exp(strength * d) for d, p in enumerate(law.delays)]
    return replace(law, delays=tuple(x * (1 - law.loss) / math.fsum(raw) for x in raw))


def with_loss(law: Law, loss: float) -> Law:
    return replace(law, delays=tuple(p * (1 - loss) / math.fsum(law.delays) for p in law.delays), loss=loss)


def with_pause(law: Law, pause: float) -> Law:
    return replace(law, pause=pause)


def changed_laws(family: str, law: Law = NULL) -> list[Law]:
    made = {"lead_time_shift": (with_tilt, TILTS), "shipment_loss": (with_loss, LOSSES), "transit_pause": (with_pause, PAUSES)}
    change, sizes = made[family]
    return [change(law, s) for s in sizes]


def alternatives(spark: SparkSession, family: str, tau: int, onset: tuple[int, int] = (0, 2)) -> DataFrame:
    """law (a number), start and duration (null: lasting) of each alternative, equally weighted."""
    grid = list(itertools.product(range(len(changed_laws(family))), range(tau + onset[0], tau + onset[1] + 1), DURATIONS[family]))
    return spark.createDataFrame(grid, "law int, start int, duration int").withColumn("weight", F.lit(1.0 / len(grid)))


def in_force(period: Column, start: Column, duration: Column) -> Column:
    """Is an alternative's law in force in a period?"""
    return (period >= start) & (duration.isNull() | (period < start + duration))


def advanced(counter: Column, paused: Column) -> Column:
    """Periods left of a shipment after one more; null (lost) stays null."""
    return F.when((counter == 0) | paused, counter).otherwise(counter - 1)


def moves(state: tuple, dispatched: float, delay: int | None, paused: bool) -> tuple[float, tuple]:
    """One period of a pipeline by remaining periods: what is received, and the pipeline after it."""
    b = list(state)
    if delay is not None:
        b[delay] += dispatched
    got, b[0] = b[0], 0.0
    return got, tuple(b) if paused else (*b[1:], 0.0)


def filtered(states: dict, law: Law, dispatched: float, received: float) -> tuple[dict, float]:
    """The hidden pipelines that a receipt allows, normalised, and the receipt's probability."""
    out: dict = {}
    step, stay = 1 - law.pause, law.pause
    later = [(d, p) for d, p in law.outcomes() if d != 0]

    def put(rest: tuple, weight: float) -> None:
        if step > 0:
            after = (*rest, 0.0)
            out[after] = out.get(after, 0.0) + weight * step
        if stay > 0:
            after = (0.0, *rest)
            out[after] = out.get(after, 0.0) + weight * stay

    for state, weight in states.items():
        rest = state[1:]
        if law.delays[0] > 0 and abs(state[0] + dispatched - received) <= 1e-9:
            put(rest, weight * law.delays[0])
        if abs(state[0] - received) <= 1e-9:
            for delay, p in later:
                put(rest if delay is None else (*rest[: delay - 1], rest[delay - 1] + dispatched, *rest[delay:]), weight * p)
    total = sum(out.values())
    return ({s: w / total for s, w in out.items()} if total else {}), total


def enumerated(law: Law, dispatches: Sequence[float], receipts: Sequence[float]) -> float:
    """The probability of receipts by going through every course of delays and pauses; for tests."""
    total = 0.0
    for course in itertools.product(itertools.product(law.outcomes(), ((False, 1 - law.pause), (True, law.pause))), repeat=len(dispatches)):
        state, p = (0.0,) * len(law.delays), 1.0
        for sent, wanted, ((delay, a), (paused, b)) in zip(dispatches, receipts, course, strict=True):
            got, state = moves(state, sent, delay, paused)
            p *= a * b if abs(got - wanted) <= 1e-9 else 0.0
            if not p:
                break
        total += p
    return total


def sampled_path(laws: Sequence[Law], dispatches: Sequence[float], rng: random.Random) -> list[float]:
    """Receipts under the law in force in each period."""
    state, out = (0.0,) * len(laws[0].delays), []
    for law, sent in zip(laws, dispatches, strict=True):
        delays, weights = zip(*law.outcomes(), strict=True)
        got, state = moves(state, sent, rng.choices(delays, weights)[0], rng.random() < law.pause)
        out.append(got)
    return out


class SharedFilter:
    """The exact filter for several laws at once on one path of receipts: pipelines in common, a column of weights for each law.

    A pipeline that one law rules out has weight 0 in its column.
    """

    def __init__(self, size: int, laws: int):
        self.states, self.weights = [(0.0,) * size], np.ones((1, laws))

    def step(self, laws: Sequence[Law], dispatched: float, received: float) -> np.ndarray:
        """The receipt's probability under the law that each column has in this period."""
        delays = np.array([[*x.delays, x.loss] for x in laws]).T
        moving, pausing = np.array([1 - x.pause for x in laws]), np.array([x.pause for x in laws])
        last, place, source, outcome, target = len(delays) - 1, {}, [], [], []
        for i, state in enumerate(self.states):
            rest, found = state[1:], []
            if abs(state[0] + dispatched - received) <= 1e-9:
                found.append((0, rest))
            if abs(state[0] - received) <= 1e-9:
                found += [(d, (*rest[: d - 1], rest[d - 1] + dispatched, *rest[d:])) for d in range(1, last)] + [(last, rest)]
            for d, after in found:
                source.append(i)
                outcome.append(d)
                target.append(place.setdefault(after, len(place)))
        if not place:
            self.states, self.weights = [(0.0,) * len(self.states[0])], np.zeros((1, len(laws)))
            return np.zeros(len(laws))
        held = np.zeros((len(place), len(laws)))
        np.add.at(held, target, self.weights[source] * delays[outcome])
        total = held.sum(axis=0)
        held /= np.where(total > 0, total, 1)
        both: dict = {}
        moved = [both.setdefault((*s, 0.0), len(both)) for s in place]
        paused = [both.setdefault((0.0, *s), len(both)) for s in place]
        self.states, self.weights = list(both), np.zeros((len(both), len(laws)))
        np.add.at(self.weights, moved, held * moving)
        np.add.at(self.weights, paused, held * pausing)
        return total


def path_ratios(seeds: DataFrame, family: str, horizon: int, tau: int, grid: list[tuple[int, int, int | None]], true_law: Law = NULL, true_from: int | None = None) -> DataFrame:
    """seed, period and a log likelihood ratio for each alternative, after tau, on receipts drawn for the seed.

    Unit dispatches. true_law is in force from true_from on, if given: for power instead of calibration.
    """
    changed = changed_laws(family)

    def one(seed: int) -> list[tuple]:
        laws = [true_law if true_from is not None and t >= true_from else NULL for t in range(1, horizon + 1)]
        receipts, columns = sampled_path(laws, [1.0] * horizon, random.Random(seed)), SharedFilter(len(NULL.delays), 1 + len(grid))
        rows = []
        for t, received in enumerate(receipts, 1):
            live = [changed[law] if t >= start and (duration is None or t < start + duration) and t > tau else NULL for law, start, duration in grid]
            p = np.log(np.maximum(columns.step([NULL, *live], 1.0, received), 1e-300))
            if t > tau:
                rows.append((seed, t, (p[1:] - p[0]).tolist()))
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for seed in pdf["seed"]:
                yield pd.DataFrame(one(int(seed)), columns=["seed", "period", "ratios"])

    return seeds.select("seed").mapInPandas(run, "seed long, period int, ratios array<double>")


def calibration(spark: SparkSession, family: str, replications: int, horizon: int, tau: int, alpha: float, *, base: int = 20_260_908, **truth) -> DataFrame:
    """Share of paths on which the mixture over alternatives ever reaches 1 / alpha, with its score interval."""
    grid = [(r.law, r.start, r.duration) for r in alternatives(spark, family, tau).collect()]  # a registered handful
    seeds = spark.range(replications).select((F.col("id") + base).alias("seed")).repartition(4 * spark.sparkContext.defaultParallelism)
    rows = path_ratios(seeds, family, horizon, tau, grid, **truth)
    names = [f"c{k}" for k in range(len(grid))]
    wide = rows.select("seed", "period", *[F.col("ratios")[k].alias(n) for k, n in enumerate(names)])
    crossed = sequential.mixture_eprocess(wide, names, [1 / len(grid)] * len(grid), alpha, ["seed"]).groupBy("seed").agg(F.min("crossed_at").alias("at"))
    counts = crossed.agg(F.count("*").alias("replications"), F.count("at").alias("activated"))
    low, high = inference.wilson(F.col("activated"), F.col("replications"))
    exact = {"low": F.when(F.col("activated") == 0, 0.0).otherwise(low), "high": F.when(F.col("activated") == F.col("replications"), 1.0).otherwise(high)}
    return counts.select(F.lit(family).alias("law"), "replications", "activated", (F.col("activated") / F.col("replications")).alias("rate"), exact["low"].alias("low"), exact["high"].alias("high"))


def validity(spark: SparkSession) -> DataFrame:
    """construction, stream, method and status of each registered test."""
    # Fixed values.
    rows = [
        ("demand_level_up", "demand", "discrete_mixture_lr", "anytime_valid"), ("demand_level_down", "demand", "discrete_mixture_lr", "anytime_valid"), ("temporary_pulse", "demand", "bounded_duration_mixture_lr", "anytime_valid_low_power"),
        ("lead_time_shift", "arrival", "finite_state_forward", "anytime_valid_own_source_only"), ("shipment_loss", "arrival", "finite_state_forward_absorbing_loss", "anytime_valid_own_source_only"),
        ("transit_pause", "arrival", "finite_state_forward_frozen_counters", "anytime_valid_own_source_only"), ("compound", "both", "separate_eprocesses_alpha_split", "anytime_valid_via_splitting"),
    ]
    return spark.createDataFrame(rows, "construction string, stream string, method string, status string")


# What a lifecycle may become.
LEGAL = (("proposed", "active"), ("proposed", "refuted"), ("proposed", "expired"), ("proposed", "superseded"), ("active", "refuted"), ("active", "expired"), ("active", "superseded"))


def illegal_transitions(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events (keys, period, state) whose step from the state before is not legal."""
    from pyspark.sql.window import Window

    legal = events.sparkSession.createDataFrame(list(LEGAL), "before string, state string")
    before = F.coalesce(F.lag("state").over(Window.partitionBy(*keys).orderBy("period")), F.lit("proposed"))
    steps = events.withColumn("before", before).where("before <> state")
    return steps.join(F.broadcast(legal), ["before", "state"], "left_anti")


def superseded(proposals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """proposals (keys, proposal, first_evidence, ended_at): each ends no later than its successor's first evidence."""
    from pyspark.sql.window import Window

    heir = F.lead("first_evidence").over(Window.partitionBy(*keys).orderBy("proposal"))
    by_heir = heir.isNotNull() & (F.col("ended_at").isNull() | (heir < F.col("ended_at")))
    return proposals.withColumns({"state": F.when(by_heir, "superseded").when(F.col("ended_at").isNotNull(), "ended").otherwise("open"), "until": F.when(by_heir, heir).otherwise(F.col("ended_at"))})


def admissible(proposals: DataFrame, cap: int, horizon: int, keys: Sequence[str]) -> DataFrame:
    """proposals (keys, tau) with their ordinal, share of alpha halved each time (split in two for compounds), and a fault:
    beyond the cap, or at or after the horizon."""
    from pyspark.sql.window import Window

    ordinal = F.row_number().over(Window.partitionBy(*keys).orderBy("tau"))
    rows = proposals.withColumn("ordinal", ordinal)
    share = F.pow(F.lit(0.5), F.col("ordinal")) / F.when(F.col("family") == "compound", 2).otherwise(1)
    return rows.withColumns({"alpha_share": share, "fault": F.when(F.col("ordinal") > cap, "cap").when(F.col("tau") >= horizon, "horizon")})


def compound_points(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two streams' log e-values side by side by period, each with its own half of alpha."""
    side = lambda df, n: df.select(*keys, "period", F.col("log_e").alias(f"log_e_{n}"), F.col("crossed_at").alias(f"crossed_{n}"))
    both = side(first, "demand").join(side(second, "arrival"), [*keys, "period"], "full")
    return both.withColumn("activated_at", F.when(F.col("crossed_demand").isNotNull() & F.col("crossed_arrival").isNotNull(), F.greatest("crossed_demand", "crossed_arrival")))
