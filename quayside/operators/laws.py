"""Demand laws and arrival filters for sequential tests, and exact binomial limits: vectorised numpy over Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERFC = np.vectorize(math.erfc, otypes=[float])
LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def log_normal_cdf(x: np.ndarray) -> np.ndarray:
    """log P(Z <= x), stable in the left tail: a continued fraction of Mills' ratio below -12."""
    x = np.asarray(x, dtype=float)
    far = x < -12
    with np.errstate(divide="ignore"):
        near = np.log(0.5 * ERFC(-np.where(far, 0.0, x) / math.sqrt(2)))
    z, fraction = -np.where(far, x, -13.0), 0.0
    for k in range(60, 0, -1):
        fraction = k / (z + fraction)
    return np.where(far, -z * z / 2 - 0.5 * math.log(2 * math.pi) - np.log(z + fraction), near)


def log_difference(larger: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """log(exp(larger) - exp(smaller)); -inf where they are equal."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(smaller >= larger, -np.inf, larger + np.log1p(-np.exp(smaller - larger)))


def rounded_normal_log_mass(value: np.ndarray, mean, sd) -> np.ndarray:
    """log P(max(0, floor(X + 1/2)) = value) for a normal X; -inf off the whole numbers."""
    value = np.asarray(value, dtype=float)
    low, high = (value - 0.5 - mean) / sd, (value + 0.5 - mean) / sd
    right = low > 0  # by symmetry the right tail is a difference of left tails
    a, b = np.where(right, -low, high), np.where(right, -high, low)
    inside = log_difference(log_normal_cdf(a), log_normal_cdf(b))
    mass = np.where(value == 0, log_normal_cdf(high), inside)
    return np.where((value >= 0) & (value == np.floor(value)), mass, -np.inf)


def negative_binomial_log_mass(value: np.ndarray, mean, sd) -> np.ndarray:
    """By mean and standard deviation; the variance must exceed the mean."""
    value = np.asarray(value, dtype=float)
    shape = mean * mean / (sd * sd - mean)
    p, ok = shape / (shape + mean), (value >= 0) & (value == np.floor(value))
    v = np.where(ok, value, 0.0)
    return np.where(ok, LGAMMA(v + shape) - LGAMMA(np.asarray(shape)) - LGAMMA(v + 1) + shape * np.log(p) + v * np.log1p(-p), -np.inf)


def shocked_log_mass(value: np.ndarray, multiplier: float, base) -> np.ndarray:
    """log P(floor(m X + 1/2) = value) for a whole-number X with log mass base: the masses of all sources summed."""
    value = np.asarray(value, dtype=float)
    low = np.maximum(0, np.ceil((value - 0.5) / multiplier))
    high = np.ceil((value + 0.5) / multiplier) - 1
    widest = int(max(0, (high - low).max(initial=0))) + 1
    terms = np.stack([np.where(low + k <= high, base(low + k), -np.inf) for k in range(widest)])
    top = terms.max(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(top), -np.inf, top + np.log(np.exp(terms - np.where(np.isneginf(top), 0, top)).sum(axis=0)))


def log_likelihood_ratio(value: Column, mean: float, sd: float, multiplier: float) -> Column:
    """Of a level change against the registered normal law, for whole-number demand."""

    def ratio(x: pd.Series) -> pd.Series:
        base = lambda v: rounded_normal_log_mass(v, mean, sd)
        return pd.Series(shocked_log_mass(x.to_numpy(), multiplier, base) - base(x.to_numpy()))

    return F.pandas_udf(ratio, "double")(value.cast("double"))


class ArrivalFilter:
    """Exact forward filter of a shipment pipeline: rows of quantities by remaining periods, and their probabilities.

    delays: probability of each delay from 0; what they leave of 1 is the chance of loss. pause: chance that a period
    does not move the pipeline.
    """

    def __init__(self, delays: Sequence[float], pause: float):
        self.delays, self.pause = np.asarray(delays, float), pause
        self.states, self.weights = np.zeros((1, len(self.delays))), np.ones(1)

    def step(self, dispatched: float, received: float) -> float:
        """Probability of the receipt, given all before it; 0 if the law rules it out."""
        lost = max(0.0, 1 - self.delays.sum())
        shift = np.eye(len(self.delays)) * dispatched
        placed = np.concatenate([self.states[:, None, :] + shift[None], self.states[:, None, :]], axis=1).reshape(-1, len(self.delays))
        weight = (self.weights[:, None] * np.append(self.delays, lost)[None]).ravel()
        fits = (np.abs(placed[:, 0] - received) <= 1e-9) & (weight > 0)
        placed, weight = placed[fits], weight[fits]
        placed[:, 0] = 0
        moved = np.concatenate([placed[:, 1:], np.zeros((len(placed), 1))], axis=1)
        both, mass = np.concatenate([moved, placed]), np.concatenate([weight * (1 - self.pause), weight * self.pause])
        both, mass = both[mass > 0], mass[mass > 0]
        if not len(mass):
            return 0.0
        self.states, at = np.unique(both, axis=0, return_inverse=True)
        sums = np.bincount(at.ravel(), mass)
        self.weights = sums / sums.sum()
        return float(sums.sum())


def arrival_likelihood(panel: DataFrame, delays: Sequence[float], pause: float, key: str = "episode") -> DataFrame:
    """key, log_likelihood of the receipts given the dispatches, and steps until one was impossible (all, if none was)."""

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        law, total, steps = ArrivalFilter(delays, pause), 0.0, 0
        for _, dispatched, received in sorted(zip(rows["period"], rows["dispatched"], rows["received"], strict=True)):
            p = law.step(dispatched, received)
            total += math.log(p) if p > 0 else -math.inf
            if p <= 0:
                break
            steps += 1
        return pd.DataFrame({key: [group[0]], "log_likelihood": [total], "steps": [steps]})

    kind = panel.schema[key].dataType.simpleString()
    return panel.groupBy(key).applyInPandas(run, f"{key} {kind}, log_likelihood double, steps long")


def beta_share(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, elementwise, by its continued fraction."""
    turned = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 200_000):
        for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            f = f * d * c
        if (np.abs(d * c - 1) < 1e-14).all():
            break
    with np.errstate(divide="ignore"):
        front = np.exp(LGAMMA(p + q) - LGAMMA(p) - LGAMMA(q) + p * np.log(y) + q * np.log1p(-y))
    share = np.where(y <= 0, 0.0, front * f / p)
    return np.where(turned, 1 - share, share)


def exact_limits(k: np.ndarray, n: np.ndarray, level: float, upper: bool) -> np.ndarray:
    """One-sided exact limits of proportions: quantiles of beta laws, by bisection of all rows at once."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    ends = k >= n if upper else k <= 0
    a, b = (k + 1, n - k) if upper else (k, n - k + 1)
    a, b = np.where(ends, 1.0, a), np.where(ends, 1.0, b)
    goal = level if upper else 1 - level
    low, high = np.zeros(len(k)), np.ones(len(k))
    for _ in range(60):
        x = (low + high) / 2
        below = beta_share(x, a, b) < goal
        low, high = np.where(below, x, low), np.where(below, high, x)
    return np.where(ends, 1.0 if upper else 0.0, (low + high) / 2)


def exact_interval(frame: DataFrame, k: str, n: str, level: float = 0.975) -> DataFrame:
    """frame with exact_low and exact_high."""

    def limits(upper: bool):
        return F.pandas_udf(lambda ks, ns: pd.Series(exact_limits(ks.to_numpy(), ns.to_numpy(), level, upper)), "double")

    return frame.withColumns({"exact_low": limits(False)(k, n), "exact_high": limits(True)(k, n)})
