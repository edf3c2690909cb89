"""Posteriors over what may have changed, and the mixture of forecasts they weigh: ordered analytics without a closed loop.

A proposal at tau says that a demand level or the lead time changed near it. Over a grid of alternatives its likelihood up
to any later period is a difference of prefix sums, so that a period costs the grid, whatever its history. Lead times are
filtered forward: every period adds one term for each (shift, start), all starts together. Predictive moments over the lead
window are closed forms, hypotheses are weighed by prior and e-value on the log scale, and the mixture's quantile is found
by a fixed number of halvings, in numpy for a batch of rows. The rest is expressions; a row holds the grid of one proposal
and period.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.plans.runtime import let, spread

# Multipliers and durations (null: lasting) of each hypothesis with the weights of its durations, and shifts.
LASTING = ((None, 0.5), (2, 0.5 / 3), (3, 0.5 / 3), (4, 0.5 / 3))
PULSE = ((2, 1 / 3), (3, 1 / 3), (4, 1 / 3))
DEMAND = {"demand_up": ((1.25, 1.5), LASTING), "demand_down": ((0.6, 0.75), LASTING), "pulse_up": ((1.5, 2.0), PULSE)}
SHIFTS, LEAD = (1, 2, 3), "lead_time"
#: Starts around tau, prior strength of a level in periods, noise of receipts: a constant and a share of what was due.
DEMAND_STARTS, LEAD_STARTS, STRENGTH, NOISE = (-4, 2), (-4, 4), 5.0, (2.0, 0.05)
NEGLIGIBLE = 1e-6

# Hart's rational approximation of the normal distribution function, to double precision.
HART_ABOVE = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BELOW = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(x: Column) -> Column:
    def polynomial(factors: Sequence[float], z: Column) -> Column:
        out = F.lit(factors[0])
        for f in factors[1:]:
            out = out * z + f
        return out

    def tail(z: Column) -> Column:
        far = z + 0.65
        for k in (4, 3, 2, 1):
            far = z + k / far
        near = polynomial(HART_ABOVE, z) / polynomial(HART_BELOW, z)
        return F.exp(-z * z / 2) * F.when(z < 7.07106781186547, near).otherwise(1 / (far * 2.506628274631))

    return let(x, lambda v: F.when(v > 0, 1 - tail(F.abs(v))).otherwise(tail(F.abs(v))))


def total(parts: Column, of) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + of(p))


def normal_cdf_of(x: np.ndarray) -> np.ndarray:
    """normal_cdf of many values; beyond 40 deviations a tail is 0."""

    def polynomial(factors: Sequence[float], z: np.ndarray) -> np.ndarray:
        out = np.full_like(z, factors[0])
        for f in factors[1:]:
            out *= z
            out += f
        return out

    z = np.minimum(np.abs(x), 40.0)
    tail = polynomial(HART_ABOVE, z) / polynomial(HART_BELOW, z)
    out = np.flatnonzero(z >= 7.07106781186547)
    far = z[out] + 0.65
    for k in (4, 3, 2, 1):
        far = z[out] + k / far
    tail[out] = 1 / (far * 2.506628274631)
    tail *= np.exp(-z * z / 2)
    return np.where(x > 0, 1 - tail, tail)


def halved(parts: pa.Array, level: pa.Array, halvings: int) -> pa.Array:
    """Quantiles of a batch of mixtures, all halved together."""
    lengths = parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    some, flat = lengths > 0, parts.flatten()
    x = np.full(len(lengths), np.nan)
    if some.any():
        n = lengths[some]
        w, mu, sd = (pc.struct_field(flat, name).to_numpy(zero_copy_only=False) for name in ("w", "mu", "sd"))
        at, wanted, sd = np.cumsum(n) - n, level.to_numpy(zero_copy_only=False)[some], np.maximum(sd, 1e-9)
        low, high = np.minimum.reduceat(mu - 12 * sd, at), np.maximum.reduceat(mu + 12 * sd, at)
        for _ in range(halvings):
            middle = (low + high) / 2
            below = np.add.reduceat(w * normal_cdf_of((np.repeat(middle, n) - mu) / sd), at) < wanted
            low, high = np.where(below, middle, low), np.where(below, high, middle)
        x[some] = np.where(np.isnan(wanted), np.nan, (low + high) / 2)
    return pa.array(x, mask=np.isnan(x))


def mixture_quantile(parts: Column, level: Column, halvings: int = 56) -> Column:
    """x with sum w Phi((x - mu) / sd) = level for parts (w, mu, sd) whose weights sum to 1; null for none.

    The first bracket is 12 deviations around all parts; each step halves it, so that 56 leave less than 1e-7 of any
    bracket below 7e9.
    """

    def quantiles(parts: pa.Array, level: pa.Array) -> pa.Array:
        return halved(parts, level, halvings)

    return F.arrow_udf(quantiles, "double")(parts, level)


def histories(panel: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("episode",), squares: bool = False) -> DataFrame:
    """keys and, for each column, prefix sums <column>_s1 (and _s2 of squares) that begin with 0; periods count from 1 without gaps."""
    w = Window.partitionBy(*keys).orderBy("period")
    sums = {f"{c}_s1": F.sum(F.col(c).cast("double")).over(w) for c in columns}
    if squares:
        sums |= {f"{c}_s2": F.sum(F.col(c).cast("double") * F.col(c)).over(w) for c in columns}
    rows = panel.withColumns(sums).groupBy(*keys).agg(F.max("period").alias("last"), F.sort_array(F.collect_list(F.struct("period", *sums))).alias("_h"))
    return rows.select(*keys, "last", *[F.concat(F.array(F.lit(0.0)), F.col(f"_h.{c}")).alias(c) for c in sums])


def scored(logs: Column, floor: float = -1.0) -> Column:
    """Structs with a log weight l → the same with p, normalised; those of p at most floor go, the rest is not normalised anew."""
    top = lambda a: F.array_max(F.transform(a, lambda e: e["l"]))
    weighed = lambda a: let(top(a), lambda m: let(total(a, lambda e: F.exp(e["l"] - m)), lambda s: F.transform(a, lambda e: e.withField("p", F.exp(e["l"] - m) / s))))
    return let(logs, lambda a: F.filter(weighed(a), lambda e: e["p"] > floor))


class Demand:
    """Expressions over a row with tau, t, last and the prefix sums of demand (demand_s1, demand_s2)."""

    def __init__(self, s1: str = "demand_s1", s2: str = "demand_s2", tau: str = "tau", t: str = "t"):
        self.s1, self.s2, self.tau, self.t = F.col(s1), F.col(s2), F.col(tau), F.col(t)

    def between(self, sums: Column, first: Column, last: Column) -> Column:
        """Sum over periods first to last."""
        return F.get(sums, F.greatest(last, first - 1)) - F.get(sums, first - 1)

    def before(self, s: Column) -> tuple[Column, Column]:
        """Mean and deviation (1 at least) of the periods before s."""
        n, a, b = s - 1, F.get(self.s1, s - 1), F.get(self.s2, s - 1)
        var = F.when(n > 1, F.greatest(F.lit(0.0), (b - a * a / n) / (n - 1))).otherwise(0.0)
        return F.when(n > 0, a / n).otherwise(0.0), F.greatest(F.lit(1.0), F.sqrt(var))

    def grid(self, hypothesis: str) -> Column:
        """multiplier, start, duration, log prior, and mean and deviation before the start."""
        multipliers, durations = DEMAND[hypothesis]
        shape = F.array(*(F.struct(F.lit(m).alias("multiplier"), F.lit(d).cast("int").alias("duration"), F.log(F.lit(w)).alias("prior")) for m in multipliers for d, w in durations))
        starts = F.sequence(F.greatest(F.lit(2), self.tau + DEMAND_STARTS[0]), F.greatest(F.lit(2), self.tau + DEMAND_STARTS[1]))
        placed = F.transform(starts, lambda s: F.struct(s.alias("start"), self.before(s)[0].alias("mu"), self.before(s)[1].alias("sd")))
        return F.flatten(F.transform(placed, lambda s: F.transform(shape, lambda g: F.struct(g["multiplier"], s["start"], g["duration"], g["prior"], s["mu"], s["sd"]))))

    def last_of(self, g: Column) -> Column:
        """The last seen period of an alternative's change."""
        return F.least(self.t - 1, F.when(g["duration"].isNull(), self.t - 1).otherwise(g["start"] + g["duration"] - 1))

    def log_likelihood(self, g: Column) -> Column:
        """Of the periods from the first start to t - 1, by prefix sums."""
        low, m = F.greatest(F.lit(2), self.tau + DEMAND_STARTS[0]), g["multiplier"]

        def normal(n: Column, a: Column, b: Column, mu: Column, sd: Column) -> Column:
            return -(b - 2 * mu * a + n * mu * mu) / (2 * sd * sd) - n * F.log(sd)

        end = self.last_of(g)
        on = F.greatest(F.lit(0), end - g["start"] + 1)
        a, b = self.between(self.s1, g["start"], end), self.between(self.s2, g["start"], end)
        rest, all_a, all_b = self.t - low - on, self.between(self.s1, low, self.t - 1), self.between(self.s2, low, self.t - 1)
        return normal(rest, all_a - a, all_b - b, g["mu"], g["sd"]) + normal(on, a, b, m * g["mu"], m * g["sd"])

    def posterior(self, hypothesis: str) -> Column:
        """Alternatives (multiplier, start, duration, mu, sd, l, p) that are not negligible."""
        return scored(F.transform(self.grid(hypothesis), lambda g: g.withField("l", g["prior"] + self.log_likelihood(g))), NEGLIGIBLE)

    def moments(self, g: Column, lead: Column) -> tuple[Column, Column]:
        """Mean and deviation of demand in t to t + lead under an alternative; its level leans on what was seen of it."""
        end = self.last_of(g)
        seen = F.greatest(F.lit(0), end - g["start"] + 1)
        level = (STRENGTH * g["multiplier"] * g["mu"] + self.between(self.s1, g["start"], end)) / (STRENGTH + seen)
        until = F.least(self.t + lead, F.when(g["duration"].isNull(), self.t + lead).otherwise(g["start"] + g["duration"] - 1))
        on = F.greatest(F.lit(0), until - F.greatest(self.t, g["start"]) + 1)
        off = lead + 1 - on
        return on * level + off * g["mu"], F.sqrt(on * F.pow(g["multiplier"] * g["sd"], 2) + off * g["sd"] * g["sd"])


def demand_posterior(panel: DataFrame, proposals: DataFrame, lifetime: int, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """A row for each proposal (keys, tau, hypothesis, lead), and period t after it, with its posterior of alternatives as
    parts (p, multiplier, start, duration, active at t, mu and sd of demand over the lead window)."""
    rows = spread(proposals.join(histories(panel, ["demand"], keys, squares=True), list(keys)), *keys, "hypothesis", "tau")
    rows = rows.withColumn("t", F.explode(F.when(F.col("tau") < F.col("last"), F.sequence(F.col("tau") + 1, F.least("last", F.col("tau") + lifetime)))))
    d = Demand()
    found = F.coalesce(*(F.when(F.col("hypothesis") == h, d.posterior(h)) for h in DEMAND))

    def part(g: Column) -> Column:
        mu, sd = d.moments(g, F.col("lead"))
        active = (F.col("t") >= g["start"]) & (g["duration"].isNull() | (F.col("t") < g["start"] + g["duration"]))
        return F.struct(g["p"].alias("p"), g["multiplier"].alias("multiplier"), g["start"].alias("start"), g["duration"].alias("duration"), active.alias("active"), mu.alias("mu"), sd.alias("sd"))

    return rows.where(F.col("hypothesis").isin(*DEMAND)).withColumn("found", found).select(*keys, "hypothesis", "tau", "t", "lead", F.transform("found", part).alias("parts"))


def lead_posterior(receipts: DataFrame, proposals: DataFrame, lifetime: int, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """keys, tau, t, lead and parts (p, shift, start, active at t) of the shift of the lead time.

    receipts: keys, period, dispatched, received. Each (shift, start) is a course of expected receipts; a running sum of
    their log densities filters all of them forward, and what is under way at t adds one more term.
    """
    low = lambda c: F.greatest(F.lit(2), F.col("tau") + c)
    flow = histories(receipts, ["dispatched", "received"], keys)
    rows = proposals.where(F.col("hypothesis") == LEAD).join(flow, list(keys)).where(F.col("tau") < F.col("last"))
    at = lambda sums, u: F.when((u >= 1) & (u <= F.col("last")), F.get(sums, u) - F.get(sums, u - 1)).otherwise(0.0)
    upto = lambda sums, u: F.get(sums, F.greatest(F.lit(0), u))
    shape = F.explode(F.flatten(F.transform(F.sequence(low(LEAD_STARTS[0]), low(LEAD_STARTS[1])), lambda s: F.transform(F.array(*map(F.lit, SHIFTS)), lambda k: F.struct(k.alias("shift"), s.alias("start"))))))
    grid = rows.withColumn("g", shape).withColumn("v", F.explode(F.sequence(low(LEAD_STARTS[0]), F.least("last", F.col("tau") + lifetime))))
    v, lead, shift, start = F.col("v"), F.col("lead"), F.col("g.shift"), F.col("g.start")

    def log_density(seen: Column, due: Column) -> Column:
        sd = NOISE[0] + NOISE[1] * F.abs(due)
        return -F.pow((seen - due) / sd, 2) / 2 - F.log(sd)

    q = F.col("dispatched_s1")
    due = F.when(v - lead < start, at(q, v - lead)).otherwise(0.0) + F.when(v - lead - shift >= start, at(q, v - lead - shift)).otherwise(0.0)
    before = F.greatest(F.lit(0.0), upto(q, F.least(v - 1, start - 1)) - upto(q, v - lead - 1))
    after = F.greatest(F.lit(0.0), upto(q, v - 1) - upto(q, F.greatest(start, v - lead - shift) - 1))
    under_way = upto(q, v - 1) - upto(F.col("received_s1"), v - 1)
    course = Window.partitionBy(*keys, "tau", "lead", "shift", "start").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    steps = grid.select(*keys, "tau", "lead", shift.alias("shift"), start.alias("start"), v.alias("t"), log_density(at(F.col("received_s1"), v), due).alias("step"), log_density(under_way, before + after).alias("now"))
    steps = steps.repartition(*keys, "tau").withColumn("l", F.coalesce(F.sum("step").over(course), F.lit(0.0)) + F.col("now")).where("t > tau")
    parts = steps.groupBy(*keys, "tau", "lead", "t").agg(scored(F.sort_array(F.collect_list(F.struct("shift", "start", "l")))).alias("parts"))
    return parts.withColumn("parts", F.transform("parts", lambda e: F.struct(e["p"].alias("p"), e["shift"].alias("shift"), e["start"].alias("start"), (F.col("t") >= e["start"]).alias("active"))))


def hedge(demand: DataFrame, lead: DataFrame, evidence: DataFrame, forecasts: DataFrame, level: float, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """keys, t, shock_mass, top (the hypothesis of the largest mass) and target, the level quantile of demand over the lead
    window under the mixture of no change and every live hypothesis.

    evidence: keys, hypothesis, t, prior, log_e (null: the hypothesis is dead). forecasts: keys, t, lead, mean, sd.
    """
    known = [*keys, "hypothesis", "t"]
    window = lambda lead_time, m, s: ((1 + lead_time) * m, F.sqrt(1 + lead_time) * s)
    part = lambda p, mu, sd: F.struct(p.alias("p"), mu.alias("mu"), sd.alias("sd"))
    level_parts = demand.select(*known, F.transform("parts", lambda e: part(e["p"], e["mu"], e["sd"])).alias("parts"))
    shifted = lead.join(forecasts.select(*keys, "t", "mean", "sd"), [*keys, "t"])
    later = lambda e: window(F.col("lead") + F.when(e["active"], e["shift"]).otherwise(0), F.col("mean"), F.col("sd"))
    lead_parts = shifted.select(*keys, F.lit(LEAD).alias("hypothesis"), "t", F.transform(F.filter("parts", lambda e: e["p"] >= NEGLIGIBLE), lambda e: part(e["p"], *later(e))).alias("parts"))
    live = evidence.where("log_e is not null").join(level_parts.unionByName(lead_parts), known)
    live = live.withColumn("mass", F.log("prior") + F.col("log_e"))
    masses = live.groupBy(*keys, "t").agg(
        F.sum("prior").alias("prior"), F.max_by("hypothesis", F.struct("mass", "hypothesis")).alias("top"),
        F.flatten(F.collect_list(F.transform("parts", lambda e: F.struct((F.col("mass") + F.log(e["p"])).alias("l"), e["mu"].alias("mu"), e["sd"].alias("sd"))))).alias("alternatives"),
    )
    rows = forecasts.join(masses, [*keys, "t"])
    mu, sd = window(F.col("lead"), F.col("mean"), F.col("sd"))
    none = F.struct(F.log(1 - F.col("prior")).alias("l"), mu.alias("mu"), sd.alias("sd"))
    rows = rows.withColumn("mix", scored(F.concat(F.array(none), "alternatives")))
    weighed = F.transform("mix", lambda e: F.struct(e["p"].alias("w"), e["mu"].alias("mu"), e["sd"].alias("sd")))
    return rows.select(*keys, "t", (1 - F.get("mix", F.lit(0))["p"]).alias("shock_mass"), "top", weighed.alias("mix")).withColumn("target", mixture_quantile(F.col("mix"), F.lit(level))).drop("mix")
