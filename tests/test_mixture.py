"""Posteriors of changes and mixture quantiles against plain enumeration."""

import math
import random
from statistics import NormalDist, mean, stdev

import numpy as np
from pyspark.sql import functions as F

from quayside.operators import mixture as M


def test_normal_cdf(spark):
    xs = [k / 7 for k in range(-280, 281)]
    got = {r.x: r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", M.normal_cdf(F.col("x")).alias("p")).collect()}
    assert all(abs(got[x] - NormalDist().cdf(x)) < 2e-15 + 1e-13 * min(NormalDist().cdf(x), 1) or abs(x) > 8 for x in xs)
    assert all(0 <= got[x] <= 1 for x in xs) and got[xs[0]] < 1e-300


def test_mixture_quantile(spark):
    rng = random.Random(4)
    rows = []
    for k in range(30):
        w = [rng.random() for _ in range(1 + k % 5)]
        rows.append((k, [(x / sum(w), rng.uniform(-500, 900), rng.choice([0.5, 30.0, 200.0])) for x in w], rng.choice([0.05, 0.5, 0.95])))
    rows.append((99, [], 0.5))
    df = spark.createDataFrame(rows, "k int, parts array<struct<w:double,mu:double,sd:double>>, level double")
    got = {r.k: r.x for r in df.select("k", M.mixture_quantile(F.col("parts"), F.col("level")).alias("x")).collect()}
    for k, parts, level in rows[:-1]:
        below = lambda x: sum(w * NormalDist(mu, sd).cdf(x) for w, mu, sd in parts)  # noqa: E731, B023
        assert below(got[k] - 1e-6) <= level + 1e-12 and below(got[k] + 1e-6) >= level - 1e-12
    assert got[99] is None


def enumerated(demand, tau, t, hypothesis):
    multipliers, durations = M.DEMAND[hypothesis]
    out = {}
    low = max(2, tau - 4)
    for s in range(low, tau + 3):
        past = demand[: s - 1]
        mu, sd = mean(past) if past else 0.0, max(1.0, stdev(past) if len(past) > 1 else 0.0)
        for m in multipliers:
            for d, w in durations:
                ll = math.log(w)
                for u in range(low, t):
                    f = m if u >= s and (d is None or u < s + d) else 1.0
                    ll += -0.5 * ((demand[u - 1] - f * mu) / (f * sd)) ** 2 - math.log(f * sd)
                out[m, s, d] = ll
    top = max(out.values())
    total = sum(math.exp(x - top) for x in out.values())
    return {k: math.exp(x - top) / total for k, x in out.items()}


def test_demand_posterior(spark):
    rng = random.Random(8)
    paths = {e: [rng.randint(60, 140) if t < 12 or e else rng.randint(100, 190) for t in range(1, 31)] for e in range(3)}
    panel = spark.createDataFrame([(e, t, d) for e, x in paths.items() for t, d in enumerate(x, 1)], "episode int, period int, demand long")
    made = spark.createDataFrame([(e, tau, h, 2) for e in paths for tau in (3, 12, 29, 30) for h in (*M.DEMAND, M.LEAD)], "episode int, tau int, hypothesis string, lead int")
    rows = M.demand_posterior(panel, made, 10).collect()
    assert {(r.tau, r.t) for r in rows} == {(tau, t) for tau in (3, 12, 29) for t in range(tau + 1, min(30, tau + 10) + 1)}
    for r in rows:
        want = {k: p for k, p in enumerated(paths[r.episode], r.tau, r.t, r.hypothesis).items() if p > 1e-6}
        got = {(p.multiplier, p.start, p.duration): p.p for p in r.parts}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_lead_posterior(spark):
    rng = random.Random(2)
    lead, horizon, sent = 2, 26, [0] + [rng.randint(0, 40) for _ in range(26)]
    got = [0.0] * 60
    for u in range(1, horizon + 1):
        got[u + lead + (2 if u >= 11 else 0)] += sent[u]
    receipts = spark.createDataFrame([(1, t, sent[t], got[t]) for t in range(1, horizon + 1)], "episode int, period int, dispatched long, received double")
    rows = M.lead_posterior(receipts, spark.createDataFrame([(1, 10, M.LEAD, lead), (1, 26, M.LEAD, lead)], "episode int, tau int, hypothesis string, lead int"), 9).collect()
    assert sorted((r.tau, r.t) for r in rows) == [(10, t) for t in range(11, 20)]
    for r in rows:
        logs = {}
        for shift in M.SHIFTS:
            for s in range(6, 15):
                due = lambda v, shift=shift, s=s: sum(sent[u] for u in range(1, r.t) if u + lead + (shift if u >= s else 0) == v)  # noqa: E731, B023
                density = lambda seen, x: -0.5 * ((seen - x) / (2 + 0.05 * x)) ** 2 - math.log(2 + 0.05 * x)
                way = sum(sent[u] for u in range(1, r.t) if u + lead + (shift if u >= s else 0) >= r.t)
                logs[shift, s] = sum(density(got[v], due(v)) for v in range(6, r.t)) + density(sum(sent[1 : r.t]) - sum(got[1 : r.t]), way)
        top = max(logs.values())
        total = sum(math.exp(x - top) for x in logs.values())
        assert all(abs(p.p - math.exp(logs[p.shift, p.start] - top) / total) < 1e-9 for p in r.parts) and len(r.parts) == 27
    last = max(rows, key=lambda r: r.t)
    assert max(last.parts, key=lambda p: p.p)[1:3] == (2, 11)


def test_quantiles_of_far_parts_and_odd_rows(spark):
    xs = np.linspace(-45, 45, 3001)
    want = np.array([NormalDist().cdf(x) for x in xs])
    assert np.abs(M.normal_cdf_of(xs) - want).max() < 1e-14
    rows = [(1, None, 0.5), (2, [(1.0, 5.0, 2.0)], 0.5), (3, [(0.5, -1e6, 0.0), (0.5, 1e6, 1e-3)], 0.25), (4, [], 0.5), (5, [(1.0, 5.0, 2.0)], None)]
    df = spark.createDataFrame(rows, "k int, parts array<struct<w:double,mu:double,sd:double>>, level double").coalesce(1)
    got = {r.k: r.x for r in df.select("k", M.mixture_quantile(F.col("parts"), F.col("level")).alias("x")).collect()}
    assert got[1] is got[4] is got[5] is None and abs(got[2] - 5) < 1e-7 and abs(got[3] + 1e6) < 1e-6


def test_posteriors_are_dealt_over_all_cores(spark):
    panel = spark.createDataFrame([(e, t, 100 + (e * t) % 9) for e in range(20) for t in range(1, 31)], "episode int, period int, demand long")
    made = spark.createDataFrame([(e, 12, h, 2) for e in range(20) for h in M.DEMAND], "episode int, tau int, hypothesis string, lead int")
    rows = M.demand_posterior(panel, made, 10).withColumn("task", F.spark_partition_id())
    assert rows.select("task").distinct().count() > 4
