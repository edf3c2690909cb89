"""Cases that a shortened job would get wrong."""

from statistics import NormalDist, mean, stdev

import numpy as np
import pytest

from quayside.operators import inference, resampling


@pytest.mark.parametrize("values", [[(-1.0) ** k * k + 3 for k in range(21)], [0.1] * 30, [0.0] * 30, [float(k % 5) - 1.5 for k in range(300)]])
def test_sign_flip_of_many_values(spark, values):
    got = inference.sign_flip_exact(spark.createDataFrame([(v,) for v in values] + [(None,)], "d double"), "d").first()
    sd = stdev(values) if len(set(values)) > 1 else 0
    expected = 2 * (1 - NormalDist().cdf(abs(mean(values)) / (sd / len(values) ** 0.5))) if sd else float(mean(values) == 0)
    assert got.flips == 0 and abs(got.p_value - expected) < 1e-6


def units(spark, n):
    rng = np.random.default_rng(4)
    rows = [(int(u), float(x)) for u in range(n) for x in rng.normal(0.3, 1, 1 + u % 3)]
    s, k = np.zeros(n), np.zeros(n)
    for u, x in rows:
        s[u] += x
        k[u] += 1
    return spark.createDataFrame(rows, "unit long, d double"), s, k


@pytest.mark.parametrize("shard", [7, 10_000])
def test_bootstrap_of_all_units(spark, monkeypatch, shard):
    monkeypatch.setattr(resampling, "SHARD", shard)
    frame, s, k = units(spark, 90)
    pick = np.random.default_rng(1).integers(0, 90, (10_000, 90))
    low, high = np.quantile(s[pick].sum(axis=1) / k[pick].sum(axis=1), [0.025, 0.975])
    got = resampling.bootstrap(frame, "d", "unit").first()
    assert got.draws == 10_000 and abs(got.low - low) < 0.02 and abs(got.high - high) < 0.02
    counts = np.sum([resampling.shard_draws([3, 0, 5, 9], i, 200) for i in range(4)], axis=0)
    assert (counts == 17).all()


@pytest.mark.parametrize("shard", [3, 10_000])
def test_flips_of_all_units(spark, monkeypatch, shard):
    monkeypatch.setattr(resampling, "SHARD", shard)
    frame, s, _ = units(spark, 14)
    signs = np.unpackbits(np.arange(1 << 14, dtype=">u2").view("uint8").reshape(-1, 2), axis=1)[:, 2:] * 2.0 - 1
    exact = (signs @ s >= s.sum() - 1e-9).mean()
    got = resampling.flips(frame, "d", "unit").first()
    assert got.flips == 100_000 and abs(got.p_value - exact) < 0.005
