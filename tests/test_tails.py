"""The lift rule's bootstrap against plain redraws."""

import math

import numpy as np
import pytest

from quayside.operators import tails


def pairs_of(sizes, seed=3):
    rng = np.random.default_rng(seed)
    return [(k, u, float(np.round(rng.gamma(3, 40) * lift, 1)), float(np.round(rng.gamma(3, 40), 1))) for k, (n, lift) in sizes.items() for u in range(n)]


def replayed(spark, rows, draws):
    """Multiplicities that the shards draw, read back through sums of one unit's indicator at a time."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "key string, unit int, a double, b double")
    shards, sizes = tails.sharded(frame)
    out = {}
    for key, n in sizes.items():
        units = shards.where(F.col("key") == key).select("unit", "shard").toPandas().sort_values(["shard", "unit"])
        m = np.zeros((draws, 1 + units["unit"].max()), int)
        for shard in range(len(n)):
            own = units[units["shard"] == shard]["unit"].to_numpy()
            if not len(own):
                continue
            k = tails.shard_draws(n, shard, draws)
            pick = np.random.default_rng([tails.SEED, tails.zlib.crc32(key.encode()), len(n), shard]).integers(0, len(own), k.sum())
            np.add.at(m, (np.repeat(np.arange(draws), k), own[pick]), 1)
        out[key] = m
    return frame, out


@pytest.mark.parametrize("shard", [4096, 7])
def test_every_draw_has_its_tail(spark, monkeypatch, shard):
    """Means and tail means of every draw, from its multiplicities and the sorted values, on 60 units and on few."""
    monkeypatch.setattr(tails, "SHARD", shard)
    rows, draws = pairs_of({"x": (60, 1.3), "y": (5, 1.0), "z": (1, 1.0), "ties": (40, 1.0)}), 50
    rows = [(k, u, round(a / 50) * 50.0, b) if k == "ties" else (k, u, a, b) for k, u, a, b in rows]
    frame, drawn = replayed(spark, rows, draws)
    got = {(r.key, r.draw): r for r in tails.tail_draws(frame, draws).collect()}
    assert len(got) == 4 * draws
    for key, m in drawn.items():
        own = [r for r in rows if r[0] == key]
        assert (m.sum(axis=1) == len(own)).all()
        for d in range(draws):
            for arm, column in (("a", 2), ("b", 3)):
                values = sorted(v for r in own for v in [r[column]] * m[d, r[1]])
                tail = values[: math.ceil(0.1 * len(own))]
                r = got[key, d]
                assert abs(r[f"mean_{arm}"] - np.mean(values)) < 1e-9 and abs(r[f"tail_{arm}"] - np.mean(tail)) < 1e-9


def test_interval_agrees_with_plain_redraws(spark):
    rows = pairs_of({f"f{k}": (60, 1.0 + 0.03 * k) for k in range(6)}, 5)
    frame = spark.createDataFrame(rows, "key string, unit int, a double, b double")
    counts = np.zeros(2000)
    rng, k = np.random.default_rng(0), 6
    for f in range(6):
        a, b = (np.array([r[c] for r in rows if r[0] == f"f{f}"]) for c in (2, 3))
        pick = rng.integers(0, 60, (2000, 60))
        low = lambda x: np.sort(x[pick], axis=1)[:, :k].mean(axis=1)  # noqa: E731, B023
        raw, tail = a[pick].mean(axis=1) / b[pick].mean(axis=1) - 1, low(a) / low(b) - 1
        counts += (raw >= 0.05) | (tail >= 0.10)
    got = tails.lift_interval(frame, 2000).first()
    assert got.draws == 2000 and abs(got.low - np.quantile(counts, 0.025)) <= 1 and abs(got.high - np.quantile(counts, 0.975)) <= 1
    shares = {r["count"]: r["share"] for r in tails.lift_distribution(frame, 2000).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and all(abs(s - (counts == c).mean()) < 0.06 for c, s in shares.items())
