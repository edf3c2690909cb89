"""Exact sign flips by halves against full enumeration and against the exact distribution of whole numbers."""

import itertools
import random

import numpy as np
import pytest

from quayside.operators import inference, resampling


def frame_of(spark, sums):
    rows = [(k, s - 0.5) for k, s in enumerate(sums)] + [(k, 0.5) for k in range(len(sums))]
    return spark.createDataFrame([*rows, (0, None)], "c int, d double")


@pytest.mark.parametrize("n", [1, 2, 7, 20])
def test_equals_full_enumeration(spark, n):
    rng = random.Random(n)
    for sums in ([rng.gauss(0.4, 1) for _ in range(n)], [float(rng.choice([-2, -1, 0, 1, 3])) for _ in range(n)]):
        signs = np.array(list(itertools.product((-1.0, 1.0), repeat=n)))
        want = float((signs @ np.array(sums) >= sum(sums) - 1e-9).mean())
        got = inference.sign_flip_halves(frame_of(spark, sums), "d", "c").first()
        assert (got.clusters, got.signings) == (n, 2**n) and abs(got.p_exact - want) < 1e-12


def test_forty_clusters_of_whole_numbers(spark):
    rng = random.Random(40)
    sums = [rng.randint(-30, 60) for _ in range(40)]
    ways = {0: 1}
    for s in sums:
        step: dict[int, int] = {}
        for total, k in ways.items():
            for x in (total + s, total - s):
                step[x] = step.get(x, 0) + k
        ways = step
    want = sum(k for total, k in ways.items() if total >= sum(sums)) / 2**40
    got = resampling.cluster_test(frame_of(spark, sums), "d", "c", 20_000).first()
    assert abs(got.p_exact - want) < 1e-12 and got.p == got.p_exact and abs(got.p_random - want) < 0.01


def test_more_clusters_than_the_limit(spark):
    got = resampling.cluster_test(frame_of(spark, [1.0, 2.0, -1.0, 0.5]), "d", "c", 2_000, limit=3).first()
    assert got.clusters == 4 and got.p_exact is None and got.p == got.p_random
    assert inference.sign_flip_halves(frame_of(spark, []).where("c < 0"), "d", "c").first().p_exact is None
