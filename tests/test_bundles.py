"""Digest trees, committed reports and landing clocks."""

import csv
import hashlib
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from quayside.operators import mechanisms
from quayside.sources import bundle, digests


def run_of(spark, change=None, n=4000):
    rows = [(k // 4, k % 4, float(k % 97), None if k % 13 == 0 else f"t{k}") for k in range(n)]
    return spark.createDataFrame(change(rows) if change else rows, "episode long, arm int, x double, note string")


@pytest.mark.parametrize(("at", "new", "side", "names"), [(2345, (586, 1, 0.5, "t2345"), "both", ["x"]), (13, None, "left only", ["note", "x"]), (3999, (999, 3, float(3999 % 97), "other"), "both", ["note"])])
def test_one_planted_difference(spark, tmp_path, at, new, side, names):
    left, right = str(tmp_path / "a"), str(tmp_path / "b")
    bounds = digests.store_run(run_of(spark), left, "episode")
    change = lambda rows: rows[:at] + ([new] if new else []) + rows[at + 1 :]
    digests.store_run(run_of(spark, change).repartition(3, "x"), right, "episode", bounds=bounds)
    found = digests.first_difference(spark, left, right, ["episode", "arm"])
    row = found.first()
    assert (row.episode, row.arm, row.side) == (at // 4, at % 4, side) and (side != "both" or sorted(row.differing) == names)
    path = digests.differing_nodes(spark, left, right)
    assert [len(p) for p in path] == [1, 1, 1]
    read = digests.stored_rows(spark, left).where(F.col("_leaf") == path[-1][0])
    assert read.count() <= 4000 / 256 + 4 and len(os.listdir(tmp_path / "a" / "rows")) > 200


def test_runs_that_agree(spark, tmp_path):
    bounds = digests.store_run(run_of(spark), str(tmp_path / "a"), "episode")
    digests.store_run(run_of(spark).orderBy("x"), str(tmp_path / "b"), "episode", bounds=bounds)
    assert digests.first_difference(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["episode", "arm"]).count() == 0
    empty = run_of(spark).where("arm > 9")
    digests.store_run(empty, str(tmp_path / "c"), "episode", bounds=bounds)
    assert digests.first_difference(spark, str(tmp_path / "a"), str(tmp_path / "c"), ["episode", "arm"]).first().episode == 0


def test_bundle(spark, tmp_path):
    a = spark.createDataFrame([(k, f'say "{k}", or\nnot', None if k % 2 else 0.5) for k in range(500)], "k int, t string, x double")
    b = spark.createDataFrame([], "only int")
    made = [bundle.write_bundle({"a": (a.repartition(n), ["k"]), "b": (b, ["only"])}, str(tmp_path / f"r{n}"), {"run": "x", "version": 3}) for n in (1, 7)]
    for n, manifest in zip((1, 7), made, strict=True):
        folder = tmp_path / f"r{n}"
        files = [p for parts in manifest["tables"].values() for p in parts]
        assert (manifest["run"], manifest["version"]) == ("x", 3) and {p["file"] for p in files} | {"manifest.json"} == {f for f in os.listdir(folder) if not f.startswith(".")}
        assert all(hashlib.sha256((folder / p["file"]).read_bytes()).hexdigest() == p["sha256"] for p in files)
        text = "".join((folder / p["file"]).read_text() for p in manifest["tables"]["a"])
        rows = list(csv.reader(text.splitlines(keepends=True)))
        assert rows[0] == ["k", "t", "x"] and [r[0] for r in rows[1:]] == [str(k) for k in range(500)] and rows[3] == ["2", 'say "2", or\nnot', "0.5"]
    with pytest.raises(Exception, match="holds a report"):
        bundle.write_bundle({"b": (b, ["only"])}, str(tmp_path / "r1"), {})


def test_failing_task_leaves_nothing(spark, tmp_path):
    bad = spark.range(100).withColumn("x", F.when(F.col("id") == 57, F.raise_error(F.lit("broken row")).cast("string")).otherwise("ok"))
    whole = bad.select(F.lit("t").alias("table"), F.col("id").alias("place"), F.col("x").alias("line")).repartition(5)
    spark.dataSource.register(bundle.BundleSource)
    with pytest.raises(Exception, match="broken row"):
        whole.write.format("quayside_bundle").option("path", str(tmp_path / "r")).mode("append").save()
    assert not (tmp_path / "r").exists() or os.listdir(tmp_path / "r") == []


def test_landing_clock(spark):
    rng = random.Random(1)
    rows = [(e, t, t + rng.randint(0, 6) if rng.random() < 0.8 else None) for e in range(5) for t in range(1, 21)]
    clock = {(r.episode, r.period): r for r in mechanisms.landing_clock(spark.createDataFrame(rows, "episode int, period int, landing int")).collect()}
    for e, t in itertools.product(range(5), range(1, 21)):
        later = [(landing, u) for k, u, landing in rows if k == e and u >= t and landing is not None]
        r = clock[e, t]
        assert r.soonest == (min(later)[0] if later else None)
        assert r.by == (max(u for landing, u in later if landing == r.soonest) if later else None)
