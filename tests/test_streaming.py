"""Streaming forms against the batch ones, on shuffled rows."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from quayside.operators import control
from quayside.streaming import lifecycle
from quayside.streaming.detectors import stream_totals

LAW = {"mean": 100.0, "sd": 20.0, "alpha": 0.05, "refute_below": -1.0, "streak": 3}


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, lifecycle.STORE)
    yield
    spark.conf.set(name, before)


def streamed(spark, frame, folder, out, build, mode="append"):
    """All rows through a stream of several files, then one far row that moves the watermark past all."""
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    query = build(stream).writeStream.format("memory").queryName(out).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.table(out)


def test_lifecycle_equals_batch_on_shuffled_rows(spark, tmp_path, rocks):
    rng = random.Random(6)
    paths = {e: [rng.gauss(100 * (1.4 if e % 3 == 1 and t > 8 else 1), 20) for t in range(1, 31)] for e in range(6)}
    made = [(e, p, tau, m, life) for e in paths for p, tau, m, life in ((1, 5, 1.5, 12), (2, 9, 1.25, 25), (3, 11, 0.6, 4), (4, 29, 1.5, 10))]
    panel = spark.createDataFrame([(e, t, d) for e, x in paths.items() for t, d in enumerate(x, 1)], "episode int, period int, demand double")
    proposals = spark.createDataFrame(made, "episode int, proposal int, tau int, multiplier double, lifetime int")
    rows = [(e, t, d, None, None, None) for e, x in paths.items() for t, d in enumerate(x, 1)] + [(e, tau, None, p, m, life) for e, p, tau, m, life in made]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "episode int, period int, demand double, proposal int, multiplier double, lifetime int")
    for k in range(4):
        spark.createDataFrame(rows[k::4], frame.schema).coalesce(1).write.parquet(str(tmp_path / "s" / f"{k}"))
    spark.createDataFrame([(99, 1000, 1.0, None, None, None)], frame.schema).coalesce(1).write.parquet(str(tmp_path / "s" / "9"))
    # files may come in any order: the delay covers all of the path
    got = streamed(spark, frame, str(tmp_path / "s"), "lifecycle", lambda s: lifecycle.stream_lifecycle(s, "episode", timedelta(minutes=40), **LAW))
    got = sorted(tuple(r) for r in got.where("period <= 30").collect())
    want = sorted(tuple(r) for r in control.lifecycle_events(panel, proposals, **LAW).select("episode", "proposal", "tau", "period", "event").collect())
    assert got == want and {r[4] for r in want} == {"conditioned", "activated", "refuted", "expired"}


def test_lifetime_ends_without_rows(spark, tmp_path, rocks):
    schema = "episode int, period int, demand double, proposal int, multiplier double, lifetime int"
    frame = spark.createDataFrame([(1, 1, 100.0, None, None, None), (1, 1, None, 1, 1.5, 3)], schema)
    frame.coalesce(1).write.parquet(str(tmp_path / "s" / "0"))
    spark.createDataFrame([(2, 50, 1.0, None, None, None)], schema).coalesce(1).write.parquet(str(tmp_path / "s" / "1"))
    got = streamed(spark, frame, str(tmp_path / "s"), "lifetimes", lambda s: lifecycle.stream_lifecycle(s, "episode", timedelta(minutes=2), **LAW))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 1, 1, "conditioned"), (1, 1, 1, 5, "expired")]


def test_totals_by_window(spark, tmp_path):
    frame = spark.createDataFrame([(k % 2, 60 * k, float(k)) for k in range(20)], "k int, s long, x double").withColumn("time", F.timestamp_seconds("s"))
    frame.coalesce(1).write.parquet(str(tmp_path / "s" / "0"))
    frame.limit(1).withColumn("time", F.timestamp_seconds(F.lit(100_000))).coalesce(1).write.parquet(str(tmp_path / "s" / "1"))
    got = streamed(spark, frame, str(tmp_path / "s"), "totals", lambda s: stream_totals(s, "time", "1 hours", "5 minutes", ["k"], "x"))
    want = frame.groupBy(F.window("time", "5 minutes"), "k").agg(F.sum("x").alias("total"), F.count("*").alias("rows"))
    key = lambda df: sorted((r.window.start, r.k, r.total, r.rows) for r in df.collect())
    assert key(got) == key(want)
