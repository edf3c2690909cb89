"""Readers, writers and extension points on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.plans import extension
from quayside.sources import instances, sinks


def test_pairs_train_and_profile(spark, tmp_path):
    rows = [("a", k, 10 + k, None if k == 2 else 1, 4, 1, 10, 1) for k in range(1, 4)]
    periods = spark.createDataFrame(rows, "instance string, period int, demand long, lead_time int, profit int, holding int, twin_demand long, twin_lead_time int")
    sinks.write_pairs(periods, str(tmp_path / "out"), "7")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["instance=a", "instance=a__twin"]
    shocked = next((tmp_path / "out" / "instance=a").glob("*.csv")).read_text().splitlines()
    twin = next((tmp_path / "out" / "instance=a__twin").glob("*.csv")).read_text().splitlines()
    assert shocked == ["exact_dates_7,demand_7,lead_time_7,profit_7,holding_cost_7", "Period_1,11,1,4,1", "Period_2,12,inf,4,1", "Period_3,13,1,4,1"] and twin[1:] == [f"Period_{k},10,1,4,1" for k in (1, 2, 3)]
    sinks.write_train(spark.createDataFrame([("a", 1, 5), ("a", 2, 6)], "instance string, period int, demand long"), str(tmp_path / "train"), "7")
    sinks.write_pauses(spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, False)], "instance string, period int, pause boolean"), str(tmp_path / "pause"))
    assert [p.name for p in (tmp_path / "pause").iterdir() if p.is_dir()] == ["instance=a"]
    folder = tmp_path / "tree" / "lead_time_4" / "x"
    folder.mkdir(parents=True)
    (folder / "test.csv").write_text("\n".join(shocked) + "\n")
    (folder / "train.csv").write_text("exact_dates_7,demand_7\nPeriod_1,5\n")
    got = instances.instance_profile(spark, str(tmp_path / "tree")).first()
    assert (got.periods, got.train_rows, got.lost, got.lead_times, got.constant_profit, len(got.test_sha256)) == (3, 1, 1, [1.0, float("inf")], True, 64)
    (folder / "supply.csv").write_text("period,pause_active\n")
    assert instances.empty_files(spark, str(tmp_path / "tree"), "supply.csv").count() == 1 and instances.empty_files(spark, str(tmp_path / "tree"), "test.csv").count() == 0


def test_bad_lines_versions_and_keys(spark, tmp_path):
    schema = T.StructType().add("episode", "string").add("schema_version", "integer")
    (tmp_path / "x.jsonl").write_text('{"episode": "a", "schema_version": 1}\n\n{"episode": oops\n{"episode": "a", "schema_version": 2}\n')
    assert [(r.line, r.text) for r in instances.bad_lines(spark, str(tmp_path / "x.jsonl"), schema).collect()] == [(3, '{"episode": oops')]
    good = spark.createDataFrame([("a", 1, "up")], "episode string, schema_version int, direction string")
    assert instances.versioned(good, 1, {"direction": ["up"]}).count() == 1 and instances.by_key(good, "episode").count() == 1
    for bad in (instances.versioned(good, 2), instances.versioned(good, 1, {"direction": ["down"]}), instances.by_key(good.union(good), "episode")):
        with pytest.raises(Exception, match="record|repeated"):
            bad.collect()


def test_runs(spark, tmp_path):
    parts = {"records": spark.createDataFrame([(1, "a")], "episode long, arm string")}
    text = json.loads(sinks.write_run(parts, str(tmp_path / "run"), {"complete": True}))
    assert text["parts"]["records"]["rows"] == 1 and spark.read.json(str(tmp_path / "run" / "records")).count() == 1
    folder = tmp_path / "old"
    folder.mkdir()
    (folder / "records.jsonl.gz").write_bytes(sinks.gzip_bytes(['{"episode": 1}']))
    (folder / "manifest.json").write_text('{"complete": false}')
    with pytest.raises(instances.BadInput):
        instances.read_run(spark, str(folder))
    with pytest.raises(instances.BadInput, match="ledger"):
        instances.read_run(spark, str(folder), partial=True)
    (folder / "ledger.csv").write_text("call_id,usd\nc,0.5\n")
    assert {k: v.count() for k, v in instances.read_run(spark, str(folder), partial=True).items()} == {"records": 1, "ledger": 1}
    assert sinks.gzip_bytes(["a"]) == sinks.gzip_bytes(["a"]) and gzip.decompress(sinks.gzip_bytes(["a", "b"])) == b"a\nb\n"


def test_nested_results_scores_and_incidents(spark):
    nested = spark.createDataFrame([("e", [(1, 2.0), (2, 3.0)]), ("f", [])], "episode string, records array<struct<period:int,sold:double>>")
    assert sorted(map(tuple, sinks.flat_results(nested).collect()), key=str) == [("e", 1, 2.0), ("e", 2, 3.0), ("f", None, None)]
    scores = spark.createDataFrame([("a", 0.5, 0.9), ("a", 0.7, 0.8), ("b", 0.3, 1.0)], "batch string, normalized_reward double, service_level double")
    got = sinks.batch_scores(scores).first()
    assert (got.total_instances, round(got.overall_score, 6), got.median, got["min"], got["max"], got.batches["a"].num_instances) == (3, 0.5, 0.5, 0.3, 0.7, 2)
    truth = spark.createDataFrame([("i", True, 30, "lead_time_shift", False, None, 15, 7, "lead_time_shift", 30, 4)], "instance string, conditional_independence boolean, lasts int, shock_family string, held_out boolean, magnitude double, onset int, seed long, effect string, effect_length int, disrupted_lead int")
    incident = json.loads(sinks.incident_lines(truth).first().incident)
    assert incident["supply_effect"] == {"disrupted_lead_time": 4, "kind": "lead_time_shift", "length": 30, "start_period": 15} and incident["magnitude"] == 1.0 and list(incident) == sorted(incident)


def test_own_triggers_builders_and_statistics(spark):
    panel = spark.createDataFrame([(1, k, v) for k, v in enumerate([1, 5, 5, 0, 9, 9], 1)], "episode long, period int, x int")
    init = F.struct(F.lit(0).alias("sum"))
    fired = extension.trigger(panel, ["x"], init, lambda s, r: F.struct((s["sum"] + r["x"]).alias("sum")), lambda s, r: s["sum"] > 9)
    assert [r.period for r in fired.where("fired").orderBy("period").collect()] == [3, 6]
    extension.register("double", lambda frame: frame.withColumn("x", 2 * F.col("x")))
    assert extension.build("double", panel).agg(F.sum("x")).first()[0] == 58
    with pytest.raises(ValueError):
        extension.register("double", None)
    points = extension.frontier_points(panel.withColumn("arm", F.lit("a")), F.max("x"), F.avg("x")).first()
    assert (points.budget, round(points.reward, 3)) == (9, 4.833)
    got = extension.bootstrap_statistic(panel, {"a": F.sum("x"), "n": F.count("x")}, F.col("a") / F.col("n"), "period", 200).first()
    assert got.low < 29 / 6 < got.high
