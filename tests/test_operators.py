"""Small cases with known results, sources and sinks, generators, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from quayside.functions import text as X
from quayside.operators import checks, detectors, evaluation, generate, inference, panel, supply
from quayside.sources import instances, sinks
from quayside.streaming.detectors import stream_cusum


def rows(df):
    return [tuple(r) for r in df.collect()]


def path(spark, values, **constant):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values, 1)], "episode long, period int, demand double")
    return df.withColumns({k: F.lit(v) for k, v in constant.items()})


def test_streak_and_recovery(spark):
    sold = path(spark, [100, 90, 80, 100, 99, 80, 100])
    # runs of lost sales are (2, 3) and (5, 6)
    assert rows(panel.max_streak(sold, F.col("demand") < 100, ["episode"])) == [(1, 2)]
    fill = path(spark, [100, 70, 95, 94, 96, 97, 98])
    assert rows(panel.time_to_recovery(fill, F.col("demand") / 100, F.lit(2), ["episode"])) == [(1, 3)]
    assert rows(panel.time_to_recovery(path(spark, [80] * 7), F.col("demand") / 100, F.lit(2), ["episode"])) == [(1, None)]


def test_cvar_pareto_area_holm(spark):
    assert rows(evaluation.cvar(spark.createDataFrame([(1, v) for v in (1.0, 2.0, 3.0, 100.0)], "g int, v double"), "v", ["g"])) == [(1, 1.0, 1)]
    pts = lambda *p: spark.createDataFrame([(str(i), float(b), float(r)) for i, (b, r) in enumerate(p)], "name string, budget double, reward double")
    assert [r[1:] for r in rows(inference.pareto(pts((1, 10), (1, 9), (3, 12)), "budget", "reward", "name"))] == [(1.0, 10.0), (3.0, 12.0)]
    assert rows(inference.frontier_area(pts((1, 10), (2, 14)), "budget", "reward", "name")) == [(11.0,)]
    p = spark.createDataFrame([("b", 0.04), ("a", 0.01), ("c", 0.03)], "name string, p double")
    assert {r.name: round(r.adjusted, 9) for r in inference.holm(p, "p", "name").collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}


@pytest.mark.parametrize("values, expected", [([1.0, 1.0], 0.5), ([0.0, 0.0], 1.0)])
def test_sign_flip(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "d double")
    assert inference.sign_flip_exact(df, "d").first().p_value == expected


@pytest.mark.parametrize("detector, rule", [(detectors.suppressed_cusum, "cusum"), (detectors.suppressed_page_hinkley, "page_hinkley")])
def test_detectors_see_the_period_before(spark, detector, rule):
    """The value of period t - 1 enters at t; only a permitted firing restarts the sums."""
    assert rows(detector(path(spark, [100] * 9 + [50] * 41), "demand", 100.0, 12.5, 100.0, 50, 2)) == [(1, 13, f"{rule}_down", 112.5)]
    assert rows(detector(path(spark, [100] * 9 + [150] * 41), "demand", 100.0, 12.5, 100.0, 50, 2)) == [(1, 13, f"{rule}_up", 112.5)]
    twice = path(spark, [100] * 9 + [150] * 11)
    assert rows(detector(twice, "demand", 100.0, 12.5, 100.0, 5, 2)) == [(1, 13, f"{rule}_up", 112.5), (1, 19, f"{rule}_up", 225.0)]
    assert detectors.with_restarts(twice, "demand", rule, 100.0, 12.5, 100.0, 5, 2).first().suppressed == 3


def test_paths_fire_where_restarts_first_do(spark):
    for values, side in (([100] * 9 + [50] * 41, "down"), ([100] * 9 + [150] * 41, "up")):
        data = path(spark, values)
        c, p = detectors.cusum_path(data, "demand", F.lit(100.0), F.lit(12.5)), detectors.page_hinkley_path(data, "demand", F.lit(100.0), F.lit(12.5))
        assert rows(detectors.first_fire(c, F.lit(100.0))) == [(1, 13, f"cusum_{side}", 112.5)]
        assert rows(detectors.first_fire(p, F.lit(100.0), "page_hinkley")) == [(1, 13, f"page_hinkley_{side}", 112.5)]


def test_recovery_and_excess(spark):
    from quayside.operators import pilot

    sold, stock = [100, 70, 95, 94, 96, 97, 98], [10, 12, 30, 40, 50, 60, 70]
    data = spark.createDataFrame([(1, "a", k, 100, s, h) for k, (s, h) in enumerate(zip(sold, stock, strict=True), 1)], "episode long, arm string, period int, demand long, sold long, on_hand_end long")
    got = pilot.recoveries(data, F.lit(2)).first()
    assert (got.recovery, got.excess - 10) == (3, 50.0)
    assert pilot.recoveries(data.withColumn("sold", F.lit(80)), F.lit(2)).first().recovery is None


def test_quantiles_by_ranges(spark):
    import numpy as np

    from quayside.operators import panel

    rng = np.random.default_rng(2)
    values = {g: rng.integers(0, 30, n).astype(float) for g, n in (("a", 1), ("b", 40), ("c", 333))}
    frame = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("b", None)], "g string, v double").repartition(7)
    got = {r.g: r for r in panel.linear_quantiles(frame, "v", {"p5": 0.05, "p50": 0.5, "p95": 0.95}, ["g"]).collect()}
    for g, vs in values.items():
        assert np.allclose([got[g].p5, got[g].p50, got[g].p95], np.quantile(vs, [0.05, 0.5, 0.95]))
    near = {r.g: r for r in panel.nearest_ranks(frame, "v", {"p5": 0.05, "p50": 0.5, "p95": 0.95}, ["g"]).collect()}
    for g, vs in values.items():
        assert [near[g].p5, near[g].p50, near[g].p95] == [sorted(vs)[max(0, int(np.ceil(q * len(vs) - 1e-9)) - 1)] for q in (0.05, 0.5, 0.95)]


def test_fifo(spark):
    def ages(orders, receipts):
        o = spark.createDataFrame([(1, p, q) for p, q in orders], "episode long, period int, ordered long")
        r = spark.createDataFrame([(1, p, q) for p, q in receipts], "episode long, period int, received long")
        return sorted((x.age, x.units) for x in supply.fifo_ages(o, r).collect())

    assert ages([(1, 10), (2, 5)], [(3, 12)]) == [(1, 2), (2, 10)]
    assert ages([(1, 20)], [(3, 8), (5, 12)]) == [(2, 8), (4, 12)]


def test_clamp(spark):
    q = spark.createDataFrame([(2.9,), (-3.0,), (99.0,), (float("nan"),), (None,)], "q double")
    assert [r[0] for r in rows(q.select(supply.clamp_order(F.col("q"), F.lit(50.0))))] == [2.0, 0.0, 50.0, None, None]


def test_checks(spark):
    df = spark.createDataFrame([("u", "t"), ("u", "t"), ("v", "t")], "unit string, arm string")
    with pytest.raises(checks.Violation):
        checks.require_empty(checks.repeated(df, ["unit", "arm"]), "one row per unit and arm")
    checks.require_empty(checks.repeated(df, ["unit", "arm"]).where("n > 2"), "none thrice")


def test_json_payload(spark):
    texts = ['{"a": 1}', 'x ```json\n{"b": 2}\n``` y', 'so {"a": "}"} and', '{"a": 1, "a": 2}', '{"a": NaN}', "none", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[1] for r in rows(df.select("i", X.json_payload(F.col("t"))).orderBy("i"))] == ['{"a": 1}', '{"b": 2}', '{"a": "}"}', None, None, None, None]


def test_generator_does_not_depend_on_partitioning(spark):
    seeds = generate.seeds(spark, 2, 5)
    a, b = (sorted(rows(generate.baseline(seeds.repartition(n), "negbin", 20))) for n in (1, 4))
    assert a == b and len(a) == 200


def test_instances_and_sinks(spark, tmp_path):
    folder = tmp_path / "in" / "lead_time_4" / "x1"
    folder.mkdir(parents=True)
    (folder / "test.csv").write_text('exact_dates_x1,demand_x1,description_x1,lead_time_x1,profit_x1,holding_cost_x1\nP1,10,"a, b",4,19,1\nP2,12,c,inf,19,1\nP3,0,d,,19,1\n')
    (folder / "supply.csv").write_text("period,lead_time,pause_active\n1,3,yes\n2,inf,0\n3,2,1\n")
    (folder / "train.csv").write_text("exact_dates_x1,demand_x1\nT1,7\n")
    (folder / "incident.json").write_text(json.dumps({"family": "shipment_loss", "onset_period": 2, "supply_effect": {"kind": "loss", "start_period": 2, "length": 1}}))
    root = str(tmp_path / "in")
    got = [(r.period, r.demand, r.lead_time, r.pause, r.promised) for r in instances.read_periods(spark, root).orderBy("period").collect()]
    assert got == [(1, 10.0, 3.0, True, 4), (2, 12.0, float("inf"), False, 4), (3, 0.0, 2.0, True, 4)]
    assert instances.incomplete_sidecars(spark, root).count() == 0
    assert instances.read_train(spark, root).first().demand == 7.0
    c = instances.instance_catalogue(spark, root).first()
    assert (c.periods, c.profit, c.lost, c.demand, c.constant_lead) == (3, 19.0, 1, 22.0, False)
    assert instances.read_incidents(spark, root).first().supply_effect.length == 1

    df = spark.createDataFrame([(2, None, 0.5), (1, "a", 1.0)], "k int, v string, x double")
    sinks.write_json_lines(df, str(tmp_path / "j"), compress=True)
    back = instances.read_jsonl(spark, str(tmp_path / "j"), df.schema)
    assert sorted(rows(back)) == [(1, "a", 1.0, None), (2, None, 0.5, None)]
    assert [r[0] for r in rows(sinks.ledger_lines(df, ["k"], {"x": 3}))] == ["1,a,1.000", "2,,0.500"]
    store = str(tmp_path / "store")
    for _ in range(2):
        sinks.put(store, spark.createDataFrame([("k", "v")], "key string, value string"))
    assert rows(sinks.get(spark, store)) == [("k", "v")]
    assert sinks.rating_sheet(spark.createDataFrame([("s",)], "sample_id string"), ["a", "b"], ["x", "y", "z"]).count() == 6


def test_streaming_equals_batch(spark, tmp_path):
    data = path(spark, [100] * 9 + [150] * 11)
    for k, (a, b) in enumerate(((1, 7), (8, 14), (15, 20))):
        data.where(F.col("period").between(a, b)).coalesce(1).write.parquet(str(tmp_path / "s" / f"{k}"))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "s"))
    args = (100.0, 12.5, 100.0, 5, 2)
    q = stream_cusum(stream, "episode", "demand", *args).writeStream.format("memory").queryName("fired").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = rows(detectors.suppressed_cusum(data, "demand", *args))
    assert sorted(rows(spark.table("fired"))) == sorted(batch) and len(batch) == 2


def test_arrival_filter_equals_enumeration():
    import itertools

    from quayside.operators.laws import ArrivalFilter

    delays, pause, dispatches = (0.20, 0.45, 0.25), 0.20, (2.0, 3.0, 5.0)
    outcomes = [*enumerate(delays), (None, 1 - sum(delays))]
    brute = {}
    for choice in itertools.product(outcomes, (0, 1), repeat=3):
        moving, weight, seen = [], 1.0, []
        for (delay, p), paused, q in zip(choice[::2], choice[1::2], dispatches, strict=True):
            weight *= p * (pause if paused else 1 - pause)
            moving += [] if delay is None else [(q, delay)]
            seen.append(sum(x for x, left in moving if left == 0))
            moving = [(x, left if paused else left - 1) for x, left in moving if left > 0]
        brute[tuple(seen)] = brute.get(tuple(seen), 0.0) + weight
    assert abs(sum(brute.values()) - 1) < 1e-12
    for receipts, expected in brute.items():
        law, product = ArrivalFilter(delays, pause), 1.0
        for q, r in zip(dispatches, receipts, strict=True):
            product *= law.step(q, r)
        assert abs(product - expected) < 1e-12


def test_demand_laws_sum_to_one():
    import numpy as np

    from quayside.operators import laws

    v = np.arange(0, 3000)
    normal = lambda x: laws.rounded_normal_log_mass(x, 20.0, 9.0)
    for logs in (normal(v), laws.negative_binomial_log_mass(v, 20.0, 9.0), laws.shocked_log_mass(v, 0.6, normal), laws.shocked_log_mass(v, 1.7, normal)):
        assert abs(np.exp(logs).sum() - 1) < 1e-9
    assert np.isneginf(normal([1.5, -1.0])).all()
    assert abs(laws.log_normal_cdf(np.array([-20.0]))[0] + 203.917155) < 1e-4


def test_exact_limits():
    from quayside.operators.laws import exact_limits

    def exact_limit(k, n, level, upper):
        return exact_limits([k], [n], level, upper)[0]

    assert abs(exact_limit(0, 20, 0.95, True) - (1 - 0.05 ** (1 / 20))) < 1e-9
    assert abs(exact_limit(20, 20, 0.95, False) - 0.05 ** (1 / 20)) < 1e-9
    assert 0.1 < exact_limit(150_000, 1_000_000, 0.975, True) - 0.05 < 0.1008
    assert exact_limit(0, 5, 0.95, False) == 0.0 and exact_limit(5, 5, 0.95, True) == 1.0


def test_policy_object_equals_fold(spark):
    from quayside.operators import policies

    values = [7, 9, 4, 12, 30, 2, 0, 8, 8, 15, 21, 3]
    panel_ = path(spark, values, lead_time=2.0, pause=False).withColumn("demand", F.col("demand").cast("long"))
    fold = policies.capped_base_stock(panel_, 2, 0.8, 0.95).first()
    run = policies.run_policy(panel_, lambda: policies.BaseStock(2, 0.8), 4.0, 1.0).toPandas()
    assert (fold.ordered, fold.sold, fold.stock) == (run.ordered.sum(), run.sold.sum(), run.on_hand_end.iloc[-1])


def test_reports(spark, tmp_path):
    from quayside.sources import reports

    df = spark.createDataFrame([("a", 1.0, 2.0), ("b|c", 2.0, None)], "arm string, budget double, reward double")
    text = reports.markdown(df, ["arm"], "records.jsonl")
    assert text.count("\n") == 4 and reports.untraced_rows(text) == [] and reports.untraced_rows("| a | |\n") == ["| a | |"]
    svg = reports.frontier_svg(df.na.fill(0.0), "arm", "budget", "reward", "a < b")
    assert svg.count("<circle") == 2 and "a &lt; b" in svg
    assert reports.digest(df).first() == reports.digest(df.repartition(3)).first()
    reports.write(str(tmp_path / "r"), {"t.md": text, "manifest.json": reports.manifest({"t.md": text}, df)})
    with pytest.raises(FileExistsError):
        reports.write(str(tmp_path / "r"), {"t.md": text})


def test_written_instances(spark, tmp_path):
    df = spark.createDataFrame([("i1", 1, 5.0, 2, 19.0, 1.0), ("i1", 2, 6.0, None, 19.0, 1.0)], "instance string, period int, demand double, lead_time int, profit double, holding double")
    sinks.write_instances(df, str(tmp_path / "w"), "x")
    back = spark.read.csv(str(tmp_path / "w"), header=True)
    assert sorted(tuple(r) for r in back.select("exact_dates_x", "demand_x", "lead_time_x").collect()) == [("Period_1", "5", "2"), ("Period_2", "6", "inf")]


@pytest.mark.parametrize("kind", ["iid", "negbin"])
def test_null_calibration_keeps_alpha(spark, kind):
    from quayside.operators.calibration import null_calibration

    row = null_calibration(spark, kind, 300, 40, 10, 0.05).first()
    assert row.replications == 300 and row.low < 0.05 and row.rate <= 0.06


def test_leakage_rules_and_literals(spark):
    from quayside.functions import text

    rows = [(1, "Demand-Level up 20 % and 1.5x, HALF of it; period 7, for two weeks"), (2, "Über-Nord (SKU 7) hits übernord; sku 77"), (3, "nothing")]
    found = text.leakage(spark.createDataFrame(rows, "k long, t string"), "k", "t", ["SKU 7", "SKU 77", "über-nord"])
    got = sorted(map(tuple, found.collect()))
    assert [(k, r, m) for k, r, m in got if k == 1] == sorted([(1, "latent_family", "Demand-Level"), (1, "exact_multiplier", "20 %"), (1, "exact_multiplier", "1.5x"), (1, "exact_multiplier", "HALF"), (1, "exact_onset", "period 7"), (1, "exact_duration", "for two weeks")])
    assert [(k, r, m) for k, r, m in got if k > 1] == sorted([(2, "forbidden_literal", "Über-Nord"), (2, "forbidden_literal", "SKU 7"), (2, "forbidden_literal", "sku 77")])
    with pytest.raises(ValueError):
        text.any_of(["a", " "])
