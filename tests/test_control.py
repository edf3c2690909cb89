"""Policies, bounds, arrival laws, answers, templates and generators on small cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.functions import answers as N
from quayside.operators import arrivals as A
from quayside.operators import checks as K
from quayside.operators import control as C
from quayside.operators import episodes as G
from quayside.operators import policies, resampling
from quayside.operators import templates as T


def panel(spark, demand, leads=None, pauses=None):
    rows = [(1, "a", k, int(d), (leads or [0] * len(demand))[k - 1], (pauses or [False] * len(demand))[k - 1]) for k, d in enumerate(demand, 1)]
    return spark.createDataFrame(rows, "episode long, arm string, period int, demand long, lead_time int, pause boolean")


def test_closed_loop_equals_the_policy_object(spark):
    rng = random.Random(3)
    demand = [rng.randint(50, 150) for _ in range(40)]
    rows = panel(spark, demand, [rng.choice([0, 1, 2, 3, None]) for _ in demand], [rng.random() < 0.2 for _ in demand])
    z = C.NORMAL.inv_cdf(0.8)
    ours = C.closed_loop(C.base_targets(C.forecast(rows), z, lead=F.lit(2)))
    other = policies.run_policy(rows.withColumn("lead_time", F.col("lead_time").cast("double")), lambda: policies.BaseStock(2, 0.8), 4.0, 0.25)
    key = lambda df: sorted((r.period, r.ordered, r.sold, r.on_hand_end) for r in df.collect())
    assert key(ours) == key(other)


def best_by_search(demand, landing, caps, p, h):
    best = 0.0
    for plan in itertools.product(*[range(c + 1) for c in caps]):
        stock, value = 0, 0.0
        for u in range(1, len(demand) + 1):
            stock += sum(q for q, at in zip(plan, landing, strict=True) if at == u)
            sold = min(stock, demand[u - 1])
            stock -= sold
            value += p * sold - h * stock
        best = max(best, value)
    return best


def test_clairvoyant_is_the_best_plan(spark):
    rng = random.Random(5)
    for _ in range(6):
        demand, caps = [rng.randint(0, 3) for _ in range(5)], [rng.randint(0, 2) for _ in range(5)]
        landing = [rng.choice([None, k, min(5, k + 1), min(5, k + 2)]) for k in range(1, 6)]
        p, h = 3.0, rng.choice([0.0, 1.0, 2.0])
        rows = spark.createDataFrame([(1, k, demand[k - 1], float(sum(c for c, at in zip(caps, landing, strict=True) if at == k)), 0.0) for k in range(1, 6)], "episode long, period int, demand long, room double, fixed double")
        assert abs(C.clairvoyant(rows, p, h).first().value - best_by_search(demand, landing, caps, p, h)) < 1e-9


def test_active_spans(spark):
    rows = panel(spark, [1] * 10)
    spans = spark.createDataFrame([(1, 1, 2, 5), (1, 2, 4, 8), (1, 3, None, 9)], "episode long, proposal int, active_from int, ended_at int")
    got = {r.period: r.proposal for r in C.active_spans(rows, spans).collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: 2, 8: None, 9: None, 10: None}


@pytest.mark.parametrize("sent", [(2.0, 3.0), (2.0, 3.0, 5.0)])
def test_filters_equal_enumeration(sent):
    law = A.Law((0.20, 0.45, 0.25), 0.10, 0.20)
    sums = {float(sum(c)) for k in range(4) for c in itertools.combinations((2.0, 3.0, 5.0), k)}
    for receipts in itertools.product(sums, repeat=len(sent)):
        states, p, shared, q = {(0.0,) * 3: 1.0}, 1.0, A.SharedFilter(3, 2), np.ones(2)
        for s, r in zip(sent, receipts, strict=True):
            states, step = A.filtered(states, law, s, r)
            p *= step
            q = q * shared.step([law, A.with_pause(law, 0.5)], s, r)
        assert abs(p - A.enumerated(law, sent, receipts)) < 1e-12 and abs(q[0] - p) < 1e-12
        assert abs(q[1] - A.enumerated(A.with_pause(law, 0.5), sent, receipts)) < 1e-12


def test_arrival_calibration_and_power(spark):
    null = A.calibration(spark, "shipment_loss", 60, 30, 12, 0.025).first()
    power = A.calibration(spark, "shipment_loss", 20, 30, 12, 0.025, true_law=A.changed_laws("shipment_loss")[1], true_from=13).first()
    assert null.activated <= 6 and power.activated >= 15


def test_draws_do_not_depend_on_partitions(spark):
    seeds = G.fresh_units(spark, 6, 5, 300_000).select("seed", "family")
    one, many = (sorted(map(tuple, (tuple(map(str, r)) for r in G.drawn(seeds.repartition(n), 30).collect()))) for n in (1, 7))
    assert one == many and len(one) == 30
    rows = G.episodes(G.drawn(seeds, 50), 50)
    before = rows.where("period < onset").agg(F.max(F.abs(F.col("demand") - F.col("twin_demand"))), F.count_if(F.col("lead_time").isNull())).first()
    assert tuple(before) == (0.0, 0) and rows.where("onset not between 14 and 22").count() == 0


def test_answers(spark):
    def of(f, *texts):
        return [r.x for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", f(F.col("t")).alias("x")).orderBy("k").collect()]

    assert of(N.orders_of, '```json\n{"action": {"7": 12.9}}\n```', 'x "action" : {"7": 3, "9" : 4} y', "none", None, "") == ['{"7": 12}', '{"7": 3, "9": 4}', None, None, None]
    assert of(N.orders_of, 'prefix {"rationale": "x", "action": {"X1": 12}, "carry', 'nothing parses {"108": 33} here', '{"action": {"X1": "lots"}}', '{not json at all}', '{"action": {"108": 5', '{"rationale": "said \\"hi { no\\" and \\\\ p", "action": {"X1": 2}}') == ['{"X1": 12}', '{"108": 33}', None, None, '{"108": 5}', '{"X1": 2}']
    assert of(N.is_order_answer, 'say {"action": {"7": 1}} now', '{"action": 3}', "", None, '{"action": {"X1": 5', '{"a": "\\$", "action": {}}', 'lead {"rationale": "no"}') == [True] + [False] * 6
    front, extra = '"rationale": "x", "action": {"7": 1}}', '"parameters": {"7": {"L": 1}}}}}'
    assert of(N.objects_of, front, front[:-1], front + "}", extra, '{"a": 1,} then {"parameters": {}}', '{"a": 1} {"b": 2}', "nothing", '{"a": [1, 2,], "b": "\\x41 \\$5",}', '5" pipe: {"action": {"7": 2}}', '"just text"') == [
        *['{"action": {"7": 1}, "rationale": "x"}'] * 3, '{"parameters": {"7": {"L": 1}}}', '{"parameters": {}}', '{"b": 2}', None, '{"a": [1, 2], "b": "A $5"}', '{"action": {"7": 2}}', None
    ]
    assert of(N.literals_of, '{"a": [1, 2.0, null, true], "b": {"c": "x\\n", "d": " "}}', "{", None)[:1] == [["1", "2.0", "2", "true", "x\n"]]
    chosen = of(N.menu_choices, '"L_method": "recent_N"', '{"L": {"L_method": "recent_N"}, "mu_hat": {"mu_hat_method": "recent_N", "N": 4}, "x": {"sigma_hat_method": "explicit", "sigma_hat_value": 2.5}}')
    assert (chosen[0].L_n, chosen[1].L_n, chosen[1].mu_hat_n, chosen[1].sigma_hat_value, chosen[0].mu_hat_method) == (5, 4, 4, 2.5, "default")


def test_answers_are_dealt_over_all_cores(spark):
    from quayside.plans import q_design

    made = q_design.tolerant_objects(spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("task"))
    assert made.distinct().count() > 4


def test_slots_by_big_numbers(spark):
    import hashlib
    import json

    rows = [("t1", 7, "A {what} in {where}", {"what": ["a", "b", "c"], "where": ["x", "y", "z", "w", "v"]}), ("t2", 123456, "{what}", {"what": ["only"]})]
    frame = spark.createDataFrame(rows, "template_id string, seed long, text string, slots map<string,array<string>>")
    got = {r.template_id: r.out for r in frame.select("template_id", T.rendered(F.col("text"), T.drawn_slots(F.col("template_id"), F.col("seed"), F.col("slots"))).alias("out")).collect()}
    for key, seed, text, slots in rows:
        chosen = {n: v[int.from_bytes(hashlib.sha256(json.dumps([key, seed, n], separators=(",", ":")).encode()).digest(), "big") % len(v)] for n, v in slots.items()}
        assert got[key] == text.format(**chosen)


def test_hidden_fields_are_found(spark):
    frame = spark.createDataFrame([], "a int, b struct<incident:int,c:array<struct<truth:int>>>, d map<string,struct<incident:int>>")
    assert K.reachable_fields(frame.schema, ["incident", "truth"]) == ["b.incident", "b.c.truth", "d.incident"]
    with pytest.raises(K.Violation):
        K.require_hidden(frame, ["truth"], "observations")


def test_ratio_bootstrap(spark, monkeypatch):
    monkeypatch.setattr(resampling, "SHARD", 9)
    rng = np.random.default_rng(2)
    a, b = rng.gamma(2, 2, 60), np.where(np.arange(60) < 6, 0, rng.gamma(3, 1, 60))
    frame = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "c long, a double, b double")
    got = resampling.ratio_interval(frame, "a", "b", "c").first()
    pick = np.random.default_rng(9).integers(0, 60, (10_000, 60))
    low, high = np.quantile(a[pick].sum(1) / b[pick].sum(1), [0.025, 0.975])
    assert got.clusters == 54 and abs(got.ratio - a.sum() / b.sum()) < 1e-9 and abs(got.low - low) < 0.05 and abs(got.high - high) < 0.08
    assert resampling.ratio_interval(frame, "a", "b", "c", draws=50, least=55).first().ratio is None


def test_frontier_membership(spark):
    rows = [(u, arm, r + u % 3, c) for u in range(30) for arm, r, c in (("x", 10.0, 1.0), ("y", 20.0, 2.0), ("z", 5.0, 3.0))]
    units = spark.createDataFrame(rows, "u long, arm string, reward double, cost double")
    ends = {arm: resampling.frontier_membership(units, ["x", "y", "z"], arm, "u", 200).first() for arm in "xyz"}
    assert [(ends[a].low, ends[a].high) for a in "xyz"] == [(1.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
