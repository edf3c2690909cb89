"""Queries over arms in closed loop, each beside its SQL: one recursion over periods for all of them."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from quayside.operators import control as C
from quayside.operators import detectors as D
from quayside.plans.q_evaluation import rounded
from quayside.plans.q_panel import CU, DL, MU, SD
from quayside.plans.runtime import table
from quayside.plans.views import DP, SP, demand_panel, supply_panel

QUERIES, SQL = {}, {}
Z8 = NormalDist().inv_cdf(0.8)
UP = (1.25, 2, 0.5)
LEAD = 2


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


MOMENTS = "COUNT(demand) OVER {w} AS n, SUM(demand) OVER {w} AS s, SUM(demand * demand) OVER {w} AS q"
STATS = "CASE WHEN {n} > 0 THEN {s} / {n} END AS {mean}, CASE WHEN {n} > 1 THEN SQRT(CAST({n} * {q} - {s} * {s} AS DOUBLE) / ({n} * ({n} - 1))) ELSE 0.0 END AS {sd}"
FK = f"fk AS (SELECT episode, period, demand, n, {STATS.format(n='n', s='s', q='q', mean='mean', sd='sd')} FROM (SELECT episode, period, demand, {MOMENTS.format(w='w')} FROM dp WINDOW w AS (PARTITION BY episode ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"
GOAL = f"{{m}} * (1 + {{lead}}) * mean + {Z8} * SQRT(1 + {{lead}}) * sd AS goal, mean + {C.CAP_Z} * sd AS cap, CAST({{gamma}} AS DOUBLE) AS gamma, NULL::DOUBLE AS quantity"
BY_GOAL = "COALESCE(quantity, GREATEST(0, LEAST(CEIL(goal - stock - gamma * (c0 + c1 + c2 + c3)), CEIL(cap))), 0)"


def loop(order: str = BY_GOAL) -> str:
    """tg (episode, arm, period, goal, cap, gamma, quantity) in closed loop with the supply panel."""
    return f"""lp AS (SELECT episode, arm, 0 AS period, 0.0::DOUBLE AS stock, 0.0::DOUBLE AS c0, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2, 0.0::DOUBLE AS c3, 0.0::DOUBLE AS o, 0.0::DOUBLE AS a, 0.0::DOUBLE AS sold, 0.0::DOUBLE AS lost, 0::BIGINT AS demand FROM (SELECT DISTINCT episode, arm FROM tg)
 UNION ALL SELECT episode, arm, period, stock + a - LEAST(demand, stock + a), CASE WHEN pause THEN 0 ELSE d1 END, CASE WHEN pause THEN d1 ELSE d2 END, CASE WHEN pause THEN d2 ELSE d3 END, CASE WHEN pause THEN d3 ELSE 0 END, o, a, LEAST(demand, stock + a), demand - LEAST(demand, stock + a), demand FROM (
 SELECT *, c0 + CASE WHEN lead_time = 0 THEN o ELSE 0 END AS a, c1 + CASE WHEN lead_time = 1 THEN o ELSE 0 END AS d1, c2 + CASE WHEN lead_time = 2 THEN o ELSE 0 END AS d2, c3 + CASE WHEN lead_time = 3 THEN o ELSE 0 END AS d3 FROM (
 SELECT *, {order} AS o FROM (SELECT x.episode, tg.arm, x.period, x.demand, x.lead_time, x.pause, tg.goal, tg.cap, tg.gamma, tg.quantity, lp.stock, lp.c0, lp.c1, lp.c2, lp.c3, lp.o AS po, lp.a AS pa, lp.demand AS pd FROM lp JOIN sp x ON x.episode = lp.episode AND x.period = lp.period + 1 JOIN tg ON tg.episode = lp.episode AND tg.arm = lp.arm AND tg.period = lp.period + 1))))"""


TOTALS = " SELECT episode, arm, ROUND(SUM(o), 4) AS ordered, ROUND(SUM(sold), 4) AS sold, ROUND(SUM(lost), 4) AS lost, ROUND(SUM(4 * sold - 0.25 * stock), 4) AS reward FROM lp WHERE period > 0 GROUP BY 1, 2"


def run(targets, order=C.goal_order):
    """Totals of arms whose targets stand beside the supply panel."""
    return rounded(C.arm_totals(C.closed_loop(targets, order), 4.0, 0.25))


def forecasts(spark, sf, recent=None):
    return C.forecast(supply_panel(spark, sf), recent=recent).withColumn("quantity", F.lit(None).cast("double"))


@query(f"WITH RECURSIVE {DP}, {SP}, {FK}, tg AS (SELECT episode, 'arm1' AS arm, period, {GOAL.format(m=1, lead=LEAD, gamma=1)} FROM fk UNION ALL SELECT episode, 'up' AS arm, period, {GOAL.format(m=UP[0], lead=UP[1], gamma=UP[2])} FROM fk), {loop()}" + TOTALS)
def grid_point_policy(spark, sf):
    """The base stock and a compiled grid point, with its pipeline credit."""
    f = forecasts(spark, sf)
    base = C.base_targets(f, Z8, lead=F.lit(LEAD)).withColumn("arm", F.lit("arm1"))
    return run(base.unionByName(C.base_targets(f, Z8, m=F.lit(UP[0]), lead=F.lit(UP[1]), gamma=F.lit(UP[2])).withColumn("arm", F.lit("up"))))


HM = (MU, MU * 1.5), (SD, SD * 1.5), (0.95, 0.9)
HP = f"""hp AS (SELECT episode, 1 AS period, 0.0::DOUBLE AS p FROM dp WHERE period = 1 UNION ALL SELECT episode, period + 1, CASE WHEN a + b > 0 THEN b / (a + b) ELSE ahead END FROM (SELECT *, (1 - ahead) * EXP(-POW((demand - {HM[0][0]}) / {HM[1][0]}, 2) / 2) / {HM[1][0]} AS a, ahead * EXP(-POW((demand - {HM[0][1]}) / {HM[1][1]}, 2) / 2) / {HM[1][1]} AS b
 FROM (SELECT d.episode, d.period, d.demand, (1 - hp.p) * {1 - HM[2][0]} + hp.p * {HM[2][1]} AS ahead FROM hp JOIN dp d ON d.episode = hp.episode AND d.period = hp.period)))"""
RK = f"rk AS (SELECT episode, period, {STATS.format(n='n', s='s', q='q', mean='rmean', sd='rsd')} FROM (SELECT episode, period, {MOMENTS.format(w='w')} FROM dp WINDOW w AS (PARTITION BY episode ORDER BY period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)))"


@query(f"WITH RECURSIVE {DP}, {SP}, {FK}, {RK}, {HP}, tg AS (SELECT episode, 'arm2' AS arm, period, {1 + LEAD} * ((1 - p) * mean + p * COALESCE(rmean, mean)) + {Z8} * {math.sqrt(1 + LEAD)} * ((1 - p) * sd + p * rsd) AS goal, mean + {C.CAP_Z} * sd AS cap, 1.0::DOUBLE AS gamma, NULL::DOUBLE AS quantity FROM fk JOIN rk USING (episode, period) JOIN hp USING (episode, period)), {loop()} SELECT arm, COUNT(*) AS episodes, ROUND(SUM(sold) / SUM(sold + lost), 3) AS fill FROM lp WHERE period > 0 GROUP BY 1")
def telemetry_policy(spark, sf):
    """Base stock on estimates blended by a filtered regime."""
    panel = forecasts(spark, sf, recent=6)
    p = C.regime_path(panel, "demand", *HM)
    path = C.closed_loop(C.telemetry_targets(panel.join(p, ["episode", "period"]), Z8, LEAD).withColumn("arm", F.lit("arm2")))
    return rounded(path.groupBy("arm").agg(F.count("*").alias("episodes"), (F.sum("sold") / F.sum(F.col("sold") + F.col("lost"))).alias("fill")), 3)


PICK = lambda a: GOAL.format(m=f"CASE WHEN {a} THEN {UP[0]} ELSE 1 END", lead=f"CASE WHEN {a} THEN {UP[1]} ELSE {LEAD} END", gamma=f"CASE WHEN {a} THEN {UP[2]} ELSE 1 END")


def up_where(rows, active):
    return C.switched(rows, active, Z8, LEAD, F.lit(UP[0]), F.lit(UP[1]), F.lit(UP[2]))


@query(CU + f", {SP}, {FK}, ff AS (SELECT episode, MIN(period) AS fired_at FROM cu WHERE GREATEST(up, down) > {4 * SD} GROUP BY 1), tg AS (SELECT fk.episode, 'detector' AS arm, period, {PICK('COALESCE(period >= fired_at, false)')} FROM fk LEFT JOIN ff ON ff.episode = fk.episode), {loop()}" + TOTALS)
def detector_switch_policy(spark, sf):
    """Compiled for good at the detector's first firing."""
    fired = D.first_fire(D.cusum_path(demand_panel(spark, sf), "demand", F.lit(MU), F.lit(SD / 2)), F.lit(4 * SD)).select("episode", F.col("period").alias("at"))
    return run(up_where(forecasts(spark, sf).join(fired, "episode", "left"), F.col("period") >= F.col("at")).withColumn("arm", F.lit("detector")))


AT = "ae AS (SELECT DISTINCT user_id % 50 AS episode, CAST(1 + event_id % 83 AS INT) AS period FROM events WHERE event_type = 'error' AND event_id % 5 <> 4)"


@query(f"WITH RECURSIVE {DP}, {SP}, {FK}, {AT}, tg AS (SELECT fk.episode, 'keyword' AS arm, fk.period, {PICK('MAX(CASE WHEN ae.episode IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY fk.episode ORDER BY fk.period) = 1')} FROM fk LEFT JOIN ae ON ae.episode = fk.episode AND ae.period = fk.period), {loop()}" + TOTALS)
def alert_switch_policy(spark, sf):
    """Compiled for good at the first alert that can be read."""
    seen = table(spark, sf, "events").where("event_type = 'error' and event_id % 5 <> 4").select((F.col("user_id") % 50).alias("episode"), (1 + F.col("event_id") % 83).cast("int").alias("period")).distinct().withColumn("alert", F.lit(True))
    rows = forecasts(spark, sf).join(seen, ["episode", "period"], "left")
    return run(up_where(rows, C.latched(rows, F.coalesce("alert", F.lit(False)))).withColumn("arm", F.lit("keyword")))


@query(f"WITH RECURSIVE {DP}, {SP}, {FK}, tg AS (SELECT episode, 'oracle' AS arm, period, {PICK('period BETWEEN 20 + episode % 5 AND 40')} FROM fk), {loop()}" + TOTALS)
def truth_window_policy(spark, sf):
    """Compiled in the true window of the shock, and at set periods switched and stood down."""
    return run(up_where(forecasts(spark, sf), F.col("period").between(20 + F.col("episode") % 5, 40)).withColumn("arm", F.lit("oracle")))


PL = """pl AS (SELECT episode, 1 AS proposal, 15 + episode % 4 AS tau, CASE WHEN episode % 3 = 0 THEN 0.75 ELSE 1.25 END AS multiplier, CASE WHEN episode % 3 = 0 THEN 'demand_down' ELSE 'demand_up' END AS direction, 30 AS lifetime FROM dp WHERE period = 1
 UNION ALL SELECT episode, 2, 45, 1.25, 'demand_up', 20 FROM dp WHERE period = 1 AND episode % 2 = 0)"""


def plans(spark, sf):
    first = demand_panel(spark, sf).where("period = 1")
    down = F.col("episode") % 3 == 0
    one = first.select("episode", F.lit(1).alias("proposal"), (15 + F.col("episode") % 4).cast("int").alias("tau"), F.when(down, 0.75).otherwise(1.25).alias("multiplier"), F.when(down, "demand_down").otherwise("demand_up").alias("direction"), F.lit(30).alias("lifetime"))
    two = first.where("episode % 2 = 0").select("episode", F.lit(2).alias("proposal"), F.lit(45).alias("tau"), F.lit(1.25).alias("multiplier"), F.lit("demand_up").alias("direction"), F.lit(20).alias("lifetime"))
    return one.unionByName(two)


VP = f"""vs AS (SELECT pl.episode, proposal, tau, lifetime, d.period, SUM(((multiplier - 1) * {MU} * (demand - {MU}) - POW((multiplier - 1) * {MU}, 2) / 2) / {SD * SD}) OVER (PARTITION BY pl.episode, proposal ORDER BY d.period) AS log_e FROM pl JOIN dp d ON d.episode = pl.episode AND d.period > tau),
 vw AS (SELECT *, period - tau <= lifetime AS alive, SUM(CASE WHEN log_e < -1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY episode, proposal ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 AS low FROM vs),
 ve AS (SELECT episode, proposal, tau, MIN(period) FILTER (alive AND log_e >= -({math.log(0.05)} + proposal * {math.log(0.5)})) AS crossed, LEAST(MIN(period) FILTER (alive AND low), MIN(period) FILTER (NOT alive)) AS ended FROM vw GROUP BY 1, 2, 3),
 sp2 AS (SELECT episode, proposal, tau, CASE WHEN ended IS NULL OR crossed < ended THEN crossed END AS active_from, ended AS ended_at FROM ve)"""


def verified(spark, sf):
    return C.verified_proposals(demand_panel(spark, sf), plans(spark, sf), MU, SD, 0.05, -1.0, 3)


@query(f"WITH {DP}, {PL}, {VP} SELECT episode, proposal, tau, active_from, ended_at FROM sp2")
def verified_proposals(spark, sf):
    return verified(spark, sf)


@query(f"WITH {DP}, {PL}, {VP} SELECT pl.episode, pl.proposal, pl.tau, CAST(pl.tau AS INT) AS period, 'conditioned' AS event FROM pl JOIN dp ON dp.episode = pl.episode AND dp.period = pl.tau UNION ALL SELECT episode, proposal, tau, active_from, 'activated' FROM sp2 WHERE active_from IS NOT NULL UNION ALL SELECT sp2.episode, sp2.proposal, sp2.tau, ended_at, CASE WHEN ended_at - sp2.tau > lifetime THEN 'expired' ELSE 'refuted' END FROM sp2 JOIN pl ON pl.episode = sp2.episode AND pl.proposal = sp2.proposal WHERE ended_at IS NOT NULL")
def proposal_events_log(spark, sf):
    """What happens to each proposal, in the order in which it happens."""
    return C.lifecycle_events(demand_panel(spark, sf), plans(spark, sf), MU, SD, 0.05, -1.0, 3)


RB = """rb AS (SELECT pl.episode, proposal, tau, d.period, COALESCE(CASE WHEN direction = 'demand_up' THEN d.demand < mean - 1.0 * sd ELSE d.demand > mean + 1.0 * sd END, false) AS wrong FROM pl JOIN fk ON fk.episode = pl.episode AND fk.period = tau JOIN dp d ON d.episode = pl.episode AND d.period > tau),
 sp3 AS (SELECT episode, proposal, tau, tau AS active_from, MIN(period) FILTER (wrong AND before) AS ended_at FROM (SELECT *, COALESCE(LAG(wrong) OVER (PARTITION BY episode, proposal ORDER BY period), false) AS before FROM rb) GROUP BY 1, 2, 3)"""


@query(f"WITH {DP}, {PL}, {FK}, {RB} SELECT episode, proposal, tau, active_from, ended_at FROM sp3")
def rolled_back_proposals(spark, sf):
    return C.rolled_back(demand_panel(spark, sf), plans(spark, sf), 1.0).select("episode", "proposal", "tau", "active_from", "ended_at")


LIVE = "EXISTS (SELECT 1 FROM {spans} s WHERE s.episode = fk.episode AND s.active_from <= fk.period AND s.proposal = (SELECT MAX(z.proposal) FROM {spans} z WHERE z.episode = fk.episode AND z.active_from <= fk.period) AND (s.ended_at IS NULL OR s.ended_at > fk.period))"


@query(f"WITH RECURSIVE {DP}, {SP}, {FK}, {PL}, {VP}, {RB}, sp1 AS (SELECT episode, proposal, tau AS active_from, NULL::INT AS ended_at FROM pl), tg AS ("
       + " UNION ALL ".join(f"SELECT episode, '{arm}' AS arm, period, {PICK(LIVE.format(spans=spans))} FROM fk" for arm, spans in (("arm8", "sp1"), ("arm9", "sp3"), ("arm10", "sp2"))) + f"), {loop()}" + TOTALS)
def proposal_policies(spark, sf):
    """Proposals active at once, with a guard, or verified: compiled while active, the base stock before and after."""
    panel, plan = demand_panel(spark, sf), plans(spark, sf)
    spans = {"arm8": plan.select("episode", "proposal", F.col("tau").alias("active_from"), F.lit(None).cast("int").alias("ended_at")), "arm9": C.rolled_back(panel, plan, 1.0), "arm10": verified(spark, sf)}
    out = None
    for arm, s in spans.items():
        rows = C.active_spans(forecasts(spark, sf), s.select("episode", "proposal", "active_from", "ended_at"))
        part = up_where(rows, F.col("proposal").isNotNull()).drop("proposal").withColumn("arm", F.lit(arm))
        out = part if out is None else out.unionByName(part)
    return run(out)


@query(f"WITH RECURSIVE {DP}, {SP}, {FK}, tg AS (SELECT episode, 'arm4' AS arm, period, goal, cap, gamma, CASE WHEN period % 8 = 0 THEN CAST(demand % 900 AS DOUBLE) END AS quantity FROM (SELECT episode, period, demand, {GOAL.format(m=1, lead=LEAD, gamma=1)} FROM fk)), {loop()}" + TOTALS)
def direct_action_policy(spark, sf):
    """An answer's quantity where the trigger fires, the fallback's order elsewhere."""
    rows = C.base_targets(forecasts(spark, sf), Z8, lead=F.lit(LEAD)).withColumn("arm", F.lit("arm4"))
    return run(rows.withColumn("quantity", F.when(F.col("period") % 8 == 0, (F.col("demand") % 900).cast("double"))))


@query(f"WITH RECURSIVE {DP}, {SP}, tg AS (SELECT episode, 'plan' AS arm, period, NULL::DOUBLE AS goal, NULL::DOUBLE AS cap, NULL::DOUBLE AS gamma, CAST(100 + (period * 37) % 900 AS DOUBLE) AS quantity FROM dp), {loop()}" + TOTALS)
def plan_replay(spark, sf):
    return run(supply_panel(spark, sf).withColumns({"arm": F.lit("plan"), "quantity": (100 + (F.col("period") * 37) % 900).cast("double")}))


REFERENCE = {"constant": (C.constant_order(700), "700.0"), "base_stock": (C.multiple_order(MU, 2), f"GREATEST(0, {MU * 3 * 1.5} - stock - (c0 + c1 + c2 + c3))"), "chase": (C.chase_order(MU, 2), f"GREATEST(0, CASE WHEN period > 1 THEN pd * 1.25 ELSE {MU} END * 3 + 0.25 * GREATEST(0, po - pa) - stock - (c0 + c1 + c2 + c3))")}
CASES = "CASE arm " + " ".join(f"WHEN '{k}' THEN {sql}" for k, (_, sql) in REFERENCE.items()) + " END"


@query(f"WITH RECURSIVE {DP}, {SP}, tg AS (SELECT episode, arm, period, NULL::DOUBLE AS goal, NULL::DOUBLE AS cap, NULL::DOUBLE AS gamma, NULL::DOUBLE AS quantity FROM dp, (SELECT UNNEST(['constant', 'base_stock', 'chase']) AS arm)), {loop(CASES)}" + TOTALS)
def reference_policies(spark, sf):
    out = None
    for arm, (order, _) in REFERENCE.items():
        part = C.closed_loop(supply_panel(spark, sf).withColumn("arm", F.lit(arm)), order)
        out = part if out is None else out.unionByName(part)
    return rounded(C.arm_totals(out, 4.0, 0.25))


ANSWER = "CASE WHEN period % 12 = 6 THEN CASE episode % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'recent_N' WHEN 2 THEN 'explicit' ELSE 'EWMA_gamma' END END"
EW = "ew AS (SELECT a.episode, a.period, SUM(POW(0.8, a.period - 1 - b.period) * b.demand) / SUM(POW(0.8, a.period - 1 - b.period)) AS ewma FROM dp a JOIN dp b ON b.episode = a.episode AND b.period < a.period GROUP BY 1, 2)"


def parameter_rows(expiry: int) -> str:
    hold = f"CASE WHEN period - MAX(CASE WHEN answer IS NOT NULL THEN period END) OVER w < {expiry} THEN LAST_VALUE(answer IGNORE NULLS) OVER w END"
    return f"SELECT *, {hold} AS method FROM (SELECT fk.*, rmean, rsd, ewma, {ANSWER} AS answer FROM fk JOIN rk USING (episode, period) LEFT JOIN ew USING (episode, period)) WINDOW w AS (PARTITION BY episode ORDER BY period)"


PARAMETERS = "SELECT episode, '{arm}' AS arm, period, mu + " + str(Z8) + " * sigma AS goal, mu / (1 + l) + " + str(C.CAP_Z) + " * sigma / SQRT(1 + l) AS cap, 1.0::DOUBLE AS gamma, NULL::DOUBLE AS quantity FROM (SELECT *, CASE WHEN method = 'explicit' THEN 2000.0 ELSE COALESCE((1 + l) * CASE method WHEN 'recent_N' THEN rmean WHEN 'EWMA_gamma' THEN ewma ELSE mean END, 0) END AS mu, CASE WHEN method = 'explicit' THEN 300.0 ELSE COALESCE(SQRT(1 + l) * CASE method WHEN 'recent_N' THEN rsd ELSE sd END, 0) END AS sigma FROM (SELECT *, CASE WHEN method = 'explicit' THEN 1.5 ELSE 2.0 END AS l FROM ({rows})))"


@query(f"WITH RECURSIVE {DP}, {SP}, {FK}, {RK}, {EW}, tg AS ({PARAMETERS.format(arm='arm6', rows=parameter_rows(1))} UNION ALL {PARAMETERS.format(arm='arm7', rows=parameter_rows(5))}), {loop()} SELECT arm, ROUND(SUM(sold) / SUM(sold + lost), 3) AS fill, COUNT(*) AS rows FROM lp WHERE period > 0 GROUP BY 1")
def parameter_policies(spark, sf):
    """An answer's estimators of lead time, demand and spread; for its own period, or until it expires."""
    panel = forecasts(spark, sf, recent=6)
    _, near, _ = C.moments("demand", C.over(["episode"], frame=(-6, -1)))
    panel = panel.withColumn("recent_mean", near).withColumn("answer", F.when(F.col("period") % 12 == 6, F.get(F.array(*map(F.lit, ("default", "recent_N", "explicit", "EWMA_gamma"))), (F.col("episode") % 4).cast("int"))))
    weighed = F.sum(F.pow(F.lit(0.8), -F.col("period").cast("double")) * F.col("demand")).over(C.over(["episode"], frame=C.BEFORE)) / F.sum(F.pow(F.lit(0.8), -F.col("period").cast("double"))).over(C.over(["episode"], frame=C.BEFORE))
    panel = panel.withColumn("ewma", weighed)
    out = None
    for arm, expiry in (("arm6", 1), ("arm7", 5)):
        rows = panel.withColumn("method", C.persisted(panel, "answer", expiry))
        method = F.col("method")
        lead = C.lead_of(F.when(method == "explicit", "explicit").otherwise("default"), F.lit(1.5), F.lit(2.0), F.lit(None).cast("double"), F.lit(None).cast("double"))
        mu = C.demand_of(method, F.lit(2000.0), lead, F.col("mean"), F.col("recent_mean"), F.col("ewma"))
        sigma = C.spread_of(method, F.lit(300.0), lead, F.col("sd"), F.col("recent_sd"))
        part = C.parameter_targets(rows, Z8, lead, mu, sigma).withColumn("arm", F.lit(arm))
        out = part if out is None else out.unionByName(part)
    path = C.closed_loop(out)
    return rounded(path.groupBy("arm").agg((F.sum("sold") / F.sum(F.col("sold") + F.col("lost"))).alias("fill"), F.count("*").alias("rows")), 3)


CK = "ck AS (SELECT *, COALESCE(SUM(CASE WHEN pause THEN 0 ELSE 1 END) OVER (PARTITION BY episode ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clock FROM sp), ld AS (SELECT o.episode, o.period, (SELECT MIN(u.period) FROM ck u WHERE u.episode = o.episode AND u.period >= o.period AND u.clock = o.clock + o.lead_time) AS landing FROM ck o WHERE lead_time IS NOT NULL)"


@query(f"""WITH RECURSIVE {DP}, {SP}, {FK}, {CK}, rm AS (SELECT d.episode, d.period, d.demand, COALESCE(r.room, 0) AS room FROM dp d LEFT JOIN (SELECT ld.episode, landing AS period, SUM(COALESCE(CEIL(mean + {C.CAP_Z} * sd), 0)) AS room FROM ld JOIN fk USING (episode, period) WHERE landing IS NOT NULL GROUP BY 1, 2) r USING (episode, period)),
 mx AS (SELECT episode, 0 AS period, 0.0::DOUBLE AS stock, 0.0::DOUBLE AS sold FROM dp WHERE period = 1 UNION ALL SELECT r.episode, r.period, GREATEST(0, stock + room - demand), sold + LEAST(demand, stock + room) FROM mx JOIN rm r ON r.episode = mx.episode AND r.period = mx.period + 1)
 SELECT episode, 4 * sold AS gross, sold FROM mx WHERE period = (SELECT MAX(period) FROM dp)""")
def clairvoyant_gross(spark, sf):
    """The capped gross bound; as sales grow with orders, ordering the cap in every period attains it, which is its SQL."""
    rows = room_rows(spark, sf)
    return C.clairvoyant(rows, 4.0, 0.0).select("episode", F.col("value").alias("gross"), "sold")


def room_rows(spark, sf, capped=True):
    from quayside.operators.supply import landing_with_pause

    panel = forecasts(spark, sf)
    cap = F.coalesce(F.ceil(F.col("mean") + C.CAP_Z * F.col("sd")), F.lit(0)) if capped else F.lit(1e12)
    return C.landing_room(panel, landing_with_pause(supply_panel(spark, sf)), cap).withColumn("fixed", F.lit(0.0))


@query(f"""WITH {DP}, {SP}, {CK}, un AS (SELECT d.episode, d.demand, (SELECT MAX(landing) FROM ld WHERE ld.episode = d.episode AND landing <= d.period) AS landed, d.period FROM dp d)
 SELECT episode, ROUND(SUM(CASE WHEN 4 - 0.25 * (period - landed) > 0 THEN demand * (4 - 0.25 * (period - landed)) ELSE 0 END), 4) AS net FROM un GROUP BY 1""")
def clairvoyant_net_uncapped(spark, sf):
    """Without a cap each unit comes with the latest landing before it, if that pays."""
    return rounded(C.clairvoyant(room_rows(spark, sf, capped=False), 4.0, 0.25).select("episode", F.col("value").alias("net")))


@query(None)
def clairvoyant_net(spark, sf):
    """The capped net bound, and the share of it that the base stock reaches."""
    bound = C.clairvoyant(room_rows(spark, sf), 4.0, 0.25)
    base = C.arm_totals(C.closed_loop(C.base_targets(forecasts(spark, sf), Z8, lead=F.lit(LEAD)).withColumn("arm", F.lit("arm1"))), 4.0, 0.25)
    return rounded(bound.join(base.select("episode", "reward"), "episode").select("episode", "value", "reward", (F.col("reward") / F.col("value")).alias("share")))


@query(f"WITH {DP}, {PL}, bi AS (SELECT episode, CAST(tau AS INT) AS period, POW(0.5, proposal) AS step FROM pl UNION ALL SELECT episode, CAST(tau + lifetime AS INT), -POW(0.5, proposal) FROM pl) SELECT dp.episode, dp.period, SUM(COALESCE(b.step, 0.0)) OVER (PARTITION BY dp.episode ORDER BY dp.period) AS live FROM dp LEFT JOIN (SELECT episode, period, SUM(step) AS step FROM bi GROUP BY 1, 2) b ON b.episode = dp.episode AND b.period = dp.period")
def budget_path(spark, sf):
    """The prior budget of live proposals by period: half as much for each further one, given back when its lifetime ends."""
    p, share = plans(spark, sf), F.pow(F.lit(0.5), F.col("proposal"))
    steps = p.select("episode", F.col("tau").alias("period"), share.alias("step")).unionByName(p.select("episode", (F.col("tau") + F.col("lifetime")).alias("period"), (-share).alias("step")))
    rows = demand_panel(spark, sf).join(steps.groupBy("episode", "period").agg(F.sum("step").alias("step")), ["episode", "period"], "left")
    return rows.select("episode", "period", F.sum(F.coalesce("step", F.lit(0.0))).over(C.over(["episode"], frame=C.UP_TO)).alias("live"))
