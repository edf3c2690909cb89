"""Queries over the demand and supply panels, each beside its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quayside.operators import detectors as D
from quayside.operators import panel as P
from quayside.operators import sequential as S
from quayside.operators import supply as U
from quayside.plans.q_evaluation import rounded
from quayside.plans.runtime import table
from quayside.plans.views import DP, SP, demand_panel, supply_panel, with_

QUERIES, SQL = {}, {}
MU, SD = 740.0, 220.0


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


AR = "ar AS (SELECT episode, CAST(period + lead_time AS INT) AS period, CAST(SUM(ordered) AS BIGINT) AS arrivals FROM sp WHERE lead_time IS NOT NULL GROUP BY 1, 2)"
PA = "pa AS (SELECT sp.*, COALESCE(arrivals, 0) AS arrivals FROM sp LEFT JOIN ar USING (episode, period))"
# the path as a recursion, one period after the other
LS = """ls AS (SELECT episode, period, demand, arrivals, GREATEST(0, arrivals - demand) AS on_hand_end, LEAST(demand, arrivals) AS sold FROM pa WHERE period = 1
 UNION ALL SELECT p.episode, p.period, p.demand, p.arrivals, GREATEST(0, l.on_hand_end + p.arrivals - p.demand), LEAST(p.demand, l.on_hand_end + p.arrivals) FROM ls l JOIN pa p ON p.episode = l.episode AND p.period = l.period + 1)"""
PATH = "WITH RECURSIVE " + ", ".join([DP, SP, AR, PA, LS]) + " "


def path(spark, sf):
    return U.lost_sales_path(U.with_arrivals(supply_panel(spark, sf)))


@query(with_(DP, SP, AR) + "SELECT * FROM ar")
def arrival_keyed(spark, sf):
    return U.arrival_keyed(supply_panel(spark, sf))


@query(PATH + "SELECT episode, period, CAST(on_hand_end AS BIGINT) AS on_hand_end, CAST(sold AS BIGINT) AS sold, CAST(demand - sold AS BIGINT) AS lost FROM ls")
def lost_sales_path(spark, sf):
    return path(spark, sf).select("episode", "period", "on_hand_end", "sold", "lost")


@query("WITH " + ", ".join([DP, SP]) + """, ck AS (SELECT *, COALESCE(SUM(CASE WHEN pause THEN 0 ELSE 1 END) OVER (PARTITION BY episode ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clock FROM sp)
 SELECT o.episode, o.period, (SELECT MIN(u.period) FROM ck u WHERE u.episode = o.episode AND u.period >= o.period AND u.clock = o.clock + o.lead_time) AS landing FROM ck o WHERE lead_time IS NOT NULL""")
def landing_with_pause(spark, sf):
    return U.landing_with_pause(supply_panel(spark, sf))


@query(PATH + """SELECT episode, demand, sold, lost, held, ROUND(4 * sold - 0.25 * held, 4) AS reward, ROUND(CASE WHEN demand > 0 THEN GREATEST(0, (4 * sold - 0.25 * held) / (4 * demand)) ELSE 0 END, 6) AS normalized_reward, ROUND(CASE WHEN demand > 0 THEN sold / demand ELSE 1 END, 6) AS fill_rate
 FROM (SELECT episode, CAST(SUM(demand) AS BIGINT) AS demand, CAST(SUM(sold) AS BIGINT) AS sold, CAST(SUM(demand - sold) AS BIGINT) AS lost, CAST(SUM(on_hand_end) AS BIGINT) AS held FROM ls GROUP BY 1)""")
def episode_totals(spark, sf):
    return rounded(U.episode_totals(path(spark, sf), 4.0, 0.25), 6)


@query(with_(DP, SP, AR, PA) + "SELECT episode, period, CAST(COALESCE(SUM(CASE WHEN lead_time IS NOT NULL THEN ordered ELSE 0 END) OVER w - SUM(arrivals) OVER w, 0) AS BIGINT) AS in_transit FROM pa WINDOW w AS (PARTITION BY episode ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def in_transit_path(spark, sf):
    return U.in_transit_path(U.with_arrivals(supply_panel(spark, sf))).select("episode", "period", "in_transit")


FI = """oi AS (SELECT episode, period, SUM(ordered) OVER w - ordered AS f, SUM(ordered) OVER w AS t FROM pa WINDOW w AS (PARTITION BY episode ORDER BY period)),
 ri AS (SELECT episode, period, SUM(arrivals) OVER w - arrivals AS f, SUM(arrivals) OVER w AS t FROM pa WINDOW w AS (PARTITION BY episode ORDER BY period))"""


@query(with_(DP, SP, AR, PA, FI) + "SELECT o.episode, CAST(SUM((LEAST(o.t, r.t) - GREATEST(o.f, r.f)) * (r.period - o.period)) AS BIGINT) AS unit_periods, CAST(SUM(LEAST(o.t, r.t) - GREATEST(o.f, r.f)) AS BIGINT) AS units FROM oi o JOIN ri r ON o.episode = r.episode AND o.f < r.t AND r.f < o.t AND o.t > o.f AND r.t > r.f GROUP BY 1")
def fifo_age(spark, sf):
    pa = U.with_arrivals(supply_panel(spark, sf))
    ages = U.fifo_ages(pa.select("episode", "period", "ordered"), pa.select("episode", "period", F.col("arrivals").alias("received")))
    return ages.groupBy("episode").agg(F.sum(F.col("units") * F.col("age")).alias("unit_periods"), F.sum("units").alias("units"))


@query("WITH RECURSIVE " + DP + """, bs AS (SELECT episode, 0 AS period, 0::BIGINT AS stock, 0::BIGINT AS total, 0::BIGINT AS ordered, 0::BIGINT AS sold FROM dp WHERE period = 1
 UNION ALL SELECT episode, period, stock + q - LEAST(demand, stock + q), total + demand, ordered + q, sold + LEAST(demand, stock + q) FROM (SELECT d.episode, d.period, d.demand, b.stock, b.total, b.ordered, b.sold,
 CAST(LEAST(GREATEST(0, (CASE WHEN b.period = 0 THEN 0 ELSE CEIL(2 * b.total / b.period) END) - b.stock), 5000) AS BIGINT) AS q FROM bs b JOIN dp d ON d.episode = b.episode AND d.period = b.period + 1))
 SELECT episode, stock, ordered, sold FROM bs WHERE period = (SELECT MAX(period) FROM dp)""")
def base_stock_order_path(spark, sf):
    return U.base_stock_path(demand_panel(spark, sf), 2, 5000)


@query(PATH + "SELECT episode, CAST(MAX(n) AS BIGINT) AS streak FROM (SELECT episode, b, SUM(f) AS n FROM (SELECT episode, f, SUM(1 - f) OVER (PARTITION BY episode ORDER BY period) AS b FROM (SELECT episode, period, CASE WHEN demand > sold THEN 1 ELSE 0 END AS f FROM ls)) GROUP BY 1, 2) GROUP BY 1")
def max_streak(spark, sf):
    return P.max_streak(path(spark, sf), F.col("lost") > 0, ["episode"])


@query(PATH + "SELECT episode, MIN(period) FILTER (ok AND period >= 20) - 20 AS recovery FROM (SELECT episode, period, MIN(fill) OVER w >= 0.95 AND COUNT(*) OVER w = 3 AS ok FROM (SELECT episode, period, CASE WHEN demand > 0 THEN sold / demand ELSE 1 END AS fill FROM ls) WINDOW w AS (PARTITION BY episode ORDER BY period ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) GROUP BY 1")
def time_to_recovery(spark, sf):
    fill = F.when(F.col("demand") > 0, F.col("sold") / F.col("demand")).otherwise(1.0)
    return P.time_to_recovery(path(spark, sf), fill, F.lit(20), ["episode"])


RF = "rf AS (SELECT episode, period, demand, COUNT(*) OVER w AS n, AVG(demand) OVER w AS mean, CASE WHEN COUNT(*) OVER w >= 2 THEN STDDEV_SAMP(demand) OVER w WHEN COUNT(*) OVER w = 1 THEN 0 END AS sd FROM dp WINDOW w AS (PARTITION BY episode ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query(with_(DP, RF) + "SELECT episode, period, n, ROUND(mean, 6) AS mean, ROUND(sd, 6) AS sd FROM rf")
def running_forecast(spark, sf):
    return rounded(P.running_forecast(demand_panel(spark, sf), "demand", ["episode"]).select("episode", "period", "n", "mean", "sd"), 6)


@query(with_(DP, RF) + "SELECT episode, period, ROUND(demand - mean, 6) AS residual, CAST(CEIL(ROUND(mean + 1.645 * sd, 6)) AS BIGINT) AS smoother_cap FROM rf WHERE n >= 2")
def online_features(spark, sf):
    f = P.running_forecast(demand_panel(spark, sf), "demand", ["episode"]).where("n >= 2")
    return f.select("episode", "period", F.round(F.col("demand") - F.col("mean"), 6).alias("residual"), F.ceil(F.round(F.col("mean") + 1.645 * F.col("sd"), 6)).alias("smoother_cap"))


@query(with_(DP, SP) + "SELECT episode, period, COALESCE(LAG(demand) OVER w, 0) AS prev_demand, COALESCE(LAG(ordered) OVER w, 0) AS prev_ordered FROM sp WINDOW w AS (PARTITION BY episode ORDER BY period)")
def observation_lag(spark, sf):
    return P.observation_lag(supply_panel(spark, sf), ["episode"], ["demand", "ordered"]).select("episode", "period", "prev_demand", "prev_ordered")


@query(with_(DP) + "SELECT episode, ROUND(SUM(POW(0.8, (SELECT MAX(period) FROM dp) - period) * demand) / SUM(POW(0.8, (SELECT MAX(period) FROM dp) - period)), 6) AS ewma FROM dp GROUP BY 1")
def ewma_last(spark, sf):
    return rounded(P.ewma_last(demand_panel(spark, sf), "demand", ["episode"], 0.8), 6)


@query(PATH + "SELECT episode, CAST(COALESCE(MIN(period) FILTER (sold > 0), (SELECT MAX(period) FROM dp) + 1) - 1 AS INT) AS run FROM ls GROUP BY 1")
def leading_zero_run(spark, sf):
    return P.leading_run(path(spark, sf), F.col("sold") > 0, ["episode"])


# the value of the period before enters; none does in the first
DL = "dl AS (SELECT episode, period, LAG(demand) OVER (PARTITION BY episode ORDER BY period) AS x FROM dp)"
CU = f"""WITH RECURSIVE {DP}, {DL}, cu AS (SELECT episode, 0 AS period, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM dp WHERE period = 1
 UNION ALL SELECT d.episode, d.period, GREATEST(0, up + COALESCE(d.x - {MU} - {SD / 2}, 0)), GREATEST(0, down + COALESCE({MU} - d.x - {SD / 2}, 0)) FROM cu JOIN dl d ON d.episode = cu.episode AND d.period = cu.period + 1)"""


def cusum(spark, sf):
    return D.cusum_path(demand_panel(spark, sf), "demand", F.lit(MU), F.lit(SD / 2))


@query(CU + " SELECT episode, period, up, down FROM cu WHERE period > 0")
def cusum_path(spark, sf):
    return cusum(spark, sf).select("episode", "period", "up", "down")


@query(f"WITH {DP}, {DL}, s AS (SELECT episode, period, SUM(COALESCE(x - {MU} - 100, 0)) OVER w AS u, SUM(COALESCE(x - {MU} + 100, 0)) OVER w AS l FROM dl WINDOW w AS (PARTITION BY episode ORDER BY period)) SELECT episode, period, u - LEAST(0, MIN(u) OVER w) AS up, GREATEST(0, MAX(l) OVER w) - l AS down FROM s WINDOW w AS (PARTITION BY episode ORDER BY period)")
def page_hinkley_path(spark, sf):
    return D.page_hinkley_path(demand_panel(spark, sf), "demand", F.lit(MU), F.lit(100.0)).select("episode", "period", "up", "down")


@query(CU + f" SELECT episode, MIN(period) AS period, MIN_BY(CASE WHEN up >= down THEN 'cusum_up' ELSE 'cusum_down' END, period) AS rule FROM cu WHERE GREATEST(up, down) > {4 * SD} GROUP BY 1 UNION ALL SELECT episode, NULL, NULL FROM cu GROUP BY 1 HAVING MAX(GREATEST(up, down)) <= {4 * SD}")
def cusum_first_fire(spark, sf):
    return D.first_fire(cusum(spark, sf), F.lit(4 * SD)).select("episode", "period", "rule")


def restarts(slack: float, threshold: float, rule: str) -> str:
    """The detector with its suppression as a recursion over periods."""
    return f"""WITH RECURSIVE {DP}, {DL}, st AS (SELECT episode, 0 AS period, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, NULL::INT AS last, 0 AS fires, false AS fire, false AS withheld, 0.0::DOUBLE AS statistic, '' AS rule FROM dp WHERE period = 1
 UNION ALL SELECT episode, period, CASE WHEN fire THEN 0 ELSE u END, CASE WHEN fire THEN 0 ELSE d END, CASE WHEN fire THEN period ELSE last END, fires + CASE WHEN fire THEN 1 ELSE 0 END, fire, GREATEST(u, d) > {threshold} AND NOT fire, GREATEST(u, d), CASE WHEN u >= d THEN '{rule}_up' ELSE '{rule}_down' END FROM (
 SELECT *, GREATEST(u, d) > {threshold} AND (last IS NULL OR period - last > 5) AND fires < 4 AS fire FROM (SELECT e.episode, e.period, st.last, st.fires, GREATEST(0, st.up + COALESCE(e.x - {MU} - {slack}, 0)) AS u, GREATEST(0, st.down + COALESCE({MU} - e.x - {slack}, 0)) AS d FROM st JOIN dl e ON e.episode = st.episode AND e.period = st.period + 1)))"""


@query(restarts(SD / 2, 2 * SD, "cusum") + " SELECT episode, period, rule, statistic FROM st WHERE fire")
def max_proposals(spark, sf):
    return D.suppressed_cusum(demand_panel(spark, sf), "demand", MU, SD / 2, 2 * SD, 5, 4)


@query(restarts(100.0, 3 * SD, "page_hinkley") + " SELECT episode, period, rule, statistic FROM st WHERE fire")
def page_hinkley_proposals(spark, sf):
    return D.suppressed_page_hinkley(demand_panel(spark, sf), "demand", MU, 100.0, 3 * SD, 5, 4)


@query(restarts(SD / 2, 2 * SD, "cusum") + " SELECT episode, COUNT(*) FILTER (fire) AS permitted, COUNT(*) FILTER (withheld) AS suppressed FROM st GROUP BY 1")
def suppressed_firings(spark, sf):
    folded = D.with_restarts(demand_panel(spark, sf), "demand", "cusum", MU, SD / 2, 2 * SD, 5, 4)
    return folded.select("episode", F.size("fires").cast("long").alias("permitted"), F.col("suppressed").cast("long").alias("suppressed"))


HI = f"hi AS (SELECT episode, period FROM dp WHERE demand > {MU})"


@query(f"""WITH RECURSIVE {DP}, {HI}, k AS (SELECT episode, MIN(period) AS period FROM hi GROUP BY 1 UNION ALL SELECT k.episode, (SELECT MIN(h.period) FROM hi h WHERE h.episode = k.episode AND h.period - k.period > 3) AS period FROM k WHERE EXISTS (SELECT 1 FROM hi h WHERE h.episode = k.episode AND h.period - k.period > 3))
 SELECT episode, period FROM k""")
def refractory_filter(spark, sf):
    return D.refractory(demand_panel(spark, sf).where(F.col("demand") > MU).select("episode", "period"), 3)


@query(CU + f", al AS (SELECT DISTINCT user_id % 50 AS episode, CAST(1 + event_id % 83 AS INT) AS period FROM events WHERE event_type = 'error'), de AS (SELECT episode, period FROM cu WHERE period > 0 AND GREATEST(up, down) > {4 * SD}) SELECT COALESCE(al.episode, de.episode) AS episode, COALESCE(al.period, de.period) AS period, CASE WHEN de.episode IS NULL THEN 'alert' WHEN al.episode IS NULL THEN 'detector' ELSE 'alert+detector' END AS rule FROM al FULL JOIN de ON al.episode = de.episode AND al.period = de.period")
def alert_or_detector(spark, sf):
    alerts = table(spark, sf, "events").where("event_type = 'error'").select((F.col("user_id") % 50).alias("episode"), (1 + F.col("event_id") % 83).cast("int").alias("period"))
    return D.either_channel(alerts, cusum(spark, sf).where(F.greatest("up", "down") > 4 * SD))


@query("SELECT range + 1 AS slot, 1 + range * 12 AS period FROM range(4)")
def even_schedule(spark, sf):
    return D.even_schedule(spark, 4, 50, 5)


@query(CU + ", tp AS (SELECT episode, MAX(GREATEST(up, down)) AS top FROM cu WHERE period > 0 GROUP BY 1), th AS (SELECT QUANTILE_DISC(top, 0.9) AS threshold FROM tp) SELECT threshold, COUNT(*) AS episodes, COUNT(*) FILTER (top > threshold) AS fires FROM tp, th GROUP BY 1")
def calibrate_threshold(spark, sf):
    return D.calibrated_threshold(cusum(spark, sf), 0.9)


LLR = {"up": f"(0.25 * (demand - {MU}) / {SD} - 0.03125)", "down": f"(-0.25 * (demand - {MU}) / {SD} - 0.03125)"}
EP = f"""ep AS (SELECT episode, period, GREATEST(a, b) + LN(EXP(a - GREATEST(a, b)) + EXP(b - GREATEST(a, b))) AS log_e FROM (SELECT episode, period, LN(0.5) + SUM({LLR['up']}) OVER w AS a, LN(0.5) + SUM({LLR['down']}) OVER w AS b FROM dp WINDOW w AS (PARTITION BY episode ORDER BY period)))"""


def eprocess(spark, sf, alpha=0.025):
    rows = demand_panel(spark, sf).withColumns({k: F.expr(v) for k, v in LLR.items()})
    return S.mixture_eprocess(rows, ["up", "down"], [0.5, 0.5], alpha)


@query(with_(DP, EP) + f"SELECT episode, period, ROUND(log_e, 4) AS log_e, MIN(CASE WHEN log_e >= {math.log(40)} THEN period END) OVER (PARTITION BY episode ORDER BY period) AS crossed_at FROM ep")
def eprocess_path(spark, sf):
    return rounded(eprocess(spark, sf).select("episode", "period", "log_e", "crossed_at"), 4)


@query(f"""WITH RECURSIVE {DP}, {EP}, lc AS (SELECT episode, 0 AS period, 'proposed' AS state, NULL::INT AS changed_at, 0 AS low FROM ep WHERE period = 1 UNION ALL SELECT episode, period, new, CASE WHEN new <> state THEN period ELSE changed_at END, low FROM (
 SELECT *, CASE WHEN state NOT IN ('proposed', 'active') THEN state WHEN period - 1 >= 60 THEN 'expired' WHEN state = 'proposed' AND log_e >= {math.log(40)} THEN 'active' WHEN low >= 3 THEN 'refuted' ELSE state END AS new FROM (
 SELECT e.episode, e.period, lc.state, lc.changed_at, e.log_e, CASE WHEN e.log_e < -1.0 THEN lc.low + 1 ELSE 0 END AS low FROM lc JOIN ep e ON e.episode = lc.episode AND e.period = lc.period + 1)))
 SELECT episode, state, changed_at FROM lc WHERE period = (SELECT MAX(period) FROM dp)""")
def lifecycle_states(spark, sf):
    return S.lifecycle(eprocess(spark, sf), 0.025, -1.0, 3, 60)


@query(with_(DP, EP) + f"SELECT episode, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN GREATEST(a, b) END AS activated_at FROM (SELECT episode, MIN(period) FILTER (log_e >= {math.log(20)}) AS a, MIN(period) FILTER (log_e >= {math.log(40)}) AS b FROM ep GROUP BY 1)")
def compound_activation(spark, sf):
    last = lambda alpha: eprocess(spark, sf, alpha).groupBy("episode").agg(F.min("crossed_at").alias("crossed_at"))
    return S.compound_activation(last(0.05), last(0.025))


@query(with_(DP) + f"SELECT episode, MIN(period) FILTER (below AND before) AS rolled_back_at FROM (SELECT episode, period, below, COALESCE(LAG(below) OVER (PARTITION BY episode ORDER BY period), false) AS before FROM (SELECT *, demand < {MU} - 1.0 * {SD} AS below FROM dp)) GROUP BY 1")
def rollback_streak(spark, sf):
    return S.contradicted(demand_panel(spark, sf), "demand", F.lit(MU), F.lit(SD), 1.0)


@query(f"""WITH RECURSIVE {DP}, hf AS (SELECT episode, 0 AS period, 0.05::DOUBLE AS p, 0.05::DOUBLE AS top FROM dp WHERE period = 1 UNION ALL SELECT episode, period, q, GREATEST(top, q) FROM (SELECT episode, period, top, CASE WHEN a + b > 0 THEN b / (a + b) ELSE ahead END AS q FROM (
 SELECT *, (1 - ahead) * EXP(-POW((demand - {MU}) / {SD}, 2) / 2) / {SD} AS a, ahead * EXP(-POW((demand - {MU * 1.5}) / {SD * 1.5}, 2) / 2) / {SD * 1.5} AS b FROM (SELECT d.episode, d.period, d.demand, hf.top, hf.p * 0.9 + (1 - hf.p) * 0.05 AS ahead FROM hf JOIN dp d ON d.episode = hf.episode AND d.period = hf.period + 1))))
 SELECT episode, ROUND(p, 6) AS last_p, ROUND(top, 6) AS max_p FROM hf WHERE period = (SELECT MAX(period) FROM dp)""")
def hmm_filter(spark, sf):
    return rounded(S.regime_filter(demand_panel(spark, sf), "demand", (MU, MU * 1.5), (SD, SD * 1.5), (0.95, 0.9)), 6)


@query("SELECT range + 1 AS proposal, 0.05 * POW(0.5, range + 1) AS alpha, 1 / (0.05 * POW(0.5, range + 1)) AS threshold FROM range(4)")
def alpha_schedule(spark, sf):
    return S.alpha_schedule(spark, 0.05, 4)


@query(with_(DP) + "SELECT episode, before, period FROM (SELECT *, LAG(period) OVER (PARTITION BY episode ORDER BY period) AS before FROM dp WHERE demand % 3 <> 0) WHERE before + 1 <> period")
def consecutive_guard(spark, sf):
    return S.consecutive_guard(demand_panel(spark, sf).where("demand % 3 <> 0"))


@query(with_(DP) + "SELECT COUNT(*) AS n, COUNT(DISTINCT d) AS trajectories FROM (SELECT SHA256(STRING_AGG(period || ':' || demand, ',' ORDER BY period)) AS d FROM dp GROUP BY episode)")
def trajectory_digest(spark, sf):
    rows = demand_panel(spark, sf).groupBy("episode").agg(F.sort_array(F.collect_list(F.struct("period", "demand"))).alias("r"))
    digest = F.sha2(F.array_join(F.transform("r", lambda x: F.concat(x["period"].cast("string"), F.lit(":"), x["demand"].cast("string"))), ","), 256)
    return rows.agg(F.count("*").alias("n"), F.count_distinct(digest).alias("trajectories"))


@query(with_(DP) + "SELECT episode, period, demand, CAST(CASE WHEN period BETWEEN 30 AND 45 THEN GREATEST(0, FLOOR(demand * 1.6 + 0.5)) ELSE demand END AS BIGINT) AS shocked FROM dp")
def demand_shock_apply(spark, sf):
    shocked = F.when(F.col("period").between(30, 45), F.greatest(F.lit(0), F.floor(F.col("demand") * 1.6 + 0.5))).otherwise(F.col("demand"))
    return demand_panel(spark, sf).withColumn("shocked", shocked)


@query(with_(DP) + "SELECT episode, period, demand FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY episode ORDER BY demand DESC, period) AS r FROM dp) WHERE r = 1")
def first_row_per_key(spark, sf):
    return P.first_row(demand_panel(spark, sf), ["episode"], [("demand", "desc"), "period"])


@query(with_(DP) + "SELECT DISTINCT d.episode, d.period, d.demand FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY episode ORDER BY period) - 1 AS i, COUNT(*) OVER (PARTITION BY episode) AS n FROM dp) d JOIN range(7) k ON d.i = k.range * d.n // 7")
def even_stride_sample(spark, sf):
    return P.even_stride(demand_panel(spark, sf), ["episode"], ["period"], 7)


@query(PATH + "SELECT o.episode, BOOL_AND(o.ordered = d.demand) AS identical, COUNT(*) FILTER (o.ordered <> d.demand) AS differences FROM sp o JOIN dp d USING (episode, period) GROUP BY 1")
def order_equality(spark, sf):
    panel = supply_panel(spark, sf)
    return U.order_sequences_equal(panel.select("episode", "period", "ordered"), panel.select("episode", "period", F.col("demand").alias("ordered")), ["episode"])
