"""Queries over policies in closed loop, demand laws and filters, each beside its SQL where SQL has one."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from quayside.operators import laws as L
from quayside.operators import policies as O
from quayside.operators import supply as U
from quayside.plans.q_evaluation import rounded
from quayside.plans.views import DP, ER, SP, demand_panel, episode_results, supply_panel, with_

QUERIES, SQL = {}, {}
Z8, Z95 = NormalDist().inv_cdf(0.8), NormalDist().inv_cdf(0.95)


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH RECURSIVE {DP}, cb AS (SELECT episode, 0 AS period, 0::BIGINT AS stock, 0::BIGINT AS p1, 0::BIGINT AS p2, 0::BIGINT AS n, 0::BIGINT AS s, 0::BIGINT AS q, 0::BIGINT AS ordered, 0::BIGINT AS sold FROM dp WHERE period = 1
 UNION ALL SELECT episode, period, stock + p1 - LEAST(demand, stock + p1), p2, o, n + 1, s + demand, q + demand * demand, ordered + o, sold + LEAST(demand, stock + p1) FROM (
 SELECT *, CASE WHEN n = 0 THEN 0 ELSE GREATEST(0, LEAST(CAST(CEIL(3 * mean + {Z8} * {math.sqrt(3)} * sd - (stock + p1 + p2)) AS BIGINT), CAST(CEIL(mean + {Z95} * sd) AS BIGINT))) END AS o FROM (
 SELECT d.episode, d.period, d.demand, cb.stock, cb.p1, cb.p2, cb.n, cb.s, cb.q, cb.ordered, cb.sold, CASE WHEN cb.n > 0 THEN cb.s / cb.n END AS mean, CASE WHEN cb.n > 1 THEN SQRT((cb.n * cb.q - cb.s * cb.s) / (cb.n * (cb.n - 1))) ELSE 0.0 END AS sd FROM cb JOIN dp d ON d.episode = cb.episode AND d.period = cb.period + 1)))
 SELECT episode, stock, ordered, sold FROM cb WHERE period = (SELECT MAX(period) FROM dp)""")
def capped_base_stock(spark, sf):
    return O.capped_base_stock(demand_panel(spark, sf), 2, 0.8, 0.95)


# shipments by remaining periods, c0 to c3; a pause keeps them where they are, and what has arrived still lands
RUNNER = f"""WITH RECURSIVE {DP}, {SP}, pr AS (SELECT episode, 0 AS period, 0.0::DOUBLE AS stock, 0.0::DOUBLE AS c0, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2, 0.0::DOUBLE AS c3, 0::BIGINT AS n, 0::BIGINT AS s, 0::BIGINT AS q, 0.0::DOUBLE AS o, 0.0::DOUBLE AS sold, 0.0::DOUBLE AS lost FROM dp WHERE period = 1
 UNION ALL SELECT episode, period, stock + a - LEAST(demand, stock + a), CASE WHEN pause THEN 0 ELSE d1 END, CASE WHEN pause THEN d1 ELSE d2 END, CASE WHEN pause THEN d2 ELSE d3 END, CASE WHEN pause THEN d3 ELSE 0 END, n + 1, s + demand, q + demand * demand, o, LEAST(demand, stock + a), demand - LEAST(demand, stock + a) FROM (
 SELECT *, c0 + CASE WHEN lead_time = 0 THEN o ELSE 0 END AS a, c1 + CASE WHEN lead_time = 1 THEN o ELSE 0 END AS d1, c2 + CASE WHEN lead_time = 2 THEN o ELSE 0 END AS d2, c3 + CASE WHEN lead_time = 3 THEN o ELSE 0 END AS d3 FROM (
 SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE GREATEST(0, LEAST(CEIL(3 * mean + {Z8} * {math.sqrt(3)} * sd - stock - (c0 + c1 + c2 + c3)), CEIL(mean + {Z95} * sd))) END AS o FROM (
 SELECT x.episode, x.period, x.demand, x.lead_time, x.pause, pr.stock, pr.c0, pr.c1, pr.c2, pr.c3, pr.n, pr.s, pr.q, CASE WHEN pr.n > 0 THEN pr.s / pr.n END AS mean, CASE WHEN pr.n > 1 THEN SQRT((pr.n * pr.q - pr.s * pr.s) / (pr.n * (pr.n - 1))) ELSE 0.0 END AS sd FROM pr JOIN sp x ON x.episode = pr.episode AND x.period = pr.period + 1))))"""


@query(RUNNER + " SELECT episode, SUM(o) AS ordered, SUM(sold) AS sold, SUM(lost) AS lost, ROUND(SUM(4 * sold - 0.25 * stock), 4) AS reward FROM pr WHERE period > 0 GROUP BY 1")
def policy_runner(spark, sf):
    """The same policy as an object, against uncertain supply: pauses and lost shipments."""
    path = O.run_policy(supply_panel(spark, sf), lambda: O.BaseStock(2, 0.8), 4.0, 0.25)
    return path.groupBy("episode").agg(F.sum("ordered").alias("ordered"), F.sum("sold").alias("sold"), F.sum("lost").alias("lost"), F.round(F.sum("reward"), 4).alias("reward"))


@query(None)
def demand_level_ratio(spark, sf):
    """Exact log likelihood ratios of a level change, for whole-number demand."""
    rows = demand_panel(spark, sf).withColumn("ratio", L.log_likelihood_ratio(F.col("demand"), 740.0, 220.0, 1.25))
    return rounded(rows.select("episode", "period", "ratio"), 6)


# every hidden pipeline that the receipts allow, with its probability, period by period
DELAYS = (0.25, 0.25, 0.2, 0.2)
FILTER = f"""WITH RECURSIVE {DP}, {SP}, ar AS (SELECT episode, CAST(period + lead_time AS INT) AS period, CAST(SUM(ordered) AS BIGINT) AS arrivals FROM sp WHERE lead_time IS NOT NULL GROUP BY 1, 2), pa AS (SELECT sp.episode, sp.period, CAST(ordered AS BIGINT) AS ordered, CAST(COALESCE(arrivals, 0) AS BIGINT) AS received FROM sp LEFT JOIN ar USING (episode, period)),
 law(delay, p) AS (VALUES (0, {DELAYS[0]}::DOUBLE), (1, {DELAYS[1]}::DOUBLE), (2, {DELAYS[2]}::DOUBLE), (3, {DELAYS[3]}::DOUBLE), (4, {1 - sum(DELAYS)}::DOUBLE)),
 st AS (SELECT episode, 0 AS period, 0::BIGINT AS b0, 0::BIGINT AS b1, 0::BIGINT AS b2, 1.0::DOUBLE AS w FROM dp WHERE period = 1
 UNION ALL SELECT episode, period, b1 + CASE WHEN delay = 1 THEN ordered ELSE 0 END, b2 + CASE WHEN delay = 2 THEN ordered ELSE 0 END, CASE WHEN delay = 3 THEN ordered ELSE 0 END, SUM(w * p) FROM (SELECT x.episode, x.period, x.ordered, x.received, st.b0, st.b1, st.b2, st.w, law.delay, law.p FROM st JOIN pa x ON x.episode = st.episode AND x.period = st.period + 1, law)
 WHERE b0 + CASE WHEN delay = 0 THEN ordered ELSE 0 END = received GROUP BY 1, 2, 3, 4, 5)"""


@query(FILTER + " SELECT episode, ROUND(CASE WHEN MAX(period) = (SELECT MAX(period) FROM dp) THEN LN(SUM(w) FILTER (period = (SELECT MAX(period) FROM dp))) ELSE '-inf'::DOUBLE END, 6) AS log_likelihood, CAST(MAX(period) AS BIGINT) AS steps FROM st GROUP BY 1")
def arrival_filter(spark, sf):
    """Likelihood of receipts under a registered delay law, filtered exactly over the hidden pipeline."""
    rows = U.with_arrivals(supply_panel(spark, sf)).select("episode", "period", F.col("ordered").cast("double").alias("dispatched"), F.col("arrivals").cast("double").alias("received"))
    return rounded(L.arrival_likelihood(rows, DELAYS, 0.0), 6)


TAIL_SUM = "LIST_SUM(LIST_TRANSFORM(RANGE({k} + 1), lambda i: EXP(LGAMMA(n + 1) - CASE WHEN i > 0 THEN LGAMMA(i + 1) ELSE 0 END - CASE WHEN n > i THEN LGAMMA(n - i + 1) ELSE 0 END + i * LN((low + high) / 2) + (n - i) * LN(1 - (low + high) / 2))))"


def bisection(name: str, count: str, above: str) -> str:
    """Halving [0, 1] 50 times by the binomial tail at its middle."""
    return f"""{name} AS (SELECT arm, k, n, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, 0 AS step FROM rt UNION ALL SELECT arm, k, n, CASE WHEN {above} THEN (low + high) / 2 ELSE low END, CASE WHEN {above} THEN high ELSE (low + high) / 2 END, step + 1 FROM (SELECT *, {TAIL_SUM.format(k=count)} AS tail FROM {name} WHERE step < 50))"""


@query("WITH RECURSIVE " + ER + ", rt AS (SELECT arm, COUNT(*) FILTER (lost > 0) AS k, COUNT(*) AS n FROM er GROUP BY arm), " + bisection("up", "k", "tail > 0.025") + ", " + bisection("dn", "k - 1", "1 - tail < 0.025") + " SELECT up.arm, up.k, up.n, ROUND(CASE WHEN up.k = 0 THEN 0 ELSE dn.low END, 6) AS exact_low, ROUND(CASE WHEN up.k = up.n THEN 1 ELSE up.low END, 6) AS exact_high FROM up JOIN dn USING (arm) WHERE up.step = 50 AND dn.step = 50")
def exact_rate_limits(spark, sf):
    k = episode_results(spark, sf).groupBy("arm").agg(F.count_if(F.col("lost") > 0).alias("k"), F.count("*").alias("n"))
    return rounded(L.exact_interval(k, "k", "n"), 6)


@query(with_(ER) + "SELECT condition, family, ROUND(AVG(profit) FILTER (arm = '1-URGENT') / NULLIF(AVG(profit) FILTER (arm = '5-LOW'), 0), 6) AS ratio, COUNT(*) FILTER (lost = 0) AS intact FROM er GROUP BY 1, 2")
def ratio_by_stratum(spark, sf):
    mean = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("profit")))
    return rounded(episode_results(spark, sf).groupBy("condition", "family").agg(F.try_divide(mean("1-URGENT"), mean("5-LOW")).alias("ratio"), F.count_if(F.col("lost") == 0).alias("intact")), 6)


@query(None)
def null_calibration(spark, sf):
    """False activations of four registered null laws, 2,000 paths of 50 periods each."""
    from quayside.operators.calibration import null_calibration as run

    out = None
    for kind in ("iid", "seasonal", "negbin", "ar1"):
        part = run(spark, kind, 2000, 50, 20, 0.025)
        out = part if out is None else out.unionByName(part)
    return rounded(out, 6)
