"""Queries over posteriors of changes and the mixture they weigh, each beside its SQL, which sums every period of every
alternative anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.operators import mechanisms as X
from quayside.operators import mixture as M
from quayside.operators import supply
from quayside.operators.panel import running_forecast
from quayside.plans.q_evaluation import rounded
from quayside.plans.q_panel import LLR
from quayside.plans.records_view import AR, PA
from quayside.plans.views import DP, SP, demand_panel, supply_panel, with_

QUERIES, SQL = {}, {}
LEAD, LIFETIME, PRIOR, LEVEL = 2, 24, 0.00625, 0.95


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def proposals(spark, sf):
    """One proposal of every hypothesis in each episode."""
    first = demand_panel(spark, sf).where("period = 1").select("episode", (14 + F.col("episode") % 9).cast("int").alias("tau"), F.lit(LEAD).alias("lead"))
    return first.withColumn("hypothesis", F.explode(F.array(*map(F.lit, (*M.DEMAND, M.LEAD)))))


PP = "pp AS (SELECT episode, CAST(14 + episode % 9 AS INT) AS tau FROM dp WHERE period = 1)"
HG = "hg(h, m, d, w) AS (VALUES " + ", ".join(f"('{h}', {m}::DOUBLE, {'NULL' if d is None else d}::INT, {w}::DOUBLE)" for h, (ms, ds) in M.DEMAND.items() for m in ms for d, w in ds) + ")"
# densities of every period of every alternative, summed for every period t
PO = f"""cand AS (SELECT episode, tau, h, m, d, LN(w) AS lp, CAST(UNNEST(RANGE(GREATEST(2, tau - 4), tau + 3)) AS INT) AS s FROM pp, hg),
 st AS (SELECT c.episode, c.s, AVG(demand) AS mu, GREATEST(1.0, STDDEV_SAMP(demand)) AS sd FROM (SELECT DISTINCT episode, s FROM cand) c JOIN dp ON dp.episode = c.episode AND dp.period < c.s GROUP BY 1, 2),
 tt AS (SELECT episode, tau, CAST(UNNEST(RANGE(tau + 1, LEAST(tau + {LIFETIME}, last) + 1)) AS INT) AS t FROM pp, (SELECT MAX(period) AS last FROM dp)),
 ll AS (SELECT episode, tau, h, m, d, s, mu, sd, t, ANY_VALUE(lp) + SUM(-0.5 * POW((demand - f * mu) / (f * sd), 2) - LN(f * sd)) AS l, SUM(CASE WHEN f <> 1 THEN demand ELSE 0 END) AS seen, COUNT(*) FILTER (f <> 1) AS k FROM (
 SELECT c.*, mu, sd, t, demand, CASE WHEN u.period >= c.s AND (d IS NULL OR u.period < c.s + d) THEN m ELSE 1.0 END AS f FROM cand c JOIN st ON st.episode = c.episode AND st.s = c.s JOIN tt ON tt.episode = c.episode JOIN dp u ON u.episode = c.episode AND u.period BETWEEN GREATEST(2, c.tau - 4) AND t - 1) GROUP BY ALL),
 po AS (SELECT *, EXP(l - top) / SUM(EXP(l - top)) OVER (PARTITION BY episode, h, t) AS p FROM (SELECT *, MAX(l) OVER (PARTITION BY episode, h, t) AS top FROM ll)),
 mo AS (SELECT po.*, t >= s AND (d IS NULL OR t < s + d) AS active, n * (5 * m * mu + seen) / (5 + k) + ({LEAD} + 1 - n) * mu AS wmu, SQRT(n * POW(m * sd, 2) + ({LEAD} + 1 - n) * sd * sd) AS wsd FROM (SELECT *, GREATEST(0, LEAST(t + {LEAD}, COALESCE(s + d - 1, t + {LEAD})) - GREATEST(t, s) + 1) AS n FROM po WHERE p > 1e-6) po)"""


@query(with_(DP, PP, HG, PO) + "SELECT episode, h AS hypothesis, t, ROUND(SUM(p * m), 4) AS multiplier, ROUND(SUM(p * s), 4) AS start, ROUND(SUM(CASE WHEN d IS NULL THEN p ELSE 0 END), 4) AS lasting, ROUND(SUM(CASE WHEN active THEN p ELSE 0 END), 4) AS active, ROUND(SUM(p * wmu), 2) AS mean FROM mo GROUP BY 1, 2, 3")
def demand_posterior(spark, sf):
    parts = M.demand_posterior(demand_panel(spark, sf), proposals(spark, sf), LIFETIME)
    mean = lambda of: M.total(F.col("parts"), lambda e: e["p"] * of(e))
    share = lambda of: M.total(F.col("parts"), lambda e: F.when(of(e), e["p"]).otherwise(0.0))
    out = parts.select("episode", "hypothesis", "t", mean(lambda e: e["multiplier"]).alias("multiplier"), mean(lambda e: e["start"]).alias("start"), share(lambda e: e["duration"].isNull()).alias("lasting"), share(lambda e: e["active"]).alias("active"), mean(lambda e: e["mu"]).alias("mean"))
    return out.withColumns({c: F.round(c, 2 if c == "mean" else 4) for c in ("multiplier", "start", "lasting", "active", "mean")})


def receipts(spark, sf):
    return supply.with_arrivals(supply_panel(spark, sf)).select("episode", "period", F.col("ordered").alias("dispatched"), F.col("arrivals").alias("received"))


# expected receipts and what is under way by going through all dispatches of every course
LP = f"""lc AS (SELECT episode, tau, x AS shift, CAST(UNNEST(RANGE(GREATEST(2, tau - 4), tau + 5)) AS INT) AS s FROM pp, (SELECT UNNEST([1, 2, 3]) AS x)), lv AS (SELECT lc.*, CAST(v AS INT) AS v FROM lc, (SELECT UNNEST(RANGE(1, last + 1)) AS v, last FROM (SELECT MAX(period) AS last FROM dp)) WHERE v BETWEEN GREATEST(2, tau - 4) AND tau + {LIFETIME}),
 lw AS (SELECT lv.episode, tau, lv.shift, lv.s, v, COALESCE(SUM(q.ordered) FILTER (q.period + e = v), 0) AS due, COALESCE(SUM(q.ordered) FILTER (q.period + e >= v), 0) AS way FROM lv LEFT JOIN (SELECT episode, period, ordered, x AS shift, y AS s, {LEAD} + CASE WHEN period >= y THEN x ELSE 0 END AS e FROM sp, (SELECT UNNEST([1, 2, 3]) AS x), (SELECT UNNEST(RANGE(2, 40)) AS y)) q ON q.episode = lv.episode AND q.shift = lv.shift AND q.s = lv.s AND q.period < v GROUP BY 1, 2, 3, 4, 5),
 ob AS (SELECT episode, period, arrivals, SUM(ordered - arrivals) OVER (PARTITION BY episode ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS on_way FROM pa),
 ls AS (SELECT lw.*, -POW((arrivals - due) / (2 + 0.05 * due), 2) / 2 - LN(2 + 0.05 * due) AS step, -POW((on_way - way) / (2 + 0.05 * way), 2) / 2 - LN(2 + 0.05 * way) AS now FROM lw JOIN ob ON ob.episode = lw.episode AND ob.period = v),
 lt AS (SELECT episode, tau, shift, s, v AS t, COALESCE(SUM(step) OVER (PARTITION BY episode, shift, s ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + now AS l FROM ls),
 lo AS (SELECT *, EXP(l - top) / SUM(EXP(l - top)) OVER (PARTITION BY episode, t) AS p FROM (SELECT *, MAX(l) OVER (PARTITION BY episode, t) AS top FROM lt WHERE t > tau))"""


@query(with_(DP, SP, AR, PA, PP, LP) + "SELECT episode, t, shift, ROUND(SUM(p), 6) AS p, ROUND(SUM(CASE WHEN t >= s THEN p ELSE 0 END), 6) AS active FROM lo GROUP BY 1, 2, 3")
def lead_posterior(spark, sf):
    parts = M.lead_posterior(receipts(spark, sf), proposals(spark, sf), LIFETIME)
    rows = parts.select("episode", "t", F.explode("parts").alias("e")).groupBy("episode", "t", F.col("e.shift").alias("shift"))
    return rounded(rows.agg(F.sum("e.p").alias("p"), F.sum(F.when(F.col("e.active"), F.col("e.p")).otherwise(0.0)).alias("active")), 6)


def poly(factors, z: str) -> str:
    out = str(factors[0])
    for f in factors[1:]:
        out = f"({out} * {z} + {f})"
    return out


CDF_TAIL = f"(EXP(-z * z / 2) * CASE WHEN z < 7.07106781186547 THEN {poly(M.HART_ABOVE, 'z')} / {poly(M.HART_BELOW, 'z')} ELSE 1 / ((z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) * 2.506628274631) END)"


def sql_quantile(name: str, source: str, keys: str, level: float) -> str:
    """name: keys and x, the level quantile of source's rows (keys, w, mu, sd), by halving; w sums to 1."""
    on = " AND ".join(f"b.{k} = r.{k}" for k in keys.split(", "))
    cdf = f"SUM(w * CASE WHEN x > 0 THEN 1 - {CDF_TAIL.replace('z', 'ABS(x)')} ELSE {CDF_TAIL.replace('z', 'ABS(x)')} END)"
    return f"""{name}_b({keys.replace(', ', ', ')}, lo, hi, k) AS (SELECT {keys}, MIN(mu - 12 * sd), MAX(mu + 12 * sd), 0 FROM {source} GROUP BY {keys} UNION ALL SELECT {keys}, CASE WHEN below < {level} THEN mid ELSE lo END, CASE WHEN below < {level} THEN hi ELSE mid END, k + 1 FROM (
 SELECT {', '.join('b.' + k for k in keys.split(', '))}, lo, hi, k, (lo + hi) / 2 AS mid, {cdf} AS below FROM (SELECT b.*, w, ((b.lo + b.hi) / 2 - mu) / sd AS x FROM {name}_b b JOIN {source} r ON {on} WHERE k < 56) b GROUP BY {', '.join('b.' + k for k in keys.split(', '))}, lo, hi, k)),
 {name} AS (SELECT {keys}, (lo + hi) / 2 AS x FROM {name}_b WHERE k = 56)"""


RW = "rw AS (SELECT episode, h, t, p / SUM(p) OVER (PARTITION BY episode, h, t) AS w, wmu AS mu, wsd AS sd FROM mo)"


@query("WITH RECURSIVE " + ", ".join([DP, PP, HG, PO, RW, sql_quantile("qu", "rw", "episode, h, t", LEVEL)]) + " SELECT episode, h AS hypothesis, t, ROUND(x, 3) AS quantile, true AS exact FROM qu")
def mixture_quantiles(spark, sf):
    """The quantile of each posterior's demand over the lead window; exact: is the distribution function there the level?"""
    parts = M.demand_posterior(demand_panel(spark, sf), proposals(spark, sf), LIFETIME)
    whole = M.total(F.col("parts"), lambda e: e["p"])
    rows = parts.withColumn("whole", whole).select("episode", "hypothesis", "t", F.transform("parts", lambda e: F.struct((e["p"] / F.col("whole")).alias("w"), e["mu"].alias("mu"), e["sd"].alias("sd"))).alias("mix"))
    rows = rows.withColumn("x", M.mixture_quantile(F.col("mix"), F.lit(LEVEL)))
    residual = M.total(F.col("mix"), lambda e: e["w"] * M.normal_cdf((F.col("x") - e["mu"]) / e["sd"])) - LEVEL
    return rows.select("episode", "hypothesis", "t", F.round("x", 3).alias("quantile"), (F.abs(residual) < 1e-9).alias("exact"))


EV = f"""ev AS (SELECT tt.episode, tt.t, h, LN({PRIOR}) + CASE h WHEN 'lead_time' THEN 0.0 WHEN 'demand_down' THEN SUM(CASE WHEN d.period > tt.tau THEN {LLR['down']} ELSE 0.0 END) ELSE SUM(CASE WHEN d.period > tt.tau THEN {LLR['up']} ELSE 0.0 END) END AS mass FROM tt JOIN dp d ON d.episode = tt.episode AND d.period < tt.t, (SELECT UNNEST(['demand_up', 'demand_down', 'pulse_up', 'lead_time']) AS h) GROUP BY 1, 2, 3),
 fo AS (SELECT episode, period AS t, AVG(demand) OVER w AS mean, STDDEV_SAMP(demand) OVER w AS dev FROM dp WINDOW w AS (PARTITION BY episode ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 cm AS (SELECT tt.episode, tt.t, 'none' AS h, LN(1 - 4 * {PRIOR}) AS l, {LEAD + 1} * mean AS mu, SQRT({LEAD + 1}) * dev AS sd FROM tt JOIN fo ON fo.episode = tt.episode AND fo.t = tt.t
 UNION ALL SELECT mo.episode, mo.t, mo.h, mass + LN(p), wmu, wsd FROM mo JOIN ev ON ev.episode = mo.episode AND ev.t = mo.t AND ev.h = mo.h
 UNION ALL SELECT lo.episode, lo.t, 'lead_time', mass + LN(p), ({LEAD + 1} + CASE WHEN lo.t >= s THEN shift ELSE 0 END) * mean, SQRT({LEAD + 1} + CASE WHEN lo.t >= s THEN shift ELSE 0 END) * dev FROM lo JOIN ev ON ev.episode = lo.episode AND ev.t = lo.t AND ev.h = 'lead_time' JOIN fo ON fo.episode = lo.episode AND fo.t = lo.t WHERE p >= 1e-6),
 cw AS (SELECT *, EXP(l - top) / SUM(EXP(l - top)) OVER (PARTITION BY episode, t) AS w FROM (SELECT *, MAX(l) OVER (PARTITION BY episode, t) AS top FROM cm))"""


@query("WITH RECURSIVE " + ", ".join([DP, SP, AR, PA, PP, HG, PO, LP, EV, sql_quantile("qu", "cw", "episode, t", LEVEL)]) + """ SELECT q.episode, q.t, ROUND(1 - (SELECT w FROM cw WHERE cw.episode = q.episode AND cw.t = q.t AND h = 'none'), 4) AS shock_mass, ARG_MAX(ev.h, {'a': mass, 'b': ev.h}) AS top, ROUND(ANY_VALUE(x), 2) AS target FROM qu q JOIN ev ON ev.episode = q.episode AND ev.t = q.t GROUP BY q.episode, q.t""")
def hedged_targets(spark, sf):
    panel, made = demand_panel(spark, sf), proposals(spark, sf)
    rows = made.join(running_forecast(panel, "demand", ["episode"]).withColumns({k: F.expr(v) for k, v in LLR.items()}), "episode")
    from pyspark.sql.window import Window

    later = Window.partitionBy("episode", "hypothesis").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("period") <= F.col("tau"), 0.0).when(F.col("hypothesis") == M.LEAD, 0.0).when(F.col("hypothesis") == "demand_down", F.col("down")).otherwise(F.col("up"))
    evidence = rows.withColumn("log_e", F.coalesce(F.sum(own).over(later), F.lit(0.0))).select("episode", "hypothesis", F.col("period").alias("t"), F.lit(PRIOR).alias("prior"), "log_e")
    forecasts = running_forecast(panel, "demand", ["episode"]).select("episode", F.col("period").alias("t"), F.lit(LEAD).alias("lead"), "mean", "sd")
    out = M.hedge(M.demand_posterior(panel, made, LIFETIME), M.lead_posterior(receipts(spark, sf), made, LIFETIME), evidence, forecasts, LEVEL)
    return out.select("episode", "t", F.round("shock_mass", 4).alias("shock_mass"), "top", F.round("target", 2).alias("target"))


OFFSETS, AROUND = (0, 10, 20), (-3, -2, -1, 0, 1)
# an order's landing: the first period whose clock, which pauses stop, is the order's clock and its lead time
LA = """ck AS (SELECT *, COALESCE(SUM(CASE WHEN pause THEN 0 ELSE 1 END) OVER (PARTITION BY episode ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clock FROM sp),
 la AS (SELECT o.episode, o.period, CASE WHEN MIN(u.period) IS NOT NULL THEN GREATEST(o.period, MIN(u.period)) END AS landing FROM ck o LEFT JOIN ck u ON u.episode = o.episode AND u.clock = o.clock + o.lead_time GROUP BY 1, 2)"""
ON = """on_ AS (SELECT episode, CAST(14 + episode % 9 AS INT) AS onset, CASE WHEN episode % 2 = 0 THEN 1.5::DOUBLE ELSE 0.6 END AS m, 3 AS duration FROM dp WHERE period = 1)"""
AFTER = "(SELECT MIN(z.landing) FROM la z WHERE z.episode = o.episode AND z.period >= onset + {k})"
SERVED = "CAST(CASE WHEN {at} IS NULL THEN 0 ELSE GREATEST(0, onset + 2 - GREATEST(onset, {at}) + 1) END AS INT)"
OWN = "(SELECT landing FROM la z WHERE z.episode = o.episode AND z.period = onset + {k})"


@query(with_(DP, SP, LA, ON) + "SELECT o.episode, onset, " + ", ".join(f"ROUND(m * (SELECT AVG(demand) FROM dp d WHERE d.episode = o.episode AND d.period < onset + {k}) / (500 * m), 6) AS ratio_{k}" for k in OFFSETS)
       + ", " + ", ".join(f"{OWN.format(k=k)} AS lands_{'m' if k < 0 else 'p'}{abs(k)}" for k in AROUND) + f", {SERVED.format(at=OWN.format(k=0))} AS own, {SERVED.format(at=AFTER.format(k=0))} AS any, {SERVED.format(at=OWN.format(k=-1))} AS own_before, (SELECT COUNT(landing) FROM la z WHERE z.episode = o.episode AND z.period BETWEEN onset AND onset + 2) AS landed, {OWN.format(k=3)} AS after FROM on_ o")
def mechanism_facts(spark, sf):
    """For each episode's shock: the level its forecast implies over the true one, where orders around the onset land, and how
    much of the shock orders can still serve."""
    panel, sp = demand_panel(spark, sf), supply_panel(spark, sf)
    onsets = panel.where("period = 1").select("episode", (14 + F.col("episode") % 9).cast("int").alias("onset"), F.when(F.col("episode") % 2 == 0, 1.5).otherwise(0.6).alias("multiplier")).withColumn("level", 500 * F.col("multiplier"))
    clock = X.landing_clock(supply.landing_with_pause(sp).join(sp.select("episode", "period"), ["episode", "period"], "right"))
    windows = onsets.select("episode", F.explode(F.array(F.col("onset"), F.col("onset") - 1)).alias("period"), F.col("onset").alias("first"), (F.col("onset") + 2).alias("last"))
    served = X.reach(clock, windows).groupBy("episode").agg(*[F.max(F.when((F.col("period") == F.col("first")) == at, F.col(c))).alias(n) for c, at, n in (("own", True, "own"), ("any", True, "any"), ("own", False, "own_before"))])
    ratios = X.implied_ratios(panel, onsets, OFFSETS)
    out = onsets.select("episode", "onset").join(ratios, "episode").join(X.landings_around(clock, onsets, AROUND), "episode").join(served, "episode").join(X.window_landings(clock, onsets, F.lit(3)), "episode")
    return out.withColumns({f"ratio_{k}": F.round(f"ratio_{k}", 6) for k in OFFSETS})


@query(with_(DP) + """SELECT episode, period, 'both' AS side, 'demand' AS differing FROM dp WHERE demand > 0 AND episode * 1000 + period >= 17 * 1000 + 40 ORDER BY episode, period LIMIT 1""")
def replay_difference(spark, sf):
    """A run and its replay, in which one episode differs from a period on: the first differing row, by their digest trees."""
    from quayside.plans.runtime import fresh_folder
    from quayside.sources import digests

    panel = demand_panel(spark, sf)
    changed = (F.col("demand") > 0) & (F.col("episode") * 1000 + F.col("period") >= 17 * 1000 + 40)
    left, right = fresh_folder(spark, "run"), fresh_folder(spark, "replay")
    bounds = digests.store_run(panel, left, "episode")
    digests.store_run(panel.withColumn("demand", F.when(changed, F.col("demand") + 1).otherwise(F.col("demand"))), right, "episode", bounds=bounds)
    return digests.first_difference(spark, left, right, ["episode", "period"]).withColumn("differing", F.array_join("differing", ","))
