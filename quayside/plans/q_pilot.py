"""Queries over period records and pilots, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.operators import checks as K
from quayside.operators import pilot as P
from quayside.plans.q_evaluation import TAIL, rounded
from quayside.plans.records_view import FACTS, NEVER, facts, run_calls, run_records, weights

QUERIES, SQL = {}, {}
Z = P.Z


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(FACTS + " SELECT episode, arm, profit, ROUND(holding_cost, 4) AS holding_cost, lost, ROUND(fill, 6) AS fill, streak, recovery, ROUND(excess, 6) AS excess, active, ROUND(exposure, 6) AS exposure FROM fc")
def episode_operational(spark, sf):
    return rounded(facts(spark, sf).select("episode", "arm", "profit", "holding_cost", "lost", "fill", "streak", "recovery", "excess", "active", "exposure"), 6)


CV = "cv AS (SELECT arm, AVG(profit) AS cvar FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY arm ORDER BY profit, episode) AS r, COUNT(*) OVER (PARTITION BY arm) AS n FROM fc) WHERE r <= CEIL(n * 0.1) GROUP BY arm)"
LONG = " UNION ALL ".join(f"SELECT arm, '{m}' AS metric, AVG({c})::DOUBLE AS value, COUNT({c}) AS n FROM fc GROUP BY arm" for m, c in (("fill_rate", "fill"), ("lost_sales_units", "lost"), ("holding_cost", "holding_cost"), ("max_stockout_streak", "streak"), ("time_to_recovery", "recovery"), ("post_recovery_excess_inventory", "excess")))


@query(FACTS + f", {CV} SELECT arm, metric, ROUND(value, 4) AS value, n FROM (SELECT arm, 'cvar10_profit' AS metric, cvar AS value, (SELECT COUNT(*) FROM fc WHERE fc.arm = cv.arm) AS n FROM cv UNION ALL SELECT arm, 'worst_decile_profit', MIN(profit), COUNT(*) FROM fc GROUP BY arm UNION ALL {LONG}) WHERE n > 0")
def operational_summaries(spark, sf):
    return rounded(P.operational_summaries(facts(spark, sf)), 4)


@query(FACTS + " SELECT arm, ROUND(AVG(fill), 6) AS overall, ROUND(AVG(fill) FILTER (NOT is_null), 6) AS shocked, ROUND(AVG(fill) FILTER (is_null), 6) AS \"null\" FROM fc GROUP BY arm")
def fill_by_arm(spark, sf):
    return rounded(P.fill_by_arm(facts(spark, sf)), 6)


HR = """hk AS (SELECT *, CASE WHEN family = 'no_change' THEN NULL WHEN family = 'demand_level' THEN family || ':' || direction ELSE family END AS key FROM fc),
 hp AS (SELECT key, arm, episode, profit FROM hk WHERE key IS NOT NULL AND arm IN ('arm8', 'arm1') AND episode IN (SELECT episode FROM hk WHERE arm = 'arm8') AND episode IN (SELECT episode FROM hk WHERE arm = 'arm1')),
 hr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY key, arm ORDER BY profit, episode) <= CEIL(COUNT(*) OVER (PARTITION BY key, arm) * 0.1) AS low FROM hp),
 hm AS (SELECT key, AVG(profit) FILTER (arm = 'arm8') AS t, AVG(profit) FILTER (arm = 'arm1') AS c, AVG(profit) FILTER (arm = 'arm8' AND low) AS tc, AVG(profit) FILTER (arm = 'arm1' AND low) AS cc FROM hr GROUP BY key),
 hl AS (SELECT key, (t - c) / ABS(c) AS raw_lift, (tc - cc) / ABS(cc) AS cvar_lift FROM hm)"""


@query(FACTS + f", {HR} SELECT key, ROUND(raw_lift, 6) AS raw_lift, ROUND(cvar_lift, 6) AS cvar_lift, raw_lift >= 0.05 OR cvar_lift >= 0.10 AS passes FROM hl")
def headroom_lifts(spark, sf):
    return rounded(P.headroom_lifts(facts(spark, sf), "arm8", "arm1"), 6)


H4 = HR.replace("FROM fc)", "FROM fc, (SELECT UNNEST([1, 2, 3, 4]) AS copy))", 1).replace("SELECT key, arm, episode, profit FROM hk", "SELECT key, arm, episode, copy, profit FROM hk").replace("ORDER BY profit, episode", "ORDER BY profit, episode, copy")


@query(FACTS + f", {H4} SELECT key, ROUND(raw_lift, 6) AS raw_lift, ROUND(cvar_lift, 6) AS cvar_lift, raw_lift >= 0.05 OR cvar_lift >= 0.10 AS passes FROM hl")
def headroom_replicated(spark, sf):
    return rounded(P.replicated_rule(facts(spark, sf), "arm8", "arm1"), 6)


def metrics(spark, sf):
    return P.pilot_metrics(facts(spark, sf), run_calls(spark, sf), weights(spark), treatment="arm10", base="arm1", oracle="arm8", detector="arm8", call_budget=12, never_recovered=NEVER)


def sql_mean(name: str, value: str, source: str) -> str:
    return f"SELECT '{name}' AS metric, AVG(v) AS estimate, AVG(v) - COALESCE({Z} * STDDEV_SAMP(v) / SQRT(COUNT(*)), 0) AS low, AVG(v) + COALESCE({Z} * STDDEV_SAMP(v) / SQRT(COUNT(*)), 0) AS high, COUNT(*) AS n FROM (SELECT CAST({value} AS DOUBLE) AS v FROM {source}) WHERE v IS NOT NULL HAVING COUNT(*) > 0"


def sql_strata(name: str, treatment: str, control: str, endpoint: str) -> str:
    return f"""SELECT '{name}', SUM(weight * m) / SUM(weight), SUM(weight * m) / SUM(weight) - {Z} * SQRT(SUM(weight * weight * v / n) / (SUM(weight) * SUM(weight))), SUM(weight * m) / SUM(weight) + {Z} * SQRT(SUM(weight * weight * v / n) / (SUM(weight) * SUM(weight))), CAST(SUM(n) AS BIGINT)
 FROM (SELECT t.family, t.condition, AVG(t.{endpoint} - c.{endpoint}) AS m, COALESCE(VAR_SAMP(t.{endpoint} - c.{endpoint}), 0) AS v, COUNT(*) AS n FROM fc t JOIN fc c ON c.episode = t.episode WHERE t.arm = '{treatment}' AND c.arm = '{control}' GROUP BY 1, 2) JOIN wt USING (family, condition)"""


MX = f"""my AS (SELECT *, COALESCE((SELECT COUNT(*) FROM rc WHERE rc.arm = 'arm10' AND rc.episode = fc.episode), 0) AS calls FROM fc WHERE arm = 'arm10'), pf AS (SELECT episode, period, ARG_MAX(outcome, attempt) = 'fallback' AS failed FROM rc WHERE arm = 'arm10' GROUP BY 1, 2),
 pe AS (SELECT episode, AVG(CAST(failed AS INT)) AS v FROM pf GROUP BY 1), cp AS (SELECT arm, AVG(profit) AS reward, COALESCE((SELECT SUM(usd) FROM rc WHERE rc.arm = fc.arm), 0) AS budget FROM fc GROUP BY arm), {HR},
 mt AS ({sql_mean('fill_rate_floor', 'fill', 'my')} UNION ALL {sql_mean('false_activation_rate', 'CASE WHEN is_null THEN CAST(active AS INT) END', 'my')} UNION ALL {sql_mean('false_activation_control', 'CASE WHEN is_null THEN 1 - CAST(active AS INT) END', 'my')}
 UNION ALL {sql_mean('wrong_family_exposure', 'exposure', 'my')} UNION ALL {sql_mean('wrong_family_activation_rate', 'CAST(exposure > 0 AS INT)', 'my')} UNION ALL {sql_mean('recovery_time', f'CASE WHEN NOT is_null THEN COALESCE(recovery, {NEVER}) END', 'my')} UNION ALL {sql_mean('budget_overrun_rate', 'CAST(calls > 12 AS INT)', 'my')}
 UNION ALL SELECT 'parser_failure_rate', (SELECT AVG(CAST(failed AS INT)) FROM pf), low, high, n FROM ({sql_mean('x', 'v', 'pe')}) UNION ALL {sql_strata('profit_lift', 'arm10', 'arm1', 'profit')} UNION ALL {sql_strata('negative_profit_lift', 'arm10', 'arm1', 'profit')} UNION ALL {sql_strata('lost_sales_reduction', 'arm1', 'arm10', 'lost')}
 UNION ALL {sql_mean('detector_indistinguishable', 't.profit - c.profit', "fc t JOIN fc c ON c.episode = t.episode WHERE t.arm = 'arm10' AND c.arm = 'arm8'")}
 UNION ALL SELECT 'cost_frontier', MAX(CASE WHEN arm = 'arm10' THEN 1.0 ELSE 0.0 END), NULL, NULL, 1 FROM (SELECT *, MAX(reward) OVER (ORDER BY budget, reward DESC, arm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM cp) WHERE best IS NULL OR reward > best
 UNION ALL SELECT 'insufficient_headroom', COUNT(*) FILTER (raw_lift >= 0.05 OR cvar_lift >= 0.10), NULL, NULL, COUNT(*) FROM hl)"""


@query(FACTS + f", {MX} SELECT metric, ROUND(estimate, 5) AS estimate, ROUND(low, 5) AS low, ROUND(high, 5) AS high, n FROM mt")
def pilot_metrics(spark, sf):
    return rounded(metrics(spark, sf), 5)


CRITERIA = [("profit_lift", "go", ">=", 0.0), ("lost_sales_reduction", "go", ">", 0.0), ("fill_rate_floor", "go", ">=", 0.2), ("false_activation_control", "go", ">=", 0.9), ("wrong_family_exposure", "kill", ">", 0.5), ("cost_frontier", "kill", "<", 1.0), ("unmeasured", "go", ">", 0.0)]
CR = "cr(name, kind, operator, threshold) AS (VALUES " + ", ".join(f"('{n}', '{k}', '{o}', {t}::DOUBLE)" for n, k, o, t in CRITERIA) + ")"


def criteria(spark):
    return spark.createDataFrame(CRITERIA, "name string, kind string, operator string, threshold double")


VD = "vd AS (SELECT name, kind, COALESCE(CASE operator WHEN '>=' THEN COALESCE(low, estimate) >= threshold WHEN '>' THEN COALESCE(low, estimate) > threshold WHEN '<' THEN COALESCE(high, estimate) < threshold END, false) AS met FROM cr LEFT JOIN mt ON metric = name)"


@query(FACTS + f", {MX}, {CR}, {VD} SELECT name, kind, met FROM vd")
def pilot_criteria(spark, sf):
    return K.verdicts(criteria(spark), metrics(spark, sf).withColumnRenamed("metric", "name"))


@query(FACTS + f", {MX}, {CR}, {VD} SELECT CASE WHEN BOOL_OR(met AND kind = 'kill') THEN 'kill' WHEN BOOL_AND(met OR kind <> 'go') THEN 'go' ELSE 'hold' END AS decision FROM vd")
def pilot_decision(spark, sf):
    return K.decision(K.verdicts(criteria(spark), metrics(spark, sf).withColumnRenamed("metric", "name")))


@query(FACTS + f", {MX}, {CR} SELECT name, kind, CASE WHEN estimate IS NULL THEN 'no estimate' ELSE 'no interval' END AS fault FROM cr LEFT JOIN mt ON metric = name WHERE estimate IS NULL OR (kind = 'go' AND NOT COALESCE(low <= high, false))")
def pilot_metric_faults(spark, sf):
    return P.metric_faults(criteria(spark), metrics(spark, sf))


@query(FACTS + " SELECT 'units' AS fault, CAST(COUNT(DISTINCT episode) AS VARCHAR) AS detail FROM fc HAVING COUNT(DISTINCT episode) NOT BETWEEN 100 AND 150 UNION ALL SELECT 'unpaired', CAST(episode AS VARCHAR) FROM fc GROUP BY episode HAVING COUNT(DISTINCT arm) < 3 UNION ALL SELECT 'empty stratum', family || '/' || condition FROM wt WHERE NOT EXISTS (SELECT 1 FROM fc WHERE fc.family = wt.family AND fc.condition = wt.condition)")
def pilot_record_faults(spark, sf):
    return P.record_faults(facts(spark, sf), 100, 150, ["arm1", "arm8", "arm10"], weights(spark))


MEMBERS = [("profit_10_1", "arm10", "arm1", "profit"), ("profit_8_1", "arm8", "arm1", "profit"), ("lost_10_8", "arm10", "arm8", "lost")]


def sql_member(name: str, t: str, c: str, endpoint: str) -> str:
    d = f"(SELECT t.family, t.condition, CAST(t.{endpoint} - c.{endpoint} AS DOUBLE) AS d FROM fc t JOIN fc c ON c.episode = t.episode WHERE t.arm = '{t}' AND c.arm = '{c}')"
    flips = f"(SELECT CASE WHEN MIN(d) = MAX(d) THEN CASE WHEN AVG(d) = 0 THEN 1.0 ELSE 0.0 END ELSE LEAST(1.0, 2 * {TAIL.replace('z', 'ABS(AVG(d) / (STDDEV_SAMP(d) / SQRT(COUNT(*))))')}) END FROM {d})"
    ranks = f"(SELECT LEAST(1.0, 2 * {TAIL}) FROM (SELECT ABS((w - n * (n + 1) / 4) / SQRT(n::DOUBLE * (n + 1) * (2 * n + 1) / 24)) AS z FROM (SELECT COUNT(*) AS n, SUM(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w FROM (SELECT d, RANK() OVER (ORDER BY ABS(d)) + (COUNT(*) OVER (PARTITION BY ABS(d)) - 1) / 2 AS rk FROM {d} WHERE d <> 0))))"
    return sql_strata(name, t, c, endpoint).replace("SELECT '" + name + "',", f"SELECT '{name}' AS member,", 1).replace(", CAST(SUM(n) AS BIGINT)", f", CAST(SUM(n) AS BIGINT), {flips}, {ranks}", 1)


CT = "ct(member, estimate, low, high, n, p, w) AS (" + " UNION ALL ".join(sql_member(*m) for m in MEMBERS) + ")"


@query(FACTS + f", {CT} SELECT member, ROUND(estimate, 4) AS estimate, ROUND(low, 4) AS low, ROUND(high, 4) AS high, n, ROUND(p, 5) AS randomization_p, ROUND(w, 5) AS wilcoxon_p, ROUND(LEAST(1.0, MAX((m - r + 1) * p) OVER (ORDER BY p, member)), 5) AS holm_p, MIN(CASE WHEN p <= 0.05 / (m - r + 1) THEN 1 ELSE 0 END) OVER (ORDER BY p, member) = 1 AS rejected FROM (SELECT *, COUNT(*) OVER () AS m, ROW_NUMBER() OVER (ORDER BY p, member) AS r FROM ct)")
def confirmatory_table(spark, sf):
    table = P.confirmatory_table(facts(spark, sf).withColumn("unit", F.col("episode")), MEMBERS, weights(spark), ["family", "condition"])
    table = table.withColumns({c: F.round(c, 5) for c in ("randomization_p", "wilcoxon_p", "holm_p")})
    return table.withColumns({c: F.round(c, 4) for c in ("estimate", "low", "high")})


@query(FACTS + " SELECT episode, arm, ARG_MAX(outcome, attempt) AS last, COUNT(*) AS attempts, period FROM rc GROUP BY episode, arm, period")
def proposal_attempts(spark, sf):
    return run_calls(spark, sf).groupBy("episode", "arm", "period").agg(F.max_by("outcome", "attempt").alias("last"), F.count("*").alias("attempts"))


@query(FACTS + " SELECT arm, episode, COUNT(*) AS periods, COUNT(active_family) AS active_periods FROM rr GROUP BY 1, 2")
def active_periods(spark, sf):
    return run_records(spark, sf).groupBy("arm", "episode").agg(F.count("*").alias("periods"), F.count("active_family").alias("active_periods"))


@query(None)
def exposure_ratio(spark, sf):
    """Lost units of one arm over another's, with an interval over episodes."""
    from quayside.operators import resampling

    side = lambda arm: F.sum(F.when(F.col("arm") == arm, F.col("lost")))
    wide = facts(spark, sf).groupBy("episode").agg(side("arm10").alias("a"), side("arm1").alias("b"))
    return rounded(resampling.ratio_interval(wide, "a", "b", "episode"), 6)


@query(None)
def frontier_membership(spark, sf):
    from quayside.operators import resampling

    cost = run_calls(spark, sf).groupBy("episode", "arm").agg(F.sum("usd").alias("cost"))
    units = facts(spark, sf).select("episode", "arm", F.col("profit").alias("reward")).join(cost, ["episode", "arm"], "left").withColumn("cost", F.coalesce("cost", F.lit(0.0)))
    return resampling.frontier_membership(units, ["arm1", "arm8", "arm10"], "arm10", "episode")


@query(None)
def headroom_interval(spark, sf):
    """2,000 redraws of the episodes of each family: the interval of how many families pass the lift rule."""
    from quayside.operators import tails

    return tails.lift_interval(P.headroom_pairs(facts(spark, sf), "arm8", "arm1"), 2_000)


@query(None)
def headroom_distribution(spark, sf):
    """10,000 redraws of seeds, of which each has several episodes: how many families pass, with shares."""
    from quayside.operators import tails

    seeds = facts(spark, sf).withColumn("seed", F.floor(F.col("episode") / 12))
    return tails.lift_distribution(P.headroom_pairs(seeds, "arm8", "arm1", "seed"), 10_000)


@query(None)
def pilot_intervals(spark, sf):
    """The metrics of a pilot with an interval of each, the frontier's and the lift rule's by 2,000 redraws of episodes."""
    return rounded(P.pilot_metrics(facts(spark, sf), run_calls(spark, sf), weights(spark), treatment="arm10", base="arm1", oracle="arm8", detector="arm8", call_budget=12, never_recovered=NEVER, draws=2_000), 5)
