"""Period records of three arms, their calls and facts, mapped onto the line table; as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.operators import pilot, supply
from quayside.plans.runtime import materialize
from quayside.plans.views import DP, SP, supply_panel

ARMS = (("arm1", 0), ("arm8", 5), ("arm10", 9))
FAMILIES = ("no_change", "demand_level", "temporary_pulse", "lead_time_shift", "shipment_loss", "compound")
CONDITIONS = ("none", "accurate", "delayed", "unreliable")
SHOCK, NEVER = 20, 64.0
WEIGHTS = [(f, c, round(0.1 + 0.05 * i + 0.02 * j, 4)) for i, f in enumerate(FAMILIES) for j, c in enumerate(CONDITIONS)]


def run_records(spark: SparkSession, sf: str) -> DataFrame:
    """episode, arm, family, direction, condition, period, demand, sold, lost, on_hand_end, active_family."""
    arms = spark.createDataFrame(list(ARMS), "arm string, k int")
    panel = supply.with_arrivals(supply_panel(spark, sf)).crossJoin(F.broadcast(arms))  # three arms
    panel = panel.withColumn("arrivals", F.col("arrivals") + F.when(F.col("k") > 0, F.col("demand") % F.when(F.col("k") > 0, F.col("k")).otherwise(1)).otherwise(0))
    path = supply.lost_sales_path(panel, ("episode", "arm"))
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    family = pick(FAMILIES, F.col("episode") % 6)
    direction = F.when(F.col("episode") % 12 == 1, "demand_up").otherwise("demand_down")
    live = (F.col("arm") == "arm10") & (F.col("period") > SHOCK) & (F.col("demand") % 5 == 0) & (F.col("demand") % 6 > 0)
    return path.select("episode", "arm", family.alias("family"), direction.alias("direction"), pick(CONDITIONS, F.floor(F.col("episode") / 6) % 4).alias("condition"), "period", "demand", "sold", "lost", "on_hand_end", F.when(live, pick(FAMILIES, F.col("demand") % 6)).alias("active_family"))


def run_calls(spark: SparkSession, sf: str) -> DataFrame:
    """episode, arm, period, attempt, outcome, usd, prompt: two attempts at every tenth period of two arms."""
    rows = run_records(spark, sf).where("arm <> 'arm1' and period % 10 = 0")
    rows = rows.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2)))).where("attempt = 1 or demand % 3 = 0")
    outcome = F.when((F.col("demand") + F.col("attempt")) % 7 == 0, "fallback").when(F.col("attempt") == 2, "repair").otherwise("accepted")
    return rows.select("episode", "arm", "period", "attempt", outcome.alias("outcome"), ((F.col("demand") % 50) / 1000).alias("usd"), (F.col("demand") % 40).alias("prompt"))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(pilot.episode_facts(materialize(run_records(spark, sf), "records"), F.lit(SHOCK), 4.0, 0.25), "facts")


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEIGHTS, "family string, condition string, weight double")


AR = "ar AS (SELECT episode, CAST(period + lead_time AS INT) AS period, CAST(SUM(ordered) AS BIGINT) AS arrivals FROM sp WHERE lead_time IS NOT NULL GROUP BY 1, 2)"
PA = "pa AS (SELECT sp.*, COALESCE(arrivals, 0) AS arrivals FROM sp LEFT JOIN ar USING (episode, period))"
AM = "am(arm, k) AS (VALUES " + ", ".join(f"('{a}', {k})" for a, k in ARMS) + ")"
PR = "pr AS (SELECT episode, arm, period, demand, arrivals + CASE WHEN k > 0 THEN demand % GREATEST(k, 1) ELSE 0 END AS arrivals FROM pa, am)"
L2 = """l2 AS (SELECT episode, arm, period, demand, CAST(GREATEST(0, arrivals - demand) AS BIGINT) AS on_hand_end, CAST(LEAST(demand, arrivals) AS BIGINT) AS sold FROM pr WHERE period = 1
 UNION ALL SELECT p.episode, p.arm, p.period, p.demand, CAST(GREATEST(0, l.on_hand_end + p.arrivals - p.demand) AS BIGINT), CAST(LEAST(p.demand, l.on_hand_end + p.arrivals) AS BIGINT) FROM l2 l JOIN pr p ON p.episode = l.episode AND p.arm = l.arm AND p.period = l.period + 1)"""
NAMES = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
RR = f"""rr AS (SELECT episode, arm, {NAMES(FAMILIES)}[episode % 6 + 1] AS family, CASE WHEN episode % 12 = 1 THEN 'demand_up' ELSE 'demand_down' END AS direction, {NAMES(CONDITIONS)}[(episode // 6) % 4 + 1] AS condition, period, demand, sold, demand - sold AS lost, on_hand_end,
 CASE WHEN arm = 'arm10' AND period > {SHOCK} AND demand % 5 = 0 AND demand % 6 > 0 THEN {NAMES(FAMILIES)}[demand % 6 + 1] END AS active_family FROM l2)"""
RC = """rc AS (SELECT episode, arm, period, attempt, CASE WHEN (demand + attempt) % 7 = 0 THEN 'fallback' WHEN attempt = 2 THEN 'repair' ELSE 'accepted' END AS outcome, (demand % 50) / 1000 AS usd, demand % 40 AS prompt
 FROM rr, (SELECT UNNEST([1, 2]) AS attempt) WHERE arm <> 'arm1' AND period % 10 = 0 AND (attempt = 1 OR demand % 3 = 0))"""
FC = f"""re AS (SELECT episode, arm, MIN(period) FILTER (ok AND period >= {SHOCK}) - {SHOCK} AS recovery FROM (SELECT episode, arm, period, MIN(fill) OVER w >= 0.95 AND COUNT(*) OVER w = 3 AS ok FROM (SELECT episode, arm, period, CASE WHEN demand > 0 THEN sold / demand ELSE 1 END AS fill FROM rr)
 WINDOW w AS (PARTITION BY episode, arm ORDER BY period ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) GROUP BY 1, 2),
 ex AS (SELECT rr.episode, rr.arm, AVG(on_hand_end) AS excess FROM rr JOIN re ON re.episode = rr.episode AND re.arm = rr.arm WHERE recovery IS NOT NULL AND period >= {SHOCK} + recovery GROUP BY 1, 2),
 sk AS (SELECT episode, arm, CAST(MAX(n) AS BIGINT) AS streak FROM (SELECT episode, arm, b, SUM(f) AS n FROM (SELECT episode, arm, f, SUM(1 - f) OVER (PARTITION BY episode, arm ORDER BY period) AS b FROM (SELECT episode, arm, period, CASE WHEN lost > 0 THEN 1 ELSE 0 END AS f FROM rr)) GROUP BY 1, 2, 3) GROUP BY 1, 2),
 fs AS (SELECT episode, arm, ANY_VALUE(family) AS family, ANY_VALUE(condition) AS condition, ANY_VALUE(direction) AS direction, CAST(4 * SUM(sold) AS DOUBLE) AS profit, 0.25 * CAST(SUM(on_hand_end) AS DOUBLE) AS holding_cost, CAST(SUM(lost) AS BIGINT) AS lost, CAST(SUM(demand) AS BIGINT) AS demand, CAST(SUM(sold) AS BIGINT) AS sold,
 BOOL_OR(active_family IS NOT NULL) AS active, AVG(CASE WHEN active_family <> family THEN 1.0 ELSE 0.0 END) AS wrong FROM rr GROUP BY 1, 2),
 fc AS (SELECT fs.*, streak, recovery, excess, family = 'no_change' AS is_null, CASE WHEN demand > 0 THEN sold / demand ELSE 1 END AS fill, CASE WHEN family <> 'no_change' THEN wrong END AS exposure FROM fs JOIN sk USING (episode, arm) JOIN re USING (episode, arm) LEFT JOIN ex USING (episode, arm))"""
WT = "wt(family, condition, weight) AS (VALUES " + ", ".join(f"('{f}', '{c}', {w}::DOUBLE)" for f, c, w in WEIGHTS) + ")"
RECORDS = "WITH RECURSIVE " + ", ".join([DP, SP, AR, PA, AM, PR, L2, RR, RC])
FACTS = RECORDS + ", " + ", ".join([FC, WT])
