"""Adapter views: the engine's episode, period and call tables mapped onto the star-schema tables.

Each view is defined twice, as a DataFrame and as a SQL common table expression, for comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quayside.plans.runtime import table

#: Episodes of a small table, and lines to an episode of a large one.
EPISODES, LINES = 50, 24_000


def money(column: str):
    """Money sums exactly as decimals, so that no order of addition shows."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def episode_results(spark: SparkSession, sf: str) -> DataFrame:
    """unit, arm, family, condition, profit, demand, lost, sold: one row per unit and arm."""
    orders, customer, nation = (table(spark, sf, n) for n in ("orders", "customer", "nation"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
    grouped = rows.groupBy(F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("arm"), F.col("c_mktsegment").alias("family"), F.col("n_regionkey").alias("condition"))
    return grouped.agg(money("o_totalprice").alias("profit"), F.count("*").alias("demand"), F.count_if(F.col("o_orderstatus") == "F").alias("lost")).withColumn("sold", F.col("demand") - F.col("lost"))


ER = """er AS (SELECT *, demand - lost AS sold FROM (SELECT o_custkey AS unit, o_orderpriority AS arm, c_mktsegment AS family, n_regionkey AS condition,
 CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS profit, COUNT(*) AS demand, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS lost
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4))"""


def demand_panel(spark: SparkSession, sf: str) -> DataFrame:
    """episode, period, demand: quantities of each month from the first to the last that has any, gaps filled with zero.

    Episodes are parts modulo their number, which grows with the table.
    """
    lines = table(spark, sf, "lineitem")
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    bounds = lines.agg(F.greatest(F.lit(EPISODES), F.floor(F.count("*") / LINES)).alias("episodes"), F.min(month).alias("first"), F.max(month).alias("last"))  # one row
    keyed = lines.join(F.broadcast(bounds)).select((F.col("l_partkey") % F.col("episodes")).alias("episode"), (month - F.col("first") + 1).cast("int").alias("period"), F.col("l_quantity").cast("long").alias("q"))
    seen = keyed.groupBy("episode", "period").agg(F.sum("q").alias("demand"))
    grid = bounds.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("episodes") - 1)).alias("episode"), "first", "last")
    grid = grid.select("episode", F.explode(F.sequence(F.lit(1), F.col("last") - F.col("first") + 1)).alias("period"))
    return grid.join(seen, ["episode", "period"], "left").select("episode", "period", F.coalesce("demand", F.lit(0)).alias("demand"))


LB = f"(SELECT GREATEST({EPISODES}, COUNT(*) // {LINES}) AS episodes, MIN(year(l_shipdate) * 12 + month(l_shipdate)) AS first, MAX(year(l_shipdate) * 12 + month(l_shipdate)) AS last FROM lineitem)"
DP = f"""dp AS (SELECT g.episode, g.period, COALESCE(s.demand, 0) AS demand FROM (SELECT episode, CAST(UNNEST(RANGE(1, last - first + 2)) AS INT) AS period FROM (SELECT UNNEST(RANGE(episodes)) AS episode, first, last FROM {LB})) g
 LEFT JOIN (SELECT l_partkey % episodes AS episode, year(l_shipdate) * 12 + month(l_shipdate) - first + 1 AS period, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS demand FROM lineitem, {LB} GROUP BY 1, 2) s
 ON g.episode = s.episode AND g.period = s.period)"""
LAST = "(SELECT MAX(period) FROM dp)"


def supply_panel(spark: SparkSession, sf: str) -> DataFrame:
    """episode, period, lead_time (null: lost), pause, ordered: the order placed is the demand of the period before."""
    panel = demand_panel(spark, sf)
    ordered = F.coalesce(F.lag("demand").over(Window.partitionBy("episode").orderBy("period")), F.lit(0))
    rows = panel.withColumn("ordered", ordered)
    lost = (F.col("demand") % 17 == 0) & (F.col("demand") > 0)
    return rows.select("episode", "period", "demand", "ordered", F.when(~lost, F.col("demand") % 4).alias("lead_time"), (F.col("demand") % 11 == 0).alias("pause"))


SP = """sp AS (SELECT episode, period, demand, COALESCE(LAG(demand) OVER (PARTITION BY episode ORDER BY period), 0) AS ordered,
 CASE WHEN NOT (demand % 17 = 0 AND demand > 0) THEN demand % 4 END AS lead_time, demand % 11 = 0 AS pause FROM dp)"""


def call_log(spark: SparkSession, sf: str) -> DataFrame:
    """arm, episode, period, call_id, latency, tokens, attempt, outcome, charged: events as a call ledger."""
    events = table(spark, sf, "events")
    period = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    tokens = F.get_json_object("props", "$.k").cast("long")
    outcome = F.when(F.col("event_type") == "error", "refusal").when(tokens % 7 == 0, "repair").otherwise("accepted")
    return events.select(F.col("event_type").alias("arm"), F.col("user_id").alias("episode"), period.alias("period"), F.col("event_id").alias("call_id"), F.col("value").alias("latency"), tokens.alias("tokens"), (F.col("event_id") % 2).alias("attempt"), outcome.alias("outcome"), (tokens % 5 != 0).alias("charged"))


CL = """cl AS (SELECT event_type AS arm, user_id AS episode, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS period, event_id AS call_id, value AS latency,
 CAST(props->>'$.k' AS BIGINT) AS tokens, event_id % 2 AS attempt, CASE WHEN event_type = 'error' THEN 'refusal' WHEN CAST(props->>'$.k' AS BIGINT) % 7 = 0 THEN 'repair' ELSE 'accepted' END AS outcome,
 CAST(props->>'$.k' AS BIGINT) % 5 <> 0 AS charged FROM events)"""


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """item, a, b: two raters' marks."""
    return table(spark, sf, "labels").select(F.col("doc_id").alias("item"), F.col("quality").alias("a"), F.col("toxic").alias("b"))


RT = "rt AS (SELECT doc_id AS item, quality AS a, toxic AS b FROM labels)"


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "
