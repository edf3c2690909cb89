"""Queries over texts, specs, pools and constraints, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.functions import specs as G
from quayside.functions import text as X
from quayside.operators import checks as K
from quayside.operators import evaluation as E
from quayside.operators import generate as N
from quayside.operators import panel as P
from quayside.plans.q_evaluation import T, C, rounded
from quayside.plans.runtime import table
from quayside.plans.views import CL, DP, ER, call_log, demand_panel, episode_results, with_

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# one alert text per event, from its fields
AL = f"al AS (SELECT event_id, CONCAT('Alert ', event_id, ': ', event_type, ' for ', CAST(FLOOR(value) AS INT), ' days at period ', user_id, CASE WHEN event_id % 5 = 0 THEN ', possible shipment loss' WHEN event_id % 5 = 1 THEN ', demand surge ahead' WHEN event_id % 5 = 2 THEN ', supplier delay' WHEN event_id % 5 = 3 THEN ', up by 20% or 1.5 times' ELSE '' END) AS text FROM events)"


def alerts(spark, sf):
    e = F.col("event_id") % 5
    tail = F.when(e == 0, ", possible shipment loss").when(e == 1, ", demand surge ahead").when(e == 2, ", supplier delay").when(e == 3, ", up by 20% or 1.5 times").otherwise("")
    text = F.concat(F.lit("Alert "), F.col("event_id"), F.lit(": "), F.col("event_type"), F.lit(" for "), F.floor("value").cast("int"), F.lit(" days at period "), F.col("user_id"), tail)
    return table(spark, sf, "events").select("event_id", text.alias("text"))


RULES = [("shipment_loss", ("loss", "lost")), ("demand_level", ("surge", "spike")), ("lead_time_shift", ("delay", "late"))]


@query(with_(AL) + """SELECT event_id, 'exact_multiplier' AS rule, UNNEST(REGEXP_EXTRACT_ALL(text, '(?i)(?:^|\\W)(\\d+(?:\\.\\d+)?\\s*%|\\d+(?:\\.\\d+)?\\s*(?:x\\b|×|times\\b|percent\\b)|\\d+\\.\\d+\\b|half\\b)', 1)) AS match FROM al
 UNION ALL SELECT event_id, 'latent_family', UNNEST(REGEXP_EXTRACT_ALL(text, '(?i)\\b(?:demand[_\\s-]+level|temporary[_\\s-]+pulse|lead[_\\s-]+time[_\\s-]+shift|shipment[_\\s-]+loss|transit[_\\s-]+pause|compound|no[_\\s-]+change|level[_\\s-]+shift)\\b')) FROM al
 UNION ALL SELECT event_id, 'exact_onset', UNNEST(REGEXP_EXTRACT_ALL(text, '(?i)\\b(?:period|week|day|step)\\s*(?:#\\s*)?\\d+\\b|\\bt\\s*=\\s*\\d+\\b')) FROM al
 UNION ALL SELECT event_id, 'exact_duration', UNNEST(REGEXP_EXTRACT_ALL(text, '(?i)\\b(?:for|lasting|lasts|duration(?:\\s+of)?)\\s+(?:exactly\\s+)?(?:\\d+(?:\\.\\d+)?|one|two|three|four|five|six|seven|eight|nine|ten)\\s+(?:periods?|weeks?|days?|steps?)\\b')) FROM al""")
def leakage_scan(spark, sf):
    return X.leakage(alerts(spark, sf), "event_id", "text")


@query(with_(AL) + "SELECT event_id, CASE WHEN LOWER(text) LIKE '%loss%' OR LOWER(text) LIKE '%lost%' THEN 'shipment_loss' WHEN LOWER(text) LIKE '%surge%' OR LOWER(text) LIKE '%spike%' THEN 'demand_level' WHEN LOWER(text) LIKE '%delay%' OR LOWER(text) LIKE '%late%' THEN 'lead_time_shift' END AS family FROM al")
def keyword_parse(spark, sf):
    return alerts(spark, sf).select("event_id", X.first_class(F.col("text"), RULES).alias("family"))


@query(with_(AL) + """SELECT event_id, REGEXP_REPLACE(text, '[^\\s]', 'x', 'g') AS masked, SUBSTR(REPEAT('no further information ', 20), 1, LENGTH(text)) AS neutral,
 (SELECT STRING_AGG(w, ' ' ORDER BY SHA256('7/' || i || '/' || w), w) FROM (SELECT UNNEST(STRING_SPLIT(text, ' ')) AS w, UNNEST(RANGE(LEN(STRING_SPLIT(text, ' ')))) AS i)) AS shuffled FROM al""")
def content_controls(spark, sf):
    text = F.col("text")
    return alerts(spark, sf).select("event_id", X.masked(text).alias("masked"), X.neutral(text).alias("neutral"), X.hash_shuffled(text, 7).alias("shuffled"))


@query(with_(DP, "pr AS (SELECT episode, 'history to 24' || CHR(10) || STRING_AGG('t=' || period || ' demand=' || demand, CHR(10) ORDER BY period) AS prompt FROM dp WHERE period <= 24 GROUP BY 1)") + "SELECT episode, prompt, SHA256(prompt) AS prompt_hash FROM pr")
def prompt_render(spark, sf):
    return X.history_prompt(demand_panel(spark, sf), ["episode"], 24)


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_field_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, '{\"k\": ' || (props->>'$.k') || '}' AS payload FROM events")
def json_payload_extract(spark, sf):
    fenced = F.concat(F.lit("Answer {draft\n```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", X.json_payload(fenced).alias("payload"))


EID = "'test/f' || (o_custkey % 7) || '/s' || o_orderkey || '/' || CASE WHEN o_orderstatus = 'F' THEN 'accurate__twin' ELSE 'none' END"


@query(f"SELECT o_orderkey AS seed, CAST(REGEXP_EXTRACT(id, 'f(\\d+)/', 1) AS INT) AS family, REGEXP_EXTRACT(id, '/([a-z]+)(__twin)?$', 1) AS condition, id LIKE '%\\_\\_twin' ESCAPE '\\' AS twin FROM (SELECT o_orderkey, {EID} AS id FROM orders)")
def episode_id_parse(spark, sf):
    o = table(spark, sf, "orders")
    eid = F.concat(F.lit("test/f"), F.col("o_custkey") % 7, F.lit("/s"), F.col("o_orderkey"), F.lit("/"), F.when(F.col("o_orderstatus") == "F", "accurate__twin").otherwise("none"))
    part = lambda k: F.regexp_extract(eid, r"^([a-z]+)/f(\d+)/s(\d+)/([a-z]+)(__twin)?$", k)
    return o.select(part(3).cast("long").alias("seed"), part(2).cast("int").alias("family"), part(4).alias("condition"), (part(5) != "").alias("twin"))


GRID = "gr AS (SELECT m, l_eff, gamma FROM (SELECT UNNEST([0.6, 0.75, 1.0, 1.25, 1.5, 2.0]::DOUBLE[]) AS m), (SELECT UNNEST([1, 2, 3, 4]) AS l_eff), (SELECT UNNEST([0.0, 0.5, 1.0]::DOUBLE[]) AS gamma))"


@query(with_(GRID) + """SELECT m, l_eff, gamma, CASE WHEN d IS NOT NULL AND s IS NOT NULL THEN 'compound_' || d || '_' || s ELSE COALESCE(d, s, 'stationary') END AS predictive_model FROM (SELECT *, CASE WHEN m > 1 THEN 'demand_up' WHEN m < 1 THEN 'demand_down' END AS d,
 CASE WHEN l_eff > 1 AND gamma = 1 THEN 'lead_time_delay' WHEN l_eff = 1 AND gamma < 1 THEN 'shipment_loss' WHEN l_eff > 1 AND gamma < 1 THEN 'transit_stall' END AS s FROM gr)""")
def control_grid(spark, sf):
    return G.control_grid(spark)


RG = "rg(family, stream, signature, direction) AS (VALUES " + ", ".join(str(r) for r in G.REGISTRY) + ")"
SPEC = "sc AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'demand_level' WHEN 1 THEN 'shipment_loss' ELSE 'compound' END AS family, CASE WHEN event_id % 2 = 0 THEN 'demand' ELSE 'arrival' END AS stream, CASE WHEN event_id % 4 < 2 THEN 'sig_demand_level_up' ELSE 'sig_arrival_loss' END AS signature, CASE WHEN event_id % 2 = 0 THEN 'demand_up' ELSE 'arrival_interrupted' END AS direction FROM events)"


@query(with_(RG, SPEC) + "SELECT family, COUNT(*) AS n FROM sc WHERE NOT EXISTS (SELECT 1 FROM rg WHERE rg.family = sc.family AND rg.stream = sc.stream AND rg.signature = sc.signature AND rg.direction = sc.direction) GROUP BY 1")
def illegal_specs(spark, sf):
    e = F.col("event_id")
    specs = table(spark, sf, "events").select(
        "event_id", F.when(e % 3 == 0, "demand_level").when(e % 3 == 1, "shipment_loss").otherwise("compound").alias("family"), F.when(e % 2 == 0, "demand").otherwise("arrival").alias("stream"),
        F.when(e % 4 < 2, "sig_demand_level_up").otherwise("sig_arrival_loss").alias("signature"), F.when(e % 2 == 0, "demand_up").otherwise("arrival_interrupted").alias("direction"),
    )
    return G.illegal(specs).groupBy("family").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN ABS(x - 1) < 0.3 THEN 'low' WHEN ABS(x - 1) < 0.6 THEN 'medium' ELSE 'high' END AS magnitude, CASE WHEN p_size <= 3 THEN '1_3' WHEN p_size <= 8 THEN '4_8' ELSE 'longer' END AS duration, CAST(CASE WHEN p_size % 2 = 0 THEN 40 ELSE LEAST(40, CASE WHEN p_size <= 3 THEN 3 WHEN p_size <= 8 THEN 8 ELSE 40 END) END AS INT) AS lifetime FROM (SELECT *, p_retailprice / 1000 AS x FROM part)")
def spec_mapping(spark, sf):
    part, duration = table(spark, sf, "part"), G.duration_bin(F.col("p_size"))
    return part.select("p_partkey", G.magnitude_bin(F.col("p_retailprice") / 1000).alias("magnitude"), duration.alias("duration"), G.lifetime(duration, F.col("p_size") % 2 == 0, F.lit(40)).alias("lifetime"))


@query("SELECT p_brand AS value, LIST_SORT(LIST(DISTINCT pool)) AS pools FROM (SELECT p_brand, CASE p_partkey % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'cal' ELSE 'test' END AS pool FROM part) GROUP BY 1 HAVING COUNT(DISTINCT pool) > 1")
def seed_pool_intersection(spark, sf):
    p = F.col("p_partkey") % 3
    pools = table(spark, sf, "part").select(F.col("p_brand").alias("value"), F.when(p == 0, "dev").when(p == 1, "cal").otherwise("test").alias("pool"))
    return K.shared(pools, "pool", "value")


@query("SELECT name, CAST(place AS INT) AS place, turn FROM (SELECT n_name AS name, ROW_NUMBER() OVER (ORDER BY n_name) AS place, 0 AS turn FROM nation UNION ALL SELECT r_name, ROW_NUMBER() OVER (ORDER BY r_name), 1 FROM region)")
def interleave_sources(spark, sf):
    return P.interleave([table(spark, sf, "nation").select(F.col("n_name").alias("name")), table(spark, sf, "region").select(F.col("r_name").alias("name"))], ["name"])


@query("SELECT c_custkey AS unit, c.condition, CAST(CASE c.condition WHEN 'accurate' THEN onset - 1 WHEN 'delayed' THEN onset + 2 WHEN 'unreliable' THEN onset + 7 END AS INT) AS alert_period FROM (SELECT c_custkey, 14 + c_custkey % 9 AS onset FROM customer), (SELECT UNNEST(['none', 'accurate', 'delayed', 'unreliable']) AS condition) c")
def condition_replay(spark, sf):
    units = table(spark, sf, "customer").select(F.col("c_custkey").alias("unit"), (14 + F.col("c_custkey") % 9).alias("onset"))
    return N.conditions(units, "onset", 7).select("unit", "condition", "alert_period")


CRIT = [("fill", "go", ">=", 0.5), ("lift", "go", ">", -0.5), ("units", "go", ">=", 10.0), ("lost", "kill", ">", 5.0), ("absent", "kill", ">", 0.0)]
CR = "cr(name, kind, operator, threshold) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in CRIT) + ")"
ME = f"me AS (SELECT UNNEST(['fill', 'lift', 'units', 'lost']) AS name, UNNEST([fill, lift, units, lost]) AS estimate FROM (SELECT SUM(sold) / SUM(demand) AS fill, AVG(profit) FILTER (arm = '{T}') / AVG(profit) FILTER (arm = '{C}') - 1 AS lift, COUNT(DISTINCT unit)::DOUBLE AS units, AVG(lost::DOUBLE) AS lost FROM er))"


@query(with_(ER, CR, ME) + "SELECT cr.name, kind, COALESCE(CASE operator WHEN '>=' THEN estimate >= threshold WHEN '>' THEN estimate > threshold END, false) AS met FROM cr LEFT JOIN me USING (name)")
def pilot_verdicts(spark, sf):
    er = episode_results(spark, sf)
    mean = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("profit")))
    wide = er.agg((F.sum("sold") / F.sum("demand")).alias("fill"), (mean(T) / mean(C) - 1).alias("lift"), F.count_distinct("unit").cast("double").alias("units"), F.avg("lost").alias("lost"))
    metrics = wide.select(F.expr("stack(4, 'fill', fill, 'lift', lift, 'units', units, 'lost', lost) as (name, estimate)")).withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    return K.verdicts(spark.createDataFrame(CRIT, "name string, kind string, operator string, threshold double"), metrics)


@query("SELECT COALESCE(a.k, b.k) AS p_partkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT p_partkey AS k, SHA256(p_name) AS d FROM part WHERE p_size > 5) a FULL JOIN (SELECT p_partkey AS k, SHA256(CASE WHEN p_partkey % 10 = 0 THEN p_type ELSE p_name END) AS d FROM part WHERE p_size < 45) b ON a.k = b.k WHERE a.d IS DISTINCT FROM b.d")
def digest_drift(spark, sf):
    part = table(spark, sf, "part")
    was = part.where("p_size > 5").select("p_partkey", F.sha2("p_name", 256).alias("d"))
    now = part.where("p_size < 45").select("p_partkey", F.sha2(F.when(F.col("p_partkey") % 10 == 0, F.col("p_type")).otherwise(F.col("p_name")), 256).alias("d"))
    return K.drift(was, now, "p_partkey", "d")


@query("SELECT n_name, CAST(('0x' || SUBSTR(SHA256('slot/' || n_name), 1, 15)) AS BIGINT) % 7 AS slot FROM nation")
def slot_choice(spark, sf):
    return table(spark, sf, "nation").select("n_name", X.slot(F.concat(F.lit("slot/"), F.col("n_name")), F.lit(7)).alias("slot"))


@query("SELECT CAST(r.range // 30 AS INT) AS family, CAST(r.range % 30 AS INT) AS index, (r.range // 30 + 1) * 1000000 + r.range % 30 AS seed FROM range(180) r")
def seed_arithmetic(spark, sf):
    return N.seeds(spark, 6, 30)


@query(with_(CL) + "SELECT arm, ROUND(1.0 * AVG(tokens), 6) AS mean_tokens, COUNT(*) AS n FROM cl WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = episode AND c_acctbal > 0) GROUP BY arm")
def semi_join_mask(spark, sf):
    mask = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("episode"))
    return rounded(call_log(spark, sf).join(mask, "episode", "left_semi").groupBy("arm").agg(F.avg("tokens").alias("mean_tokens"), F.count("*").alias("n")), 6)


@query(with_(CL) + "SELECT p.episode, p.period AS tau, COUNT(r.period) AS periods, CAST(COALESCE(SUM(r.tokens), 0) AS BIGINT) AS tokens FROM (SELECT episode, period, LEAD(period) OVER (PARTITION BY episode ORDER BY period) AS nxt FROM cl WHERE arm = 'signup') p JOIN cl r ON r.episode = p.episode AND r.period >= p.period AND (r.period < p.nxt OR p.nxt IS NULL) GROUP BY 1, 2")
def proposal_windows(spark, sf):
    """Which proposal governs each period: the last one at or before it, carried forward in one window instead of a range join."""
    w = E.Window.partitionBy("episode").orderBy("period").rowsBetween(E.Window.unboundedPreceding, 0)
    tau = F.last(F.when(F.col("arm") == "signup", F.col("period")), ignorenulls=True).over(w)
    return call_log(spark, sf).withColumn("tau", tau).where("tau is not null").groupBy("episode", "tau").agg(F.count("*").alias("periods"), F.sum("tokens").alias("tokens"))


@query(with_(CL) + "SELECT arm, COUNT(*) AS calls FROM (SELECT * FROM cl WHERE attempt = 0 UNION ALL SELECT * FROM cl WHERE attempt = 1) GROUP BY 1")
def union_all_align(spark, sf):
    calls = call_log(spark, sf)
    both = calls.where("attempt = 0").unionByName(calls.where("attempt = 1").select(*reversed(calls.columns)))
    return both.groupBy("arm").agg(F.count("*").alias("calls"))


@query(None)
def generated_paths(spark, sf):
    """Seeded demand with a level change: numpy draws, no SQL counterpart; tests hold it across partitionings."""
    paths = N.baseline(N.seeds(spark, 6, 30), "ar1", 50).withColumn("demand", N.demand_cells(F.col("draw")))
    return N.level_change(paths, "demand", F.lit(1.5), F.lit(20), F.lit(50)).select("seed", "period", "demand", "shocked")


CAN = "ca(family, direction, stream, magnitude, m, l_eff, gamma) AS (VALUES " + ", ".join(f"('{f}', '{d}', '{t}', '{G.MAGNITUDES[k]}', {m}::DOUBLE, {n}, {g}::DOUBLE)" for (f, d, t), points in G.CANONICAL.items() for k, (m, n, g) in enumerate(points)) + ")"
LEG = f"lg AS (SELECT family, direction, stream, magnitude, pos FROM (SELECT UNNEST({list(G.FAMILIES)}) AS family), (SELECT UNNEST({list(G.DIRECTIONS)}) AS direction), (SELECT UNNEST({list(G.STREAMS)}) AS stream), (SELECT UNNEST({list(G.MAGNITUDES)}) AS magnitude, UNNEST([1, 2, 3]) AS pos))"
LAB = "CASE WHEN d IS NOT NULL AND s IS NOT NULL THEN 'compound_' || d || '_' || s ELSE COALESCE(d, s, 'stationary') END"


@query(with_(GRID, CAN, LEG) + f""", fr AS (SELECT *, ROW_NUMBER() OVER (ORDER BY m, l_eff, gamma) AS r FROM gr WHERE NOT EXISTS (SELECT 1 FROM ca WHERE ca.m = gr.m AND ca.l_eff = gr.l_eff AND ca.gamma = gr.gamma) AND NOT (m = 1 AND l_eff = 1 AND gamma = 1)),
 ot AS (SELECT *, ROW_NUMBER() OVER (ORDER BY family, direction, stream, pos) AS r FROM lg WHERE NOT EXISTS (SELECT 1 FROM ca WHERE ca.family = lg.family AND ca.direction = lg.direction AND ca.stream = lg.stream)),
 al AS (SELECT family, direction, stream, magnitude, m, l_eff, gamma FROM ca UNION ALL SELECT family, direction, stream, magnitude, COALESCE(m, 1), COALESCE(l_eff, 1), COALESCE(gamma, 1) FROM ot LEFT JOIN fr ON ot.r = fr.r UNION ALL SELECT 'no_change', 'none', 'none', NULL, 1, 1, 1)
 SELECT family, direction, stream, magnitude, m, l_eff, gamma, {LAB} AS predictive_model FROM (SELECT *, CASE WHEN m > 1 THEN 'demand_up' WHEN m < 1 THEN 'demand_down' END AS d, CASE WHEN l_eff > 1 AND gamma = 1 THEN 'lead_time_delay' WHEN l_eff = 1 AND gamma < 1 THEN 'shipment_loss' WHEN l_eff > 1 AND gamma < 1 THEN 'transit_stall' END AS s FROM al)""")
def mapping_table(spark, sf):
    return G.compile_specs(G.legal_specs(spark))
