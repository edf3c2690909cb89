"""Queries over answers, generated episodes, arrival laws, templates and registrations, each beside its SQL where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quayside.functions import answers as N
from quayside.operators import arrivals as A
from quayside.operators import checks as K
from quayside.operators import episodes as G
from quayside.operators import templates as T
from quayside.plans.q_evaluation import rounded
from quayside.plans.q_panel import EP, eprocess
from quayside.plans.runtime import spread, table
from quayside.plans.views import DP, demand_panel

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))

# an answer for each event, more or less broken
AN = r"""an AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '```json' || CHR(10) || '{"L_method": "recent_N", "N": ' || user_id || ', "mu_hat_method": "explicit", "mu_hat_value": ' || user_id || '.5, "sigma_hat_method": "odd",}' || CHR(10) || '```'
 WHEN 1 THEN '"action": {"7": ' || user_id || ', "8": 2}}' WHEN 2 THEN 'I think {"rationale": "so \$5 and 10\%", "action": {"7": ' || user_id || '}} is right' WHEN 3 THEN 'order "7": ' || user_id || ' please' WHEN 4 THEN '{"parameters": {"7": {"L": {"method": "default"}, "mu_hat": {"method": "recent_N", "N": 3}, "sigma_hat": {"method": "explicit"}}}}'
 ELSE 'nothing to say \x41' END AS text FROM events)"""


def answers(spark, sf):
    e, u = F.col("event_id") % 6, F.col("user_id").cast("string")
    lit = F.lit
    text = (
        F.when(e == 0, F.concat(lit('```json\n{"L_method": "recent_N", "N": '), u, lit(', "mu_hat_method": "explicit", "mu_hat_value": '), u, lit('.5, "sigma_hat_method": "odd",}\n```')))
        .when(e == 1, F.concat(lit('"action": {"7": '), u, lit(', "8": 2}}'))).when(e == 2, F.concat(lit('I think {"rationale": "so \\$5 and 10\\%", "action": {"7": '), u, lit("}} is right")))
        .when(e == 3, F.concat(lit('order "7": '), u, lit(" please"))).when(e == 4, lit('{"parameters": {"7": {"L": {"method": "default"}, "mu_hat": {"method": "recent_N", "N": 3}, "sigma_hat": {"method": "explicit"}}}}')).otherwise(lit("nothing to say \\x41"))
    )
    return spread(table(spark, sf, "events").select("event_id", "user_id"), "event_id").select("event_id", text.alias("text"))


@query(f"WITH {AN} SELECT event_id, " + r"""REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(TRIM(text), '^```(?:json)?\s*', ''), '\s*```$', ''), '(^|[^\\])\\\$', '\1$', 'g'), '(^|[^\\])\\%', '\1%', 'g'), '\\x([0-9a-fA-F]{2})', '\\u00\1', 'g'), ',(\s*[}\]])', '\1', 'g') AS cleaned,
 text LIKE '%{%' OR text LIKE '%}%' OR REGEXP_MATCHES(LOWER(text), 'method|default|explicit|recent') AS content FROM an""")
def cleaned_answers(spark, sf):
    text = F.col("text")
    return answers(spark, sf).select("event_id", N.cleaned(text).alias("cleaned"), N.has_content(text).alias("content"))


METHOD = "CASE WHEN REGEXP_EXTRACT(text, '\"{n}_method\"\\s*:\\s*\"(\\w+)\"', 1) IN ('default', 'explicit', 'recent_N', 'calculate') THEN REGEXP_EXTRACT(text, '\"{n}_method\"\\s*:\\s*\"(\\w+)\"', 1) ELSE 'default' END"
CHOICES = ", ".join(
    f"{METHOD.format(n=n)} AS {n}_method, CASE WHEN {METHOD.format(n=n)} = 'explicit' THEN TRY_CAST(REGEXP_EXTRACT(text, '\"{n}_value\"\\s*:\\s*(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) END AS {n}_value, CASE WHEN {METHOD.format(n=n)} = 'recent_N' THEN COALESCE(NULLIF(TRY_CAST(REGEXP_EXTRACT(text, '\"{n}_method\"[^}}]*?\"N\"\\s*:\\s*(\\d+)', 1) AS INT), 0), TRY_CAST(REGEXP_EXTRACT(text, '\"N\"\\s*:\\s*(\\d+)', 1) AS INT), 5) END AS {n}_n"
    for n in N.MENU
)


@query(f"WITH {AN} SELECT event_id, {CHOICES} FROM an")
def menu_choices(spark, sf):
    return answers(spark, sf).select("event_id", N.menu_choices(F.col("text")).alias("c")).select("event_id", "c.*")


@query(f"WITH {AN} SELECT event_id, CASE WHEN event_id % 6 = 4 THEN 'no value of sigma_hat' ELSE 'no parameters' END AS fault FROM an")
def parameter_faults(spark, sf):
    return answers(spark, sf).select("event_id", N.parameter_fault(F.col("text"), "7").alias("fault"))


@query(f"""WITH {AN} SELECT an.event_id, CASE an.event_id % 6 WHEN 1 THEN '{{"7": ' || user_id || ', "8": 2}}' WHEN 2 THEN '{{"7": ' || user_id || '}}' WHEN 3 THEN '{{"7": ' || user_id || '}}' END AS orders, false AS valid FROM an JOIN events USING (event_id)""")
def action_orders(spark, sf):
    """Broken answers' orders: by pattern where the object does not parse; the object with invalid escapes is no valid answer."""
    text = F.col("text")
    return answers(spark, sf).select("event_id", N.orders_of(text).alias("orders"), N.is_order_answer(text).alias("valid"))


@query(f"""WITH {AN} SELECT an.event_id, CASE an.event_id % 6 WHEN 0 THEN '{{"L_method": "recent_N", "N": ' || user_id || ', "mu_hat_method": "explicit", "mu_hat_value": ' || user_id || '.5, "sigma_hat_method": "odd"}}' WHEN 1 THEN '{{"action": {{"7": ' || user_id || ', "8": 2}}}}'
 WHEN 2 THEN '{{"action": {{"7": ' || user_id || '}}, "rationale": "so $5 and 10%"}}' WHEN 4 THEN '{{"parameters": {{"7": {{"L": {{"method": "default"}}, "mu_hat": {{"N": 3, "method": "recent_N"}}, "sigma_hat": {{"method": "explicit"}}}}}}}}' END AS object FROM an JOIN events USING (event_id)""")
def tolerant_objects(spark, sf):
    return answers(spark, sf).select("event_id", N.objects_of(F.col("text")).alias("object"))


@query("SELECT event_id, UNNEST([CAST(user_id AS VARCHAR), 'true', event_type, CAST(user_id AS VARCHAR) || '.0', CAST(user_id AS VARCHAR)]) AS literal FROM events")
def json_literals(spark, sf):
    made = F.concat(F.lit('{"a": ['), F.col("user_id"), F.lit(', null, true], "b": {"c": "'), F.col("event_type"), F.lit('", "d": '), F.col("user_id"), F.lit('.0, "e": ""}}'))
    return table(spark, sf, "events").select("event_id", F.explode(N.literals_of(made)).alias("literal"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'history' END AS history, CASE WHEN o_orderkey % 3 > 0 THEN 'alert' END AS alert, 'v' || (o_orderkey % 4) AS \"left\", 'v' || (3 - o_orderkey % 4) AS \"right\" FROM orders")
def channel_ablations(spark, sf):
    """Channels removed for an ablation, and two variants of one set."""
    k = F.col("o_orderkey")
    variants = F.create_map(*[F.lit(x) for i in range(4) for x in (i, f"v{i}")])
    return table(spark, sf, "orders").select("o_orderkey", F.when(k % 2 == 0, "history").alias("history"), F.when(k % 3 > 0, "alert").alias("alert"), F.element_at(variants, (k % 4).cast("int")).alias("left"), F.element_at(variants, (3 - k % 4).cast("int")).alias("right"))


# generated episodes: shocks over given paths have SQL, draws do not
GP = """gp AS (SELECT episode, CAST(1 + episode % 7 AS INT) AS family, period, demand, CAST(14 + episode % 9 AS INT) AS onset, (SELECT MAX(period) FROM dp) AS horizon, CASE WHEN episode % 7 = 1 THEN 0.6 ELSE 1.5 END AS magnitude, 3 AS duration, 2 AS base_lead, 4 AS disrupted_lead, 2 AS loss_length, 3 AS pause_length FROM dp)"""
SHOCKED = """CASE WHEN family IN (1, 2) AND period >= onset OR family IN (3, 6, 7) AND period >= onset AND period < onset + duration THEN GREATEST(0.0, FLOOR(demand * magnitude + 0.5)) ELSE CAST(demand AS DOUBLE) END AS demand, demand AS twin_demand, base_lead AS twin_lead_time,
 CASE WHEN family IN (5, 7) AND period >= onset AND period < onset + loss_length THEN NULL WHEN family = 4 AND period >= onset THEN disrupted_lead ELSE base_lead END AS lead_time, family = 6 AND period >= onset AND period < onset + pause_length AS pause"""


def shock_rows(spark, sf):
    e = F.col("episode")
    panel = demand_panel(spark, sf)
    last = panel.agg(F.max("period").alias("horizon"))
    fixed = {"magnitude": F.when(e % 7 == 1, 0.6).otherwise(1.5), "duration": F.lit(3), "base_lead": F.lit(2), "disrupted_lead": F.lit(4), "loss_length": F.lit(2), "pause_length": F.lit(3)}
    return panel.join(F.broadcast(last)).withColumns({"family": (1 + e % 7).cast("int"), "onset": (14 + e % 9).cast("int"), **fixed})  # one row


@query(f"WITH {DP}, {GP} SELECT episode, period, {SHOCKED} FROM gp")
def shocked_episodes(spark, sf):
    return G.shocked(shock_rows(spark, sf)).select("episode", "period", "demand", "twin_demand", "twin_lead_time", "lead_time", "pause")


@query(f"""WITH {DP}, {GP} SELECT episode, CASE WHEN family IN (1, 2) THEN 'demand_level' WHEN family = 3 THEN 'temporary_pulse' WHEN family = 4 THEN 'lead_time_shift' WHEN family = 5 THEN 'shipment_loss' ELSE 'compound' END AS shock_family, onset, CASE WHEN family IN (1, 2, 4) THEN horizon - onset + 1 WHEN family = 5 THEN LEAST(loss_length, horizon - onset + 1) ELSE LEAST(duration, horizon - onset + 1) END AS lasts,
 CASE WHEN family = 4 THEN 'lead_time_shift' WHEN family IN (5, 7) THEN 'shipment_loss' WHEN family = 6 THEN 'transit_pause' END AS effect, CASE WHEN family = 4 THEN horizon - onset + 1 WHEN family IN (5, 7) THEN loss_length WHEN family = 6 THEN LEAST(pause_length, horizon - onset + 1) END AS effect_length, family NOT IN (6, 7) AS conditional_independence FROM gp WHERE period = 1""")
def hidden_incidents(spark, sf):
    return G.incidents(shock_rows(spark, sf).where("period = 1")).select("episode", "shock_family", "onset", "lasts", "effect", "effect_length", "conditional_independence")


@query(None)
def drawn_episodes(spark, sf):
    """Episodes of all six families from their seeds: draws on the workers, shocks in expressions."""
    seeds = G.fresh_units(spark, 6, 20, 300_000).select("seed", "family")
    rows = G.episodes(G.drawn(seeds, 50), 50)
    return rounded(rows.groupBy("family").agg(F.count("*").alias("rows"), F.count_distinct("seed").alias("seeds"), F.avg("demand").alias("demand"), F.avg("twin_demand").alias("twin"), F.count_if(F.col("lead_time").isNull()).alias("lost"), F.count_if("pause").alias("paused"), F.min("onset").alias("first_onset"), F.max("onset").alias("last_onset")))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 3 THEN 1 WHEN 4 THEN 3 END AS base_lead, CASE o_orderkey % 6 WHEN 3 THEN 3 END AS disrupted_lead, CASE o_orderkey % 6 WHEN 4 THEN 1 END AS loss_length, CASE WHEN o_orderkey % 6 IN (0, 1, 2, 5) THEN 1.0 END AS magnitude, CASE WHEN o_orderkey % 6 IN (2, 5) THEN 3 END AS duration, CASE o_orderkey % 6 WHEN 5 THEN 5 END AS pause_length, true AS inverse FROM orders""")
def combo_round_trip(spark, sf):
    """Combinations as parameters, and back."""
    family = (1 + F.col("o_orderkey") % 6).cast("int")
    sizes = F.when(family.isin(1, 2), 1).when(family == 6, 3).otherwise(2)
    combo = F.slice(F.array(F.lit(1.0), F.lit(3.0), F.lit(5.0)), F.lit(1), sizes)
    rows = table(spark, sf, "orders").select("o_orderkey", family.alias("family"), combo.alias("combo")).withColumn("p", G.combo_parameters(F.col("combo"), F.col("family")))
    return rows.select("o_orderkey", "p.*", (G.parameters_combo(F.col("p"), F.col("family")) == F.col("combo")).alias("inverse"))


@query("SELECT CAST(f AS INT) AS family, CAST(i + 30 AS INT) AS \"index\", f * 1000000 + 300000 + i + 30 AS seed FROM (SELECT UNNEST(RANGE(1, 7)) AS f), (SELECT UNNEST(RANGE(20)) AS i)")
def fresh_units(spark, sf):
    return G.fresh_units(spark, 6, 20, 300_000, first=30)


@query("SELECT seed, COUNT(*) AS n, LIST_SORT(LIST(DISTINCT pool)) AS pools FROM (SELECT f * 1000000 + 300000 + i AS seed, 'a' AS pool FROM (SELECT UNNEST(RANGE(1, 3)) AS f), (SELECT UNNEST(RANGE(10)) AS i) UNION ALL SELECT f * 1000000 + 300000 + i, 'b' FROM (SELECT UNNEST(RANGE(1, 3)) AS f), (SELECT UNNEST(RANGE(7, 12)) AS i)) GROUP BY 1 HAVING COUNT(*) > 1")
def seed_collisions(spark, sf):
    a = G.fresh_units(spark, 2, 10, 300_000).select("seed", F.lit("a").alias("pool"))
    return G.collisions(a.unionByName(G.fresh_units(spark, 2, 5, 300_000, first=7).select("seed", F.lit("b").alias("pool"))))


@query("SELECT law, regime, cv, CASE WHEN cv = 0.1 THEN 1000 ELSE 200 END AS replications FROM (SELECT UNNEST(['iid', 'negbin']) AS law), (SELECT UNNEST(['stable', 'shift', 'pulse']) AS regime), (SELECT UNNEST([0.1::DOUBLE, 0.25, 0.4]) AS cv)")
def cell_design(spark, sf):
    return G.cell_design(spark, ["iid", "negbin"], ["stable", "shift", "pulse"], [0.1, 0.25, 0.4], 1000, 200)


@query("SELECT family, \"index\", seed FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY family, \"index\" % 2 ORDER BY seed) AS r FROM (SELECT CAST(f AS INT) AS family, CAST(i AS INT) AS \"index\", f * 1000000 + i AS seed FROM (SELECT UNNEST(RANGE(1, 7)) AS f), (SELECT UNNEST(RANGE(20)) AS i))) WHERE r <= 3")
def balanced_units(spark, sf):
    units = G.fresh_units(spark, 6, 20, 0).withColumn("half", F.col("index") % 2)
    return G.balanced(units, ["family", "half"], 3).select("family", "index", "seed")


@query(None)
def lead_noise(spark, sf):
    rows = G.lead_noise(G.fresh_units(spark, 2, 50, 0), 50)
    return rounded(rows.groupBy("noise").agg(F.count("*").alias("n")))


@query(None)
def null_violations(spark, sf):
    """Null paths that break what the tests assume, by kind."""
    from quayside.operators.generate import baseline

    paths = baseline(spark.range(200).select((F.col("id") + 8_000_000).alias("seed")), "iid", 50)
    out = None
    for kind in ("variance_change", "seasonality", "outliers"):
        part = G.violated(paths, kind, 100.0, 50).groupBy(F.lit(kind).alias("violation")).agg(F.avg("demand").alias("mean"), F.stddev_samp("demand").alias("sd"), F.count_if(F.col("demand") == 400).alias("outliers"))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 3)


# arrival laws
GRID = "(SELECT law, CAST(start AS INT) AS start, CAST(duration AS INT) AS duration, 1.0 / 18 AS weight FROM (SELECT UNNEST([0, 1]) AS law), (SELECT UNNEST([15, 16, 17]) AS start), (SELECT UNNEST([3, 4, 5]) AS duration))"


@query(f"SELECT law, start, duration, ROUND(weight, 9) AS weight FROM {GRID}")
def arrival_alternatives(spark, sf):
    return rounded(A.alternatives(spark, "transit_pause", 15), 9)


@query(f"SELECT start, duration, CAST(COUNT(*) FILTER (p >= start AND p < start + duration) AS BIGINT) AS in_force FROM {GRID}, (SELECT UNNEST(RANGE(1, 31)) AS p) WHERE law = 0 GROUP BY 1, 2")
def law_in_force(spark, sf):
    periods = spark.range(1, 31).select(F.col("id").cast("int").alias("p"))
    grid = A.alternatives(spark, "transit_pause", 15).where("law = 0")
    return periods.join(F.broadcast(grid)).groupBy("start", "duration").agg(F.count_if(A.in_force(F.col("p"), F.col("start"), F.col("duration"))).alias("in_force"))


@query(f"WITH {DP} SELECT episode, period, CASE WHEN demand % 7 = 0 THEN NULL WHEN demand % 4 = 0 OR demand % 3 = 0 THEN demand % 4 ELSE demand % 4 - 1 END AS left_after FROM dp")
def transit_counters(spark, sf):
    d = F.col("demand")
    return demand_panel(spark, sf).select("episode", "period", A.advanced(F.when(d % 7 != 0, d % 4), d % 3 == 0).alias("left_after"))


@query(None)
def arrival_calibration(spark, sf):
    """False activations of the three arrival tests, 2,000 paths of 50 periods each."""
    out = None
    for family in A.DURATIONS:
        part = A.calibration(spark, family, 2000, 50, 12, 0.025)
        out = part if out is None else out.unionByName(part)
    return rounded(out, 6)


@query("SELECT * FROM (VALUES ('demand_level_up', 'demand', 'discrete_mixture_lr', 'anytime_valid'), ('demand_level_down', 'demand', 'discrete_mixture_lr', 'anytime_valid'), ('temporary_pulse', 'demand', 'bounded_duration_mixture_lr', 'anytime_valid_low_power'), ('lead_time_shift', 'arrival', 'finite_state_forward', 'anytime_valid_own_source_only'), ('shipment_loss', 'arrival', 'finite_state_forward_absorbing_loss', 'anytime_valid_own_source_only'), ('transit_pause', 'arrival', 'finite_state_forward_frozen_counters', 'anytime_valid_own_source_only'), ('compound', 'both', 'separate_eprocesses_alpha_split', 'anytime_valid_via_splitting')) v(construction, stream, method, status)")
def validity_flags(spark, sf):
    return A.validity(spark)


LE = "le AS (SELECT user_id AS episode, event_id AS period, (['proposed', 'active', 'refuted', 'expired'])[event_id % 4 + 1] AS state FROM events)"


@query(f"WITH {LE} SELECT episode, period, before, state FROM (SELECT *, COALESCE(LAG(state) OVER (PARTITION BY episode ORDER BY period), 'proposed') AS before FROM le) WHERE before <> state AND NOT (before IN ('proposed', 'active') AND state IN ('active', 'refuted', 'expired', 'superseded') AND NOT (before = 'active' AND state = 'active'))")
def illegal_transitions(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("episode"), F.col("event_id").alias("period"), pick(("proposed", "active", "refuted", "expired"), F.col("event_id") % 4).alias("state"))
    return A.illegal_transitions(rows, ["episode"]).select("episode", "period", "before", "state")


PO = "po AS (SELECT o_custkey AS episode, o_orderkey AS tau, CASE WHEN o_orderkey % 3 = 0 THEN 'compound' ELSE 'demand_level' END AS family, o_orderkey + 3 AS first_evidence, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 20 END AS ended_at FROM orders)"


def orders_as_proposals(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("episode"), k.alias("tau"), F.when(k % 3 == 0, "compound").otherwise("demand_level").alias("family"), (k + 3).alias("first_evidence"), F.when(k % 2 == 0, k + 20).alias("ended_at"))


@query(f"WITH {PO}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY episode ORDER BY tau) AS ordinal FROM po) SELECT episode, tau, CAST(ordinal AS INT) AS ordinal, POW(0.5, ordinal) / CASE WHEN family = 'compound' THEN 2 ELSE 1 END AS alpha_share, CASE WHEN ordinal > 2 THEN 'cap' WHEN tau >= 50000 THEN 'horizon' END AS fault FROM r")
def admissible_proposals(spark, sf):
    return A.admissible(orders_as_proposals(spark, sf), 2, 50_000, ["episode"]).select("episode", "tau", "ordinal", "alpha_share", "fault")


@query(f"WITH {PO}, h AS (SELECT *, LEAD(first_evidence) OVER (PARTITION BY episode ORDER BY tau) AS heir FROM po) SELECT episode, tau, CASE WHEN heir IS NOT NULL AND (ended_at IS NULL OR heir < ended_at) THEN 'superseded' WHEN ended_at IS NOT NULL THEN 'ended' ELSE 'open' END AS state, CASE WHEN heir IS NOT NULL AND (ended_at IS NULL OR heir < ended_at) THEN heir ELSE ended_at END AS until FROM h")
def superseded_proposals(spark, sf):
    rows = orders_as_proposals(spark, sf).withColumnRenamed("tau", "proposal")
    return A.superseded(rows, ["episode"]).select("episode", F.col("proposal").alias("tau"), "state", "until")


@query(f"WITH {PO} SELECT episode, CAST(ROW_NUMBER() OVER (PARTITION BY episode ORDER BY period, tau, event) AS INT) AS place, period, tau, event FROM (SELECT episode, tau, tau AS period, 'proposed' AS event FROM po UNION ALL SELECT episode, tau, first_evidence, 'evidence' FROM po UNION ALL SELECT episode, tau, ended_at, 'ended' FROM po WHERE ended_at IS NOT NULL)")
def lifecycle_log(spark, sf):
    """All proposals' events of an episode in one log."""
    p = orders_as_proposals(spark, sf)
    part = lambda c, name: p.where(F.col(c).isNotNull()).select("episode", "tau", F.col(c).alias("period"), F.lit(name).alias("event"))
    log = part("tau", "proposed").unionByName(part("first_evidence", "evidence")).unionByName(part("ended_at", "ended"))
    return log.withColumn("place", F.row_number().over(Window.partitionBy("episode").orderBy("period", "tau", "event")))


@query(f"WITH {DP}, {EP}, a AS (SELECT episode, period, log_e, MIN(CASE WHEN log_e >= LN(80) THEN period END) OVER (PARTITION BY episode ORDER BY period) AS crossed FROM ep), b AS (SELECT episode, period, -log_e AS log_e, CASE WHEN episode % 2 = 0 AND period >= 40 THEN 40 END AS crossed FROM ep) SELECT episode, period, ROUND(a.log_e, 4) AS log_e_demand, ROUND(b.log_e, 4) AS log_e_arrival, CASE WHEN a.crossed IS NOT NULL AND b.crossed IS NOT NULL THEN GREATEST(a.crossed, b.crossed) END AS activated_at FROM a JOIN b USING (episode, period)")
def compound_points(spark, sf):
    """Two e-processes side by side, each on half of alpha; both must cross."""
    one = eprocess(spark, sf, 0.0125)
    two = one.select("episode", "period", (-F.col("log_e")).alias("log_e"), F.when((F.col("episode") % 2 == 0) & (F.col("period") >= 40), 40).alias("crossed_at"))
    return rounded(A.compound_points(one, two, ["episode"]).select("episode", "period", "log_e_demand", "log_e_arrival", "activated_at"))


# templates: one per part, its slots from a few words
BANK = """tb AS (SELECT 't' || p_partkey AS template_id, (['dev', 'cal', 'test'])[p_partkey % 3 + 1] AS split, (['demand_level', 'compound'])[p_partkey % 2 + 1] AS family, (['accurate', 'overstated', 'ambiguous'])[p_partkey % 5 % 3 + 1] AS kind, 'w' || (p_partkey % 7) AS wording, 'A {what} hits {where} of line ' || (p_partkey % 30) AS text, ['surge', 'drop'] AS what, CASE WHEN p_partkey % 2 = 0 THEN ['north', 'south', 'east'] ELSE ['west'] END AS wher, CAST(p_partkey % 3 AS INT) AS lo, CAST(p_partkey % 4 AS INT) AS hi, 's' || (p_partkey % 4) AS signature, p_partkey AS k FROM part)"""


def bank(spark, sf):
    k = F.col("p_partkey")
    where = F.when(k % 2 == 0, F.array(*map(F.lit, ("north", "south", "east")))).otherwise(F.array(F.lit("west")))
    return table(spark, sf, "part").select(
        F.concat(F.lit("t"), k).alias("template_id"), pick(("dev", "cal", "test"), k % 3).alias("split"), pick(("demand_level", "compound"), k % 2).alias("family"), pick(("accurate", "overstated", "ambiguous"), k % 5 % 3).alias("kind"), F.concat(F.lit("w"), k % 7).alias("wording"),
        F.concat(F.lit("A {what} hits {where} of line "), k % 30).alias("text"), F.create_map(F.lit("what"), F.array(F.lit("surge"), F.lit("drop")), F.lit("where"), where).alias("slots"), (k % 3).cast("int").alias("lo"), (k % 4).cast("int").alias("hi"), F.concat(F.lit("s"), k % 4).alias("signature"), k.alias("k"),
    )


DIGEST = "SHA256('[\"' || template_id || '\",' || k || ',\"{slot}\"]')"
MODULO = "CAST(LIST_REDUCE(LIST_PREPEND(0::HUGEINT, LIST_TRANSFORM(STRING_SPLIT({d}, ''), lambda c: CAST(INSTR('0123456789abcdef', c) - 1 AS HUGEINT))), lambda a, b: (a * 16 + b) % {n}) AS BIGINT)"


@query(f"WITH {BANK} SELECT template_id, REPLACE(REPLACE(text, '{{what}}', what[1 + {MODULO.format(d=DIGEST.format(slot='what'), n='LEN(what)')}]), '{{where}}', wher[1 + {MODULO.format(d=DIGEST.format(slot='where'), n='LEN(wher)')}]) AS rendered FROM tb")
def rendered_templates(spark, sf):
    rows = bank(spark, sf)
    return rows.select("template_id", T.rendered(F.col("text"), T.drawn_slots(F.col("template_id"), F.col("k"), F.col("slots"))).alias("rendered"))


RENDERINGS = f"{BANK}, re AS (SELECT template_id, split, REPLACE(REPLACE(text, '{{what}}', a), '{{where}}', b) AS text FROM (SELECT template_id, split, text, UNNEST(what) AS a, wher FROM tb), (SELECT UNNEST(['north', 'south', 'east', 'west']) AS b) WHERE LIST_CONTAINS(wher, b))"


@query(f"WITH {RENDERINGS} SELECT template_id, split, text FROM re")
def all_renderings(spark, sf):
    return T.all_renderings(bank(spark, sf))


@query(f"WITH {RENDERINGS} SELECT split, text, COUNT(DISTINCT template_id) AS owners, MIN(template_id) AS first FROM re GROUP BY 1, 2 HAVING COUNT(DISTINCT template_id) > 1")
def repeated_renderings(spark, sf):
    return T.shared_texts(T.all_renderings(bank(spark, sf)), "template_id")


@query(f"WITH {BANK} SELECT family, split, COUNT(*) AS n FROM tb GROUP BY 1, 2 HAVING COUNT(*) <> 10 OR COUNT(*) FILTER (kind = 'accurate') <> 4 OR COUNT(*) FILTER (kind = 'overstated') <> 4 OR COUNT(*) FILTER (kind = 'ambiguous') <> 2")
def bank_composition(spark, sf):
    return T.composition_faults(bank(spark, sf), ["demand_level", "compound"], ["dev", "cal", "test"], {"accurate": 4, "overstated": 4, "ambiguous": 2})


@query(f"WITH {BANK} SELECT template_id, 'window' AS fault FROM tb WHERE NOT (lo = 0 AND hi IN (0, 1, 2)) UNION ALL SELECT template_id, 'signature' FROM tb WHERE (family, signature) NOT IN (('demand_level', 's0'), ('compound', 's1'))")
def unregistered_templates(spark, sf):
    windows = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "lo int, hi int")
    return T.unregistered(bank(spark, sf), windows, spark.createDataFrame([("demand_level", "s0"), ("compound", "s1")], "family string, signature string"))


@query(f"WITH {BANK} SELECT wording FROM tb WHERE split = 'test' AND k % 4 = 0 INTERSECT SELECT wording FROM tb WHERE split <> 'test' AND k % 4 = 1")
def wording_overlap(spark, sf):
    rows = bank(spark, sf)
    return rows.where("split = 'test' and k % 4 = 0").select("wording").intersect(rows.where("split <> 'test' and k % 4 = 1").select("wording"))


@query(f"WITH {BANK}, tp AS (SELECT split, family, template_id, ROW_NUMBER() OVER (PARTITION BY split, family ORDER BY template_id) - 1 AS i, COUNT(*) OVER (PARTITION BY split, family) AS n FROM tb WHERE kind = 'accurate') SELECT o_orderkey AS slot, tp.split, tp.family, template_id FROM (SELECT o_orderkey, (['dev', 'cal', 'test'])[o_orderkey % 3 + 1] AS split, (['demand_level', 'compound'])[o_orderkey % 2 + 1] AS family FROM orders) u JOIN tp ON tp.split = u.split AND tp.family = u.family AND (o_orderkey + 2) % n = i")
def chosen_templates(spark, sf):
    k = F.col("o_orderkey")
    units = table(spark, sf, "orders").select(k.alias("slot"), pick(("dev", "cal", "test"), k % 3).alias("split"), pick(("demand_level", "compound"), k % 2).alias("family"))
    return T.chosen_templates(units, bank(spark, sf), "accurate", 2)


@query(f"WITH {BANK}, r AS (SELECT template_id, family, kind, ROW_NUMBER() OVER (PARTITION BY family, kind ORDER BY template_id) AS turn, (LIST_POSITION(['accurate', 'overstated', 'ambiguous'], kind) - DENSE_RANK() OVER (ORDER BY family) + 3) % 3 AS k FROM tb) SELECT template_id, family, kind FROM r ORDER BY turn, k, family, template_id LIMIT 20")
def review_sample(spark, sf):
    return T.review_sample(bank(spark, sf), ["accurate", "overstated", "ambiguous"], 20)


# registrations
@query("SELECT id, label, CASE WHEN family_level AND metric IN ('cvar10', 'worst_decile') THEN 'exploratory' ELSE label END AS effective, label = 'confirmatory' AND NOT (family_level AND metric IN ('cvar10', 'worst_decile')) AND id % 3 <> 0 AS unregistered FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'confirmatory' ELSE 'exploratory' END AS label, o_orderkey % 5 = 0 AS family_level, (['cvar10', 'profit'])[o_orderkey % 4 // 2 + 1] AS metric FROM orders)")
def analysis_labels(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k.alias("id"), F.when(k % 2 == 0, "confirmatory").otherwise("exploratory").alias("label"), (k % 5 == 0).alias("family_level"), pick(("cvar10", "profit"), F.floor(k % 4 / 2)).alias("metric"))
    registered = rows.where("id % 3 = 0").select("id")
    return K.labelled(rows, registered).select("id", "label", "effective", "unregistered")


@query("SELECT 'weights' AS fault, '1.05' AS detail UNION ALL SELECT 'placeholder', 'alpha' UNION ALL SELECT 'missing', 'contrasts'")
def registration_faults(spark, sf):
    entries = spark.createDataFrame([("weight", "a", "0.6"), ("weight", "b", "0.45"), ("threshold", "alpha", "TBD"), ("threshold", "lift", "0.05")], "section string, name string, value string")
    return K.registration_faults(entries, ["weight", "threshold", "contrasts"])


@query("SELECT unit, COUNT(DISTINCT seed) AS seeds FROM (SELECT o_custkey AS unit, o_orderkey % 2 AS seed FROM orders) GROUP BY 1 HAVING COUNT(DISTINCT seed) <> 1")
def unresolved_units(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("unit"), (F.col("o_orderkey") % 2).alias("seed"))
    return rows.groupBy("unit").agg(F.count_distinct("seed").alias("seeds")).where("seeds <> 1")


@query("SELECT o_orderkey AS id, (['dev', 'cal', 'test'])[o_orderkey % 3 + 1] AS split FROM orders WHERE o_orderkey % 3 <> 2 AND o_orderkey % 7 IN (1, 2)")
def held_out_leaks(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k.alias("id"), pick(("dev", "cal", "test"), k % 3).alias("split"), pick(("main", "held_out_combo", "ood"), F.when(k % 7 < 3, k % 7).otherwise(0)).alias("slice"))
    return rows.where("split <> 'test' and slice in ('held_out_combo', 'extrapolation', 'ood')").select("id", "split")


@query("SELECT arm, attempted, classified, charged, physical FROM (SELECT event_type AS arm, COUNT(*) AS attempted, COUNT(*) FILTER (event_id % 11 <> 0) AS classified, COUNT(*) FILTER (event_id % 3 <> 0) AS charged, COUNT(DISTINCT CASE WHEN event_id % 3 <> 0 THEN user_id END) AS physical FROM events GROUP BY 1) WHERE attempted <> classified OR physical > charged")
def unconserved_arms(spark, sf):
    """Arms whose calls are not all classified, or more physical than charged."""
    e = F.col("event_id")
    rows = table(spark, sf, "events").groupBy(F.col("event_type").alias("arm")).agg(F.count("*").alias("attempted"), F.count_if(e % 11 != 0).alias("classified"), F.count_if(e % 3 != 0).alias("charged"), F.count_distinct(F.when(e % 3 != 0, F.col("user_id"))).alias("physical"))
    return rows.where("attempted <> classified or physical > charged")


@query("SELECT call, COUNT(*) AS settled, MAX(outcome) AS outcome FROM (SELECT event_id % 4000 AS call, event_type AS outcome FROM events) GROUP BY 1 HAVING COUNT(*) > 1")
def double_settlements(spark, sf):
    rows = table(spark, sf, "events").select((F.col("event_id") % 4000).alias("call"), F.col("event_type").alias("outcome"))
    return rows.groupBy("call").agg(F.count("*").alias("settled"), F.max("outcome").alias("outcome")).where("settled > 1")


@query("SELECT k AS cluster, family, SHA256(STRING_AGG(v, ',' ORDER BY v)) AS digest FROM (SELECT o_custkey % 40 AS k, o_orderpriority AS family, CAST(o_orderkey AS VARCHAR) AS v FROM orders) GROUP BY 1, 2")
def arm_digests(spark, sf):
    """One digest for each arm of a run, to hold against another run's."""
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("cluster"), F.col("o_orderpriority").alias("family"), F.col("o_orderkey").cast("string").alias("v"))
    return rows.groupBy("cluster", "family").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("v")), ","), 256).alias("digest"))
