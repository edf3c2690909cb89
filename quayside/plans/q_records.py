"""Queries over proposals, truths and period records, each beside its SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quayside.functions import records as R
from quayside.operators import evaluation as E
from quayside.operators import inference as I
from quayside.operators import panel as P
from quayside.plans.q_evaluation import Z, rounded
from quayside.plans.records_view import CONDITIONS, FAMILIES, FACTS, NAMES, RECORDS, SHOCK, facts, run_calls, run_records
from quayside.plans.runtime import table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


BINS, LASTING, SPANS = ("low", "medium", "high"), ("persistent", "transient"), ("1_3", "4_8", "longer")
pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))


def stream_of(family):
    return F.when(family.isin("demand_level", "temporary_pulse"), "demand").when(family == "compound", "both").otherwise("arrival")


def proposals(spark, sf):
    """episode, arm, period, attempt, parsed, abstention and the fields proposed: a call's answer each."""
    k = F.col("prompt")
    family = F.when(k % 4 == 0, "no_change").otherwise(pick(FAMILIES, 1 + k % 5))
    direction = F.when(family == "no_change", "none").when(k % 2 == 0, "demand_up").otherwise("demand_down")
    error = F.when(F.col("outcome") == "fallback", F.concat(F.lit("bad answer "), (k % 6).cast("string"), F.lit("\nline two")))
    return run_calls(spark, sf).select(
        "episode", "arm", "period", "attempt", (F.col("outcome") != "fallback").alias("parsed"), (k % 4 == 0).alias("abstention"), family.alias("family"), direction.alias("direction"), F.when(family == "no_change", "none").otherwise(stream_of(family)).alias("stream"),
        pick(BINS, k % 3).alias("magnitude"), pick(LASTING, k % 2).alias("persistence"), pick(SPANS, k % 3).alias("duration"), (k % 3 - 2).cast("int").alias("lo"), (k % 3 + 1).cast("int").alias("hi"), error.alias("error"), "prompt", "usd",
    )


def truths(spark, sf):
    """episode, family, direction, stream, onset, magnitude, persistence, duration of shocked episodes."""
    rows = run_records(spark, sf).where("arm = 'arm1' and period = 1 and family <> 'no_change'")
    e = F.col("episode")
    return rows.select("episode", "family", "direction", stream_of(F.col("family")).alias("stream"), (SHOCK + e % 3).cast("int").alias("onset"), pick(BINS, e % 3).alias("magnitude"), pick(LASTING, e % 2).alias("persistence"), pick(SPANS, e % 3).alias("duration"))


STREAM = "CASE WHEN {f} IN ('demand_level', 'temporary_pulse') THEN 'demand' WHEN {f} = 'compound' THEN 'both' ELSE 'arrival' END"
PP = f"""pp AS (SELECT episode, arm, period, attempt, outcome <> 'fallback' AS parsed, prompt % 4 = 0 AS abstention, CASE WHEN prompt % 4 = 0 THEN 'no_change' ELSE {NAMES(FAMILIES)}[2 + prompt % 5] END AS family, CASE WHEN prompt % 4 = 0 THEN 'none' WHEN prompt % 2 = 0 THEN 'demand_up' ELSE 'demand_down' END AS direction,
 CASE WHEN prompt % 4 = 0 THEN 'none' ELSE {STREAM.format(f=f'{NAMES(FAMILIES)}[2 + prompt % 5]')} END AS stream, {NAMES(BINS)}[prompt % 3 + 1] AS magnitude, {NAMES(LASTING)}[prompt % 2 + 1] AS persistence, {NAMES(SPANS)}[prompt % 3 + 1] AS duration, CAST(prompt % 3 - 2 AS INT) AS lo, CAST(prompt % 3 + 1 AS INT) AS hi,
 CASE WHEN outcome = 'fallback' THEN 'bad answer ' || (prompt % 6) || CHR(10) || 'line two' END AS error, prompt, usd FROM rc)"""
TR = f"tr AS (SELECT episode, family, direction, {STREAM.format(f='family')} AS stream, CAST({SHOCK} + episode % 3 AS INT) AS onset, {NAMES(BINS)}[episode % 3 + 1] AS magnitude, {NAMES(LASTING)}[episode % 2 + 1] AS persistence, {NAMES(SPANS)}[episode % 3 + 1] AS duration FROM rr WHERE arm = 'arm1' AND period = 1 AND family <> 'no_change')"
PROPOSED = RECORDS + f", {PP}, {TR}"
KNOWN = FACTS + f", {PP}, {TR}"
EV = "ev AS (SELECT *, CASE WHEN NOT parsed THEN 'parse_fail' WHEN abstention THEN 'abstain' ELSE 'shock' END AS outcome, ROW_NUMBER() OVER (PARTITION BY episode, arm ORDER BY period) AS event FROM (SELECT *, COUNT(*) OVER (PARTITION BY episode, arm, period) AS attempts, ROW_NUMBER() OVER (PARTITION BY episode, arm, period ORDER BY attempt DESC) AS r FROM pp) WHERE r = 1)"


def events(spark, sf):
    """A row per proposal: its last attempt, how many there were, what came of it, its place among the episode's."""
    rows = proposals(spark, sf)
    rest = [c for c in rows.columns if c not in ("episode", "arm", "period")]
    last = rows.groupBy("episode", "arm", "period").agg(F.max_by(F.struct(*rest), "attempt").alias("r"), F.count("*").alias("attempts")).select("episode", "arm", "period", "r.*", "attempts")
    outcome = F.when(~F.col("parsed"), "parse_fail").when(F.col("abstention"), "abstain").otherwise("shock")
    return last.withColumns({"outcome": outcome, "event": F.row_number().over(Window.partitionBy("episode", "arm").orderBy("period"))})


@query(PROPOSED + f", {EV} SELECT episode, arm, period, attempts, parsed AND attempt > 1 AS repaired, outcome, CAST(event AS INT) AS event FROM ev")
def proposal_events(spark, sf):
    return events(spark, sf).select("episode", "arm", "period", "attempts", (F.col("parsed") & (F.col("attempt") > 1)).alias("repaired"), "outcome", "event")


FP = "fp AS (SELECT e.episode, ev.period, COALESCE(ev.outcome, 'no_call') AS outcome, ev.family, ev.direction, tr.family AS true_family, tr.onset, ev.period - tr.onset AS delay FROM (SELECT DISTINCT episode FROM rr) e LEFT JOIN ev ON ev.episode = e.episode AND ev.arm = 'arm10' AND ev.event = 1 LEFT JOIN tr ON tr.episode = e.episode)"


def first_rows(spark, sf):
    """Every episode with its first proposal, or none, beside the truth."""
    first = events(spark, sf).where("arm = 'arm10' and event = 1").select("episode", "period", "outcome", "family", "direction")
    truth = truths(spark, sf).select("episode", F.col("family").alias("true_family"), "onset")
    rows = run_records(spark, sf).select("episode").distinct().join(first, "episode", "left").join(truth, "episode", "left")
    return rows.select("episode", "period", F.coalesce("outcome", F.lit("no_call")).alias("outcome"), "family", "direction", "true_family", "onset", (F.col("period") - F.col("onset")).alias("delay"))


@query(PROPOSED + f", {EV}, {FP} SELECT * FROM fp")
def first_proposals(spark, sf):
    return first_rows(spark, sf)


@query(PROPOSED + f", {EV}, {FP} SELECT outcome, COUNT(*) AS episodes, COUNT(*) FILTER (family = true_family) AS right_family, ROUND(MEDIAN(delay), 4) AS median_delay FROM fp GROUP BY 1")
def first_proposal_accuracy(spark, sf):
    return rounded(first_rows(spark, sf).groupBy("outcome").agg(F.count("*").alias("episodes"), F.count_if(F.col("family") == F.col("true_family")).alias("right_family"), F.median("delay").alias("median_delay")))


@query(PROPOSED + f", {EV}, fs AS (SELECT DISTINCT ON (arm, episode) * FROM ev ORDER BY arm, episode, period) SELECT arm, COUNT(*) AS called_shocked, COUNT(*) FILTER (parsed AND NOT abstention AND fs.family = tr.family AND fs.direction = tr.direction) AS family_right, COUNT(*) FILTER (parsed AND abstention) AS abstain, COUNT(*) FILTER (NOT parsed) AS parse_fail FROM fs JOIN tr USING (episode) GROUP BY arm")
def perception_counts(spark, sf):
    first = P.first_row(events(spark, sf), ["arm", "episode"], ["period"])
    t = truths(spark, sf).select("episode", F.col("family").alias("tf"), F.col("direction").alias("td"))
    said = F.col("parsed") & ~F.col("abstention")
    right = said & (F.col("family") == F.col("tf")) & (F.col("direction") == F.col("td"))
    return first.join(t, "episode").groupBy("arm").agg(F.count("*").alias("called_shocked"), F.count_if(right).alias("family_right"), F.count_if(F.col("parsed") & F.col("abstention")).alias("abstain"), F.count_if(~F.col("parsed")).alias("parse_fail"))


OKS = "p.family <> 'no_change' AND p.family = t.family AND p.direction = t.direction AS family_ok, p.family <> 'no_change' AND t.onset - p.period BETWEEN lo AND hi AS onset_ok, p.family <> 'no_change' AND p.magnitude = t.magnitude AS magnitude_ok, p.family <> 'no_change' AND p.persistence = t.persistence AS persistence_ok, p.family <> 'no_change' AND p.duration = t.duration AS duration_ok"
SC = f"sc AS (SELECT p.episode, p.arm, p.period, {OKS}, p.stream = t.stream AS stream_ok FROM ev p JOIN tr t USING (episode))"


def scores(spark, sf):
    p = events(spark, sf).select("episode", "arm", F.struct("family", "direction", "stream", "magnitude", "persistence", "duration", "lo", "hi", F.col("period").alias("tau")).alias("p"))
    t = truths(spark, sf).select("episode", F.struct("family", "direction", "stream", "onset", "magnitude", "persistence", "duration").alias("t"))
    return p.join(t, "episode").select("episode", "arm", F.col("p.tau").alias("period"), *[v.alias(k) for k, v in R.field_scores().items()])


@query(PROPOSED + f", {EV}, {SC} SELECT episode, arm, period, family_ok, onset_ok, magnitude_ok, persistence_ok, duration_ok, family_ok AND onset_ok AND magnitude_ok AND persistence_ok AND duration_ok AND stream_ok AS full_ok FROM sc")
def proposal_field_scores(spark, sf):
    return scores(spark, sf)


@query(PROPOSED + f", {EV}, ag AS (SELECT a.outcome AS oa, b.outcome AS ob, a.family AS fa, b.family AS fb FROM ev a JOIN ev b ON a.episode = b.episode AND a.arm = 'arm10' AND b.arm = 'arm8' AND a.event = 1 AND b.event = 1) SELECT COUNT(*) AS episodes, COUNT(*) FILTER (oa = ob) AS same_outcome, COUNT(*) FILTER (fa = fb) AS same_family, COUNT(*) FILTER (oa = 'shock' AND ob = 'shock') AS both_shock FROM ag")
def run_agreement(spark, sf):
    """Two runs' first proposals side by side."""
    first = events(spark, sf).where("event = 1")
    side = lambda arm, n: first.where(F.col("arm") == arm).select("episode", F.col("outcome").alias(f"o{n}"), F.col("family").alias(f"f{n}"))
    both = side("arm10", "a").join(side("arm8", "b"), "episode")
    shock = lambda c: F.col(c) == "shock"
    return both.agg(F.count("*").alias("episodes"), F.count_if(F.col("oa") == F.col("ob")).alias("same_outcome"), F.count_if(F.col("fa") == F.col("fb")).alias("same_family"), F.count_if(shock("oa") & shock("ob")).alias("both_shock"))


@query(PROPOSED + """, kd AS (SELECT condition, episode, MAX(CASE WHEN parsed AND NOT abstention THEN 1 ELSE 0 END) FILTER (arm = 'arm10') AS a, MAX(CASE WHEN parsed AND NOT abstention THEN 1 ELSE 0 END) FILTER (arm = 'arm8') AS b FROM pp JOIN (SELECT DISTINCT episode, condition FROM rr) USING (episode) GROUP BY 1, 2)
 SELECT condition, COUNT(*) FILTER (a = 1 AND b = 1) AS both, COUNT(*) FILTER (a + b = 1) AS one, COUNT(*) FILTER (a + b = 0) AS neither FROM kd GROUP BY 1""")
def paired_two_by_two(spark, sf):
    """Episodes in which both arms, one or neither proposed a shock, by condition."""
    said = (F.col("parsed") & ~F.col("abstention")).cast("int")
    kinds = run_records(spark, sf).select("episode", "condition").distinct()
    side = lambda arm: F.max(F.when(F.col("arm") == arm, said))
    both = proposals(spark, sf).join(kinds, "episode").groupBy("condition", "episode").agg(side("arm10").alias("a"), side("arm8").alias("b"))
    n = F.col("a") + F.col("b")
    return both.groupBy("condition").agg(F.count_if(n == 2).alias("both"), F.count_if(n == 1).alias("one"), F.count_if(n == 0).alias("neither"))


# what became of each episode under a gated arm
CLS = """fi AS (SELECT episode, LIST(DISTINCT period ORDER BY period) AS firings, MIN(period) AS first_firing, COUNT(DISTINCT period) AS n_firings FROM pp WHERE arm = 'arm10' GROUP BY 1),
 ac AS (SELECT episode, MIN(period) FILTER (active_family IS NOT NULL) AS t_act, COUNT(active_family) AS active_periods FROM rr WHERE arm = 'arm10' GROUP BY 1),
 sd AS (SELECT rr.episode, MIN(period) AS stood_down FROM rr JOIN ac ON ac.episode = rr.episode WHERE arm = 'arm10' AND period > t_act AND active_family IS NULL GROUP BY 1),
 kc AS (SELECT f.episode, f.family, f.condition, f.is_null, first_firing, n_firings, t_act, active_periods, stood_down, CASE WHEN first_firing IS NULL THEN 'no_fire' WHEN t_act IS NULL THEN 'blocked' ELSE 'activated' END AS category, t_act - first_firing AS delay,
 f.profit - b.profit AS gap_profit, f.lost - b.lost AS gap_lost FROM fc f JOIN fc b ON b.episode = f.episode AND b.arm = 'arm1' LEFT JOIN fi ON fi.episode = f.episode LEFT JOIN ac ON ac.episode = f.episode LEFT JOIN sd ON sd.episode = f.episode WHERE f.arm = 'arm10')"""


def classified(spark, sf):
    """episode, category (no_fire, blocked, activated), first firing, activation, stand-down, delay, and gaps to the base arm."""
    fired = proposals(spark, sf).where("arm = 'arm10'").groupBy("episode").agg(F.min("period").alias("first_firing"), F.count_distinct("period").alias("n_firings"))
    mine = run_records(spark, sf).where("arm = 'arm10'")
    acts = mine.groupBy("episode").agg(F.min(F.when(F.col("active_family").isNotNull(), F.col("period"))).alias("t_act"), F.count("active_family").alias("active_periods"))
    down = mine.join(acts, "episode").where("period > t_act and active_family is null").groupBy("episode").agg(F.min("period").alias("stood_down"))
    f = facts(spark, sf)
    base = f.where("arm = 'arm1'").select("episode", F.col("profit").alias("bp"), F.col("lost").alias("bl"))
    rows = f.where("arm = 'arm10'").select("episode", "family", "condition", "is_null", "profit", "lost").join(base, "episode")
    for part in (fired, acts, down):
        rows = rows.join(part, "episode", "left")
    category = F.when(F.col("first_firing").isNull(), "no_fire").when(F.col("t_act").isNull(), "blocked").otherwise("activated")
    return rows.select("episode", "family", "condition", "is_null", "first_firing", "n_firings", "t_act", "active_periods", "stood_down", category.alias("category"), (F.col("t_act") - F.col("first_firing")).alias("delay"), (F.col("profit") - F.col("bp")).alias("gap_profit"), (F.col("lost") - F.col("bl")).alias("gap_lost"))


@query(KNOWN + f", {CLS} SELECT * FROM kc")
def episode_categories(spark, sf):
    return classified(spark, sf)


@query(KNOWN + f", {CLS} SELECT family, COUNT(*) AS episodes, COUNT(first_firing) AS fired, COUNT(*) FILTER (category = 'activated') AS activated, COUNT(stood_down) AS stood_down, QUANTILE_CONT(delay, 0) AS d0, QUANTILE_CONT(delay, 0.5) AS d50, QUANTILE_CONT(delay, 1) AS d100 FROM kc GROUP BY 1")
def activation_summary(spark, sf):
    rows = classified(spark, sf)
    counts = rows.groupBy("family").agg(F.count("*").alias("episodes"), F.count("first_firing").alias("fired"), F.count_if(F.col("category") == "activated").alias("activated"), F.count("stood_down").alias("stood_down"))
    return counts.join(P.linear_quantiles(rows, "delay", {"d0": 0.0, "d50": 0.5, "d100": 1.0}, ["family"]), "family", "left")


@query(KNOWN + f", {CLS} SELECT COALESCE(family, 'all') AS family, COUNT(*) AS n, ROUND(AVG(gap_profit), 4) AS gap_profit, ROUND(AVG(gap_lost), 4) AS gap_lost FROM kc WHERE category = 'activated' GROUP BY ROLLUP (family)")
def benefit_given_activation(spark, sf):
    rows = classified(spark, sf).where("category = 'activated'").rollup("family").agg(F.count("*").alias("n"), F.avg("gap_profit").alias("gap_profit"), F.avg("gap_lost").alias("gap_lost"))
    return rounded(rows.withColumn("family", F.coalesce("family", F.lit("all"))))


@query(KNOWN + f", {CLS} SELECT condition, COUNT(*) AS n, COUNT(*) FILTER (category = 'activated') AS activated, COUNT(*) FILTER (category = 'blocked') AS blocked, COUNT(*) FILTER (category = 'no_fire') AS no_fire, ROUND(AVG(gap_profit), 4) AS gap_profit FROM kc WHERE is_null GROUP BY 1")
def null_summary(spark, sf):
    count = lambda c: F.count_if(F.col("category") == c).alias(c)
    return rounded(classified(spark, sf).where("is_null").groupBy("condition").agg(F.count("*").alias("n"), count("activated"), count("blocked"), count("no_fire"), F.avg("gap_profit").alias("gap_profit")))


ACT = "CASE WHEN family = 'no_change' THEN 'null' WHEN family IN ('lead_time_shift', 'shipment_loss', 'transit_pause') AND condition = 'none' THEN 'supply_no_alert' WHEN family IN ('lead_time_shift', 'shipment_loss', 'transit_pause') THEN 'supply_alert_only' ELSE 'demand_visible' END"


@query(KNOWN + f", {CLS} SELECT {ACT} AS class, COUNT(*) AS n, ROUND(SUM(gap_profit) / (SELECT COUNT(*) FROM kc), 4) AS contribution, ROUND(SUM(gap_profit) / (SELECT SUM(gap_profit) FROM kc), 6) AS share FROM kc GROUP BY 1")
def gap_by_actionability(spark, sf):
    rows = classified(spark, sf).withColumn("class", R.actionability(F.col("family"), F.col("condition")))
    total = rows.agg(F.count("*").alias("all"), F.sum("gap_profit").alias("sum"))
    cells = rows.groupBy("class").agg(F.count("*").alias("n"), F.sum("gap_profit").alias("s")).join(F.broadcast(total))  # one row
    return cells.select("class", "n", F.round(F.col("s") / F.col("all"), 4).alias("contribution"), F.round(F.try_divide("s", "sum"), 6).alias("share"))


@query(KNOWN + f", {CLS} SELECT family, condition, ROUND(SUM(gap_profit) / (SELECT COUNT(*) FROM kc), 4) AS contribution, COUNT(*) AS rows FROM kc GROUP BY 1, 2")
def gap_by_cell(spark, sf):
    return rounded(E.contribution(classified(spark, sf), "gap_profit", ["family", "condition"]))


FR = f"fr AS (SELECT k.episode, k.family, k.condition, k.is_null, k.first_firing, k.n_firings, fi.firings, CASE WHEN k.first_firing % 20 = 0 THEN 'alert' ELSE 'detector' END AS source, k.first_firing - tr.onset AS latency, tr.onset FROM kc k LEFT JOIN fi ON fi.episode = k.episode LEFT JOIN tr ON tr.episode = k.episode)"


def firings(spark, sf):
    """Each episode's firings in order, what fired first, and how long after the onset."""
    lists = proposals(spark, sf).where("arm = 'arm10'").groupBy("episode").agg(F.sort_array(F.collect_set("period")).alias("firings"))
    base = run_records(spark, sf).where("arm = 'arm10' and period = 1").select("episode", "family", "condition", (F.col("family") == "no_change").alias("is_null"))
    rows = base.join(lists, "episode", "left").join(truths(spark, sf).select("episode", "onset"), "episode", "left")
    first = F.get("firings", F.lit(0))
    return rows.withColumns({"first_firing": first, "n_firings": F.size("firings"), "source": F.when(first % 20 == 0, "alert").when(first.isNotNull(), "detector"), "latency": first - F.col("onset")})


@query(KNOWN + f", {CLS}, {FR} SELECT family, condition, COUNT(*) AS episodes, COUNT(first_firing) AS fired, COUNT(*) FILTER (source = 'alert' AND first_firing IS NOT NULL) AS alert_first, ROUND(AVG(COALESCE(n_firings, 0)), 6) AS firings, CAST(COALESCE(SUM(LEN(LIST_FILTER(firings, lambda p: p % 20 <> 0 AND p < onset))), 0) AS BIGINT) AS before_onset FROM fr GROUP BY 1, 2")
def firing_table(spark, sf):
    early = F.size(F.filter("firings", lambda p: (p % 20 != 0) & (p < F.col("onset"))))
    rows = firings(spark, sf)
    return rounded(rows.groupBy("family", "condition").agg(F.count("*").alias("episodes"), F.count("first_firing").alias("fired"), F.count_if(F.col("source") == "alert").alias("alert_first"), F.avg(F.greatest(F.lit(0), F.col("n_firings"))).alias("firings"), F.coalesce(F.sum(F.when(F.col("onset").isNotNull(), F.greatest(F.lit(0), early))), F.lit(0)).alias("before_onset")), 6)


@query(KNOWN + f", {CLS}, {FR} SELECT source, COUNT(f.episode) AS n FROM (SELECT UNNEST(['alert', 'detector', 'none']) AS source) s LEFT JOIN (SELECT episode, CASE WHEN first_firing IS NULL THEN 'none' ELSE source END AS source FROM fr) f USING (source) GROUP BY 1")
def firing_sources(spark, sf):
    rows = firings(spark, sf).withColumn("source", F.coalesce("source", F.lit("none")))
    return E.category_counts(rows, "source", ["alert", "detector", "none"]).select("source", "n")


@query(KNOWN + f", {CLS}, {FR}, dd AS (SELECT DISTINCT ON (family, cluster) *, FROM (SELECT *, episode // 24 AS cluster FROM fr) ORDER BY family, cluster, episode) SELECT family, COUNT(*) AS seeds, COUNT(first_firing) AS fired, COUNT(*) FILTER (first_firing IS NOT NULL AND (onset IS NULL OR first_firing >= onset)) AS at_or_after FROM dd GROUP BY 1")
def detector_power(spark, sf):
    """One row per seed, as its conditions repeat it."""
    rows = P.first_row(firings(spark, sf).withColumn("cluster", F.floor(F.col("episode") / 24)).select("family", "cluster", "episode", "first_firing", "onset"), ["family", "cluster"], ["episode"])
    late = F.col("first_firing").isNotNull() & (F.col("onset").isNull() | (F.col("first_firing") >= F.col("onset")))
    return rows.groupBy("family").agg(F.count("*").alias("seeds"), F.count("first_firing").alias("fired"), F.count_if(late).alias("at_or_after"))


MASS = "ms AS (SELECT episode, arm, is_null, mass, top, period FROM (SELECT episode, arm, family = 'no_change' AS is_null, (demand % 100) / 100 AS mass, active_family AS top, period FROM rr WHERE arm <> 'arm1'))"


def masses(spark, sf):
    """episode, arm, is_null, period, mass on a shock, and the top hypothesis."""
    return run_records(spark, sf).where("arm <> 'arm1'").select("episode", "arm", (F.col("family") == "no_change").alias("is_null"), "period", ((F.col("demand") % 100) / 100).alias("mass"), F.col("active_family").alias("top"))


@query(RECORDS + f", {MASS}, me AS (SELECT arm, episode, is_null, SUM(mass) AS s, MAX(mass) AS m FROM ms GROUP BY 1, 2, 3) SELECT arm, ROUND(AVG(s) FILTER (is_null), 4) AS null_mean, ROUND(MAX(m) FILTER (is_null), 4) AS null_max, COUNT(*) FILTER (is_null AND m >= 0.5) AS null_half, ROUND(AVG(s) FILTER (NOT is_null), 4) AS shocked_mean FROM me GROUP BY 1")
def mass_exposure(spark, sf):
    per = masses(spark, sf).groupBy("arm", "episode", "is_null").agg(F.sum("mass").alias("s"), F.max("mass").alias("m"))
    null = F.col("is_null")
    return rounded(per.groupBy("arm").agg(F.avg(F.when(null, F.col("s"))).alias("null_mean"), F.max(F.when(null, F.col("m"))).alias("null_max"), F.count_if(null & (F.col("m") >= 0.5)).alias("null_half"), F.avg(F.when(~null, F.col("s"))).alias("shocked_mean")))


@query(RECORDS + f", {MASS} SELECT arm, COALESCE(top, 'none') AS top, ROUND(SUM(mass) / (SELECT COUNT(DISTINCT episode) FROM ms WHERE is_null), 4) AS mass FROM ms WHERE is_null GROUP BY 1, 2")
def mass_by_hypothesis(spark, sf):
    rows = masses(spark, sf).where("is_null")
    n = rows.agg(F.count_distinct("episode").alias("n"))
    cells = rows.groupBy("arm", F.coalesce("top", F.lit("none")).alias("top")).agg(F.sum("mass").alias("s")).join(F.broadcast(n))  # one row
    return cells.select("arm", "top", F.round(F.col("s") / F.col("n"), 4).alias("mass"))


@query(PROPOSED + """, lp AS (SELECT DISTINCT ON (p.episode) p.episode, p.magnitude, p.period FROM pp p JOIN tr USING (episode) WHERE p.arm = 'arm10' AND parsed AND p.family = 'lead_time_shift' ORDER BY p.episode, p.period, p.attempt),
 la AS (SELECT lp.*, CASE magnitude WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS stated, 1 + episode % 2 AS true_shift, (SELECT MIN(period) FROM rr WHERE rr.episode = lp.episode AND arm = 'arm10' AND active_family IS NOT NULL) - period AS delay FROM lp)
 SELECT magnitude, COUNT(*) AS n, COUNT(*) FILTER (stated = true_shift) AS exact, COUNT(*) FILTER (stated > true_shift) AS too_large, COUNT(*) FILTER (stated < true_shift) AS too_small, MEDIAN(delay) AS median_delay FROM la GROUP BY 1""")
def lead_time_proposals(spark, sf):
    """Each shocked episode's first lead-time proposal: its stated size against the true shift, and periods to the first active one."""
    said = proposals(spark, sf).where("arm = 'arm10' and parsed and family = 'lead_time_shift'").join(truths(spark, sf).select("episode"), "episode", "left_semi")
    first = P.first_row(said.select("episode", "magnitude", "period", "attempt"), ["episode"], ["period", "attempt"])
    acts = run_records(spark, sf).where("arm = 'arm10' and active_family is not null").groupBy("episode").agg(F.min("period").alias("act"))
    rows = first.join(acts, "episode", "left").withColumns({"stated": F.when(F.col("magnitude") == "low", 1).when(F.col("magnitude") == "medium", 2).otherwise(3), "true": 1 + F.col("episode") % 2})
    return rows.groupBy("magnitude").agg(F.count("*").alias("n"), F.count_if(F.col("stated") == F.col("true")).alias("exact"), F.count_if(F.col("stated") > F.col("true")).alias("too_large"), F.count_if(F.col("stated") < F.col("true")).alias("too_small"), F.median(F.col("act") - F.col("period")).alias("median_delay"))


@query(FACTS + " SELECT 1 + f.episode % 2 AS shift, COUNT(*) AS episodes, ROUND(AVG(f.profit - b.profit), 4) AS difference FROM fc f JOIN fc b ON b.episode = f.episode AND b.arm = 'arm1' WHERE f.arm = 'arm10' AND f.family = 'lead_time_shift' GROUP BY 1")
def gain_by_shift(spark, sf):
    f = facts(spark, sf).withColumn("unit", F.col("episode"))
    d = E.paired_differences(f.where("family = 'lead_time_shift'"), "arm10", "arm1", "profit")
    return rounded(d.groupBy((1 + F.col("unit") % 2).alias("shift")).agg(F.count("*").alias("episodes"), F.avg("difference").alias("difference")))


@query(FACTS + " , gs AS (SELECT f.family, SUM(f.profit - b.profit) AS gain, AVG(f.profit - b.profit) AS mean, AVG(f.lost - b.lost) AS lost, COUNT(*) AS n FROM fc f JOIN fc b ON b.episode = f.episode AND b.arm = 'arm1' WHERE f.arm = 'arm10' GROUP BY 1) SELECT family, n, ROUND(mean, 4) AS mean, ROUND(gain / (SELECT SUM(gain) FROM gs), 6) AS share, SIGN(mean) = -SIGN(lost) AS signs_agree FROM gs")
def gain_shares(spark, sf):
    """Each family's share of the whole gain, its mean, and whether profit and lost units move against each other."""
    f = facts(spark, sf)
    b = f.where("arm = 'arm1'").select("episode", F.col("profit").alias("bp"), F.col("lost").alias("bl"))
    cells = f.where("arm = 'arm10'").join(b, "episode").groupBy("family").agg(F.sum(F.col("profit") - F.col("bp")).alias("gain"), F.avg(F.col("profit") - F.col("bp")).alias("mean"), F.avg(F.col("lost") - F.col("bl")).alias("lost"), F.count("*").alias("n"))
    total = cells.agg(F.sum("gain").alias("all"))
    return cells.join(F.broadcast(total)).select("family", "n", F.round("mean", 4).alias("mean"), F.round(F.try_divide("gain", "all"), 6).alias("share"), (F.signum("mean") == -F.signum("lost")).alias("signs_agree"))


@query(FACTS + " SELECT arm, ROUND(AVG(profit) / (SELECT AVG(profit) FROM fc WHERE arm = 'arm1'), 6) AS share, COUNT(*) AS n FROM fc GROUP BY 1")
def share_of_base(spark, sf):
    f = facts(spark, sf)
    base = f.where("arm = 'arm1'").agg(F.avg("profit").alias("b"))
    return f.groupBy("arm").agg(F.avg("profit").alias("m"), F.count("*").alias("n")).join(F.broadcast(base)).select("arm", F.round(F.try_divide("m", "b"), 6).alias("share"), "n")


CONTRASTS = (("arm10", "arm1"), ("arm8", "arm1"), ("arm10", "arm8"))


@query(FACTS + f", cc AS (SELECT t.arm || '-' || c.arm AS contrast, t.condition, t.profit - c.profit AS d FROM fc t JOIN fc c ON c.episode = t.episode AND (t.arm, c.arm) IN {CONTRASTS}) SELECT contrast, COALESCE(condition, 'all') AS condition, ROUND(AVG(d), 4) AS estimate, ROUND(AVG(d) - COALESCE({Z} * STDDEV_SAMP(d) / SQRT(COUNT(*)), 0), 4) AS low, ROUND(AVG(d) + COALESCE({Z} * STDDEV_SAMP(d) / SQRT(COUNT(*)), 0), 4) AS high, COUNT(*) AS n FROM cc GROUP BY contrast, ROLLUP (condition)")
def contrasts_by_condition(spark, sf):
    """Contrasts over all and by condition, in one aggregation."""
    f = facts(spark, sf)
    names = f.sparkSession.createDataFrame([(t, c) for t, c in CONTRASTS], "t string, c string")
    wide = f.groupBy("episode", "condition").agg(F.map_from_entries(F.collect_list(F.struct("arm", "profit"))).alias("p"))
    rows = wide.join(F.broadcast(names)).select(F.concat_ws("-", "t", "c").alias("contrast"), F.explode(F.array(F.col("condition"), F.lit("all"))).alias("condition"), (F.try_element_at("p", "t") - F.try_element_at("p", "c")).alias("d")).where("d is not null")
    return rounded(I.mean_interval(rows, "d", ["contrast", "condition"]))


@query(FACTS + f", {PP}, {EV} SELECT condition, arm, COUNT(DISTINCT f.episode) AS episodes, COUNT(ev.period) AS calls, COUNT(*) FILTER (ev.outcome = 'shock') AS shocks FROM (SELECT DISTINCT episode, condition FROM fc WHERE is_null) f JOIN ev USING (episode) GROUP BY 1, 2")
def null_controls(spark, sf):
    nulls = run_records(spark, sf).where("family = 'no_change'").select("episode", "condition").distinct()
    return events(spark, sf).join(nulls, "episode").groupBy("condition", "arm").agg(F.count_distinct("episode").alias("episodes"), F.count("*").alias("calls"), F.count_if(F.col("outcome") == "shock").alias("shocks"))


@query(PROPOSED + " SELECT arm, COUNT(*) AS calls, COUNT(*) FILTER (attempt > 1) AS retries, ROUND(SUM(usd), 4) AS usd, COUNT(DISTINCT prompt) AS prompts, COUNT(*) FILTER (attempt = 1) AS first_attempts FROM pp GROUP BY 1")
def run_operations(spark, sf):
    p = proposals(spark, sf)
    return rounded(p.groupBy("arm").agg(F.count("*").alias("calls"), F.count_if(F.col("attempt") > 1).alias("retries"), F.sum("usd").alias("usd"), F.count_distinct("prompt").alias("prompts"), F.count_if(F.col("attempt") == 1).alias("first_attempts")))


PRICES = (("cheap", 0.1), ("dear", 2.0))


@query(PROPOSED + " SELECT arm, endpoint, n * multiplier AS calls, ROUND(n * multiplier * price * 0.001, 6) AS projected FROM (SELECT arm, COUNT(*) AS n FROM pp GROUP BY 1), (VALUES ('cheap', 0.1::DOUBLE), ('dear', 2.0::DOUBLE)) e(endpoint, price), (SELECT UNNEST([1, 10]) AS multiplier)")
def price_projection(spark, sf):
    n = proposals(spark, sf).groupBy("arm").agg(F.count("*").alias("n"))
    prices = spark.createDataFrame(list(PRICES), "endpoint string, price double")
    rows = n.join(F.broadcast(prices)).withColumn("multiplier", F.explode(F.array(F.lit(1), F.lit(10))))
    return rows.select("arm", "endpoint", (F.col("n") * F.col("multiplier")).alias("calls"), F.round(F.col("n") * F.col("multiplier") * F.col("price") * 0.001, 6).alias("projected"))


@query(PROPOSED + ", fa AS (SELECT prompt, MIN(usd) AS a FROM pp WHERE arm = 'arm10' GROUP BY 1), fb AS (SELECT prompt, MIN(usd) AS b FROM pp WHERE arm = 'arm8' GROUP BY 1) SELECT COUNT(*) AS prompts, COUNT(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS shared, ROUND(SUM(a) FILTER (b IS NOT NULL) / NULLIF(SUM(b) FILTER (a IS NOT NULL), 0), 6) AS ratio, (SELECT COUNT(*) FROM (SELECT DISTINCT episode FROM pp WHERE arm = 'arm10' AND prompt NOT IN (SELECT prompt FROM fb))) AS unshared_episodes FROM fa FULL JOIN fb USING (prompt)")
def digest_matched_cost(spark, sf):
    """Cost of prompts that two runs share, and episodes with a prompt that only one has."""
    p = proposals(spark, sf)
    side = lambda arm, n: p.where(F.col("arm") == arm).groupBy("prompt").agg(F.min("usd").alias(n))
    both = side("arm10", "a").join(side("arm8", "b"), "prompt", "full")
    shared = F.col("a").isNotNull() & F.col("b").isNotNull()
    alone = p.where("arm = 'arm10'").join(side("arm8", "b"), "prompt", "left_anti").agg(F.count_distinct("episode").alias("unshared_episodes"))
    ratio = F.try_divide(F.sum(F.when(shared, F.col("a"))), F.sum(F.when(shared, F.col("b"))))
    return both.agg(F.count("*").alias("prompts"), F.count_if(shared).alias("shared"), F.round(ratio, 6).alias("ratio")).join(F.broadcast(alone))


@query(RECORDS + " SELECT x.episode, COUNT(*) AS differences FROM rr x JOIN rr y ON x.episode = y.episode AND x.period = y.period AND x.arm = 'arm10' AND y.arm = 'arm1' WHERE x.period NOT BETWEEN 20 + x.episode % 3 AND 40 AND x.sold <> y.sold GROUP BY 1")
def differences_outside_window(spark, sf):
    """Periods outside the true window in which two arms sell differently."""
    r = run_records(spark, sf).where("arm in ('arm1', 'arm10')")
    both = r.groupBy("episode", "period").agg(F.count_distinct("sold").alias("k"))
    return both.where((F.col("k") > 1) & ~F.col("period").between(20 + F.col("episode") % 3, 40)).groupBy("episode").agg(F.count("*").alias("differences"))


@query(RECORDS + ", rp AS (SELECT episode, arm, LIST(STRUCT_PACK(period := period, sold := sold) ORDER BY period) AS path FROM rr WHERE arm IN ('arm1', 'arm8') GROUP BY 1, 2) SELECT arm, COUNT(*) AS episodes, COUNT(DISTINCT path) AS paths, MIN(LEN(path)) AS periods FROM rp GROUP BY 1")
def periods_by_arm(spark, sf):
    paths = run_records(spark, sf).where("arm in ('arm1', 'arm8')").groupBy("episode", "arm").agg(F.sort_array(F.collect_list(F.struct("period", "sold"))).alias("path"))
    return paths.groupBy("arm").agg(F.count("*").alias("episodes"), F.count_distinct(F.sha2(F.to_json("path"), 256)).alias("paths"), F.min(F.size("path")).cast("long").alias("periods"))


@query(KNOWN + " SELECT f.episode, f.arm, COUNT(pp.period) AS calls, ROUND(COALESCE(SUM(usd), 0), 6) AS usd, ROUND(f.profit, 2) AS profit FROM fc f LEFT JOIN pp ON pp.episode = f.episode AND pp.arm = f.arm GROUP BY f.episode, f.arm, f.profit")
def results_with_calls(spark, sf):
    """Every result with the calls charged to it."""
    calls = proposals(spark, sf).groupBy("episode", "arm").agg(F.collect_list(F.struct("period", "attempt", "usd")).alias("calls"))
    rows = facts(spark, sf).select("episode", "arm", "profit").join(calls, ["episode", "arm"], "left")
    cost = F.aggregate(F.coalesce("calls", F.array().cast(calls.schema["calls"].dataType)), F.lit(0.0), lambda s, c: s + c["usd"])
    return rows.select("episode", "arm", F.greatest(F.lit(0), F.size("calls")).cast("long").alias("calls"), F.round(cost, 6).alias("usd"), F.round("profit", 2).alias("profit"))


@query(RECORDS + f", {MASS} SELECT is_null, COUNT(*) AS rows FROM (SELECT ms.*, EXISTS (SELECT 1 FROM rr WHERE rr.episode = ms.episode AND rr.family = 'no_change') AS in_nulls FROM ms) WHERE in_nulls = is_null GROUP BY 1")
def null_semi_anti(spark, sf):
    """Log rows of null episodes by a semi join, the others by an anti join."""
    log, nulls = masses(spark, sf), run_records(spark, sf).where("family = 'no_change'").select("episode").distinct()
    return log.join(nulls, "episode", "left_semi").unionByName(log.join(nulls, "episode", "left_anti")).groupBy("is_null").agg(F.count("*").alias("rows"))


@query(FACTS + ", ref AS (SELECT episode, ROUND(profit) AS profit FROM fc WHERE arm = 'arm1' AND episode % 7 <> 0) SELECT COUNT(*) AS episodes, COUNT(*) FILTER (ref.episode IS NULL) AS missing, ROUND(MAX(ABS(fc.profit - ref.profit)), 4) AS max_abs_difference FROM fc LEFT JOIN ref ON ref.episode = fc.episode WHERE arm = 'arm1'")
def reference_alignment(spark, sf):
    mine = facts(spark, sf).where("arm = 'arm1'").select("episode", "profit")
    ref = mine.where("episode % 7 <> 0").select("episode", F.round("profit").alias("reference"))
    return mine.join(ref, "episode", "left").agg(F.count("*").alias("episodes"), F.count_if(F.col("reference").isNull()).alias("missing"), F.round(F.max(F.abs(F.col("profit") - F.col("reference"))), 4).alias("max_abs_difference"))


@query(FACTS + " SELECT source, condition, COUNT(*) AS rows, ROUND(AVG(profit), 4) AS profit FROM (SELECT 'stored' AS source, episode, profit FROM fc WHERE arm = 'arm1' UNION ALL SELECT 'variant', episode, profit FROM fc WHERE arm = 'arm8') x JOIN (SELECT DISTINCT episode, condition FROM fc) USING (episode) GROUP BY 1, 2")
def stored_and_variant(spark, sf):
    f = facts(spark, sf)
    part = lambda arm, name: f.where(F.col("arm") == arm).select(F.lit(name).alias("source"), "episode", "profit")
    meta = f.select("episode", "condition").distinct()
    return rounded(part("arm1", "stored").unionByName(part("arm8", "variant")).join(meta, "episode").groupBy("source", "condition").agg(F.count("*").alias("rows"), F.avg("profit").alias("profit")))


@query(FACTS + ", ia AS (SELECT episode FROM fc WHERE arm = 'arm10' AND episode % 11 <> 0), ib AS (SELECT episode FROM fc WHERE arm = 'arm8') SELECT (SELECT COUNT(*) FROM ia WHERE episode NOT IN (SELECT episode FROM ib)) AS only_a, (SELECT COUNT(*) FROM ib WHERE episode NOT IN (SELECT episode FROM ia)) AS only_b, (SELECT COUNT(*) FROM ia JOIN ib USING (episode)) AS both")
def run_id_sets(spark, sf):
    f = facts(spark, sf)
    a, b = f.where("arm = 'arm10' and episode % 11 <> 0").select("episode", F.lit(1).alias("a")), f.where("arm = 'arm8'").select("episode", F.lit(1).alias("b"))
    both = a.join(b, "episode", "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


@query(FACTS + " SELECT condition, ROUND(AVG(profit) FILTER (arm = 'arm1'), 4) AS profit_arm1, ROUND(AVG(profit) FILTER (arm = 'arm10'), 4) AS profit_arm10, ROUND(AVG(fill) FILTER (arm = 'arm1'), 6) AS fill_arm1, ROUND(AVG(fill) FILTER (arm = 'arm10'), 6) AS fill_arm10, CAST(SUM(lost) FILTER (arm = 'arm1') AS BIGINT) AS lost_arm1, CAST(SUM(lost) FILTER (arm = 'arm10') AS BIGINT) AS lost_arm10 FROM fc GROUP BY 1")
def multi_value_pivot(spark, sf):
    wide = facts(spark, sf).groupBy("condition").pivot("arm", ["arm1", "arm10"]).agg(F.round(F.avg("profit"), 4).alias("profit"), F.round(F.avg("fill"), 6).alias("fill"), F.sum("lost").alias("lost"))
    return wide.select("condition", *[F.col(f"{a}_{m}").alias(f"{m}_{a}") for m in ("profit", "fill", "lost") for a in ("arm1", "arm10")])


IDS = "ids AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'broken ' || o_orderkey ELSE (['dev', 'cal', 'test'])[o_orderkey % 3 + 1] || '/f' || (o_orderkey % 7) || '/s' || (1000000 + o_orderkey) || '/' || (['no_alert', 'early_accurate'])[o_orderkey % 2 + 1] || CASE WHEN o_orderkey % 5 = 0 THEN '__twin' ELSE '' END END AS id, o_orderkey AS k, o_totalprice AS price FROM orders)"


def ids(spark, sf):
    k = F.col("o_orderkey")
    made = F.concat(pick(("dev", "cal", "test"), k % 3), F.lit("/f"), k % 7, F.lit("/s"), 1_000_000 + k, F.lit("/"), pick(("no_alert", "early_accurate"), k % 2), F.when(k % 5 == 0, "__twin").otherwise(""))
    return table(spark, sf, "orders").select(F.when(k % 13 == 0, F.concat(F.lit("broken "), k)).otherwise(made).alias("id"), k.alias("k"), F.col("o_totalprice").alias("price"))


GROUPS = r"REGEXP_EXTRACT(id, '^([a-z_]+)/f([0-9]+)/s([0-9]+)/([a-z_]+?)(__twin)?$', {k})"


@query(f"WITH {IDS} SELECT id, NULLIF({GROUPS.format(k=1)}, '') AS split, CAST(NULLIF({GROUPS.format(k=2)}, '') AS INT) AS family, CAST(NULLIF({GROUPS.format(k=3)}, '') AS BIGINT) AS seed, NULLIF({GROUPS.format(k=4)}, '') AS condition, CASE WHEN {GROUPS.format(k=1)} <> '' THEN {GROUPS.format(k=5)} <> '' END AS is_null, CASE WHEN {GROUPS.format(k=1)} <> '' THEN REGEXP_EXTRACT(id, '^[a-z_]+/f[0-9]+/s[0-9]+') END AS cluster FROM ids")
def parsed_episode_ids(spark, sf):
    return ids(spark, sf).select("id", R.parsed_id(F.col("id")).alias("p")).select("id", "p.*")


@query("SELECT o_orderkey, (4000000 + o_orderkey * 37 % 3000000) // 1000000 AS family, (4000000 + o_orderkey * 37 % 3000000) % 1000000 - (4000000 + o_orderkey * 37 % 3000000) % 100000 AS base, (4000000 + o_orderkey * 37 % 3000000) % 100000 AS \"index\" FROM orders")
def seed_decode(spark, sf):
    seed = 4_000_000 + F.col("o_orderkey") * 37 % 3_000_000
    return table(spark, sf, "orders").select("o_orderkey", R.unit_of_seed(seed).alias("u")).select("o_orderkey", "u.*")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS ratio, CASE o_orderkey % 3 WHEN 0 THEN 'lead_time_0' WHEN 1 THEN 'lead_time_4' END AS lead, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0.05 WHEN 2 THEN 2.5 END AS threshold,
 CASE o_orderkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 19 WHEN 2 THEN 18 ELSE 1 END AS anchor, CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE SUBSTR('error ' || o_orderkey || REPEAT('x', 100), 1, 90) END AS error, CASE WHEN o_orderkey % 6 = 0 THEN 'Infinity'::DOUBLE ELSE GREATEST(0.0, o_orderkey % 3 - 1.0) END AS noisy, CASE WHEN o_orderkey % 6 = 0 THEN 'Infinity'::DOUBLE ELSE LEAST(1.0, GREATEST(0.0, o_orderkey % 3 - 1.0)) END AS clipped,
 ROUND((o_orderkey * 2.5 + 10 * 10.0) / 1000000, 9) AS usd, CASE WHEN o_orderkey % 7 = 0 THEN 'transient' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'refusal' WHEN 1 THEN 'transient' WHEN 2 THEN 'fatal' ELSE 'transient' END END AS kind, SHA256(COALESCE(CASE WHEN o_orderkey % 2 = 0 THEN 'sys' END, '') || CHR(0) || o_orderstatus) AS digest FROM orders""")
def record_functions(spark, sf):
    k = F.col("o_orderkey")
    profit = F.when(k % 4 == 0, 19.0).when(k % 4 == 1, 4.0).when(k % 4 == 2, 1.0).otherwise(2.0)
    path = F.concat(F.lit("x/"), pick(("lead_time_0", "lead_time_4", "other"), k % 3), F.lit("/test.csv"))
    named = F.create_map(F.lit("small"), F.lit(0.05))
    error = F.when(k % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("error "), k, F.repeat(F.lit("x"), 100), F.lit("\nmore")))
    lead = F.when(k % 6 == 0, float("inf")).otherwise((k % 3).cast("double"))
    # as the SQL's last branches have it: also for a key that is negative or null
    status = F.coalesce(pick(("403", "429", "400"), k % 4), F.lit("503")).cast("int")
    named_anchor = F.coalesce(pick(("onset", "early1", "early2"), k % 4), F.lit("start"))
    # exact until the price is divided, and rounded as the SQL rounds doubles, by their product with a power of ten: other
    # ways differ from it where a double has no ninth digit
    usd = F.round(R.call_cost(k, F.lit(10), Decimal("2.5"), Decimal("10.0")) * 1e9) / 1e9
    return table(spark, sf, "orders").select(
        "o_orderkey", R.cost_ratio(profit).alias("ratio"), R.path_label(path, ("lead_time_0", "lead_time_4")).alias("lead"), R.threshold_of(pick(("none", "small", "2.5", "bad"), k % 4), named).alias("threshold"),
        R.anchor(named_anchor, F.lit(20)).alias("anchor"), F.when(k.isNotNull(), R.error_class(error)).alias("error"), R.noisy_lead(lead, F.lit(-1)).alias("noisy"), R.noisy_lead(lead, F.lit(-1), F.lit(1.0)).alias("clipped"),
        usd.alias("usd"), R.error_kind(status, F.coalesce(k % 7 != 0, F.lit(True))).alias("kind"), R.request_digest(F.when(k % 2 == 0, "sys"), F.col("o_orderstatus")).alias("digest"),
    )


SPEC = "sp0 AS (SELECT o_orderkey AS k, (['no_change', 'demand_level', 'temporary_pulse', 'lead_time_shift', 'shipment_loss', 'transit_pause', 'compound'])[o_orderkey % 7 + 1] AS family, 0.5 + (o_orderkey % 4) * 0.5 AS magnitude, CAST(1 + o_orderkey % 12 AS INT) AS duration FROM orders)"
FAMILY7 = ("no_change", "demand_level", "temporary_pulse", "lead_time_shift", "shipment_loss", "transit_pause", "compound")


@query(f"""WITH {SPEC} SELECT k, CASE WHEN family IN ('demand_level', 'temporary_pulse') THEN CASE WHEN magnitude > 1 THEN 'demand_up' WHEN magnitude < 1 THEN 'demand_down' END WHEN family = 'lead_time_shift' THEN 'arrival_delayed' WHEN family IN ('shipment_loss', 'transit_pause') THEN 'arrival_interrupted' WHEN family = 'compound' THEN 'mixed' END AS direction,
 CASE WHEN family IN ('demand_level', 'temporary_pulse') THEN 'demand' WHEN family = 'compound' THEN 'both' WHEN family <> 'no_change' THEN 'arrival' END AS target_stream, CASE WHEN ABS(magnitude - 1) < 0.3 THEN 'low' WHEN ABS(magnitude - 1) < 0.6 THEN 'medium' ELSE 'high' END AS magnitude_bin, CASE WHEN family IN ('temporary_pulse', 'compound') THEN 'transient' ELSE 'persistent' END AS persistence,
 CASE WHEN duration <= 3 THEN '1_3' WHEN duration <= 8 THEN '4_8' ELSE 'longer' END AS duration_bin, CASE WHEN family = 'demand_level' THEN CASE WHEN magnitude > 1 THEN 'demand_up' WHEN magnitude < 1 THEN 'demand_down' END WHEN family = 'lead_time_shift' THEN 'lead_time' WHEN family = 'temporary_pulse' AND magnitude > 1 THEN 'pulse_up' END AS hypothesis FROM sp0""")
def incident_payloads(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k.alias("k"), pick(FAMILY7, k % 7).alias("family"), (0.5 + (k % 4) * 0.5).alias("magnitude"), (1 + k % 12).cast("int").alias("duration"))
    made = rows.select("k", "family", R.incident_payload(F.col("family"), F.col("magnitude"), F.col("duration")).alias("p"))
    return made.select("k", "p.direction", "p.target_stream", "p.magnitude_bin", "p.persistence", "p.duration_bin", R.hypothesis_key(F.col("family"), F.col("p.direction")).alias("hypothesis"))


@query(f"""WITH {SPEC} SELECT k, CASE WHEN family <> 'no_change' THEN NULLIF(CONCAT_WS('+', CASE WHEN k % 3 = 0 THEN 'persistence_none' END, CASE WHEN k % 5 = 0 THEN 'duration_none' END, CASE WHEN k % 60 >= 50 THEN 'tau_at_horizon' END), '') END AS reason,
 CASE WHEN family = 'no_change' AND k % 2 = 0 THEN NULL ELSE CASE WHEN k % 2 = 0 THEN 'none' ELSE 'low' END END AS magnitude, CASE WHEN family = 'no_change' THEN CASE WHEN k % 3 <> 0 THEN 'stream' WHEN k % 2 <> 0 THEN 'magnitude' END ELSE CASE WHEN k % 2 = 0 THEN 'no magnitude' WHEN k % 3 = 0 THEN 'no stream' END END AS fault FROM sp0""")
def proposal_faults(spark, sf):
    k, family = F.col("o_orderkey"), pick(FAMILY7, F.col("o_orderkey") % 7)
    reason = R.unregistrable(family, F.when(k % 3 == 0, "none").otherwise("transient"), F.when(k % 5 == 0, "none").otherwise("1_3"), k % 60, F.lit(50))
    magnitude = R.normal_abstention(family, F.when(k % 2 == 0, "none").otherwise("low"))
    none = family == "no_change"
    fault = R.spec_fault(family, F.when(k % 3 == 0, "none").otherwise("demand"), F.when(none, "none").otherwise("demand_up"), F.when(~none, F.lit(1)), magnitude)
    return table(spark, sf, "orders").select(k.alias("k"), reason.alias("reason"), magnitude.alias("magnitude"), fault.alias("fault"))


@query(f"WITH {IDS}, s AS (SELECT *, NULLIF({GROUPS.format(k=1)}, '') AS split FROM ids), w AS (SELECT UNNEST(['dev', 'holdout']) AS wanted) SELECT wanted, COUNT(*) AS rows FROM s, w WHERE wanted NOT IN (SELECT split FROM s WHERE split IS NOT NULL) OR split = wanted GROUP BY 1")
def split_or_all(spark, sf):
    """Rows of a split; all rows if the split is unknown or has none."""
    rows = ids(spark, sf).select(R.parsed_id(F.col("id"))["split"].alias("split"))
    wanted = spark.createDataFrame([("dev",), ("holdout",)], "wanted string")
    sizes = wanted.join(rows.groupBy("split").count(), F.col("wanted") == F.col("split"), "left").select("wanted", F.coalesce("count", F.lit(0)).alias("n"))
    total = rows.agg(F.count("*").alias("all"))
    return sizes.join(F.broadcast(total)).select("wanted", F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("all")).alias("rows"))


@query(KNOWN + f", {CLS} SELECT LIST(DISTINCT 1000000 + episode ORDER BY 1000000 + episode) AS seeds, LIST(DISTINCT family || '/' || condition ORDER BY family || '/' || condition) AS templates, COUNT(*) AS episodes FROM kc")
def pilot_manifest(spark, sf):
    """The seeds and templates that a pilot used, in order: a registered few hundred."""
    rows = classified(spark, sf)
    distinct = lambda c: F.sort_array(F.collect_set(c))
    return rows.agg(distinct(1_000_000 + F.col("episode")).alias("seeds"), distinct(F.concat_ws("/", "family", "condition")).alias("templates"), F.count("*").alias("episodes"))


@query(KNOWN + f", {CLS}, ce AS (SELECT family, condition, AVG(gap_profit) AS m, STDDEV_SAMP(gap_profit) / SQRT(COUNT(*)) AS se FROM kc GROUP BY 1, 2) SELECT family, COUNT(*) AS cells, COUNT(*) FILTER (m - 1.96 * se > 0) AS clear, COUNT(*) FILTER (m > 0 AND NOT COALESCE(m - 1.96 * se > 0, false)) AS point FROM ce GROUP BY 1")
def flags_by_family(spark, sf):
    """Cells whose gap is clear of zero, above it, or neither, by family."""
    from quayside.operators.hypotheses import flag

    cells = classified(spark, sf).groupBy("family", "condition").agg(F.avg("gap_profit").alias("m"), (F.stddev_samp("gap_profit") / F.sqrt(F.count("*"))).alias("se"))
    flags = cells.withColumn("flag", flag(F.col("m"), F.col("se"), 0.0))
    return flags.groupBy("family").agg(F.count("*").alias("cells"), F.count_if(F.col("flag") == "clear").alias("clear"), F.count_if(F.col("flag") == "point").alias("point"))


@query(KNOWN + f", {CLS}, dv AS (SELECT is_null, CAST(category = 'activated' AS INT) AS hit, episode // 6 AS cluster FROM kc) SELECT is_null, COUNT(*) AS n, SUM(hit)::BIGINT AS k, ROUND(AVG(hit), 6) AS estimate, ROUND(AVG(hit) - COALESCE({Z} * STDDEV_SAMP(hit) / SQRT(COUNT(*)), 0), 6) AS normal_low, ROUND(AVG(hit) + COALESCE({Z} * STDDEV_SAMP(hit) / SQRT(COUNT(*)), 0), 6) AS normal_high, ROUND((AVG(hit) + {Z * Z} / (2 * COUNT(*)) - {Z} * SQRT(AVG(hit) * (1 - AVG(hit)) / COUNT(*) + {Z * Z} / (4 * COUNT(*) * COUNT(*)))) / (1 + {Z * Z} / COUNT(*)), 6) AS wilson_low, ROUND((AVG(hit) + {Z * Z} / (2 * COUNT(*)) + {Z} * SQRT(AVG(hit) * (1 - AVG(hit)) / COUNT(*) + {Z * Z} / (4 * COUNT(*) * COUNT(*)))) / (1 + {Z * Z} / COUNT(*)), 6) AS wilson_high, COUNT(DISTINCT cluster) AS clusters FROM dv GROUP BY 1")
def activation_intervals(spark, sf):
    """Activation rates with normal and score intervals; resampled ones are exposure_ratio's and unit_bootstrap_ci's."""
    hit = (F.col("category") == "activated").cast("int")
    rows = classified(spark, sf).withColumns({"hit": hit, "cluster": F.floor(F.col("episode") / 6)})
    n, p = F.count("*"), F.avg("hit")
    half = F.coalesce(Z * F.stddev_samp("hit") / F.sqrt(n), F.lit(0.0))
    low, high = I.wilson(F.sum("hit"), n)
    return rounded(rows.groupBy("is_null").agg(n.alias("n"), F.sum("hit").alias("k"), p.alias("estimate"), (p - half).alias("normal_low"), (p + half).alias("normal_high"), low.alias("wilson_low"), high.alias("wilson_high"), F.count_distinct("cluster").alias("clusters")), 6)
