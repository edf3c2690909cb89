"""Queries over hypothesis cases, grids and Monte Carlo cells, each beside its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quayside.operators import evaluation as E
from quayside.operators import hypotheses as H
from quayside.operators import resampling as R
from quayside.plans.q_evaluation import PD, differences, rounded
from quayside.plans.runtime import table
from quayside.plans.views import CL, DP, ER, call_log, demand_panel, with_

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


CS = """cs AS (SELECT p_partkey AS item, CASE p_partkey % 4 WHEN 0 THEN 'no_change' WHEN 1 THEN 'demand_level' WHEN 2 THEN 'shipment_loss' ELSE 'compound' END AS true_family, CASE (p_partkey + p_size % 3) % 4 WHEN 0 THEN 'no_change' WHEN 1 THEN 'demand_level' WHEN 2 THEN 'shipment_loss' ELSE 'compound' END AS pred_family,
 CASE WHEN p_size % 5 > 0 THEN p_type END AS true_direction, CASE WHEN p_size % 5 > 1 THEN p_type END AS pred_direction, p_size % 3 > 0 AS activated, p_partkey % 4 = 0 AS true_null, p_size % 7 AS delay FROM part)"""


def cases(spark, sf):
    p = table(spark, sf, "part")
    family = lambda c: F.when(c % 4 == 0, "no_change").when(c % 4 == 1, "demand_level").when(c % 4 == 2, "shipment_loss").otherwise("compound")
    size = F.col("p_size")
    return p.select(F.col("p_partkey").alias("item"), family(F.col("p_partkey")).alias("true_family"), family(F.col("p_partkey") + size % 3).alias("pred_family"), F.when(size % 5 > 0, F.col("p_type")).alias("true_direction"), F.when(size % 5 > 1, F.col("p_type")).alias("pred_direction"), (size % 3 > 0).alias("activated"), (F.col("p_partkey") % 4 == 0).alias("true_null"), (size % 7).alias("delay"))


@query(with_(CS) + """SELECT COUNT(*) AS cases, ROUND(COUNT(*) FILTER (true_family = pred_family AND true_direction IS NOT DISTINCT FROM pred_direction) / COUNT(*), 6) AS exact,
 ROUND(COUNT(*) FILTER (pred_family = 'no_change' AND true_null) / COUNT(*) FILTER (pred_family = 'no_change'), 6) AS abstention_precision, ROUND(COUNT(*) FILTER (pred_family = 'no_change' AND true_null) / COUNT(*) FILTER (true_null), 6) AS abstention_recall,
 COUNT(*) FILTER (activated AND true_null) AS false_activations, COUNT(*) FILTER (activated AND NOT true_null AND pred_family <> true_family) AS wrong_activations, ROUND(AVG(delay) FILTER (activated AND NOT true_null AND pred_family = true_family), 6) AS mean_delay FROM cs""")
def hypothesis_metrics(spark, sf):
    return rounded(H.case_metrics(cases(spark, sf), ["family", "direction"]), 6)


@query(with_(CS, """fp AS (SELECT 'family' AS field, true_family AS t, pred_family AS p FROM cs UNION ALL SELECT 'direction', COALESCE(true_direction, '(none)'), COALESCE(pred_direction, '(none)') FROM cs WHERE NOT (true_direction IS NULL AND pred_direction IS NULL)),
 lb AS (SELECT DISTINCT field, t AS label FROM fp UNION SELECT DISTINCT field, p FROM fp)""") + "SELECT field, ROUND(AVG(2 * tp / (2 * tp + fpos + fneg)), 6) AS macro_f1, COUNT(*) AS labels FROM (SELECT lb.field, label, COUNT(*) FILTER (t = label AND p = label) AS tp, COUNT(*) FILTER (t <> label AND p = label) AS fpos, COUNT(*) FILTER (t = label AND p <> label) AS fneg FROM lb JOIN fp ON lb.field = fp.field GROUP BY 1, 2) GROUP BY 1")
def field_macro_f1(spark, sf):
    return rounded(E.macro_f1(H.field_f1(cases(spark, sf), ["family", "direction"]), "true_value", "pred_value", ["field"]), 6)


@query(with_(CL) + "SELECT episode, ROUND(AVG(CASE WHEN outcome <> 'accepted' THEN 1.0 ELSE 0.0 END), 6) AS exposure FROM cl GROUP BY 1")
def wrong_spec_exposure(spark, sf):
    return rounded(H.exposure(call_log(spark, sf), F.col("outcome") != "accepted", ["episode"]), 6)


@query("SELECT m AS multiplier, CAST(s AS INT) AS start, CAST(NULLIF(d, 0) AS INT) AS duration, 1.0 / 12 AS weight FROM (SELECT UNNEST([1.25, 1.5]::DOUBLE[]) AS m), (SELECT UNNEST([-1, 0]) AS s), (SELECT UNNEST([3, 8, 0]) AS d)")
def alternatives_grid(spark, sf):
    return H.level_alternatives(spark, [1.25, 1.5], [-1, 0], [3, 8, None])


@query("SELECT CAST(i AS INT) AS delay, ROUND(p * EXP(i * 0.5) * 0.9 / SUM(p * EXP(i * 0.5)) OVER (), 9) AS tilted, ROUND(p * 0.8 / 0.9, 9) AS lossy FROM (SELECT UNNEST([0.2, 0.45, 0.25]::DOUBLE[]) AS p, UNNEST([0, 1, 2]) AS i)")
def delay_tilt(spark, sf):
    law = spark.range(1).select(F.array(*map(F.lit, (0.2, 0.45, 0.25))).alias("d"))
    both = law.select(F.posexplode(F.arrays_zip(H.tilted(F.col("d"), 0.5).alias("t"), H.with_loss(F.col("d"), 0.2).alias("l"))).alias("delay", "x"))
    return both.select("delay", F.round(F.col("x").getField("t"), 9).alias("tilted"), F.round(F.col("x").getField("l"), 9).alias("lossy"))


@query("SELECT CAST(period AS INT) AS period FROM (SELECT (range - 1) * 5 + 1 AS period, ROW_NUMBER() OVER (ORDER BY SHA256('11/' || ((range - 1) * 5 + 1))) AS r FROM range(1, 11)) WHERE r <= 4")
def random_schedule(spark, sf):
    return H.hash_schedule(spark, 4, 50, 11, 5)


@query(with_(DP, "pm AS (SELECT episode % 5 AS cell, period, AVG(demand) AS mean, STDDEV_SAMP(demand) / SQRT(COUNT(*)) AS se FROM dp GROUP BY 1, 2)") + "SELECT cell, COUNT(*) AS periods, ROUND(MAX(mean), 6) AS sup_mean, ROUND(ARG_MAX(se, mean * 1000 - period * 0.0001), 6) AS se, ARG_MAX(period, mean * 1000 - period * 0.0001) AS at, CASE WHEN ARG_MAX(mean - 1.96 * se, mean * 1000 - period * 0.0001) > 750 THEN 'clear' WHEN MAX(mean) > 750 THEN 'point' END AS flag FROM pm GROUP BY 1")
def monte_carlo_cells(spark, sf):
    cells = H.cell_summary(demand_panel(spark, sf).withColumn("cell", F.col("episode") % 5), "demand", ["cell"])
    return rounded(cells.withColumn("flag", H.flag(F.col("sup_mean"), F.col("se"), 750.0)), 6)


@query("SELECT ROUND(CORR(p_size, p_retailprice), 6) AS pearson, ROUND((SELECT CORR(a, b) FROM (SELECT RANK() OVER (ORDER BY p_size) + (COUNT(*) OVER (PARTITION BY p_size) - 1) / 2 AS a, RANK() OVER (ORDER BY p_retailprice) + (COUNT(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS b FROM part)), 6) AS spearman, COUNT(*) AS n FROM part")
def rank_correlations(spark, sf):
    return rounded(H.rank_correlation(table(spark, sf, "part").select("p_size", "p_retailprice"), "p_size", "p_retailprice"), 6)


@query(with_(ER, PD) + """, cs AS (SELECT unit % 24 AS cluster, SUM(CAST(difference AS DECIMAL(18,2))) AS s FROM pd GROUP BY 1), nb AS (SELECT CAST(s AS DOUBLE) AS s, ROW_NUMBER() OVER (ORDER BY cluster) AS i FROM cs),
 fl AS (SELECT f.range AS flip, SUM(CASE WHEN CAST(('0x' || SUBSTR(MD5(f.range || '/' || i), 1, 8)) AS BIGINT) % 2 = 1 THEN s ELSE -s END) AS t, SUM(s) AS seen FROM nb, range(1, 501) f GROUP BY 1) SELECT ROUND((COUNT(*) FILTER (t >= seen - 1e-9) + 1) / (COUNT(*) + 1), 6) AS p_value, COUNT(*) AS flips FROM fl""")
def cluster_sign_flip(spark, sf):
    d = differences(spark, sf).select((F.col("unit") % 24).alias("cluster"), F.col("difference").cast("decimal(18,2)").alias("difference"))
    sums = d.groupBy("cluster").agg(F.sum("difference").cast("double").alias("difference"))
    return rounded(H.cluster_flips(sums, "difference", "cluster", 500), 6)


# all pairs of a signing of the one half and one of the other
@query(with_(ER, PD) + """, cs AS (SELECT unit % 24 AS cluster, CAST(SUM(CAST(difference AS DECIMAL(18,2))) AS DOUBLE) AS s, COUNT(*) AS n FROM pd GROUP BY 1), nb AS (SELECT s, n, CAST(ROW_NUMBER() OVER (ORDER BY s, cluster) - 1 AS INT) AS i FROM cs),
 mk AS (SELECT CAST(range AS INT) AS mask FROM range(4096)), ha AS (SELECT mask, SUM(CASE WHEN (mask >> (i // 2)) & 1 = 1 THEN s ELSE -s END) AS x FROM nb, mk WHERE i % 2 = 0 GROUP BY 1), hb AS (SELECT mask, SUM(CASE WHEN (mask >> (i // 2)) & 1 = 1 THEN s ELSE -s END) AS x FROM nb, mk WHERE i % 2 = 1 GROUP BY 1),
 ob AS (SELECT SUM(s) - 1e-9 * GREATEST(SUM(n), ABS(SUM(s))) AS goal, COUNT(*) AS clusters FROM nb) SELECT ANY_VALUE(clusters) AS clusters, COUNT(*) AS signings, ROUND(COUNT(*) FILTER (ha.x + hb.x >= goal) / COUNT(*), 9) AS p_exact FROM ha, hb, ob""")
def signflip_halves(spark, sf):
    from quayside.operators import inference as I

    d = differences(spark, sf).select((F.col("unit") % 24).alias("cluster"), F.col("difference").cast("decimal(18,2)").alias("difference"))
    return rounded(I.sign_flip_halves(d, "difference", "cluster"), 9)


@query(None)
def cluster_test(spark, sf):
    """All signings of 40 clusters beside 100,000 random ones."""
    d = differences(spark, sf).select((F.col("unit") % 40).alias("cluster"), "difference")
    return rounded(R.cluster_test(d, "difference", "cluster"), 6)


@query(None)
def unit_sign_flip(spark, sf):
    """100,000 flips of the independent units: too many for SQL to enumerate."""
    return rounded(R.flips(differences(spark, sf), "difference", "unit"), 6)


@query(None)
def unit_bootstrap_ci(spark, sf):
    """10,000 draws of the independent units: too many for SQL to enumerate."""
    return rounded(R.bootstrap(differences(spark, sf), "difference", "unit"), 3)


@query("SELECT range AS row, CASE range % 3 WHEN 0 THEN 'iid' WHEN 1 THEN 'seasonal' ELSE 'ar1' END AS kind, CAST(14 + (range // 3) % 9 AS INT) AS onset, 9000000 + range AS seed FROM range(1300)")
def nullbank_rows(spark, sf):
    return H.null_registrations(spark, 1300, ["iid", "seasonal", "ar1"], (14, 22), 9_000_000)


@query("SELECT event_id, CAST(props->>'$.k' AS DOUBLE) AS k, CAST(event_id % 9 AS DOUBLE) / 2 AS lead FROM events")
def parameter_regex(spark, sf):
    text = F.concat(F.lit("```json\n{\"K\" = \""), F.get_json_object("props", "$.k"), F.lit("\", "), F.lit("lead: "), (F.col("event_id") % 9 / 2).cast("string"), F.lit(",}\n```"))
    return table(spark, sf, "events").select("event_id", H.parameter(text, "k").alias("k"), H.parameter(text, "lead").alias("lead"))


@query(f"SELECT ROUND({0.7 * 0.9 / (0.1 * 0.3)}, 9) AS bound, ROUND({math.log(20)}, 9) AS threshold")
def ville_bounds(spark, sf):
    return spark.range(1).select(F.round(F.lit(H.log_ratio_bound(0.7, 0.1)), 9).alias("bound"), F.round(-F.ln(F.lit(0.05)), 9).alias("threshold"))


@query("SELECT n, LPAD(LOWER(PRINTF('%x', CAST(h % 1152921504606846976 AS BIGINT))), 15, '0') AS digest FROM (SELECT COUNT(*) AS n, SUM(CAST(('0x' || SUBSTR(SHA256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}'), 1, 15)) AS HUGEINT)) AS h FROM nation)")
def record_digest(spark, sf):
    from quayside.sources.reports import digest

    return digest(table(spark, sf, "nation").select("n_name", "n_nationkey"))


@query("SELECT family, index, seed, held_out FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY family, held_out ORDER BY seed) AS p FROM (SELECT CAST(range // 30 AS INT) AS family, CAST(range % 30 AS INT) AS index, (range // 30 + 1) * 1000000 + range % 30 AS seed, range % 30 % 4 = 0 AS held_out FROM range(180))) WHERE p <= CASE WHEN held_out THEN 4 ELSE 16 END")
def pilot_units(spark, sf):
    from quayside.operators import generate as N

    return N.pilot_selection(N.units(spark, 6, 30, 4), ["family"], 16, 4, "held_out")


RS = "rs AS (SELECT doc_id AS sample_id, doc_id % 3 AS criterion, quality AS a, (toxic + doc_id % 2) % 2 AS b FROM labels)"


def rated(spark, sf):
    """The labels as ratings of two raters."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), (F.col("doc_id") % 3).alias("criterion"), F.col("quality").alias("a"), ((F.col("toxic") + F.col("doc_id") % 2) % 2).alias("b"))
    return labels.select("sample_id", "criterion", F.explode(F.array(F.struct(F.lit("r1").alias("rater"), F.col("a").cast("long").alias("score")), F.struct(F.lit("r2").alias("rater"), F.col("b").cast("long").alias("score")))).alias("x")).select("sample_id", "criterion", "x.rater", "x.score")


@query(with_(RS) + """SELECT criterion, n AS items, ROUND(po, 6) AS observed, ROUND(pe, 6) AS expected, ROUND(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM (SELECT t.criterion, COUNT(*) AS n, COUNT(*) FILTER (a = b) / COUNT(*) AS po,
 (SELECT SUM(x.c * y.c) FROM (SELECT criterion, a AS v, COUNT(*) AS c FROM rs GROUP BY 1, 2) x JOIN (SELECT criterion, b AS v, COUNT(*) AS c FROM rs GROUP BY 1, 2) y ON x.v = y.v AND x.criterion = y.criterion WHERE x.criterion = t.criterion) / (COUNT(*) * COUNT(*)) AS pe FROM rs t GROUP BY 1)""")
def kappa_by_criterion(spark, sf):
    from quayside.operators import audit

    return rounded(audit.kappa_by(audit.side_by_side(rated(spark, sf), ["r1", "r2"]), ["criterion"]), 6)


@query(with_(RS) + "SELECT criterion, sample_id, disagreement, CAST(place AS INT) AS place FROM (SELECT criterion, sample_id, ABS(a - b) AS disagreement, ROW_NUMBER() OVER (PARTITION BY criterion ORDER BY ABS(a - b) DESC, sample_id) AS place FROM rs WHERE a <> b) WHERE place <= 5")
def rating_removals(spark, sf):
    from quayside.operators import audit

    return audit.removals(audit.side_by_side(rated(spark, sf), ["r1", "r2"]), ["criterion"], 5)
