"""Readouts in long form, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.operators import readouts as R
from quayside.plans.q_evaluation import PD, C, T, Z, rounded
from quayside.plans.runtime import table
from quayside.plans.views import ER, episode_results, with_

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


CONTRASTS = (("urgent_high", "1-URGENT", "2-HIGH"), ("urgent_low", "1-URGENT", "5-LOW"), ("high_low", "2-HIGH", "5-LOW"))


def sql_axes(source: str, axes: dict[str, str]) -> str:
    return " UNION ALL ".join([f"SELECT *, 'all' AS axis, 'all' AS level FROM {source}"] + [f"SELECT *, '{a}' AS axis, CAST({e} AS VARCHAR) AS level FROM {source}" for a, e in axes.items()])


PAIRED = " UNION ALL ".join(f"SELECT t.family, t.condition, '{n}' AS contrast, t.profit - c.profit AS d, c.profit AS b FROM er t JOIN er c ON c.unit = t.unit AND c.family = t.family AND c.condition = t.condition WHERE t.arm = '{a}' AND c.arm = '{z}'" for n, a, z in CONTRASTS)


@query(with_(ER) + f", pr AS ({PAIRED}), px AS ({sql_axes('pr', {'family': 'family', 'condition': 'condition'})}) SELECT contrast, axis, level, COUNT(*) AS n, ROUND(AVG(d), 4) AS mean, ROUND(STDDEV_SAMP(d), 3) AS sd, ROUND(AVG(b), 4) AS base, ROUND(AVG(d) / AVG(b), 6) AS share FROM px GROUP BY 1, 2, 3")
def contrast_readout(spark, sf):
    """Contrasts overall, by family and by condition."""
    out = R.contrast_readout(episode_results(spark, sf), CONTRASTS, "profit", ["family", "condition"])
    return out.withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 3), "base": F.round("base", 4), "share": F.round("share", 6)})


@query(with_(ER) + f", rr AS (SELECT er.*, r FROM er, (SELECT UNNEST([1.0, 4.0, 19.0]::DOUBLE[]) AS r)), pr AS (SELECT t.family, t.r, (t.r * t.sold - t.lost) - (c.r * c.sold - c.lost) AS d, c.r * c.sold - c.lost AS b FROM rr t JOIN rr c ON c.unit = t.unit AND c.r = t.r AND c.family = t.family WHERE t.arm = '{T}' AND c.arm = '{C}'), px AS ({sql_axes('pr', {'family': 'family'})}) SELECT r AS ratio, ROUND(r / (r + 1), 6) AS fractile, axis, level, COUNT(*) AS n, ROUND(AVG(d), 6) AS mean, ROUND(AVG(b), 6) AS base, ROUND(CASE WHEN AVG(b) <> 0 THEN AVG(d) / AVG(b) END, 6) AS share FROM px GROUP BY ALL")
def ratio_readout(spark, sf):
    """The contrast at several ratios of profit to holding cost, with the critical fractile of each."""
    priced = episode_results(spark, sf).withColumn("ratio", F.explode(F.array(F.lit(1.0), F.lit(4.0), F.lit(19.0)))).withColumn("net", F.col("ratio") * F.col("sold") - F.col("lost"))
    out = R.contrast_readout(priced, [("main", T, C)], "net", ["family"], ["ratio"]).withColumn("fractile", F.col("ratio") / (F.col("ratio") + 1))
    return rounded(out.select("ratio", "fractile", "axis", "level", "n", "mean", "base", "share"), 6)


@query(with_(ER, PD) + "SELECT ROUND(SUM(difference), 2) AS total, ROUND(SUM(difference) FILTER (condition < 2), 2) AS part, ROUND(SUM(difference) FILTER (condition < 2) / SUM(difference), 6) AS share FROM pd")
def gain_of_part(spark, sf):
    """The share of the gain that falls to some conditions."""
    out = R.gain_share(episode_results(spark, sf), T, C, "profit", F.col("condition") < 2)
    return out.select(F.round("total", 2).alias("total"), F.round("part", 2).alias("part"), F.round("share", 6).alias("share"))


HC = """hc AS (SELECT p_partkey AS item, ['no_change', 'demand_level', 'shipment_loss', 'compound'][p_partkey % 4 + 1] AS true_family, ['no_change', 'demand_level', 'shipment_loss', 'compound'][(p_partkey + p_size % 3) % 4 + 1] AS pred_family, CASE WHEN p_size % 5 > 0 THEN p_brand END AS true_direction, CASE WHEN p_size % 5 > 1 THEN p_brand END AS pred_direction,
 p_size % 3 > 0 AS activated, p_partkey % 4 = 0 AS true_null, 10 AS proposal_period, CASE WHEN p_size % 3 > 0 THEN 10 + p_size % 7 END AS activation_period, CASE WHEN p_size % 9 = 1 THEN 20 + p_size % 5 END AS rollback_period, CASE WHEN p_size % 4 = 2 THEN 30 END AS expiration_period, CASE WHEN p_size % 8 = 2 THEN 'expired' ELSE 'active' END AS state,
 CASE WHEN p_size % 6 > 1 THEN p_size % 6 > 3 END AS magnitude_covered, CASE WHEN p_size % 10 > 2 THEN p_size % 10 > 5 END AS benefited, ['accurate', 'delayed', 'none'][p_size % 3 + 1] AS condition, CASE WHEN p_size % 7 > 0 THEN p_size % 11 - 4 END AS rel_tau FROM part)"""


def cases(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    families = ("no_change", "demand_level", "shipment_loss", "compound")
    return table(spark, sf, "part").select(
        k.alias("item"), pick(families, k % 4).alias("true_family"), pick(families, (k + s % 3) % 4).alias("pred_family"), F.when(s % 5 > 0, F.col("p_brand")).alias("true_direction"), F.when(s % 5 > 1, F.col("p_brand")).alias("pred_direction"),
        (s % 3 > 0).alias("activated"), (k % 4 == 0).alias("true_null"), F.lit(10).alias("proposal_period"), F.when(s % 3 > 0, 10 + s % 7).alias("activation_period"), F.when(s % 9 == 1, 20 + s % 5).alias("rollback_period"), F.when(s % 4 == 2, 30).alias("expiration_period"),
        F.when(s % 8 == 2, "expired").otherwise("active").alias("state"), F.when(s % 6 > 1, s % 6 > 3).alias("magnitude_covered"), F.when(s % 10 > 2, s % 10 > 5).alias("benefited"), pick(("accurate", "delayed", "none"), s % 3).alias("condition"), F.when(s % 7 > 0, s % 11 - 4).alias("rel_tau"),
    )


SAME = "true_family = pred_family AND true_direction IS NOT DISTINCT FROM pred_direction"
SHARE = lambda hit, of: f"COUNT(*) FILTER (({hit}) AND ({of})) / NULLIF(COUNT(*) FILTER ({of}), 0)"
THIRTEEN = {
    "exact_match": SHARE(SAME, "true"), "abstention_precision": SHARE("true_null", "pred_family = 'no_change'"), "abstention_recall": SHARE("pred_family = 'no_change'", "true_null"), "magnitude_coverage": SHARE("magnitude_covered", "magnitude_covered IS NOT NULL"),
    "activation_delay": "AVG(activation_period - proposal_period)", "rollback_delay": "AVG(rollback_period - activation_period)", "expiration_accuracy": SHARE("state = 'expired'", "expiration_period IS NOT NULL"), "false_activation": "COUNT(*) FILTER (activated AND true_null)",
    "wrong_family_activation": "COUNT(*) FILTER (activated AND NOT true_null AND pred_family <> true_family)", "wrong_spec_exposure": f"COUNT(*) FILTER (activated AND NOT ({SAME}))", "benefit_given_activation": SHARE("benefited", "activated AND benefited IS NOT NULL"),
}
F1 = """fp AS (SELECT 'family' AS field, true_family AS t, pred_family AS p FROM hc UNION ALL SELECT 'direction', COALESCE(true_direction, '(none)'), COALESCE(pred_direction, '(none)') FROM hc WHERE NOT (true_direction IS NULL AND pred_direction IS NULL)),
 lb AS (SELECT DISTINCT field, t AS label FROM fp UNION SELECT DISTINCT field, p FROM fp), ff AS (SELECT field, AVG(2 * tp / (2 * tp + fpos + fneg)) AS f FROM (SELECT lb.field, label, COUNT(*) FILTER (t = label AND p = label) AS tp, COUNT(*) FILTER (t <> label AND p = label) AS fpos, COUNT(*) FILTER (t = label AND p <> label) AS fneg FROM lb JOIN fp ON lb.field = fp.field GROUP BY 1, 2) GROUP BY 1)"""


@query(with_(HC, F1) + " UNION ALL ".join(f"SELECT '{m}' AS metric, ROUND(CAST({e} AS DOUBLE), 6) AS value FROM hc" for m, e in THIRTEEN.items()) + " UNION ALL SELECT 'f1_' || field, ROUND(f, 6) FROM ff UNION ALL SELECT 'macro_f1', ROUND(MAX(f) FILTER (field = 'family'), 6) FROM ff UNION ALL SELECT 'field_macro_f1', ROUND(AVG(f), 6) FROM ff")
def hypothesis_scores(spark, sf):
    """All thirteen metrics of hypothesis cases."""
    return rounded(R.case_scores(cases(spark, sf), ["family", "direction"]), 6)


@query(with_(HC) + f", hx AS ({sql_axes('hc', {'condition': 'condition', 'true_family': 'true_family'})}) SELECT axis, level, COUNT(*) AS n, COUNT(*) FILTER (state = 'expired') AS expired, CAST(COUNT(*) FILTER (true_family = pred_family) AS BIGINT) AS family_ok, ROUND(COUNT(*) FILTER (true_family = pred_family) / COUNT(*), 6) AS family_ok_rate, CAST(COUNT(*) FILTER (magnitude_covered) AS BIGINT) AS magnitude_covered, ROUND(COUNT(*) FILTER (magnitude_covered) / COUNT(*), 6) AS magnitude_covered_rate FROM hx GROUP BY 1, 2")
def accuracy_blocks(spark, sf):
    out = R.accuracy_blocks(cases(spark, sf).withColumn("family_ok", F.col("true_family") == F.col("pred_family")), ["family_ok", "magnitude_covered"], ["condition", "true_family"], "state")
    return rounded(out.withColumn("expired", F.coalesce(F.try_element_at("outcomes", F.lit("expired")), F.lit(0).cast("long"))).drop("outcomes"), 6)


@query(with_(HC) + "SELECT true_family AS truth, pred_family AS said, COUNT(*) AS count FROM hc GROUP BY 1, 2")
def confusion_pairs(spark, sf):
    return R.confusion(cases(spark, sf), "true_family", "pred_family")


@query(with_(HC) + "SELECT condition, COUNT(rel_tau) AS called, COUNT(*) FILTER (rel_tau < 0) AS before_onset, COUNT(*) FILTER (activated AND rel_tau IS NOT NULL) AS on_alert, ROUND(MEDIAN(rel_tau), 6) AS median FROM hc GROUP BY 1")
def proposal_timing(spark, sf):
    return rounded(R.timing(cases(spark, sf), "rel_tau", "condition", F.col("activated")), 6)


def four(e: str) -> str:
    d = f"(SELECT unit % 48 AS cluster, MAX({e}) FILTER (arm = '{T}') - MAX({e}) FILTER (arm = '{C}') AS d FROM er WHERE arm IN ('{T}', '{C}') GROUP BY unit HAVING COUNT(DISTINCT arm) = 2)"
    mean = f"SELECT '{e}' AS endpoint, '{{kind}}' AS kind, AVG(d) AS estimate, AVG(d) - {Z} * STDDEV_SAMP(d) / SQRT(COUNT(*)) AS low, AVG(d) + {Z} * STDDEV_SAMP(d) / SQRT(COUNT(*)) AS high, COUNT(*) AS n FROM {{rows}}"
    redrawn = f"""SELECT '{e}', 'redrawn', (SELECT AVG(d) FROM {d}), QUANTILE_CONT(m, 0.025), QUANTILE_CONT(m, 0.975), (SELECT COUNT(*) FROM {d}) FROM (SELECT draw, SUM(s) / SUM(k) AS m FROM (SELECT x.range AS draw, CAST(('0x' || SUBSTR(MD5(x.range || '/' || i), 1, 8)) AS BIGINT) % n AS i FROM (SELECT ROW_NUMBER() OVER (ORDER BY cluster) - 1 AS i, COUNT(*) OVER () AS n FROM {d} GROUP BY cluster), range(200) x)
 JOIN (SELECT SUM(d) AS s, COUNT(*) AS k, ROW_NUMBER() OVER (ORDER BY cluster) - 1 AS i FROM {d} GROUP BY cluster) USING (i) GROUP BY draw)"""
    p, zz = "(k / n)", Z * Z
    wilson = f"SELECT '{e}', 'above_zero', {p}, ({p} + {zz} / (2 * n) - {Z} * SQRT({p} * (1 - {p}) / n + {zz} / (4 * n * n))) / (1 + {zz} / n), ({p} + {zz} / (2 * n) + {Z} * SQRT({p} * (1 - {p}) / n + {zz} / (4 * n * n))) / (1 + {zz} / n), n FROM (SELECT COUNT(*) FILTER (d > 0) AS k, COUNT(*) AS n FROM {d})"
    return " UNION ALL ".join([mean.format(kind="units", rows=d), mean.format(kind="clusters", rows=f"(SELECT AVG(d) AS d FROM {d} GROUP BY cluster)"), redrawn, wilson])


@query(with_(ER) + f"SELECT endpoint, kind, ROUND(estimate, 4) AS estimate, ROUND(low, 4) AS low, ROUND(high, 4) AS high, n FROM ({four('sold')} UNION ALL {four('lost')})")
def interval_kinds(spark, sf):
    """Four intervals of each endpoint's contrast in one frame."""
    results = episode_results(spark, sf).withColumn("cluster", F.col("unit") % 48)
    return rounded(R.interval_kinds(results, T, C, ["sold", "lost"], "cluster"), 4)


IC = "ic AS (SELECT o_custkey, o_orderpriority AS kind, o_orderstatus AS label, COUNT(*) AS rows FROM orders GROUP BY 1, 2, 3)"


@query(with_(IC) + f", iy AS (SELECT *, kind || '/' || label AS kind_and_label FROM ic), ix AS ({sql_axes('iy', {'kind': 'kind', 'label': 'label', 'kind_and_label': 'kind_and_label'})}) SELECT axis, level, COUNT(*) AS instances, CAST(SUM(rows) AS BIGINT) AS decisions, ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT rows)), ',') AS horizons FROM ix GROUP BY 1, 2")
def catalogue_counts(spark, sf):
    """A catalogue's counts, total decisions and horizons: an instance is a customer's orders of one priority and status."""
    instances = table(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("kind_of"), F.col("o_orderstatus").alias("label_of")).agg(F.count("*").alias("n"))
    return R.catalogue_counts(instances, "kind_of", "label_of", "n").withColumn("horizons", F.array_join(F.col("horizons").cast("array<string>"), ","))


PV = """pv AS (SELECT user_id AS episode, event_id AS period, event_type AS family FROM events WHERE event_id % 3 = 0), pc AS (SELECT user_id AS episode, event_id AS period, event_id + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS generated, 'm' || (event_id % 2) AS model, 'det-v1' AS decoding, CASE WHEN event_id % 11 = 0 THEN 'short' ELSE SHA256(CAST(event_id AS VARCHAR)) END AS prompt_hash FROM events WHERE event_id % 7 > 0)"""


@query(with_(PV) + "SELECT pv.episode, pv.period, family, generated, model, decoding, prompt_hash, pv.period AS tau, CAST(ROW_NUMBER() OVER (PARTITION BY pv.episode ORDER BY pv.period) AS INT) AS proposal, CASE WHEN model IS NULL THEN 'no call' WHEN pv.period < generated THEN 'backdated' WHEN LENGTH(prompt_hash) <> 64 THEN 'bad digest' END AS fault FROM pv LEFT JOIN pc ON pc.episode = pv.episode AND pc.period = pv.period")
def spec_provenance(spark, sf):
    """Specs with the provenance that the system attaches, and why some may not be registered."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    specs = e.where(k % 3 == 0).select(F.col("user_id").alias("episode"), k.alias("period"), F.col("event_type").alias("family"))
    prompt = F.when(k % 11 == 0, "short").otherwise(F.sha2(k.cast("string"), 256))
    calls = e.where(k % 7 > 0).select(F.col("user_id").alias("episode"), k.alias("period"), (k + F.when(k % 5 == 0, 1).otherwise(0)).alias("generated"), F.concat(F.lit("m"), (k % 2).cast("string")).alias("model"), F.lit("det-v1").alias("decoding"), prompt.alias("prompt_hash"))
    return R.with_provenance(specs, calls, ["episode"])
