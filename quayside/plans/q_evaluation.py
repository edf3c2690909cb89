"""Queries over episode results, calls and ratings, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.operators import evaluation as E
from quayside.operators import inference as I
from quayside.plans.views import CL, ER, RT, call_log, episode_results, ratings, with_

QUERIES, SQL = {}, {}
T, C = "1-URGENT", "5-LOW"
ARMS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
WEIGHTS = [("AUTOMOBILE", 0.3), ("BUILDING", 0.25), ("FURNITURE", 0.2), ("HOUSEHOLD", 0.15), ("MACHINERY", 0.1), ("ABSENT", 0.5)]
W_SQL = "w(family, weight) AS (VALUES " + ", ".join(f"('{f}', {w}::DOUBLE)" for f, w in WEIGHTS) + ")"
PD = f"pd AS (SELECT unit, family, condition, t - c AS difference FROM (SELECT unit, family, condition, MAX(profit) FILTER (arm = '{T}') AS t, MAX(profit) FILTER (arm = '{C}') AS c FROM er GROUP BY 1, 2, 3) WHERE t IS NOT NULL AND c IS NOT NULL)"
Z = 1.959963984540054


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def weights(spark):
    return spark.createDataFrame(WEIGHTS, "family string, weight double")


def rounded(df, places=4):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def differences(spark, sf):
    return E.paired_differences(episode_results(spark, sf), T, C, "profit", ["family", "condition"])


@query(with_(ER, PD) + "SELECT unit, ROUND(difference, 2) AS difference FROM pd")
def paired_contrast(spark, sf):
    return rounded(differences(spark, sf).select("unit", "difference"), 2)


@query(with_(ER) + f"SELECT COUNT(*) AS units, COUNT(*) FILTER (v_t IS NULL) AS missing_t, COUNT(*) FILTER (v_c IS NULL) AS missing_c, ROUND(MAX(ABS(v_t - v_c)), 2) AS max_abs_difference FROM (SELECT unit, profit AS v_t FROM er WHERE arm = '{T}') FULL JOIN (SELECT unit, profit AS v_c FROM er WHERE arm = '{C}') USING (unit)")
def paired_full_outer(spark, sf):
    return rounded(E.paired_full(episode_results(spark, sf), T, C, "profit"), 2)


@query(with_(ER, W_SQL) + "SELECT arm, ROUND(SUM(weight * m) / SUM(weight), 4) AS weighted_mean, COUNT(*) AS strata FROM (SELECT arm, family, AVG(profit) AS m FROM er GROUP BY 1, 2) JOIN w USING (family) GROUP BY arm")
def stratum_weighted_endpoint(spark, sf):
    return rounded(E.weighted_mean(episode_results(spark, sf), "profit", ["family"], weights(spark), ["arm"]))


@query(with_(ER, PD, W_SQL) + f"""SELECT ROUND(e, 3) AS estimate, ROUND(e - {Z} * s, 3) AS low, ROUND(e + {Z} * s, 3) AS high, CAST(n AS BIGINT) AS n FROM (
 SELECT SUM(weight * m) / SUM(weight) AS e, SQRT(SUM(weight * weight * v / n) / (SUM(weight) * SUM(weight))) AS s, SUM(n) AS n FROM (SELECT family, AVG(difference) AS m, COALESCE(VAR_SAMP(difference), 0) AS v, COUNT(*) AS n FROM pd GROUP BY 1) JOIN w USING (family))""")
def stratum_weighted_interval(spark, sf):
    return rounded(I.stratified_interval(differences(spark, sf), "difference", ["family"], weights(spark)), 3)


@query(with_(ER) + "SELECT arm, endpoint, ROUND(AVG(value), 4) AS mean, COUNT(DISTINCT unit) AS units FROM (SELECT unit, arm, 'profit' AS endpoint, profit AS value FROM er UNION ALL SELECT unit, arm, 'lost', lost::DOUBLE FROM er) GROUP BY 1, 2")
def arm_endpoints(spark, sf):
    return rounded(E.arm_endpoints(episode_results(spark, sf), ["profit", "lost"]))


@query(with_(ER) + "SELECT arm, ROUND(AVG(GREATEST(0, sold / demand)), 6) AS mean_fill, COUNT(*) AS n FROM er GROUP BY arm")
def compat_micro_mean(spark, sf):
    er = episode_results(spark, sf).withColumn("fill", F.greatest(F.lit(0.0), F.col("sold") / F.col("demand")))
    return rounded(er.groupBy("arm").agg(F.avg("fill").alias("mean_fill"), F.count("*").alias("n")), 6)


@query(with_(ER, W_SQL) + "SELECT ROUND(SUM(weight * m) / SUM(weight), 6) AS weighted_mean, COUNT(*) AS strata FROM (SELECT family, AVG(lost::DOUBLE) AS m FROM er GROUP BY 1) JOIN w USING (family)")
def weighted_by_field(spark, sf):
    return rounded(E.weighted_mean(episode_results(spark, sf), "lost", ["family"], weights(spark)), 6)


@query(with_(CL) + """SELECT arm, COUNT(*) AS calls, COUNT(*) FILTER (outcome = 'repair') AS repairs, COUNT(*) FILTER (outcome = 'refusal') AS refusals, CAST(SUM(tokens) AS BIGINT) AS tokens, ROUND(QUANTILE_CONT(latency, 0.5), 6) AS p50, ROUND(QUANTILE_CONT(latency, 0.95), 6) AS p95, ROUND(MAX(latency), 6) AS longest,
 ROUND(CASE WHEN COUNT(*) FILTER (outcome = 'accepted') > 0 THEN SUM(tokens) / COUNT(*) FILTER (outcome = 'accepted') END, 6) AS tokens_per_accepted FROM cl GROUP BY arm""")
def efficiency_by_arm(spark, sf):
    return rounded(E.efficiency(call_log(spark, sf)), 6)


@query(with_(CL) + "SELECT arm, COUNT(*) AS charged, CAST(SUM(tokens) AS BIGINT) AS tokens, QUANTILE_DISC(latency, 0.5) AS p50, QUANTILE_DISC(latency, 0.95) AS p95 FROM cl WHERE charged GROUP BY arm")
def ledger_by_arm_nearest_rank(spark, sf):
    return E.ledger_summary(call_log(spark, sf))


@query(with_(ER) + "SELECT arm, ROUND(AVG(profit), 4) AS cvar, COUNT(*) AS rows FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY arm ORDER BY profit, unit) AS r, COUNT(*) OVER (PARTITION BY arm) AS n FROM er) WHERE r <= CEIL(n * 0.1) GROUP BY arm")
def cvar10_by_arm(spark, sf):
    return rounded(E.cvar(episode_results(spark, sf), "profit", ["arm"]))


@query(with_(ER) + "SELECT unit, arm, profit FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY arm ORDER BY profit, unit) AS r, COUNT(*) OVER (PARTITION BY arm) AS n FROM er) WHERE r <= CEIL(n * 0.1)")
def worst_decile_rows(spark, sf):
    return E.worst_share(episode_results(spark, sf), "profit", ["arm"]).select("unit", "arm", "profit")


@query(with_(RT) + """SELECT ROUND(AVG(2 * tp / (2 * tp + fp + fn)), 6) AS macro_f1, COUNT(*) AS labels FROM (SELECT label, COUNT(*) FILTER (a = label AND b = label) AS tp, COUNT(*) FILTER (a <> label AND b = label) AS fp, COUNT(*) FILTER (a = label AND b <> label) AS fn
 FROM rt, (SELECT DISTINCT a AS label FROM rt UNION SELECT DISTINCT b FROM rt) GROUP BY label)""")
def macro_f1_label(spark, sf):
    return rounded(E.macro_f1(ratings(spark, sf), "a", "b"), 6)


@query(with_(RT) + """SELECT n AS items, ROUND(po, 6) AS observed, ROUND(pe, 6) AS expected, ROUND(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (a = b) / COUNT(*) AS po,
 (SELECT SUM(x.c * y.c) FROM (SELECT a AS v, COUNT(*) AS c FROM rt GROUP BY 1) x JOIN (SELECT b AS v, COUNT(*) AS c FROM rt GROUP BY 1) y USING (v)) / (COUNT(*) * COUNT(*)) AS pe FROM rt)""")
def kappa_labels(spark, sf):
    return rounded(E.kappa(ratings(spark, sf), "a", "b"), 6)


@query(with_(RT) + "SELECT a, b, COUNT(*) AS n FROM rt GROUP BY 1, 2")
def confusion_pairs(spark, sf):
    return E.confusion(ratings(spark, sf), "a", "b")


def points(spark, sf):
    """Arms as frontier points: mean latency sum as budget, tokens as reward."""
    per = call_log(spark, sf).groupBy("arm", "episode").agg(F.sum(F.col("latency").cast("decimal(18,2)")).cast("double").alias("budget"), F.sum("tokens").alias("reward"))
    return per.groupBy("arm").agg(F.round(F.avg("budget"), 6).alias("budget"), F.round(F.avg("reward"), 6).alias("reward"))


PT = "pt AS (SELECT arm, ROUND(AVG(budget), 6) AS budget, ROUND(AVG(reward), 6) AS reward FROM (SELECT arm, episode, CAST(SUM(CAST(latency AS DECIMAL(18,2))) AS DOUBLE) AS budget, SUM(tokens) AS reward FROM cl GROUP BY 1, 2) GROUP BY arm)"


@query(with_(CL, PT) + "SELECT arm, budget, reward FROM (SELECT *, MAX(reward) OVER (ORDER BY budget, reward DESC, arm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM pt) WHERE best IS NULL OR reward > best")
def pareto_frontier(spark, sf):
    return I.pareto(points(spark, sf), "budget", "reward", "arm")


@query(with_(CL, PT) + "SELECT ROUND(SUM((x - px) * (reward + pr) / 2), 4) AS area FROM (SELECT reward, budget / m AS x, COALESCE(LAG(budget / m) OVER (ORDER BY budget, arm), 0) AS px, COALESCE(LAG(reward) OVER (ORDER BY budget, arm), reward) AS pr FROM (SELECT *, MAX(budget) OVER () AS m FROM pt))")
def frontier_auc(spark, sf):
    return rounded(I.frontier_area(points(spark, sf), "budget", "reward", "arm"))


@query(with_(CL, PT) + "SELECT p.arm, p.budget, p.reward, ROUND(ABS(p.budget - r.budget), 6) AS gap FROM pt p, pt r WHERE r.arm = 'purchase' AND p.arm <> 'purchase' ORDER BY ABS(p.budget - r.budget), p.arm LIMIT 1")
def matched_budget(spark, sf):
    return rounded(I.matched_budget(points(spark, sf), "budget", "arm", "purchase"), 6)


def tests(spark, sf):
    """A p-value per family, from the normal approximation of the paired mean."""
    z = F.abs(F.avg("difference") / (F.stddev_samp("difference") / F.sqrt(F.count("*"))))
    return differences(spark, sf).groupBy("family").agg(z.alias("z")).select("family", F.round(I.two_sided(F.col("z")), 8).alias("p"))


TAIL = "EXP(-z * z / 2) * 0.3989422804014327 * (1 / (1 + 0.2316419 * z)) * (0.319381530 + (1 / (1 + 0.2316419 * z)) * (-0.356563782 + (1 / (1 + 0.2316419 * z)) * (1.781477937 + (1 / (1 + 0.2316419 * z)) * (-1.821255978 + (1 / (1 + 0.2316419 * z)) * 1.330274429))))"
PV = f"pv AS (SELECT family, ROUND(LEAST(1.0, 2 * {TAIL}), 8) AS p FROM (SELECT family, ABS(AVG(difference) / (STDDEV_SAMP(difference) / SQRT(COUNT(*)))) AS z FROM pd GROUP BY 1))"


@query(with_(ER, PD, PV) + """SELECT family, ROUND(p, 6) AS p, ROUND(LEAST(1.0, MAX((m - r + 1) * p) OVER (ORDER BY p, family)), 6) AS adjusted, MIN(CASE WHEN p <= 0.05 / (m - r + 1) THEN 1 ELSE 0 END) OVER (ORDER BY p, family) = 1 AS rejected
 FROM (SELECT *, COUNT(*) OVER () AS m, ROW_NUMBER() OVER (ORDER BY p, family) AS r FROM pv)""")
def holm_adjust(spark, sf):
    return rounded(I.holm(tests(spark, sf), "p", "family"), 6)


@query(with_(ER, PD) + f"""SELECT n, ROUND(w, 2) AS w, ROUND(LEAST(1.0, 2 * {TAIL}), 6) AS p_value FROM (SELECT n, w, ABS((w - n * (n + 1) / 4) / SQRT(n::DOUBLE * (n + 1) * (2 * n + 1) / 24)) AS z FROM (
 SELECT COUNT(*) AS n, SUM(CASE WHEN difference > 0 THEN rk END) AS w FROM (SELECT difference, RANK() OVER (ORDER BY ABS(difference)) + (COUNT(*) OVER (PARTITION BY ABS(difference)) - 1) / 2 AS rk FROM pd WHERE difference <> 0)))""")
def wilcoxon_signed_rank(spark, sf):
    return I.signed_rank(differences(spark, sf), "difference").select("n", F.round("w", 2).alias("w"), F.round("p_value", 6).alias("p_value"))


SMALL = "sm AS (SELECT CAST(SUM(CAST(difference AS DECIMAL(18,2))) AS DOUBLE) AS d FROM pd GROUP BY family, condition % 2)"


@query(with_(ER, PD, SMALL) + """SELECT COUNT(*) AS flips, ROUND(COUNT(*) FILTER (ABS(s) >= ABS(t) - 1e-9) / COUNT(*), 6) AS p_value FROM (SELECT mask, SUM(CASE WHEN (mask >> i) & 1 = 1 THEN d ELSE -d END) AS s, SUM(d) AS t
 FROM (SELECT d, CAST(ROW_NUMBER() OVER (ORDER BY d) - 1 AS INT) AS i FROM sm), (SELECT CAST(range AS INT) AS mask FROM range(1024)) GROUP BY mask)""")
def signflip_exact(spark, sf):
    small = differences(spark, sf).groupBy("family", (F.col("condition") % 2).alias("half")).agg(F.sum(F.col("difference").cast("decimal(18,2)")).cast("double").alias("d"))
    return rounded(I.sign_flip_exact(small, "d"), 6)


@query(with_(ER, PD) + f"SELECT CAST(0 AS BIGINT) AS flips, ROUND(LEAST(1.0, 2 * {TAIL}), 6) AS p_value FROM (SELECT ABS(AVG(difference) / (STDDEV_SAMP(difference) / SQRT(COUNT(*)))) AS z FROM pd)")
def signflip_units(spark, sf):
    """Over the independent units; every table has more than 20."""
    return rounded(I.sign_flip_exact(differences(spark, sf), "difference"), 6)


@query(with_(ER) + f"SELECT arm, k, n, ROUND((k / n + {Z * Z} / (2 * n) - {Z} * SQRT((k / n) * (1 - k / n) / n + {Z * Z} / (4 * n * n))) / (1 + {Z * Z} / n), 6) AS low, ROUND((k / n + {Z * Z} / (2 * n) + {Z} * SQRT((k / n) * (1 - k / n) / n + {Z * Z} / (4 * n * n))) / (1 + {Z * Z} / n), 6) AS high FROM (SELECT arm, COUNT(*) FILTER (lost > 0) AS k, COUNT(*) AS n FROM er GROUP BY arm)")
def wilson_by_group(spark, sf):
    k = episode_results(spark, sf).groupBy("arm").agg(F.count_if(F.col("lost") > 0).alias("k"), F.count("*").alias("n"))
    low, high = I.wilson(F.col("k"), F.col("n"))
    return rounded(k.select("arm", "k", "n", low.alias("low"), high.alias("high")), 6)


@query(with_(ER, PD) + """, cs AS (SELECT unit % 48 AS cluster, CAST(SUM(CAST(difference AS DECIMAL(18,2))) AS DOUBLE) AS s, COUNT(*) AS k FROM pd GROUP BY 1), nb AS (SELECT *, ROW_NUMBER() OVER (ORDER BY cluster) - 1 AS i, COUNT(*) OVER () AS n FROM cs),
 dr AS (SELECT d.range AS draw, CAST(('0x' || SUBSTR(MD5(d.range || '/' || nb.i), 1, 8)) AS BIGINT) % n AS i FROM nb, range(200) d), ms AS (SELECT draw, SUM(s) / SUM(k) AS m FROM dr JOIN nb USING (i) GROUP BY draw)
 SELECT ROUND(QUANTILE_CONT(m, 0.025), 3) AS low, ROUND(QUANTILE_CONT(m, 0.975), 3) AS high, COUNT(*) AS draws FROM ms""")
def bootstrap_hash_ci(spark, sf):
    return rounded(I.cluster_bootstrap(differences(spark, sf).withColumn("cluster", F.col("unit") % 48), "difference", "cluster"), 3)


@query(with_(ER, PD) + f"SELECT family, ROUND(m, 3) AS estimate, ROUND(m - h, 3) AS low, ROUND(m + h, 3) AS high, n FROM (SELECT family, AVG(difference) AS m, COALESCE({Z} * STDDEV_SAMP(difference) / SQRT(COUNT(*)), 0) AS h, COUNT(*) AS n FROM pd GROUP BY 1)")
def paired_interval_by_family(spark, sf):
    return rounded(I.mean_interval(differences(spark, sf), "difference", ["family"]), 3)


@query(with_(ER, PD) + "SELECT family, condition, COUNT(*) AS rows, ROUND(SUM(difference) / (SELECT COUNT(*) FROM pd), 4) AS contribution FROM pd GROUP BY 1, 2")
def contribution_matrix(spark, sf):
    return rounded(E.contribution(differences(spark, sf), "difference", ["family", "condition"]))


@query(with_(CL) + "SELECT outcome, CAST(i - 1 AS INT) AS position, COUNT(arm) AS n FROM (SELECT UNNEST(['accepted', 'repair', 'refusal', 'timeout']) AS outcome, UNNEST([1, 2, 3, 4]) AS i) LEFT JOIN cl USING (outcome) GROUP BY 1, 2")
def outcome_counts(spark, sf):
    return E.category_counts(call_log(spark, sf), "outcome", ["accepted", "repair", "refusal", "timeout"])


@query(with_(ER) + "SELECT unit, " + ", ".join(f"MAX(profit) FILTER (arm = '{a}') AS a{i}" for i, a in enumerate(ARMS, 1)) + " FROM er GROUP BY unit")
def pivot_arm(spark, sf):
    return E.pivot_arms(episode_results(spark, sf), "unit", ARMS, "profit", "max")


@query(with_(CL) + "SELECT episode, arm, ARG_MAX(outcome, call_id) AS outcome FROM cl GROUP BY 1, 2")
def terminal_attempt(spark, sf):
    return E.terminal_attempt(call_log(spark, sf), ["episode", "arm"], "call_id", "outcome")


@query(with_(ER) + f"SELECT family, ROUND((t - c) / ABS(c), 6) AS lift, (t - c) / ABS(c) >= 0.05 AS clears FROM (SELECT family, AVG(profit) FILTER (arm = '{T}') AS t, AVG(profit) FILTER (arm = '{C}') AS c FROM er GROUP BY 1)")
def relative_lift_by_family(spark, sf):
    mean = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("profit")))
    lifts = episode_results(spark, sf).groupBy("family").agg(E.relative_lift(mean(T), mean(C)).alias("lift"))
    return rounded(lifts.withColumn("clears", F.col("lift") >= 0.05), 6)


@query(with_(ER, PD) + "SELECT family, CAST(CASE WHEN AVG(difference) > 0 THEN CEIL(POW(2.8015852180796507 * STDDEV_SAMP(difference) / AVG(difference), 2)) END AS BIGINT) AS units FROM pd GROUP BY family")
def required_units_by_family(spark, sf):
    z = I.NormalDist().inv_cdf(0.975) + I.NormalDist().inv_cdf(0.8)
    ratio = z * F.stddev_samp("difference") / F.avg("difference")
    return differences(spark, sf).groupBy("family").agg(F.when(F.avg("difference") > 0, F.ceil(ratio * ratio)).alias("units"))


@query(with_(ER) + "SELECT unit, arm, COUNT(*) AS n FROM er GROUP BY 1, 2 HAVING COUNT(*) > 1")
def uniqueness_guard(spark, sf):
    return episode_results(spark, sf).groupBy("unit", "arm").agg(F.count("*").alias("n")).where("n > 1")


@query(with_(CL) + "SELECT tokens, COUNT(*) AS calls, COUNT(DISTINCT outcome) AS answers FROM cl GROUP BY tokens HAVING COUNT(*) > 1")
def repeated_prompts(spark, sf):
    return call_log(spark, sf).groupBy("tokens").agg(F.count("*").alias("calls"), F.count_distinct("outcome").alias("answers")).where("calls > 1")


@query(with_(CL) + "SELECT arm, k, n, ROUND(k / n, 6) AS rate FROM (SELECT arm, COUNT(*) FILTER (outcome = 'accepted') AS k, COUNT(outcome) AS n FROM cl GROUP BY arm)")
def outcome_rate(spark, sf):
    return rounded(call_log(spark, sf).groupBy("arm").agg(*E.rate(F.when(F.col("outcome").isNotNull(), F.col("outcome") == "accepted"))), 6)


@query(with_(CL) + "SELECT arm, tokens, n, CAST(r AS INT) AS place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY arm ORDER BY n DESC, tokens) AS r FROM (SELECT arm, tokens, COUNT(*) AS n FROM cl WHERE outcome = 'refusal' OR outcome = 'repair' GROUP BY 1, 2)) WHERE r <= 8")
def top_errors(spark, sf):
    counts = call_log(spark, sf).where("outcome in ('refusal', 'repair')").groupBy("arm", "tokens").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(E.Window.partitionBy("arm").orderBy(F.desc("n"), "tokens"))).where("place <= 8")


@query(with_(CL) + "SELECT call_id, tokens, charged, ROW_NUMBER() OVER (PARTITION BY tokens, outcome ORDER BY call_id) = 1 AS physical FROM cl")
def charge_physical(spark, sf):
    return call_log(spark, sf).select("call_id", "tokens", "charged", (F.row_number().over(E.Window.partitionBy("tokens", "outcome").orderBy("call_id")) == 1).alias("physical"))


@query(with_(CL) + "SELECT arm, COUNT(*) FILTER (charged) AS charged, COUNT(*) FILTER (first) AS physical, COUNT(*) FILTER (first) <= COUNT(*) AS conserved FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY arm, tokens ORDER BY call_id) = 1 AS first FROM cl) GROUP BY arm")
def conservation_guard(spark, sf):
    first = F.row_number().over(E.Window.partitionBy("arm", "tokens").orderBy("call_id")) == 1
    return call_log(spark, sf).withColumn("first", first).groupBy("arm").agg(F.count_if("charged").alias("charged"), F.count_if("first").alias("physical"), (F.count_if("first") <= F.count("*")).alias("conserved"))


@query(with_(ER) + f"SELECT unit, arm FROM (SELECT DISTINCT unit FROM er) u, (SELECT DISTINCT arm FROM er) a WHERE NOT EXISTS (SELECT 1 FROM er WHERE er.unit = u.unit AND er.arm = a.arm)")
def missing_pairs_antijoin(spark, sf):
    er = episode_results(spark, sf)
    arms = spark.createDataFrame([(a,) for a in ARMS], "arm string")
    expected = er.select("unit").distinct().crossJoin(F.broadcast(arms))  # the registered arms: a list of five
    return expected.join(er.select("unit", "arm"), ["unit", "arm"], "left_anti")
