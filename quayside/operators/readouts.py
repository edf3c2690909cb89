"""Readouts of a run in long form: contrasts by any axis, blocks of accuracy, scores of hypotheses, four intervals of a column,
counts of a catalogue. Each is one or two aggregations whatever the number of axes, as axes are rows and not passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators import evaluation, inference
from quayside.operators.hypotheses import field_f1, ratio
from quayside.operators.panel import linear_quantiles

ALL = "all"


def along(frame: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Every row once for the whole and once for each axis that it has a level of: axis and level."""
    parts = [F.struct(F.lit(ALL).alias("axis"), F.lit(ALL).alias("level"))] + [F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("level")) for a in axes]
    return frame.withColumn("_x", F.explode(F.array(*parts))).select("*", "_x.axis", "_x.level").drop("_x").where("level is not null")


def contrast_readout(results: DataFrame, contrasts: Sequence[tuple[str, str, str]], value: str, axes: Sequence[str], by: Sequence[str] = (), unit: str = "unit") -> DataFrame:
    """by, contrast, axis, level, n, mean, sd, base (the control's mean over the same units) and share of the base.

    results: unit, arm, by, axes, value; repeated rows of an arm are averaged first. contrasts: name, treatment, control. A
    unit without both arms of a contrast is out of that contrast.
    """
    arms = sorted({a for _, t, c in contrasts for a in (t, c)})
    of = {a: F.avg(F.when(F.col("arm") == a, F.col(value))).alias(f"v{k}") for k, a in enumerate(arms)}
    column = {a: F.col(f"v{k}") for k, a in enumerate(arms)}
    wide = results.where(F.col("arm").isin(arms)).groupBy(*by, unit, *axes).agg(*of.values())
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("contrast"), (column[t] - column[c]).alias("d"), column[c].alias("b")) for n, t, c in contrasts]))
    rows = along(wide.withColumn("p", pairs).select(*by, *axes, "p.*").where("d is not null"), axes)
    found = rows.groupBy(*by, "contrast", "axis", "level").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.avg("b").alias("base"))
    return found.withColumn("share", F.when(F.col("base") != 0, F.col("mean") / F.col("base")))


def gain_share(results: DataFrame, treatment: str, control: str, value: str, part: Column, unit: str = "unit") -> DataFrame:
    """total gain of a contrast, the gain of the units of a part, and its share; null where there is no gain."""
    d = evaluation.paired_differences(results.withColumn("unit", F.col(unit)).withColumn("_part", part), treatment, control, value, ["_part"])
    sums = d.agg(F.sum("difference").alias("total"), F.sum(F.when(F.col("_part"), F.col("difference"))).alias("part"))
    return sums.select("total", "part", F.when(F.col("total") != 0, F.col("part") / F.col("total")).alias("share"))


def accuracy_blocks(cases: DataFrame, scores: Sequence[str], axes: Sequence[str], outcome: str = "outcome") -> DataFrame:
    """axis, level, n, outcomes (a map of counts) and the count and rate of each score; a null score is a miss."""
    rows = along(cases, axes)
    hit = lambda s: F.count_if(F.coalesce(F.col(s), F.lit(False)))
    counts = rows.groupBy("axis", "level", F.col(outcome).alias("_o")).agg(F.count("*").alias("_n"), *[hit(s).alias(s) for s in scores])
    sums = counts.groupBy("axis", "level").agg(F.sum("_n").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("_o", "_n")))).alias("outcomes"), *[F.sum(s).alias(s) for s in scores])
    return sums.withColumns({f"{s}_rate": F.col(s) / F.col("n") for s in scores})


def confusion(cases: DataFrame, truth: str, said: str) -> DataFrame:
    return cases.groupBy(F.col(truth).alias("truth"), F.col(said).alias("said")).agg(F.count("*").alias("count"))


def timing(cases: DataFrame, relative: str, by: str, alert: Column) -> DataFrame:
    """by, called, median of the relative period, how many before the onset, how many on an alert; relative null: not called."""
    called = cases.where(F.col(relative).isNotNull())
    counts = cases.groupBy(by).agg(F.count(relative).alias("called"), F.count_if(F.col(relative) < 0).alias("before_onset"), F.count_if(alert & F.col(relative).isNotNull()).alias("on_alert"))
    return counts.join(linear_quantiles(called, relative, {"median": 0.5}, [by]), by, "left")


def case_scores(cases: DataFrame, fields: Sequence[str]) -> DataFrame:
    """metric and value: all thirteen metrics of hypothesis cases, null where nothing bears on one.

    cases: true_<field>, pred_<field>, activated, true_null, proposal_period, activation_period, rollback_period,
    expiration_period, state, magnitude_covered, benefited. The macro F1 of fields is the mean over fields that occur.
    """
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"true_{f}").eqNullSafe(F.col(f"pred_{f}"))
    abstain, null, active = F.col("pred_family") == "no_change", F.col("true_null"), F.col("activated")
    share = lambda c, of: ratio(F.count_if(c & of), F.count_if(of))
    metrics = {
        "exact_match": share(same, F.lit(True)), "abstention_precision": share(abstain & null, abstain), "abstention_recall": share(abstain & null, null),
        "magnitude_coverage": share(F.col("magnitude_covered"), F.col("magnitude_covered").isNotNull()), "activation_delay": F.avg(F.col("activation_period") - F.col("proposal_period")), "rollback_delay": F.avg(F.col("rollback_period") - F.col("activation_period")),
        "expiration_accuracy": share(F.col("state") == "expired", F.col("expiration_period").isNotNull()), "false_activation": F.count_if(active & null), "wrong_family_activation": F.count_if(active & ~null & (F.col("pred_family") != F.col("true_family"))),
        "wrong_spec_exposure": F.count_if(active & ~same), "benefit_given_activation": share(F.col("benefited"), active & F.col("benefited").isNotNull()),
    }
    wide = cases.agg(*[m.cast("double").alias(n) for n, m in metrics.items()])
    out = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics])).alias("m")).select("m.*")
    f1 = evaluation.macro_f1(field_f1(cases, fields), "true_value", "pred_value", ["field"])
    named = f1.select(F.concat(F.lit("f1_"), "field").alias("metric"), F.col("macro_f1").alias("value"))
    whole = f1.agg(F.max(F.when(F.col("field") == "family", F.col("macro_f1"))).alias("macro_f1"), F.avg("macro_f1").alias("field_macro_f1"))
    both = whole.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in ("macro_f1", "field_macro_f1")])).alias("m")).select("m.*")
    return out.unionByName(named).unionByName(both)


def interval_kinds(results: DataFrame, treatment: str, control: str, endpoints: Sequence[str], cluster: str, draws: int = 200) -> DataFrame:
    """endpoint, kind, estimate, low, high and n of a contrast: over units, over means of clusters, over whole clusters redrawn,
    and over the signs of its units (a score interval of how often it is above zero)."""
    out = None
    for e in endpoints:
        d = evaluation.paired_differences(results, treatment, control, e, [cluster])
        seeds = d.groupBy(cluster).agg(F.avg("difference").alias("difference"))
        drawn = inference.cluster_bootstrap(d.withColumn("cluster", F.col(cluster)), "difference", "cluster", draws)
        estimate = d.agg(F.avg("difference").alias("estimate"), F.count("*").alias("n"))
        up = d.agg(F.count_if(F.col("difference") > 0).alias("k"), F.count("*").alias("n")).withColumn("estimate", F.col("k") / F.col("n"))
        low, high = inference.wilson(F.col("k"), F.col("n"))
        kinds = {
            "units": inference.mean_interval(d, "difference"), "clusters": inference.mean_interval(seeds, "difference"),
            "redrawn": estimate.crossJoin(drawn.select("low", "high")), "above_zero": up.withColumns({"low": low, "high": high}),
        }
        for kind, frame in kinds.items():  # a row each
            row = frame.select(F.lit(e).alias("endpoint"), F.lit(kind).alias("kind"), F.col("estimate").cast("double").alias("estimate"), "low", "high", "n")
            out = row if out is None else out.unionByName(row)
    return out


def catalogue_counts(instances: DataFrame, kind: str, label: str, rows: str) -> DataFrame:
    """axis, level, instances, decisions (their rows) and horizons (the distinct row counts) of a catalogue: in all, by kind, by
    label and by both."""
    both = instances.withColumn("kind_and_label", F.concat_ws("/", kind, label)).withColumns({"kind": F.col(kind), "label": F.col(label)})
    found = along(both.select("kind", "label", "kind_and_label", F.col(rows).alias("rows")), ["kind", "label", "kind_and_label"])
    return found.groupBy("axis", "level").agg(F.count("*").alias("instances"), F.sum("rows").alias("decisions"), F.sort_array(F.collect_set("rows")).alias("horizons"))


def with_provenance(specs: DataFrame, calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """specs (keys, period) with what the system knows of the call that gave them: tau, proposal (its ordinal by key), model,
    decoding and prompt digest; fault says why a spec must not be registered.

    calls: keys, period, generated (the period it was made for), model, decoding, prompt_hash.
    """
    from pyspark.sql.window import Window

    own = calls.select(*keys, "period", "generated", "model", "decoding", "prompt_hash")
    rows = specs.join(own, [*keys, "period"], "left")
    ordinal = F.row_number().over(Window.partitionBy(*keys).orderBy("period"))
    fault = F.when(F.col("model").isNull(), "no call").when(F.col("period") < F.col("generated"), "backdated").when(F.length("prompt_hash") != 64, "bad digest")
    return rows.withColumns({"tau": F.col("period"), "proposal": ordinal, "fault": fault})
