"""Hypothesis cases: agreement with the truth, exposure to wrong beliefs, grids of alternatives, Monte Carlo cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quayside.operators.inference import hash_draw
from quayside.operators.panel import numbered, running_total


def ratio(k: Column, n: Column) -> Column:
    """k / n; null where n is 0."""
    return F.when(n > 0, k / n)


def case_metrics(cases: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """cases: true_<field> and pred_<field>, activated, true_null, delay. One row of metrics per group.

    exact: all fields agree, where a pair of nulls agrees. Abstention is a predicted family of no_change.
    """
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"true_{f}").eqNullSafe(F.col(f"pred_{f}"))
    abstain, null, active = F.col("pred_family") == "no_change", F.col("true_null"), F.col("activated")
    wrong = active & ~null & (F.col("pred_family") != F.col("true_family"))
    return cases.groupBy(*by).agg(
        F.count("*").alias("cases"), ratio(F.count_if(same), F.count("*")).alias("exact"), ratio(F.count_if(abstain & null), F.count_if(abstain)).alias("abstention_precision"), ratio(F.count_if(abstain & null), F.count_if(null)).alias("abstention_recall"),
        F.count_if(active & null).alias("false_activations"), F.count_if(wrong).alias("wrong_activations"), F.avg(F.when(active & ~null & ~wrong, F.col("delay"))).alias("mean_delay"),
    )


def field_f1(cases: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, true_value, pred_value of all pairs that are not both null: the input of macro_f1 by field."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"true_{f}").alias("t"), F.col(f"pred_{f}").alias("p")) for f in fields])
    return cases.select(F.explode(pairs).alias("x")).select("x.field", F.coalesce("x.t", F.lit("(none)")).alias("true_value"), F.coalesce("x.p", F.lit("(none)")).alias("pred_value")).where("not (true_value = '(none)' and pred_value = '(none)')")


def exposure(records: DataFrame, wrong: Column, keys: Sequence[str]) -> DataFrame:
    """Share of a key's periods under a wrong belief."""
    return records.groupBy(*keys).agg(F.avg(F.coalesce(wrong, F.lit(False)).cast("double")).alias("exposure"))


def level_alternatives(spark: SparkSession, multipliers: Sequence[float], starts: Sequence[int], durations: Sequence[int | None]) -> DataFrame:
    """A registered grid of multiplier, start and duration (null: lasting), with equal weights."""
    rows = [(m, s, d) for m in multipliers for s in starts for d in durations]
    return spark.createDataFrame(rows, "multiplier double, start int, duration int").withColumn("weight", F.lit(1.0 / len(rows)))


def tilted(delays: Column, strength: float) -> Column:
    """A delay law, by delay from 0, tilted exponentially towards long delays; its total stays."""
    raised = F.transform(delays, lambda p, i: p * F.exp(i * strength))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda p: p * total(delays) / total(raised))


def with_loss(delays: Column, loss: float) -> Column:
    """A delay law scaled so that loss is left of 1."""
    return F.transform(delays, lambda p: p * (1 - loss) / F.aggregate(delays, F.lit(0.0), lambda s, x: s + x))


def hash_schedule(spark: SparkSession, n: int, horizon: int, seed: int, spacing: int = 1) -> DataFrame:
    """n firing periods in an order drawn from a hash: slots of spacing periods, so that no two are closer."""
    slots = spark.range(1, horizon // spacing + 1).select(((F.col("id") - 1) * spacing + 1).cast("int").alias("period"))
    drawn = slots.withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.sha2(F.concat(F.lit(f"{seed}/"), F.col("period").cast("string")), 256))))
    return drawn.where(F.col("_r") <= n).drop("_r")


def cell_summary(paths: DataFrame, value: str, cell: Sequence[str], period: str = "period") -> DataFrame:
    """Monte Carlo cells: mean and standard error per period, then each cell's largest mean, where it is, and its error."""
    per = paths.groupBy(*cell, period).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("se"))
    top = F.max_by(F.struct("mean", "se", period), F.struct("mean", -F.col(period))).alias("top")
    return per.groupBy(*cell).agg(top, F.count("*").alias("periods")).select(*cell, "periods", F.col("top.mean").alias("sup_mean"), F.col("top.se").alias("se"), F.col(f"top.{period}").alias("at"))


def flag(estimate: Column, se: Column, bound: float, z: float = 1.96) -> Column:
    """clear: above the bound by z errors; point: above it; null: not above."""
    return F.when(estimate - z * se > bound, "clear").when(estimate > bound, "point")


def rank_correlation(frame: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's and Spearman's correlations; average ranks from counts of values."""

    def ranks(c: str) -> DataFrame:
        counts = frame.groupBy(F.col(c).alias(f"_{c}")).agg(F.count("*").alias("_k"))
        return running_total(counts, [f"_{c}"], F.col("_k"), "_before").select(f"_{c}", (F.col("_before") + (F.col("_k") + 1) / 2).alias(f"r_{c}"))

    ranked = frame.join(ranks(x), F.col(x) == F.col(f"_{x}")).join(ranks(y), F.col(y) == F.col(f"_{y}"))
    return ranked.agg(F.corr(x, y).alias("pearson"), F.corr(f"r_{x}", f"r_{y}").alias("spearman"), F.count("*").alias("n"))


def cluster_flips(frame: DataFrame, value: str, cluster: str, flips: int) -> DataFrame:
    """One-sided Monte Carlo sign-flip test on cluster sums, with counter-based signs; the observed value counts as one flip."""
    sums = frame.groupBy(cluster).agg(F.sum(value).alias("s"))
    signed = numbered(sums, [cluster]).select("s", (F.col("i") + 1).alias("i"), F.explode(F.sequence(F.lit(1), F.lit(flips))).alias("flip"))
    sign = F.when(hash_draw(F.col("flip"), F.col("i"), F.lit(2)) == 1, 1).otherwise(-1)
    total = signed.groupBy("flip").agg(F.sum(sign * F.col("s")).alias("t"), F.sum("s").alias("seen"))
    return total.agg(((F.count_if(F.col("t") >= F.col("seen") - 1e-9) + 1) / (F.count("*") + 1)).alias("p_value"), F.count("*").alias("flips"))


def clean_json(text: Column) -> Column:
    """Fences stripped, trailing commas dropped."""
    bare = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    return F.regexp_replace(bare, r",\s*([}\]])", "$1")


def parameter(text: Column, name: str) -> Column:
    """The number given to a parameter anywhere in a text: name, a colon or an equals sign, a number."""
    return F.regexp_extract(text, rf'(?i)"?{name}"?\s*[:=]\s*"?(-?[0-9]+(?:\.[0-9]+)?)', 1).try_cast("double")


def null_registrations(spark: SparkSession, n: int, kinds: Sequence[str], onsets: tuple[int, int], base: int) -> DataFrame:
    """Balanced null rows: kind and onset cycle with the index, seeds follow it."""
    names = F.array(*map(F.lit, kinds))
    width = onsets[1] - onsets[0] + 1
    return spark.range(n).select(F.col("id").alias("row"), F.get(names, F.pmod("id", F.lit(len(kinds))).cast("int")).alias("kind"), (onsets[0] + F.pmod(F.floor(F.col("id") / len(kinds)), F.lit(width))).cast("int").alias("onset"), (base + F.col("id")).alias("seed"))


def log_ratio_bound(a: float, c: float) -> float:
    """Ville's bound on a false alarm for prior odds: a (1 - c) / (c (1 - a))."""
    return a * (1 - c) / (c * (1 - a)) if 0 < a < 1 and c > 0 else math.inf
