"""Endpoints, contrasts, efficiency, operational and agreement metrics over episode-level frames.

Every function takes and returns DataFrames and is planned lazily; small frames of weights are broadcast because their
size is that of the registered design, not of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quayside.operators.panel import linear_quantiles, nearest_ranks, value_ranks


def long_endpoints(frame: DataFrame, keys: Sequence[str], endpoints: Sequence[str]) -> DataFrame:
    """Wide to long: keys, endpoint, value."""
    pairs = ", ".join(f"'{e}', cast({e} as double)" for e in endpoints)
    return frame.select(*keys, F.expr(f"stack({len(endpoints)}, {pairs}) as (endpoint, value)"))


def arm_endpoints(results: DataFrame, endpoints: Sequence[str]) -> DataFrame:
    """Mean of each endpoint by arm, with distinct units."""
    return long_endpoints(results, ["unit", "arm"], endpoints).groupBy("arm", "endpoint").agg(F.avg("value").alias("mean"), F.count_distinct("unit").alias("units"))


def weighted_mean(frame: DataFrame, value: str, strata: Sequence[str], weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means of strata weighted by weights (strata, weight), renormalised over the strata that have rows."""
    means = frame.groupBy(*by, *strata).agg(F.avg(value).alias("mean")).join(F.broadcast(weights), list(strata))
    return means.groupBy(*by).agg((F.sum(F.col("weight") * F.col("mean")) / F.sum("weight")).alias("weighted_mean"), F.count("*").alias("strata"))


def paired_differences(results: DataFrame, treatment: str, control: str, endpoint: str, keep: Sequence[str] = ()) -> DataFrame:
    """unit, keep, difference for units that have both arms. One aggregation, no self join."""
    side = lambda arm: F.max(F.when(F.col("arm") == arm, F.col(endpoint)))
    both = results.where(F.col("arm").isin(treatment, control)).groupBy("unit", *keep).agg(side(treatment).alias("t"), side(control).alias("c"))
    return both.where("t is not null and c is not null").select("unit", *keep, (F.col("t") - F.col("c")).alias("difference"))


def paired_full(results: DataFrame, treatment: str, control: str, endpoint: str) -> DataFrame:
    """Every unit with either arm; missing_t and missing_c count what a strict pairing would refuse."""
    side = lambda arm: results.where(F.col("arm") == arm).select("unit", F.col(endpoint).alias(f"v_{'t' if arm == treatment else 'c'}"))
    both = side(treatment).join(side(control), "unit", "full")
    return both.agg(F.count("*").alias("units"), F.count_if(F.col("v_t").isNull()).alias("missing_t"), F.count_if(F.col("v_c").isNull()).alias("missing_c"), F.max(F.abs(F.col("v_t") - F.col("v_c"))).alias("max_abs_difference"))


def worst_share(frame: DataFrame, value: str, by: Sequence[str], share: float = 0.1) -> DataFrame:
    """Rows with the lowest ceil(share n) values of each group; of rows that tie at the cut, the first by their other columns.

    The cut is found among counts of values by ranges; only its ties are numbered in a window.
    """
    ranked = value_ranks(frame, value, by)
    sizes = ranked.groupBy(*by).agg(F.sum("count").alias("_n"))
    wanted = F.ceil(F.col("_n") * share)
    cut = ranked.join(sizes, list(by)).where((F.col("before") < wanted) & (F.col("before") + F.col("count") >= wanted)).select(*by, F.col("value").alias("_cut"), (wanted - F.col("before")).alias("_room"))
    near = frame.join(cut, list(by)).where(F.col(value) <= F.col("_cut"))
    ties = Window.partitionBy(*by).orderBy(*([c for c in frame.columns if c not in {value, *by}] or [value]))
    at_cut = near.where(F.col(value) == F.col("_cut")).withColumn("_rank", F.row_number().over(ties)).where("_rank <= _room")
    return near.where(F.col(value) < F.col("_cut")).select(*frame.columns).unionByName(at_cut.select(*frame.columns))


def cvar(frame: DataFrame, value: str, by: Sequence[str], share: float = 0.1, copies: int = 1) -> DataFrame:
    """Mean of the lowest ceil(share n) values of each group; ties at the cut count as often as there is room. Every row
    counts copies times."""
    counts = value_ranks(frame, value, by).withColumns({c: F.col(c) * copies for c in ("count", "before")})
    wanted = F.ceil(F.col("_n") * share)
    taken = F.greatest(F.lit(0), F.least("count", wanted - F.col("before")))
    rows = counts.join(counts.groupBy(*by).agg(F.sum("count").alias("_n")), list(by)).withColumn("_k", taken)
    return rows.where("_k > 0").groupBy(*by).agg((F.sum(F.col("_k") * F.col("value")) / F.sum("_k")).alias("cvar"), F.sum("_k").alias("rows"))


def relative_lift(treatment: Column, control: Column) -> Column:
    inf = F.lit(float("inf"))
    return F.when(control != 0, (treatment - control) / F.abs(control)).when(treatment > 0, inf).when(treatment < 0, -inf).otherwise(0.0)


def efficiency(calls: DataFrame) -> DataFrame:
    """Calls, repairs, refusals, tokens, linear percentiles of latency, tokens per accepted call, by arm."""
    accepted = F.count_if(F.col("outcome") == "accepted")
    counts = calls.groupBy("arm").agg(
        F.count("*").alias("calls"), F.count_if(F.col("outcome") == "repair").alias("repairs"), F.count_if(F.col("outcome") == "refusal").alias("refusals"), F.sum("tokens").alias("tokens"),
        F.max("latency").alias("longest"), F.when(accepted > 0, F.sum("tokens") / accepted).alias("tokens_per_accepted"),
    )
    return counts.join(linear_quantiles(calls, "latency", {"p50": 0.5, "p95": 0.95}, ["arm"]), "arm", "left")


def ledger_summary(calls: DataFrame) -> DataFrame:
    """Charged calls by arm with nearest-rank percentiles, 0 where there is no latency."""
    charged = calls.where("charged")
    counts = charged.groupBy("arm").agg(F.count("*").alias("charged"), F.sum("tokens").alias("tokens"))
    ranks = nearest_ranks(charged, "latency", {"p50": 0.5, "p95": 0.95}, ["arm"])
    return counts.join(ranks, "arm", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("p50", "p95")})


def macro_f1(pairs: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of F1 over the union of labels."""
    labels = pairs.select(*by, F.explode(F.array_distinct(F.array(truth, predicted))).alias("label"), F.col(truth).alias("_t"), F.col(predicted).alias("_p"))
    hit = lambda c: F.count_if(c)
    t, p = F.col("_t") == F.col("label"), F.col("_p") == F.col("label")
    counts = labels.groupBy(*by, "label").agg(hit(t & p).alias("tp"), hit(~t & p).alias("fp"), hit(t & ~p).alias("fn"))
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.groupBy(*by).agg(F.avg(f1).alias("macro_f1"), F.count("*").alias("labels"))


def confusion(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    return pairs.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement beyond chance of two raters; null where chance alone agrees always."""
    cells = pairs.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("n")).otherwise(0)).alias("agree"))
    by = lambda c: cells.groupBy(F.col(c).alias("v")).agg(F.sum("n").alias(f"n{c}"))
    chance = by("_a").join(by("_b"), "v").agg(F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).alias("s"))
    po, pe = F.col("agree") / F.col("n"), F.col("s") / (F.col("n") * F.col("n"))
    return total.join(chance).select(F.col("n").alias("items"), po.alias("observed"), pe.alias("expected"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def rate(flags: Column) -> list[Column]:
    """k, n, rate of non-null flags."""
    k, n = F.count_if(flags), F.count(flags)
    return [k.alias("k"), n.alias("n"), F.when(n > 0, k / n).alias("rate")]


def contribution(frame: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Additive shares of the overall mean: sum over the cell, divided by all rows."""
    n = frame.agg(F.count("*").alias("_n"))
    return frame.groupBy(*keys).agg(F.sum(value).alias("_s"), F.count("*").alias("rows")).join(F.broadcast(n)).select(*keys, "rows", (F.col("_s") / F.col("_n")).alias("contribution"))


def category_counts(frame: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Counts over a fixed list of categories, zeros kept."""
    listed = frame.sparkSession.createDataFrame([(c, i) for i, c in enumerate(order)], f"{column} string, position int")
    return listed.join(frame.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, "position", F.coalesce("n", F.lit(0)).alias("n"))


def pivot_arms(frame: DataFrame, key: str, arms: Sequence[str], value: str, how: str = "first") -> DataFrame:
    """One column per arm, named a1, a2, ... in the order given."""
    wide = frame.groupBy(key).pivot("arm", list(arms)).agg(getattr(F, how)(value))
    return wide.select(key, *[F.col(f"`{a}`").alias(f"a{i}") for i, a in enumerate(arms, 1)])


def terminal_attempt(calls: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """The value of the last attempt per key."""
    return calls.groupBy(*keys).agg(F.max_by(value, order).alias(value))
