"""Ordered functions over (key, period) panels, as windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quayside.plans.runtime import materialize

UP_TO = (Window.unboundedPreceding, 0)
BEFORE = (Window.unboundedPreceding, -1)


def over(keys: Sequence[str], order: str = "period", frame=None) -> Window:
    w = Window.partitionBy(*keys).orderBy(order)
    return w.rowsBetween(*frame) if frame else w


def max_streak(panel: DataFrame, flag: Column, keys: Sequence[str], order: str = "period") -> DataFrame:
    """Longest run of consecutive rows with flag; 0 where there is none."""
    rows = panel.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_b", F.sum(F.when(~F.col("_f"), 1).otherwise(0)).over(over(keys, order, UP_TO)))
    runs = rows.groupBy(*keys, "_b").agg(F.count_if("_f").alias("_n"))
    return runs.groupBy(*keys).agg(F.max("_n").alias("streak"))


def time_to_recovery(panel: DataFrame, fill: Column, shock: Column, keys: Sequence[str], threshold: float = 0.95, sustain: int = 3) -> DataFrame:
    """Periods from the shock to the first period that opens sustain rows of fill at or above threshold; null if there is none."""
    ahead = Window.partitionBy(*keys).orderBy("period").rowsBetween(0, sustain - 1)
    ok = (F.min(fill).over(ahead) >= threshold) & (F.count("*").over(ahead) == sustain)
    rows = panel.withColumns({"_ok": ok, "_shock": shock})
    return rows.groupBy(*keys).agg((F.min(F.when(F.col("_ok") & (F.col("period") >= F.col("_shock")), F.col("period"))) - F.min("_shock")).alias("recovery"))


def running_forecast(panel: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of all values before the row; deviation 0 below two values."""
    w = over(keys, frame=BEFORE)
    n = F.count(value).over(w)
    return panel.withColumns({"n": n, "mean": F.avg(value).over(w), "sd": F.when(n >= 2, F.stddev_samp(value).over(w)).when(n == 1, 0.0)})


def observation_lag(panel: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """prev_<column>: the values of the period before; 0 in the first."""
    w = over(keys)
    return panel.withColumns({f"prev_{c}": F.coalesce(F.lag(c).over(w), F.lit(0)) for c in columns})


def ewma_last(panel: DataFrame, value: str, keys: Sequence[str], gamma: float) -> DataFrame:
    """Normalised exponentially weighted mean of each key's values, newest first."""
    age = F.max("period").over(Window.partitionBy(*keys)) - F.col("period")
    weighed = panel.withColumn("_w", F.pow(F.lit(gamma), age))
    return weighed.groupBy(*keys).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("ewma"))


def leading_run(panel: DataFrame, flag: Column, keys: Sequence[str]) -> DataFrame:
    """Rows before the first with flag."""
    first = F.min(F.when(flag, F.col("period")))
    return panel.groupBy(*keys).agg((F.coalesce(first, F.max("period") + 1) - F.min("period")).alias("run"))


def first_row(frame: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in order; combined before the shuffle. order: columns, or pairs of a column and "desc", which must be numbers."""
    place = F.struct(*[(-F.col(c[0]) if isinstance(c, tuple) else F.col(c)).alias(f"o{k}") for k, c in enumerate(order)])
    rest = [c for c in frame.columns if c not in keys]
    return frame.groupBy(*keys).agg(F.min_by(F.struct(*rest), place).alias("_row")).select(*[c if c in keys else F.col("_row")[c].alias(c) for c in frame.columns])


def even_stride(frame: DataFrame, keys: Sequence[str], order: Sequence[str], count: int) -> DataFrame:
    """The rows at positions floor(i n / count) of each key."""
    w = Window.partitionBy(*keys)
    rows = frame.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    # position p is taken if some i has floor(i n / count) = p: the bucket ceil(p count / n) is new
    i = F.ceil(F.col("_i") * count / F.col("_n"))
    return rows.where((F.floor(i * F.col("_n") / count) == F.col("_i")) & (i < count)).drop("_i", "_n")


def value_ranks(frame: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """by, value, count and before: each value's rows, and the rows of smaller values in its group. Values are counted before they
    are sorted, and sorted by ranges, so that no task holds a group."""
    counts = frame.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("count"))
    ranked = running_total(counts, [*by, "value"], F.col("count"), "_all")
    if not by:
        return ranked.withColumnRenamed("_all", "before")
    starts = ranked.groupBy(*by).agg(F.min("_all").alias("_start"))
    return ranked.join(starts, list(by)).withColumn("before", F.col("_all") - F.col("_start")).drop("_all", "_start")


def at_ranks(ranked: DataFrame, ranks: Sequence[tuple[str, Column]], by: Sequence[str] = ()) -> DataFrame:
    """by, _n and a column for each named rank (from 0; a Column of _n): the value there. ranked: of value_ranks."""
    n = ranked.groupBy(*by).agg(F.sum("count").alias("_n"))
    both = ranked.join(n, list(by)) if by else ranked.join(F.broadcast(n))
    here = lambda r: F.max(F.when((F.col("before") <= r) & (r < F.col("before") + F.col("count")), F.col("value")))
    return both.groupBy(*by, "_n").agg(*[here(r).alias(name) for name, r in ranks])


def linear_quantiles(frame: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """by and a column for each named share: quantiles interpolated between neighbours."""
    place = lambda q: F.lit(float(q)) * (F.col("_n") - 1)
    ranks = [(f"_{side}_{name}", f(place(q)).cast("long")) for name, q in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    found = at_ranks(value_ranks(frame, value, by), ranks, by)
    part = lambda q: place(q) - F.floor(place(q))
    return found.select(*by, *[(F.col(f"_low_{k}") + part(q) * (F.col(f"_high_{k}") - F.col(f"_low_{k}"))).alias(k) for k, q in shares.items()])


def nearest_ranks(frame: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """by and a column for each named share: the smallest value that at least that share of rows does not exceed."""
    ranks = [(name, F.greatest(F.lit(0), F.ceil(F.lit(float(q)) * F.col("_n") - 1e-9) - 1).cast("long")) for name, q in shares.items()]
    return at_ranks(value_ranks(frame, value, by), ranks, by).drop("_n")


def nearest_rank(frame: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """share and value, over the whole frame."""
    wide = nearest_ranks(frame, value, {f"q{k}": q for k, q in enumerate(shares)})
    return wide.select(F.explode(F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q{k}").alias("value")) for k, q in enumerate(shares)])).alias("r")).select("r.share", "r.value")


def running_total(frame: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """frame with the sum of value over all rows before each in a total order, without a task that sees them all.

    Rows are range-partitioned and written once, so that the ranges stay as they are; totals of ranges, one row each, are
    summed in order, and each range adds its own running sum.
    """
    ranges = materialize(frame.withColumn("_v", value).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(*BEFORE)), F.lit(0))
    offsets = ranges.groupBy("_p").agg(F.sum("_v").alias("_s")).select("_p", before.alias("_o"))
    inside = F.coalesce(F.sum("_v").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(*BEFORE)), F.lit(0))
    return ranges.withColumn("_i", inside).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_i")).drop("_v", "_p", "_i", "_o")  # a row per range


def numbered(frame: DataFrame, order: Sequence[str], name: str = "i") -> DataFrame:
    """frame with each row's place from 0 in a total order; order must tell rows apart for the places to be fixed."""
    return running_total(frame, order, F.lit(1), name)


def interleave(frames: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """Round robin over ordered sources: place numbers each source's rows, turn names the source."""
    placed = [numbered(f, order, "place").withColumns({"place": F.col("place") + 1, "turn": F.lit(k)}) for k, f in enumerate(frames)]
    out = placed[0]
    for f in placed[1:]:
        out = out.unionByName(f)
    return out


def ordered_fold(panel: DataFrame, keys: Sequence[str], columns: Sequence[str], init: Column, step, finish=None, order: str = "period") -> DataFrame:
    """A stateful fold over each key's rows in order: keys and result. Stays in the JVM; state is a struct column.

    Rows of a key are gathered, so a key must be an episode-like bounded sequence.
    """
    rows = panel.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("_rows"))
    return rows.select(*keys, (F.aggregate("_rows", init, step, finish) if finish else F.aggregate("_rows", init, step)).alias("result"))
