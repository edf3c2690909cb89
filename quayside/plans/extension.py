"""Where a user's own code plugs in: names for frame builders, triggers and statistics of one's own.

A policy is an object with order (operators.policies.run_policy) or an order rule of columns (operators.control.closed_loop);
a compiler of specs is a frame to join; a prompt is an expression over a key's rows; a model's answers are a table joined
by their digest, as executors never call out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators import resampling
from quayside.operators.panel import ordered_fold

_BUILDERS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, builder: Callable[..., DataFrame]) -> None:
    """Give a builder of frames a name; a name is given once."""
    if name in _BUILDERS:
        raise ValueError(f"{name} is registered")
    _BUILDERS[name] = builder


def build(name: str, *args, **options) -> DataFrame:
    if name not in _BUILDERS:
        raise KeyError(f"{name} is not one of {sorted(_BUILDERS)}")
    return _BUILDERS[name](*args, **options)


def trigger(panel: DataFrame, columns: Sequence[str], init: Column, update: Callable[[Column, Column], Column], fires: Callable[[Column, Column], Column], keys: Sequence[str] = ("episode",)) -> DataFrame:
    """keys, period and fired of a trigger with state: update(state, row) gives the new state, fires(state, row) tells of it
    whether the trigger fires, and after a firing the state starts anew. init is a struct whose fields have their final types."""
    state = panel.sparkSession.range(1).select(init.alias("s")).schema["s"].dataType.simpleString()
    t = f"struct<s:{state},out:array<struct<period:int,fired:boolean>>>"
    once = lambda value, body: F.transform(F.array(value), body)[0]

    def step(acc: Column, row: Column) -> Column:
        def after(s: Column) -> Column:
            fired = F.coalesce(fires(s, row), F.lit(False))
            line = F.struct(row["period"].cast("int").alias("period"), fired.alias("fired"))
            return F.struct(F.when(fired, init.cast(state)).otherwise(s.cast(state)).alias("s"), F.concat(acc["out"], F.array(line)).alias("out")).cast(t)

        return once(update(acc["s"], row), after)

    start = F.struct(init.alias("s"), F.array().alias("out")).cast(t)
    return ordered_fold(panel, keys, columns, start, step).select(*keys, F.explode("result.out").alias("r")).select(*keys, "r.period", "r.fired")


def frontier_points(results: DataFrame, budget: Column, reward: Column) -> DataFrame:
    """arm, budget and reward by any aggregates."""
    return results.groupBy("arm").agg(budget.alias("budget"), reward.alias("reward"))


def bootstrap_statistic(frame: DataFrame, sums: dict[str, Column], statistic: Column, cluster: str, draws: int = 10_000) -> DataFrame:
    """low and high of any expression of sums over clusters drawn whole."""
    return resampling.percentile_interval(resampling.resampled(frame, sums, cluster, draws), statistic)
