"""Constraints as relations that must be empty, and verdicts over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Violation(ValueError):
    """A constraint's relation has rows."""


def repeated(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def shared(pools: DataFrame, pool: str, value: str) -> DataFrame:
    """Values in more than one pool, with the pools."""
    return pools.groupBy(value).agg(F.sort_array(F.collect_set(pool)).alias("pools")).where(F.size("pools") > 1)


def missing(expected: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(seen.select(*keys), list(keys), "left_anti")


def drift(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys whose digest changed, appeared or went."""
    both = before.select(key, F.col(digest).alias("was")).join(after.select(key, F.col(digest).alias("now")), key, "full")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select(key, kind.alias("change"))


def require_empty(frame: DataFrame, name: str) -> None:
    """Raise with up to three rows if frame has any. The only action in this module."""
    rows = frame.take(3)
    if rows:
        raise Violation(f"{name}: {rows}")


def compare(estimate: Column, operator: Column, threshold: Column) -> Column:
    """The comparison named by operator; false where either side is null."""
    held = F.when(operator == ">=", estimate >= threshold).when(operator == ">", estimate > threshold).when(operator == "<=", estimate <= threshold).when(operator == "<", estimate < threshold).when(operator == "==", estimate == threshold)
    return F.coalesce(held, F.lit(False))


def verdicts(criteria: DataFrame, metrics: DataFrame) -> DataFrame:
    """criteria (name, kind, operator, threshold) against metrics (name, estimate, low, high): the conservative end of the interval decides."""
    joined = criteria.join(metrics, "name", "left")
    end = F.when(F.col("operator").isin(">=", ">"), F.coalesce("low", "estimate")).otherwise(F.coalesce("high", "estimate"))
    return joined.select("name", "kind", compare(end, F.col("operator"), F.col("threshold")).alias("met"))


def decision(verdict: DataFrame) -> DataFrame:
    """kill if any kill criterion is met, go if all go criteria are, else hold."""
    kill = F.bool_or(F.col("met") & (F.col("kind") == "kill"))
    go = F.bool_and(F.col("met") | (F.col("kind") != "go"))
    return verdict.agg(F.when(kill, "kill").when(go, "go").otherwise("hold").alias("decision"))


def labelled(analyses: DataFrame, registered: DataFrame) -> DataFrame:
    """analyses (id, label, family_level, metric) with the effective label, tails of single families being exploratory always,
    and whether it is confirmatory without a registration."""
    effective = F.when(F.col("family_level") & F.col("metric").isin("cvar10", "worst_decile"), "exploratory").otherwise(F.col("label"))
    rows = analyses.withColumn("effective", effective).join(registered.select("id", F.lit(True).alias("_known")), "id", "left")
    return rows.withColumn("unregistered", (F.col("effective") == "confirmatory") & F.col("_known").isNull()).drop("_known")


def registration_faults(entries: DataFrame, sections: Sequence[str]) -> DataFrame:
    """entries (section, name, value): weights that do not sum to 1, values left to be filled in, sections without entries."""
    total = F.sum(F.when(F.col("section") == "weight", F.col("value").try_cast("double")))
    weights = entries.agg(F.round(total, 6).alias("w")).where("abs(w - 1) > 1e-9").select(F.lit("weights").alias("fault"), F.format_string("%.2f", "w").alias("detail"))
    open_ = entries.where(F.upper("value").isin("TBD", "TODO", "FIXME", "XXX") | (F.trim("value") == "")).select(F.lit("placeholder").alias("fault"), F.col("name").alias("detail"))
    named = entries.sparkSession.createDataFrame([(s,) for s in sections], "section string")
    absent = named.join(entries.select("section").distinct(), "section", "left_anti").select(F.lit("missing").alias("fault"), F.col("section").alias("detail"))
    return weights.unionByName(open_).unionByName(absent)


def reachable_fields(schema, hidden: Sequence[str], path: str = "") -> list[str]:
    """Fields of a schema, at any depth, whose names are hidden from policies."""
    found = []
    for field in getattr(schema, "fields", []):
        here = f"{path}{field.name}"
        if field.name in hidden:
            found.append(here)
        inner = field.dataType
        while hasattr(inner, "elementType") or hasattr(inner, "valueType"):
            inner = getattr(inner, "elementType", None) or inner.valueType
        found += reachable_fields(inner, hidden, f"{here}.")
    return found


def require_hidden(frame: DataFrame, hidden: Sequence[str], name: str) -> None:
    """Raise if a frame that a policy sees holds a hidden field at any depth."""
    found = reachable_fields(frame.schema, hidden)
    if found:
        raise Violation(f"{name}: {found}")
