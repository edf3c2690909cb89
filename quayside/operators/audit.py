"""Audits of rating sheets: completeness, agreement by criterion, samples to remove."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unrated(sheet: DataFrame, ratings: DataFrame) -> DataFrame:
    """Cells of the sheet (sample_id, rater, criterion) without a rating."""
    return sheet.select("sample_id", "rater", "criterion").join(ratings.select("sample_id", "rater", "criterion"), ["sample_id", "rater", "criterion"], "left_anti")


def side_by_side(ratings: DataFrame, raters: Sequence[str]) -> DataFrame:
    """sample_id, criterion, a, b: the scores of two raters where both gave one."""
    first, second = raters
    score = lambda r: F.max(F.when(F.col("rater") == r, F.col("score")))
    return ratings.groupBy("sample_id", "criterion").agg(score(first).alias("a"), score(second).alias("b")).where("a is not null and b is not null")


def kappa_by(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Agreement beyond chance of a and b in each group; null where chance alone agrees always. One pass for the cells, none over rows again."""
    cells = pairs.groupBy(*by, "a", "b").agg(F.count("*").alias("n"))
    margin = lambda c: F.sum("n").over(Window.partitionBy(*by, c))
    total = F.sum("n").over(Window.partitionBy(*by))
    # each row of a margin is counted once: its cell with the least other value stands for it
    rows = cells.withColumns({"_t": total, "_a": margin("a"), "_first": F.row_number().over(Window.partitionBy(*by, "a").orderBy("b"))})
    b = cells.groupBy(*by, F.col("b").alias("a")).agg(F.sum("n").alias("_b"))
    joined = rows.join(b, [*by, "a"], "left")
    seen = F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)) / F.first("_t")
    chance = F.sum(F.when(F.col("_first") == 1, F.col("_a") * F.coalesce("_b", F.lit(0))).otherwise(0)) / (F.first("_t") * F.first("_t"))
    return joined.groupBy(*by).agg(F.first("_t").alias("items"), seen.alias("observed"), chance.alias("expected")).withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def removals(pairs: DataFrame, cell: Sequence[str], cap: int) -> DataFrame:
    """The samples raters disagree on most, at most cap of each cell; ties by sample."""
    apart = pairs.groupBy(*cell, "sample_id").agg(F.sum(F.abs(F.col("a") - F.col("b"))).alias("disagreement")).where("disagreement > 0")
    place = F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("disagreement"), "sample_id"))
    return apart.withColumn("place", place).where(F.col("place") <= cap)
