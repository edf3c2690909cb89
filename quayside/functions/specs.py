"""The hypothesis registry, the control grid and the compiler between them, as small dimension frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The grid and the registered pairs of family, stream, signature and direction.
MULTIPLIERS, LEADS, CREDITS = (0.6, 0.75, 1.0, 1.25, 1.5, 2.0), (1, 2, 3, 4), (0.0, 0.5, 1.0)
REGISTRY = (
    ("no_change", "none", "sig_demand_level_up", "demand_up"),
    ("demand_level", "demand", "sig_demand_level_up", "demand_up"),
    ("demand_level", "demand", "sig_demand_level_down", "demand_down"),
    ("temporary_pulse", "demand", "sig_demand_pulse", "demand_up"),
    ("lead_time_shift", "arrival", "sig_arrival_delay", "arrival_delayed"),
    ("shipment_loss", "arrival", "sig_arrival_loss", "arrival_interrupted"),
    ("transit_pause", "arrival", "sig_arrival_stall", "arrival_interrupted"),
    ("compound", "both", "sig_compound", "mixed"),
)


def label(m: Column, lead: Column, credit: Column) -> Column:
    """What a grid point believes: of demand, of supply, or of both."""
    demand = F.when(m > 1, "demand_up").when(m < 1, "demand_down")
    supply = F.when((lead > 1) & (credit == 1), "lead_time_delay").when((lead == 1) & (credit < 1), "shipment_loss").when((lead > 1) & (credit < 1), "transit_stall")
    return F.when(demand.isNotNull() & supply.isNotNull(), F.concat(F.lit("compound_"), demand, F.lit("_"), supply)).otherwise(F.coalesce(demand, supply, F.lit("stationary")))


def control_grid(spark: SparkSession) -> DataFrame:
    axis = lambda name, values: spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))
    grid = axis("m", MULTIPLIERS).crossJoin(axis("l_eff", LEADS)).crossJoin(axis("gamma", CREDITS))  # 72 rows by design
    return grid.withColumn("predictive_model", label(F.col("m"), F.col("l_eff"), F.col("gamma")))


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGISTRY), "family string, stream string, signature string, direction string")


def illegal(specs: DataFrame) -> DataFrame:
    """Specs whose family, stream, signature and direction are not registered together."""
    return specs.join(F.broadcast(registry(specs.sparkSession)), ["family", "stream", "signature", "direction"], "left_anti")


def magnitude_bin(multiplier: Column) -> Column:
    size = F.abs(multiplier - 1)
    return F.when(size < 0.3, "low").when(size < 0.6, "medium").otherwise("high")


def duration_bin(periods: Column) -> Column:
    return F.when(periods.isNull(), "none").when(periods <= 3, "1_3").when(periods <= 8, "4_8").otherwise("longer")


def lifetime(duration: Column, persistent: Column, remaining: Column) -> Column:
    """Periods a hypothesis may live: those of its duration, or all that remain."""
    return F.when(persistent, remaining).otherwise(F.least(remaining, F.when(duration == "1_3", 3).when(duration == "4_8", 8).otherwise(remaining)))


# Grid points (multiplier, lead, credit) of canonical hypotheses at low, medium and high magnitude.
UP, DOWN = ((1.25, 1, 1.0), (1.5, 1, 1.0), (2.0, 1, 1.0)), ((0.75, 1, 1.0), (0.6, 1, 1.0), (0.6, 1, 1.0))
CANONICAL = {
    ("demand_level", "demand_up", "demand"): UP,
    ("demand_level", "demand_down", "demand"): DOWN,
    ("temporary_pulse", "demand_up", "demand"): UP,
    ("temporary_pulse", "demand_down", "demand"): DOWN,
    ("lead_time_shift", "arrival_delayed", "arrival"): ((1.0, 2, 1.0), (1.0, 3, 1.0), (1.0, 4, 1.0)),
    ("shipment_loss", "arrival_interrupted", "arrival"): ((1.0, 1, 0.5), (1.0, 1, 0.0), (1.0, 1, 0.0)),
    ("transit_pause", "arrival_interrupted", "arrival"): ((1.0, 2, 1.0), (1.0, 2, 1.0), (1.0, 3, 0.5)),
    ("compound", "mixed", "both"): ((1.25, 2, 1.0), (1.25, 2, 1.0), (1.5, 3, 1.0)),
}
FAMILIES = ("demand_level", "temporary_pulse", "lead_time_shift", "shipment_loss", "transit_pause", "compound")
DIRECTIONS = ("demand_up", "demand_down", "arrival_delayed", "arrival_interrupted", "mixed")
STREAMS, MAGNITUDES = ("demand", "arrival", "both"), ("low", "medium", "high")
KEY = ["family", "direction", "stream", "magnitude"]


def legal_specs(spark: SparkSession) -> DataFrame:
    """Every shape of a hypothesis once, and the abstention."""
    axis = lambda name, values: spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))
    shapes = axis("family", FAMILIES).crossJoin(axis("direction", DIRECTIONS)).crossJoin(axis("stream", STREAMS)).crossJoin(axis("magnitude", MAGNITUDES))  # 270 rows by design
    return shapes.unionByName(spark.createDataFrame([("no_change", "none", "none", None)], "family string, direction string, stream string, magnitude string"))


def spec_points(spark: SparkSession) -> DataFrame:
    """The compiler's table: canonical hypotheses at their points; grid points that these leave are given, in order, to the other shapes."""
    from pyspark.sql.window import Window

    canonical = spark.createDataFrame([(*shape, MAGNITUDES[k], *point) for shape, points in CANONICAL.items() for k, point in enumerate(points)], "family string, direction string, stream string, magnitude string, m double, l_eff int, gamma double")
    point = ["m", "l_eff", "gamma"]
    taken = canonical.select(*point).union(spark.createDataFrame([(1.0, 1, 1.0)], "m double, l_eff int, gamma double"))
    numbered = lambda df, *order: df.withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    rank = F.array_position(F.array(*map(F.lit, MAGNITUDES)), F.col("magnitude"))
    others = numbered(legal_specs(spark).where("magnitude is not null").join(canonical.select(*KEY), KEY, "left_anti"), "family", "direction", "stream", rank)
    free = numbered(control_grid(spark).select(*point).join(taken, point, "left_anti"), *point)
    return canonical.unionByName(others.join(free, "_r").select(*KEY, *point))


def compile_specs(specs: DataFrame) -> DataFrame:
    """specs with the grid point each compiles to: total, as what has no point of its own gets the baseline."""
    placed = specs.join(F.broadcast(spec_points(specs.sparkSession)), KEY, "left")  # at most 270 rows
    full = placed.withColumns({"m": F.coalesce("m", F.lit(1.0)), "l_eff": F.coalesce("l_eff", F.lit(1)), "gamma": F.coalesce("gamma", F.lit(1.0))})
    return full.withColumn("predictive_model", label(F.col("m"), F.col("l_eff"), F.col("gamma")))
