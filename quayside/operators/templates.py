"""Message templates: slots, renderings, and the checks of a bank. templates: template_id, split, family, kind, wording, text, slots (a map of arrays)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def big_modulo(hex_digest: Column, n: Column) -> Column:
    """A hexadecimal number of any length modulo n, seven digits at a time."""
    chunks = F.regexp_extract_all(hex_digest, F.lit("[0-9a-f]{1,7}"), F.lit(0))
    step = lambda acc, c: (acc * F.pow(F.lit(16), F.length(c)).cast("long") + F.conv(c, 16, 10).cast("long")) % n
    return F.aggregate(chunks, F.lit(0).cast("long"), step)


def drawn_slots(template_id: Column, seed: Column, slots: Column) -> Column:
    """One value of each slot, by the SHA-256 of the compact JSON list of template, seed and slot."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    key = lambda name: F.concat(F.lit("["), quoted(template_id), F.lit(","), seed.cast("string"), F.lit(","), quoted(name), F.lit("]"))
    return F.transform_values(slots, lambda name, values: F.get(values, big_modulo(F.sha2(key(name), 256), F.size(values).cast("long")).cast("int")))


def rendered(text: Column, chosen: Column) -> Column:
    """The text with each {slot} replaced."""
    return F.aggregate(F.map_entries(chosen), text, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def all_renderings(templates: DataFrame, most: int = 100_000) -> DataFrame:
    """template_id, split and text of every combination of slot values; templates with more than most have none, and are in overflows."""
    count = F.aggregate(F.map_values("slots"), F.lit(1).cast("long"), lambda n, v: n * F.size(v))
    rows = templates.withColumn("_n", count).where((F.col("_n") > 0) & (F.col("_n") <= most))
    one = rows.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    # a combination's number, read in the mixed radix of the slots' sizes
    start = F.struct(F.col("_i").alias("left"), F.col("text").alias("t"))
    put = lambda acc, e: F.struct(F.floor(acc["left"] / F.size(e["value"])).alias("left"), F.replace(acc["t"], F.concat(F.lit("{"), e["key"], F.lit("}")), F.get(e["value"], (acc["left"] % F.size(e["value"])).cast("int"))).alias("t"))
    return one.select("template_id", "split", F.aggregate(F.map_entries("slots"), start, put, lambda acc: acc["t"]).alias("text"))


def overflows(templates: DataFrame, most: int = 100_000) -> DataFrame:
    count = F.aggregate(F.map_values("slots"), F.lit(1).cast("long"), lambda n, v: n * F.size(v))
    return templates.withColumn("combinations", count).where((F.col("combinations") == 0) | (F.col("combinations") > most)).select("template_id", "combinations")


def composition_faults(templates: DataFrame, families: Sequence[str], splits: Sequence[str], expected: dict[str, int]) -> DataFrame:
    """family and split of cells that do not hold the expected numbers of kinds."""
    spark = templates.sparkSession
    cells = spark.createDataFrame([(f, s) for f in families for s in splits], "family string, split string")
    wide = templates.groupBy("family", "split").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in expected])
    right = F.coalesce(F.col("n") == sum(expected.values()), F.lit(False))
    for k, n in expected.items():
        right = right & (F.col(k) == n)
    return cells.join(wide, ["family", "split"], "left").where(~F.coalesce(right, F.lit(False))).select("family", "split", F.coalesce("n", F.lit(0)).alias("n"))


def shared_texts(rows: DataFrame, owner: str) -> DataFrame:
    """Texts that several owners (templates or units) have in one split."""
    return rows.groupBy("split", "text").agg(F.count_distinct(owner).alias("owners"), F.min(owner).alias("first")).where("owners > 1")


def unregistered(templates: DataFrame, windows: DataFrame, signatures: DataFrame) -> DataFrame:
    """Templates whose onset window (lo, hi) or pair of family and signature is not registered."""
    bad_window = templates.where("lo is not null").join(F.broadcast(windows), ["lo", "hi"], "left_anti").select("template_id", F.lit("window").alias("fault"))
    bad_pair = templates.join(F.broadcast(signatures), ["family", "signature"], "left_anti").select("template_id", F.lit("signature").alias("fault"))
    return bad_window.unionByName(bad_pair)


def chosen_templates(units: DataFrame, templates: DataFrame, kind: str, shift: int = 0) -> DataFrame:
    """units (split, family, slot) with the template at their slot, modulo how many their cell has of a kind."""
    w = Window.partitionBy("split", "family")
    placed = templates.where(F.col("kind") == kind).select("split", "family", "template_id", (F.row_number().over(w.orderBy("template_id")) - 1).alias("_at"), F.count("*").over(w).alias("_n"))
    sizes = placed.select("split", "family", "_n").distinct()
    return units.join(sizes, ["split", "family"], "left").withColumn("_at", F.pmod(F.col("slot") + shift, F.col("_n"))).join(placed.drop("_n"), ["split", "family", "_at"], "left").drop("_at", "_n")


def review_sample(templates: DataFrame, kinds: Sequence[str], count: int) -> DataFrame:
    """The first count templates in turns over cells of family and kind, each family's kinds rotated by its place."""
    family = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("family")) - 1  # a bank is a registered handful
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")) - 1
    turn = F.row_number().over(Window.partitionBy("family", "kind").orderBy("template_id"))
    rows = templates.withColumns({"_f": family, "_turn": turn}).withColumn("_k", F.pmod(place - F.col("_f"), F.lit(len(kinds))))
    return rows.orderBy("_turn", "_k", "family", "template_id").limit(count).select("template_id", "family", "kind")
