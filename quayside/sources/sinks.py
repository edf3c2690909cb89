"""Writers: JSON lines, ledgers, order sheets, rating sheets, a content-addressed store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def json_lines(frame: DataFrame) -> DataFrame:
    """value: one compact JSON object a row, keys in order, nulls kept."""
    return frame.select(F.to_json(F.struct(*sorted(frame.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(frame: DataFrame, path: str, compress: bool = False) -> None:
    json_lines(frame).write.mode("errorifexists").text(path, compression="gzip" if compress else "none")


def ledger_lines(calls: DataFrame, order: Sequence[str], fixed: dict[str, int]) -> DataFrame:
    """value: CSV lines in order; columns of fixed have that many decimals."""
    cell = lambda c: F.format_string(f"%.{fixed[c]}f", c) if c in fixed else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return calls.orderBy(*order).select(F.concat_ws(",", *[cell(c) for c in calls.columns]).alias("value"))


def write_orders(orders: DataFrame, path: str) -> None:
    """period and order_quantity as CSV, a folder for each instance."""
    rows = orders.select("instance", F.col("period").cast("int").alias("period"), F.col("order_quantity").cast("long").alias("order_quantity"))
    rows.repartition("instance").sortWithinPartitions("instance", "period").write.mode("errorifexists").partitionBy("instance").csv(path, header=True)


def rating_sheet(samples: DataFrame, raters: Sequence[str], criteria: Sequence[str]) -> DataFrame:
    """Every sample for every rater and criterion, score empty."""
    grid = F.explode(F.array(*[F.struct(F.lit(r).alias("rater"), F.lit(c).alias("criterion")) for r in raters for c in criteria]))
    return samples.select("sample_id", grid.alias("g")).select("sample_id", "g.rater", "g.criterion", F.lit("").alias("score"))


def put(store: str, entries: DataFrame) -> None:
    """Append entries (key, value); repeated puts of a key are harmless, as reads keep one."""
    entries.select("key", "value").write.mode("append").parquet(store)


def get(spark: SparkSession, store: str) -> DataFrame:
    rows = spark.read.parquet(store)
    first = F.row_number().over(Window.partitionBy("key").orderBy("value"))
    return rows.withColumn("_r", first).where("_r = 1").drop("_r")


def write_instances(periods: DataFrame, root: str, item: str) -> None:
    """instance, period, demand, lead_time (null: lost), profit, holding as CSV, a folder for each instance, headers naming the item; whole-number cells."""
    lead = F.coalesce(F.col("lead_time").cast("long").cast("string"), F.lit("inf"))
    rows = periods.select(
        "instance", "period", F.concat(F.lit("Period_"), F.col("period").cast("string")).alias(f"exact_dates_{item}"), F.col("demand").cast("long").alias(f"demand_{item}"),
        lead.alias(f"lead_time_{item}"), F.col("profit").cast("long").alias(f"profit_{item}"), F.col("holding").cast("long").alias(f"holding_cost_{item}"),
    )
    rows.repartition("instance").sortWithinPartitions("instance", "period").drop("period").write.mode("errorifexists").partitionBy("instance").csv(root, header=True)


def write_pairs(periods: DataFrame, root: str, item: str, suffix: str = "__twin") -> None:
    """Shocked instances and their unshocked twins, which are null instances in form. periods: instance, period, profit,
    holding, demand, lead_time (null: lost), twin_demand and twin_lead_time."""
    twins = periods.select(F.concat("instance", F.lit(suffix)).alias("instance"), "period", F.col("twin_demand").alias("demand"), F.col("twin_lead_time").alias("lead_time"), "profit", "holding")
    write_instances(periods.select("instance", "period", "demand", "lead_time", "profit", "holding").unionByName(twins), root, item)


def write_train(train: DataFrame, root: str, item: str) -> None:
    """instance, period, demand: training values, whole numbers, a folder for each instance."""
    rows = train.select("instance", "period", F.concat(F.lit("Period_"), F.col("period").cast("string")).alias(f"exact_dates_{item}"), F.col("demand").cast("long").alias(f"demand_{item}"))
    rows.repartition("instance").sortWithinPartitions("instance", "period").drop("period").write.mode("errorifexists").partitionBy("instance").csv(root, header=True)


def write_pauses(pauses: DataFrame, root: str) -> None:
    """instance, period, pause: the sidecar of instances that have a pause at all."""
    paused = pauses.where("pause").select("instance").distinct()
    rows = pauses.join(paused, "instance", "left_semi").select("instance", "period", F.when(F.col("pause"), "true").otherwise("false").alias("pause_active"))
    rows.repartition("instance").sortWithinPartitions("instance", "period").write.mode("errorifexists").partitionBy("instance").csv(root, header=True)


def incident_lines(truths: DataFrame) -> DataFrame:
    """instance and incident, its hidden truth as JSON with keys in order; no effect is null."""
    effect = F.when(F.col("effect").isNotNull(), F.struct(F.when(F.col("effect") == "lead_time_shift", F.col("disrupted_lead")).alias("disrupted_lead_time"), F.col("effect").alias("kind"), F.col("effect_length").alias("length"), F.col("onset").alias("start_period")))
    payload = F.struct(
        F.concat("instance", F.lit("__twin")).alias("baseline_twin_id"), "conditional_independence", F.col("lasts").alias("duration"), F.col("shock_family").alias("family"), F.col("held_out").alias("held_out_combo"), F.coalesce("magnitude", F.lit(1.0)).alias("magnitude"), F.col("onset").alias("onset_period"), "seed", effect.alias("supply_effect"),
    )
    return truths.select("instance", F.to_json(payload, {"ignoreNullFields": "false"}).alias("incident"))


def flat_results(results: DataFrame, nested: str = "records") -> DataFrame:
    """A row per nested record, its fields beside the result's own, in a fixed order of columns."""
    fields = results.schema[nested].dataType.elementType.names
    own = sorted(c for c in results.columns if c != nested)
    return results.select(*own, F.explode_outer(nested).alias("_r")).select(*own, *[F.col(f"_r.{f}").alias(f"record_{f}") for f in sorted(fields)])


def write_rating_sheet(sheet: DataFrame, path: str) -> None:
    """An empty sheet; one that is there is not overwritten."""
    sheet.orderBy("sample_id", "rater", "criterion").coalesce(1).write.mode("errorifexists").csv(path, header=True)


def gzip_bytes(lines: list[str]) -> bytes:
    """Lines gzipped without a time stamp: the same bytes for the same lines. For small artifacts on the driver."""
    import gzip

    return gzip.compress(("\n".join(lines) + "\n").encode(), mtime=0)


def batch_scores(scores: DataFrame) -> DataFrame:
    """One row: batches (a map of their instances, mean score and service level), the mean over all instances, and its spread.
    scores: batch, normalized_reward, service_level; batches are a registered handful."""
    x = "normalized_reward"
    per = scores.groupBy("batch").agg(F.count("*").alias("num_instances"), F.avg(x).alias("score"), F.avg("service_level").alias("service_level_mean"))
    batches = per.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("batch", F.struct("num_instances", "score", "service_level_mean"))))).alias("batches"))
    whole = scores.agg(F.count("*").alias("total_instances"), F.avg(x).alias("overall_score"), F.median(x).alias("median"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return whole.crossJoin(batches)  # a row each


def write_run(parts: dict[str, DataFrame], root: str, meta: dict) -> str:
    """A run's parts as JSON lines below root, and its manifest: rows and digest of each part. Returns the manifest."""
    import json

    from quayside.sources.reports import digest

    out = dict(meta) | {"parts": {}}
    for name, frame in sorted(parts.items()):
        write_json_lines(frame, f"{root}/{name}", compress=True)
        row = digest(frame).first()
        out["parts"][name] = {"rows": row.n, "digest": row.digest}
    text = json.dumps(out, sort_keys=True)
    spark = next(iter(parts.values())).sparkSession
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{root}/manifest")
    return text
