"""Readers of instance directories, record stores and rating sheets.

An instance is a folder with test.csv and, optionally, train.csv, supply.csv and incident.json. Column names embed the
item (demand_<item>), so files are read as lines and their headers brought to one form; every instance of a tree is read
by the same three scans, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_COLUMNS = 32
# Promised lead times by the label in a path.
PROMISED = (("lead_time_0", 0), ("lead_time_4", 4), ("lead_time_stochastic", 2))
NAMES = ("exact_dates", "demand", "description", "lead_time", "profit", "holding_cost")


def number(cell: Column) -> Column:
    """A cell as double; the spellings of infinity are a lost shipment; null if empty."""
    plain = F.lower(F.trim(F.regexp_replace(cell, '"', "")))
    return F.when(plain.isin("inf", "+inf", "infinity"), F.lit(float("inf"))).when(plain == "", None).otherwise(plain.try_cast("double"))


def canonical(name: Column) -> Column:
    """demand_<item> → demand; other names stay."""
    out = name
    for known in NAMES:
        out = F.when(name.startswith(f"{known}_"), F.lit(known)).otherwise(out)
    return out


def cells(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, instance (its folder), row (from 1) and a map of canonical name to cell, for every file of that name below root."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), "value")
    schema = ", ".join(f"c{i} string" for i in range(MAX_COLUMNS))
    parsed = lambda line: F.from_csv(line, F.lit(schema), {"mode": "PERMISSIVE"})
    lines = files.select("path", F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("row", "line"))
    cut = lines.select("path", "row", parsed(F.col("line")).alias("c")).select("path", "row", F.array(*[F.col(f"c.c{i}") for i in range(MAX_COLUMNS)]).alias("v"))
    heads = cut.where("row = 0").select("path", F.transform(F.filter("v", lambda x: x.isNotNull()), canonical).alias("head"))
    rows = cut.where("row > 0").join(heads, "path")
    instance = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return rows.select("path", instance.alias("instance"), "row", F.map_from_arrays("head", F.slice("v", F.lit(1), F.size("head"))).alias("cell"))


def promised_lead_time(path: Column) -> Column:
    out = F.lit(None).cast("int")
    for label, value in PROMISED:
        out = F.when(path.contains(label), F.lit(value)).otherwise(out)
    return out


def read_periods(spark: SparkSession, root: str) -> DataFrame:
    """instance, period, date, demand, lead_time (inf: lost), pause, profit, holding, promised; a sidecar overrides what it declares."""
    test = cells(spark, root, "test.csv").select(
        "instance", F.col("row").alias("period"), F.col("cell.exact_dates").alias("date"), number(F.col("cell.demand")).alias("demand"), number(F.col("cell.lead_time")).alias("own_lead"),
        number(F.col("cell.profit")).alias("profit"), number(F.col("cell.holding_cost")).alias("holding"), promised_lead_time(F.col("instance")).alias("promised"),
    )
    side = cells(spark, root, "supply.csv").select("instance", F.col("cell.period").cast("int").alias("period"), number(F.col("cell.lead_time")).alias("side_lead"), F.lower(F.trim(F.col("cell.pause_active"))).isin("1", "true", "yes").alias("pause"))
    joined = test.join(side, ["instance", "period"], "left")
    return joined.select("instance", "period", "date", "demand", F.coalesce("side_lead", "own_lead", F.col("promised").cast("double")).alias("lead_time"), F.coalesce("pause", F.lit(False)).alias("pause"), "profit", "holding", "promised")


def incomplete_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """Instances whose supply.csv does not cover every period of test.csv; must be empty."""
    count = lambda name, key: cells(spark, root, name).groupBy("instance").agg(key.alias(name[:-4]))
    return count("supply.csv", F.count_distinct("cell.period")).join(count("test.csv", F.count("*")), "instance", "left").where(~F.col("supply").eqNullSafe(F.col("test")))


def read_train(spark: SparkSession, root: str) -> DataFrame:
    return cells(spark, root, "train.csv").select("instance", F.col("row").alias("period"), number(F.col("cell.demand")).alias("demand"))


def instance_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """One row per instance: periods, first profit and holding cost, lost shipments, total demand, whether leads are constant."""
    rows = read_periods(spark, root)
    lost = F.count_if(F.col("lead_time") == float("inf"))
    first = lambda c: F.min_by(c, "period").alias(c)
    return rows.groupBy("instance", "promised").agg(F.count("*").alias("periods"), first("profit"), first("holding"), lost.alias("lost"), F.sum("demand").alias("demand"), (F.count_distinct("lead_time") <= 1).alias("constant_lead"))


INCIDENT = ("family string, onset_period int, magnitude double, duration int, conditional_independence boolean, supply_effect struct<kind:string,start_period:int,length:int,disrupted_lead_time:int>, baseline_twin_id string, seed bigint, held_out_combo boolean")


def read_incidents(spark: SparkSession, root: str) -> DataFrame:
    """Hidden truth, in a frame of its own: never join it to what a policy sees."""
    rows = spark.read.schema(INCIDENT).json(root, multiLine=True, recursiveFileLookup=True, pathGlobFilter="incident.json")
    return rows.select(F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]*$", 1).alias("instance"), *rows.columns)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, gzipped or not; blank lines are skipped and malformed ones carry their text in _corrupt_record."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(whole).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def read_ratings(spark: SparkSession, path: str, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ratings with a score, and rows of samples that are not known, which must be empty."""
    rows = spark.read.csv(path, header=True, schema="sample_id string, rater string, criterion string, score string").where(F.trim("score") != "")
    return rows.withColumn("score", F.col("score").cast("int")), rows.join(samples.select("sample_id"), "sample_id", "left_anti")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """A list of ids, one a line, without comments and blank lines."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("id")).where("id <> ''")


class BadInput(ValueError):
    """A file that cannot be what it should be."""


def empty_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files of that name without a row after the header; must be empty."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = F.size(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != ""))
    return files.where(lines < 2).select("path")


def bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """path, line (from 1) and text of JSON lines that do not parse; blank lines count as lines. Files are read whole, one task each."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("at", "text"))
    whole = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = files.where(F.trim("text") != "").withColumn("r", F.from_json("text", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("r._bad is not null").select("path", (F.col("at") + 1).alias("line"), "text")


def versioned(records: DataFrame, version: int, enums: dict[str, list[str]] | None = None) -> DataFrame:
    """records, failing at run time on a schema_version other than version or a value outside its list."""
    ok = F.col("schema_version") == version
    for column, values in (enums or {}).items():
        ok = ok & (F.col(column).isNull() | F.col(column).isin(*values))
    return records.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("record "), F.to_json(F.struct("*")))).cast("boolean")))


def by_key(records: DataFrame, key: str) -> DataFrame:
    """records, failing at run time if a key occurs twice."""
    from pyspark.sql.window import Window

    rows = records.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    return rows.where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit(f"repeated {key} "), F.col(key).cast("string"))).cast("boolean"))).drop("_n")


#: The parts of a run's folder, and whether a run may lack them.
RUN_PARTS = {"records.jsonl.gz": False, "proposals.jsonl": True, "alerts.jsonl": True, "ledger.csv": False, "spend_log.jsonl": True}


def read_run(spark: SparkSession, root: str, partial: bool = False) -> dict[str, DataFrame]:
    """The parts of a run by name; a manifest that is not complete is refused unless partial."""
    manifest = spark.read.json(f"{root}/manifest.json", multiLine=True).first()
    if not partial and not manifest["complete"]:
        raise BadInput(f"{root} is a partial run")
    found = {r.path.rsplit("/", 1)[-1] for r in spark.read.format("binaryFile").load(root).select("path").collect()}  # a folder's few files
    missing = [name for name, optional in RUN_PARTS.items() if name not in found and not optional]
    if missing:
        raise BadInput(f"{root} lacks {missing}")
    read = lambda name: spark.read.csv(f"{root}/{name}", header=True, inferSchema=True) if name.endswith(".csv") else spark.read.json(f"{root}/{name}")
    return {name.split(".")[0]: read(name) for name in RUN_PARTS if name in found}


def read_bank(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """The templates of several YAML files, each a mapping with split and templates, in one frame."""
    from quayside.sources.reports import read_yaml

    rows = []
    for name, text in sorted(texts.items()):
        data = read_yaml(text)
        for t in data["templates"]:
            rows.append((t["template_id"], data["split"], t["family"], t["kind"], t["wording_family"], t["text"], {k: list(v) for k, v in t.get("slots", {}).items()}))
    return spark.createDataFrame(rows, "template_id string, split string, family string, kind string, wording string, text string, slots map<string,array<string>>")


def file_digests(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """instance and the SHA-256 of its file of that name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select(F.regexp_extract("path", r"^(?:file:)?/*(.*)/[^/]*$", 1).alias("instance"), F.sha2("content", 256).alias("sha256"))


def instance_profile(spark: SparkSession, root: str) -> DataFrame:
    """The catalogue with training rows, distinct lead times and digests of both files."""
    test = instance_catalogue(spark, root)
    leads = read_periods(spark, root).groupBy("instance").agg(F.sort_array(F.collect_set("lead_time")).alias("lead_times"), (F.count_distinct("profit") == 1).alias("constant_profit"), (F.count_distinct("holding") == 1).alias("constant_holding"))
    train = read_train(spark, root).groupBy("instance").agg(F.count("*").alias("train_rows"))
    plain = lambda df: df.withColumn("instance", F.regexp_replace("instance", "^file:/*", ""))
    out = plain(test).join(plain(leads), "instance").join(plain(train), "instance", "left")
    for name in ("test", "train"):
        out = out.join(plain(file_digests(spark, root, f"{name}.csv")).withColumnRenamed("sha256", f"{name}_sha256"), "instance", "left")
    return out


def read_orders(spark: SparkSession, root: str) -> DataFrame:
    """instance, period and order_quantity of published order sheets, a folder for each instance."""
    return spark.read.option("recursiveFileLookup", "false").csv(root, header=True, schema="period int, order_quantity bigint")


def replay_answers(proposals: DataFrame) -> DataFrame:
    """arm, episode, period and the answer of the last attempt."""
    return proposals.groupBy("arm", "episode", "period").agg(F.max_by("answer", "attempt").alias("answer"))
