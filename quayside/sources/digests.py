"""Two runs compared by trees of digests: the first differing row is found without joining the runs.

A run is stored in leaves, ranges of a whole-numbered key, with a tree over them: a leaf's digest is that of its rows,
whatever their order, a node's that of its children. Comparison goes down from the root along nodes that differ, and reads
the rows of the one leaf it ends in, which are in a folder of their own.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Children of a node, and levels below the root: 16^2 leaves.
FANOUT, DEPTH = 16, 2


def row_digest(columns: Sequence[str]) -> Column:
    """120 bits of a row's digest in two numbers that add up without overflow; nulls and texts are told apart."""
    text = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.conv(F.substring(text, at, 15), 16, 10).cast("decimal(20,0)")
    return F.struct(part(1).alias("a"), part(16).alias("b"))


def leaf_of(key: str, low: int, high: int, depth: int) -> Column:
    """The key's range from 0 to FANOUT^depth - 1; keys outside of low to high go to the ends."""
    at = F.floor((F.col(key).cast("decimal(38,0)") - low) * FANOUT**depth / (high - low + 1))
    return F.greatest(F.lit(0), F.least(F.lit(FANOUT**depth - 1), F.coalesce(at, F.lit(0)))).cast("int")


def store_run(rows: DataFrame, folder: str, key: str, *, bounds: tuple[int, int] | None = None, depth: int = DEPTH) -> tuple[int, int]:
    """Write rows and their tree below folder. bounds of the key come from the run that another is compared with; they are
    returned. A row without a key is in the first leaf."""
    if bounds is None:
        ends = rows.agg(F.min(key), F.max(key)).first()
        bounds = (int(ends[0] or 0), int(ends[1] or 0))
    columns = sorted(rows.columns)
    leaves = rows.select(*columns, leaf_of(key, *bounds, depth).alias("_leaf"))
    leaves.repartition("_leaf").write.partitionBy("_leaf").mode("errorifexists").parquet(f"{folder}/rows")
    spark = rows.sparkSession
    spark.createDataFrame([(leaves.schema.json(),)], "value string").coalesce(1).write.text(f"{folder}/schema")
    stored = stored_rows(spark, folder)
    level = stored.select("_leaf", row_digest(columns).alias("d")).groupBy(F.col("_leaf").alias("node")).agg(F.count("*").alias("rows"), F.sum("d.a").alias("a"), F.sum("d.b").alias("b"))
    level = level.select("node", "rows", F.sha2(F.concat_ws("/", "rows", "a", "b"), 256).alias("digest"))
    tree = level.withColumn("level", F.lit(depth))
    for k in range(depth - 1, -1, -1):
        children = F.sort_array(F.collect_list(F.struct("node", "digest")))  # FANOUT at most
        level = level.groupBy(F.floor(F.col("node") / FANOUT).cast("int").alias("node")).agg(F.sum("rows").alias("rows"), F.sha2(F.to_json(children), 256).alias("digest"))
        tree = tree.unionByName(level.withColumn("level", F.lit(k)))
    tree.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/tree")
    return bounds


def stored_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A stored run's rows with their leaf; the schema is stored too, as an empty run has no file to tell it."""
    schema = StructType.fromJson(json.loads(spark.read.text(f"{folder}/schema").first()[0]))
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def differing_nodes(spark: SparkSession, left: str, right: str, depth: int = DEPTH) -> list[list[int]]:
    """The differing nodes of each level that lie below differing ones, from the root down; an empty list where runs agree."""
    side = lambda folder, n: spark.read.parquet(f"{folder}/tree").select("level", "node", F.col("digest").alias(n))
    both = side(left, "l").join(side(right, "r"), ["level", "node"], "full").where(~F.col("l").eqNullSafe(F.col("r")))
    path: list[list[int]] = []
    for k in range(depth + 1):
        here = both.where(F.col("level") == k)
        if k and path[-1]:
            here = here.where(F.floor(F.col("node") / FANOUT) == path[-1][0])  # the first branch that differs
        path.append(sorted(r.node for r in here.select("node").collect()) if not path or path[-1] else [])  # FANOUT at most
    return path


def first_difference(spark: SparkSession, left: str, right: str, order: Sequence[str], depth: int = DEPTH) -> DataFrame:
    """order, side (left only, right only, both) and differing (names of columns) of the first rows, in order, that the two
    runs do not share; none if they agree. order tells rows apart."""
    path = differing_nodes(spark, left, right, depth)
    leaf = path[-1][0] if path[-1] else -1
    read = lambda folder: stored_rows(spark, folder).where(F.col("_leaf") == leaf).drop("_leaf")
    l, r = read(left), read(right)  # noqa: E741
    rest = [c for c in l.columns if c not in order]
    same = F.lit(True)
    for c in order:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    both = l.withColumn("_in", F.lit(1)).alias("l").join(r.withColumn("_in", F.lit(1)).alias("r"), same, "full")
    names = F.array_compact(F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in rest])) if rest else F.array().cast("array<string>")
    side = F.when(F.col("r._in").isNull(), "left only").when(F.col("l._in").isNull(), "right only").otherwise("both")
    found = both.select(*[F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in order], side.alias("side"), names.alias("differing"))
    return found.where((F.col("side") != "both") | (F.size("differing") > 0)).orderBy(*order).limit(1)
