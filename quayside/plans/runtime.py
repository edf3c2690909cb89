"""Where operators put intermediate tables, and small helpers they share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Where the running code's tables are noted, if they are.
_SCRATCH: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if sc.applicationId not in _OWN:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="quayside-")
        atexit.register(shutil.rmtree, _OWN[sc.applicationId], ignore_errors=True)
    return _OWN[sc.applicationId]


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's name in the shared folder; inside scratch() it is one of the block's."""
    path = f"{shared_dir(spark).rstrip('/')}/quayside/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    if (made := _SCRATCH.get()) is not None:
        made.append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = fresh_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """The folders of the tables written inside the block, by the code that runs in it and by no other."""
    made: list[str] = []
    mark = _SCRATCH.set(made)
    try:
        yield made
    finally:
        _SCRATCH.reset(mark)


def discard(spark: SparkSession, made: list[str]) -> None:
    """Delete tables; frames that still read them are lost with them."""
    for path in made:
        remove(spark, path)
    made.clear()


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that were not written yet are lost with them."""
    remove(spark, f"{shared_dir(spark).rstrip('/')}/quayside/{spark.sparkContext.applicationId}")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable cannot be inlined again by the optimizer."""
    return F.transform(F.array(value), body)[0]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over all cores: small rows that cost much each would stay in the few tasks that their bytes fill."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
