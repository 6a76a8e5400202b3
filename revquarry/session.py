"""Session settings, the folder that driver and executors share, and tables written there."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Used only by a local master that names no checkpoint folder (tests).
LOCAL_WORKSPACE = "file:///tmp/checkpoints"


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def workspace(spark: SparkSession) -> str:
    """The shared folder, from ``spark.checkpoint.dir``. Only a local master may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = LOCAL_WORKSPACE
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **seen_too: Column) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and lost executors cost no recomputation.

    Rows are counted while they are written, and aggregates given by name are taken; :func:`seen_in` tells them.
    """
    path, seen = new_folder(df.sparkSession, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *(x.alias(k) for k, x in seen_too.items())).write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to, out._seen = path, seen.get
    return out


def seen_in(df: DataFrame, name: str = "rows"):
    """What :func:`written` saw of a DataFrame that it gave."""
    return df._seen.get(name)


def rows_in(df: DataFrame) -> int:
    """How many rows; for what :func:`written` gave without counting again."""
    known = getattr(df, "_seen", {}).get("rows")
    return df.count() if known is None else known


def discard(df: DataFrame) -> None:
    """Delete what :func:`written` wrote, once nothing reads it any more."""
    path = getattr(df, "_written_to", None)
    if path:
        discard_folder(df.sparkSession, path)


def discard_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started (a cluster installs it)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def clean(spark: SparkSession) -> None:
    """Delete all that this application wrote to the shared folder; DataFrames that read it are of no use afterwards."""
    discard_folder(spark, f"{workspace(spark)}/{spark.sparkContext.applicationId}")
