"""Indexes kept up to date from a stream of contents.

Contents are immutable and named by what they hold, so a stream needs no watermark: what was seen once is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import search
from ..session import ship_package
from ..sources import formats


def loose_stream(spark: SparkSession, git_dir: str) -> DataFrame:
    """``oid, kind, data`` of loose objects as they come, from the repository's folder."""
    ship_package(spark)
    raw = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[0-9a-f]*").schema("path string, modificationTime timestamp, length long, content binary").load(f"{git_dir}/objects")

    def decode(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                kind, data = formats.loose_object(bytes(content))
                rows.append(("".join(path.split("/")[-2:]), kind, data))
            yield pd.DataFrame(rows, columns=["oid", "kind", "data"])

    return raw.filter(F.col("path").rlike("/objects/[0-9a-f]{2}/[0-9a-f]{38}$")).select("path", "content").mapInPandas(decode, "oid string, kind string, data binary")


def keep_index(blobs: DataFrame, provider: search.Provider, folder: str, schema: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write a provider's rows for every new content of a stream of ``oid, path, text`` to ``folder``/index; ``folder``/seen holds what was.

    Each micro-batch goes to files of its own number, so a repeated batch overwrites what it wrote before.
    """
    spark = blobs.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        done = spark.read.schema("oid string, batch long").option("ignoreMissingFiles", "true").parquet(f"{folder}/seen").filter(F.col("batch") < number)
        new = search.not_indexed(batch, done.select("oid")).persist()
        provider(new).write.mode("overwrite").parquet(f"{folder}/index/batch={number}")
        new.select("oid").write.mode("overwrite").parquet(f"{folder}/seen/batch={number}")
        new.unpersist()

    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/index/batch=-1")
    spark.createDataFrame([], "oid string").write.mode("overwrite").parquet(f"{folder}/seen/batch=-1")
    return blobs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def committed(commits: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Commits per author and window of a stream of ``author, time``, late ones up to ``late`` counted."""
    return commits.withWatermark("time", late).groupBy(F.window("time", every), "author").agg(F.count(F.lit(1)).alias("commits"))
