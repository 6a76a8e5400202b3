import subprocess

from pyspark.sql import functions as F

from revquarry.operators import search
from revquarry.streaming import incremental


def test_an_index_follows_a_stream(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "out")
    schema = "oid string, path string, text string"
    provider = search.text_provider(r"\.vb$", "Option Strict Off")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        incremental.keep_index(stream, provider, folder, "oid string", str(tmp_path / "checkpoint")).awaitTermination()
        return sorted(r.oid for r in spark.read.parquet(folder + "/index").collect())

    assert run([("1", "a.vb", "option strict off"), ("2", "b.txt", "option strict off")]) == ["1"]
    assert run([("1", "c.vb", "option strict off"), ("3", "d.vb", "Option Strict Off")]) == ["1", "3"]


def test_loose_objects_stream(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    oid = subprocess.run(["git", "-C", str(tmp_path), "hash-object", "-w", "--stdin"], input=b"foo", capture_output=True, check=True).stdout.decode().strip()
    query = incremental.loose_stream(spark, str(tmp_path / ".git")).writeStream.format("memory").queryName("loose").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.oid, r.kind, bytes(r.data)) for r in spark.table("loose").collect()] == [(oid, "blob", b"foo")]


def test_windows(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 11:00:00"), ("b", "2024-01-05 00:00:00")], "author string, time string").select("author", F.col("time").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "commits"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "commits"))
    query = incremental.committed(stream).writeStream.format("memory").outputMode("complete").queryName("per_day").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.author, r.commits) for r in spark.table("per_day").collect()) == [("a", 2), ("b", 1)]
