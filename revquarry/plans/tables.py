"""The synthetic tables read as repositories: contents, snapshots, histories, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import objects as O


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_path(moved=None):
    plain = F.concat_ws("/", "lang", "source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    elsewhere = F.concat_ws("/", "lang", F.lit("moved"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return plain if moved is None else F.when(moved, elsewhere).otherwise(plain)


def files(docs: DataFrame, path=None) -> DataFrame:
    """``path, mode, oid, size, text`` with one file a document."""
    return docs.select("doc_id", (path if path is not None else doc_path()).alias("path"), F.lit("100644").alias("mode"), F.lit("blob").alias("kind"), O.object_id("blob", "text").alias("oid"), F.octet_length("text").cast("long").alias("size"), "text")


def old_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(table(spark, sf_dir, "documents").filter("doc_id % 10 <> 0"))


def new_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some documents are new, some edited (a line more), some moved to another directory."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 10 <> 1")
    edited = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\nedited"))).otherwise(F.col("text")))
    return files(edited, doc_path(F.col("doc_id") % 13 == 0))


def talk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is a commit; its first parent is the turn before, and every third has another three back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    oid = lambda turn: F.col("conv_id") * 1000 + turn
    first = turns.select(oid(F.col("turn")).alias("child"), oid(F.col("turn") - 1).alias("parent"), F.lit(0).alias("parent_no"))
    second = turns.filter("turn % 3 = 0").select(oid(F.col("turn")).alias("child"), oid(F.col("turn") - 3).alias("parent"), F.lit(1).alias("parent_no"))
    return first.unionByName(second).join(turns.select(oid(F.col("turn")).alias("parent")), "parent", "left_semi").select("child", "parent", "parent_no")


def talk_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("start")).agg((F.max("turn") + F.col("conv_id") * 1000).alias("oid"))


def heap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a history with merges: the parent of k is k/2, and k/3 too for every fifth."""
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("child")).distinct()
    first = k.filter("child >= 2").select("child", F.floor(F.col("child") / 2).alias("parent"), F.lit(0).alias("parent_no"))
    second = k.filter("child >= 3 and child % 5 = 0").select("child", F.floor(F.col("child") / 3).alias("parent"), F.lit(1).alias("parent_no"))
    return first.unionByName(second)


def commit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o_orderkey, signature, commit, tag`` texts from orders and their customers."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    zone = F.when(F.col("o_custkey") % 3 == 0, "+0000").when(F.col("o_custkey") % 3 == 1, "+0200").otherwise("-0530")
    sign = F.concat("c_name", F.lit(" <"), F.lower("c_name"), F.lit("@example.com> "), F.unix_timestamp("o_orderdate").cast("string"), F.lit(" "), zone)
    o = o.withColumn("signature", sign)
    key = F.col("o_orderkey").cast("string")
    parents = F.concat(F.lit("parent "), F.sha1(F.concat(F.lit("p"), key).cast("binary")), F.lit("\n"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("parent "), F.sha1(F.concat(F.lit("q"), key).cast("binary")), F.lit("\n"))).otherwise(F.lit("")))
    commit = F.concat(F.lit("tree "), F.sha1(key.cast("binary")), F.lit("\n"), parents, F.lit("author "), sign, F.lit("\ncommitter "), sign, F.lit("\nencoding UTF-8\n\n\nOrder "), key, F.lit(" is "), "o_orderstatus", F.lit("\n\ntree of lines\n"))
    tag = F.concat(F.lit("object "), F.sha1(key.cast("binary")), F.lit("\ntype commit\ntag v"), key, F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat(F.lit("\ntagger "), sign)), F.lit("\n\nRelease "), key)
    return o.select("o_orderkey", "signature", commit.alias("commit"), tag.alias("tag"))


def place_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as trees."""
    entry = lambda df, tree, kind, mode, name, oid: df.select(F.concat(F.lit(tree[0]), F.col(tree[1]).cast("string")).alias("tree_oid") if tree[1] else F.lit(tree[0]).alias("tree_oid"), F.lit(0).alias("ordinal"), F.lit(mode).alias("mode"), F.lit(kind).alias("kind"), F.col(name).alias("name"), F.concat(F.lit(oid[0]), F.col(oid[1]).cast("string")).alias("oid"))
    r, n, c = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    return entry(r, ("root", None), "tree", "40000", "r_name", ("r", "r_regionkey")).unionByName(entry(n, ("r", "n_regionkey"), "tree", "40000", "n_name", ("n", "n_nationkey"))).unionByName(entry(c, ("n", "c_nationkey"), "blob", "100644", "c_name", ("c", "c_custkey")))


def config_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, ordinal, value``: lines of a configuration per region."""
    part = F.concat(F.lit('[Branch "'), "n_name", F.lit('"]\n\tRemote = origin\n; a comment\n\tmerge=refs/heads/'), F.lower("n_name"), F.lit("\n\n\tflag"))
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("repo")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", part.alias("t")))).alias("parts"))
    text = F.concat(F.lit("# top\n[core]\n\tbare = false\n"), F.array_join(F.transform("parts", lambda x: x["t"]), "\n"))
    return n.select("repo", F.posexplode(F.split(text, "\n")).alias("ordinal", "value"))


def references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Loose and packed references from suppliers."""
    s = table(spark, sf_dir, "supplier")
    canonical = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "refs/remotes/").otherwise("refs/heads/"), "s_name")
    loose = s.filter("s_suppkey % 7 = 0").select(canonical.alias("canonical"), F.sha1(F.concat("s_name", F.lit(" loose")).cast("binary")).alias("oid"))
    packed = s.filter("s_suppkey % 11 <> 0").select(canonical.alias("canonical"), F.sha1(F.col("s_name").cast("binary")).alias("oid"))
    return loose, packed


def changeset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, op, data, mode, seq``: three writes to some documents of the old snapshot, of which the last counts."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 5 = 2")
    each = docs.select("doc_id", doc_path().alias("path"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seq"))
    put = (F.col("doc_id") + F.col("seq")) % 4 != 0
    return each.select("path", F.when(put, "put").otherwise("remove").alias("op"), F.concat(F.lit("write "), F.col("seq").cast("string"), F.lit(" of "), F.col("doc_id").cast("string")).cast("binary").alias("data"), F.lit(None).cast("string").alias("mode"), "seq")
