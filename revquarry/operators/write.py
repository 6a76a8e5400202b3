"""The write path: change sets, the snapshots and tree ids they lead to, and commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import objects as O
from ..session import written

EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"  # the id of a tree without entries


def last_writes(changes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of several operations on a path the last (``path, op, data, mode, seq``; op is put or remove)."""
    last = F.max_by(F.struct("op", "data", "mode"), "seq").alias("x")
    return changes.groupBy(*by, "path").agg(last).select(*by, "path", "x.op", "x.data", "x.mode")


def require_changes(changes: DataFrame, allow_empty: bool = False) -> DataFrame:
    if not allow_empty and not changes.limit(1).count():
        raise ValueError("there is nothing to commit")
    return changes


def applied(files: DataFrame, changes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``path, mode, oid`` after the changes: replaced and removed files go, put ones come. Empty directories just have no files."""
    last = last_writes(changes, by)
    key = [*by, "path"]
    put = last.filter("op = 'put'").select(*by, "path", F.coalesce("mode", F.lit("100644")).alias("mode"), O.object_id("blob", "data").alias("oid"))
    return files.select(*by, "path", "mode", "oid").join(last.select(*key), key, "left_anti").unionByName(put)


def serialised(entries: Column) -> Column:
    """A tree's bytes from ``array<struct<mode,name,oid>>``: directories sort as if their names ended in a slash."""
    keyed = F.array_sort(F.transform(entries, lambda e: F.struct(F.concat(e["name"], F.when(e["mode"] == "40000", "/").otherwise("")).alias("k"), e["mode"].alias("mode"), e["name"].alias("name"), e["oid"].alias("oid"))))
    one = lambda e: F.concat(F.hex(F.concat(e["mode"], F.lit(" "), e["name"]).cast("binary")), F.lit("00"), F.upper(e["oid"]))
    return F.unhex(F.array_join(F.transform(keyed, one), ""))


def tree_objects(files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``dir, oid, data`` of every directory, the root ("") included, deepest first: one aggregation per level."""
    depth = lambda p: F.size(O.chunks(p))
    level = written(files.select(*by, "path", "mode", "oid").withColumn("depth", depth("path")), "entries")
    deepest = level.agg(F.max("depth")).first()[0] or 0
    trees: DataFrame | None = None
    carried: DataFrame | None = None
    for d in range(deepest, 0, -1):
        here = level.filter(F.col("depth") == d).select(*by, "path", "mode", "oid")
        if carried is not None:
            here = here.unionByName(carried)
        entries = F.collect_list(F.struct("mode", O.base_name("path").alias("name"), "oid"))
        made = here.groupBy(*by, O.parent_path("path").alias("dir")).agg(entries.alias("entries")).select(*by, "dir", serialised(F.col("entries")).alias("data"))
        made = written(made.withColumn("oid", O.object_id("tree", "data")), "trees")
        carried = made.filter("dir <> ''").select(*by, F.col("dir").alias("path"), F.lit("40000").alias("mode"), "oid")
        trees = made if trees is None else trees.unionByName(made)
    if trees is None:
        trees = files.select(*by, F.lit("").alias("dir"), F.unhex(F.lit("")).alias("data"), F.lit(EMPTY_TREE).alias("oid")).limit(0)
    return trees


def tree_ids(files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``dir, oid`` of every directory."""
    return tree_objects(files, by).select(*by, "dir", "oid")


def signature_text(name: Column, email: Column, epoch: Column, tz_min: Column) -> Column:
    minutes = F.abs(tz_min)
    zone = F.concat(F.when(tz_min < 0, "-").otherwise("+"), F.lpad((F.floor(minutes / 60)).cast("string"), 2, "0"), F.lpad((minutes % 60).cast("string"), 2, "0"))
    return F.concat(name, F.lit(" <"), email, F.lit("> "), epoch.cast("string"), F.lit(" "), zone)


def commit_text(tree: Column, parents: Column, author: Column, committer: Column, message: Column) -> Column:
    """A commit's content from its parts; author and committer are signature texts."""
    lines = F.array_join(F.transform(parents, lambda p: F.concat(F.lit("parent "), p, F.lit("\n"))), "")
    return F.concat(F.lit("tree "), tree, F.lit("\n"), lines, F.lit("author "), author, F.lit("\ncommitter "), committer, F.lit("\n\n"), message)


def exported_messages(system: str, patch: Column, answer: Column) -> Column:
    """A training example as a line of JSON: a system text, a patch as the user's and a message as the assistant's."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(F.struct(F.array(said("system", F.lit(system)), said("user", patch), said("assistant", answer)).alias("messages")))


def benchmark_files(spark, n_files: int = 50_000, n_chars: int = 10_000, seed: int = 42) -> DataFrame:
    """``path, text`` of files that are permutations of the same characters, by hash: the same for a seed on any cluster."""
    alphabet = F.transform(F.sequence(F.lit(0), F.lit(n_chars - 1)), lambda i: F.struct(F.xxhash64(F.lit(seed), F.col("id"), i).alias("k"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz \n"), (i % 28 + 1).cast("int"), F.lit(1)).alias("c")))
    text = F.array_join(F.transform(F.array_sort(alphabet), lambda x: x["c"]), "")
    return spark.range(n_files).select(F.format_string("file_%06d.txt", F.col("id")).alias("path"), text.alias("text"))


def delta_candidates(objects: DataFrame, k: int = 50) -> DataFrame:
    """``oid, base, rank``: for each object up to k bases of its kind and of like size, nearest in size first, ties by id.

    Sizes must be within a factor of 0.1 to 2 and differ by at most half of the larger one. Distinct sizes are ranked
    (within powers of two, the bands before counted), and a size meets only those at most 2 (k + 1) ranks away, each
    with its first k + 1 ids: nearer sizes and smaller ids would take all places before any other.
    """
    top = k + 1
    first = F.row_number().over(Window.partitionBy("kind", "size").orderBy("oid"))
    ids = objects.select("kind", "size", "oid").withColumn("_n", first).filter(F.col("_n") <= top)
    sizes = ids.groupBy("kind", "size").agg(F.collect_list("oid").alias("oids")).withColumn("band", F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int"))
    within = sizes.withColumn("_r", F.row_number().over(Window.partitionBy("kind", "band").orderBy("size")))
    bands = sizes.groupBy("kind", "band").agg(F.count(F.lit(1)).alias("_c"))
    before = bands.select("kind", "band", (F.sum("_c").over(Window.partitionBy("kind").orderBy("band")) - F.col("_c")).alias("_before"))
    ranked = written(within.join(before, ["kind", "band"]).select("kind", "size", "oids", F.floor((F.col("_before") + F.col("_r")) / top).alias("slot")), "sizes")
    near = F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot")
    a = ranked.select("kind", "size", near)
    b = ranked.select("kind", F.col("size").alias("base_size"), "oids", "slot")
    apart = F.abs(F.col("size") - F.col("base_size"))
    fits = (10 * F.col("base_size") >= F.col("size")) & (F.col("base_size") <= 2 * F.col("size")) & (2 * apart <= F.greatest("size", "base_size"))
    pairs = a.join(b, ["kind", "slot"]).filter(fits).select("kind", "size", apart.alias("apart"), F.explode("oids").alias("base"))
    w = Window.partitionBy("kind", "size").orderBy("apart", "base")
    best = pairs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= top).select("kind", "size", "apart", "base")
    mine = Window.partitionBy("oid").orderBy("apart", "base")
    found = objects.select("oid", "kind", "size").join(best, ["kind", "size"]).filter(F.col("oid") != F.col("base"))
    return found.withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= k).select("oid", "base", "rank")
