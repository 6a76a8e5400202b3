import random

from pyspark.sql import functions as F

from revquarry.functions import objects as O
from revquarry.operators import compare, snapshot


def listing(spark, files, mode="100644"):
    rows = [(p, t, m) for p, t, m in ((*x, mode)[:3] for x in files)]
    return spark.createDataFrame(rows, "path string, text string, mode string").withColumn("oid", O.object_id("blob", "text")).withColumn("size", F.octet_length("text").cast("long"))


def changes(spark, old, new, **options):
    found = compare.compare(listing(spark, old), listing(spark, new), **options).orderBy(compare.result_order()).collect()
    return [(r.type, r.old_path, r.new_path) for r in found]


def test_one_change_each(spark):
    f = "folder/blob.txt"
    assert changes(spark, [(f, "old")], [(f, "new")]) == [("Modified", f, f)]
    assert changes(spark, [(f, "old")], []) == [("Removed", f, None)]
    assert changes(spark, [], [(f, "new")]) == [("Added", None, f)]
    assert changes(spark, [(f, "x")], [(f, "x")]) == []


def test_similar_renames(spark):
    text = lambda n: "\n".join(map(str, range(n)))
    assert changes(spark, [("blob.txt", text(100))], [("renamed.txt", text(105))]) == [("Renamed", "blob.txt", "renamed.txt")]
    assert changes(spark, [("blob.txt", "0" * 100)], [("renamed.txt", "0" * 150)]) == [("Removed", "blob.txt", None), ("Added", None, "renamed.txt")]


def test_exact_renames_pair_in_order(spark):
    assert changes(spark, [("a", "x"), ("b", "x")], [("c", "x")]) == [("Removed", "b", None), ("Renamed", "a", "c")]
    assert changes(spark, [("a", "x")], [("a", "x"), ("b", "x")]) == []  # a copy of something that stays is no change of its content


def test_only_plain_files_unless_asked(spark):
    old, new = [("run", "x", "100644")], [("run", "x", "100755")]
    assert changes(spark, old, new) == [("Removed", "run", None)]
    link = [("l", "target", "120000")]
    assert changes(spark, [], link) == []
    assert changes(spark, [], link, regular_only=False) == [("Added", None, "l")]


def test_greedy_matching_equals_the_sequential_rule(spark):
    rng = random.Random(7)
    pairs = sorted({(f"r{rng.randrange(12):02d}", f"a{rng.randrange(12):02d}") for _ in range(60)})
    taken, want = set(), []
    for r in sorted({p[0] for p in pairs}):
        for a in sorted(x for q, x in pairs if q == r):
            if a not in taken:
                taken.add(a)
                want.append((r, a))
                break
    got = compare.first_match(spark.createDataFrame(pairs, "old_path string, new_path string")).collect()
    assert sorted(map(tuple, got)) == want


def test_pruned_divergence_equals_flat_difference(spark):
    entries = spark.createDataFrame(
        [("o", 0, "40000", "tree", "same", "s"), ("o", 1, "40000", "tree", "d", "d1"), ("n", 0, "40000", "tree", "same", "s"), ("n", 1, "40000", "tree", "d", "d2"), ("s", 0, "100644", "blob", "f", "f0"), ("d1", 0, "100644", "blob", "x", "x1"), ("d2", 0, "100644", "blob", "x", "x2"), ("d2", 1, "160000", "gitlink", "sub", "c0")],
        "tree_oid string, ordinal int, mode string, kind string, name string, oid string",
    )
    pairs = spark.createDataFrame([(1, "o", "n"), (2, None, "n")], "pair int, old_root string, new_root string")
    found = sorted((r.pair, r.side, r.path, r.kind) for r in snapshot.diverging(entries, pairs).collect())
    assert found == [(1, "new", "d/sub", "gitlink"), (1, "new", "d/x", "blob"), (1, "old", "d/x", "blob"), (2, "new", "d/sub", "gitlink"), (2, "new", "d/x", "blob"), (2, "new", "same/f", "blob")]
    flat = snapshot.flatten(entries, spark.createDataFrame([("n",)], "root string")).orderBy(O.chunks("path")).collect()
    assert [(r.path, r.kind) for r in flat] == [("d/sub", "gitlink"), ("d/x", "blob"), ("same/f", "blob")]
