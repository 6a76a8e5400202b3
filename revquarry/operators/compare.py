"""Snapshot comparison: what was added, removed, modified or renamed between two listings of files.

A listing has ``path, oid, mode, size, text`` (size and text only for similarity) and may carry ``repo`` columns to
compare many pairs at once; here the key columns are passed as ``by``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import objects as O
from ..session import discard, rows_in, written

CHANGE = ["type", "old_path", "new_path", "old_oid", "new_oid", "old_mode", "new_mode"]


def regular(files: DataFrame, regular_only: bool = True) -> DataFrame:
    """Only plain files take part unless all kinds are asked for; then links and executables do as well."""
    return files.filter(F.col("mode") == "100644") if regular_only else files


def missing_ids(first: DataFrame, second: DataFrame, by: Sequence[str] = (), dedupe_ids: bool = False) -> DataFrame:
    """Rows of ``first`` whose content ``second`` doesn't have; one row per content if ``dedupe_ids``."""
    out = first.join(second.select(*by, "oid").distinct(), [*by, "oid"], "left_anti")
    if dedupe_ids:
        w = Window.partitionBy(*by, "oid").orderBy(O.chunks("path"))
        out = out.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    return out


def classify(old: DataFrame, new: DataFrame, by: Sequence[str] = (), dedupe_ids: bool = False) -> DataFrame:
    """Added, Removed and Modified by path, among contents that the other side lacks."""
    side = lambda x, n: x.select(*by, "path", F.col("oid").alias(f"{n}_oid"), F.col("mode").alias(f"{n}_mode"))
    a, b = side(missing_ids(old, new, by, dedupe_ids), "old"), side(missing_ids(new, old, by, dedupe_ids), "new")
    kind = F.when(F.col("old_oid").isNull(), "Added").when(F.col("new_oid").isNull(), "Removed").otherwise("Modified")
    joined = a.join(b, [*by, "path"], "full_outer")
    return joined.select(*by, kind.alias("type"), F.when(F.col("old_oid").isNotNull(), F.col("path")).alias("old_path"), F.when(F.col("new_oid").isNotNull(), F.col("path")).alias("new_path"), "old_oid", "new_oid", "old_mode", "new_mode")


def exact_renames(old: DataFrame, new: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Equal content under other paths: the k-th old path with the k-th new one; what is left over is Added or Removed.

    Contents that only one side has are :func:`classify`'s.
    """
    key = [*by, "oid", "path"]
    both = old.select(*by, "oid").distinct().join(new.select(*by, "oid").distinct(), [*by, "oid"])
    rank = F.row_number().over(Window.partitionBy(*by, "oid").orderBy(O.chunks("path")))

    def side(x: DataFrame, other: DataFrame, n: str) -> DataFrame:
        moved = x.join(other.select(*key), key, "left_anti").join(both, [*by, "oid"], "left_semi")
        return moved.select(*by, "oid", rank.alias("k"), F.col("path").alias(f"{n}_path"), F.col("mode").alias(f"{n}_mode"))

    a, b = side(old, new, "old"), side(new, old, "new")
    # A content needs a moved path on both sides, else nothing was renamed.
    paired = [*by, "oid"]
    a, b = a.join(b.select(*paired).distinct(), paired, "left_semi"), b.join(a.select(*paired).distinct(), paired, "left_semi")
    kind = F.when(F.col("old_path").isNull(), "Added").when(F.col("new_path").isNull(), "Removed").otherwise("Renamed")
    return a.join(b, [*paired, "k"], "full_outer").select(*by, kind.alias("type"), "old_path", "new_path", F.when(F.col("old_path").isNotNull(), F.col("oid")).alias("old_oid"), F.when(F.col("new_path").isNotNull(), F.col("oid")).alias("new_oid"), "old_mode", "new_mode")


def line_similarity(removed: DataFrame, added: DataFrame, by: Sequence[str] = (), percent: int = 90) -> DataFrame:
    """Pairs of removed and added files whose line sets have a Dice coefficient of at least ``percent`` hundredths.

    Both have ``path, size, text``. Sizes must be alike to the same degree, and both must be text. Pairs come from
    common lines among each file's rarest ones: with n lines and t the threshold, the overlap is at least t/(2-t) n,
    so one of the first n - ceil(t/(2-t) n) + 1 in rarity is shared. So common lines such as blanks join few files.
    """
    lines = lambda x: x.filter(O.is_text("text")).withColumn("lines", O.line_set("text")).withColumn("n", F.size("lines")).filter("n > 0").select(*by, "path", "size", "n", "lines")
    a, b = written(lines(removed), "removed"), written(lines(added), "added")
    each = lambda x: x.select(*by, "path", "size", "n", F.explode("lines").alias("line"))
    rarity = each(a).select(*by, "line").unionByName(each(b).select(*by, "line")).groupBy(*by, "line").agg(F.count(F.lit(1)).alias("common"))
    least = F.ceil(F.col("n") * percent / F.lit(200.0 - percent))

    def prefix(x: DataFrame) -> DataFrame:
        ranked = each(x).join(rarity, [*by, "line"])
        w = Window.partitionBy(*by, "path").orderBy("common", "line")
        return ranked.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= F.col("n") - least + 1)

    p = prefix(a).select(*by, "line", F.col("path").alias("old_path"), F.col("size").alias("old_size"))
    q = prefix(b).select(*by, "line", F.col("path").alias("new_path"), F.col("size").alias("new_size"))
    alike = 100 * F.abs(F.col("old_size") - F.col("new_size")) <= (100 - percent) * F.greatest("old_size", "new_size")
    pairs = p.join(q, [*by, "line"]).filter(alike).select(*by, "old_path", "new_path").distinct()
    sets = lambda x, n: x.select(*by, F.col("path").alias(f"{n}_path"), F.col("lines").alias(f"{n}_lines"))
    met = pairs.join(sets(a, "old"), [*by, "old_path"]).join(sets(b, "new"), [*by, "new_path"])
    shared, total = F.size(F.array_intersect("old_lines", "new_lines")), F.size("old_lines") + F.size("new_lines")
    return met.select(*by, "old_path", "new_path", shared.alias("common_lines"), total.alias("total_lines")).filter(200 * F.col("common_lines") >= percent * F.col("total_lines"))


def first_match(candidates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Greedy pairing: every removed path, in order, takes the first added path still free.

    A pair in which each is the other's first can be taken at once, in whatever order; so rounds of such pairs give
    the sequential result without a sequential pass.
    """
    left = written(candidates.select(*by, "old_path", "new_path"), "candidates")
    taken: DataFrame | None = None
    while rows_in(left):
        first = lambda mine, other: F.row_number().over(Window.partitionBy(*by, mine).orderBy(O.chunks(other)))
        now = written(left.withColumn("x", first("old_path", "new_path")).withColumn("y", first("new_path", "old_path")).filter("x = 1 and y = 1").select(*by, "old_path", "new_path"), "taken")
        taken = now if taken is None else taken.unionByName(now)
        after = written(left.join(now.select(*by, "old_path"), [*by, "old_path"], "left_anti").join(now.select(*by, "new_path"), [*by, "new_path"], "left_anti"), "candidates")
        discard(left)
        left = after
    return left if taken is None else taken


def compare(old: DataFrame, new: DataFrame, by: Sequence[str] = (), percent: int = 90, regular_only: bool = True, dedupe_ids: bool = False) -> DataFrame:
    """All changes between two listings, renames included; an empty listing stands for no snapshot.

    Columns: ``type, old_path, new_path, old_oid, new_oid, old_mode, new_mode``. Order by :func:`result_order`.
    """
    old, new = regular(old, regular_only), regular(new, regular_only)
    keep = [*by, "path", "oid", "mode"]
    changes = classify(old.select(*keep), new.select(*keep), by, dedupe_ids).unionByName(exact_renames(old.select(*keep), new.select(*keep), by))
    changes = written(changes, "changes")
    pick = lambda x, side, kind: x.join(changes.filter(F.col("type") == kind).select(*by, F.col(f"{side}_path").alias("path")), [*by, "path"], "left_semi").select(*by, "path", "size", "text")
    pairs = first_match(line_similarity(pick(old, "old", "Removed"), pick(new, "new", "Added"), by, percent), by)
    removed = changes.filter("type = 'Removed'").select(*by, "old_path", "old_oid", "old_mode").join(pairs, [*by, "old_path"])
    renamed = removed.join(changes.filter("type = 'Added'").select(*by, "new_path", "new_oid", "new_mode"), [*by, "new_path"])
    gone = pairs.select(*by, F.col("old_path").alias("path"), F.lit("Removed").alias("type")).unionByName(pairs.select(*by, F.col("new_path").alias("path"), F.lit("Added").alias("type")))
    rest = changes.withColumn("path", F.coalesce("new_path", "old_path")).join(gone, [*by, "path", "type"], "left_anti")
    return rest.select(*by, *CHANGE).unionByName(renamed.withColumn("type", F.lit("Renamed")).select(*by, *CHANGE))


def result_order():
    """Directory-wise order by the new path, or the old one where there is none."""
    return O.chunks(F.coalesce("new_path", "old_path"))


def diffstat(changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``diffstat`` per group: counts of files changed, added and removed in words."""
    n = lambda *kinds: F.count_if(F.col("type").isin(*kinds))
    counts = changes.groupBy(*by).agg(n("Modified", "Renamed").alias("changed"), n("Added").alias("added"), n("Removed").alias("removed"))
    word = lambda k, one, many: F.concat(F.col(k).cast("string"), F.lit(" "), F.when(F.col(k) > 1, many).otherwise(one))
    changed = F.when((F.col("changed") > 0) | ((F.col("added") == 0) & (F.col("removed") == 0)), F.concat(word("changed", "file", "files"), F.lit(" changed")))
    text = F.concat_ws(", ", changed, F.when(F.col("added") > 0, word("added", "insertion(+)", "insertions(+)")), F.when(F.col("removed") > 0, word("removed", "deletion(-)", "deletions(-)")))
    return counts.select(*by, "changed", "added", "removed", F.concat(F.lit(" "), text, F.lit("\n\n")).alias("diffstat"))
