"""Directory snapshots: from tree entries to files, and lookups in them.

``tree_entries``: ``tree_oid, ordinal, mode, kind, name, oid``. Files: ``root, path, ordinal, mode, kind, oid``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import objects as O
from ..session import written

FILE_KINDS = ("blob", "executable", "symlink", "gitlink")


def flatten(tree_entries: DataFrame, roots: DataFrame, base: str = "", prune: DataFrame | None = None) -> DataFrame:
    """All files under each tree in ``roots`` (``root``): one join per directory level, shared subtrees read once per use.

    ``base`` goes before every path. ``prune`` (``root, path, oid``) leaves out equal subtrees, so that two snapshots
    can be compared without reading what they share. Links into other repositories are rows of kind gitlink and not
    followed. ``ordinal`` is the entry's place in its directory; order by ``O.chunks(path)`` for traversal order.
    """
    start = f"{base}/" if base else ""
    level = roots.select("root", F.col("root").alias("tree_oid"), F.lit(start).alias("prefix"))
    files: DataFrame | None = None
    while True:
        entries = level.join(tree_entries, "tree_oid").select("root", F.concat("prefix", "name").alias("path"), "ordinal", "mode", "kind", "oid")
        if prune is not None:
            entries = entries.join(prune.select("root", "path", "oid"), ["root", "path", "oid"], "left_anti")
        entries = written(entries, "level")
        here = entries.filter(F.col("kind") != "tree")
        files = here if files is None else files.unionByName(here)
        trees = entries.filter(F.col("kind") == "tree")
        if not trees.limit(1).count():
            return files
        level = trees.select("root", F.col("oid").alias("tree_oid"), F.concat("path", F.lit("/")).alias("prefix"))


def diverging(tree_entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pair, side, path, mode, kind, oid`` of files that differ between two trees, reading only subtrees that differ.

    ``pairs``: ``pair, old_root, new_root``; a null root is an empty tree. On each level equal entries cancel out by
    an anti-join before anything below them is read.
    """
    side = lambda n: pairs.select("pair", F.lit(n).alias("side"), F.col(f"{n}_root").alias("tree_oid"), F.lit("").alias("prefix")).filter("tree_oid is not null")
    level = side("old").unionByName(side("new"))
    found: DataFrame | None = None
    while True:
        entries = level.join(tree_entries, "tree_oid").select("pair", "side", F.concat("prefix", "name").alias("path"), "mode", "kind", "oid")
        entries = written(entries, "level")
        same = entries.groupBy("pair", "path", "mode", "oid").agg(F.count_distinct("side").alias("k")).filter("k = 2")
        differ = entries.join(same, ["pair", "path", "mode", "oid"], "left_anti")
        here = differ.filter(F.col("kind") != "tree")
        found = here if found is None else found.unionByName(here)
        trees = differ.filter(F.col("kind") == "tree")
        if not trees.limit(1).count():
            return found
        level = trees.select("pair", "side", F.col("oid").alias("tree_oid"), F.concat("path", F.lit("/")).alias("prefix"))


def entry_at(tree_entries: DataFrame, roots: DataFrame, path: str) -> DataFrame:
    """``root, mode, kind, oid`` of the entry at one path in each tree of ``roots`` that has it: one join per part of the path."""
    at = roots.select("root", F.col("root").alias("oid"), F.lit(None).cast("string").alias("mode"), F.lit("tree").alias("kind"))
    for part in filter(None, path.split("/")):
        below = tree_entries.filter(F.col("name") == part).select(F.col("tree_oid").alias("_tree"), "mode", "kind", "oid")
        at = at.select("root", F.col("oid").alias("_tree")).join(below, "_tree").drop("_tree")
    return at


def at_path(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (``root, path``) with the entry's mode, kind and oid; nulls where there is none."""
    return wanted.join(files.select("root", "path", "mode", "kind", "oid"), ["root", "path"], "left")


def path_of(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first path, in traversal order, that each ``root, oid`` has; no row where it has none."""
    first = F.min_by("path", O.chunks("path"))
    return files.join(wanted.select("root", "oid").distinct(), ["root", "oid"]).groupBy("root", "oid").agg(first.alias("path"))


def archive(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """``root, path, mode, size, data`` of every file: what an archive of the snapshot holds."""
    return files.filter(F.col("kind").isin("blob", "executable", "symlink")).join(blobs.select("oid", "size", "data"), "oid").select("root", "path", "mode", "size", "data")


def content_sizes(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """``root, path, size`` in bytes of every file's content."""
    return files.join(blobs.select("oid", "size"), "oid").select("root", "path", "size")
