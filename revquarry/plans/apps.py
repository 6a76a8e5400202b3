"""Whole applications over a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import objects as O
from ..operators import compare, dag, patch, snapshot, write
from ..repo import Repo
from ..session import written
from ..sources import repository


def log_history(repo: Repo, revision: str = "HEAD", months: int | None = 6) -> DataFrame:
    """``oid, time, preview`` along first parents, of the last months before the newest commit."""
    log = repo.log(revision).select("seq", "oid", F.timestamp_seconds("committer.epoch").alias("time"), O.preview("message").alias("preview"))
    if months is not None:
        newest = log.agg(F.max("time")).first()[0]
        log = log.filter(F.col("time") >= F.add_months(F.lit(newest), -months))
    return log.orderBy("seq").drop("seq")


def path_history(repo: Repo, path: str, revision: str = "HEAD") -> DataFrame:
    """``oid, time, preview`` of the commits that changed a path."""
    return repo.log(revision, path=path).select("oid", F.timestamp_seconds("committer.epoch").alias("time"), O.preview("message").alias("preview"))


def last_changes(repo: Repo, old: str = "HEAD~1", new: str = "HEAD") -> DataFrame:
    return repo.compare(old, new).select(O.change_text("type", "old_path", "new_path").alias("text"))


def content_sizes(repo: Repo, revision: str = "HEAD") -> DataFrame:
    """``path, size`` of every file of a commit."""
    return snapshot.content_sizes(repo.files(revision), repo.blobs).select("path", "size").orderBy(O.chunks("path"))


def staged(repo: Repo) -> DataFrame:
    return repository.staging(repo.spark, repo.git_dir).orderBy("ordinal")


def staged_objects(repo: Repo) -> DataFrame:
    """Staging entries with the contents that they name; null contents where an object isn't there."""
    return staged(repo).join(repo.objects.select("oid", "kind", F.col("size").alias("stored"), "data"), "oid", "left")


def archive(repo: Repo, revision: str = "HEAD") -> DataFrame:
    """``root, path, mode, size, data`` of a commit's files; :func:`export.zips` writes it."""
    return snapshot.archive(repo.files(revision), repo.blobs)


# Messages that the training export leaves out, and what begins a member in the sources it is made for.
EXCLUDED, MEMBER, CONTEXT, MONTHS = r"(?i)(fix:|\[BUG\]|Merge)", r"^\s*\b(public|private|protected|internal)\s+", 20, 12


def training_data(repo: Repo, revision: str = "HEAD", system: str = "", exclude: str = EXCLUDED, below: str = "", unified: int = CONTEXT, member: str | None = MEMBER, months: int | None = MONTHS) -> tuple[DataFrame, DataFrame]:
    """Lines of JSON, a patch and its message each, for the commits of a first-parent log; and counts by outcome.

    The log's commits of the last ``months`` before the newest take part. Messages that match ``exclude`` are left out,
    then commits without a changed text file below the path; a commit whose tree, or whose parent, isn't there is an
    error. All commits are compared with their first parents at once.
    """
    log = repo.log(revision).select("oid", "message", "committer.epoch", F.try_element_at("parents", F.lit(1)).alias("parent"))
    if months is not None:
        newest = log.agg(F.max("epoch")).first()[0]
        log = log.filter(F.timestamp_seconds("epoch") >= F.add_months(F.timestamp_seconds(F.lit(newest or 0)), -months))
    here = repo.commits.join(repo.objects.filter("kind = 'tree'").select(F.col("oid").alias("tree")), "tree", "left_semi").select("oid")
    sound = lambda name: log.join(here.withColumnRenamed("oid", name), name, "left_semi").select("oid")
    whole = sound("oid").join(sound("parent").unionByName(log.filter("parent is null").select("oid")), "oid", "left_semi").withColumn("sound", F.lit(True))
    log = log.join(whole, "oid", "left")
    log = written(log.select("oid", "message", "parent", F.col("message").rlike(exclude).alias("excluded"), F.coalesce("sound", F.lit(False)).alias("sound")), "log")
    trees = repo.commits.select("oid", "tree")
    pairs = log.filter(~F.col("excluded") & F.col("sound")).join(trees.select("oid", F.col("tree").alias("new_root")), "oid").join(trees.select(F.col("oid").alias("parent"), F.col("tree").alias("old_root")), "parent", "left")
    differ = written(snapshot.diverging(repo.tree_entries, pairs.select(F.col("oid").alias("pair"), "old_root", "new_root")), "differ").join(repo.blobs.select("oid", "size", "text"), "oid", "left")
    side = lambda n: differ.filter(F.col("side") == n).select("pair", "path", "oid", "mode", "size", "text")
    changes = compare.compare(side("old"), side("new"), by=("pair",)).filter(O.contains_path(F.lit(below), F.coalesce("new_path", "old_path")))
    changes = written(changes, "changes")
    text = lambda c: repo.blobs.select(F.col("oid").alias(f"{c}_oid"), F.col("text").alias(f"{c}_text"))
    hunks = patch.with_hunks(changes.join(text("old"), "old_oid", "left").join(text("new"), "new_oid", "left"), unified, member)
    name = lambda mark, p: F.concat(F.lit(mark), F.coalesce(p, F.lit("dev/null")), F.lit("\n"))
    sections = hunks.select("pair", *compare.CHANGE, F.concat(name("--- a/", F.col("old_path")), name("+++ b/", F.col("new_path")), F.array_join("hunks", "")).alias("section"))
    done = patch.patches(sections, ("pair",)).withColumnRenamed("pair", "oid")
    lines = log.join(done, "oid").select("oid", write.exported_messages(system, F.col("patch"), F.col("message")).alias("line"))
    outcome = F.when(F.col("excluded"), "excluded").when(~F.col("sound"), "error").when(F.col("patch").isNull(), "no file").otherwise("added")
    return lines, log.join(done, "oid", "left").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def ancestors(repo: Repo, revision: str) -> DataFrame:
    return dag.ancestors(repo.edges, repo._start(revision)).select("oid")


def stash_patches(repo: Repo, oid: str, unified: int = patch.UNIFIED) -> dict[str, str]:
    """The patch of each part of a stash."""
    changes = written(repo.stash_changes(oid), "stash")
    sections = patch.file_sections(changes, repo.blobs, None, oid, unified, by=("part",))
    return {r["part"]: r["patch"] for r in patch.patches(sections, ("part",)).collect()}
