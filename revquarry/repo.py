"""One object for a repository, from its folder or from tables; every method gives a DataFrame unless it says otherwise."""

from __future__ import annotations

import re
import time
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import objects as O
from .operators import compare, dag, patch, refs, search, snapshot, write
from .session import ship_package, written
from .sources import export, formats, repository

# Files whose presence tells what is going on, in the order they are asked.
OPERATIONS = (
    ("rebase-merge/interactive", "rebase-interactive"),
    ("rebase-merge", "rebase-merge"),
    ("rebase-apply/rebasing", "rebase"),
    ("rebase-apply/applying", "apply-mailbox"),
    ("rebase-apply", "apply-mailbox-or-rebase"),
    ("MERGE_HEAD", "merge"),
    ("REVERT_HEAD", "revert"),
    ("CHERRY_PICK_HEAD", "cherry-pick"),
    ("BISECT_LOG", "bisect"),
)


#: Tags of tags are followed so far.
MOST_TAGS = 20


def _git_dir(spark: SparkSession, path: str) -> str:
    path = str(path).rstrip("/")
    return f"{path}/.git" if repository.exists(spark, f"{path}/.git/HEAD") else path


class NotSupported(Exception):
    pass


def unsupported(config: dict[str, str], present: set[str]) -> list[str]:
    """What a repository uses that can't be read, from its settings and the files it has."""
    found = []
    if any(f.startswith("objects/pack/") and f.endswith(".promisor") for f in present):
        found.append("promisor packs")
    for file, what in (("objects/info/alternates", "alternates"), ("objects/info/http-alternates", "http-alternates"), ("reftable", "reftable")):
        if file in present:
            found.append(what)
    if int(config.get("core.repositoryformatversion", "0")) > 1:
        found.append("repository format version above 1")
    if config.get("extensions.objectformat", "sha1") != "sha1":
        found.append("object formats other than sha1")
    if config.get("extensions.worktreeconfig", "false").lower() == "true":
        found.append("worktree configuration")
    if "extensions.partialclone" in config:
        found.append("partial clones")
    return found


class Repo:
    def __init__(self, spark: SparkSession, objects: DataFrame, references: DataFrame, config: DataFrame | None = None, git_dir: str | None = None, head: str | None = None):
        self.spark, self.objects, self.references, self.config, self.git_dir, self.head = spark, objects, references, config, git_dir, head

    @staticmethod
    def is_valid(spark: SparkSession, path: str) -> bool:
        at = _git_dir(spark, path)
        return all(repository.exists(spark, f"{at}/{x}") for x in ("HEAD", "objects", "refs"))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Repo:
        """A repository's folder (or the working folder around it), wherever Spark can read; objects are decoded once, into the shared folder."""
        if not cls.is_valid(spark, path):
            raise ValueError(f"not a repository: {path}")
        git_dir = _git_dir(spark, path)
        config = repository.configuration(spark, git_dir)
        values = {".".join(filter(None, (r["section"], r["subsection"], r["key"]))): r["value"] for r in refs.config_values(config).collect()}
        present = {f for f in ("objects/info/alternates", "objects/info/http-alternates", "reftable") if repository.exists(spark, f"{git_dir}/{f}")}
        present |= {f"objects/pack/{f}" for f in repository.names(spark, f"{git_dir}/objects/pack")}
        if problems := unsupported(values, present):
            raise NotSupported(("Feature" if len(problems) == 1 else "Features") + " not supported: " + ", ".join(problems))
        head = repository.text_of(spark, f"{git_dir}/HEAD").strip()
        return cls(spark, written(repository.objects(spark, git_dir).sortWithinPartitions("oid"), "objects"), repository.references(spark, git_dir), config, git_dir, head)

    @classmethod
    def from_tables(cls, spark: SparkSession, objects: DataFrame, references: DataFrame, config: DataFrame | None = None, head: str | None = None) -> Repo:
        """``objects``: ``oid, kind, size, data``; ``references``: ``canonical, oid, storage``."""
        return cls(spark, objects, references, config, None, head)

    @property
    def operation(self) -> str:
        """What is under way: a merge, a rebase and so on, or none."""
        return next((name for file, name in OPERATIONS if self.git_dir and repository.exists(self.spark, f"{self.git_dir}/{file}")), "none")

    def head_moved(self, canonical: str) -> str:
        """What HEAD's file holds after moving to a branch; refused while an operation is under way."""
        if self.operation != "none":
            raise ValueError(f"HEAD can't move during a {self.operation}")
        return f"ref: {canonical}\n"

    def _parsed(self, kind: str, parse) -> DataFrame:
        """Objects of a kind, parsed once and written: no later filter can be moved below and meet other objects' bytes."""
        found = self.objects.filter(F.col("kind") == kind).select("oid", parse(F.decode("data", "utf-8")).alias("x"))
        return written(found.select("oid", "x.*"), f"{kind}s")

    @cached_property
    def commits(self) -> DataFrame:
        return self._parsed("commit", O.commit)

    @cached_property
    def tags(self) -> DataFrame:
        return self._parsed("tag", O.tag)

    @cached_property
    def tree_entries(self) -> DataFrame:
        ship_package(self.spark)
        schema = "array<struct<ordinal:int,mode:string,kind:string,name:string,oid:string>>"

        @F.pandas_udf(schema)
        def entries(data: pd.Series) -> pd.Series:
            return data.map(lambda x: formats.tree(bytes(x)))

        found = self.objects.filter("kind = 'tree'").select(F.col("oid").alias("tree_oid"), F.explode(entries("data")).alias("e"))
        return written(found.select("tree_oid", "e.ordinal", "e.mode", "e.kind", "e.name", "e.oid"), "trees")

    @cached_property
    def blobs(self) -> DataFrame:
        text = O.is_text("data")
        return self.objects.filter("kind = 'blob'").select("oid", "size", "data", text.alias("is_text"), F.when(text, F.decode("data", "utf-8")).alias("text"))

    @cached_property
    def edges(self) -> DataFrame:
        return written(dag.edges_of(self.commits), "edges")

    @cached_property
    def commit_times(self) -> DataFrame:
        return self.commits.select("oid", F.coalesce("committer.epoch", "author.epoch").alias("time"))

    @cached_property
    def branches(self) -> DataFrame:
        out = self.references.filter(F.col("canonical").rlike("^refs/(heads|remotes)/")).withColumn("friendly", O.friendly_name("canonical"))
        return (refs.upstreams(out, self.config) if self.config is not None else out).orderBy("canonical")

    def object(self, abbreviated: str) -> DataFrame:
        """Objects whose id starts so (at least 4 digits). More than one is an error."""
        if len(abbreviated) < 4:
            raise ValueError("an abbreviated id needs at least 4 digits")
        low = abbreviated.lower()
        found = self.objects.filter((F.col("oid") >= low) & (F.col("oid") < low + "g"))
        if found.select("oid").distinct().limit(2).count() > 1:
            raise ValueError(f"ambiguous id: {abbreviated}")
        return found

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """``prefix, status, oid, kind, size`` for each of ``wanted`` (``prefix``): found, missing or ambiguous; null ids in the latter two.

        Prefixes need at least 4 digits; shorter ones and those that aren't hexadecimal are missing.
        """
        digits = lambda c: F.left(c, F.lit(4)).alias("_digits")
        asked = wanted.select("prefix").distinct().withColumn("_low", F.lower("prefix"))
        known = self.objects.select("oid", "kind", "size").dropDuplicates(["oid"])
        met = asked.filter(F.length("_low") >= 4).select("prefix", "_low", digits(F.col("_low"))).join(known.withColumn("_digits", F.left("oid", F.lit(4))), "_digits").filter(F.startswith("oid", "_low"))
        one = met.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("oid", "kind", "size")).alias("x"))
        status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("found")
        sole = lambda name: F.when(F.col("n") == 1, F.col(f"x.{name}")).alias(name)
        return asked.select("prefix").join(one, "prefix", "left").select("prefix", status.alias("status"), sole("oid"), sole("kind"), sole("size"))

    def resolve(self, revision: str) -> str:
        """The commit id of a revision: HEAD, a branch or tag, a whole or abbreviated id, and ~n and ^n steps from there."""
        base, steps = dag.parse_revision(revision)
        if base == "HEAD" and self.head:
            base = self.head.removeprefix("ref: ")
        names = self.spark.range(1).select(F.lit(base).alias("name"))
        tagged = self.references.filter(F.col("canonical") == f"refs/tags/{base}").select("oid").first()
        row = refs.resolve_names(names, self.references).first()
        oid = row["oid"] or (tagged and tagged["oid"])
        if not oid:
            found = self.object(base).select("oid").first() if len(base) >= 4 and all(x in "0123456789abcdefABCDEF" for x in base) else None
            if not found:
                raise KeyError(f"unknown revision: {revision}")
            oid = found["oid"]
        oid = self._peeled(oid)
        if not steps:
            return oid
        at = dag.follow(self.edges, self.spark.range(1).select(F.lit(revision).alias("start"), F.lit(oid).alias("oid")), steps).first()
        if not at:
            raise KeyError(f"unknown revision: {revision}")
        return at["oid"]

    def _peeled(self, oid: str) -> str:
        """What a tag leads to, through tags of tags; the id itself if it is no tag's."""
        for _ in range(MOST_TAGS):
            tag = self.tags.filter(F.col("oid") == oid).select("target").first()
            if tag is None:
                return oid
            oid = tag["target"]
        raise ValueError(f"more than {MOST_TAGS} tags in a row")

    def _start(self, revision: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(revision).alias("start"), F.lit(self.resolve(revision)).alias("oid"))

    def log(self, revision: str = "HEAD", first_parent: bool = True, by_time: bool = False, exclude: str | None = None, path: str | None = None, since=None, until=None, prune: bool = False, topological: bool = False) -> DataFrame:
        """``seq, oid`` with the commit's columns, in order. With ``path`` only commits that changed it, renames followed."""
        stops = self._start(exclude).withColumn("start", F.lit(revision)) if exclude else None
        times = self.commit_times if by_time or since is not None or until is not None else None
        walk = dag.log(self.edges, self._start(revision), first_parent=first_parent, times=times, stops=stops, since=since, until=until, prune=prune, topological=topological)
        if path is not None:
            walk = self._path_log(walk, path)
        return walk.join(self.commits, "oid").select("seq", "oid", "tree", "parents", "author", "committer", "message").orderBy("seq")

    def _path_log(self, walk: DataFrame, path: str) -> DataFrame:
        """The walk's commits that changed the path; where it is missing, an exact or similar rename is followed, else the history ends."""
        walk = written(walk, "walk")
        trees = self.commits.select("oid", F.col("tree").alias("root"))
        roots = written(walk.join(trees, "oid").select("root").distinct(), "roots")
        out: DataFrame | None = None
        after = 0
        while True:
            here = walk.filter(F.col("seq") > after).join(trees, "oid").join(snapshot.entry_at(self.tree_entries, roots, path).select("root", F.col("oid").alias("blob")), "root", "left").select("start", "seq", "oid", "blob")
            here = written(here, "segment")
            gap = here.filter("blob is null").agg(F.min("seq")).first()[0]
            part = here.filter("blob is not null" if gap is None else f"blob is not null and seq < {gap}").withColumn("path", F.lit(path))
            found = dag.path_log(part.select("start", "oid", "seq"), part.select("oid", "path", "blob"))
            out = found if out is None else out.unionByName(found)
            if gap is None:
                return out.select("start", "oid", "seq")
            # At the gap the path's content came from another path: the newer commit's file is a rename of an older one.
            newer = walk.filter(F.col("seq") == gap - 1).first() if gap > 1 else None
            older = walk.filter(F.col("seq") == gap).first()
            if newer is None:
                return out.select("start", "oid", "seq")
            changes = self.compare(older["oid"], newer["oid"])
            moved = changes.filter((F.col("type") == "Renamed") & (F.col("new_path") == path)).first()
            if moved is None:
                return out.select("start", "oid", "seq")
            path, after = moved["old_path"], gap - 1

    def merge_base(self, a: str, b: str) -> str | None:
        pair = self.spark.range(1).select(F.lit(0).alias("pair"), F.lit(self.resolve(a)).alias("a"), F.lit(self.resolve(b)).alias("b"))
        row = dag.merge_base(self.edges, pair, self.commit_times).first()
        return row["oid"] if row else None

    def files(self, revision: str = "HEAD", base: str = "") -> DataFrame:
        """``root, path, ordinal, mode, kind, oid`` of a commit's snapshot."""
        tree = self.commits.filter(F.col("oid") == self.resolve(revision)).select(F.col("tree").alias("root"))
        return snapshot.flatten(self.tree_entries, tree, base)

    def compare(self, old: str | None, new: str, percent: int = 90, regular_only: bool = True) -> DataFrame:
        """Changes between two revisions; ``old`` None is the empty snapshot. Only differing subtrees are read."""
        tree = lambda r: self.commits.filter(F.col("oid") == self.resolve(r)).select("tree").first()["tree"]
        roots = self.spark.range(1).select(F.lit(0).alias("pair"), F.lit(tree(old) if old else None).cast("string").alias("old_root"), F.lit(tree(new)).alias("new_root"))
        differ = written(snapshot.diverging(self.tree_entries, roots), "differ").join(self.blobs.select("oid", "size", "text"), "oid", "left")
        side = lambda n: differ.filter(F.col("side") == n).select("path", "oid", "mode", "size", "text")
        return compare.compare(side("old"), side("new"), percent=percent, regular_only=regular_only).orderBy(compare.result_order())

    def patch(self, old: str | None, new: str, unified: int = patch.UNIFIED, member: str | None = None) -> str:
        """The whole patch as text (one commit's worth)."""
        start, end = self.resolve(old) if old else None, self.resolve(new)
        sections = patch.file_sections(self.compare(old, new).withColumn("_g", F.lit(0)), self.blobs, start, end, unified, member, by=("_g",))
        c = self.commits.filter(F.col("oid") == end).select("author.*", "message")
        head = c.select(patch.header(F.col("name"), F.col("email"), F.col("epoch"), F.col("tz_min"), F.col("message"), start).alias("h")).first()["h"]
        body = patch.patches(sections, ("_g",)).first()
        return head + (body["patch"] if body else " 0 file changed\n\n")

    def stash_changes(self, oid: str) -> DataFrame:
        """Staged (head to staged), unstaged (staged to stash) and, if kept, untracked changes of a stash, with ``part``."""
        parents = self.commits.filter(F.col("oid") == oid).select("parents").first()["parents"]
        parts = [("staged", parents[0], parents[1]), ("unstaged", parents[1], oid)]
        if len(parents) > 2:
            parts.append(("untracked", parents[1], parents[2]))
        out = None
        for name, a, b in parts:
            x = self.compare(a, b).withColumn("part", F.lit(name))
            out = x if out is None else out.unionByName(x)
        return out

    @cached_property
    def stashes(self) -> DataFrame:
        """``ordinal, oid, head, staged, untracked, message`` in the file's order."""
        p = F.col("parents")
        return repository.stashes(self.spark, self.git_dir).drop("message").join(self.commits, "oid").select("ordinal", "oid", p[0].alias("head"), p[1].alias("staged"), F.get(p, F.lit(2)).alias("untracked"), "message")

    def search(self, index: DataFrame, condition, revision: str = "HEAD") -> DataFrame:
        listed = self.files(revision).select(F.lit(self.resolve(revision)).alias("commit"), "path", "oid")
        return search.search(index, listed, condition)

    def indexed(self, provider: search.Provider, revision: str = "HEAD", index: DataFrame | None = None, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The index with a revision's files taken in, and the contents seen so far."""
        blobs = self.files(revision).filter("kind <> 'gitlink'").join(self.blobs, "oid").select("oid", "path", "data", "text")
        seen = seen if seen is not None else blobs.select("oid").limit(0)
        if index is None:
            index = provider(blobs).limit(0)
        return search.ensure_index(blobs, seen, index, provider)

    def default_author(self) -> str:
        """The configured user as a signature's text, at the present time."""
        values = {r["property"]: r["value"] for r in refs.properties(self.config).collect()} if self.config is not None else {}
        if not values.get("user.name") or not values.get("user.email"):
            raise ValueError("no author given, and none is configured")
        return f"{values['user.name']} <{values['user.email']}> {int(time.time())} +0000"

    def commit(self, revision: str | None, changes: DataFrame, author: str | None = None, message: str = "", allow_empty: bool = False, update_branch: str | None = None, update_head: bool = False, amend: bool = False) -> tuple[str, DataFrame]:
        """The id of a commit with ``changes`` (``path, op, data, mode, seq``) on top of a revision, and its new objects (``oid, kind, size, data``).

        With ``update_branch`` the objects are written to the repository's folder and the branch moves to the commit,
        with ``update_head`` HEAD too. The author is a signature's text; the configured user is the default.
        """
        if amend:
            raise ValueError("a commit can't be amended; make a new one on its parent")
        if update_head and not update_branch:
            raise ValueError("HEAD can only move to a branch")
        write.require_changes(changes, allow_empty)
        author = author or self.default_author()
        none = self.spark.createDataFrame([], "path string, mode string, oid string")
        before = self.files(revision).select("path", "mode", "oid") if revision else none
        after = written(write.applied(before, changes), "after")
        tree_rows = write.tree_objects(after)
        root = tree_rows.filter("dir = ''").select("oid").first()
        root = root["oid"] if root else write.EMPTY_TREE
        parents = F.array(F.lit(self.resolve(revision))) if revision else F.array().cast("array<string>")
        text = write.commit_text(F.lit(root), parents, F.lit(author), F.lit(author), F.lit(message))
        made = self.spark.range(1).select(text.alias("text")).select(O.object_id("commit", "text").alias("oid"), F.lit("commit").alias("kind"), F.col("text").cast("binary").alias("data"))
        puts = write.last_writes(changes).filter("op = 'put'").select(O.object_id("blob", "data").alias("oid"), F.lit("blob").alias("kind"), F.col("data").cast("binary").alias("data"))
        new = made.unionByName(tree_rows.select("oid", F.lit("tree").alias("kind"), "data")).unionByName(puts)
        new = written(new.dropDuplicates(["oid"]).withColumn("size", F.octet_length("data").cast("long")).select("oid", "kind", "size", "data"), "new")
        oid = made.first()["oid"]
        if update_branch:
            if update_head:
                self.head_moved(f"refs/heads/{update_branch}")  # refused before anything is written
            export.save(new.join(self.objects.select("oid"), "oid", "left_anti"), self.git_dir)
            self.objects = written(self.objects.unionByName(new.join(self.objects.select("oid"), "oid", "left_anti"), allowMissingColumns=True), "objects")
            self.set_branch(update_branch, oid, overwrite=True)
            if update_head:
                self.move_head(f"refs/heads/{update_branch}")
        return oid, new

    def set_branch(self, name: str, oid: str, overwrite: bool = False) -> str:
        """Write a branch's file; an existing branch moves only with ``overwrite``. Gives the full name."""
        canonical = f"refs/heads/{name}"
        if not refs.valid_name(canonical):
            raise ValueError(f"not a name for a branch: {name}")
        if not re.fullmatch("[0-9a-f]{40}", oid):
            raise ValueError(f"not an id: {oid}")
        refs.moved(self.references, canonical, oid, overwrite)
        repository.write_text(self.spark, f"{self.git_dir}/{canonical}", f"{oid}\n")
        self._reread()
        return canonical

    def delete_branch(self, name: str) -> None:
        """Remove a branch's file and its line among the packed references, all else there staying as it is. HEAD's branch stays."""
        canonical = f"refs/heads/{name}"
        if self.head == f"ref: {canonical}":
            raise ValueError(f"HEAD is on {name}")
        if not self.references.filter(F.col("canonical") == canonical).limit(1).count():
            raise KeyError(f"unknown branch: {name}")
        packed = f"{self.git_dir}/packed-refs"
        if repository.exists(self.spark, packed):
            lines = repository.lines(repository.one_file(self.spark, packed)).select("ordinal", "value")
            kept = [r["value"] for r in refs.packed_without(lines, canonical).orderBy("ordinal").collect()]  # one small file
            repository.write_text(self.spark, packed, "\n".join(kept))
        repository.remove(self.spark, f"{self.git_dir}/{canonical}")
        self._reread()

    def move_head(self, canonical: str) -> None:
        """Write HEAD; refused while an operation is under way."""
        text = self.head_moved(canonical)
        repository.write_text(self.spark, f"{self.git_dir}/HEAD", text)
        self.head = text.strip()

    def _reread(self) -> None:
        self.references = repository.references(self.spark, self.git_dir)
        for name in ("branches", "commits", "tags", "tree_entries", "blobs", "edges", "commit_times"):
            self.__dict__.pop(name, None)
