"""Repositories made by git at test time; git's own output is what must come out."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from revquarry.functions import objects as O
from revquarry.operators import search, write
from revquarry.repo import NotSupported, Repo, unsupported
from revquarry.sources import formats, repository

clock = [1_600_000_000]


def git(folder, *args, data=None):
    clock[0] += 60
    when = f"{clock[0]} +0200"
    env = os.environ | {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "C", "GIT_COMMITTER_EMAIL": "c@x", "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}
    return subprocess.run(["git", "-c", "init.defaultBranch=main", "-C", str(folder), *args], check=True, capture_output=True, env=env, input=data).stdout.decode().strip()


def put(folder, path, text):
    at = folder / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(text)


def commit(folder, message, **files):
    for path, text in files.items():
        path = path.replace("__", "/").replace("_", ".")
        if text is None:
            (folder / path).unlink()
        else:
            put(folder, path, text)
    git(folder, "add", "-A")
    git(folder, "commit", "-q", "-m", message)
    return git(folder, "rev-parse", "HEAD")


@pytest.fixture(scope="module")
def merged(tmp_path_factory):
    """Two sides merged, an octopus merge, renames, tags, a stash, packs with deltas and loose objects on top."""
    f = tmp_path_factory.mktemp("merged")
    git(f, "init", "-q")
    long = "\n".join(f"line {i} of a longer text" for i in range(200))
    commit(f, "first", a_txt=long, dir__b_txt="b\n", dir__sub__c_txt="c\n")
    commit(f, "second", a_txt=long + "\nmore")
    git(f, "checkout", "-q", "-b", "side")
    commit(f, "on side", s_txt="s\n")
    git(f, "checkout", "-q", "main")
    commit(f, "on main", m_txt="m\n")
    git(f, "merge", "-q", "--no-ff", "-m", "merge side", "side")
    for k in (1, 2):
        git(f, "checkout", "-q", "-b", f"o{k}", "main")
        commit(f, f"octopus {k}", **{f"o{k}_txt": str(k)})
    git(f, "checkout", "-q", "main")
    git(f, "merge", "-q", "--no-ff", "-m", "octopus", "o1", "o2")
    git(f, "tag", "-a", "v1", "-m", "Release one")
    git(f, "gc", "-q")
    commit(f, "rename", a_txt=None, renamed__a_txt=long + "\nmore\nand more")
    commit(f, "last", dir__b_txt="changed\n")
    put(f, "dir/b.txt", "stashed\n")
    git(f, "stash", "push", "-q", "-m", "kept")
    return f


@pytest.fixture(scope="module")
def repo(spark, merged):
    return Repo.open(spark, str(merged))


def test_objects_hash_to_themselves(repo, merged):
    listed = {x.split()[0]: x.split()[1] for x in git(merged, "cat-file", "--batch-all-objects", "--batch-check").splitlines()}
    raw = F.concat(F.concat("kind", F.lit(" "), F.octet_length("data").cast("string")).cast("binary"), F.unhex(F.lit("00")), "data")
    rows = repo.objects.select("oid", "kind", F.sha1(raw).alias("again"), "storage").collect()
    assert {r.oid: r.kind for r in rows} == listed
    assert all(r.oid == r.again for r in rows)
    assert {r.storage for r in rows} == {"loose", "pack"}


def test_pack_index_agrees_with_the_pack(spark, repo, merged):
    index = {(r.oid, r.offset) for r in repository.pack_index(spark, str(merged / ".git")).collect()}
    packed = {(r.oid, r.offset) for r in repository.packed_objects(spark, str(merged / ".git")).collect()}
    assert index == packed and index


def test_commit_graph(spark, repo, merged):
    git(merged, "commit-graph", "write", "--reachable")
    graph = {r.oid: (r.tree, r.parents, r.commit_time) for r in repository.commit_graph(spark, str(merged / ".git")).collect()}
    want = {r.oid: (r.tree, r.parents, r.committer.epoch) for r in repo.commits.collect()}
    reachable = set(git(merged, "rev-list", "--all").split())
    assert graph.keys() == reachable
    assert all(want[k] == v for k, v in graph.items())
    assert any(len(p) == 3 for _, p, _ in graph.values())


def test_commit_graph_chain(spark, tmp_path):
    git(tmp_path, "init", "-q")
    commit(tmp_path, "one", a_txt="1")
    git(tmp_path, "commit-graph", "write", "--reachable", "--split=no-merge")
    commit(tmp_path, "two", a_txt="2")
    git(tmp_path, "commit-graph", "write", "--reachable", "--split=no-merge")
    rows = {r.oid: r.parents for r in repository.commit_graph(spark, str(tmp_path / ".git")).collect()}
    head, first = git(tmp_path, "rev-list", "HEAD").split()
    assert rows == {head: [first], first: []}


def test_multi_pack_index(spark, tmp_path):
    git(tmp_path, "init", "-q")
    for k in range(3):
        commit(tmp_path, f"c{k}", a_txt=str(k))
        git(tmp_path, "repack", "-q", "-d")
    git(tmp_path, "multi-pack-index", "write")
    commit(tmp_path, "later", a_txt="later")
    git(tmp_path, "repack", "-q", "-d")
    index = repository.pack_index(spark, str(tmp_path / ".git")).collect()
    packed = repository.packed_objects(spark, str(tmp_path / ".git")).collect()
    assert {(r.pack, r.oid, r.offset) for r in index} == {(r.pack, r.oid, r.offset) for r in packed}
    assert len({r.pack for r in index}) == 4


def test_thin_pack_bases_are_found_elsewhere(spark, tmp_path):
    base, target = b"".join(b"line %d\n" % i for i in range(500)), b"".join(b"line %d\n" % i for i in range(501))
    from revquarry.operators.delta import make_delta

    import hashlib
    import struct
    import zlib

    d = make_delta(base, target)
    head = bytearray([7 << 4 | len(d) & 15])
    n = len(d) >> 4
    while n:
        head[-1] |= 128
        head.append(n & 127)
        n >>= 7
    body = struct.pack(">4sII", b"PACK", 2, 1) + bytes(head) + bytes.fromhex(formats.oid_of("blob", base)) + zlib.compress(d)
    folder = tmp_path / "objects"
    oid = formats.oid_of("blob", base)
    (folder / oid[:2]).mkdir(parents=True)
    (folder / oid[:2] / oid[2:]).write_bytes(formats.write_loose("blob", base))
    (folder / "pack").mkdir()
    (folder / "pack" / "pack-x.pack").write_bytes(body + hashlib.sha1(body).digest())
    rows = repository.packed_objects(spark, str(tmp_path)).collect()
    assert [(r.oid, bytes(r.data)) for r in rows] == [(formats.oid_of("blob", target), target)]


def test_files_equal_ls_tree(repo, merged):
    want = sorted((x.split("\t")[1], x.split()[0], x.split()[2]) for x in git(merged, "ls-tree", "-r", "HEAD").splitlines())
    assert sorted((r.path, r.mode, r.oid) for r in repo.files().collect()) == want


def test_logs(repo, merged):
    assert [r.oid for r in repo.log().collect()] == git(merged, "rev-list", "--first-parent", "HEAD").split()
    every = [r.oid for r in repo.log(first_parent=False).collect()]
    assert sorted(every) == sorted(git(merged, "rev-list", "HEAD").split())
    assert [r.oid for r in repo.log(first_parent=False, topological=True).collect()] == every[::-1]
    left = {r.oid for r in repo.log(first_parent=False, exclude="side").collect()}
    assert left == set(git(merged, "rev-list", "HEAD", "^side").split())
    times = {r.oid: r.committer.epoch for r in repo.commits.collect()}
    middle = sorted(times[x] for x in every)[3]
    assert {r.oid for r in repo.log(first_parent=False, since=middle).collect()} == {x for x in every if times[x] >= middle}


def test_time_order_visits_the_older_parent_first(repo, merged):
    side, main = git(merged, "rev-parse", "side"), git(merged, "rev-parse", "o1~1^1")
    got = [r.oid for r in repo.log("o1~1", first_parent=False, by_time=True).collect()]
    times = {r.oid: r.committer.epoch for r in repo.commits.collect()}
    assert got[1:3] == sorted((side, main), key=times.get)


@pytest.mark.parametrize("revision", ["HEAD", "main", "side", "HEAD~1", "HEAD~2^2", "HEAD~2^3", "HEAD^1~1", "v1", "refs/heads/o1", "HEAD^0"])
def test_revisions(repo, merged, revision):
    assert repo.resolve(revision) == git(merged, "rev-parse", revision + "^{commit}")


def test_abbreviated_ids(repo, merged):
    head = git(merged, "rev-parse", "HEAD")
    assert repo.resolve(head[:10]) == head
    with pytest.raises(KeyError):
        repo.resolve("nowhere")
    with pytest.raises(ValueError):
        repo.object("abc")


def test_ambiguous_ids(spark):
    objects = spark.createDataFrame([("0123456789abcdef0123456789abcdef01234567",), ("0123456789abcdef0123456789aaaaaaaaaaaaaa",)], "oid string")
    empty = spark.createDataFrame([], "canonical string, oid string, storage string")
    with pytest.raises(ValueError, match="ambiguous"):
        Repo.from_tables(spark, objects, empty).object("0123456789")


def test_merge_base(repo, merged):
    assert repo.merge_base("side", "main~3^1") == git(merged, "merge-base", "side", "main~3^1")
    assert repo.merge_base("o1", "o2") == git(merged, "merge-base", "o1", "o2")


def test_compare_and_patch(repo, merged):
    got = [(r.type, r.old_path, r.new_path) for r in repo.compare("HEAD~2", "HEAD").collect()]
    assert got == [("Modified", "dir/b.txt", "dir/b.txt"), ("Renamed", "a.txt", "renamed/a.txt")]
    text = repo.patch("HEAD~1", "HEAD")
    assert f"From {git(merged, 'rev-parse', 'HEAD~1')} " in text and "Subject: [PATCH] last\n\n 1 file changed\n\n" in text
    assert text.endswith("-b\n+changed\n")
    root = git(merged, "rev-list", "--max-parents=0", "HEAD")
    assert [(r.type, r.new_path) for r in repo.compare(None, root).collect()] == [("Added", "a.txt"), ("Added", "dir/b.txt"), ("Added", "dir/sub/c.txt")]


def test_path_log_follows_the_rename(repo, merged):
    got = [r.message for r in repo.log(path="renamed/a.txt").collect()]
    assert got == ["last", "octopus", "first"]  # of each run of equal content the newest commit
    oids = [r.oid for r in repo.log(path="dir/b.txt").collect()]
    assert oids[0] == git(merged, "rev-parse", "HEAD") and len(oids) == 2


def test_tags_stashes_branches(repo, merged):
    assert [(r.tag, r.target_type, r.message) for r in repo.tags.collect()] == [("v1", "commit", "Release one")]
    stash = repo.stashes.collect()
    assert [s.oid for s in stash] == [git(merged, "rev-parse", "refs/stash")] and "kept" in stash[0].message
    assert [(r.part, r.type, r.new_path) for r in repo.stash_changes(stash[0].oid).collect()] == [("unstaged", "Modified", "dir/b.txt")]
    from revquarry.plans import apps

    shown = apps.stash_patches(repo, stash[0].oid)
    assert list(shown) == ["unstaged"] and shown["unstaged"].endswith("-changed\n+stashed\n")
    want = git(merged, "for-each-ref", "--format=%(refname) %(objectname)", "refs/heads").split("\n")
    assert [f"{r.canonical} {r.oid}" for r in repo.branches.collect()] == want


@pytest.mark.parametrize("version", ["2", "4"])
def test_staging_index(spark, tmp_path, version):
    git(tmp_path, "init", "-q")
    for k in range(30):
        put(tmp_path, f"some/directory/file{k}.txt", str(k))
    git(tmp_path, "add", "-A")
    git(tmp_path, "update-index", "--index-version", version)
    want = [tuple(x.split("\t")[::-1]) for x in git(tmp_path, "ls-files", "-s").splitlines()]
    got = repository.staging(spark, str(tmp_path / ".git")).orderBy("ordinal").collect()
    assert [(r.path, f"100{oct(r.perms)[2:]} {r.oid} {r.stage}") for r in got] == want
    assert {r.type for r in got} == {"regular"} and got[0].size == 1


def test_commit_gives_the_ids_that_git_gives(spark, repo, merged, tmp_path):
    git(tmp_path, "clone", "-q", str(merged), "copy")
    f = tmp_path / "copy"
    changes = spark.createDataFrame([("a0", "put", bytearray(b"zero\n"), None, 1), ("a/x.txt", "put", bytearray(b"old\n"), None, 2), ("a/x.txt", "put", bytearray(b"x\n"), None, 3), ("a.txt", "put", bytearray(b"t\n"), "100755", 4), ("m.txt", "remove", None, None, 5)], "path string, op string, data binary, mode string, seq int")
    oid, new = repo.commit("HEAD", changes, "A <a@x> 1700000000 +0200", "made")
    for path, text in (("a0", "zero\n"), ("a/x.txt", "x\n"), ("a.txt", "t\n")):
        put(f, path, text)
    (f / "a.txt").chmod(0o755)
    (f / "m.txt").unlink()
    git(f, "add", "-A")
    tree = git(f, "write-tree")
    made = {r.oid: r for r in new.collect()}
    assert tree in made and f"tree {tree}\n".encode() in bytes(made[oid].data)
    pack, index = formats.write_pack([(r.kind, bytes(r.data)) for r in made.values()])
    folder = f / ".git/objects/pack"
    (folder / "pack-made.pack").write_bytes(pack)
    (folder / "pack-made.idx").write_bytes(index)
    assert git(f, "cat-file", "-t", oid) == "commit"
    assert git(f, "rev-parse", f"{oid}^{{tree}}") == tree
    git(f, "fsck", "--strict")
    with pytest.raises(ValueError, match="nothing to commit"):
        repo.commit("HEAD", changes.limit(0), "A <a@x> 1 +0000", "empty")


def test_commits_move_branches_and_head(spark, tmp_path):
    git(tmp_path, "init", "-q", "-b", "main")
    git(tmp_path, "config", "user.name", "Ada")
    git(tmp_path, "config", "user.email", "ada@loom")
    first = commit(tmp_path, "one", a_txt="1")
    git(tmp_path, "branch", "old")
    git(tmp_path, "tag", "-a", "t", "-m", "t")
    git(tmp_path, "pack-refs", "--all")
    repo = Repo.open(spark, str(tmp_path))
    puts = spark.createDataFrame([("dir/b.txt", "put", bytearray(b"two"), None, 1)], "path string, op string, data binary, mode string, seq int")
    second, _ = repo.commit("HEAD", puts, message="two", update_branch="next", update_head=True)
    assert git(tmp_path, "rev-parse", "HEAD", "next") == f"{second}\n{second}" and git(tmp_path, "symbolic-ref", "HEAD") == "refs/heads/next"
    assert git(tmp_path, "log", "--format=%s %an", "-2") .split("\n")[0] == "two Ada" and git(tmp_path, "show", "HEAD:dir/b.txt") == "two"
    git(tmp_path, "fsck", "--strict")
    assert repo.resolve("HEAD~1") == first and [r.path for r in repo.files("next").orderBy("path").collect()] == ["a.txt", "dir/b.txt"]
    # Guards.
    with pytest.raises(ValueError, match="exists already"):
        repo.set_branch("main", second)
    with pytest.raises(ValueError, match="not a name"):
        repo.set_branch("a..b", second)
    with pytest.raises(ValueError, match="amended"):
        repo.commit("HEAD", puts, message="x", amend=True)
    with pytest.raises(ValueError, match="HEAD is on"):
        repo.delete_branch("next")
    # Only in packed-refs: the file keeps its comment, the tag and its peeled id.
    repo.delete_branch("old")
    assert git(tmp_path, "branch", "--format=%(refname:short)").split() == ["main", "next"]
    assert git(tmp_path, "rev-parse", "t^{commit}") == first
    assert "^" in (tmp_path / ".git/packed-refs").read_text() and (tmp_path / ".git/packed-refs").read_text().startswith("#")
    (tmp_path / ".git/MERGE_HEAD").write_text(first)
    with pytest.raises(ValueError, match="during a merge"):
        repo.commit("HEAD", puts, message="x", update_branch="main", update_head=True)
    assert git(tmp_path, "rev-parse", "main") == first


def test_lookup_of_many_ids(spark, repo, merged):
    head = git(merged, "rev-parse", "HEAD")
    got = {r.prefix: (r.status, r.oid, r.kind) for r in repo.lookup(spark.createDataFrame([(head,), (head[:9].upper(),), ("0" * 40,), ("abc",), (None,)], "prefix string")).collect()}
    assert got[head] == got[head[:9].upper()] == ("found", head, "commit")
    assert got["0" * 40] == got["abc"] == got[None] == ("missing", None, None)


def test_written_indexes_and_graphs(spark, tmp_path):
    """git reads what the writers make."""
    git(tmp_path, "init", "-q")
    a = commit(tmp_path, "one", a_txt="1")
    tree = git(tmp_path, "rev-parse", "HEAD^{tree}")
    blob = git(tmp_path, "rev-parse", "HEAD:a.txt")
    (tmp_path / ".git/index").write_bytes(formats.write_staging([("z/long name.txt", 0o100644, blob, 1, 5), ("a.txt", 0o100755, blob, 1, 5)]))
    assert git(tmp_path, "ls-files", "-s") == f"100755 {blob} 0\ta.txt\n100644 {blob} 0\tz/long name.txt"
    oids = [a]
    for k, parents in enumerate([[0], [0], [0], [1, 2], [1, 2, 3, 4]]):
        args = [x for p in parents for x in ("-p", oids[p])]
        oids.append(git(tmp_path, "commit-tree", tree, *args, "-m", f"c{k}"))
    rows = [{"oid": o, "tree": tree, "parents": git(tmp_path, "log", "-1", "--format=%P", o).split(), "commit_time": int(git(tmp_path, "log", "-1", "--format=%ct", o))} for o in oids]
    at = tmp_path / ".git/objects/info/commit-graph"
    at.parent.mkdir(exist_ok=True)
    at.write_bytes(formats.write_commit_graph(rows))
    git(tmp_path, "commit-graph", "verify")
    got = {r["oid"]: r for r in formats.commit_graph(at.read_bytes())}
    assert all(got[r["oid"]]["parents"] == r["parents"] for r in rows) and [got[o]["generation"] for o in oids] == [1, 2, 2, 2, 3, 4]


def test_index_and_search(spark, tmp_path):
    git(tmp_path, "init", "-q")
    commit(tmp_path, "one", **{"A__Pages__x__t_json": '{"$type": "Models.Table", "name": "orders"}', "A__Pages__x__u_json": '{"$type": "Other", "name": "orders"}', "m_vb": "' x\noption strict OFF\n"})
    repo = Repo.open(spark, str(tmp_path))
    provider = search.json_provider(r"/Pages/[^/]+/[^/]+\.json$", {"$['$type']": "Models.Table"}, name="$.name")
    index, seen = repo.indexed(provider)
    assert [r.path for r in repo.search(index, F.col("name") == "orders").collect()] == ["A/Pages/x/t.json"]
    flags, _ = repo.indexed(search.text_provider(r"\.vb$", "Option Strict Off"))
    assert [r.path for r in repo.search(flags, F.lit(True)).collect()] == ["m.vb"]
    words, _ = repo.indexed(search.python_provider(lambda path, data: [{"n": len(data)}] if path.endswith(".vb") else [], "n int"))
    assert [r.n for r in words.collect()] == [22]
    again, seen2 = repo.indexed(provider, index=index, seen=seen)
    assert again.count() == 1 and seen2.distinct().count() == seen.distinct().count()


def test_text_is_no_pattern(spark):
    blobs = spark.createDataFrame([("1", "a.c", "x API_key y"), ("2", "b.c", "apiXkey"), ("3", "c.c", "50% off"), ("4", "d.c", "é" * 600 + "api_key"), ("5", "e.c", None)], "oid string, path string, text string")
    found = lambda text: sorted(r.oid for r in search.text_provider(r"[.]c$", text)(blobs).collect())
    assert (found("api_key"), found("0% O"), found("50_")) == (["1"], ["3"], [])


def test_a_pack_too_large_for_the_reader_leaves_loose_objects_readable(spark, tmp_path):
    git(tmp_path, "init", "-q")
    commit(tmp_path, "one", a_txt="1")
    (tmp_path / ".git/objects/pack/pack-x.pack").write_bytes(b"PACK" + bytes(100_000))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 50_000)
    try:
        assert repository.loose_objects(spark, str(tmp_path / ".git")).count() == 3
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_tags_of_tags(spark, tmp_path):
    git(tmp_path, "init", "-q")
    first = commit(tmp_path, "one", a_txt="1")
    git(tmp_path, "tag", "-a", "inner", "-m", "inner")
    git(tmp_path, "tag", "-a", "outer", "-m", "outer", "inner")
    assert Repo.open(spark, str(tmp_path)).resolve("outer") == first


def test_lfs(spark, tmp_path):
    sha = "1234567890abcdef" * 4
    at = tmp_path / "lfs/objects/12/34" / sha
    at.parent.mkdir(parents=True)
    at.write_bytes(b"LFS object content")
    lfs = repository.lfs_objects(spark, str(tmp_path))
    pointer = f"{O.LFS_PREFIX}\noid sha256:{{}}\nsize 18\n"
    blobs = spark.createDataFrame([("1", pointer.format(sha), bytearray(b"p")), ("2", "plain", bytearray(b"plain"))], "oid string, text string, data binary")
    got = {r.oid: bytes(r.data) for r in repository.resolve_lfs(blobs, lfs).collect()}
    assert got == {"1": b"LFS object content", "2": b"plain"}
    missing = spark.createDataFrame([("1", pointer.format("0" * 64), bytearray(b"p"))], blobs.schema)
    with pytest.raises(Exception, match="git lfs fetch"):
        repository.resolve_lfs(missing, lfs).collect()


def test_detached_head_and_operations(spark, tmp_path):
    git(tmp_path, "init", "-q")
    first = commit(tmp_path, "one", a_txt="1")
    git(tmp_path, "checkout", "-q", "--detach")
    (tmp_path / ".git/MERGE_HEAD").write_text(first)
    repo = Repo.open(spark, str(tmp_path))
    assert repo.resolve("HEAD") == first and repo.operation == "merge"
    assert not Repo.is_valid(spark, str(tmp_path / "nowhere"))
    with pytest.raises(ValueError, match="during a merge"):
        repo.head_moved("refs/heads/main")
    (tmp_path / ".git/MERGE_HEAD").unlink()
    assert repo.head_moved("refs/heads/main") == "ref: refs/heads/main\n"


def test_unsupported_features(spark, tmp_path):
    assert unsupported({}, set()) == []
    assert unsupported({"extensions.objectformat": "sha256", "core.repositoryformatversion": "2"}, {"reftable"}) == ["reftable", "repository format version above 1", "object formats other than sha1"]
    git(tmp_path, "init", "-q")
    (tmp_path / ".git/objects/info/alternates").write_text("/elsewhere")
    with pytest.raises(NotSupported, match="Feature not supported: alternates"):
        Repo.open(spark, str(tmp_path))


def test_loose_objects_are_checked():
    import zlib

    assert formats.loose_object(formats.write_loose("blob", b"foo")) == ("blob", b"foo")
    with pytest.raises(ValueError):
        formats.loose_object(zlib.compress(b"blob 4\0foo"))


def test_tree_literal():
    data = b"100644 file.txt\0" + bytes.fromhex("fee84b5575de791d1ac1edb089a63ab85d504f3c") + b"40000 dir\0" + bytes.fromhex("efe84b5575de791d1ac1edb089a63ab85d504f3c")
    assert [(x["kind"], x["name"], x["oid"][:3]) for x in formats.tree(data)] == [("blob", "file.txt", "fee"), ("tree", "dir", "efe")]


def test_references_and_configuration(spark, tmp_path):
    git(tmp_path, "init", "-q")
    first = commit(tmp_path, "one", a_txt="1")
    git(tmp_path, "branch", "packed")
    git(tmp_path, "tag", "-a", "t", "-m", "t")
    git(tmp_path, "pack-refs", "--all")
    second = commit(tmp_path, "two", a_txt="2")
    git(tmp_path, "remote", "add", "origin", "https://example.com/x")
    git(tmp_path, "config", "branch.main.remote", "origin")
    git(tmp_path, "config", "branch.main.merge", "refs/heads/main")
    git(tmp_path, "update-ref", "refs/remotes/origin/main", first)
    git(tmp_path, "symbolic-ref", "refs/remotes/origin/HEAD", "refs/remotes/origin/main")
    repo = Repo.open(spark, str(tmp_path))
    got = {r.canonical: (r.oid, r.storage) for r in repo.references.filter("canonical not like 'refs/tags/%'").collect()}
    assert got == {"refs/heads/main": (second, "loose"), "refs/heads/packed": (first, "packed"), "refs/remotes/origin/main": (first, "loose"), "refs/remotes/origin/HEAD": (first, "loose")}
    main = repo.branches.filter("friendly = 'main'").first()
    assert (main.remote, main.upstream) == ("origin", "refs/heads/main")
    from revquarry.operators import refs

    assert [tuple(r) for r in refs.remotes(repo.config).collect()] == [("origin", "https://example.com/x", "+refs/heads/*:refs/remotes/origin/*")]
    values = {r.property: r.value for r in refs.properties(repo.config).collect()}
    assert values["core.bare"] == "false" and values["core.commitgraph"] == "true" and values["user.name"] is None
    moved = refs.moved(repo.references, "refs/heads/packed", second, overwrite=True)
    assert moved.filter("canonical = 'refs/heads/packed'").first().oid == second
    with pytest.raises(ValueError, match="exists"):
        refs.moved(repo.references, "refs/heads/packed", second)
    names = spark.createDataFrame([("origin",), ("refs/remotes/origin",), ("other",)], "name string")
    assert sorted((r.name, r.oid) for r in refs.remote_of(names, refs.remotes(repo.config)).collect()) == [("origin", "https://example.com/x"), ("other", None), ("refs/remotes/origin", "https://example.com/x")]
    packed = ["# pack-refs with: peeled", f"{'1' * 40} refs/heads/a", f"{'2' * 40} refs/tags/t", f"^{'3' * 40}", f"{'4' * 40} refs/heads/b"]
    rows = spark.createDataFrame(list(enumerate(packed)), "ordinal int, value string")
    assert [r.value for r in refs.packed_without(rows, "refs/tags/t").orderBy("ordinal").collect()] == [packed[0], packed[1], packed[4]]
    assert refs.packed_without(rows, "refs/heads/a").count() == 4
    heads = spark.createDataFrame([("ref: refs/heads/main\n",), (first,)], "t string").select(refs.head_state(F.col("t")).alias("h")).collect()
    assert [(h.h.kind, h.h.oid) for h in heads] == [("branch", None), ("detached", first)]


def test_change_sets_and_benchmark_files(spark):
    assert write.EMPTY_TREE == formats.oid_of("tree", b"")
    rows = write.benchmark_files(spark, 3, 100).collect()
    assert [len(r.text) for r in rows] == [100] * 3 and len({r.text for r in rows}) == 3


def test_packs_with_deltas(tmp_path):
    text = b"".join(b"line %d of some text\n" % i for i in range(300))
    objects = [("blob", text + b"end %d\n" % k) for k in range(30)] + [("blob", b""), ("tree", b"")]
    raw, index = formats.write_pack(objects, deltas=True)
    assert {(x["kind"], x["data"]) for x in formats.pack(raw)} == set(objects)
    assert len(raw) < len(formats.write_pack(objects)[0]) / 4
    assert [formats.chain_depth(n) for n in (0, 1, 10, 100)] == [1, 1, 10, 50]
    git(tmp_path, "init", "-q")
    (tmp_path / ".git/objects/pack/pack-x.pack").write_bytes(raw)
    (tmp_path / ".git/objects/pack/pack-x.idx").write_bytes(index)
    git(tmp_path, "verify-pack", str(tmp_path / ".git/objects/pack/pack-x.idx"))


def test_exports(spark, repo, tmp_path):
    import zipfile

    from revquarry.plans import apps
    from revquarry.sources import export

    for way in ("loose", "packs"):
        git(tmp_path, "init", "-q", "--bare", way)
        getattr(export, way)(repo.objects, f"file://{tmp_path}/{way}")
        git(tmp_path / way, "fsck", "--strict", "--no-dangling")
        assert len(git(tmp_path / way, "cat-file", "--batch-all-objects", "--batch-check").splitlines()) == repo.objects.count()
    assert export.loose(repo.objects, f"file://{tmp_path}/loose") == 0
    assert export.zips(apps.archive(repo), f"file://{tmp_path}/zips") == 1
    (made,) = (tmp_path / "zips").glob("*.zip")
    with zipfile.ZipFile(made) as z:
        assert sorted(z.namelist()) == sorted(r.path for r in repo.files().collect()) and z.read("dir/b.txt") == b"changed\n"


def test_applications(repo):
    import json

    from revquarry.plans import apps

    assert [r.preview for r in apps.log_history(repo).collect()][:2] == ["last", "rename"]
    assert apps.path_history(repo, "dir/b.txt").count() == 2
    assert [r.text for r in apps.last_changes(repo).collect()] == ["Modified: dir/b.txt -> dir/b.txt"]
    assert {r.path: r.size for r in apps.content_sizes(repo).collect()}["dir/b.txt"] == 8
    assert apps.staged(repo).count() > 0
    lines, counts = apps.training_data(repo, system="Say why.")
    got = [json.loads(r.line)["messages"] for r in lines.collect()]
    assert {m[2]["content"]: m[1]["content"] for m in got}["last"].endswith("-b\n+changed\n")
    assert {r.outcome: r.n for r in counts.collect()}.get("excluded") == 1
