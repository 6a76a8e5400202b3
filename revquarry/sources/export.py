"""Objects and snapshots written out as files: loose objects, packs, archives, lines of JSON. Folders must be shared."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dag
from ..session import discard, discard_folder, new_folder, rows_in, seen_in, ship_package, written
from . import formats, repository

#: Up to so many new objects are written loose, more as packs; a larger content is always loose.
LOOSE_UP_TO, LARGEST_PACKED = 100, 512 * 1024 * 1024


def _put(store, path: str, raw: bytes) -> None:
    """All or nothing: written beside its place, then moved there. A repeated attempt, which writes the same, leaves an earlier one's file."""
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.part-{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(part) as f:
        f.write(raw)
    if store.get_file_info(path).type == pyarrow.fs.FileType.File:
        store.delete_file(part)
    else:
        store.move(part, path)


def _from(git_dir: str):
    """A folder's file system and the path in it; a plain path is a local or mounted folder."""
    return pyarrow.fs.FileSystem.from_uri(git_dir if "://" in git_dir or git_dir.startswith("file:") else f"file://{git_dir}")


def loose(objects: DataFrame, git_dir: str) -> int:
    """Write ``oid, kind, data`` as loose objects; gives how many. Objects that are there already are left alone."""
    ship_package(objects.sparkSession)

    def run(batches):
        store, root = _from(git_dir)
        for batch in batches:
            n = 0
            for oid, kind, data in zip(batch["oid"], batch["kind"], batch["data"], strict=True):
                path = f"{root}/objects/{oid[:2]}/{oid[2:]}"
                if store.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
                    _put(store, path, formats.write_loose(kind, bytes(data)))
                    n += 1
            yield pd.DataFrame({"n": [n]})

    return objects.select("oid", "kind", "data").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def packs(objects: DataFrame, git_dir: str, n_packs: int = 1, deltas: bool = True) -> list[str]:
    """Write ``oid, kind, data`` as packs, a task each, dealt by content; gives the packs' names."""
    ship_package(objects.sparkSession)

    def run(batches):
        store, root = _from(git_dir)
        mine = [(kind, bytes(data)) for batch in batches for kind, data in zip(batch["kind"], batch["data"], strict=True)]
        if mine:
            pack, index = formats.write_pack(mine, deltas)
            name = f"pack-{pack[-20:].hex()}"
            _put(store, f"{root}/objects/pack/{name}.pack", pack)
            _put(store, f"{root}/objects/pack/{name}.idx", index)
            yield pd.DataFrame({"name": [name]})

    dealt = objects.select("oid", "kind", "data").repartitionById(n_packs, F.pmod(F.xxhash64("oid"), F.lit(n_packs)).cast("int")).sortWithinPartitions("oid")
    return sorted(r["name"] for r in dealt.mapInPandas(run, "name string").collect())


def save(objects: DataFrame, git_dir: str, object_bytes: int = 1 << 30) -> None:
    """Few objects loose, many in packs of about ``object_bytes``; very large contents are loose in any case."""
    n, size = objects.agg(F.count(F.lit(1)), F.sum("size")).first()
    if n < LOOSE_UP_TO:
        loose(objects, git_dir)
        return
    loose(objects.filter(F.col("size") > LARGEST_PACKED), git_dir)
    packs(objects.filter(F.col("size") <= LARGEST_PACKED), git_dir, max(1, -(-size // object_bytes)))


def zips(archive: DataFrame, folder: str) -> int:
    """One ``<root>.zip`` a snapshot of ``root, path, mode, data``, each made by one task as its rows come in path order; gives how many."""
    ship_package(archive.sparkSession)

    def run(batches):
        store, at = _from(folder)
        root, out, made = None, None, 0

        def close():
            out[1].close()
            _put(store, f"{at}/{root}.zip", out[0].getvalue())

        for batch in batches:
            for name, path, mode, data in zip(batch["root"], batch["path"], batch["mode"], batch["data"], strict=True):
                if name != root:
                    if out:
                        close()
                    root, buffer = name, io.BytesIO()
                    out, made = (buffer, zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED)), made + 1
                entry = zipfile.ZipInfo(path)
                entry.external_attr = int(mode, 8) << 16
                out[1].writestr(entry, bytes(data), zipfile.ZIP_DEFLATED)
        if out:
            close()
        yield pd.DataFrame({"n": [made]})

    dealt = archive.select("root", "path", "mode", "data").repartition("root").sortWithinPartitions("root", "path")
    return dealt.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def commit_graph(commits: DataFrame, git_dir: str) -> None:
    """Write commits (``oid, tree, parents, commit_time``, each oid once) as the commit graph; generations count from 1 at the roots.

    Up to repository.GRAPH_WHOLE commits one task makes it, beyond that a task each part; the driver joins their files without holding them.
    """
    spark, size, path = commits.sparkSession, repository.GRAPH_PART, f"{git_dir}/objects/info/commit-graph"
    raw = commits.select(F.unhex("oid").alias("oid"), F.unhex("tree").alias("tree"), F.transform("parents", F.unhex).alias("parents"), F.col("commit_time").cast("long").alias("commit_time"))
    raw = written(raw, "commits", timed=F.count("commit_time"), least=F.min("commit_time"), most=F.max("commit_time"))
    n = rows_in(raw)
    if seen_in(raw, "timed") < n or n and not 0 <= seen_in(raw, "least") <= seen_in(raw, "most") < formats.GRAPH_TIMES:
        raise ValueError("a commit graph holds times of 34 bits only")
    if n > formats.NO_PARENT:
        raise ValueError("a commit graph holds fewer commits")
    ship_package(spark)
    folder = new_folder(spark, "graph")
    if n <= repository.GRAPH_WHOLE:

        def whole(batches):
            rows = [{"oid": oid.hex(), "tree": tree.hex(), "parents": [x.hex() for x in parents], "commit_time": time} for batch in batches for oid, tree, parents, time in zip(*(batch[c].to_pylist() for c in ("oid", "tree", "parents", "commit_time")), strict=True)]
            made = formats.write_commit_graph(rows)
            store, root = _from(folder)
            _put(store, f"{root}/whole", made)
            yield pa.RecordBatch.from_pydict({"n": [len(made)]})

        if n:
            length = raw.coalesce(1).mapInArrow(whole, "n long").first()[0]
            repository.write_ranges(spark, path, f"{folder}/whole", [(0, length)])
        else:
            repository.write_bytes(spark, path, formats.write_commit_graph([]))
        discard_folder(spark, folder)
        return discard(raw)
    # Places in the order of ids: rows are numbered within the sorted partitions, whose sizes the driver sums up.
    sorted_ = written(raw.orderBy("oid").withColumn("_id", F.monotonically_increasing_id()), "sorted")
    discard(raw)
    starts, total = [], 0
    for p, k in sorted(tuple(r) for r in sorted_.groupBy(F.shiftright("_id", 33)).count().collect()):
        starts.append((p, total))
        total += k
    starts = F.broadcast(spark.createDataFrame(starts, "_p long, _start long"))
    placed = sorted_.join(starts, F.shiftright("_id", 33) == F.col("_p")).withColumn("position", F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1))
    links = placed.select(F.col("position").alias("child"), F.posexplode("parents").alias("parent_no", "oid")).join(placed.select("oid", F.col("position").alias("parent")), "oid", "left")
    parent = F.when(F.col("parent").isNull(), F.raise_error(F.lit("a parent is not among the commits")).cast("long")).otherwise(F.col("parent"))
    links = written(links.select("child", "parent_no", parent.alias("parent")), "links", most=F.max("parent_no"))
    edges, before, held = {}, {}, 0
    if (seen_in(links, "most") or 0) > 1:
        many = links.filter("parent_no > 1").groupBy("child").agg(F.max("parent_no").alias("k"))
        edges = {r["part"]: r["k"] for r in many.groupBy(F.floor(F.col("child") / size).alias("part")).agg(F.sum("k").alias("k")).collect()}
    for part in sorted(edges):
        before[part] = held
        held += edges[part]
    known = dag.generations(links, n)

    def build(key, rows):
        part = key[0].as_py()
        number = rows["parent_no"].to_numpy()
        own = rows.filter(pa.array(number == -2)).sort_by("position")
        place, value, k = rows["position"].to_numpy() - part * size, rows["value"].to_numpy(), len(own)
        data, time, generation = np.zeros(k, formats.GRAPH_ROW), own["value"].to_numpy(), np.zeros(k, np.int64)
        generation[place[number == -1]] = value[number == -1]
        ids = np.frombuffer(b"".join(own["oid"].to_pylist()), "V20")
        data["tree"] = np.frombuffer(b"".join(own["tree"].to_pylist()), "V20")
        data["first"] = data["second"] = formats.NO_PARENT
        data["first"][place[number == 0]] = value[number == 0]
        data["second"][place[number == 1]] = value[number == 1]
        data["high"], data["low"] = np.minimum(generation, formats.GRAPH_GENERATIONS - 1) << 2 | time >> 32, time & 0xFFFFFFFF
        many = np.zeros(k, bool)
        many[place[number == 2]] = True
        extra = np.flatnonzero((number > 0) & many[place])
        extra = extra[np.lexsort((number[extra], place[extra]))]
        of, begins = np.unique(place[extra], return_index=True)
        listed = value[extra].astype(">u4")
        listed[np.append(begins[1:], len(listed))[: len(of)] - 1] |= formats.EXTRA_PARENTS
        data["second"][of] = formats.EXTRA_PARENTS | before.get(part, 0) + begins
        store, root = _from(folder)
        for name, raw in (("ids", ids.tobytes()), ("data", data.tobytes()), ("edges", listed.tobytes())):
            _put(store, f"{root}/{name}/{part}", raw)
        return pa.table({"counts": [np.bincount(ids.view(np.uint8)[::20], minlength=256)]})

    nothing = F.lit(None).cast("binary")
    rows = placed.select("position", "oid", "tree", F.lit(-2).alias("parent_no"), F.col("commit_time").alias("value"))
    rows = rows.unionByName(links.select(F.col("child").alias("position"), nothing.alias("oid"), nothing.alias("tree"), "parent_no", F.col("parent").alias("value")))
    rows = rows.unionByName(known.select(F.col("commit").alias("position"), nothing.alias("oid"), nothing.alias("tree"), F.lit(-1).alias("parent_no"), F.col("generation").alias("value")))
    made = rows.groupBy(F.floor(F.col("position") / size).alias("part")).applyInArrow(build, "counts array<long>")
    counts = dict(tuple(r) for r in made.select(F.posexplode("counts").alias("byte", "n")).groupBy("byte").agg(F.sum("n")).collect())
    parts = range(-(-n // size))
    files = [f"{folder}/ids/{p}" for p in parts] + [f"{folder}/data/{p}" for p in parts] + [f"{folder}/edges/{p}" for p in sorted(edges)]
    repository.write_joined(spark, path, formats.graph_head([counts[x] for x in range(256)], held), files)
    for x in (sorted_, links, known):
        discard(x)
    discard_folder(spark, folder)


def json_lines(lines: DataFrame, folder: str) -> None:
    """One ``line`` a row as text files."""
    lines.select("line").write.mode("errorifexists").text(folder)
