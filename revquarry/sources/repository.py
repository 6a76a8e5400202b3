"""A repository's folder as DataFrames. Files are listed and read by Spark; decoders run inside its tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import objects as O
from ..operators import delta, refs
from ..session import discard_folder, new_folder, rows_in, ship_package, written
from . import formats

GRAPH = "oid string, tree string, parents array<string>, commit_time long, generation long"
#: Commits of a commit graph that one task makes or reads at most; larger ones go by parts, of so many commits or extra edges.
GRAPH_WHOLE, GRAPH_PART = 200_000, 65_536
OBJECTS = "oid string, kind string, size long, data binary, storage string, pack string, offset long"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _at(spark, path)
    return store.exists(at)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies directly in a folder; nothing where it is missing."""
    at, store = _at(spark, folder)
    return [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []


def files(spark: SparkSession, folder: str, pattern: str, name: str = "*") -> DataFrame:
    """``path, content`` of files below ``folder`` whose name matches the glob ``name`` and whose whole path matches; no rows where the folder is missing.

    Only files of that name are opened: the glob is applied while listing.
    """
    if not exists(spark, folder):
        return spark.createDataFrame([], "path string, content binary")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(folder)
    return found.filter(F.col("path").rlike(pattern)).select("path", "content")


def one_file(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of one file, without listing what lies around it; no row where it is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def write_bytes(spark: SparkSession, path: str, raw: bytes) -> None:
    """Write a small file."""
    _write(spark, path, lambda out: out.write(bytearray(raw)))


def write_joined(spark: SparkSession, path: str, head: bytes, parts: Iterable[str]) -> None:
    """Write ``head``, the files ``parts`` in order and the SHA-1 of it all; the bytes flow through the driver, which holds a buffer of them."""
    jvm = spark._jvm

    def fill(out):
        digest = jvm.java.security.MessageDigest.getInstance("SHA-1")
        both = jvm.java.security.DigestOutputStream(out, digest)
        both.write(bytearray(head))
        for part in parts:
            at, store = _at(spark, part)
            source = store.open(at)
            try:
                jvm.org.apache.commons.io.IOUtils.copyLarge(source, both)
            finally:
                source.close()
        both.flush()
        out.write(digest.digest())

    _write(spark, path, fill)


def write_ranges(spark: SparkSession, path: str, other: str, ranges: list[tuple[int, int]]) -> None:
    """Write another file's ranges (start, length); they flow through the driver as well."""
    at, store = _at(spark, other)
    source = store.open(at)

    def fill(out):
        for start, length in ranges:
            source.seek(start)
            if spark._jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, length) != length:
                raise ValueError(f"{other} is cut off")

    try:
        _write(spark, path, fill)
    finally:
        source.close()


def _write(spark: SparkSession, path: str, fill: Callable) -> None:
    """Fill a file beside its place, then put it there; a reader sees the old bytes or the new."""
    at, store = _at(spark, path)
    part, _ = _at(spark, f"{path}.new")
    store.mkdirs(at.getParent())
    out = store.create(part, True)
    try:
        fill(out)
    finally:
        out.close()
    # Not every store replaces a file by renaming.
    if not store.rename(part, at):
        store.delete(at, False)
        if not store.rename(part, at):
            raise OSError(f"{path} can't be written")


def remove(spark: SparkSession, path: str) -> None:
    at, store = _at(spark, path)
    store.delete(at, False)


def text_of(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    row = one_file(spark, path).first()
    if row is None:
        raise FileNotFoundError(path)
    return bytes(row["content"]).decode()


def decoded(raw: DataFrame, decode: Callable[[str, bytes], Iterable[dict]], schema: str) -> DataFrame:
    """Rows that ``decode(path, content)`` makes of each file."""
    ship_package(raw.sparkSession)
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = list(decode(path, bytes(content)))
                for i in range(0, len(rows), 5000):
                    yield pd.DataFrame(rows[i : i + 5000], columns=names)

    return raw.mapInPandas(run, schema)


def lines(found: DataFrame) -> DataFrame:
    """``path, ordinal, value`` of small text files' lines."""
    return found.select("path", F.posexplode(F.split(F.decode("content", "utf-8"), "\r?\n")).alias("ordinal", "value"))


def loose_objects(spark: SparkSession, git_dir: str) -> DataFrame:
    def decode(path, raw):
        kind, data = formats.loose_object(raw)
        parts = path.split("/")
        yield {"oid": parts[-2] + parts[-1], "kind": kind, "size": len(data), "data": data, "storage": "loose", "pack": None, "offset": None}

    return decoded(files(spark, f"{git_dir}/objects", "/objects/[0-9a-f]{2}/[0-9a-f]{38}$", "[0-9a-f]" * 38), decode, OBJECTS)


def packed_objects(spark: SparkSession, git_dir: str) -> DataFrame:
    """Objects of all packs, a task per pack; deltas whose base is elsewhere are resolved by joins, level by level."""
    raw_schema = OBJECTS + ", base_oid string, delta binary"

    def decode(path, raw):
        name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        for x in formats.pack(raw):
            oid = formats.oid_of(x["kind"], x["data"]) if x["data"] is not None else None
            yield {"oid": oid, "kind": x["kind"], "size": len(x["data"]) if oid else None, "data": x["data"], "storage": "pack", "pack": name, "offset": x["offset"], "base_oid": x["base_oid"], "delta": x["delta"]}

    found = written(decoded(files(spark, f"{git_dir}/objects/pack", r"\.pack$", "*.pack"), decode, raw_schema), "packs")
    plain = found.filter("oid is not null").drop("base_oid", "delta")
    left = written(found.filter("oid is null"), "left")
    known = plain.unionByName(loose_objects(spark, git_dir)).select(F.col("oid").alias("base_oid"), F.col("kind").alias("base_kind"), F.col("data").alias("base"))
    while rows_in(left):
        made = delta.with_targets(left.join(known.dropDuplicates(["base_oid"]), "base_oid")).withColumn("kind", F.col("base_kind"))
        oid = F.sha1(F.concat(F.concat(F.col("kind"), F.lit(" "), F.octet_length("made").cast("string")).cast("binary"), F.unhex(F.lit("00")), F.col("made")))
        made = written(made.select(oid.alias("oid"), "kind", F.octet_length("made").cast("long").alias("size"), F.col("made").alias("data"), "storage", "pack", "offset"), "thin")
        if not rows_in(made):
            raise ValueError("a delta's base is missing")
        plain = plain.unionByName(made)
        left = written(left.join(made.select("pack", "offset"), ["pack", "offset"], "left_anti"), "left")
        known = made.select(F.col("oid").alias("base_oid"), F.col("kind").alias("base_kind"), F.col("data").alias("base"))
    return plain


def objects(spark: SparkSession, git_dir: str) -> DataFrame:
    """One row per object, loose before packed where it is stored twice."""
    both = loose_objects(spark, git_dir).withColumn("_p", F.lit(0)).unionByName(packed_objects(spark, git_dir).withColumn("_p", F.lit(1)))
    from pyspark.sql import Window

    w = Window.partitionBy("oid").orderBy("_p", "pack")
    return both.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_p")


def pack_index(spark: SparkSession, git_dir: str) -> DataFrame:
    """``pack, oid, offset, crc``: the multi-pack index first, then the indexes of packs that it doesn't cover."""
    name = lambda path: path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    single = decoded(files(spark, f"{git_dir}/objects/pack", r"\.idx$", "*.idx"), lambda p, raw: ({"pack": name(p)} | x for x in formats.pack_index(raw)), "pack string, oid string, offset long, crc long")
    multi = decoded(one_file(spark, f"{git_dir}/objects/pack/multi-pack-index"), lambda p, raw: ({"crc": None} | x for x in formats.multi_pack_index(raw)), "pack string, oid string, offset long, crc long")
    return multi.unionByName(single.join(multi.select("pack").distinct(), "pack", "left_anti").select("pack", "oid", "offset", "crc"))


def commit_graph(spark: SparkSession, git_dir: str) -> DataFrame:
    """``oid, tree, parents, commit_time, generation`` from the graph file or its chain; no rows where there is none."""
    info = f"{git_dir}/objects/info"
    chain = f"{info}/commit-graphs/commit-graph-chain"
    single = [f"{info}/commit-graph"] if exists(spark, f"{info}/commit-graph") else []
    several = [f"{info}/commit-graphs/graph-{x}.graph" for x in text_of(spark, chain).split()] if exists(spark, chain) else []
    found = [_graph(spark, paths) for paths in (single, several) if paths]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], GRAPH)


def _graph(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files of a chain, which refer to those below by position: by one task where they are small, else by parts."""
    chunks, sizes = [], []
    for path in paths:
        at, store = _at(spark, path)
        source = store.open(at)
        try:
            head = bytes(source.readNBytes(8))
            chunks.append(formats.graph_chunks(head + bytes(source.readNBytes(12 * (head[6] + 1)))))
            source.seek(chunks[-1][b"OIDF"][0] + 255 * 4)
            sizes.append(source.readInt())
        finally:
            source.close()
    if sum(sizes) > GRAPH_WHOLE:
        return _graph_by_parts(spark, paths, chunks, sizes)
    ship_package(spark)
    names = [x.rsplit("/", 1)[-1] for x in paths]

    def read(batches):
        found = {p.rsplit("/", 1)[-1]: bytes(c) for batch in batches for p, c in zip(batch["path"], batch["content"], strict=True)}
        earlier: list[str] = []
        for name in names:
            rows = formats.commit_graph(found[name], earlier)
            earlier += [x["oid"] for x in rows]
            yield pd.DataFrame(rows, columns=["oid", "tree", "parents", "commit_time", "generation"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").coalesce(1).mapInPandas(read, GRAPH)


def _graph_by_parts(spark: SparkSession, paths: list[str], chunks: list[dict], sizes: list[int]) -> DataFrame:
    """The driver copies ranges of the files into files of their own, without holding them; tasks read those, and positions become ids by a join."""
    folder = new_folder(spark, "graph")
    first, first_edge = 0, 0
    for path, at, n in zip(paths, chunks, sizes, strict=True):
        for i in range(0, n, GRAPH_PART):
            k = min(GRAPH_PART, n - i)
            write_ranges(spark, f"{folder}/commits/{first + i}-{first_edge}", path, [(at[b"OIDL"][0] + 20 * i, 20 * k), (at[b"CDAT"][0] + 36 * i, 36 * k)])
        first += n
        if b"EDGE" in at:
            start, end = at[b"EDGE"]
            for i, k in _edge_parts(spark, path, start, (end - start) // 4):
                write_ranges(spark, f"{folder}/edges/{first_edge + i}", path, [(start + 4 * i, 4 * k)])
            first_edge += (end - start) // 4
    ship_package(spark)

    def commits(batches):
        for path, raw in ((p.as_py(), x.as_py()) for batch in batches for p, x in zip(batch["path"], batch["content"], strict=True)):
            place, edge = (int(x) for x in path.rsplit("/", 1)[-1].split("-"))
            n = len(raw) // 56
            rows = np.frombuffer(raw, formats.GRAPH_ROW, offset=20 * n)
            a, b, high = (rows[c].astype(np.int64) for c in ("first", "second", "high"))
            more = (b & formats.EXTRA_PARENTS) > 0
            ids = lambda x: pa.Array.from_buffers(pa.binary(20), n, [None, pa.py_buffer(x)]).cast(pa.binary())  # noqa: B023, E731
            number = lambda x, there: pa.array(x, mask=~there)
            columns = [pa.array(np.arange(place, place + n)), ids(raw[: 20 * n]), ids(rows["tree"].tobytes()), number(a, a != formats.NO_PARENT), number(b, ~more & (b != formats.NO_PARENT)), number(edge + (b & ~formats.EXTRA_PARENTS), more), pa.array((high & 3) << 32 | rows["low"].astype(np.int64)), pa.array(high >> 2)]
            yield pa.RecordBatch.from_arrays(columns, names=["position", "oid", "tree", "first", "second", "edge", "commit_time", "generation"])

    def edges(batches):
        for path, raw in ((p.as_py(), x.as_py()) for batch in batches for p, x in zip(batch["path"], batch["content"], strict=True)):
            x = np.frombuffer(raw, ">u4").astype(np.int64)
            at = np.arange(len(x)) + int(path.rsplit("/", 1)[-1])
            last = at[(x & formats.EXTRA_PARENTS) > 0]
            k = np.searchsorted(last, at)
            yield pa.RecordBatch.from_arrays([pa.array(y[k < len(last)]) for y in (at, last[np.minimum(k, len(last) - 1)] if len(last) else at, x & ~formats.EXTRA_PARENTS)], names=["edge", "last", "parent"])

    read = lambda x: spark.read.format("binaryFile").load(f"{folder}/{x}").select("path", "content")
    nodes = written(read("commits").mapInArrow(commits, "position long, oid binary, tree binary, first long, second long, edge long, commit_time long, generation long"), "commits")
    links = nodes.select(F.col("position").alias("child"), F.posexplode(F.array("first", "second")).alias("parent_no", "parent")).filter("parent is not null")
    if first_edge:
        extra = written(read("edges").mapInArrow(edges, "edge long, last long, parent long"), "edges")
        # A list goes from the edge that the commit names to the next one marked as last.
        lists = nodes.filter("edge is not null").select(F.col("position").alias("child"), F.col("edge").alias("opens")).join(extra.select(F.col("edge").alias("opens"), "last"), "opens", "left")
        lists = lists.withColumn("last", F.when(F.col("last").isNull(), F.raise_error(F.lit("a commit graph's extra edges are cut off")).cast("long")).otherwise(F.col("last")))
        links = links.unionByName(lists.join(extra, "last").filter("edge >= opens").select("child", (F.col("edge") - F.col("opens") + 1).cast("int").alias("parent_no"), "parent"))
    discard_folder(spark, folder)
    named = links.join(nodes.select(F.col("position").alias("parent"), F.col("oid").alias("parent_oid")), "parent", "left")
    name = F.when(F.col("parent_oid").isNull(), F.raise_error(F.lit("a commit graph lacks a parent")).cast("string")).otherwise(F.lower(F.hex("parent_oid")))
    parents = named.groupBy(F.col("child").alias("position")).agg(F.sort_array(F.collect_list(F.struct("parent_no", name.alias("oid"))))["oid"].alias("parents"))
    whole = nodes.join(parents, "position", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
    return whole.select(F.lower(F.hex("oid")).alias("oid"), F.lower(F.hex("tree")).alias("tree"), "parents", "commit_time", "generation")


def _edge_parts(spark: SparkSession, path: str, start: int, n: int) -> Iterable[tuple[int, int]]:
    """``n`` extra edges as (first, length) of parts that end where a list of edges does."""
    at, store = _at(spark, path)
    source, first = store.open(at), 0
    try:
        while first < n:
            end = min(n, first + GRAPH_PART)
            source.seek(start + 4 * (end - 1))
            while source.readInt() >= 0 and end < n:  # the mark is the sign
                end += 1
            yield first, end - first
            first = end
    finally:
        source.close()


def staging(spark: SparkSession, git_dir: str) -> DataFrame:
    schema = "ordinal int, path string, oid string, type string, perms int, size long, ctime long, ctime_nanos long, mtime long, mtime_nanos long, stage int"
    rows = decoded(one_file(spark, f"{git_dir}/index"), lambda _, raw: formats.staging_index(raw), schema)
    return rows.withColumn("ctime", F.timestamp_seconds("ctime")).withColumn("mtime", F.timestamp_seconds("mtime"))


def lfs_objects(spark: SparkSession, git_dir: str) -> DataFrame:
    """``sha256, data`` of locally stored large files."""
    found = files(spark, f"{git_dir}/lfs/objects", "/[0-9a-f]{2}/[0-9a-f]{2}/[0-9a-f]{64}$", "[0-9a-f]" * 64)
    return found.select(F.regexp_extract("path", "([0-9a-f]{64})$", 1).alias("sha256"), F.col("content").alias("data"))


def resolve_lfs(blobs: DataFrame, lfs: DataFrame, strict: bool = True) -> DataFrame:
    """``blobs`` (``oid, text, data``) with pointers' ``data`` replaced by the large file's; a missing one is an error when ``strict``."""
    p = O.lfs_pointer("text")
    joined = blobs.withColumn("_sha", p["sha256"]).join(lfs.select(F.col("sha256").alias("_sha"), F.col("data").alias("_large")), "_sha", "left")
    missing = F.raise_error(F.concat(F.lit("Large file "), F.col("_sha"), F.lit(" is not here; run git lfs fetch."))) if strict else F.col("data")
    return joined.withColumn("data", F.when(F.col("_sha").isNull(), F.col("data")).when(F.col("_large").isNotNull(), F.col("_large")).otherwise(missing)).drop("_sha", "_large")


def references(spark: SparkSession, git_dir: str) -> DataFrame:
    """``canonical, oid, storage``; symbolic references are followed to where they lead, loose ones go before packed."""
    loose = lines(files(spark, f"{git_dir}/refs", "/refs/")).filter("ordinal = 0").select(F.regexp_extract("path", "/(refs/.*)$", 1).alias("canonical"), F.regexp_replace("value", r"[.\s]+$", "").alias("oid"))
    packed = refs.parse_packed(lines(one_file(spark, f"{git_dir}/packed-refs")))
    found = refs.effective(loose, packed)
    target = F.regexp_extract("oid", "^ref: (.+)$", 1)
    known = found.select(F.col("canonical").alias("_to"), F.col("oid").alias("_oid"))
    return found.withColumn("_to", target).join(known, "_to", "left").select("canonical", F.when(F.col("_to") == "", F.col("oid")).otherwise(F.col("_oid")).alias("oid"), "storage")


def configuration(spark: SparkSession, git_dir: str) -> DataFrame:
    return refs.parse_config(lines(one_file(spark, f"{git_dir}/config")).select("ordinal", "value"))


def stashes(spark: SparkSession, git_dir: str) -> DataFrame:
    """``ordinal, oid, message`` in the file's order: the oldest first."""
    found = lines(one_file(spark, f"{git_dir}/logs/refs/stash")).filter("value <> ''")
    return found.select("ordinal", F.split("value", " ")[1].alias("oid"), F.regexp_extract("value", "\t(.*)$", 1).alias("message"))
