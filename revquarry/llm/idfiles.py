"""Token ids in binary shard files, read by key through a minimal perfect hash.

A shard is ``<n>.ids``, nothing but the documents' ids in ascending document order as little-endian unsigned integers
(2 bytes when the vocabulary allows, else 4; the index tells), and ``<n>.mph``, its index: a minimal perfect hash of
the shard's distinct document keys onto 0..n-1, a 32-bit fingerprint, the first record and the number of records of
each key, and the records' offsets in ids. A key's shard follows from the shards' key ranges, so a lookup is: range,
hash, fingerprint, offset. A key that fills whole shards has shards of its own, among which its documents are dealt by
their texts' hash. The hash is a cascade of bit arrays: keys that are alone at their bit of a level stay there, the
others go to the next level; a key's number is the rank of its bit. Keys left after the last level are listed.
"""

from __future__ import annotations

import io
import struct
import zlib
from array import array
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import byte_level_encoder, greatest_id

#: Documents in a shard, and shards in a partition, about.
SHARD_DOCS, SHARDS_TOGETHER = 8192, 8
#: Bytes read at once, and rows handed on at once.
READ_BYTES, ROWS_TOGETHER = 4_000_000, 8192
MAGIC = b"IDSHARD2"
LEVELS = 24


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of integer keys, by seed (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 977) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Distinct int64 keys onto 0..n-1, about 3 bits a key."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.cumsum(x) - x for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left) and len(levels) < LEVELS:
            size = max(64, int(1.6 * len(left)))
            at = (mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; for keys that were not built in, any number or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (mix(keys[open_], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.before[k] + self.ranks[k][at[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.searchsorted(self.rest, keys[open_])
            at[at == len(self.rest)] = 0
            same = self.rest[at] == keys[open_]
            out[open_[same]] = self.before[-1] + at[same]
        return out

    def pack(self) -> bytes:
        parts = [struct.pack("<II", len(self.levels), len(self.rest)), self.rest.astype("<i8").tobytes()]
        for bits in self.levels:
            parts += [struct.pack("<Q", len(bits)), np.packbits(bits).tobytes()]
        return b"".join(parts)

    @classmethod
    def unpack(cls, f: io.BytesIO) -> PerfectHash:
        n, rest = struct.unpack("<II", f.read(8))
        kept = np.frombuffer(f.read(8 * rest), dtype="<i8")
        levels = []
        for _ in range(n):
            (size,) = struct.unpack("<Q", f.read(8))
            levels.append(np.unpackbits(np.frombuffer(f.read(-(-size // 8)), dtype=np.uint8), count=size).astype(bool))
        return cls(levels, kept)


class ShardIndex:
    """What ``<n>.mph`` holds."""

    def __init__(self, hash_: PerfectHash, prints: np.ndarray, first: np.ndarray, count: np.ndarray, offsets: np.ndarray, width: int = 2):
        self.hash, self.prints, self.first, self.count, self.offsets, self.width = hash_, prints, first, count, offsets, width

    @classmethod
    def build(cls, keys: np.ndarray, lengths: np.ndarray, first_record: int, width: int = 2) -> ShardIndex:
        """``keys`` ascending, perhaps repeated; records before ``first_record`` have no key (null document ids). Ids take ``width`` bytes."""
        distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
        hash_ = PerfectHash.build(distinct)
        number = hash_.numbers(distinct)
        prints, firsts, counts = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        prints[number], firsts[number], counts[number] = fingerprint(distinct), first + first_record, count
        return cls(hash_, prints, firsts, counts, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), width)

    def pack(self) -> bytes:
        parts = [MAGIC, struct.pack("<QQB", len(self.prints), len(self.offsets), self.width), self.hash.pack()]
        return b"".join([*parts, self.prints.astype("<u4").tobytes(), self.first.astype("<i8").tobytes(), self.count.astype("<i8").tobytes(), self.offsets.astype("<i8").tobytes()])

    @classmethod
    def unpack(cls, raw: bytes) -> ShardIndex:
        f = io.BytesIO(raw)
        if f.read(8) != MAGIC:
            raise ValueError("not a shard index")
        n, m, width = struct.unpack("<QQB", f.read(17))
        hash_ = PerfectHash.unpack(f)
        return cls(hash_, *(np.frombuffer(f.read(k * size), dtype=kind) for k, size, kind in ((n, 4, "<u4"), (n, 8, "<i8"), (n, 8, "<i8"), (m, 8, "<i8"))), width)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; 0 records where its fingerprint is not the stored one."""
        if not len(self.prints):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = self.hash.numbers(keys)
        known = (at >= 0) & (self.prints[at] == fingerprint(keys))
        return np.where(known, self.first[at], 0), np.where(known, self.count[at], 0)


def _store(folder: str):
    return pyarrow.fs.FileSystem.from_uri(folder)


def _exists(store, path: str) -> bool:
    return store.get_file_info(path).type == pyarrow.fs.FileType.File


def _moved(store, part: str, path: str) -> None:
    """Give a finished file its name. A repeated attempt has written the same bytes: it leaves an earlier one's file."""
    if not _exists(store, path):
        try:
            store.move(part, path)
            return
        except OSError:
            if not _exists(store, path):
                raise
    store.delete_file(part)


class _ShardWriter:
    """Writes a shard as its documents come: the ids go straight to the file, only keys and lengths are held.

    All or nothing: an attempt that dies leaves no file under the final name.
    """

    def __init__(self, store, root: str, n: int, width: int):
        task = TaskContext.get()
        self.store, self.path, self.width = store, f"{root}/{n}", width
        self.part = f".part-{task.taskAttemptId() if task else 0}"
        self.ids = store.open_output_stream(f"{self.path}.ids{self.part}")
        self.keys, self.lengths, self.nulls, self.total = array("q"), array("q"), 0, 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.ids.write(ids.astype(f"<u{self.width}").tobytes())
        if key is None:
            self.nulls += 1
        else:
            self.keys.append(key)
        self.lengths.append(len(ids))
        self.total += len(ids)

    def close(self) -> int:
        self.ids.close()
        index = ShardIndex.build(np.array(self.keys, dtype=np.int64), np.array(self.lengths, dtype=np.int64), self.nulls, self.width)
        with self.store.open_output_stream(f"{self.path}.mph{self.part}") as f:
            f.write(index.pack())
        for end in (".ids", ".mph"):
            _moved(self.store, self.path + end + self.part, self.path + end)
        return self.total


class Layout:
    """Which shard a document is in. Shards are numbered in the order of their keys, null keys first.

    ``limits`` are ascending keys; each ends a range of keys. ``own`` says how many shards its last key has for itself
    (0: it is in the range's shard), ``nulls`` how many the null keys have (0: there are none).
    """

    def __init__(self, limits: list[int], own: list[int], nulls: int = 0):
        self.limits, self.own, self.nulls = np.array(limits, dtype=np.int64), np.array([*own, 0], dtype=np.int64), nulls
        self.base = nulls + np.concatenate([[0], np.cumsum(1 + self.own)])[:-1]
        self.shards = int(self.base[-1] + 1)

    @classmethod
    def of(cls, keys: DataFrame, n: int, nulls: int, shard_docs: int) -> Layout:
        """By quantiles of the key: one that comes as several quantiles has as many shards to itself."""
        shards = max(1, -(-(n - nulls) // shard_docs))
        cuts = Counter(map(int, keys.approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.1 / shards))) if shards > 1 else {}
        limits = sorted(cuts)
        return cls(limits, [cuts[x] if cuts[x] > 1 else 0 for x in limits], -(-nulls // shard_docs))

    def of_key(self, key: int | None) -> range:
        if key is None:
            return range(self.nulls)
        k = bisect_left(self.limits, key)
        if k < len(self.limits) and self.own[k] and self.limits[k] == key:
            return range(int(self.base[k]) + 1, int(self.base[k] + 1 + self.own[k]))
        return range(int(self.base[k]), int(self.base[k]) + 1)

    def shard(self, doc_id: pd.Series, part: pd.Series) -> pd.Series:
        """The shard of each document; ``part`` in [0, 1) is its place among those of its key."""
        none, key = doc_id.isna().to_numpy(), doc_id.fillna(0).astype("int64").to_numpy()
        k = np.searchsorted(self.limits, key)
        last = np.append(self.limits, 0)[k] == key
        own = np.where(last, self.own[k], 0)
        found = self.base[k] + np.where(own > 0, 1 + np.floor(part.to_numpy() * own).astype(np.int64), 0)
        return pd.Series(np.where(none, np.floor(part.to_numpy() * self.nulls).astype(np.int64), found).astype(np.int32))


class IdFiles:
    """Shard files in a folder, with what a reader needs to know of each: its keys, and the ids before it."""

    def __init__(self, folder: str, layout: Layout, before: list[int]):
        self.folder, self.layout, self.before = folder, layout, before

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document with this key, in stored order."""
        store, root = _store(self.folder)
        out = []
        for n in self.layout.of_key(key):
            with store.open_input_stream(f"{root}/{n}.mph") as f:
                index = ShardIndex.unpack(f.read())
            first, count = index.find(np.array([key], dtype=np.int64))
            with store.open_input_file(f"{root}/{n}.ids") as f:
                for k in range(int(first[0]), int(first[0] + count[0])):
                    a, b = int(index.offsets[k]), int(index.offsets[k + 1])
                    out.append(np.frombuffer(f.read_at((b - a) * index.width, a * index.width), dtype=f"<u{index.width}").astype(np.uint32))
        return out


def _dealt(rows: DataFrame, shards: int, *order) -> DataFrame:
    """Rows by ``shard``, several neighbouring shards to a partition."""
    parts = min(shards, max(common.default_parallelism(rows.sparkSession), -(-shards // SHARDS_TOGETHER)))
    to = (F.col("shard").cast("long") * parts / F.lit(shards)).cast("int")
    return rows.withColumn("_to", to).repartitionById(parts, "_to").sortWithinPartitions("shard", *order).drop("_to")


def write_ids(docs: DataFrame, path: str, end_id: int = 2, shard_docs: int = SHARD_DOCS, folder: str | None = None) -> IdFiles:
    """Encode every whole text (null: empty), append ``end_id``, and write the shards in ascending ``doc_id`` order.

    Null keys come first, in shard 0, and can be read only in order, not by key. Documents that share a key are
    ordered by their text and all returned for it. Other columns are ignored. An empty table writes one empty shard.
    """
    spark = docs.sparkSession
    common.ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keys = docs.select("doc_id")
    n, nulls = keys.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    layout = Layout.of(keys, n, nulls, shard_docs)
    folder = folder or common.new_folder(spark, "ids")
    store, root = _store(folder)
    store.create_dir(root)
    width = 2 if max(greatest_id(path), end_id) < 1 << 16 else 4

    def run(batches):
        encode = byte_level_encoder(path)
        store, root = _store(folder)
        now, shard, end = None, None, np.array([end_id])
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([shard.close()], pa.int64())], names=["shard", "ids"])
        for batch in common.slices(batches):
            for n, key, text in zip(batch["shard"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if n != now:
                    if now is not None:
                        yield done()
                    now, shard = n, _ShardWriter(store, root, n, width)
                shard.add(key, np.concatenate([encode(text), end]))
        if now is not None:
            yield done()

    column = F.pandas_udf(layout.shard, "int")
    part = F.shiftrightunsigned(F.xxhash64("text"), 11) * 2.0**-53
    dealt = _dealt(docs.withColumn("shard", column("doc_id", part)), layout.shards, F.col("doc_id").asc_nulls_first(), "text").select("shard", "doc_id", "text")
    # Two numbers a shard.
    sizes = {r["shard"]: r["ids"] for r in dealt.mapInArrow(run, "shard int, ids long").collect()}
    before, total = [], 0
    for k in range(layout.shards):
        if k not in sizes:
            _ShardWriter(store, root, k, width).close()
        before.append(total)
        total += sizes.get(k, 0)
    return IdFiles(folder, layout, before)


class _Payload:
    """Reads a shard's ids; neighbouring records come from one read of READ_BYTES or so."""

    def __init__(self, store, path: str, width: int):
        self.file, self.width = store.open_input_file(path), width
        self.at, self.held = 0, b""

    def ids(self, first: int, after: int) -> np.ndarray:
        a, b = first * self.width, after * self.width
        if a < self.at or b > self.at + len(self.held):
            self.at, self.held = a, self.file.read_at(max(b - a, READ_BYTES), a)
        return np.frombuffer(self.held, dtype=f"<u{self.width}", count=after - first, offset=a - self.at)


def read_ids(spark: SparkSession, files: IdFiles, keys: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the documents with these keys, read from the files through the index.

    A row of ``keys`` per lookup; repeated keys are looked up once. Keys that no file holds give no row. A null among
    the keys gives the documents without a key.
    """
    folder, before, layout = files.folder, files.before, files.layout
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches):
        store, root = _store(folder)
        now, index, payload = None, None, None
        for batch in batches:
            shards, asked = batch["shard"].to_numpy(), batch["doc_id"]
            rows: list[tuple] = []
            for n in np.unique(shards):
                if n != now:
                    with store.open_input_stream(f"{root}/{n}.mph") as f:
                        index = ShardIndex.unpack(f.read())
                    now, payload = n, _Payload(store, f"{root}/{n}.ids", index.width)
                mine = asked.filter(pa.array(shards == n))
                some = mine.drop_null().to_numpy()
                first, count = index.find(some)
                records = [(int(k), int(a), int(a + c)) for k, a, c in zip(some, first, count, strict=True)]
                if mine.null_count:
                    records.append((None, 0, len(index.offsets) - 1 - int(index.count.sum())))
                for key, a, b in records:
                    for k in range(a, b):
                        start, end = int(index.offsets[k]), int(index.offsets[k + 1])
                        rows.append((key, before[n] + start, end - start, zlib.crc32(payload.ids(start, end).astype("<u4").tobytes())))
                        if len(rows) == ROWS_TOGETHER:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                            rows = []
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    @F.pandas_udf("array<int>")
    def shards_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series([[*layout.of_key(None if x is None else int(x))] for x in doc_id.astype(object).where(doc_id.notna(), None)])

    hot = len(layout.limits) and layout.own.any() or layout.nulls > 1
    one = F.pandas_udf(layout.shard, "int")("doc_id", F.lit(0.0))
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("shard", F.explode(shards_of("doc_id")) if hot else one)
    dealt = _dealt(wanted, layout.shards, "doc_id").select("shard", "doc_id")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
