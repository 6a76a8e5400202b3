"""Jaccard join on word shingles by vertical partitioning.

A document is the set of its distinct 5-word shingles, as 64-bit hashes. The order of all shingles is cut into
fragments; every document's set falls into segments, one for each fragment. Each fragment finds by itself which of its
shingles several documents share, and how many share each: that is the global order's frequency, and the shared parts
of the segments are all that can overlap. A document links with another only if the shared parts, summed over the
fragments, make up the threshold's share of its set; most documents end here.

The rest are joined. Documents that can link have a shingle in common among the first of each in the order (rarest
first; the prefix). Pairs found so are verified fragment by fragment: each counts the overlap of the two segments, and
the counts are summed per pair. Documents with equal sets are one. Every document has a random level, three quarters
of them level 0, three quarters of the rest level 1, and so on. In each prefix shingle's list, the members of the
highest level are paired with the others first, then in turn those of the next lower level, four times as many. What a
turn joins is one group from then on, and only pairs of different groups are tried, of which one at least is outside
the list's largest group. So every pair that sizes and positions don't rule out is tried or found connected already:
no link that joins two groups is lost. A document linked with a share of a list meets one of that share after about as
many tries as the share goes into the list, so neither copies nor near copies are expanded into all their pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import rows_in
from . import common
from .components import components

#: Words in a shingle; the threshold as a fraction.
WORDS, NUMERATOR, DENOMINATOR = 5, 3, 4
#: Bytes of hashes in a block, and of text for each fragment: they bound a task's memory.
BLOCK_BYTES, FRAGMENT_BYTES, LEAST_FRAGMENTS = 16_000_000, 16_000_000, 32
#: Groups of fragments that overlaps are counted in, and bytes of pairs up to which they are broadcast.
COUNTED_IN, PAIRS_BROADCAST = 8, 8_000_000
#: Times as many members of a list are paired with the others in each turn.
GROWTH = 4
#: Rows that a worker hands on at once, and what a set takes in memory besides its hashes.
ROWS_TOGETHER, SET_BYTES = 4096, 256
#: Words that a worker remembers the hash of at most.
CACHE_WORDS = 200_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


def _rolled(h: np.ndarray, words: int) -> np.ndarray:
    n = len(h) - words + 1
    x = np.full(n, words, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(words):
            x = (x ^ h[i : i + n]) * _MIX[i % len(_MIX)]
            x ^= x >> np.uint64(29)
        x *= _MIX[0]
        return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, hashes: dict, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the text's distinct shingles. A-Z are lowered; words are what ASCII white space separates."""
    found = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    return np.unique(_rolled(h, min(words, len(h))))


def pack_hashes(h: np.ndarray) -> bytes:
    """Ascending hashes by their differences: 6 bytes each where those suffice, else 8; the first byte tells."""
    d = np.diff(h, prepend=np.uint64(0))
    first, rest = d[:1].astype("<u8").tobytes(), d[1:].astype("<u8")
    if len(rest) and int(rest.max()) >= 1 << 48:
        return b"\x08" + first + rest.tobytes()
    return b"\x06" + first + np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack_hashes(raw: bytes) -> np.ndarray:
    first = np.frombuffer(raw, dtype="<u8", count=1, offset=1)
    if raw[0] == 8:
        rest = np.frombuffer(raw, dtype="<u8", offset=9)
    else:
        cut = np.frombuffer(raw, dtype=np.uint8, offset=9).reshape(-1, 6)
        wide = np.zeros((len(cut), 8), dtype=np.uint8)
        wide[:, :6] = cut
        rest = wide.view("<u8").ravel()
    return np.cumsum(np.concatenate([first, rest]), dtype=np.uint64)


DEALT = pa.schema([("fragment", pa.int32()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("same", pa.binary()), ("hashes", pa.binary()), ("places", pa.binary())])
DEALT_DDL = "fragment int, uid long, doc_id long, n long, same binary, hashes binary, places binary"
FOUND = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("same", pa.binary()), ("fragment", pa.int32()), ("hashes", pa.list_(pa.int64())), ("shared_by", pa.list_(pa.int32()))])
FOUND_DDL = "uid long, doc_id long, n long, same binary, fragment int, hashes array<long>, shared_by array<int>"


def _dealt(docs: DataFrame, fragments: int, words: int, block_bytes: int) -> DataFrame:
    """A row per document, and per block and fragment one with the block's segments of it."""

    def table(rows: list) -> list[pa.RecordBatch]:
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), DEALT, strict=True)], schema=DEALT).to_batches()

    def run(batches):
        hashes = _Hashes()
        uid = TaskContext.get().partitionId() << 33
        base, sets, size, seen = uid, [], 0, set()

        def block():
            nonlocal base, sets, size, seen
            h = np.concatenate([s for _, s in sets])
            place = np.repeat(np.array([p for p, _ in sets], dtype=np.uint32), [len(s) for _, s in sets])
            wide = np.uint16 if uid - base < 1 << 16 else np.uint32
            of = base
            base, sets, size, seen = uid, [], 0, set()
            order = np.argsort(h, kind="stable")
            h, place = h[order], place[order]
            del order
            # A fragment is a range of hashes.
            edges = np.searchsorted(h, np.array([(k << 64) // fragments for k in range(1, fragments)], dtype=np.uint64))
            cut = [(k, a, b) for k, (a, b) in enumerate(zip([0, *edges], [*edges, len(h)], strict=True)) if b > a]
            for i in range(0, len(cut), 1024):
                yield from table([(k, of, None, None, None, pack_hashes(h[a:b]), place[a:b].astype(wide).tobytes()) for k, a, b in cut[i : i + 1024]])

        for batch in common.slices(batches):
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                s = shingle_set(text, hashes, words)
                same = xxhash.xxh3_128_digest(s.tobytes())
                rows.append((uid % fragments, uid, doc_id, len(s), same, None, None))
                if len(s) and same not in seen:  # equal sets of a block are one already
                    seen.add(same)
                    sets.append((uid - base, s))
                    size += 8 * len(s) + SET_BYTES
                uid += 1
                if size >= block_bytes:
                    yield from block()
                if len(rows) == ROWS_TOGETHER:
                    yield from table(rows)
                    rows = []
            if rows:
                yield from table(rows)
        if sets:
            yield from block()

    return docs.mapInArrow(run, DEALT_DDL)


def _fragments(dealt: DataFrame, fragments: int) -> DataFrame:
    """Document rows as they are; per fragment and document the shingles that others share, and how many share each."""

    def shared(blobs: list) -> list[pa.RecordBatch]:
        if not blobs:
            return []
        fragment = blobs[0][0]
        h = np.concatenate([unpack_hashes(x) for _, _, x, _ in blobs])
        uid = []
        for _, base, hashes, places in blobs:
            n = (len(hashes) - 9) // hashes[0] + 1
            uid.append(np.frombuffer(places, dtype=np.uint16 if len(places) == 2 * n else np.uint32).astype(np.int64) + base)
        uid = np.concatenate(uid)
        blobs.clear()
        order = np.argsort(h)
        h, uid = h[order], uid[order]
        del order
        # Only runs of equal hashes go on.
        same = h[1:] == h[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        h, uid = h[keep], uid[keep]
        of = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]) - 1
        count = np.bincount(of)[of] if len(h) else of
        order = np.lexsort((h, uid))
        h, uid, count = h[order].view(np.int64), uid[order], count[order].astype(np.int32)
        starts = np.flatnonzero(np.concatenate([[True], uid[1:] != uid[:-1]])) if len(uid) else np.empty(0, dtype=np.int64)
        offsets = pa.array(np.concatenate([starts, [len(uid)]]), pa.int32())
        m = len(starts)
        none = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.binary())]
        table = pa.Table.from_arrays([pa.array(uid[starts], pa.int64()), *none, pa.array(np.full(m, fragment), pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(h)), pa.ListArray.from_arrays(offsets, pa.array(count))], schema=FOUND)
        return table.to_batches(max_chunksize=4096)

    def run(batches):
        blobs: list = []
        for batch in batches:
            docs = batch.filter(batch["n"].is_valid())
            if len(docs):
                yield pa.RecordBatch.from_arrays([docs["uid"], docs["doc_id"], docs["n"], docs["same"], pa.nulls(len(docs), pa.int32()), pa.nulls(len(docs), pa.list_(pa.int64())), pa.nulls(len(docs), pa.list_(pa.int32()))], schema=FOUND)
            segments = batch.filter(batch["n"].is_null())
            for row in zip(*(segments[c].to_pylist() for c in ("fragment", "uid", "hashes", "places")), strict=True):
                if blobs and blobs[0][0] != row[0]:
                    yield from shared(blobs)
                    blobs = []
                blobs.append(row)
        yield from shared(blobs)

    return dealt.repartitionById(fragments, "fragment").sortWithinPartitions("fragment").mapInArrow(run, FOUND_DDL)


def _overlaps(pairs: DataFrame, n_pairs: int, segments: DataFrame) -> DataFrame:
    """``a, b, overlap``: the segments' overlaps, counted part by part and summed per pair."""
    sides = pairs.select("a", "b", F.col("a").alias("uid")).unionByName(pairs.select("a", "b", F.col("b").alias("uid")))
    if 48 * n_pairs <= PAIRS_BROADCAST:
        sides = F.broadcast(sides)
    met = segments.join(sides, "uid").groupBy("a", "b", "part").agg(F.collect_list("hashes").alias("two"))
    partial = met.filter(F.size("two") == 2).select("a", "b", F.size(F.array_intersect(F.col("two")[0], F.col("two")[1])).alias("k"))
    return partial.groupBy("a", "b").agg(F.sum("k").alias("overlap"))


def _merged(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """``id, component`` after ``links`` (``a, b``) between components or ids that have none yet."""
    found = common.written(components(links), "joined")
    if groups is None:
        return found
    now = groups.join(found.select(F.col("id").alias("component"), F.col("component").alias("_now")), "component", "left")
    fresh = found.join(groups.select("id"), "id", "left_anti")
    return common.written(now.select("id", F.coalesce("_now", "component").alias("component")).unionByName(fresh.select("id", "component")), "groups")


def _in_mixed_lists(met: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``met`` with each member's group as ``label``, and whether that is the list's largest; lists of one group are left out.

    Written, so that the joins on it start from plain exchanges, which Spark can split where a shingle is frequent.
    """
    now = met.withColumn("label", F.col("uid"))
    if groups is not None:
        now = met.join(groups.withColumnRenamed("id", "uid"), "uid", "left").withColumn("label", F.coalesce("component", "uid")).drop("component")
    lists = now.groupBy("h", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count(F.lit(1)).alias("k"))
    lists = common.written(lists.filter("k > 1").select("h", "main"), "lists")
    out = common.written(now.join(lists, "h").withColumn("main", F.col("label") == F.col("main")), "mixed")
    common.discard(lists)
    return out


def _turn(members: DataFrame, level: int) -> DataFrame:
    """``a, b, la, lb, both``: the pairs of the lists' members of this level with others of this level or a lower one."""
    side = lambda x: [F.col("h"), *(F.col(c).alias(f"{c[0]}{x}") for c in ("uid", "n", "place", "label"))]
    # What can still be reached: sizes, and what is left behind this shingle if it is the first in common.
    near = (F.col("la") != F.col("lb")) & (DENOMINATOR * F.least("na", "nb") >= NUMERATOR * F.greatest("na", "nb"))
    reach = (NUMERATOR + DENOMINATOR) * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= NUMERATOR * (F.col("na") + F.col("nb"))
    lead, rest = members.filter(F.col("level") == level), members.filter(F.col("level") <= level)
    met = [one.select(side("a")).join(two.select(side("b")), "h").filter(near & reach) for one, two in ((lead, rest.filter("not main")), (lead.filter("not main"), rest.filter("main")))]
    swap = F.col("ua") > F.col("ub")
    pick = lambda x, y, name: F.when(swap, F.col(x)).otherwise(F.col(y)).alias(name)
    return met[0].unionByName(met[1]).select(pick("ub", "ua", "a"), pick("ua", "ub", "b"), pick("lb", "la", "la"), pick("la", "lb", "lb"), (F.col("na") + F.col("nb")).alias("both")).distinct()


def join_groups(docs: DataFrame, words: int = WORDS, block_bytes: int = BLOCK_BYTES, fragment_bytes: int = FRAGMENT_BYTES, least_fragments: int = LEAST_FRAGMENTS) -> DataFrame:
    """``doc_id, n_shingles, component_id``: documents joined by links of Jaccard similarity >= 3/4 on shingle sets.

    Null, empty and blank texts have no shingles and link with nothing; texts of fewer words than a shingle have one,
    the whole sequence. Repeated rows and null ids each give a row; a component's id is the smallest id in it that is
    not null (null if all are). Other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    common.ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(least_fragments, -(-size // fragment_bytes))
    found = common.written(_fragments(_dealt(docs, fragments, words, block_bytes), fragments), "fragments")
    rows = found.filter(F.col("n").isNotNull()).select("uid", "doc_id", "n", "same")
    # Equal sets are one class; its least uid is the first of its block and so has the segments.
    classes = common.written(rows.filter("n > 0").groupBy("same", "n").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("doc_id")), "classes")
    segments = found.filter(F.col("fragment").isNotNull()).select("uid", "fragment", "hashes", "shared_by")
    enough = segments.groupBy("uid").agg(F.sum(F.size("hashes")).alias("m")).join(classes.select("uid", "n"), "uid").filter(DENOMINATOR * F.col("m") >= NUMERATOR * F.col("n"))
    parts = segments.join(enough, "uid").withColumn("part", (F.col("fragment") * COUNTED_IN / F.lit(fragments)).cast("int"))
    kept = common.written(parts.groupBy("uid", "n", "m", "part").agg(F.flatten(F.collect_list("hashes")).alias("hashes"), F.flatten(F.collect_list("shared_by")).alias("shared_by")), "segments")
    common_part = kept.select("uid", "part", "hashes")
    # The prefix: with a of n shingles at least to be shared, one of the first n - a + 1. Those of this document alone come first.
    order = F.sort_array(F.flatten(F.collect_list(F.zip_with("shared_by", "hashes", lambda by, h: F.struct(by.alias("by"), h.alias("h"))))))
    first = F.col("n") - F.ceil(NUMERATOR * F.col("n") / DENOMINATOR) + 1 - (F.col("n") - F.col("m"))
    prefixes = kept.groupBy("uid", "n", "m").agg(order.alias("shared")).select("uid", "n", F.posexplode(F.slice("shared", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("at", "s"), "m").select("uid", "n", (F.col("n") - F.col("m") + F.col("at")).alias("place"), F.col("s.h").alias("h"))
    prefixes = common.written(prefixes, "prefixes")
    lists = common.written(prefixes.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "lists")
    longest = lists.agg(F.max("k")).first()[0] or 1
    top = math.ceil(math.log(longest, GROWTH))
    random = (F.shiftrightunsigned(F.xxhash64("uid", F.lit(3)), 11) + 1) * 2.0**-53
    level = F.least(F.floor(-F.log(random) / math.log(GROWTH)), F.lit(top)).cast("int")
    met = common.written(prefixes.join(lists.select("h"), "h").withColumn("level", level), "met")
    common.discard(prefixes)

    groups: DataFrame | None = None
    before = met
    for turn in range(top, -1, -1):
        members = _in_mixed_lists(met, groups)
        if not rows_in(members):
            break
        pairs = common.written(_turn(members, turn), "pairs")
        # Lists of one group stay so: the next turn starts from those that are still mixed.
        common.discard(before)
        met, before = members.drop("label", "main"), members
        tried = rows_in(pairs)
        if tried:
            fit = _overlaps(pairs.select("a", "b"), tried, common_part).join(pairs, ["a", "b"]).filter((NUMERATOR + DENOMINATOR) * F.col("overlap") >= NUMERATOR * F.col("both"))
            fit = common.written(fit.select(F.col("la").alias("a"), F.col("lb").alias("b")), "fit")
            if rows_in(fit):
                groups = _merged(groups, fit)
        common.discard(pairs)
    # By class, of which there is one row however many its copies are; written, so that a large group's join can be split.
    named = classes.withColumn("root", F.col("uid"))
    if groups is not None:
        named = classes.join(groups.withColumnRenamed("id", "uid"), "uid", "left").withColumn("root", F.coalesce("component", "uid")).drop("component")
        smallest = common.written(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
        named = common.written(named.drop("doc_id").join(smallest, "root").select("same", "n", "component_id"), "named")
    else:
        named = named.select("same", "n", F.col("doc_id").alias("component_id"))
    blank = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return rows.filter("n > 0").join(named, ["same", "n"]).select("doc_id", "n", "component_id").unionByName(blank).withColumnRenamed("n", "n_shingles")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: the row whose id is the group's smallest.

    Of rows that share that id, the first by text stays; rows without id stay only where no row of their group has one.
    Columns stay as they are, whatever their names.
    """
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1 or doc_id is null")
    if repeated.limit(1).count():
        return _with_repeats(docs)
    groups = common.written(join_groups(docs), "groups")
    gone = common.written(groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id"), "gone")
    return docs.join(F.broadcast(gone) if 16 * rows_in(gone) <= PAIRS_BROADCAST else gone, "doc_id", "left_anti").select(docs.columns)


def _with_repeats(docs: DataFrame) -> DataFrame:
    """Where ids repeat or are null, rows can't be told by id: number all rows and join those numbers instead."""
    uid = common.free_name("uid", docs.columns)
    named = common.written(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")
    groups = common.written(join_groups(named.select(F.col(uid).alias("doc_id"), "text")), "groups").select(F.col("doc_id").alias("uid"), F.col("component_id").alias("root"))
    keys = named.select(F.col(uid).alias("uid"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text")).join(groups, "uid")
    # The least row of each group; ids that are null come last.
    first = keys.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text", "uid")).alias("least")).select(F.col("least.uid").alias(uid))
    return named.join(common.written(first, "first"), uid, "left_semi").select(docs.columns)
