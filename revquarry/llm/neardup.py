"""Near-duplicate vectors by lattice hashing.

Unit vectors are projected at random to eight dimensions, once for each of several tables, and decoded to the nearest
point of the E8 lattice, their cell. A vector is kept in its own cell and probes the cells next nearest to its
projection; pairs that meet in a cell are verified by cosine in double precision. Equal vectors are one class. A cell
is worked on in tiles of bounded size, every pair of tiles by itself, so that no cell has to fit one task and no pairs
are written out: a tile pair yields each vector's number of links and a spanning forest of the links. A pair is counted
only in the first table in which it meets.

How fine the cells are, and how many tables that takes, follows from the number of vectors: finer cells hold fewer
vectors that have nothing to do with each other, coarser ones need fewer tables for the same recall.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import rows_in
from . import common
from .components import components

THRESHOLD = 0.95
#: Probes beside the own cell; how likely two vectors with a cosine of just the threshold must meet in some table.
PROBES, RECALL = 8, 0.999
#: Scales of the projections against the lattice's that are considered, and what a vector's place in a cell costs in comparisons.
SCALES, PLACE_COST = tuple(0.6 * 1.15**k for k in range(14)), 500
#: Pairs that the chance of meeting is estimated from, and tables at most.
PAIRS_DRAWN, MOST_TABLES = 2000, 512
#: Members of a tile.
TILE = 1024
SEED = 8
#: Links whose earlier meetings are looked up at once.
LINKS_TOGETHER = 20_000


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest point of D8 (integers of even sum) to each row."""
    r = np.rint(x)
    odd = r.sum(axis=1).astype(np.int64) % 2 != 0
    off = x - r
    worst = np.argmax(np.abs(off), axis=1)
    rows = np.flatnonzero(odd)
    r[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the union of D8 and D8 moved by halves."""
    a = nearest_d8(x)
    b = nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all of +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        signs = np.array([1 if bits >> k & 1 else -1 for k in range(8)])
        if (signs < 0).sum() % 2 == 0:
            out.append(signs / 2)
    return np.array(out)


AROUND = neighbours()


def lattice(unit: np.ndarray, tables: int, probes: int, scale: float, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Twice each vector's own lattice point, (vectors, tables, 8), and which neighbours it probes, (vectors, tables, probes)."""
    own, near = np.empty((len(unit), tables, 8), dtype=np.int16), np.empty((len(unit), tables, probes), dtype=np.uint8)
    for t in range(tables):
        rng = np.random.default_rng([seed, t, unit.shape[1]])
        projected = unit @ rng.standard_normal((unit.shape[1], 8)) * scale + rng.random(8)
        point = nearest_e8(projected)
        rest = projected - point
        own[:, t] = np.rint(2 * point)
        # |rest - n|^2 = |rest|^2 - 2 rest.n + 2: the nearest neighbouring cells have the largest rest.n.
        if probes:
            near[:, t] = np.argpartition(-(rest @ AROUND.T), probes, axis=1)[:, :probes]
    return own, near


def codes(own: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Hashes of each vector's cells: shape (vectors, tables, 1 + probes), the own cell first."""
    mixer = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 2**64) for k in range(8)], dtype=np.uint64)
    twice = np.rint(2 * AROUND).astype(np.int64)
    points = np.concatenate([own[:, :, None, :].astype(np.int64), own[:, :, None, :] + twice[near]], axis=2)
    code = (points.astype(np.uint64) * mixer).sum(axis=3, dtype=np.uint64)
    code ^= code >> np.uint64(31)
    return (code * np.uint64(0xD6E8FEB86659FD93) + np.arange(own.shape[1], dtype=np.uint64)[:, None]).view(np.int64)


def cells(unit: np.ndarray, tables: int, probes: int = PROBES, scale: float = SCALES[2], seed: int = SEED) -> np.ndarray:
    return codes(*lattice(unit, tables, probes, scale, seed))


def meeting(dims: int, threshold: float, scale: float, probes: int = PROBES) -> float:
    """How likely two vectors at the threshold meet in one table, from PAIRS_DRAWN drawn pairs."""
    rng = np.random.default_rng([SEED, dims])
    a, b = (rng.standard_normal((PAIRS_DRAWN, dims)) for _ in range(2))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold * threshold)) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = (cells(v, 4, probes, scale, SEED + 1) for v in (a, b))
    return float(((x[:, :, :1] == y).any(axis=2) | (y[:, :, :1] == x).any(axis=2)).mean())


def plan(n: int, dims: int, threshold: float = THRESHOLD, probes: int = PROBES, recall: float = RECALL) -> tuple[float, int]:
    """Scale and number of tables for ``n`` vectors: what costs least of all that reach the recall.

    A vector has 1 + probes places in each table, and is compared with all that share one: of unrelated vectors about a
    (1 + 2 probes)th of the projections' density, integrated over itself, (4 pi scale^2)^-4.
    """
    best = None
    for scale in SCALES:
        p = min(0.9999, meeting(max(dims, 2), threshold, scale, probes))
        if p <= 0 or (tables := math.ceil(math.log(1 - recall) / math.log(1 - p))) > MOST_TABLES:
            continue
        cost = tables * ((1 + probes) * PLACE_COST + n * min(1.0, (1 + 2 * probes) / (4 * math.pi * scale * scale) ** 4))
        if best is None or cost < best[0]:
            best = cost, scale, tables
    return best[1:] if best else (SCALES[0], MOST_TABLES)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (i, j) of a spanning forest of the links a[k]-b[k] among 0..n-1."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    """A list column whose lists are equally long."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


class Tile:
    """Members of one cell, those of one tile or of two."""

    def __init__(self, threshold: float, tables: int, probes: int):
        self.threshold, self.tables, self.probes = threshold, tables, probes

    def codes(self, marks: list[bytes]) -> np.ndarray:
        """The cells again, from lattice points and probes: they tell where a pair has met before."""
        each = 16 + self.probes
        raw = np.frombuffer(b"".join(marks), dtype=np.uint8).reshape(len(marks), self.tables, each)
        return codes(np.ascontiguousarray(raw[:, :, :16]).view("<i2"), raw[:, :, 16:])

    def links(self, table: int, cell: int, a: int, b: int, tiles: np.ndarray, unit: np.ndarray, marks) -> tuple[np.ndarray, np.ndarray]:
        """The links that count here: first met in this table, and in it in this cell."""
        left, right = np.flatnonzero(tiles == a), np.flatnonzero(tiles == b)
        i, j = np.nonzero(unit[left] @ unit[right].T >= self.threshold)
        i, j = left[i], right[j]
        if a == b:
            i, j = i[i < j], j[i < j]
        if len(i):
            some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            found = self.codes([marks[k] for k in some.tolist()])
            mine = np.zeros(len(i), dtype=bool)
            for start in range(0, len(i), LINKS_TOGETHER):
                part = slice(start, start + LINKS_TOGETHER)
                mine[part] = self._counts_here(found, at[: len(i)][part], at[len(i) :][part], table, cell)
            i, j = i[mine], j[mine]
        return i, j

    @staticmethod
    def _counts_here(found: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, cell: int) -> np.ndarray:
        open_ = np.ones(len(i), dtype=bool)
        here = np.zeros(len(i), dtype=bool)
        for t in range(table + 1):
            x, y = found[i, t], found[j, t]
            by_y, by_x, same = (x[:, 1:] == y[:, :1]).any(axis=1), (x[:, :1] == y[:, 1:]).any(axis=1), x[:, 0] == y[:, 0]
            if t < table:
                open_ &= ~(by_y | by_x | same)
            else:
                # Two that probe each other meet in both home cells; which one counts may not depend on the order of rows or tiles.
                both = by_x & by_y
                at = np.where(both, np.minimum(x[:, 0], y[:, 0]), np.where(same | by_x, x[:, 0], y[:, 0]))
                here = (both | same | by_x | by_y) & (at == cell)
        return open_ & here


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int | None = None, probes: int = PROBES, scale: float | None = None, tile: int = TILE, seed: int = SEED) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding``.

    Links join vectors of equal length with cosine >= ``threshold``. A vector that is null, empty, zero or holds a null
    or non-finite component links with nothing and is its own component. Repeated rows count as vectors of their own
    (with one id and so one component), each linked to the other. A row without id stays, without component, not kept.
    ``tables`` and ``scale`` follow from the number of vectors unless given.
    """
    spark = vectors.sparkSession
    common.ship_package(spark)
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(~F.exists("embedding", odd) & F.exists("embedding", lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", sound.alias("_sound"))
    # Classes of equal vectors: one representative each, with how many they are.
    members = common.written(rows.filter("_sound").select("vec_id", F.col("embedding").alias("v")), "vectors")
    classes = common.written(members.groupBy("v").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("rep")), "classes")

    if tables is None or scale is None:
        dims = classes.agg(F.max(F.size("v"))).first()[0] or 2
        planned = plan(rows_in(classes), dims, threshold, probes)
        scale, tables = scale or planned[0], tables or planned[1]

    def hash_cells(batches):
        for batch in common.slices(batches, 4096):
            lists = batch["v"]
            lengths = np.diff(lists.offsets.to_numpy())
            out = np.empty((len(lists), tables * (1 + probes)), dtype=np.int64)
            marks = np.empty((len(lists), tables, 16 + probes), dtype=np.uint8)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                own, near = lattice(_unit(_matrix(lists.take(pa.array(at)))), tables, probes, scale, seed)
                out[at] = codes(own, near).reshape(len(at), -1)
                marks[at] = np.concatenate([own.astype("<i2").view(np.uint8), near], axis=2)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch["rep"], flat, pa.array([x.tobytes() for x in marks], pa.binary())], names=["rep", "cells", "marks"])

    hashed = common.written(classes.select("rep", "v").mapInArrow(hash_cells, "rep long, cells array<long>, marks binary"), "cells")
    width = 1 + probes
    # Postings by cell: a vector is there by its own cell (home) or by a probe. Cells that nothing calls home decide nothing.
    postings = hashed.select("rep", F.posexplode("cells").alias("_p", "cell")).select("rep", "cell", F.floor(F.col("_p") / width).cast("int").alias("of"), (F.col("_p") % width == 0).alias("home"))
    sizes = postings.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes")).filter("n > 1 and homes > 0")
    live = postings.join(sizes, "cell").select("cell", "of", "rep", F.ceil(F.col("n") / tile).cast("int").alias("tiles")).withColumn("tile", F.pmod(F.xxhash64("rep", F.lit(77)), F.col("tiles")).cast("int"))
    full = classes.join(hashed.select(F.col("rep").alias("_rep"), "marks"), F.col("rep") == F.col("_rep")).select("rep", "size", "v", "marks")
    live = live.join(full, "rep")
    # Every tile meets every tile of its cell once: a row goes to all tile pairs that it is part of.
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, F.col("tile")).alias("a"), F.greatest(k, F.col("tile")).alias("b")))
    met = live.select("cell", "of", F.size("v").alias("dims"), "tile", "rep", "size", "v", "marks", F.explode(pairs).alias("p")).select("cell", "of", "dims", "p.a", "p.b", "tile", "rep", "size", "v", "marks")
    keys = ["cell", "of", "dims", "a", "b"]
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def verify(batches):
        tile_ = Tile(threshold, tables, probes)
        held: list[pa.Table] = []

        def runs(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
            key = [table[k].to_numpy() for k in keys]
            new = np.zeros(len(key[0]), dtype=bool)
            for k in key:
                new[1:] |= k[1:] != k[:-1]
            return np.concatenate([[0], np.flatnonzero(new), [len(new)]]), key

        def work(table: pa.Table, starts: np.ndarray, key: list[np.ndarray]) -> pa.RecordBatch:
            ids, size, tiles = (table[c].to_numpy() for c in ("rep", "size", "tile"))
            out: list = [[], [], []]
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if hi - lo < 2:
                    continue
                part = table.slice(lo, hi - lo)
                cell, of, _, a, b = (int(k[lo]) for k in key)
                i, j = tile_.links(of, cell, a, b, tiles[lo:hi], _unit(_matrix(part["v"])), part["marks"].to_pylist())
                if not len(i):
                    continue
                own, count = ids[lo:hi], size[lo:hi]
                n = np.bincount(i, weights=count[j], minlength=hi - lo) + np.bincount(j, weights=count[i], minlength=hi - lo)
                some = np.flatnonzero(n)
                out[0] += own[some].tolist()
                out[1] += n[some].astype(np.int64).tolist()
                out[2] += [None] * len(some)
                for p, q in forest(int(hi - lo), i, j):
                    out[0].append(int(own[p]))
                    out[1].append(0)
                    out[2].append(int(own[q]))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            table = pa.concat_tables(held)
            starts, key = runs(table)
            if len(starts) > 2:  # the last run may go on in the next batch
                yield work(table, starts[:-1], key)
                table = table.slice(int(starts[-2]))
            held = [table]
        if held and held[0].num_rows:
            yield work(held[0], *runs(held[0]))

    dealt = met.repartition(common.default_parallelism(spark), *keys).sortWithinPartitions(*keys)
    seen = common.written(dealt.mapInArrow(verify, "rep long, n long, other long"), "links")
    linked = seen.filter("n > 0").groupBy("rep").agg(F.sum("n").alias("links"))
    joined = components(seen.filter("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "rep")
    by_class = common.written(classes.join(linked, "rep", "left").join(joined, "rep", "left").select(F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "by_class")  # written: a join of plain exchanges can be split where one vector is frequent
    known = members.join(by_class, F.col("v") == F.col("_v")).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("_sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
