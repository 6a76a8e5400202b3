"""Packing documents into sequences by a grouping genetic algorithm on islands.

The genes are whole sequences (bins). Crossover injects well-filled bins of one parent into the other, drops the bins
that held any of their pieces and puts the displaced pieces back: first a displaced piece takes the place of a shorter
one wherever it fills a bin better, then the rest goes in by best fit, longest first. Mutation empties the poorest bins
and some others likewise. Fewer bins are fitter, and of as many those with more in full bins. Pieces are dealt at
random into blocks of bounded size; each block evolves on several islands, whose elites migrate to the next island
between epochs, and the best island's bins stand. Bins that a block could not fill go to the next round, where the
blocks are dealt anew, until one block holds all that is left. Where less than half finds a full bin, blocks grow up to
a bound; where that does not help either, no dealing would, and every block's bins stand.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import word_pieces

CAPACITY = 4096
#: Pieces in a block, about: bounds a task's memory and the cost of a generation.
BLOCK_PIECES = 4096
#: Blocks grow, where hardly anything fits any better, to so many times that at most.
MOST_GROWTH = 4
#: Bits of a bin's number in its block within a sequence's id; a block has far fewer bins.
BIN_BITS = 22
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2, 2, 4, 5
#: Part of the pieces that a round must settle, else blocks grow.
LEAST_SETTLED = 0.5
#: A bin at least so full is kept; the pieces of others are packed again with those of other blocks.
KEPT_FILL = 0.999

PIECES_SCHEMA = pa.schema([("pid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every whole text (null: empty) with ``end_id`` appended, each with a ``pid`` of its own."""
    common.ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    end = end_id.to_bytes(4, "little")

    def run(batches):
        pieces = word_pieces(path)
        pid = TaskContext.get().partitionId() << 33
        for batch in common.slices(batches):
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                raw = memoryview(pieces.encode(text) + end)
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((pid, doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    pid += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES_SCHEMA, strict=True)] if rows else [pa.array([], f.type) for f in PIECES_SCHEMA], schema=PIECES_SCHEMA)

    return docs.mapInArrow(run, "pid long, doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """One block's problem: ``lengths`` in descending order. A solution is a list of bins, each a list of places in it."""

    def __init__(self, lengths: list[int], capacity: int, rng: random.Random):
        self.lengths, self.capacity, self.rng = lengths, capacity, rng
        self.least = -(-sum(lengths) // capacity)

    def fill(self, bin_: list[int]) -> int:
        return sum(map(self.lengths.__getitem__, bin_))

    def best_fit(self, bins: list[list[int]], items: list[int]) -> list[list[int]]:
        """Put ``items`` into the fullest bins that still hold them, in the order given; new bins where none does."""
        free = sorted((self.capacity - self.fill(b), k) for k, b in enumerate(bins))
        for i in items:
            n = self.lengths[i]
            at = bisect_left(free, (n, -1))
            if at < len(free):
                room, k = free.pop(at)
                bins[k].append(i)
                if room > n:
                    insort(free, (room - n, k))
            else:
                bins.append([i])
                if n < self.capacity:
                    insort(free, (self.capacity - n, len(bins) - 1))
        return bins

    def put_back(self, bins: list[list[int]], displaced: list[int]) -> list[list[int]]:
        """Displaced pieces replace shorter ones where that fills a bin better, longest first; what is left goes in by best fit."""
        lengths = self.lengths
        pool = sorted((lengths[i], i) for i in displaced)
        for members in bins:
            room = self.capacity - self.fill(members)
            if not room or not pool:
                continue
            for at, i in enumerate(members):
                n = lengths[i]
                k = bisect_right(pool, (n + room, len(lengths))) - 1
                if k >= 0 and pool[k][0] > n:
                    longer, j = pool.pop(k)
                    members[at], room = j, room - (longer - n)
                    insort(pool, (n, i))
                    if not room:
                        break
        return self.best_fit(bins, [i for _, i in reversed(pool)])

    def fitness(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins, then more in full ones."""
        return -len(bins), sum((self.fill(b) / self.capacity) ** 2 for b in bins)

    def perfect(self, bins: list[list[int]]) -> bool:
        """No packing has fewer bins, and all but one are full."""
        return len(bins) == self.least and sum(self.fill(b) < self.capacity for b in bins) <= 1

    def individual(self, shaken: float) -> list[list[int]]:
        """Best fit over the lengths in about descending order."""
        order = range(len(self.lengths))
        if shaken:
            order = sorted(order, key=lambda i: self.lengths[i] * (1 - shaken * self.rng.random()), reverse=True)
        return self.best_fit([], list(order))

    def crossover(self, a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
        """``a`` with some of the well-filled bins of ``b``."""
        ranked = sorted(b, key=self.fill, reverse=True)
        good = ranked[: max(1, len(ranked) // 2)]
        injected = self.rng.sample(good, max(1, len(good) // 2))
        taken = {i for x in injected for i in x}
        kept = [x for x in a if taken.isdisjoint(x)]
        displaced = [i for x in a if not taken.isdisjoint(x) for i in x if i not in taken]
        return self.put_back([list(x) for x in (*injected, *kept)], displaced)

    def mutation(self, bins: list[list[int]]) -> list[list[int]]:
        ranked = sorted(bins, key=self.fill, reverse=True)
        n = min(len(ranked), max(2, len(ranked) // 20))
        rest = ranked[:-n]
        emptied = ranked[-n:] + [rest.pop(self.rng.randrange(len(rest))) for _ in range(min(n, len(rest)))]
        return self.put_back([list(x) for x in rest], [i for x in emptied for i in x])

    def evolve(self, seeds: list[list[list[int]]]) -> list[list[int]]:
        """The fittest after some generations, earlier only where nothing can be fitter."""
        people = [*seeds]
        while len(people) < POPULATION:
            people.append(self.individual(0.0 if not people else 0.2 * len(people)))
        score = {id(x): self.fitness(x) for x in people}
        for _ in range(GENERATIONS):
            people.sort(key=lambda x: score[id(x)], reverse=True)
            if self.perfect(people[0]):
                break
            # Half of the people are children; each has the fitter of two for its body, and the other's good bins.
            children = []
            for _ in range(len(people) // 2):
                a, b = sorted(self.rng.sample(range(len(people)), 2))
                children.append(self.mutation(self.crossover(people[a], people[b])))
            people[-len(children) :] = children
            score = {id(x): score.get(id(x)) or self.fitness(x) for x in people}
        return max(people, key=self.fitness)


def _epoch(rows: DataFrame, capacity: int, level: int, epoch: int) -> DataFrame:
    """rows: block, island, items (by length, longest first), own and migrant: bin of each item or null."""

    def run(batches):
        for batch in batches:
            blocks, islands, found, fitness = batch["block"].to_pylist(), batch["island"].to_pylist(), [], []
            for block, island, lengths, *bins in zip(blocks, islands, batch["lengths"].to_pylist(), batch["own"].to_pylist(), batch["migrant"].to_pylist(), strict=True):
                problem = Packing(lengths, capacity, random.Random(f"{level} {block} {island} {epoch}"))
                seeds = []
                for x in bins:
                    if x is not None:
                        groups: dict[int, list[int]] = {}
                        for i, k in enumerate(x):
                            groups.setdefault(k, []).append(i)
                        seeds.append(list(groups.values()))
                best = problem.evolve(seeds)
                of = [0] * len(lengths)
                for k, members in enumerate(best):
                    for i in members:
                        of[i] = k
                found.append(of)
                fitness.append([float(x) for x in problem.fitness(best)])
            yield pa.RecordBatch.from_arrays([batch["block"], batch["island"], batch["pids"], batch["lengths"], pa.array(found, pa.list_(pa.int32())), pa.array(fitness, pa.list_(pa.float64()))], names=["block", "island", "pids", "lengths", "own", "fitness"])

    return rows.mapInArrow(run, "block long, island int, pids array<long>, lengths array<long>, own array<int>, fitness array<double>")


def _settle(best: DataFrame, capacity: int, level: int, last: bool) -> DataFrame:
    """``pid, length, sequence_id, offset``; the latter two null for pieces that are packed again."""
    schema = pa.schema([("pid", pa.int64()), ("length", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        for batch in batches:
            for block, pids, lengths, of in zip(batch["block"].to_pylist(), batch["pids"].to_pylist(), batch["lengths"].to_pylist(), batch["own"].to_pylist(), strict=True):
                groups: dict[int, list[int]] = {}
                for i, k in enumerate(of):
                    groups.setdefault(k, []).append(i)
                rows = []
                for k, members in groups.items():
                    kept = last or sum(lengths[i] for i in members) >= KEPT_FILL * capacity
                    offset = 0
                    for i in members:
                        rows.append((pids[i], lengths[i], (((level << 56) + (block << BIN_BITS) + k) << 1) + 1 if kept else None, offset if kept else None))
                        offset += lengths[i]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return best.mapInArrow(run, "pid long, length long, sequence_id long, offset long")


def assign(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``pid, sequence_id, offset`` for every piece of a written table with ``pid, length``."""
    whole = pieces.filter(F.col("length") == capacity).select("pid", (2 * F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, left = [whole], pieces.filter(F.col("length") < capacity).select("pid", "length")
    level, n, most, stuck = 0, left.count(), MOST_GROWTH * block_pieces, False
    while n:
        blocks = -(-n // block_pieces)
        last = blocks == 1 or stuck
        item = F.transform(F.sort_array(F.collect_list(F.struct("length", "pid")), asc=False), lambda x: x)
        grouped = left.groupBy(F.pmod(F.xxhash64("pid", F.lit(level)), F.lit(blocks)).alias("block")).agg(item.alias("items"))
        rows = grouped.select("block", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), F.col("items.pid").alias("pids"), F.col("items.length").alias("lengths"), F.lit(None).cast("array<int>").alias("own"), F.lit(None).cast("array<int>").alias("migrant"))
        elites = None
        for epoch in range(EPOCHS):
            if elites is not None:
                ring = Window.partitionBy("block").orderBy("island")
                rows = elites.withColumn("migrant", F.coalesce(F.lag("own").over(ring), F.last("own").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
            elites = _epoch(rows, capacity, level, epoch)
        best = elites.groupBy("block").agg(F.max_by(F.struct("pids", "lengths", "own"), F.struct(F.col("fitness"), -F.col("island"))).alias("x")).select("block", "x.*")
        settled = common.written(_settle(best, capacity, level, last), f"packed{level}")
        done.append(settled.filter(F.col("sequence_id").isNotNull()).select("pid", "sequence_id", "offset"))
        left = settled.filter(F.col("sequence_id").isNull()).select("pid", "length")
        left_n = 0 if last else left.count()
        if left_n > (1 - LEAST_SETTLED) * n:  # larger blocks, as far as a task's memory bears them
            stuck = 2 * block_pieces > most
            block_pieces = block_pieces if stuck else 2 * block_pieces
        level, n = level + 1, left_n
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: all documents in as few sequences as it can.

    A null text counts as empty: its one piece is the end id. Only documents longer than ``capacity`` are cut.
    Repeated rows and null ids each are documents of their own; other columns are ignored; an empty table gives none.
    """
    pieces = common.written(cut(docs, path, end_id, capacity), "pieces")
    return pieces.join(assign(pieces, capacity, block_pieces), "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
