"""Exact top-k by integer inner product with MaxScore over sharded vectors.

A vector's dimensions are its terms. In a shard, a dimension's two postings lists hold the vectors with its highest
and its lowest components; a query term uses the list on the side of its weight's sign. For a vector outside a term's
list the term adds no more than the best component outside it; the term's gain is what the list's best adds beyond
that. Essential terms' lists are traversed, those of most gain first. What is new on a list is scored block of terms by
block of terms, strongest first, and leaves as soon as the remaining bounds can't make it competitive. The k-th best
score so far is the threshold; it rises with every list, and once the weaker lists together can't lift a vector over it
they are non-essential and not traversed. If even vectors on no list can reach the threshold, they are scored too.
A shard's index is built once; the queries stream past it. Shards' best are merged. All bounds are integers, so the
result is exact, ties included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import rows_in
from . import common

#: Vectors in a shard, about: bounds a task's memory.
SHARD_VECTORS = 8192
#: A postings list holds about one in so many of its shard's vectors.
LIST_SHARE = 8
#: Terms that a candidate is scored by before it is looked at again.
TERMS_TOGETHER = 16


class Shard:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.columns = ids[order], np.ascontiguousarray(vectors[order].T)
        self.copies = np.ones(len(ids), dtype=np.int64) if copies is None else copies[order]
        n = len(ids)
        take = max(1, n // LIST_SHARE)
        ranked = np.sort(self.columns, axis=1)
        self.top, self.bottom = ranked[:, -1], ranked[:, 0]
        self.cut_high, self.cut_low = ranked[:, -min(n, take + 1)], ranked[:, min(n - 1, take)]
        self.high = self.columns > self.cut_high[:, None]
        self.low = self.columns < self.cut_low[:, None]

    def best(self, own: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, scores and copies of the k best other than ``own``, ties to the smaller id; ``scored`` counts the vectors looked at."""
        dims = min(len(weights), len(self.columns))
        weights = weights[:dims]
        positive = weights > 0
        most = np.where(positive, weights * self.top[:dims], weights * self.bottom[:dims])
        outside = np.where(positive, weights * self.cut_high[:dims], weights * self.cut_low[:dims])
        gain = most - outside
        by_gain = np.argsort(gain, kind="stable")
        off_lists = outside.sum()
        reach = off_lists + np.cumsum(gain[by_gain])  # what a vector can score that is on the n weakest lists only
        strongest = np.argsort(-(np.abs(weights) * (self.top[:dims] - self.bottom[:dims])), kind="stable")
        blocks = [strongest[i : i + TERMS_TOGETHER] for i in range(0, dims, TERMS_TOGETHER)]
        left = [int(sum(most[x].sum() for x in blocks[i:])) for i in range(len(blocks))]
        found, scores, threshold, self.scored = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), None, 0

        def take(new: np.ndarray) -> None:
            nonlocal found, scores, threshold
            self.scored += len(new)
            total = np.zeros(len(new), dtype=np.int64)
            for x, bound in zip(blocks, left, strict=True):
                if threshold is not None:
                    stay = total + bound >= threshold
                    new, total = new[stay], total[stay]
                total += weights[x] @ self.columns[np.ix_(x, new)]
            found, scores = np.concatenate([found, new]), np.concatenate([scores, total])
            best = np.lexsort((self.ids[found], -scores))[:k]
            found, scores = found[best], scores[best]
            if len(scores) == k:
                threshold = int(scores[-1])

        open_ = self.ids != own
        for place in range(dims - 1, -1, -1):
            if threshold is not None and reach[place] < threshold:
                break  # this list and all weaker ones are non-essential
            t = by_gain[place]
            new = np.flatnonzero((self.high[t] if positive[t] else self.low[t]) & open_)
            if len(new):
                open_[new] = False
                take(new)
        else:
            if threshold is None or off_lists >= threshold:
                take(np.flatnonzero(open_))
        return self.ids[found], scores, self.copies[found]


def quantise(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of each component; rows whose id or vector is null, or that hold a null or non-finite component, are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return vectors.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(rows) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros, which add nothing."""
    width = max((len(v) for v in rows), default=0)
    out = np.zeros((len(rows), max(width, 1)), dtype=np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k best candidates (all, if fewer) other than rows of its own id.

    Both have ``vec_id, v`` as :func:`quantise` gives them. Ties go to the smaller id. Rows that repeat an id are
    candidates each; queries that repeat an id and vector are asked once. Vectors of unequal length meet in the
    dimensions that both have. Scores are 64-bit. With no candidates there are no rows.

    Each vector is sent to its shard once, each query to every shard: any of them may hold its best.
    """
    spark = candidates.sparkSession
    common.ship_package(spark)
    # Equal rows are one, with how many they are.
    rows = common.written(candidates.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")), "vectors")
    shards = max(1, -(-rows_in(rows) // shard_vectors))
    shard = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    stream = rows.select(shard, F.lit(0).alias("asks"), "vec_id", "v", "n").unionByName(queries.select("vec_id", "v").distinct().select(every, F.lit(1).alias("asks"), "vec_id", "v", F.lit(1).cast("long").alias("n")))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("n", pa.int64())])

    def run(batches):
        now, held, index = None, [], None
        for batch in common.slices(batches, 1024):
            shard, asks = (batch[c].to_numpy(zero_copy_only=False) for c in ("shard", "asks"))
            cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if shard[a] != now:
                    now, held, index = shard[a], [], None
                if not asks[a]:
                    held.append(part.select(["vec_id", "v", "n"]))
                    continue
                if index is None and held:
                    mine = pa.Table.from_batches(held)
                    held, index = [], Shard(mine["vec_id"].to_numpy(), _matrix(mine["v"].to_pylist()), mine["n"].to_numpy())
                out: list = [[], [], [], []]
                if index is not None:
                    for own, weights in zip(part["vec_id"].to_pylist(), _matrix(part["v"].to_pylist()), strict=True):
                        ids, scores, copies = index.best(own, weights, k)
                        for column, values in zip(out, ([own] * len(ids), ids.tolist(), scores.tolist(), copies.tolist()), strict=True):
                            column += values
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    dealt = stream.repartition(common.default_parallelism(spark), "shard").sortWithinPartitions("shard", "asks", "vec_id")
    partial = dealt.mapInArrow(run, "query_id long, vec_id long, score long, n long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    copies = F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy")
    return partial.select("query_id", "vec_id", "score", copies).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
