"""Connected components of links between ids: few links in one worker's memory, more in DataFrame rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import rows_in, seen_in
from . import common


#: Links that one worker joins by itself, counted before; about 100 bytes each there.
TOGETHER = 1_000_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in ``a`` and ``b``, ascending, and for each the smallest that links reach."""
    ids, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = codes[: len(a)], codes[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        # Greater roots go below the least one that a link shows them; then everything points at its root again.
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return ids, ids[root]


def _together(links: DataFrame) -> DataFrame:
    common.ship_package(links.sparkSession)

    def run(batches):
        sides = [(batch["a"].to_numpy(), batch["b"].to_numpy()) for batch in batches if len(batch)]
        if sides:
            ids, least = least_reachable(*(np.concatenate(x) for x in zip(*sides, strict=True)))
            yield from pa.table({"id": ids, "component": least}).to_batches(max_chunksize=65_536)

    return links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").coalesce(1).mapInArrow(run, "id long, component long")


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) for every id in ``links`` (``a, b``); ids without links aren't in it.

    At most TOGETHER links are joined by one task. More of them alternate two steps until nothing changes: every id
    passes the least id among itself and its neighbours to its greater neighbours, then to its smaller ones. Stars form
    in a number of rounds that grows with the logarithm of the number of ids, and no id ever gathers its neighbours'
    list in one row.
    """
    if not hasattr(links, "_seen"):
        links = common.written(links.select("a", "b"), "links")
    if rows_in(links) <= TOGETHER:
        return _together(links)
    both = lambda x: x.unionByName(x.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sign = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    edges = common.written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", sign=sign)
    before = rows_in(edges), seen_in(edges, "sign")
    while before[0]:
        # Large star: greater neighbours of u go to the least id around u.
        around = both(edges)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = around.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: smaller neighbours of u, and u itself, go to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        after = common.written(small, "edges", sign=sign)
        now = rows_in(after), seen_in(after, "sign")
        common.discard(edges)
        edges, same, before = after, now == before, now
        if same:  # the same set of edges, by count and sum of hashes
            break
    stars = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return stars.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
